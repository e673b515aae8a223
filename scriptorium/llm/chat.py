"""Preference formatting: a shared prompt and two masked completions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranks import ranked

#: A rendered turn is OPEN + role + MIDDLE + text + CLOSE.
OPEN, MIDDLE, CLOSE = "<|", "|>\n", "<|end|>\n"
#: The role whose turns a model learns.
LEARNED = "assistant"
_TURN = "array<struct<role:string,text:string>>"


def _turns(c: str) -> Column:
    """Turns without nulls: a null list is empty, null roles and texts are empty strings."""
    each = lambda t: F.struct(F.coalesce(t["role"], F.lit("")).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text"))
    return F.transform(F.filter(F.coalesce(F.col(c).cast(_TURN), F.array().cast(_TURN)), lambda t: t.isNotNull()), each)


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), t["role"], F.lit(MIDDLE), t["text"], F.lit(CLOSE))), "")


def _mask(turns: Column) -> Column:
    """``a-b`` for each learned turn, comma-joined: the characters of its text and end mark, counted in the completion."""
    head = lambda t: F.length(t["role"]) + len(OPEN) + len(MIDDLE)
    body = lambda t: F.length(t["text"]) + len(CLOSE)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))
    step = lambda acc, t: F.struct(
        (acc["at"] + head(t) + body(t)).alias("at"),
        F.when(t["role"] == LEARNED, F.concat(acc["spans"], F.array(F.concat_ws("-", acc["at"] + head(t), acc["at"] + head(t) + body(t))))).otherwise(acc["spans"]).alias("spans"),
    )
    return F.aggregate(turns, start, step, lambda acc: F.array_join(acc["spans"], ","))


def preference_format(pairs: DataFrame) -> DataFrame:
    """``pairs(.., chosen, rejected)``, both array<struct<role, text>>, -> adds ``prompt_turns, prompt, chosen_text, chosen_mask, rejected_text, rejected_mask``; ``chosen`` and ``rejected`` go.

    The prompt renders the longest common prefix of turns, once; completions
    render the rest.  Masks are the character ranges of the completion that
    count for learning: the assistant's texts with their end marks.  Equal
    conversations have two empty completions; null or empty ones have no turns;
    null turns are left out.
    """
    n = F.least(F.size("__c"), F.size("__r"))
    differs = F.filter(F.sequence(F.lit(1), n), lambda i: F.element_at("__c", i.cast("int")) != F.element_at("__r", i.cast("int")))
    prefix = F.when(n == 0, 0).when(F.size(differs) > 0, differs[0] - 1).otherwise(n)
    rest = lambda c: F.slice(c, F.col("prompt_turns") + 1, F.greatest(F.size(c) - F.col("prompt_turns"), F.lit(0)))
    out = pairs.withColumns({"__c": _turns("chosen"), "__r": _turns("rejected")}).drop("chosen", "rejected").withColumn("prompt_turns", prefix)
    out = out.withColumn("prompt", _render(F.slice("__c", 1, F.col("prompt_turns"))))
    for name, c in (("chosen", "__c"), ("rejected", "__r")):
        out = out.withColumns({f"{name}_text": _render(rest(c)), f"{name}_mask": _mask(rest(c))})
    return out.drop("__c", "__r")


def conversation_pairs(conversations: DataFrame) -> DataFrame:
    """``conversations(conv_id, turn, role, text)`` -> ``chosen_id, rejected_id, chosen, rejected``, every conversation in one pair.

    Conversations with the same first turn are ranked by a hash of their id and
    paired two by two; the lower id counts as chosen.  One that is left over is
    paired with itself with a stale last answer: the assistant's last turn
    there repeats the turn before it.  Turns are ordered by (turn, role, text);
    rows without conv_id belong to no conversation and are left out.
    """
    own = F.col("conv_id").cast("long").alias("conv_id")
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    turns = conversations.filter("conv_id is not null").select(own, turn.alias("t"))
    # pairs are found on ids alone; the turns come once, by pair
    first = turns.groupBy("conv_id").agg(F.min("t").alias("t"))
    keyed = first.select("conv_id", F.md5(F.concat("t.role", F.lit("\n"), "t.text")).alias("opening"), _hash().alias("h"))
    place = ranked(keyed, ["h", "conv_id"], "opening")
    both = place.groupBy("opening", F.expr("rank div 2").alias("pair")).agg(F.min("conv_id").alias("chosen_id"), F.max("conv_id").alias("rejected_id"))
    member = both.select("chosen_id", "rejected_id", F.explode(F.array_distinct(F.array("chosen_id", "rejected_id"))).alias("conv_id"))
    out = turns.join(member, "conv_id").groupBy("chosen_id", "rejected_id").agg(F.sort_array(F.collect_list(F.struct((F.col("conv_id") != F.col("chosen_id")).alias("other"), "t"))).alias("all"))
    side = lambda other: F.transform(F.filter("all", lambda x: x["other"] == other), lambda x: F.struct(x["t"]["role"].alias("role"), x["t"]["text"].alias("text")))
    out = out.select("chosen_id", "rejected_id", side(F.lit(False)).alias("chosen"), side(F.lit(True)).alias("other"))
    last = F.array_max(F.filter(F.sequence(F.lit(1), F.size("chosen")), lambda i: F.element_at("chosen", i)["role"] == LEARNED))
    stale = F.transform("chosen", lambda t, i: F.when(i + 1 == F.col("last"), F.struct(t["role"].alias("role"), F.element_at("chosen", F.greatest(F.col("last") - 1, F.lit(1)))["text"].alias("text"))).otherwise(t))
    out = out.withColumn("last", last).withColumn("rejected", F.when(F.col("chosen_id") == F.col("rejected_id"), F.when(F.col("last").isNull(), F.col("chosen")).otherwise(stale)).otherwise(F.col("other")))
    return out.select("chosen_id", "rejected_id", "chosen", "rejected")


def _hash() -> Column:
    """60 bits of the id's MD5."""
    return F.conv(F.substring(F.md5(F.col("conv_id").cast("string")), 1, 15), 16, 10).cast("long")


SQL = f"""
WITH turns AS (
  SELECT conv_id::BIGINT AS conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY ALL
), ranked AS (
  SELECT conv_id, md5(turns[1].role || chr(10) || turns[1].text) AS opening,
    row_number() OVER (PARTITION BY md5(turns[1].role || chr(10) || turns[1].text) ORDER BY ('0x' || substr(md5(conv_id::VARCHAR), 1, 15))::BIGINT, conv_id) - 1 AS nth
  FROM turns
), pairs AS (
  SELECT min(conv_id) AS chosen_id, max(conv_id) AS rejected_id FROM ranked GROUP BY opening, nth // 2
), both_ AS (
  SELECT chosen_id, rejected_id, a.turns AS c, b.turns AS o, list_max(list_filter(range(1, len(a.turns) + 1), lambda i: a.turns[i].role = '{LEARNED}')) AS last
  FROM pairs JOIN turns a ON a.conv_id = chosen_id JOIN turns b ON b.conv_id = rejected_id
), made AS (
  SELECT chosen_id, rejected_id, c, CASE WHEN chosen_id <> rejected_id THEN o WHEN last IS NULL THEN c
    ELSE list_transform(c, lambda t, i: CASE WHEN i = last THEN {{'role': t.role, 'text': c[greatest(last - 1, 1)].text}} ELSE t END) END AS r
  FROM both_
), cut AS (
  SELECT *, coalesce(list_min(list_filter(range(1, least(len(c), len(r)) + 1), lambda i: c[i] <> r[i])) - 1, least(len(c), len(r))) AS n FROM made
), parts AS (
  SELECT chosen_id, rejected_id, n, c[1:n] AS p, c[n + 1:] AS c, r[n + 1:] AS r FROM cut
)
SELECT chosen_id, rejected_id, n::INTEGER AS prompt_turns, @prompt AS prompt, @chosen AS chosen_text, @chosen_mask AS chosen_mask, @rejected AS rejected_text, @rejected_mask AS rejected_mask FROM parts
"""


def oracle() -> str:
    quoted = lambda s: "'" + s.replace("\n", "' || chr(10) || '") + "'"
    text = lambda x: f"coalesce(array_to_string(list_transform({x}, lambda t: {quoted(OPEN)} || t.role || {quoted(MIDDLE)} || t.text || {quoted(CLOSE)}), ''), '')"
    size = f"length(t.role) + length(t.text) + {len(OPEN) + len(MIDDLE) + len(CLOSE)}"
    start = lambda x: f"coalesce(list_sum(list_transform({x}[1:i - 1], lambda t: {size})), 0)::BIGINT + length({x}[i].role) + {len(OPEN) + len(MIDDLE)}"
    mask = lambda x: f"coalesce(array_to_string(list_transform(list_filter(range(1, len({x}) + 1), lambda i: {x}[i].role = '{LEARNED}'), lambda i: ({start(x)})::VARCHAR || '-' || ({start(x)} + length({x}[i].text) + {len(CLOSE)})::VARCHAR), ','), '')"
    sql = SQL
    for name, made in (("chosen_mask", mask("c")), ("rejected_mask", mask("r")), ("prompt", text("p")), ("chosen", text("c")), ("rejected", text("r"))):
        sql = sql.replace(f"@{name} AS", f"{made} AS")
    return sql
