"""Repair of conversation structure: a forward Viterbi search over the states of a turn grammar.

A conversation is right if the initials of its roles are ``(s?(ua)+)?``.  The
search finds the cheapest edits of a damaged one; of equally cheap ones that
whose initials in order, the audit, come first in ASCII.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEEP, REROLE, DELETE, INSERT = "KRDI"
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 3, 4, 3, 3
START, SYSTEM, USER, ASSISTANT = range(4)
#: Where a turn with such an initial leads.
STEPS = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
#: States that inserted turns lead to; two are enough, as more only go round.
INSERTS = {START: (START, USER, ASSISTANT), SYSTEM: (SYSTEM, USER, ASSISTANT), USER: (USER, ASSISTANT), ASSISTANT: (ASSISTANT, USER)}
#: Roles of inserted and rewritten turns, by the state they lead to.
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: Output rows that a task holds before it passes them on.
PLANS_HELD = 1024
#: Characters that are white space here, as a class of a regular expression.
SPACE = r"\x20\x09-\x0D"


def _moves() -> dict[tuple[str, bool, bool], list[list[tuple[int, int, str]]]]:
    """By (initial, must go, truncated) and state: (state after, cost, initials of inserts and edit) of each edit of a turn."""
    out = {}
    for initial in ("s", "u", "a", ""):
        for gone, cut in ((True, False), (False, True), (False, False)):
            by = []
            for state in range(4):
                found = []
                for n, at in enumerate(INSERTS[state]):
                    before, cost = INSERT * n, INSERT_COST * n
                    found.append((at, cost + DELETE_COST, before + DELETE))
                    if not gone:
                        extra = cost + (TRUNCATED_COST if cut else 0)
                        if initial in STEPS[at]:
                            found.append((STEPS[at][initial], extra, before + KEEP))
                        found += [(STEPS[at][i], extra + REROLE_COST, before + REROLE) for i in "ua" if i in STEPS[at]]
                by.append(found)
            out[initial, gone, cut] = by
    return out


MOVES = _moves()
#: What a task stores of a step: the state before, and the initials of its inserts and edit.
_SUFFIXES = sorted({m[2] for by in MOVES.values() for found in by for m in found})
_CODE = {(s, x): 4 * k + s for k, x in enumerate(_SUFFIXES) for s in range(4)}


class Search:
    """The layer of states after some turns, each with its least (cost, audit) and the digest of its repaired turns.

    Audits aren't kept as strings: those of two states always differ at a place
    that both have (the one isn't the other's beginning, as both end with the edit
    of the same turn), so their order is fixed for good, and a rank of each
    state stands for it.  A turn takes four bytes, to read the audit back.
    """

    def __init__(self) -> None:
        self.layer = {START: (0, 0, hashlib.sha256())}  # state: (cost, rank of the audit, digest)
        self.back = bytearray()

    def turn(self, role: str, text: bytes, gone: bool, cut: bool) -> None:
        """One more turn; ``gone``: it must be deleted; ``cut``: it is truncated, which costs if it stays."""
        initial = role[:1] if role[:1] in ("s", "u", "a") else ""
        best: dict[int, tuple[int, int, str, int]] = {}
        for state, (cost, rank, _) in self.layer.items():
            for after, more, suffix in MOVES[initial, gone, cut and not gone][state]:
                key = (cost + more, rank, suffix, state)
                if after not in best or key < best[after]:
                    best[after] = key
        order = {after: k for k, after in enumerate(sorted(best, key=lambda a: best[a][1:3]))}
        layer, back = {}, bytearray(b"\xff" * 4)
        for after, (cost, _, suffix, state) in best.items():
            back[after] = _CODE[state, suffix]
            layer[after] = (cost, order[after], self._digest(state, suffix, role, text))
        self.layer = layer
        self.back += back

    def _digest(self, state: int, suffix: str, role: str, text: bytes):
        digest = self.layer[state][2]
        if suffix == DELETE:
            return digest  # shared until another turn is written
        digest = digest.copy()
        for edit in suffix:
            if edit == DELETE:
                break
            first = state == START
            if edit == KEEP:
                own, written = role, text
            else:
                state = next(STEPS[state][i] for i in "ua" if i in STEPS[state])
                own, written = ROLES[state], text if edit == REROLE else b""
            digest.update(b"%s%s:" % (b"" if first else b"\n", own.encode()))
            digest.update(written)
        return digest

    def result(self) -> tuple[int, str, str]:
        """(cost, audit, SHA-256 of the repaired turns)."""
        ends = []
        for state, (cost, rank, _) in self.layer.items():
            for n, at in enumerate(INSERTS[state]):
                if at in (START, ASSISTANT):
                    ends.append((cost + n * INSERT_COST, rank, INSERT * n, state))
        cost, _, suffix, state = min(ends)
        digest = self._digest(state, suffix, "", b"").hexdigest()
        parts = [suffix]
        for at in range(len(self.back) - 4, -1, -4):
            code = self.back[at + state]
            parts.append(_SUFFIXES[code >> 2])
            state = code & 3
        return cost, "".join(reversed(parts)), digest


def key_of(conv: str = "conv_id", turn: str = "turn") -> Column:
    """``conv_id:turn``, where a null is one space."""
    return F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (conv, turn)])


def damaged(rows: DataFrame) -> DataFrame:
    """``rows(conv_id, turn, role, text)`` with reproducible damage: ``conv_id, turn, role, text, lost``.

    By the CRC-32 of ``conv_id:turn`` modulo 20 a row is lost (0), its text
    emptied (1) or robbed of ``.!?`` (2), the row repeated (3), or its role set
    to user (4).  Lost rows stay, without text, so that their conversation is
    known.  A null role or text is one space.  Other columns are left out.
    """
    kind = F.crc32(key_of()) % 20
    text = F.coalesce(F.col("text").cast("string"), F.lit(" "))
    out = rows.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.when(kind == 4, "user").otherwise(F.coalesce(F.col("role").cast("string"), F.lit(" "))).alias("role"),
        F.when(kind < 2, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        (kind == 0).alias("lost"),
        F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("__copy"),
    )
    return out.drop("__copy")


def _order() -> list[Column]:
    """The order of a conversation's rows; rows that these don't tell apart are alike."""
    return [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]


def with_faults(rows: DataFrame) -> DataFrame:
    """``rows(conv_id, turn, role, text, lost)`` by conversation, with ``blank``, ``repeated`` and ``truncated``.

    A conversation's rows come together and in order; they are dealt out once.
    """
    alike = Window.partitionBy("conv_id", "lost", "role", "text").orderBy(F.col("turn").asc_nulls_first())
    return (
        rows.repartition("conv_id")
        .withColumn("repeated", F.row_number().over(alike) > 1)
        .withColumn("blank", ~F.col("text").rlike(f"[^{SPACE}]"))
        .withColumn("truncated", ~F.col("text").rlike(rf"[.!?][{SPACE}]*\z"))
        .sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("lost").desc(), *_order(), "repeated")
    )


def repair_plans(rows: DataFrame) -> DataFrame:
    """The cheapest repair of each conversation of ``rows(conv_id, turn, role, text, lost)``, as ``damaged`` gives them.

    Returns ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256``.  Rows without conv_id are one conversation.  Rows are
    taken by turn, nulls first, then role and text; a row's first fault counts:
    blank, seen earlier in its conversation, truncated.  A conversation whose
    rows are all lost has zeros, an empty audit and the digest of nothing; an
    empty table gives an empty one; other columns are ignored.

    Rows stream through a task: of a conversation it keeps four bytes a turn
    and one running digest a state, never its texts.  Sorting spills to disk.
    The digest of a conversation is one chain, so a conversation isn't split.
    """
    kind = rows.schema["conv_id"].dataType
    ready = with_faults(rows).select("conv_id", "lost", "turn", "role", "text", "blank", "repeated", "truncated")
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    schema = T.StructType([T.StructField("conv_id", kind), *[T.StructField(n, T.LongType()) for n in names[1:7]], *[T.StructField(n, T.StringType()) for n in names[7:]]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, out = None, []
        for batch in batches:
            ids = batch.column(0)
            for at in range(batch.num_rows):
                conv = ids[at].as_py()
                if one is None or conv != one.conv:
                    if one is not None:
                        out.append(one.row())
                    one = _Conversation(conv)
                    if len(out) >= PLANS_HELD:
                        yield _batch(out, names, ids.type)
                        out = []
                if not batch.column(1)[at].as_py():
                    one.add(*(batch.column(k)[at].as_py() for k in range(2, 8)))
        if one is not None:
            yield _batch([*out, one.row()], names, ids.type)

    return ready.mapInArrow(run, schema)


def _batch(rows: list[tuple], names: list[str], kind: pa.DataType) -> pa.RecordBatch:
    types = [kind, *[pa.int64()] * 6, pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names)


class _Conversation:
    """Counts and search of the conversation that a task reads."""

    def __init__(self, conv) -> None:
        self.conv, self.search = conv, Search()
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first = self.last = self.initial = None

    def add(self, turn: int | None, role: str, text: str, blank: bool, repeated: bool, cut: bool) -> None:
        if turn is not None and turn != self.last:
            self.turns += 1
            self.first = turn if self.first is None else self.first
            self.last = turn
        self.blank += blank
        self.duplicate += repeated and not blank
        gone = blank or repeated
        self.truncated += cut and not gone
        if self.initial is not None and self.initial + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.initial = role[:1]
        self.search.turn(role, text.encode(), gone, cut and not gone)

    def row(self) -> tuple:
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        return (self.conv, gaps, self.blank, self.duplicate, self.truncated, self.illegal, *self.search.result())


def repaired_turns(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """The turns that ``plans`` (of ``repair_plans``) make of ``rows`` (of ``damaged``): ``conv_id, place, edit, role, text``.

    ``place`` counts a conversation's repaired turns from 0; ``edit`` is K, R
    or I.  Deleted rows and conversations without turns have no rows here.
    """
    conv = Window.partitionBy("conv_id")
    edits = plans.select("conv_id", F.posexplode(F.split("audit", "")).alias("at", "edit")).filter("edit <> ''")
    edits = edits.withColumn("n", F.when(F.col("edit") != INSERT, F.sum((F.col("edit") != INSERT).cast("long")).over(conv.orderBy("at"))))
    numbered = rows.filter(~F.col("lost")).withColumn("n", F.row_number().over(conv.orderBy(*_order())).cast("long"))
    same = edits["conv_id"].eqNullSafe(numbered["conv_id"]) & (edits["n"] == numbered["n"])
    kept = edits.filter(F.col("edit") != DELETE).join(numbered.select("conv_id", "n", "role", "text"), same, "left").select(edits["conv_id"], "at", "edit", "role", "text")
    kept = kept.withColumn("place", F.row_number().over(conv.orderBy("at")).cast("long") - 1)
    led = F.max((F.col("place") == 0) & (F.col("edit") == KEEP) & F.col("role").startswith("s")).over(conv)
    second = (F.col("place") + led.cast("long")) % 2 == 1
    role = F.when(F.col("edit") == KEEP, F.col("role")).when(second, "assistant").otherwise("user")
    return kept.select("conv_id", "place", "edit", role.alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def conversation_repair(conversations: DataFrame) -> DataFrame:
    """Damage ``conversations(conv_id, turn, role, text)`` reproducibly and plan the repair of each; see ``damaged`` and ``repair_plans``."""
    return repair_plans(damaged(conversations))


def _crc() -> str:
    """CRC-32 of a key's bytes in SQL: eight shifts a byte."""
    return """list_reduce(list_prepend(4294967295::BIGINT, [ascii(c)::BIGINT FOR c IN string_split(key, '')]), lambda h, b:
      list_reduce(list_prepend(xor(h, b), [0::BIGINT FOR _ IN range(8)]), lambda x, _: xor(x >> 1, (x & 1) * 3988292384)))"""


SQL = f"""
WITH RECURSIVE raw AS (
  SELECT conv_id AS id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor({_crc()}, 4294967295) % 20 AS kind
  FROM (SELECT *, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations)
), rows AS (
  SELECT id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM raw, range(CASE WHEN kind = 3 THEN 2 ELSE 1 END) WHERE kind > 0
), faults AS (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY turn NULLS FIRST, role, text, again) AS n, NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') AS blank,
    NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') AS cut,
    lag(left(role, 1)) OVER (PARTITION BY id ORDER BY turn NULLS FIRST, role, text) || left(role, 1) AS two
  FROM (SELECT *, row_number() OVER (PARTITION BY id, role, text ORDER BY turn NULLS FIRST) > 1 AS again FROM rows)
), grammar(state, initial, after) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)
), inserts(state, inserted, after, lines) AS (VALUES (0, '', 0, []), (0, 'I', 2, ['user:']), (0, 'II', 3, ['user:', 'assistant:']), (1, '', 1, []), (1, 'I', 2, ['user:']),
  (1, 'II', 3, ['user:', 'assistant:']), (2, '', 2, []), (2, 'I', 3, ['assistant:']), (3, '', 3, []), (3, 'I', 2, ['user:'])
), paths(id, n, state, cost, audit, lines) AS (
  SELECT DISTINCT id, 0::BIGINT, 0, 0::BIGINT, '', []::VARCHAR[] FROM raw
  UNION ALL
  SELECT id, n, state, cost, audit, lines FROM (
    SELECT *, row_number() OVER (PARTITION BY id, state ORDER BY cost, audit) AS place FROM (
      SELECT p.id, f.n, e.state, p.cost + 3 * length(i.inserted) + e.cost AS cost, p.audit || i.inserted || e.edit AS audit, p.lines || i.lines || e.lines AS lines
      FROM paths p JOIN faults f ON f.id IS NOT DISTINCT FROM p.id AND f.n = p.n + 1 JOIN inserts i ON i.state = p.state,
      LATERAL (
        SELECT i.after AS state, 4 AS cost, 'D' AS edit, []::VARCHAR[] AS lines
        UNION ALL SELECT g.after, 3 * f.cut::INT, 'K', [f.role || ':' || f.text] FROM grammar g WHERE g.state = i.after AND g.initial = left(f.role, 1) AND NOT f.blank AND NOT f.again
        UNION ALL SELECT g.after, 3 + 3 * f.cut::INT, 'R', [CASE g.initial WHEN 'u' THEN 'user:' ELSE 'assistant:' END || f.text] FROM grammar g
          WHERE g.state = i.after AND g.initial <> 's' AND NOT f.blank AND NOT f.again
      ) e
    )
  ) WHERE place = 1
), ends AS (
  SELECT p.id, p.cost + 3 * length(i.inserted) AS cost, p.audit || i.inserted AS audit, p.lines || i.lines AS lines
  FROM paths p JOIN inserts i USING (state) JOIN (SELECT id, max(n) AS n FROM paths GROUP BY id) z ON z.id IS NOT DISTINCT FROM p.id AND z.n = p.n WHERE i.after IN (0, 3)
  QUALIFY row_number() OVER (PARTITION BY p.id ORDER BY p.cost + 3 * length(i.inserted), p.audit || i.inserted) = 1
), counts AS (
  SELECT id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (NOT blank AND again) AS duplicate,
    count(*) FILTER (NOT blank AND NOT again AND cut) AS truncated, count(*) FILTER (two NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faults GROUP BY id
)
SELECT e.id AS conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, e.cost::BIGINT AS cost, e.audit, sha256(array_to_string(e.lines, chr(10))) AS repaired_sha256
FROM ends e LEFT JOIN counts c ON c.id IS NOT DISTINCT FROM e.id
"""
