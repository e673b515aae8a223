"""Mixing sources to target weights along a low-discrepancy schedule.

Only DataFrame functions: sources get targets by water-filling; each source's
documents, shuffled by hash, form a stream of words cut in equal blocks; the
slots of a golden-ratio schedule fall on sources by their cumulative weights,
are ranked by source, and take the source's blocks in order, going round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import running, table_written

WORDS = r"[^\x20\x09-\x0D]+"
#: Words of a block, and the least blocks that a source is cut in (or a block a word).
BLOCK_WORDS, SOURCE_BLOCKS = 64, 256
#: Blocks of a larger mix grow, so that there are about so many and every source keeps points of the schedule.
MOST_BLOCKS = 1 << 29
#: No document is taken more often.
MAX_REPEATS = 3
#: Golden-ratio points: multiples of this odd number (nearest 2**31 / 1.618034) modulo 2**31.
GOLDEN, POINTS = 1327217885, 1 << 31
#: Slots whose ranks one task works out together, and ranges that a source's shuffled documents fall in.
SLOT_RUN, SHUFFLE_RUNS = 1 << 16, 1 << 12


def targets(sources: DataFrame, repeats: int = MAX_REPEATS) -> DataFrame:
    """``sources(source, source_size)`` -> adds ``target double``.

    Weights 1, 2, 3, repeating, in code-point order, null last; together the
    targets make all sizes.  No target exceeds ``repeats`` times the source's
    size: the excess goes to the others by weight until none is above.  That
    is the least level that source by source min(weight * level, cap) reaches,
    found from sums in the order of cap / weight.
    """
    w = Window.partitionBy("__all")
    by_name = w.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    by_ratio = w.orderBy(F.col("__cap") / F.col("__w"), F.col("source").isNull(), F.col("source").cast("binary"))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    out = (
        sources.withColumn("__all", F.lit(0))
        .withColumn("__w", F.pmod(F.row_number().over(by_name) - 1, F.lit(3)) + 1)
        .withColumn("__cap", F.col("source_size") * repeats)
        .withColumn("__left", F.sum("source_size").over(w) - F.coalesce(F.sum("__cap").over(before), F.lit(0)))
        .withColumn("__open", F.sum("__w").over(w) - F.coalesce(F.sum("__w").over(before), F.lit(0)))
        .withColumn("__level", F.col("__left").cast("double") / F.col("__open"))
        .withColumn("__capped", F.col("__level") * F.col("__w") > F.col("__cap"))
        # the first source that isn't capped sets the level of all that follow
        .withColumn("__level", F.min(F.when(~F.col("__capped"), F.struct(F.col("__cap") / F.col("__w"), F.col("__open") * -1, F.col("__level")))).over(w)["__level"])
    )
    return out.withColumn("target", F.least(F.col("__cap").cast("double"), F.coalesce(F.col("__level") * F.col("__w"), F.col("__cap").cast("double")))).select("source", "source_size", "target")


def mix(docs: DataFrame, block_words: int = BLOCK_WORDS, source_blocks: int = SOURCE_BLOCKS) -> DataFrame:
    """The mix of all ``docs(doc_id, text, source)``.

    Returns ``doc_id, size, source_size, target, taken``, a row for each row of
    ``docs``: its words, its source's words and target, and the words that the
    mix takes of it, repeats counted.  No document is taken more than
    three times; each source's taken words come within a few blocks of its target.

    Null texts have size 0 and are taken 0 times; a null source is a source,
    the last one; repeated rows count each; ties in the shuffle are between
    equal rows only (same id and text) or ordered by the text's hash; other
    columns are ignored; an empty table gives an empty one.  Rows that tie
    in all of that are interchangeable.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    number = lambda c: F.conv(F.substring(F.md5(c), 1, 15), 16, 10).cast("long")
    rows = docs.select(
        F.col("doc_id").cast("long"), F.col("source").cast("string"), F.regexp_count(text, F.lit(WORDS)).cast("long").alias("size"),
        number(own).alias("k"), number(text).alias("k2"),
    )
    rows = table_written(rows.withColumn("row", F.monotonically_increasing_id()), "sizes")
    run = F.shiftright("k", 60 - SHUFFLE_RUNS.bit_length() + 1)
    w = Window.partitionBy("__all")
    sources = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")))
    # blocks of equal size in each source: m blocks over its words, block b from floor(b * size / m)
    whole = F.expr(f"(sum(source_size) over () + {MOST_BLOCKS - 1}) div {MOST_BLOCKS}")
    sources = sources.withColumn("w", F.greatest(F.lit(block_words).cast("long"), whole))
    sources = sources.withColumn("m", F.greatest(F.expr("(source_size + w - 1) div w"), F.least("source_size", F.lit(source_blocks).cast("long")))).drop("w")
    sources = sources.withColumn("slots", F.round(F.when(F.col("source_size") > 0, F.col("target") * F.col("m") / F.col("source_size")).otherwise(0.0)).cast("long"))
    sources = sources.withColumn("__all", F.lit(0)).withColumn("n", F.sum("slots").over(w))
    order = w.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    # in slots and then in points of the schedule, so that sums are exact
    sources = sources.withColumn("hi", F.sum("slots").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    point = lambda c: F.floor(F.col(c).cast("double") / F.col("n") * F.lit(float(POINTS))).cast("long")
    sources = sources.withColumn("lo", F.col("hi") - F.col("slots")).withColumn("hi", point("hi")).withColumn("lo", point("lo"))
    sources = table_written(sources.drop("__all"), "sources")
    total = sources.agg(F.max("n")).first()[0] or 0

    slots = docs.sparkSession.range(total).select(F.col("id").alias("slot"), F.pmod(F.pmod(F.col("id"), F.lit(POINTS)) * F.lit(GOLDEN), F.lit(POINTS)).alias("u"))
    # a point's source: its cell of a fine grid names the few sources that lie in it
    cells = sources.filter("hi > lo").select("source", "m", "lo", "hi", F.explode(F.sequence(F.shiftright("lo", 20), F.shiftright(F.col("hi") - 1, 20))).alias("cell"))
    slots = slots.withColumn("cell", F.shiftright("u", 20)).join(cells, "cell").filter("u >= lo and u < hi")
    slots = running(slots, ["source"], F.floor(F.col("slot") / SLOT_RUN), [F.col("slot")], F.lit(1), "rank")
    blocks = slots.filter(F.col("rank") < F.col("m") * MAX_REPEATS).groupBy("source", F.pmod("rank", "m").alias("block")).agg(F.count("*").alias("times"))

    sized = sources.select(F.col("source").alias("__s"), "source_size", "target", "m")
    rows = rows.join(sized, F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    placed = running(rows.filter("size > 0"), ["source"], run, [F.col("k"), F.col("doc_id"), F.col("size"), F.col("k2")], F.col("size"), "at")
    # block b holds the words from floor(b * size / m); word p is in block floor(((p + 1) * m - 1) / size)
    start = lambda b: F.expr(f"({b} * source_size) div m")
    holds = lambda p: F.expr(f"(({p} + 1) * m - 1) div source_size")
    pieces = placed.withColumn("block", F.explode(F.sequence(holds("at"), holds("(at + size - 1)"))))
    pieces = pieces.withColumn("words", F.least(F.col("at") + F.col("size"), start("(block + 1)")) - F.greatest(F.col("at"), start("block")))
    chosen = blocks.select(F.col("source").alias("__s"), F.col("block").alias("__b"), "times")
    pieces = pieces.join(chosen, F.col("source").eqNullSafe(F.col("__s")) & (F.col("block") == F.col("__b")), "left")
    out = ["doc_id", "size", "source_size", "target"]
    taken = pieces.groupBy("row", *out).agg(F.coalesce(F.sum(F.col("words") * F.col("times")), F.lit(0)).cast("long").alias("taken")).drop("row")
    return taken.unionByName(rows.filter("size = 0").select(*out, F.lit(0).cast("long").alias("taken")))


SQL = f"""
WITH rows AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORDS}'))::BIGINT AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS k, ('0x' || substr(md5(coalesce(text, '')), 1, 15))::BIGINT AS k2
  FROM documents
), s0 AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM rows GROUP BY source
), s1 AS (
  SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w, source_size * {MAX_REPEATS} AS cap FROM s0
), s2 AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0))::DOUBLE / (sum(w) OVER () - coalesce(sum(w) OVER before, 0))::DOUBLE AS level,
    row_number() OVER (ORDER BY cap::DOUBLE / w::DOUBLE, source NULLS LAST) AS nth
  FROM s1 WINDOW before AS (ORDER BY cap::DOUBLE / w::DOUBLE, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), s3 AS (
  SELECT source, source_size, least(cap::DOUBLE, coalesce((SELECT level FROM s2 WHERE level * w <= cap ORDER BY nth LIMIT 1) * w, cap::DOUBLE)) AS target,
    greatest((source_size + block - 1) // block, least(source_size, {SOURCE_BLOCKS}))::BIGINT AS m
  FROM (SELECT *, greatest({BLOCK_WORDS}, (sum(source_size) OVER () + {MOST_BLOCKS - 1}) // {MOST_BLOCKS})::BIGINT AS block FROM s2)
), s4 AS (
  SELECT *, CASE WHEN source_size > 0 THEN round(target * m / source_size) ELSE 0 END::BIGINT AS slots FROM s3
), s5 AS (
  SELECT *, sum(slots) OVER () AS n, sum(slots) OVER (ORDER BY source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM s4
), s6 AS (
  SELECT source, source_size, target, m, floor(upto::DOUBLE / n::DOUBLE * {float(POINTS)}::DOUBLE)::BIGINT AS hi, floor((upto - slots)::DOUBLE / n::DOUBLE * {float(POINTS)}::DOUBLE)::BIGINT AS lo
  FROM s5 WHERE n > 0
), slots AS (
  SELECT slot, (slot % {POINTS}) * {GOLDEN} % {POINTS} AS u FROM (SELECT unnest(range((SELECT coalesce(max(n), 0)::BIGINT FROM s5))) AS slot)
), ranked AS (
  SELECT source, m, row_number() OVER (PARTITION BY source ORDER BY slot) - 1 AS nth FROM slots JOIN s6 ON u >= lo AND u < hi
), blocks AS (
  SELECT source, nth % m AS block, count(*) AS times FROM ranked WHERE nth < m * {MAX_REPEATS} GROUP BY 1, 2
), placed AS (
  SELECT row_number() OVER () AS id, doc_id, r.source, size, s3.source_size, target, m,
    (sum(size) OVER (PARTITION BY r.source ORDER BY k, doc_id NULLS FIRST, size, k2 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::BIGINT - size AS pos
  FROM rows r JOIN s3 ON r.source IS NOT DISTINCT FROM s3.source
), pieces AS (
  SELECT *, unnest(range(((pos + 1) * m - 1) // source_size, ((pos + size) * m - 1) // source_size + 1)) AS block FROM placed WHERE size > 0
), taken AS (
  SELECT id, sum((least(pos + size, ((p.block + 1) * source_size) // p.m) - greatest(pos, (p.block * source_size) // p.m)) * times) AS words
  FROM pieces p JOIN blocks b ON p.source IS NOT DISTINCT FROM b.source AND p.block = b.block GROUP BY id
)
SELECT doc_id, size, source_size, target, coalesce(words, 0)::BIGINT AS taken FROM placed LEFT JOIN taken USING (id)
"""
