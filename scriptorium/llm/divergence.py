"""Audit of sources: how far each source's use of words is from that of its language and of the language's other sources.

Shares are integers in billionths, so every value is exact and the same on any cluster.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import as_bytes, slices, table_written

#: A language keeps the terms of at least so many of its documents; a group reports so many terms.
KEPT_DOCUMENTS, TOP_TERMS = 3, 200
#: Terms that a task holds before it passes their counts on, as many in a row; a document counts as so many occurrences in one number.
HELD_TERMS, TERMS_A_ROW, DOCUMENT = 800_000, 4096, 1 << 32
#: Sources of a language are dealt in blocks of so many; pairs are summed up in matrices of two blocks (512 KB).
BLOCK_SOURCES = 256
#: Parts that a group's terms are ranked in before the best of all are.
RANK_PARTS = 16
#: Matrices that a task holds, and pairs of postings that it unfolds at once.
HELD_MATRICES, PAIR_STEP = 32, 1 << 19
#: Lower-case A-Z; blank out other ASCII bytes.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def share(count: Column, total: Column) -> Column:
    """``1 + floor(10^9 (count + 1) / total)`` without overflow: a long division by thousands; ``total`` is under 9 * 10^15 and above ``count``."""
    digits, rest = F.lit(1), count + 1
    for scale in (1_000_000, 1_000, 1):
        rest = rest * 1000
        digits = digits + F.call_function("div", rest, total) * scale
        rest = rest % total
    return digits


def gap(p: Column, q: Column) -> Column:
    """``floor((p - q)^2 / q)``; under 10^18 for shares."""
    return F.call_function("div", (p - q) * (p - q), q)


def _gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def terms(text: bytes | None) -> list[bytes]:
    """``[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+`` of a UTF-8 text whose A-Z are lower-cased; none for null."""
    return text.translate(_LETTERS).split() if text else []


def term_counts(docs: DataFrame) -> DataFrame:
    """``docs(lang, source, text)`` -> ``lang, source, x``: occurrences and documents of terms, ``array<struct<term, n, docs>>``, added up in each task only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], dict[bytes, int]] = {}
        size = words = 0
        for part in slices(batches):
            for lang, source, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), as_bytes(part.column(2))):
                found = terms(text)
                words += len(found)
                own = held.setdefault((lang, source), {})
                size -= len(own)
                for term, n in Counter(found).items():  # a document and its occurrences as one number
                    own[term] = own.get(term, 0) + DOCUMENT + n
                size += len(own)
            if size > HELD_TERMS or words > DOCUMENT // 2:
                yield from out(held)
                held, size, words = {}, 0, 0
        yield from out(held)

    def out(held: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), own in held.items():
            counts = np.fromiter(own.values(), np.int64, len(own))
            columns = [pa.array(list(own), pa.binary()).cast(pa.string()), pa.array(counts % DOCUMENT), pa.array(counts // DOCUMENT)]
            cuts = [*range(0, len(own), TERMS_A_ROW), len(own)] if own else [0]
            listed = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.StructArray.from_arrays(columns, ["term", "n", "docs"]))
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(listed), pa.string()), pa.array([source] * len(listed), pa.string()), listed], ["lang", "source", "x"])

    return docs.mapInArrow(run, "lang string, source string, x array<struct<term:string,n:bigint,docs:bigint>>")


def postings(docs: DataFrame, groups: DataFrame, kept_documents: int = KEPT_DOCUMENTS) -> DataFrame:
    """The kept terms with the sources that have them: ``lang, term, total, first, block, ids, counts``.

    A row has a term's sources of one block, by their number in it, and the
    term's occurrences in the language; ``first`` marks one row of each term.
    Counts are added up by term and source before a term's sources meet, so a
    common term brings a row for each source, whatever its number of documents.
    """
    term = Window.partitionBy("lang", "term")
    counted = term_counts(docs).join(groups.select("lang", "source", "block", "id"), ["lang", "source"]).select("lang", "block", "id", F.inline("x"))
    counted = counted.groupBy("lang", "term", "block", "id").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    counted = counted.select("lang", "term", "block", "id", "n", F.sum("docs").over(term).alias("docs"), F.sum("n").over(term).alias("total"), (F.col("block") == F.min("block").over(term)).alias("first"))
    packed = counted.filter(F.col("docs") >= kept_documents).groupBy("lang", "term", "total", "first", "block").agg(F.collect_list(F.struct("id", "n")).alias("x"))
    return packed.select("lang", "term", "total", "first", "block", F.col("x.id").alias("ids"), F.col("x.n").alias("counts"))


def numbered_groups(docs: DataFrame, block: int = BLOCK_SOURCES) -> DataFrame:
    """``lang, source, block, id``: every group, numbered by source in its language; there are as many rows as groups."""
    at = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    groups = docs.select("lang", "source").distinct().withColumn("at", at)
    return groups.select("lang", "source", F.floor(F.col("at") / block).cast("int").alias("block"), (F.col("at") % block).cast("int").alias("id"))


def source_divergence(docs: DataFrame, kept_documents: int = KEPT_DOCUMENTS, top: int = TOP_TERMS, block: int = BLOCK_SOURCES) -> DataFrame:
    """``docs(text, lang, source)`` -> ``lang, source, part, item, value, rank``.

    Part ``pair`` ranks a language's other sources by the divergence of a
    source from them; part ``term`` the ``top`` terms that a source uses more than its
    language.  Null text, lang and source are ''.  Languages without kept
    terms have pairs of value 0 and no terms; ties go by item in UTF-8 order;
    repeated rows count as documents of their own; other columns are ignored;
    an empty table gives an empty one.
    """
    docs = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    groups = table_written(numbered_groups(docs, block), "sources")
    table = table_written(postings(docs, groups, kept_documents), "postings")
    flat = table.select("lang", "term", "total", "block", F.explode(F.arrays_zip("ids", "counts")).alias("x")).select("lang", "term", "total", "block", F.col("x.ids").alias("id"), F.col("x.counts").alias("n"))
    # the histogram of each group: how many of its terms occur so often, and how often these do in the language
    buckets = table_written(flat.groupBy("lang", "block", "id", "n").agg(F.count("*").alias("terms"), F.min("total").alias("least"), F.max("total").alias("most")), "buckets")
    sums = buckets.groupBy("lang", "block", "id").agg(F.sum(F.col("n") * F.col("terms")).alias("size"))
    kept = table.filter("first").groupBy("lang").agg(F.count("*").alias("kept"), F.sum("total").alias("lang_size"))
    stats = groups.join(sums, ["lang", "block", "id"], "left").join(kept, "lang", "left")
    stats = table_written(stats.select("lang", "source", "block", "id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("kept", "lang_size", "size")]).withColumn("none", F.when(F.col("kept") > 0, share(F.lit(0), F.col("size") + F.col("kept")))), "shares")
    most = stats.agg(F.max("block")).first()[0]
    return _pairs(table, buckets, stats, most or 0, block).unionByName(_terms(flat, buckets, stats, top))


def _with_shares(rows: DataFrame, stats: DataFrame) -> DataFrame:
    """Adds ``source``, ``p`` and ``q``: the shares of a count in its group, and of ``total`` in the language."""
    rows = rows.join(stats.select("lang", "block", "id", "source", "size", "kept", "lang_size"), ["lang", "block", "id"])
    return rows.withColumn("p", share(F.col("n"), F.col("size") + F.col("kept"))).withColumn("q", share(F.col("total"), F.col("lang_size") + F.col("kept")))


def _terms(flat: DataFrame, buckets: DataFrame, stats: DataFrame, top: int) -> DataFrame:
    """Best-first search over the buckets of each group, in two batches.

    All terms of a bucket have one share in the group, so the least share in
    the language bounds their values.  The buckets with the highest bounds, to ``top``
    terms, give a kth value; then all whose bound isn't below it are evaluated.
    """
    group = ["lang", "block", "id"]
    bounded = _with_shares(buckets.withColumn("total", F.col("least")), stats).filter("p > q").withColumn("bound", gap(F.col("p"), F.col("q")))
    bounded = table_written(bounded.select(*group, "n", "terms", "bound"), "bounds")
    order = Window.partitionBy(*group).orderBy(F.desc("bound"), F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)
    early = bounded.withColumn("seen", F.coalesce(F.sum("terms").over(order), F.lit(0))).filter(F.col("seen") < top)
    value = gap(F.col("p"), F.col("q"))

    def evaluated(chosen: DataFrame) -> DataFrame:
        return _with_shares(flat.join(chosen, [*group, "n"]), stats).filter("p > q").withColumn("value", value)

    kth = _best(evaluated(early.select(*group, "n")).select(*group, "term", "value"), group, top)
    kth = kth.groupBy(*group).agg(F.when(F.count("*") >= top, F.min("value")).otherwise(F.lit(-1)).alias("kth"))
    late = bounded.join(table_written(kth, "kth"), group).filter(F.col("bound") >= F.col("kth")).select(*group, "n", "kth")
    found = evaluated(late).filter(F.col("value") >= F.col("kth"))
    return _best(found, group, top).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")


def _best(rows: DataFrame, group: list[str], top: int) -> DataFrame:
    """The ``top`` rows of each group by value and term, with their ``rank``.

    The terms of a group are ranked in parts first, so that of a group with many no task gets more than a part's and the parts' best.
    """
    order = [F.desc("value"), F.col("term")]
    part = F.row_number().over(Window.partitionBy(*group, "__part").orderBy(*order))
    rows = rows.withColumn("__part", F.pmod(F.xxhash64("term"), F.lit(RANK_PARTS))).withColumn("__rank", part).filter(F.col("__rank") <= top).drop("__part", "__rank")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("rank") <= top)


def _pairs(table: DataFrame, buckets: DataFrame, stats: DataFrame, most: int, size: int) -> DataFrame:
    """Divergence of each two sources of a language, from histograms and postings.

    With ``f00`` for a term that neither has, the sum over all terms is ``kept *
    f00`` and corrections: for the terms of each source alone, by its buckets;
    and for those of both, by the postings.  Terms that neither has are never visited.
    """
    blocks = stats.groupBy("lang", "block").agg(F.sort_array(F.collect_list(F.struct("id", "none"))).alias("x"))
    blocks = table_written(blocks.select("lang", F.col("block").alias("other"), F.col("x.none").alias("others")), "blocks")
    single = buckets.join(stats.select("lang", "block", "id", "size", "kept", "none"), ["lang", "block", "id"])
    single = single.select("lang", "block", "id", "terms", share(F.col("n"), F.col("size") + F.col("kept")).alias("p"), "none")
    alone = single.join(blocks, "lang").select("lang", "block", "id", "terms", "p", "none", "other", "others").mapInArrow(lambda batches: _alone(batches, size), _PARTS)
    sizes = stats.groupBy("lang", "block").agg(F.sort_array(F.collect_list(F.struct("id", "size"))).alias("x"), F.first("kept").alias("kept"))
    sizes = table_written(sizes.select("lang", "block", F.col("x.size").alias("sizes"), "kept"), "sizes")
    shares = F.transform(F.arrays_zip("ids", "counts"), lambda x: share(x["counts"], F.element_at("sizes", x["ids"] + 1) + F.col("kept")))
    nones = F.transform("ids", lambda i: share(F.lit(0), F.element_at("sizes", i + 1) + F.col("kept")))
    ready = table.join(sizes, ["lang", "block"]).select("lang", "term", "block", "ids", shares.alias("p"), nones.alias("none"))
    # a term's sources meet in a task: those of a block as one row, those of two blocks as two
    together = ready.select("lang", "block", "ids", "p", "none", *[F.lit(None).cast(t).alias(f"{c}2") for c, t in (("block", "int"), ("ids", "array<int>"), ("p", "array<bigint>"), ("none", "array<bigint>"))])
    if most > 0:
        b = ready.select("lang", "term", *[F.col(c).alias(f"{c}2") for c in ("block", "ids", "p", "none")])
        together = together.unionByName(ready.join(b, ["lang", "term"]).filter("block < block2").drop("term"))
    parts = alone.unionByName(together.mapInArrow(lambda batches: _together(batches, size), _PARTS))
    exact = parts.groupBy("lang", "at", "at2").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("more"))
    here = stats.select("lang", "source", (F.col("block") * size + F.col("id")).alias("at"), "none", "kept")
    there = here.select("lang", F.col("source").alias("item"), F.col("at").alias("at2"), F.col("none").alias("none2"))
    rows = here.join(there, "lang").filter("at <> at2").join(exact, ["lang", "at", "at2"], "left")
    both = F.coalesce(F.col("kept") * gap(F.col("none"), F.col("none2")), F.lit(0)).cast("decimal(38,0)")
    rows = rows.withColumn("value", (both + F.coalesce("more", F.lit(0).cast("decimal(38,0)"))).cast("long"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return rows.select("lang", "source", F.lit("pair").alias("part"), "item", "value", rank.alias("rank"))


_PARTS = "lang string, at int, at2 int, value long"


def _parts(lang: str, at: np.ndarray, at2: np.ndarray, value: np.ndarray) -> pa.RecordBatch:
    keep = (value != 0) & (at != at2)
    columns = [pa.array([lang] * int(keep.sum()), pa.string()), *(pa.array(x[keep].astype(t)) for x, t in ((at, np.int32), (at2, np.int32), (value, np.int64)))]
    return pa.RecordBatch.from_arrays(columns, ["lang", "at", "at2", "value"])


def _alone(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Corrections for the terms of one source, against every source of a block: as the first of a pair, and as the second."""
    for batch in batches:
        lang, other = batch.column(0).to_pylist(), batch.column(6).to_pylist()
        block, id_, terms_, p, none = (batch.column(k).to_numpy() for k in range(1, 6))
        at = block.astype(np.int64) * size + id_
        by: dict[tuple[str, int], list[int]] = {}
        for i, key in enumerate(zip(lang, other)):
            by.setdefault(key, []).append(i)
        for (name, far), rows in by.items():
            rows = np.array(rows)
            rows = rows[np.argsort(at[rows], kind="stable")]
            others = batch.column(7)[int(rows[0])].values.to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], at[rows][1:] != at[rows][:-1]]))
            n, mine, zero = terms_[rows, None], p[rows, None], none[rows, None]
            first = np.add.reduceat(n * (_gap(mine, others) - _gap(zero, others)), starts)
            second = np.add.reduceat(n * (_gap(others, mine) - _gap(others, zero)), starts)
            own, there = np.repeat(at[rows][starts], len(others)), np.tile(np.arange(len(others)) + far * size, len(starts))
            yield _parts(name, own, there, first.ravel())
            yield _parts(name, there, own, second.ravel())


def _together(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Corrections for the terms of both sources of a pair, summed up by task."""
    held: dict[tuple[str, int, int], np.ndarray] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for (lang, a, b), sums in held.items():
            i, j = np.divmod(np.flatnonzero(sums), size)
            yield _parts(lang, i + a * size, j + b * size, sums.ravel()[sums.ravel() != 0])
        held.clear()

    def add(key: tuple[str, int, int], rows: np.ndarray, left: tuple, right: tuple) -> None:
        sums = held.setdefault(key, np.zeros((size, size), np.int64)).ravel()
        found = left[1][rows] * right[1][rows]
        cuts = np.searchsorted(np.cumsum(found) // PAIR_STEP, np.arange(1, int(found.sum()) // PAIR_STEP + 2))
        for part in np.split(rows, cuts):
            if len(part):
                i, j = _unfolded(left, right, part)
                s, t = left[0][:, i], right[0][:, j]
                value = _gap(s[1], t[1]) - _gap(s[1], t[2]) - _gap(s[2], t[1]) + _gap(s[2], t[2])
                np.add.at(sums, s[0] * size + t[0], value)

    for batch in batches:
        names, blocks, blocks2 = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(5).to_pylist()
        left, right = _lists(batch, 2), _lists(batch, 6)
        by: dict[tuple[str, int, int | None], list[int]] = {}
        for i, key in enumerate(zip(names, blocks, blocks2)):
            by.setdefault(key, []).append(i)
        for (lang, a, b), rows in by.items():
            rows = np.array(rows)
            if b is None:
                add((lang, a, a), rows, left, left)
            else:
                add((lang, a, b), rows, left, right)
                add((lang, b, a), rows, right, left)
            if len(held) > HELD_MATRICES:
                yield from out()
    yield from out()


def _lists(batch: pa.RecordBatch, at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, shares and shares of no occurrence) of all rows in a row, lengths and starts of each row's."""
    lists = [batch.column(at + k) for k in range(3)]
    sizes = lists[0].value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = np.array([x.flatten().to_numpy().astype(np.int64) for x in lists])
    return values, sizes, np.cumsum(sizes) - sizes


def _unfolded(left: tuple, right: tuple, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of each element of a row's left list with each of its right one."""
    a, b = left[1][rows], right[1][rows]
    sizes = a * b
    row = np.repeat(np.arange(len(rows)), sizes)
    inside = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return left[2][rows][row] + inside // b[row], right[2][rows][row] + inside % b[row]


SQL = """
WITH d AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS words FROM documents
), t AS (
  SELECT doc, lang, source, unnest(words) AS term FROM d
), k AS (
  SELECT lang, term, count(*) AS total FROM t GROUP BY lang, term HAVING count(DISTINCT doc) >= 3
), g AS (
  SELECT DISTINCT lang, source FROM d
), c AS (
  SELECT lang, source, term, count(*) AS n FROM t GROUP BY lang, source, term
), full_counts AS (
  SELECT g.lang, g.source, k.term, k.total, coalesce(c.n, 0) AS n FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)
), p AS (
  SELECT *, 1 + (1000000000::HUGEINT * (n + 1)) // (sum(n) OVER s + count(*) OVER s) AS p, 1 + (1000000000::HUGEINT * (total + 1)) // (sum(total) OVER s + count(*) OVER s) AS q
  FROM full_counts WINDOW s AS (PARTITION BY lang, source)
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL
), every_pair AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0) AS value FROM g a JOIN g b USING (lang) LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  WHERE a.source <> b.source
), terms AS (
  SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value FROM p WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM every_pair UNION ALL SELECT * FROM terms)
) WHERE part = 'pair' OR rank <= 200
"""
