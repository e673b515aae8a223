"""Near copies by the Jaccard similarity of word shingles: SimHash finds candidates, exact sets decide.

The generalised pigeonhole of ``simhash`` on a wider fingerprint.  Sets of
shingles of similarity s differ in a bit with a chance of at most
acos(2 s / (1 + s)) / pi, 0.15 at 0.8, so partitions and their thresholds are
chosen by dynamic programming for the least estimated cost at which a pair just
at the bound agrees in none of them with a chance of at most MISS.  Candidates
only say which texts are compared; links are of exact similarity.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import as_bytes, join_hot, slices, table_written
from .components import components
from .simhash import PAIR_COST, ROW_COST, SEED, Part, bit_counts, bucket_links, chances, grouped_bits, majorities, part_cost, probes, shingle_hashes

#: The chance to miss a pair whose similarity is just at the bound; it falls fast above.
MISS = 1 / 500
#: Lanes whose bits go with every probe, and standard deviations by which a pair at the bound may differ more in them.
CHECK_LANES, CHECK_DEVIATIONS = 2, 4
#: Texts of a block; a group of candidates that is larger is cut in blocks.
BLOCK_TEXTS = 256
#: Steps of the dynamic programming for what the least useful part adds to the logarithm of MISS.
_PART_STEPS = 20


def shingle_set(text: bytes | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a UTF-8 text."""
    return np.unique(shingle_hashes(text, words))


def bit_chance(similarity: Fraction) -> float:
    """How likely sets of this similarity differ in a bit, at most: sets of one size do so most."""
    return math.acos(float(2 * similarity / (1 + similarity))) / math.pi


def _meeting(differ: float, bits: int, threshold: int) -> float:
    """The chance that a pair differs in at most ``threshold`` of the bits."""
    return sum(math.comb(bits, d) * differ**d * (1 - differ) ** (bits - d) for d in range(threshold + 1))


def part_bits(n: int, similarity: Fraction) -> int:
    """Bits of a part of the least cost for ``n`` random fingerprints."""
    differ = bit_chance(similarity)

    def cost(bits: int) -> float:
        return math.log(MISS) / math.log1p(-_meeting(differ, bits, 0)) * (n * ROW_COST + n * n / 2 ** (bits + 1) * PAIR_COST)

    return min(range(4, 49), key=cost)


def lanes_needed(n: int, similarity: Fraction) -> int:
    """64-bit lanes of a fingerprint that is wide enough for ``n`` sets, CHECK_LANES included; a tenth more than parts without threshold take."""
    bits = part_bits(n, similarity)
    parts = math.log(MISS) / math.log1p(-_meeting(bit_chance(similarity), bits, 0))
    return CHECK_LANES + math.ceil(1.1 * parts / (64 // bits))


def wide_plan(counts: list[np.ndarray], similarity: Fraction) -> list[Part]:
    """Parts of the probed lanes and their thresholds (0 or 1; others aren't probed) of the least estimated cost for MISS."""
    differ, goal = bit_chance(similarity), -math.log(MISS)
    n = max(counts[0][64, 64], 1)
    width = part_bits(int(n), similarity)
    sizes = [width] * (64 // width) + [64 % width] * bool(64 % width)
    unit = -math.log1p(-_meeting(differ, width, 0)) / _PART_STEPS
    steps = math.ceil(goal / unit)
    options: list[list[tuple[float, int, Part]]] = []
    for lane, own in enumerate(counts):
        for bits in grouped_bits(own, sizes):
            if len(bits) == width:
                chance = chances(own, bits, 1)
                options.append([(part_cost(n, width, t, chance[t]), int(-math.log1p(-_meeting(differ, width, t)) / unit + 1e-9), Part(bits, t, lane)) for t in (0, 1)])
    # cost[g]: the least cost of a gain of g steps or more
    cost, chosen = np.full(steps + 1, np.inf), []
    cost[0] = 0
    for choice in options:
        best, took = cost.copy(), np.full(steps + 1, -1)
        for k, (more, gain, _) in enumerate(choice):
            ahead = np.full(steps + 1, np.inf)
            ahead[gain:] = cost[: steps + 1 - gain] + more
            ahead[steps] = min(ahead[steps], cost[max(0, steps - gain) :].min() + more)
            took[ahead < best] = k
            best = np.minimum(best, ahead)
        chosen.append((took, cost))
        cost = best
    if np.isinf(cost[steps]):
        raise ValueError("the fingerprint is too narrow")
    out, at = [], steps
    for choice, (took, before) in zip(reversed(options), reversed(chosen)):
        if took[at] >= 0:
            more, gain, part = choice[took[at]]
            out.append(part)
            if at == steps:  # from where the goal was reached at the least cost
                start = max(0, steps - gain)
                at = start + int(np.argmin(before[start:]))
            else:
                at -= gain
    return out[::-1]


def signatures(docs: DataFrame, words: int, lanes: int) -> DataFrame:
    """``docs(doc_id, t, text)`` -> ``(doc_id, t, h1, h2, bits)``: a 128-bit hash of the shingle set, and its fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            sets = [shingle_set(t, words) for t in as_bytes(part.column(2))]
            whole = np.frombuffer(b"".join(xxhash.xxh128_digest(s.tobytes(), SEED) for s in sets), np.int64).reshape(-1, 2)
            bits = [majorities(s, lanes).tobytes() for s in sets]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(whole[:, 0]), pa.array(whole[:, 1]), pa.array(bits, pa.binary())], ["doc_id", "t", "h1", "h2", "bits"])

    return docs.mapInArrow(run, "doc_id long, t long, h1 long, h2 long, bits binary")


def _lanes(distinct: DataFrame, lanes: int) -> DataFrame:
    """``distinct(node, bits)`` -> ``(node, b0, b1, ..)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wide = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int64).reshape(-1, lanes)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.ascontiguousarray(wide[:, i])) for i in range(lanes))], ["node", *(f"b{i}" for i in range(lanes))])

    return distinct.select("node", "bits").mapInArrow(run, "node long, " + ", ".join(f"b{i} long" for i in range(lanes)))


def similar(sets: list[np.ndarray], similarity: Fraction, labels: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Places that link all sets of at least ``similarity`` to each other, directly or by others. Sets of one label count as linked."""
    sizes = np.array([len(s) for s in sets])
    label, out = np.arange(len(sets)) if labels is None else labels.copy(), []
    for i in np.flatnonzero(sizes == 0)[1:]:
        out.append((int(np.flatnonzero(sizes == 0)[0]), int(i)))
    if not sizes.sum():
        return out
    p, q = similarity.numerator, similarity.denominator
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    owner = np.repeat(np.arange(len(sets)), sizes)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    mark = np.zeros(ids.max() + 1, bool)
    for i in range(len(sets) - 1):
        apart = np.flatnonzero(label[i + 1 :] != label[i])
        if not len(apart) or not sizes[i]:
            continue
        mark[ids[starts[i] : starts[i + 1]]] = True
        both = np.bincount(owner[starts[i + 1] :][mark[ids[starts[i + 1] :]]], minlength=len(sets))
        mark[ids[starts[i] : starts[i + 1]]] = False
        for j in (apart + i + 1)[q * both[apart + i + 1] >= p * (sizes[i] + sizes[apart + i + 1] - both[apart + i + 1])]:
            if label[j] != label[i]:
                out.append((i, int(j)))
                label[label == label[j]] = label[i]
    return out


def verified(cells: DataFrame, words: int, similarity: Fraction) -> DataFrame:
    """``cells(root, cell, node, text)`` -> ``(u, v, apart)``: links of similar texts, a forest of each cell, and, with v null, nodes apart from their root.

    Cells are bounded; each is compared in one task.
    """

    def compared(nodes: list[int], texts: list[bytes | None], root: int) -> tuple[list[int], list[int | None]]:
        own = dict(zip(nodes, texts))
        nodes = sorted(own, key=lambda x: (x != root, x))
        pairs = similar([shingle_set(own[x], words) for x in nodes], similarity)
        near = {0} if nodes[0] == root else set()
        while more := {j if i in near else i for i, j in pairs if (i in near) != (j in near)}:
            near |= more
        lone = [x for i, x in enumerate(nodes) if i not in near] if near else []
        return [*(nodes[i] for i, _ in pairs), *lone], [*(nodes[j] for _, j in pairs), *[None] * len(lone)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, nodes, texts = None, [], []

        def out() -> pa.RecordBatch:
            u, v = compared(nodes, texts, key[0])
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array([key[0]] * len(u), pa.int64())], ["u", "v", "root"])

        for batch in slices(batches):
            for root, cell, node, text in zip(*(batch.column(i).to_pylist() for i in range(3)), as_bytes(batch.column(3))):
                if (root, cell) != key:
                    if nodes:
                        yield out()
                    key, nodes, texts = (root, cell), [], []
                nodes.append(node)
                texts.append(text)
        if nodes:
            yield out()

    rows = cells.select("root", "cell", "node", "text").repartition("root", "cell").sortWithinPartitions("root", "cell")
    return rows.mapInArrow(run, "u long, v long, root long")


def _exact_links(texts: DataFrame, words: int, similarity: Fraction) -> DataFrame:
    """``texts(root, node, text)``, groups of candidates -> links (u, v) that connect all similar texts of a group.

    A large group is cut in blocks that each meet the group's first text; only
    texts that stay apart from it meet the other blocks.
    """
    groups = table_written(texts.groupBy("root").agg(F.count("*").alias("n")), "groups").withColumn("b", F.ceil(F.col("n") / BLOCK_TEXTS).cast("int"))
    total = groups.agg(F.sum("n")).first()[0] or 0
    placed = join_hot(texts, groups, ["root"], total).withColumn("y", F.pmod(F.xxhash64("node"), F.col("b")).cast("int"))
    first = placed.filter("b > 1 and node = root").withColumn("cell", F.explode(F.expr("sequence(0, b - 1)"))).filter("cell != y")
    found = table_written(verified(placed.withColumn("cell", F.col("y")).unionByName(first, allowMissingColumns=True), words, similarity), "verified")
    linked = found.filter("v is not null").select("u", "v")
    apart = found.filter("v is null").select(F.col("u").alias("node"), "root").distinct().join(groups.filter("b > 1").select("root", "b"), "root")
    apart = table_written(apart, "apart")
    blocks = apart.groupBy("root").agg(F.ceil(F.count("*") / BLOCK_TEXTS).cast("int").alias("a"), F.first("b").alias("b"))
    if apart.isEmpty():
        return linked
    own = texts.join(apart.select("node"), "node", "left_semi").join(blocks, "root")
    own = own.withColumn("x", F.pmod(F.xxhash64("node"), F.col("a"))).withColumn("y", F.explode(F.expr("sequence(0, b - 1)")))
    others = texts.join(blocks, "root").withColumn("y", F.pmod(F.xxhash64("node"), F.col("b")).cast("int")).withColumn("x", F.explode(F.expr("sequence(0, a - 1)")))
    cells = own.unionByName(others).withColumn("cell", F.col("x").cast("long") * F.col("b") + F.col("y"))
    return linked.unionByName(verified(cells, words, similarity).filter("v is not null").select("u", "v"))


def near_copies(docs: DataFrame, words: int = 5, similarity: Fraction = Fraction(4, 5)) -> DataFrame:
    """Groups of ``docs(doc_id, text)`` by links of shingle sets of a Jaccard similarity of at least ``similarity``.

    Returns ``doc_id long, t long, copies long, first boolean``, a row for each
    different doc_id and text: ``t`` is the text's XXH64 (seed 42; 42 for
    null), ``copies`` the rows that have both, and ``first`` is true for one
    row of each group, that of the smallest doc_id (nulls last) and hash.

    Null, empty and blank texts are alike.  Rows count each as a document,
    whether they have an id or share one.  Other columns are ignored.
    """
    texts = docs.select(F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string")).alias("t"), F.col("text").cast("string"))
    rows = docs.count()
    lanes = lanes_needed(max(rows, 1), similarity)
    signed = table_written(signatures(texts, words, lanes), "signatures")
    order = F.struct(F.isnull("doc_id").alias("none"), "doc_id", "t")
    distinct = signed.groupBy("h1", "h2").agg(F.min(order).alias("lead"), F.count("*").alias("n"), F.first("bits").alias("bits"))
    distinct = table_written(distinct.withColumn("node", F.monotonically_increasing_id()), "distinct")
    names = [f"b{i}" for i in range(lanes)]
    wide = table_written(_lanes(distinct, lanes), "lanes")
    check, probed = names[:CHECK_LANES], names[CHECK_LANES:]
    parts = wide_plan(bit_counts(wide, probed), similarity)
    differ, m = bit_chance(similarity), 64 * CHECK_LANES
    most = math.ceil(m * differ + CHECK_DEVIATIONS * math.sqrt(m * differ * (1 - differ)))
    roots = components(bucket_links(probes(wide, parts, probed, check), check, most))
    members = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct()).join(distinct.select("node", "lead"), "node")
    members = members.select("root", "node", "lead.none", F.coalesce("lead.doc_id", F.lit(0)).alias("i"), "lead.t")
    keyed = texts.select(F.isnull("doc_id").alias("none"), F.coalesce("doc_id", F.lit(0)).alias("i"), "t", "text")
    keyed = keyed.join(members, ["none", "i", "t"]).dropDuplicates(["none", "i", "t"])
    roots = components(_exact_links(table_written(keyed.select("root", "node", "text"), "candidates"), words, similarity))
    named = distinct.join(roots, "node", "left").withColumn("c", F.coalesce("root", "node"))
    leads = named.groupBy("c").agg(F.min("lead").alias("lead")).select("lead.none", F.coalesce("lead.doc_id", F.lit(0)).alias("i"), "lead.t", F.lit(True).alias("first"))
    each = signed.groupBy("doc_id", "t").agg(F.count("*").alias("copies")).withColumns({"none": F.isnull("doc_id"), "i": F.coalesce("doc_id", F.lit(0))})
    return each.join(leads, ["none", "i", "t"], "left").select("doc_id", "t", "copies", F.coalesce("first", F.lit(False)).alias("first"))


def one_of_each(docs: DataFrame, words: int = 5, similarity: Fraction = Fraction(4, 5)) -> DataFrame:
    """The rows and columns of ``docs(doc_id, text, ..)``, one row of each group of ``near_copies``.

    Of rows with equal doc_id and text the one of the least hash of all columns
    stays, so reruns agree.  Rows without doc_id take part like any other.
    """
    kept = near_copies(docs, words, similarity).filter("first")
    kept = kept.select(F.isnull("doc_id").alias("__none"), F.coalesce("doc_id", F.lit(0)).alias("__i"), F.col("t").alias("__t"), F.col("copies").alias("__copies"))
    number = F.col("doc_id").cast("long")
    keyed = docs.withColumns({"__none": F.isnull(number), "__i": F.coalesce(number, F.lit(0)), "__t": F.xxhash64(F.col("text").cast("string"))})
    found = keyed.join(kept, ["__none", "__i", "__t"])
    several = found.filter("__copies > 1").withColumn("__hash", F.xxhash64(F.to_json(F.struct(*docs.columns))))
    turn = F.row_number().over(Window.partitionBy("__none", "__i", "__t").orderBy("__hash"))
    return found.filter("__copies = 1").select(*docs.columns).unionByName(several.withColumn("__turn", turn).filter("__turn = 1").select(*docs.columns))
