"""SimHash near-duplicates by a generalised pigeonhole.

Fingerprints are 64 bits.  Bits that go together are grouped into partitions,
and each partition gets its own threshold: with thresholds t_i that satisfy
``sum(t_i + 1) = max_bits + 1`` two fingerprints within ``max_bits`` agree to
t_i bits in at least one partition (-1: the partition isn't probed).  The
thresholds minimise the estimated work: rows to shuffle plus candidates to
verify, by dynamic programming.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import as_bytes, join_hot, mix64, slices, space_words, table_written
from .components import components

SEED = 42
#: Rows of a bucket that one task compares; larger buckets are split.
BUCKET_ROWS = 4096
#: Seconds that a shuffled row and a compared pair are taken to cost.
ROW_COST, PAIR_COST = 2e-6, 2e-8


# --- fingerprints ---------------------------------------------------------------------------------------------------


def shingle_hashes(text: bytes | None, shingle_words: int) -> np.ndarray:
    """XXH64 of each shingle of a UTF-8 text, repeats included.

    A-Z are lower-cased; shingles are space-joined runs of words.  Fewer words
    make one shingle, no words none.
    """
    words = space_words(text and text.lower())
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    k = min(shingle_words, n)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    return np.fromiter([digest(joined[a:b], SEED) for a, b in zip(starts, ends[k - 1 :].tolist())], np.uint64, n - k + 1)


def majorities(hashes: np.ndarray, lanes: int = 1) -> np.ndarray:
    """A 64-bit fingerprint for each lane: a bit is 1 if set in over half the lane's hashes; zero without hashes.

    The first lane takes the hashes as they are, further ones scramble them each in its own way.
    """
    n, counts = len(hashes), np.zeros(64 * lanes, np.int64)
    own = np.array([0x9E3779B97F4A7C15 * i % (1 << 64) for i in range(1, lanes)], np.uint64)
    for at in range(0, n, 255):
        h = hashes[at : at + 255, None]
        wide = np.concatenate([h, mix64(h + own)], axis=1) if lanes > 1 else h
        bits = np.unpackbits(np.ascontiguousarray(wide.astype(">u8")).view(np.uint8), axis=1)
        counts += np.add.reduce(bits, axis=0, dtype=np.uint8)
    return np.packbits(2 * counts > n).view(">u8").astype(np.uint64)


def fingerprints(docs: DataFrame, shingle_words: int = 3) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, fp long)``, a row for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = [majorities(shingle_hashes(t, shingle_words)) for t in as_bytes(part.column(1))]
            fps = np.concatenate(found).view(np.int64) if found else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


# --- the plan -------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Part:
    """Bits of a lane that are probed together, and how many of them may differ."""

    bits: tuple[int, ...]
    threshold: int
    lane: int = 0

    @property
    def mask(self) -> np.uint64:
        return np.uint64(sum(1 << b for b in self.bits))

    def flips(self) -> np.ndarray:
        """What to xor to reach every value within the threshold, itself first."""
        return np.array([sum(1 << b for b in c) for n in range(self.threshold + 1) for c in combinations(self.bits, n)], np.uint64)


def bit_counts(distinct: DataFrame, names: list[str] = ["fp"]) -> list[np.ndarray]:
    """For each column of fingerprints, how often bits i and j are both set, (65, 65); row 64 counts all. Over every row."""
    i, j = np.triu_indices(65)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(names), 65, 65))
        for batch in batches:
            for lane in range(len(names)):
                fp = batch.column(lane).to_numpy(zero_copy_only=False).view(np.uint64)
                for at in range(0, len(fp), 65536):
                    bits = np.ones((len(fp[at : at + 65536]), 65), np.float32)
                    bits[:, :64] = (fp[at : at + 65536, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)
                    total[lane] += bits.T @ bits
        for lane in range(len(names)):
            n = total[lane][i, j].astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), lane, np.int32)), pa.array(np.arange(len(i)), pa.int32()), pa.array(n)], ["lane", "place", "n"])

    out = np.zeros((len(names), 65, 65))
    for lane, place, n in distinct.select(*names).mapInArrow(run, "lane int, place int, n long").groupBy("lane", "place").agg(F.sum("n")).collect():
        out[lane, i[place], j[place]] = out[lane, j[place], i[place]] = n
    return list(out)


def _correlation(counts: np.ndarray) -> np.ndarray:
    n = max(counts[64, 64], 1)
    mean = counts[64, :64] / n
    spread = np.sqrt(np.maximum(mean * (1 - mean), 1e-12))
    corr = np.abs((counts[:64, :64] / n - np.outer(mean, mean)) / np.outer(spread, spread))
    np.fill_diagonal(corr, 0)
    return corr


def grouped_bits(counts: np.ndarray, sizes: list[int]) -> list[tuple[int, ...]]:
    """Parts of the given sizes, each grown from its most correlated free bits, a bit next to the one it goes with most."""
    corr = _correlation(counts)
    free, groups = list(range(64)), []
    for size in sizes:
        best = max(free, key=lambda b: (corr[b, free].max() if len(free) > 1 else 0, -b))
        group = [best]
        free.remove(best)
        while len(group) < size:
            best = max(free, key=lambda b: (corr[b, group[-1]] + corr[b, group].mean(), -b))
            group.append(best)
            free.remove(best)
        groups.append(tuple(group))
    return groups


def chances(counts: np.ndarray, bits: tuple[int, ...], most: int) -> np.ndarray:
    """The chance that two fingerprints differ in at most 0 .. ``most`` of the bits.

    Bits are taken as a chain: each depends on the one before it, by how often
    the two are set together, so that bits that go together count for less.
    """
    n = max(counts[64, 64], 1)

    def joint(i: int, j: int) -> np.ndarray:
        """Chances that two fingerprints agree or differ in i (row) and in j (column)."""
        both, a, b = counts[i, j] / n, counts[i, i] / n, counts[j, j] / n
        p = np.maximum(np.array([[1 - a - b + both, b - both], [a - both, both]]), 0)
        differ_j, differ_i, differ = 2 * (p[0, 0] * p[0, 1] + p[1, 0] * p[1, 1]), 2 * (p[0, 0] * p[1, 0] + p[0, 1] * p[1, 1]), 2 * (p[0, 0] * p[1, 1] + p[0, 1] * p[1, 0])
        return np.maximum(np.array([[(p**2).sum(), differ_j], [differ_i, differ]]), 1e-12)

    first = joint(bits[0], bits[0])
    state = np.zeros((2, most + 2))  # last bit agrees or not; bits that differ so far, more than most together
    state[0, 0], state[1, 1] = first[0, 0], first[1, 1]
    for i, j in zip(bits, bits[1:]):
        both = joint(i, j)
        step = both / both.sum(1, keepdims=True)
        after = np.zeros_like(state)
        for was in (0, 1):
            after[0] += state[was] * step[was, 0]
            after[1, 1:] += state[was, :-1] * step[was, 1]
            after[1, -1] += state[was, -1] * step[was, 1]
        state = after
    return np.minimum(np.cumsum(state.sum(0)[: most + 1]), 1)


def part_cost(n: float, bits: int, threshold: int, chance: float) -> float:
    """Seconds for the rows to shuffle and the candidates to verify of one part."""
    rows = sum(math.comb(bits, d) for d in range(threshold + 1))
    return n * rows * ROW_COST + n * n / 2 * chance * PAIR_COST


def plan(counts: np.ndarray, max_bits: int) -> list[Part]:
    """Partitions and thresholds of the least estimated cost for the fingerprints whose ``bit_counts`` are given."""
    n = max(counts[64, 64], 1)
    best: tuple[float, list[Part]] = (math.inf, [])
    for m in range(1, max_bits + 2):
        groups = grouped_bits(counts, [64 // m + (i < 64 % m) for i in range(m)])
        # state: probed so far (sum of t + 1) -> (cost, thresholds)
        states: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}
        for bits in groups:
            chance = chances(counts, bits, 2)
            after: dict[int, tuple[float, tuple[int, ...]]] = {}
            for used, (cost, ts) in states.items():
                for t in (-1, 0, 1, 2):
                    if used + t + 1 > max_bits + 1:
                        break
                    more = 0 if t < 0 else part_cost(n, len(bits), t, chance[t])
                    if cost + more < after.get(used + t + 1, (math.inf,))[0]:
                        after[used + t + 1] = (cost + more, (*ts, t))
            states = after
        if max_bits + 1 in states and states[max_bits + 1][0] < best[0]:
            best = (states[max_bits + 1][0], [Part(b, t) for b, t in zip(groups, states[max_bits + 1][1]) if t >= 0])
    return best[1]


# --- probing and verifying ------------------------------------------------------------------------------------------


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning star of each component of the given links."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        label = label[label]
        if (label[a] == label[b]).all():
            while (label[label] != label).any():
                label = label[label]
            break
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _links(keys: np.ndarray, center: np.ndarray, node: np.ndarray, fps: list[np.ndarray], most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among rows sorted by bucket (keys: bucket numbers) that differ in at most ``most`` bits, as a forest of the rows given."""
    n, ua, ub = len(node), [], []
    i, d = np.arange(n), 0
    while len(i):
        d += 1
        i = i[i < n - d]
        i = i[keys[i] == keys[i + d]]
        j = i + d
        far = sum(np.bitwise_count(f[i] ^ f[j]).astype(np.int16) for f in fps)
        ok = (far <= most) & (center[i] | center[j])
        ua.append(node[i[ok]])
        ub.append(node[j[ok]])
    a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (ua, ub))
    keep = a != b
    return _forest(a[keep], b[keep]) if keep.any() else (a[:0], b[:0])


def _bucket_links(rows: DataFrame, names: list[str], most: int) -> DataFrame:
    """rows(key, cell, center, node, *names) -> links(u, v), a forest of each Arrow batch; buckets (key, cell) are bounded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(table: pa.Table, number: np.ndarray) -> pa.RecordBatch:
            a, b = _links(number, table["center"].to_numpy(), table["node"].to_numpy(), [table[x].to_numpy().view(np.uint64) for x in names], most)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["u", "v"])

        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table]).combine_chunks()
            if not table.num_rows:
                continue
            columns = [table[x].to_numpy() for x in ("key", "cell")]
            new = np.concatenate([[True], np.logical_or.reduce([c[1:] != c[:-1] for c in columns])])
            cut = int(np.flatnonzero(new)[-1])
            number = np.cumsum(new)
            rest = table.slice(cut)
            if cut:
                yield out(table.slice(0, cut), number[:cut])
        if rest is not None:
            yield out(rest, np.zeros(rest.num_rows, np.int64))

    rows = rows.select("key", "cell", "center", "node", *names)
    return rows.repartition("key", "cell").sortWithinPartitions("key", "cell").mapInArrow(run, "u long, v long")


def probes(distinct: DataFrame, parts: list[Part], lanes: list[str], names: list[str]) -> DataFrame:
    """A row for each part and value within its threshold: (key, center, node, *names); ``lanes`` names the columns of fingerprints.

    ``key`` scrambles the part's number and value; two that meet by chance are verified like any others.
    """
    tables = [(_key(k), p.lane, p.mask, p.flips()) for k, p in enumerate(parts)]
    columns = list(dict.fromkeys([*lanes, *names]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4096):
            node = batch.column(0).to_numpy(zero_copy_only=False)
            own = {x: batch.column(i + 1).to_numpy(zero_copy_only=False) for i, x in enumerate(columns)}
            for salt, lane, mask, flips in tables:
                keys = mix64(((own[lanes[lane]].view(np.uint64) & mask)[:, None] ^ flips) + salt).view(np.int64).ravel()
                center = np.tile(np.arange(len(flips)) == 0, len(node))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys), pa.array(center), pa.array(np.repeat(node, len(flips))), *(pa.array(np.repeat(own[x], len(flips))) for x in names)],
                    ["key", "center", "node", *names],
                )

    return distinct.select("node", *columns).mapInArrow(run, "key long, center boolean, node long, " + ", ".join(f"{n} long" for n in names))


def _key(part: int) -> np.uint64:
    return mix64(np.array([0xD1B54A32D192ED03 * (part + 1) % (1 << 64)], np.uint64))[0]


def _ball_links(members: DataFrame) -> DataFrame:
    """Links (u, v) of fingerprints within 2 bits: two of them are so near exactly if some value is within 1 bit of both.

    At most 65 fingerprints share such a value, however large their bucket was.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flips = np.concatenate([[0], np.uint64(1) << np.arange(64, dtype=np.uint64)]).astype(np.uint64)
        for batch in slices(batches, 4096):
            node, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            keys = (fp.view(np.uint64)[:, None] ^ flips).view(np.int64).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.repeat(node, 65))], ["key", "node"])

    near = members.select("node", "fp").mapInArrow(run, "key long, node long")
    return near.withColumn("v", F.min("node").over(Window.partitionBy("key"))).filter("node != v").select(F.col("node").alias("u"), "v")


def bucket_links(rows: DataFrame, names: list[str], most: int) -> DataFrame:
    """Links of ``probes`` that connect whatever differs in at most ``most`` bits of ``names`` in one bucket.

    Large buckets are split.  Their members are compared with one of them, the
    center; only those that stay apart from it meet the others, block by block,
    so the work grows with the bucket times what stays apart.
    """
    whole = rows.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct("node", *names)).alias("__mid")).filter(F.col("n") > BUCKET_ROWS)
    whole = table_written(whole, "buckets")
    total = whole.agg(F.sum("n")).first()[0]
    if not total:
        return _bucket_links(rows.withColumn("cell", F.lit(0).cast("long")), names, most)
    small = rows.join(whole.select("key"), "key", "left_anti").withColumn("cell", F.lit(0).cast("long"))
    far = sum((F.bit_count(F.col(x).bitwiseXOR(F.col(f"__mid.{x}"))) for x in names), F.lit(0))
    large = join_hot(rows, whole.withColumn("rows", F.col("n")), ["key"], total).withColumn("near", F.col("center") & (far <= most))
    large = table_written(large, "large-buckets")
    half = BUCKET_ROWS // 2
    # a center that is a flipped row itself says nothing of flipped rows, so those stay apart
    blocks = large.groupBy("key", F.col("rows").alias("n")).agg(F.ceil(F.count_if(~F.col("near")) / half).cast("int").alias("a"), F.ceil(F.count("*") / half).cast("int").alias("b")).filter("a > 0")
    near = large.filter("near and node != __mid.node").select(F.col("node").alias("u"), F.col("__mid.node").alias("v"))
    cells = join_hot(large, blocks, ["key"], total)
    own = F.pmod(F.xxhash64("node", "center"), F.col("b")).cast("int")
    apart = cells.filter("not near").withColumn("x", F.pmod(F.xxhash64("node", "center"), F.col("a")).cast("int")).withColumn("y", F.explode(F.expr("sequence(0, b - 1)")))
    others = cells.withColumn("y", own).withColumn("x", F.explode(F.expr("sequence(0, a - 1)")))
    both = apart.unionByName(others).withColumn("cell", F.col("x").cast("long") * F.col("b") + F.col("y") + 1)
    columns = ["key", "cell", "center", "node", *names]
    return _bucket_links(small.select(*columns).unionByName(both.select(*columns)), names, most).unionByName(near)


def links(distinct: DataFrame, max_bits: int) -> DataFrame:
    """``distinct(node, fp)`` -> links ``(u, v)`` that connect whatever differs in at most ``max_bits`` bits."""
    rows = probes(distinct, plan(bit_counts(distinct)[0], max_bits), ["fp"], ["fp"])
    if max_bits != 2:
        return bucket_links(rows, ["fp"], max_bits)
    # within 2 bits, large buckets have a way of their own
    whole = table_written(rows.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > BUCKET_ROWS), "buckets")
    total = whole.agg(F.sum("n")).first()[0]
    if not total:
        return _bucket_links(rows.withColumn("cell", F.lit(0).cast("long")), ["fp"], max_bits)
    large = join_hot(rows, whole, ["key"], total).select("node", "fp").distinct()
    small = rows.join(whole.select("key"), "key", "left_anti").withColumn("cell", F.lit(0).cast("long"))
    return _bucket_links(small, ["fp"], max_bits).unionByName(_ball_links(large))


def simhash_groups(docs: DataFrame, shingle_words: int = 3, max_bits: int = 2) -> DataFrame:
    """Near-duplicate groups of ``docs(doc_id, text)``.

    Returns ``doc_id long, fingerprint string, component_id long``, a row for
    each row of ``docs``.  Fingerprints that differ in at most ``max_bits``
    bits are linked; ``component_id`` is the smallest doc_id that links reach.

    Null, empty and blank texts have fingerprint zero and are linked like any
    other.  Repeated rows give repeated rows; rows that share a doc_id are one
    document, so their fingerprints are linked.  Ids may be any 64-bit integers.
    A row whose doc_id is null takes its group's smallest id; a group without
    ids has a null component_id.  Other columns are ignored; an empty table
    gives an empty one.
    """
    rows = table_written(fingerprints(docs, shingle_words), "fingerprints")
    # a fingerprint is its own node, whatever the ids are
    distinct = rows.groupBy("fp").agg(F.min("doc_id").alias("id"), F.count("*").alias("n"))
    distinct = table_written(distinct.select("fp", F.col("fp").alias("node"), "id", "n"), "distinct")
    total = distinct.agg(F.sum("n")).first()[0] or 0
    several = rows.filter("doc_id is not null").groupBy("doc_id").agg(F.min("fp").alias("v"), F.max("fp").alias("__last"), F.count("*").alias("n")).filter("v != __last")
    one_id = join_hot(rows, several, ["doc_id"], total).select(F.col("fp").alias("u"), "v")
    roots = components(links(distinct, max_bits).unionByName(one_id))
    named = distinct.join(roots, "node", "left").select("fp", "id", "n", F.coalesce("root", "node").alias("c"))
    groups = named.groupBy("c").agg(F.min("id").alias("component_id"), F.count("*").alias("k"))
    # most fingerprints are alone and have their group's id already
    alone = groups.filter("k = 1").select(F.col("c").alias("fp"), "component_id")
    linked = join_hot(named.select("fp", "c"), groups.filter("k > 1").select("c", "component_id", F.col("k").alias("n")), ["c"], total).select("fp", "component_id")
    named = alone.unionByName(linked).join(distinct.select("fp", "n"), "fp")
    return join_hot(rows, named, ["fp"], total).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
