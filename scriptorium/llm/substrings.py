"""Removal of repeated passages, with a count-min prefilter.

Texts are packed in chunks.  A window is represented by its anchor, the run of
words in it with the least hash: equal windows have equal anchors at different
places, so an anchor's count is never below its windows' count.  The first pass
counts the anchors of each chunk in a count-min sketch, cut in shards by hash,
as many as the input needs; the shards of all chunks are merged, and each chunk
gets back a bit for each of its anchors: estimated twice or more.  The second
pass groups exactly, by 96 bits of hash, the windows of such anchors.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, mix64, slices, space_words, table_bucketed

WINDOW_WORDS = 35
#: Words of an anchor.
ANCHOR_WORDS = 16
#: Count-min rows, and cells of a row for each anchor that the input is expected to have (at most).
SKETCH_ROWS, CELLS_PER_ANCHOR = 2, 16
#: Anchors of a shard of the sketch, about; the number of shards grows with the input.
SHARD_ANCHORS = 1 << 18
#: Words of a chunk: what a task holds as hashes at once.
CHUNK_WORDS = 2_000_000
#: Windows that one task groups, about.
GROUP_WINDOWS = 2_000_000

_U = np.uint64
_BASES = (_U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F))


class _Powers:
    """Powers of an odd base modulo 2**64 and of its inverse, as far as needed."""

    def __init__(self, base: np.uint64) -> None:
        self.base, self.inverse = int(base), pow(int(base), -1, 1 << 64)
        self.up = self.down = np.ones(1, _U)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = 1 << (n - 1).bit_length()
            self.up, self.down = (np.concatenate([[_U(1)], np.cumprod(np.full(size - 1, b, _U))]).astype(_U) for b in (self.base, self.inverse))
        return self.up[:n], self.down[:n]


_POWERS = [_Powers(b) for b in _BASES]


def word_hashes(words: list[bytes]) -> np.ndarray:
    """XXH64 of each word."""
    return np.fromiter(map(xxhash.xxh64_intdigest, words), _U, len(words))


def run_hashes(words: np.ndarray, length: int, lane: int = 0) -> np.ndarray:
    """A hash of each run of ``length`` word hashes, by prefix sums of a polynomial."""
    n = len(words)
    up, down = _POWERS[lane].to(n)
    total = np.concatenate([np.zeros(1, _U), np.cumsum(words * up, dtype=_U)])
    return mix64((total[length:] - total[: n - length + 1]) * down[: n - length + 1])


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values."""
    have = 1
    n = len(x) - width + 1
    while 2 * have <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[:n], x[width - have : width - have + n])


def anchors(words: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """The anchor's hash of each window, and the hashes of all places that are an anchor of some window."""
    grams = run_hashes(words, anchor)
    width = window - anchor + 1
    least = _sliding_min(grams, width)
    # a place is one if the largest minimum of the windows around it is its own hash
    edge = np.zeros(width - 1, _U)
    most = ~_sliding_min(~np.concatenate([edge, least, edge]), width)
    return least, grams[most == grams]


_PAIR = np.dtype([("a", "<u8"), ("b", "<u4")])


def _packed(values: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The order by group, the groups, and each group's values as bytes."""
    order = np.argsort(groups, kind="stable")
    own, cuts = np.unique(groups[order], return_index=True)
    offsets = np.append(cuts, len(values)) * values.dtype.itemsize
    return order, own, pa.BinaryArray.from_buffers(pa.binary(), len(own), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values[order]))])


def _bits(flags: np.ndarray, groups: np.ndarray) -> list[bytes]:
    """Flags, ordered by group, as bits of each group."""
    cuts = np.unique(groups, return_index=True)[1][1:]
    return [np.packbits(x).tobytes() for x in np.split(flags, cuts)]


def _marked(marks: list[dict], groups: np.ndarray) -> np.ndarray:
    """The flags of values whose groups are given, from the bits that each group sent back."""
    order = np.argsort(groups, kind="stable")
    sizes = np.unique(groups, return_counts=True)[1].tolist()
    flags = np.zeros(len(groups), bool)
    answers = sorted((m["at"], m["bits"]) for m in marks)
    flags[order] = np.concatenate([np.unpackbits(np.frombuffer(bits, np.uint8), count=n) for (_, bits), n in zip(answers, sizes)] or [np.zeros(0, np.uint8)]).astype(bool)
    return flags


def estimated_twice(values: np.ndarray, more: np.ndarray, rows: int, cells: int) -> np.ndarray:
    """Whether a count-min sketch of ``rows`` by ``cells`` counts each value at least twice; ``more``: counted twice by itself already."""
    ok = np.ones(len(values), bool)
    for r in range(rows):
        at = (mix64(values.astype(_U) + _U((r + 1) * int(_BASES[1]) % (1 << 64))) % _U(cells)).astype(np.int64)
        total = np.bincount(at, 1 + more, minlength=cells)
        ok &= total[at] >= 2
    return ok


def _kept(words: list[bytes], starts: np.ndarray, window: int) -> tuple[list[bytes], int]:
    """The words that no window beginning at ``starts`` covers, and how many it covers."""
    if not len(starts):
        return words, 0
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + window, -1)
    gone = np.cumsum(edges[:-1]) > 0
    return [w for w, g in zip(words, gone.tolist()) if not g], int(gone.sum())


def remove_repeats(docs: DataFrame, window: int = WINDOW_WORDS, anchor: int = ANCHOR_WORDS, chunk_words: int = CHUNK_WORDS, shard_anchors: int = SHARD_ANCHORS,
                   cells_per_anchor: int = CELLS_PER_ANCHOR, texts: bool = True) -> DataFrame:
    """Texts of ``docs(doc_id, text)`` without repeated passages.

    Returns ``doc_id, n_words, n_removed, kept_sha256`` and, with ``texts``,
    ``text``: the kept words joined by one space; a row for each row of
    ``docs``.  Each word goes that a window of ``window`` words covers whose
    word sequence also starts anywhere else, in the same document or another;
    all copies go, and windows are judged on the input.

    Null, empty and blank texts have no words and an empty kept text; texts
    shorter than a window stay whole; a repeated row repeats all its windows.
    Other columns are ignored; an empty table gives an empty one.

    Nothing that grows with the input is broadcast or sent to the driver: a
    chunk sends 4 bytes for each of its distinct anchors and 12 for each
    distinct window of an anchor that is estimated repeated, and gets bits back.
    """
    anchor = min(anchor, window)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    final = ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seq, n = TaskContext.get().partitionId(), 0, 0
        held: list[tuple[int | None, bytes]] = []

        def chunk() -> pa.RecordBatch:
            sizes = np.array([len(t) for _, t in held], "<u4").tobytes()
            blob = zstandard.compress(sizes + b"".join([t for _, t in held]), 3)
            return pa.RecordBatch.from_arrays([pa.array([(task << 24) + seq]), pa.array([[i for i, _ in held]], pa.list_(pa.int64())), pa.array([blob], pa.binary()), pa.array([n])], ["chunk", "ids", "blob", "words"])

        for part in slices(batches):
            for i, t in zip(part.column(0).to_pylist(), as_bytes(part.column(1))):
                held.append((i, t or b""))
                n += len(space_words(t))
                if n >= chunk_words:
                    yield chunk()
                    held, n, seq = [], 0, seq + 1
        if held:
            yield chunk()

    chunks = table_bucketed(rows.mapInArrow(pack, "chunk long, ids array<long>, blob binary, words long"), "chunks", "chunk", rows.rdd.getNumPartitions())
    words = chunks.agg(F.sum("words")).first()[0] or 0
    # two of window - anchor + 2 places are anchors, on average
    shards = max(1, math.ceil(2 * words / (window - anchor + 2) / shard_anchors))
    cells = shard_anchors * cells_per_anchor
    buckets = max(1, math.ceil(words / GROUP_WINDOWS))

    def unpacked(ids: list, blob: bytes) -> list[list[bytes]]:
        data = zstandard.decompress(blob)
        cuts = np.cumsum(np.concatenate([[4 * len(ids)], np.frombuffer(data, "<u4", len(ids))])).tolist()
        return [space_words(data[a:b]) for a, b in zip(cuts, cuts[1:])]

    def hashed(whole: list[list[bytes]]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray] | None]:
        """Of each text: its words' hashes, each window's anchor, and the places' anchors; none for short texts."""
        found = []
        for own in whole:
            hashes = word_hashes(own) if len(own) >= window else None
            found.append(None if hashes is None else (hashes, *anchors(hashes, window, anchor)))
        return found

    def distinct_anchors(each: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted anchors of a chunk, whether it has them more than once, and their shards."""
        values, times = np.unique(np.concatenate([np.zeros(0, _U), *(x[2] for x in each if x)]), return_counts=True)
        return values, times > 1, ((values >> _U(32)) % _U(shards)).astype(np.int32)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A chunk's sparse sketch: 32 bits of each anchor, which say its cells, by shard."""
        for batch in batches:
            for chunk, ids, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                values, more, shard = distinct_anchors(hashed(unpacked(ids, blob.as_py())))
                order, own, packed = _packed(values.astype(np.uint32), shard)
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(np.full(len(own), chunk)), packed, pa.array(_bits(more[order], shard[order]) if len(own) else [], pa.binary())], ["at", "chunk", "cells", "more"])

    def merge(table: pa.Table) -> pa.Table:
        """The sketch of a shard, and what it says of each chunk's anchors."""
        parts = [np.frombuffer(x, np.uint32) for x in table["cells"].to_pylist()]
        more = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=len(p)) for x, p in zip(table["more"].to_pylist(), parts)])
        flags = np.split(estimated_twice(np.concatenate(parts), more, SKETCH_ROWS, cells), np.cumsum([len(p) for p in parts])[:-1])
        return pa.table([table["at"], table["chunk"], pa.array([np.packbits(x).tobytes() for x in flags], pa.binary())], names=["at", "chunk", "bits"])

    def candidates(each: list, marks: list[dict]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each text, first words and hashes (two lanes as one structured value) of the windows whose anchor is estimated repeated."""
        values, _, shard = distinct_anchors(each)
        flags, found = _marked(marks, shard), []
        for x in each:
            starts = np.flatnonzero(flags[np.searchsorted(values, x[1])]) if x else np.zeros(0, np.int64)
            out = np.empty(len(starts), _PAIR)
            if len(starts):
                out["a"] = run_hashes(x[0], window, 0)[starts]
                out["b"] = run_hashes(x[0], window, 1)[starts] >> _U(32)
            found.append((starts, out))
        return found

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A chunk's distinct candidates, dealt by hash, and which of them it has more than once."""
        for batch in batches:
            for chunk, ids, blob, marks in zip(*(batch.column(i).to_pylist() for i in (0, 1)), batch.column(2), batch.column(3)):
                found = candidates(hashed(unpacked(ids, blob.as_py())), marks.as_py() or [])
                values, times = np.unique(np.concatenate([h for _, h in found]), return_counts=True)
                if not len(values):
                    continue
                at = values["b"].astype(np.int64) % buckets
                order, own, a = _packed(values["a"], at)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own, pa.int32()), pa.array(np.full(len(own), chunk)), a, _packed(values["b"], at)[2], pa.array(_bits(times[order] > 1, at[order]), pa.binary())], ["at", "chunk", "a", "b", "more"]
                )

    def grouped(table: pa.Table) -> pa.Table:
        """Of each chunk's candidates of a bucket, whether they start at two places or more: a bit each."""
        a, b = (np.concatenate([np.frombuffer(x, t) for x in table[n].to_pylist()]) for n, t in (("a", "<u8"), ("b", "<u4")))
        sizes = [len(x) // 8 for x in table["a"].to_pylist()]
        # a hash that one chunk has more than once is single there, but counts as repeated
        twice = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=n) for x, n in zip(table["more"].to_pylist(), sizes)]).astype(bool)
        order = np.lexsort((b, a))
        same = (a[order][1:] == a[order][:-1]) & (b[order][1:] == b[order][:-1])
        twice[order[1:]] |= same
        twice[order[:-1]] |= same
        cuts = np.cumsum([0, *sizes])
        return pa.table([table["at"], table["chunk"], pa.array([np.packbits(twice[cuts[i] : cuts[i + 1]]).tobytes() for i in range(len(sizes))], pa.binary())], names=["at", "chunk", "bits"])

    def closed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The texts of each chunk without what is repeated."""
        for batch in batches:
            for ids, blob, marks, repeats in zip(batch.column(0).to_pylist(), *(batch.column(i) for i in (1, 2, 3))):
                whole = unpacked(ids, blob.as_py())
                found = candidates(hashed(whole), marks.as_py() or [])
                values = np.unique(np.concatenate([h for _, h in found]))
                repeated = _marked(repeats.as_py() or [], values["b"].astype(np.int64) % buckets)
                kept = [_kept(w, starts[repeated[np.searchsorted(values, h)]] if len(starts) else starts, window) for w, (starts, h) in zip(whole, found)]
                joined = [b" ".join(k) for k, _ in kept]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids, pa.int64()), pa.array([len(w) for w in whole], pa.int64()), pa.array([g for _, g in kept], pa.int64()),
                        pa.array([hashlib.sha256(j).hexdigest() for j in joined], pa.string()), pa.array([j.decode() if texts else None for j in joined], pa.string()),
                    ],
                    final,
                )

    def by_chunk(answers: DataFrame, name: str) -> DataFrame:
        return answers.groupBy("chunk").agg(F.collect_list(F.struct("at", "bits")).alias(name)).hint("shuffle_hash")

    sketch = chunks.select("chunk", "ids", "blob").mapInArrow(count, "at int, chunk long, cells binary, more binary")
    marks = by_chunk(sketch.groupBy("at").applyInArrow(merge, "at int, chunk long, bits binary"), "marks")
    marked = chunks.join(marks, "chunk", "left")
    deal = marked.select("chunk", "ids", "blob", "marks").mapInArrow(dealt, "at int, chunk long, a binary, b binary, more binary")
    repeats = by_chunk(deal.groupBy("at").applyInArrow(grouped, "at int, chunk long, bits binary"), "repeats")
    out = marked.join(repeats, "chunk", "left").select("ids", "blob", "marks", "repeats")
    out = out.mapInArrow(closed, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")
    return out.select(*final[:4], *([F.col("kept").alias("text")] if texts else []))
