"""Benchmark decontamination with Wu-Manber multi-pattern search over words."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MANY_BLOCKS, alnum_words, as_bytes, slices

WINDOW_WORDS = 13
#: Windows of benchmark text in one broadcast search table; a larger benchmark takes several, one after the other.
#: A table takes some 40 bytes for each window and as many places of its hash table (4 to 8 for each window, 5 bytes each).
BLOCK_WINDOWS = 1 << 20


class WuManber:
    """Searches word lists for all windows of one length of some items.

    Blocks are pairs of words (single words for windows of one word).  The
    shift table, by hash of the block, says how far the end of a candidate may
    move for the block seen there (blocks of one hash share the least); where
    it can't move, the bucket of that hash names the windows, sorted by a hash
    of their own, and the words are compared directly.
    """

    def __init__(self, length: int, items: list[tuple[str, list[bytes]]], seed: int = 0) -> None:
        m, self.length, self.block, self.seed = length, length, min(2, length), seed
        self.items = [item for item, _ in items]
        windows = sum(len(words) - m + 1 for _, words in items)
        self.mask = (1 << max(4, (4 * windows).bit_length())) - 1
        self.shift = np.full(self.mask + 1, m - self.block + 1, np.uint8 if m < 255 else np.int32)
        starts, ends, buckets, owners, base, lines = [], [], [], [], 0, []
        for k, (_, words) in enumerate(items):
            at = base + np.cumsum([0, *(len(w) + 1 for w in words)])
            places = np.fromiter((self._place(words, end) for end in range(self.block, len(words) + 1)), np.int64, len(words) - self.block + 1)
            # a block that ends n words into the item ends a window from n = m on
            np.minimum.at(self.shift, places, np.maximum(0, m - np.arange(self.block, len(words) + 1)).astype(self.shift.dtype))
            starts.append(at[: len(words) - m + 1])
            ends.append(at[m:] - 1)
            buckets.append(places[m - self.block :])
            owners.append(np.full(len(words) - m + 1, k, np.int32))
            lines.append(b" ".join(words))
            base = int(at[-1])
        self.text = b" ".join(lines)
        start, end, bucket, owner = (np.concatenate(x) for x in (starts, ends, buckets, owners))
        own = np.fromiter((self._hash(self.text[a:b]) for a, b in zip(start.tolist(), end.tolist())), np.uint64, windows)
        order = np.lexsort((owner, own, bucket))
        self.start, self.end, self.owner, self.hash = start[order], (end - start)[order].astype(np.int32), owner[order], own[order]
        self.first = np.searchsorted(bucket[order], np.arange(self.mask + 2)).astype(np.int32)
        self.end = self.start + self.end

    def _place(self, words: list[bytes], end: int) -> int:
        return xxhash.xxh32_intdigest(b" ".join(words[end - self.block : end]), self.seed) & self.mask

    def _hash(self, window: bytes) -> int:
        return xxhash.xxh64_intdigest(window, self.seed)

    def sound(self) -> bool:
        """Whether windows of one hash have the same words, so that comparing one of them is enough."""
        same = np.flatnonzero((self.hash[1:] == self.hash[:-1]) & (np.diff(self.start) != 0))
        return all(self._window(i) == self._window(i + 1) for i in same.tolist())

    def _window(self, i: int) -> bytes:
        return self.text[self.start[i] : self.end[i]]

    def find(self, words: list[bytes]) -> Iterator[tuple[int, list[str]]]:
        """(first word, items) of each occurrence."""
        m, n, end, shift, place = self.length, len(words), self.length, self.shift, self._place
        while end <= n:
            at = place(words, end)
            if step := int(shift[at]):
                end += step
                continue
            lo, hi = int(self.first[at]), int(self.first[at + 1])
            if lo < hi:
                window = b" ".join(words[end - m : end])
                key = np.uint64(self._hash(window))
                a = lo + int(np.searchsorted(self.hash[lo:hi], key))
                if a < hi and self.hash[a] == key and self._window(a) == window:
                    b = lo + int(np.searchsorted(self.hash[lo:hi], key, "right"))
                    yield end - m, [self.items[i] for i in np.unique(self.owner[a:b])]
            end += 1


def machines(items: list[tuple[str, list[bytes]]], window: int = WINDOW_WORDS) -> list[WuManber]:
    """A search for each window length: all windows of an item, or the whole of a shorter one."""
    by: dict[int, list[tuple[str, list[bytes]]]] = {}
    for item, words in items:
        if words:
            by.setdefault(min(window, len(words)), []).append((item, words))
    out = []
    for length, own in by.items():
        machine = WuManber(length, own)
        while not machine.sound():
            machine = WuManber(length, own, machine.seed + 1)
        out.append(machine)
    return out


def _blocks(benchmark: DataFrame, limit: int, window: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """Items with their words, ``limit`` windows at a time; a longer item is cut in overlapping pieces."""
    block: list[tuple[str, list[bytes]]] = []
    held = 0
    for item, text in benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string")).toLocalIterator():
        words = alnum_words(text and text.encode()) if item is not None else []
        windows = max(1, len(words) - window + 1)
        for at in range(0, windows if words else 0, limit):
            part = words[at : at + limit + window - 1]
            n = max(1, len(part) - window + 1)
            if block and held + n > limit:
                yield block
                block, held = [], 0
            block.append((item, part))
            held += n
    yield block


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW_WORDS, block_windows: int = BLOCK_WINDOWS, keep: bool = False) -> DataFrame:
    """Benchmark passages in ``docs(doc_id, text)``; ``benchmark(item_id, text)``.

    Returns ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``, a
    row for each row of ``docs`` in no order; with ``keep``, instead the rows
    and columns of ``docs`` that aren't contaminated.

    A word is hit inside any occurrence of a window of ``window`` consecutive
    words of an item, or of the whole of a shorter item.  Contaminated: at
    least one word in 20.  Null, empty and wordless texts have no words; items
    without id or words have no windows; equal items each count; an empty
    benchmark hits nothing.  The search tables hold ``block_windows`` windows
    at most, and a task holds one at a time; further tables are searched one
    after the other in the same pass, so the documents are never shuffled.
    Other columns are ignored; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    tables = [spark.sparkContext.broadcast(machines(b, window)) for b in _blocks(benchmark, block_windows, window)]
    names = docs.columns
    at_text = names.index("text")

    def judge(texts: list[bytes | None]) -> list[tuple[int, int, list[str]]]:
        words = [alnum_words(t) for t in texts]
        marks = [bytearray(len(w)) for w in words]
        items: list[set[str]] = [set() for _ in words]
        for table in tables:
            for machine in load(table):
                m = machine.length
                for w, mark, got in zip(words, marks, items):
                    for at, found in machine.find(w):
                        mark[at : at + m] = b"\1" * m
                        got.update(found)
        return [(len(w), mark.count(1), sorted(got)) for w, mark, got in zip(words, marks, items)]

    def load(table) -> list[WuManber]:
        found = table.value
        if len(tables) > 1:
            table.__dict__.pop("_value", None)  # the next use reads it from the worker's disk again
        return found

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, *(MANY_BLOCKS if len(tables) > 1 else ())):
            got = judge(as_bytes(part.column(1)))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array([n for n, _, _ in got], pa.int64()),
                    pa.array([h for _, h, _ in got], pa.int64()),
                    pa.array([len(i) for _, _, i in got], pa.int64()),
                    pa.array([hashlib.sha256(",".join(i).encode()).hexdigest() for _, _, i in got], pa.string()),
                    pa.array([h > 0 and 20 * h >= n for n, h, _ in got], pa.bool_()),
                ],
                ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
            )

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, *(MANY_BLOCKS if len(tables) > 1 else ())):
            got = judge(as_bytes(part.column(at_text)))
            yield part.filter(pa.array([not (h > 0 and 20 * h >= n) for n, h, _ in got], pa.bool_()))

    if keep:
        return docs.mapInArrow(clean, docs.schema)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(report, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")
