"""Boxes on pages: matching, suppression, owners, order, proximity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.geometry import Box, contained, iou

BOX = ("l", "t", "r", "b")
#: Cells of a page that are laid out whole, gaps closed; on a larger page cells are looked up.
DENSE_CELLS = 1 << 20


def _overlap(a: Column, b: Column) -> Column:
    return iou(Box(*(a[c] for c in BOX)), Box(*(b[c] for c in BOX)))


def suppressed(boxes: DataFrame, threshold: float) -> DataFrame:
    """Non-maximum suppression by page: boxes in the order of (score, area) descending stay unless one that stayed overlaps them by ``threshold`` or more. Ties keep idx order.

    An ordered fold over each page's boxes: pages are small, and no page needs another.
    """
    area = F.greatest(F.col("r") - F.col("l"), F.lit(0.0)) * F.greatest(F.col("b") - F.col("t"), F.lit(0.0))
    row = F.struct((-F.col("score")).alias("k1"), (-area).alias("k2"), F.col("idx"), *[F.col(c) for c in BOX], F.col("score"))
    pages = boxes.groupBy("page").agg(F.sort_array(F.collect_list(row)).alias("all"))
    step = lambda kept, x: F.when(F.exists(kept, lambda k: _overlap(k, x) >= threshold), kept).otherwise(F.concat(kept, F.array(x)))
    kept = F.aggregate("all", F.filter("all", lambda x: F.lit(False)), step)
    return pages.select("page", F.explode(kept).alias("x")).select("page", "x.idx", *[f"x.{c}" for c in BOX], "x.score")


def greedy_matches(candidates: DataFrame, references: DataFrame, threshold: float = 0.3) -> DataFrame:
    """One-to-one matches by page, largest overlap first, ties to the largest indices: ``page, cand, ref, score``.

    Only pairs at or over the threshold leave the join; the fold over each
    page's pairs takes one whenever both sides are free.
    """
    a = candidates.select("page", F.col("idx").alias("cand"), *[F.col(c).alias(f"a{c}") for c in BOX])
    b = references.select("page", F.col("idx").alias("ref"), *[F.col(c).alias(f"b{c}") for c in BOX])
    pairs = a.join(b, "page").withColumn("score", iou(Box.of("a"), Box.of("b"))).filter(F.col("score") >= threshold)
    ranked = pairs.groupBy("page").agg(F.sort_array(F.collect_list(F.struct("score", "cand", "ref")), asc=False).alias("all"))
    free = lambda got, x: ~F.exists(got, lambda m: (m["cand"] == x["cand"]) | (m["ref"] == x["ref"]))
    got = F.aggregate("all", F.filter("all", lambda x: F.lit(False)), lambda g, x: F.when(free(g, x), F.concat(g, F.array(x))).otherwise(g))
    return ranked.select("page", F.explode(got).alias("m")).select("page", "m.cand", "m.ref", "m.score")


def owners(points: DataFrame, boxes: DataFrame) -> DataFrame:
    """``points(page, pid, x, y)`` with the smallest box that holds each, ties to the least idx; null if none does."""
    b = boxes.select("page", "idx", *BOX)
    inside = F.col("x").between(F.col("l"), F.col("r")) & F.col("y").between(F.col("t"), F.col("b"))
    key = F.struct(((F.col("r") - F.col("l")) * (F.col("b") - F.col("t"))).alias("area"), "idx")
    found = points.join(b, "page").filter(inside).groupBy("page", "pid").agg(F.min(key)["idx"].alias("owner"))
    return points.join(found, ["page", "pid"], "left")


def downward_links(nodes: DataFrame, sideways: float = 0.45) -> DataFrame:
    """Each node's nearest node below it: ``page, src, dst``; the gap plus ``sideways`` times the shift of centres counts, ties to the least idx."""
    a = nodes.select("page", F.col("idx").alias("src"), *[F.col(c).alias(f"a{c}") for c in BOX])
    b = nodes.select("page", F.col("idx").alias("dst"), *[F.col(c).alias(f"b{c}") for c in BOX])
    cost = (F.col("bt") - F.col("ab")) + sideways * F.abs((F.col("bl") + F.col("br")) / 2 - (F.col("al") + F.col("ar")) / 2)
    near = a.join(b, "page").filter("src != dst and bt >= ab").groupBy("page", "src").agg(F.min(F.struct(cost.alias("cost"), "dst"))["dst"].alias("dst"))
    return near


def flow_order(nodes: DataFrame, band: float = 48.0) -> DataFrame:
    """Add ``place``: bands from the top, then nearness to the page's median centre, then top, left, idx."""
    center = (F.col("l") + F.col("r")) / 2
    rows = nodes.withColumn("__lane", F.median(center).over(Window.partitionBy("page")))
    w = Window.partitionBy("page").orderBy(F.bround(F.col("t") / band), F.abs(center - F.col("__lane")), "t", "l", "idx")
    return rows.withColumn("place", F.row_number().over(w)).drop("__lane")


def fragment_order(fragments: DataFrame, places: DataFrame) -> DataFrame:
    """Add ``order`` to ``fragments(page, idx, owner, t, l)``: by the place of the owner in ``places(page, idx, place)``, fragments without one last, then top, left, idx."""
    own = places.select("page", F.col("idx").alias("owner"), "place")
    w = Window.partitionBy("page").orderBy(F.col("place").asc_nulls_last(), "t", "l", "idx")
    return fragments.join(own, ["page", "owner"], "left").withColumn("order", F.row_number().over(w)).drop("place")


def labelled(words: DataFrame, regions: DataFrame, share: float = 0.5) -> DataFrame:
    """Regions with the words that lie in them by ``share`` or more, joined in (top, left) order: ``page, idx, words``."""
    w = words.select("page", F.col("idx").alias("wid"), "label", *[F.col(c).alias(f"w{c}") for c in BOX])
    inside = contained(Box.of("w"), Box.of()) >= share
    found = regions.join(w, "page").filter(inside).groupBy("page", "idx").agg(F.array_join(F.sort_array(F.collect_list(F.struct("wt", "wl", "wid", "label")))["label"], " ").alias("words"))
    return regions.select("page", "idx").join(found, ["page", "idx"], "left")


def _hits(item: np.ndarray, probes: np.ndarray, x: np.ndarray, y: np.ndarray, n: int, radius: int) -> np.ndarray:
    """Of a page's cells, by number of item: at [p, q], how many probing cells of p have a cell of q within ``radius``."""

    def closed(v: np.ndarray) -> np.ndarray:
        """Coordinates with wide gaps closed to what is just out of reach."""
        own, at = np.unique(v, return_inverse=True)
        return np.r_[0, np.cumsum(np.minimum(np.diff(own), radius + 1))][at] + radius

    x, y = closed(x), closed(y)
    wide = int(y.max()) + radius + 1
    key = x * wide + y
    cells, at = np.unique(key, return_inverse=True)
    area = (int(x.max()) + radius + 1) * wide
    dense = area <= DENSE_CELLS
    span = int(key.max()) + 1
    once = np.unique(item[probes] * span + key[probes])  # a cell may be listed again and again
    asked, owner = once % span, once // span
    out = np.zeros((n, n), np.int64)
    for low in range(0, n, 62):  # so many items in the bits of a number
        some = (item >= low) & (item < low + 62)
        held = np.zeros(area if dense else len(cells), np.int64)
        np.bitwise_or.at(held, (key if dense else at)[some], np.int64(1) << (item[some] - low))
        seen = np.zeros(len(asked), np.int64)
        for i in range(-radius, radius + 1):
            for j in range(-radius, radius + 1):
                if i * i + j * j <= radius * radius:
                    to = asked + i * wide + j
                    if dense:
                        seen |= held[to]
                    else:
                        place = np.minimum(np.searchsorted(cells, to), len(cells) - 1)
                        seen |= np.where(cells[place] == to, held[place], 0)
        for q in range(low, min(n, low + 62)):
            out[:, q] = np.bincount(owner[(seen >> (q - low)) & 1 > 0], minlength=n)
    return out


def near_items(items: DataFrame, radius: int, least: int, allowed: DataFrame | None = None) -> DataFrame:
    """``near_pairs`` of rows ``page, item, probes, cells array<struct<cx, cy>>``, dealt by page: nothing else is shuffled, and no pair of cells is a row."""
    kinds = {f.name: f.dataType for f in items.schema.fields}
    row = F.struct("item", "probes", "cells")
    pages = items.filter("item is not null and page is not null").groupBy("page").agg(F.collect_list(row).alias("items"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("items")
            rows = lists.flatten()
            names, probes, cells = rows.field("item").to_pylist(), np.array([bool(p) for p in rows.field("probes").to_pylist()], bool), rows.field("cells")
            size = cells.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            flat = cells.flatten()
            x, y = (flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("cx", "cy"))
            row_end = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
            cell_end = np.r_[0, np.cumsum(size)]
            pages_, a, b, hits = [], [], [], []
            for page, low, high in zip(batch.column("page").to_pylist(), np.r_[0, row_end[:-1]], row_end):
                own = sorted(set(names[low:high]))
                number = {name: k for k, name in enumerate(own)}
                codes = np.array([number[name] for name in names[low:high]], np.int64)
                part = slice(cell_end[low], cell_end[high])
                if part.start == part.stop:
                    continue
                found = _hits(np.repeat(codes, size[low:high]), np.repeat(probes[low:high], size[low:high]), x[part], y[part], len(own), radius)
                both = np.triu(found + found.T, 1)
                for p, q in zip(*np.nonzero((both >= least) & (both > 0))):
                    pages_.append(page), a.append(own[p]), b.append(own[q]), hits.append(int(both[p, q]))
            kind = batch.schema.field("items").type.value_type.field("item").type
            yield pa.RecordBatch.from_arrays([pa.array(pages_, batch.schema.field("page").type), pa.array(a, kind), pa.array(b, kind), pa.array(hits, pa.int64())], ["page", "a", "b", "hits"])

    out = T.StructType([T.StructField("page", kinds["page"]), T.StructField("a", kinds["item"]), T.StructField("b", kinds["item"]), T.StructField("hits", T.LongType())])
    hits = pages.mapInArrow(run, out)
    return hits if allowed is None else hits.join(allowed, ["page", "a", "b"], "left_anti")


def near_pairs(points: DataFrame, radius: int, least: int, allowed: DataFrame | None = None) -> DataFrame:
    """Items of a page whose ink comes within ``radius`` cells in ``least`` places or more: ``page, a, b, hits``; a < b.

    ``points(page, item, cx, cy, probes)`` in grid cells.  Cells of items that
    probe (text and formulas) look around: a place counts for each other item
    near it, so two such items count from both sides.  A page's items are marked in
    one number a cell, and the numbers of the disc around a cell are put together; ``allowed(page, a, b)`` pairs, a < b, are left out.
    """
    cells = points.filter("cx is not null and cy is not null").groupBy("page", "item", "probes").agg(F.collect_set(F.struct("cx", "cy")).alias("cells"))
    return near_items(cells, radius, least, allowed)


def text_rows(tsv: DataFrame, least: float = 20.0) -> DataFrame:
    """Recognised words from OCR rows of strings (left, top, width, height, conf, text): rows that can't be read, empty boxes and confidences under ``least`` go."""
    n = {c: F.expr(f"try_cast({c} as double)") for c in ("left", "top", "width", "height", "conf")}
    rows = tsv.select(F.trim("text").alias("label"), *[v.alias(k) for k, v in n.items()])
    rows = rows.filter(f"label != '' and conf >= {least} and width > 0 and height > 0 and left is not null and top is not null")
    return rows.select(F.col("left").alias("l"), F.col("top").alias("t"), (F.col("left") + F.col("width")).alias("r"), (F.col("top") + F.col("height")).alias("b"), F.col("conf").alias("score"), "label")


def quad_box(quad: Column, score: Column) -> Column:
    """Box of a four-point outline (array<array<double>>); the score becomes per cent."""
    side = lambda f, k: f(F.transform(quad, lambda p: p[k]))
    return F.struct(side(F.array_min, 0).alias("l"), side(F.array_min, 1).alias("t"), side(F.array_max, 0).alias("r"), side(F.array_max, 1).alias("b"), (score * 100).alias("score"))
