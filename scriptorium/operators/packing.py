"""Packing of blocks on pages: a fold over the space that is still free, attempt after attempt until one fits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

# How attempts shrink text and then grow the page.
ATTEMPTS, SHRINK, BOARDS = 12, (1.0, 0.92, 0.8464, 0.778688), (1.0, 1.25, 1.5)
#: Steps of the search for any free spot.
SCAN = 10.0
#: Places of blocks, and spots of a search, that a task holds at once.
CELLS = 1 << 20


def kept_with_next(blocks: DataFrame, gap: float) -> DataFrame:
    """``blocks(page, idx, heading, w, h)`` -> ``page, idx, w, h, members array<struct<idx, dy>>``: headings stacked on the block that they introduce.

    A heading goes with the next block that is none; headings at a page's end
    stay together.  ``members`` says how far below a block's top each of its own blocks is.
    """
    order = Window.partitionBy("page").orderBy("idx")
    group = F.coalesce(F.sum((~F.col("heading")).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = blocks.withColumn("g", group)
    inside = Window.partitionBy("page", "g").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("dy", F.coalesce(F.sum(F.col("h") + gap).over(inside), F.lit(0.0)))
    members = F.sort_array(F.collect_list(F.struct("idx", "dy")))
    return rows.groupBy("page", "g").agg(F.min("idx").alias("idx"), F.max("w").alias("w"), F.max(F.col("dy") + F.col("h")).alias("h"), members.alias("members")).drop("g")


def _scanned(w: np.ndarray, h: np.ndarray, placed: tuple[np.ndarray, ...], near: float, margin: float, sheet: tuple[float, float]) -> tuple[np.ndarray, np.ndarray]:
    """The first free spot by rows for a block of each page, NaN where there is none; ``placed`` are x, y, w and h of the blocks before, by page."""
    x, y = np.full(len(w), np.nan), np.full(len(w), np.nan)
    steps = lambda room: np.floor(np.nan_to_num(np.maximum((room - margin) / SCAN, 0))).astype(np.int64) + 1
    across, down = steps(sheet[0] - w), steps(sheet[1] - h)
    i = np.arange(across.max())
    spot_x = margin + i * SCAN
    some = max(CELLS // len(i), 1)
    for first in range(0, len(w), some):
        left, rows = np.arange(first, min(first + some, len(w))), 0
        while len(left := left[down[left] > rows]):
            j = np.arange(rows, min(rows + max(CELLS // (len(i) * len(left)), 1), down[left].max()))
            rows, spot_y = j[-1] + 1, margin + j * SCAN
            px, py, pw, ph = (v[left, :, None] for v in placed)
            bw, bh = w[left, None], h[left, None]
            # a block is hit where it is hit both across and down
            hit_x = (spot_x - near < px + pw) & (px - near < (spot_x + bw)[:, None])
            hit_y = (spot_y - near < py + ph) & (py - near < (spot_y + bh)[:, None])
            free_x = (i < across[left, None]) & (spot_x >= margin * 0.5) & (spot_x + bw <= sheet[0] - margin * 0.5)
            free_y = (j < down[left, None]) & (spot_y >= margin * 0.5) & (spot_y + bh <= sheet[1] - margin * 0.5)
            free = free_y[:, :, None] & free_x[:, None]
            for k in range(px.shape[1]):
                free &= ~(hit_y[:, k, :, None] & hit_x[:, k, None])
            free = free.reshape(len(left), -1)
            at = free.argmax(1)
            found = free[np.arange(len(left)), at]
            y[left[found]], x[left[found]] = spot_y[at[found] // len(i)], spot_x[at[found] % len(i)]
            left = left[~found]
    return x, y


def packed(w: np.ndarray, h: np.ndarray, n: np.ndarray, gap: float, column_gap: float, margin: float, beside_first: bool, sheet: tuple[float, float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``x, y, lost`` of blocks in order, for pages of a width and height at once: a row each, with ``n`` blocks.

    A block goes below the last one in its column, beside it, at the top of a
    new column, or to the first free spot by rows, whichever is free first;
    ``beside_first`` turns the first two round.  ``lost``: some block had no place.
    """
    x, y, column, lost, near = np.zeros(w.shape), np.zeros(w.shape), np.zeros(len(w)), np.zeros(len(w), bool), gap * 0.6
    for k in range(w.shape[1]):
        at = np.flatnonzero(~lost & (n > k))
        if not len(at):
            break
        bw, bh = w[at, k], h[at, k]
        placed = px, py, pw, ph = tuple(v[at, :k] for v in (x, y, w, h))
        top = np.full(len(at), margin)
        if k:
            below = column[at], py[:, -1] + ph[:, -1] + gap, False
            beside = px[:, -1] + pw[:, -1] + column_gap, py[:, -1], True
            spots = [*((beside, below) if beside_first else (below, beside)), ((px + pw).max(1) + column_gap, top, True)]
        else:
            spots = [(top, top, True)]
        bx, by, new = np.full(len(at), np.nan), np.full(len(at), np.nan), np.ones(len(at), bool)
        for sx, sy, fresh in spots:
            # on the page, in half its margin, and 0.6 of a gap away from the placed ones
            free = np.isnan(bx) & (sx >= margin * 0.5) & (sy >= margin * 0.5) & (sx + bw <= sheet[0] - margin * 0.5) & (sy + bh <= sheet[1] - margin * 0.5)
            u, v = sx[:, None], sy[:, None]
            free &= ~((u - near < px + pw) & (px - near < u + bw[:, None]) & (v - near < py + ph) & (py - near < v + bh[:, None])).any(1)
            bx[free], by[free], new[free] = sx[free], sy[free], fresh
        none = np.flatnonzero(np.isnan(bx))
        if len(none):
            bx[none], by[none] = _scanned(bw[none], bh[none], tuple(p[none] for p in placed), near, margin, sheet)
        x[at, k], y[at, k], lost[at] = bx, by, np.isnan(bx)
        column[at] = np.where(new, bx, column[at])
    return x, y, lost


def _fitted(w: np.ndarray, h: np.ndarray, n: np.ndarray, width: float, height: float, gap: float, column_gap: float, margin: float) -> tuple[np.ndarray, ...]:
    """``attempt, scale, x, y`` of pages, a row each with ``n`` blocks; ``attempt`` is -1 where none fits."""
    attempt, scale, x, y = np.full(len(w), -1, np.int32), np.full(len(w), np.nan), np.zeros(w.shape), np.zeros(w.shape)
    left = np.arange(len(w))
    for a in range(ATTEMPTS):
        s, board = SHRINK[min(max(a - 2, 0), 3)], BOARDS[0 if a < 6 else 1 if a < 9 else 2]
        ax, ay, lost = packed(w[left] * s, h[left] * s, n[left], gap * s, column_gap * s, margin, a % 2 == 1, (width * board, height * board))
        made = left[~lost]
        attempt[made], scale[made], x[made], y[made] = a, s, ax[~lost], ay[~lost]
        left = left[lost]
        if not len(left):
            break
    return attempt, scale, x, y


def layouts(blocks: DataFrame, width: float, height: float, gap: float, column_gap: float, margin: float) -> DataFrame:
    """``blocks(page, idx, w, h)`` -> ``page, attempt, idx, x, y, scale``: the places of the first attempt that fits all of a page's blocks; later ones aren't made.

    Attempts 0 to 11: every second one tries beside before below; from the third on
    blocks shrink, three times at most; from the seventh and tenth on the page is larger.  A page that
    no attempt fits has rows with null ``attempt`` and places.  A page's blocks are one row: what one page holds;
    pages of a batch are packed together, block after block.
    """
    sizes = [F.col(c).cast("double").alias(c) for c in "wh"]
    pages = blocks.groupBy("page").agg(F.sort_array(F.collect_list(F.struct("idx", *sizes))).alias("b")).select("page", "b.idx", "b.w", "b.h")
    names = [("attempt", IntegerType()), ("idx", blocks.schema["idx"].dataType), ("x", DoubleType()), ("y", DoubleType()), ("scale", DoubleType())]
    schema = StructType([StructField("page", blocks.schema["page"].dataType), *(StructField(*n) for n in names)])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            page, idx, *wh = batch.columns
            n = np.diff(idx.offsets.to_numpy())
            w, h = (v.flatten().to_numpy(zero_copy_only=False) for v in wh)
            begin = np.cumsum(n) - n
            order, first = np.argsort(-n, kind="stable"), 0
            while first < len(order):  # pages of about one size together
                most = max(n[order[first]], 1)
                own = order[first : first + max(CELLS // most, 1)]
                first += len(own)
                inside = np.arange(most) < n[own, None]
                flat = (begin[own, None] + np.arange(most))[inside]
                grid = np.zeros((2, len(own), most))
                grid[:, inside] = w[flat], h[flat]
                attempt, scale, x, y = _fitted(*grid, n[own], width, height, gap, column_gap, margin)
                at = np.repeat(np.arange(len(own)), n[own])
                none = attempt[at] < 0
                columns = [page.take(pa.array(own[at])), pa.array(attempt[at], mask=none), idx.flatten().take(pa.array(flat))]
                columns += [pa.array(v, mask=none) for v in (x[inside], y[inside], scale[at])]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return pages.mapInArrow(place, schema)
