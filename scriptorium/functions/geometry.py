"""Geometry as Column expressions; boxes are four columns (left, top, right, bottom)."""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Box(NamedTuple):
    """Four Column edges."""

    left: Column
    top: Column
    right: Column
    bottom: Column

    @classmethod
    def of(cls, prefix: str = "") -> Box:
        return cls(*(F.col(f"{prefix}{c}") for c in "ltrb"))

    @property
    def width(self) -> Column:
        return F.greatest(self.right - self.left, F.lit(0.0))

    @property
    def height(self) -> Column:
        return F.greatest(self.bottom - self.top, F.lit(0.0))

    @property
    def area(self) -> Column:
        return self.width * self.height

    @property
    def center(self) -> tuple[Column, Column]:
        return (self.left + self.right) / 2, (self.top + self.bottom) / 2


def half_away(x: Column) -> Column:
    """Round half away from zero, exactly: ``floor(x + 0.5)`` or ``ceil(x - 0.5)``."""
    return F.when(x >= 0, F.floor(x + 0.5)).otherwise(F.ceil(x - 0.5))


def half_even(x: Column) -> Column:
    return F.bround(x)


def intersection(a: Box, b: Box) -> Column:
    w = F.greatest(F.least(a.right, b.right) - F.greatest(a.left, b.left), F.lit(0.0))
    h = F.greatest(F.least(a.bottom, b.bottom) - F.greatest(a.top, b.top), F.lit(0.0))
    return w * h


def iou(a: Box, b: Box) -> Column:
    """Intersection over union; 0 where the union is empty."""
    shared = intersection(a, b)
    return F.coalesce(F.try_divide(shared, a.area + b.area - shared), F.lit(0.0))


def contained(inner: Box, outer: Box) -> Column:
    """Share of ``inner`` that lies in ``outer``; 0 where inner is empty."""
    return F.coalesce(F.try_divide(intersection(inner, outer), inner.area), F.lit(0.0))


def overlaps(a: Box, b: Box, margin: float = 0.0) -> Column:
    """Strict overlap of the boxes grown by ``margin``."""
    return (a.left - margin < b.right) & (b.left - margin < a.right) & (a.top - margin < b.bottom) & (b.top - margin < a.bottom)


def fit(width: Column, height: Column, size: int = 224) -> dict[str, Column]:
    """Ratio, whole size (1 at least) and centring offsets that fit a picture in a square."""
    ratio = F.least(F.lit(float(size)) / width, F.lit(float(size)) / height)
    w, h = (F.greatest(F.lit(1), (x * ratio).cast("int")) for x in (width, height))
    return {"ratio": ratio, "w": w, "h": h, "dx": F.floor((F.lit(size) - w) / 2).cast("int"), "dy": F.floor((F.lit(size) - h) / 2).cast("int")}


def unfit(v: Column, ratio: Column, shift: Column, origin: Column | None = None) -> Column:
    """A coordinate of the square back in the picture."""
    return (v - shift) / ratio + (F.lit(0.0) if origin is None else origin)


def segment_hits_box(x0: Column, y0: Column, x1: Column, y1: Column, box: Box, samples: int = 40) -> Column:
    """Whether a point of the segment, sampled evenly, lies strictly inside the box."""
    at = F.sequence(F.lit(0), F.lit(samples))

    def inside(i: Column) -> Column:
        t = i / samples
        x, y = x0 + (x1 - x0) * t, y0 + (y1 - y0) * t
        return (x > box.left) & (x < box.right) & (y > box.top) & (y < box.bottom)

    return F.exists(at, inside)


def on_segment(x: Column, y: Column, x0: Column, y0: Column, x1: Column, y1: Column, near: float = 0.5) -> Column:
    """Whether a point is on an upright or level segment, give or take ``near``."""
    return x.between(F.least(x0, x1) - near, F.greatest(x0, x1) + near) & y.between(F.least(y0, y1) - near, F.greatest(y0, y1) + near)


def circle(cx: Column, cy: Column, r: Column, n: int = 24) -> Column:
    """A closed circle of n segments as array<struct<x, y>>, from its top counter-clockwise on a page whose y grows down."""
    turn = lambda i: i * (2 * 3.141592653589793 / n)
    return F.transform(F.sequence(F.lit(0), F.lit(n)), lambda i: F.struct((cx - r * F.sin(turn(i))).alias("x"), (cy - r * F.cos(turn(i))).alias("y")))


def rounded_rectangle(box: Box, radius: Column, n: int = 6) -> Column:
    """A closed outline from the end of the top left corner clockwise; corners are quarter circles of n segments, none of a radius over half a side."""
    r = F.least(radius, (box.right - box.left) / 2, (box.bottom - box.top) / 2)
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    plain = F.array(*(point(x, y) for x, y in ((box.left, box.top), (box.right, box.top), (box.right, box.bottom), (box.left, box.bottom), (box.left, box.top))))

    # the turns are the same for all boxes, so they are constants; the last point is the first again
    turns = [(corner, math.radians(corner * 90 - 90 + part * (90 / n))) for corner in range(4) for part in range(n + 1)]
    steps = F.array(*(F.struct(F.lit(math.cos(t)).alias("c"), F.lit(math.sin(t)).alias("s"), F.lit(k < 2).alias("right"), F.lit(k in (0, 3)).alias("top")) for k, t in [*turns, turns[0]]))

    def at(s: Column, e: Column) -> Column:
        return point(F.when(s["right"], e["right"]).otherwise(e["left"]) + e["r"] * s["c"], F.when(s["top"], e["top"]).otherwise(e["bottom"]) + e["r"] * s["s"])

    # as a list of one, so that the corners' centres are computed once for a box
    centres = F.array(F.struct(r.alias("r"), (box.right - r).alias("right"), (box.left + r).alias("left"), (box.top + r).alias("top"), (box.bottom - r).alias("bottom")))
    round_ = F.transform(centres, lambda e: F.transform(steps, lambda s: at(s, e)))[0]
    return F.when(r <= 0, plain).otherwise(round_)


def segment_conflict(first: tuple[Column, Column, Column, Column], second: tuple[Column, Column, Column, Column], near: float = 0.01) -> Column:
    """How two level or upright segments (x0, y0, x1, y1) meet: ``overlap``, ``touch``, or null where they are apart or properly cross."""
    (ax, ay, bx, by), (cx, cy, dx, dy) = first, second
    level_a, level_c = F.abs(ay - by) < near, F.abs(cy - dy) < near

    def along(x0: Column, x1: Column, u0: Column, u1: Column, apart: Column) -> Column:
        shared = F.least(F.greatest(x0, x1), F.greatest(u0, u1)) - F.greatest(F.least(x0, x1), F.least(u0, u1))
        return F.when(apart > near, None).when(shared > near, "overlap").when(shared > -near, "touch")

    def across(h: tuple, v: tuple) -> Column:
        x, y, low_x, high_x = v[0], h[1], F.least(h[0], h[2]), F.greatest(h[0], h[2])
        low_y, high_y = F.least(v[1], v[3]), F.greatest(v[1], v[3])
        meet = x.between(low_x - near, high_x + near) & y.between(low_y - near, high_y + near)
        proper = (x > low_x + near) & (x < high_x - near) & (y > low_y + near) & (y < high_y - near)
        return F.when(meet & ~proper, "touch")

    same = F.when(level_a, along(ax, bx, cx, dx, F.abs(ay - cy))).otherwise(along(ay, by, cy, dy, F.abs(ax - cx)))
    return F.when(level_a == level_c, same).when(level_a, across(first, second)).otherwise(across(second, first))


def diamond(box: Box) -> Column:
    cx, cy = box.center
    return F.array(*(F.struct(x.alias("x"), y.alias("y")) for x, y in ((cx, box.top), (box.right, cy), (cx, box.bottom), (box.left, cy), (cx, box.top))))


def parallelogram(box: Box, skew: Column | float = 8.0) -> Column:
    """``skew``: how far the top edge is set to the right, in the box's unit."""
    s = F.lit(skew) if isinstance(skew, (int, float)) else skew
    points = ((box.left + s, box.top), (box.right, box.top), (box.right - s, box.bottom), (box.left, box.bottom), (box.left + s, box.top))
    return F.array(*(F.struct(x.alias("x"), y.alias("y")) for x, y in points))


def bezier(p0: tuple, p1: tuple, p2: tuple, p3: tuple, n: int = 12) -> Column:
    """A cubic Bezier curve in n segments as array<struct<x, y>>."""

    def at(i: Column, k: int) -> Column:
        t = i / n
        u = 1 - t
        return u * u * u * p0[k] + 3 * u * u * t * p1[k] + 3 * u * t * t * p2[k] + t * t * t * p3[k]

    return F.transform(F.sequence(F.lit(0), F.lit(n)), lambda i: F.struct(at(i, 0).alias("x"), at(i, 1).alias("y")))


def bounds(points: Column) -> Column:
    """Bounding box of array<struct<x, y>>; zeros if empty."""
    side = lambda f, k: F.coalesce(f(F.transform(points, lambda p: p[k])), F.lit(0.0))
    return F.struct(side(F.array_min, "x").alias("l"), side(F.array_min, "y").alias("t"), side(F.array_max, "x").alias("r"), side(F.array_max, "y").alias("b"))


def translated(points: Column, dx: Column, dy: Column) -> Column:
    return F.transform(points, lambda p: F.struct((p["x"] + dx).alias("x"), (p["y"] + dy).alias("y")))


def scaled(points: Column, sx: Column, sy: Column | None = None) -> Column:
    return F.transform(points, lambda p: F.struct((p["x"] * sx).alias("x"), (p["y"] * (sx if sy is None else sy)).alias("y")))


def simplified(points: Column) -> Column:
    """An orthogonal polyline without repeated points and without the middle of three points in line."""

    def step(acc: Column, p: Column) -> Column:
        n = F.size(acc)
        last, before = F.try_element_at(acc, F.lit(-1)), F.try_element_at(acc, F.lit(-2))
        in_line = ((before["x"] == last["x"]) & (last["x"] == p["x"])) | ((before["y"] == last["y"]) & (last["y"] == p["y"]))
        return F.when((n > 0) & (last["x"] == p["x"]) & (last["y"] == p["y"]), acc).when((n > 1) & in_line, F.concat(F.slice(acc, F.lit(1), n - 1), F.array(p))).otherwise(F.concat(acc, F.array(p)))

    return F.aggregate(points, F.filter(points, lambda p: F.lit(False)), step)
