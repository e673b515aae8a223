"""Shapes, lines and circuits of diagrams: geometry by kind, pairwise conflicts, port and net rules, simulation."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import Box

Point = tuple[Column, Column]


def inside(kind: Column, box: Box, x: Column, y: Column, margin: float = 0.5, skew: Column | float = 8.0) -> Column:
    """Whether a point is in a shape by more than ``margin``: diamond, ellipse, parallelogram; any other kind is its box."""
    cx, cy, w, h = (box.left + box.right) / 2, (box.top + box.bottom) / 2, (box.right - box.left) / 2 - margin, (box.bottom - box.top) / 2 - margin
    u, v = F.abs(x - cx) / w, F.abs(y - cy) / h
    up = (box.bottom - y) / (box.bottom - box.top)
    leaning = (x > box.left + up * skew + margin) & (x < box.right - (1 - up) * skew - margin)
    shape = F.when(kind == "diamond", u + v < 1).when(kind == "ellipse", u * u + v * v < 1).when(kind == "parallelogram", leaning).otherwise(F.lit(True))
    return (x > box.left + margin) & (x < box.right - margin) & (y > box.top + margin) & (y < box.bottom - margin) & shape


def corners(kind: str, box: Box, skew: Column | float = 8.0) -> list[Point]:
    """Corners of an outline, in order."""
    cx, cy = (box.left + box.right) / 2, (box.top + box.bottom) / 2
    if kind == "diamond":
        return [(cx, box.top), (box.right, cy), (cx, box.bottom), (box.left, cy)]
    if kind == "parallelogram":
        return [(box.left + skew, box.top), (box.right, box.top), (box.right - skew, box.bottom), (box.left, box.bottom)]
    return [(box.left, box.top), (box.right, box.top), (box.right, box.bottom), (box.left, box.bottom)]


def segment_distance(a: Point, b: Point, x: Column, y: Column) -> Column:
    """Distance of a point from a segment, which may be a point."""
    dx, dy = b[0] - a[0], b[1] - a[1]
    share = F.coalesce(F.try_divide((x - a[0]) * dx + (y - a[1]) * dy, dx * dx + dy * dy), F.lit(0.0))
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), share))
    return F.hypot(x - a[0] - share * dx, y - a[1] - share * dy)


def outline_distance(kind: Column, box: Box, x: Column, y: Column, skew: Column | float = 8.0) -> Column:
    """Distance of a point from the outline of a diamond, parallelogram or box."""

    def least(name: str) -> Column:
        p = corners(name, box, skew)
        return F.least(*[segment_distance(a, b, x, y) for a, b in zip(p, p[1:] + p[:1])])

    return F.when(kind == "diamond", least("diamond")).when(kind == "parallelogram", least("parallelogram")).otherwise(least("box"))


def arrow_between(a: Box, b: Box, gap: Column | float) -> Column:
    """A straight arrow (x0, y0, x1, y1) from one box to another between the sides that face each other; null where the boxes overlap."""
    middle = lambda q: ((q.left + q.right) / 2, (q.top + q.bottom) / 2)
    (ax, ay), (bx, by) = middle(a), middle(b)
    arrow = lambda *v: F.struct(*[c.alias(n) for c, n in zip(v, ("x0", "y0", "x1", "y1"))])
    across = F.when(b.left > a.right, arrow(a.right + gap, ay, b.left - gap, by)).when(b.right < a.left, arrow(a.left - gap, ay, b.right + gap, by))
    return across.when(b.top > a.bottom, arrow(ax, a.bottom + gap, bx, b.top - gap)).when(b.bottom < a.top, arrow(ax, a.top - gap, bx, b.bottom + gap))


def conflicts(items: DataFrame, margin: float = 0.5) -> DataFrame:
    """``page, a, b, problem`` for the pairs of a page's ``items(page, idx, role, grp, l, t, r, b)`` that get in each other's way; a < b.

    Roles are text, node_text, shape and line, a line being a horizontal or
    vertical box without area and a shape its box; ``grp`` is a node, whose
    text may stand on its shape, or a net, whose lines may touch.  Lines may
    reach ``margin`` into a shape.  One join by page; meeting is part of it.
    """
    a, b = (items.select("page", *[F.col(c).alias(f"{p}_{c}") for c in ("idx", "role", "grp", "l", "t", "r", "b")]) for p in "ab")
    meet = "a_idx < b_idx and a_l <= b_r and b_l <= a_r and a_t <= b_b and b_t <= a_b"
    strict = F.expr("a_l < b_r and b_l < a_r and a_t < b_b and b_t < a_b")
    into = F.expr(f"a_l < b_r - {margin} and b_l < a_r - {margin} and a_t < b_b - {margin} and b_t < a_b - {margin}")
    plain = [F.when(F.col(f"{p}_role") == "node_text", "text").otherwise(F.col(f"{p}_role")) for p in "ab"]
    roles, other = F.array_sort(F.array(*plain)), F.col("a_grp") != F.col("b_grp")
    own = ~other & ((F.col("a_role") == "node_text") | (F.col("b_role") == "node_text"))
    are = lambda *r: roles == F.array(*map(F.lit, sorted(r)))
    along = F.expr("(a_t = a_b and b_t = b_b and a_t = b_t) or (a_l = a_r and b_l = b_r and a_l = b_l)")
    problem = (
        F.when(are("text", "text") & strict, "texts overlap")
        .when(are("text", "shape") & strict & ~own, "text on shape")
        .when(are("text", "line"), "line through text")
        .when(are("line", "shape") & into, "line through shape")
        .when(are("line", "line") & other & along, "nets touch")
    )
    return a.join(b, "page").filter(meet).select("page", F.col("a_idx").alias("a"), F.col("b_idx").alias("b"), problem.alias("problem")).filter("problem is not null")


def wire_problems(ports: DataFrame, wires: DataFrame) -> DataFrame:
    """``page, port, problem`` of circuits: ``ports(page, port, is_input)``, ``wires(page, src, dst)``.

    A wire's end that is no port, an input driven more than once, an input
    that nothing drives.
    """
    ends = wires.select("page", F.explode(F.array("src", "dst")).alias("port")).filter("port is not null")
    known = ports.select("page", "port")
    driven = wires.groupBy("page", F.col("dst").alias("port")).agg(F.count("*").alias("n"))
    parts = [
        (ends.join(known, ["page", "port"], "left_anti").distinct(), "no port"),
        (driven.filter("n > 1"), "driven twice"),
        (ports.filter("is_input").join(driven, ["page", "port"], "left_anti"), "not connected"),
    ]
    out = [rows.select("page", "port", F.lit(problem).alias("problem")) for rows, problem in parts]
    return out[0].unionByName(out[1]).unionByName(out[2])


def net_problems(parts: DataFrame, nets: DataFrame) -> DataFrame:
    """``page, name, problem`` of schematics: ``parts(page, part, col, row)``, ``nets(page, net, port)``, a port being one of ``part``.

    A grid place taken by two parts, a net of fewer than two ports, a port in
    two nets, a net at an unknown part.
    """
    text = lambda c: F.col(c).cast("string").alias("name")
    taken = parts.groupBy("page", "col", "row").agg(F.count("*").alias("n")).filter("n > 1").select("page", F.concat_ws(",", "col", "row").alias("name"), F.lit("place taken").alias("problem"))
    short = nets.groupBy("page", "net").agg(F.count("*").alias("n")).filter("n < 2").select("page", text("net"), F.lit("one port").alias("problem"))
    twice = nets.groupBy("page", "port").agg(F.count_distinct("net").alias("n")).filter("n > 1").select("page", text("port"), F.lit("in two nets").alias("problem"))
    lost = nets.join(parts.select("page", F.col("part").alias("port")), ["page", "port"], "left_anti").select("page", text("port"), F.lit("no part").alias("problem")).distinct()
    return taken.unionByName(short).unionByName(twice).unionByName(lost)


GATES = {"and": lambda a, b: a & b, "or": lambda a, b: a | b, "xor": lambda a, b: a ^ b, "nand": lambda a, b: 1 - (a & b), "nor": lambda a, b: 1 - (a | b), "xnor": lambda a, b: 1 - (a ^ b), "not": lambda a, b: 1 - a, "buffer": lambda a, b: a}


def settle(gates: list[dict], depth: int = 50) -> dict | None:
    """Values of all nodes of a circuit: dicts ``id, type, a, b, bit``; type ``in`` has its bit. None for a loop, a missing source or more than ``depth`` levels."""
    by_id, values = {g["id"]: g for g in gates}, {}

    def value(node, level: int) -> int:
        if node not in values:
            g = by_id[node]
            if level > depth:
                raise ValueError("a loop, or too deep")
            values[node] = int(g["bit"]) if g["type"] == "in" else GATES[g["type"]](value(g["a"], level + 1), value(g["b"], level + 1) if g["type"] not in ("not", "buffer") else 0)
        return values[node]

    try:
        for node in by_id:
            value(node, 0)
    except (KeyError, ValueError, TypeError):
        return None
    return values


def simulated(gates: DataFrame) -> DataFrame:
    """``gates(page, id, type, a, b, bit)`` -> ``page, id, value``: each circuit settled by itself; pages that can't be simulated give null."""

    def run(circuits: pd.Series) -> pd.Series:
        out = []
        for c in circuits:
            rows = list(c)
            got = settle(rows)
            out.append([{"id": g["id"], "value": got and got[g["id"]]} for g in rows])
        return pd.Series(out)

    run.__annotations__ = {"circuits": pd.Series, "return": pd.Series}
    udf = F.pandas_udf(run, "array<struct<id:long,value:int>>")
    one = gates.groupBy("page").agg(F.collect_list(F.struct(F.col("id").cast("long").alias("id"), "type", F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), F.col("bit").cast("int").alias("bit"))).alias("g"))
    return one.select("page", F.explode(udf("g")).alias("v")).select("page", "v.id", "v.value")


def covered(annotations: DataFrame, items: DataFrame) -> DataFrame:
    """``page, ann, leaf``: the items that an annotation's ``ref`` names; ``items(page, leaf, element, line_of, row)``.

    A reference is a leaf (or the item whose marker it is), an element, a line's
    item, or a table's row ``<table>.r<k>``: a union of equi-joins, not one
    join with alternatives.
    """
    refs = annotations.select("page", "ann", "ref")
    keys = [F.col("leaf"), F.regexp_extract("leaf", r"(?s)^(.*)\.marker$", 1), F.col("element"), F.col("line_of"), F.concat("element", F.lit(".r"), F.col("row").cast("string"))]
    names = items.select("page", "leaf", F.explode(F.array_distinct(F.filter(F.array(*keys), lambda k: k.isNotNull() & (k != "")))).alias("ref"))
    return refs.join(names, ["page", "ref"]).select("page", "ann", "leaf").distinct()


def same_names(left: DataFrame, right: DataFrame, name: str = "name") -> DataFrame:
    """Circuits and tables of a page with the same set of pin names: ``page, circuit, table`` of ``left(page, circuit, name)`` and ``right(page, table, name)``."""
    names = F.array_sort(F.collect_set(name)).alias("names")
    return left.groupBy("page", "circuit").agg(names).join(right.groupBy("page", "table").agg(names), ["page", "names"]).select("page", "circuit", "table")
