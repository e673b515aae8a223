"""Gates and schematic components: their ports and outlines as tables of pieces, brought to where they are placed.

Every placed symbol has a frame: an origin and vectors A, B, C, so that a piece's
point ``(a, b, c)`` lies at ``origin + a A + b B + c C``.  A gate's A is its width, B its
height to the right, C its height downward.  A component's A leads from its first
terminal to the second, B along it and C across it by the length of its body.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import cos, pi, sin

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, IntegerType, StringType, StructField, StructType

Piece = tuple[str, str, int, int, str, list[float]]
#: Columns with their types, and what makes them of the x and y of strokes alike: a row a stroke, a column a point.
Summary = tuple[list[tuple[str, DataType]], Callable[[np.ndarray, np.ndarray], list[np.ndarray]]]

# The symbols' names and proportions.
GATES = ("and2", "or2", "xor2", "nand2", "nor2", "xnor2", "not", "buf")
COMPONENTS = ("resistor", "capacitor", "inductor", "diode", "voltage_source", "current_source", "battery", "ground", "terminal")
BUBBLE, BULGE, BODY, BODY_SHARE = 0.07, 0.12, 30.0, 0.7
ONE_INPUT = ("not", "buf")
INVERTED = ("nand2", "nor2", "xnor2", "not")
ONE_PORT = ("ground", "terminal")
FRAME = ("ox", "oy", "ax", "ay", "bx", "by", "cx", "cy", "unit")
X_FRAME, Y_FRAME = (0, 2, 4, 6, 8), (1, 3, 5, 7, 8)
#: Symbols that a task draws at once.
ROWS = 1 << 13


def gate_ports(boxes: DataFrame) -> DataFrame:
    """``boxes(.., kind, l, t, r, b)`` with a row for each port: ``port, x, y``. Inputs lie on the left side, the output on the right; other kinds have none."""
    rows = []
    for kind in GATES:
        inputs = [("a", 0.5)] if kind in ONE_INPUT else [("a", 0.25), ("b", 0.75)]
        rows += [(kind, port, 0.0, down) for port, down in inputs] + [(kind, "y", 1.0, 0.5)]
    ports = boxes.sparkSession.createDataFrame(rows, "kind string, port string, along double, down double")
    at = lambda low, high, share: F.col(low) + F.col(share) * (F.col(high) - F.col(low))
    out = boxes.join(F.broadcast(ports), "kind")  # 22 rows, whatever the pages
    return out.withColumns({"x": at("l", "r", "along"), "y": at("t", "b", "down")}).drop("along", "down")


def component_ports(placed: DataFrame) -> DataFrame:
    """``placed(.., kind, ax, ay, bx, by)`` with a row for each terminal: ``port, x, y``; grounds and terminals have one."""
    both = F.array(F.struct(F.lit("a").alias("port"), F.col("ax").alias("x"), F.col("ay").alias("y")), F.struct(F.lit("b").alias("port"), F.col("bx").alias("x"), F.col("by").alias("y")))
    rows = placed.filter(F.col("kind").isin(*COMPONENTS)).withColumn("__p", F.explode(F.when(F.col("kind").isin(*ONE_PORT), F.slice(both, 1, 1)).otherwise(both)))
    return rows.select("*", "__p.*").drop("__p")


def _line(kind: str, part: str, stroke: int, *points: tuple[float, float, float], seq: int = 0) -> list[Piece]:
    return [(kind, part, stroke, seq + k, "point", list(p)) for k, p in enumerate(points)]


def _curve(kind: str, part: str, stroke: int, seq: int, ends: list[tuple[float, float, float]], skip: int = 0) -> list[Piece]:
    """A quadratic curve of 16 segments by three points; ``skip``: without its first point."""
    return [(kind, part, stroke, seq, "curve", [v for p in ends for v in p] + [float(skip)])]


def _arc(kind: str, part: str, stroke: int, seq: int, center: tuple[float, float, float], sine: tuple[float, float], cosine: tuple[float, float], sweep: float, n: int, skip: int = 0, form: str = "arc") -> list[Piece]:
    """``center + (B, C) . (sine sin + cosine cos)`` over ``sweep`` in n segments; a ``ring`` stands upright on the page however its symbol lies."""
    return [(kind, part, stroke, seq, form, [*center, *sine, *cosine, sweep, float(n), float(skip)])]


def gate_pieces() -> list[Piece]:
    out: list[Piece] = []
    for kind in GATES:
        inverted = kind in INVERTED
        end = -2 * BUBBLE if inverted else 0.0
        if kind in ("and2", "nand2"):
            out += _line(kind, "body", 0, (0, 0, 0), (1, end - 0.5, 0)) + _arc(kind, "body", 0, 2, (1, end - 0.5, 0.5), (0.5, 0), (0, -0.5), pi, 16)
            out += _line(kind, "body", 0, (0, 0, 1), (0, 0, 0), seq=3)
        elif kind in ONE_INPUT:
            out += _line(kind, "body", 0, (0, 0, 0), (1, end, 0.5), (0, 0, 1), (0, 0, 0))
        else:
            back = BULGE if kind in ("xor2", "xnor2") else 0.0
            top, bottom, tip, hollow = (back, 0, 0), (back, 0, 1), (1, end, 0.5), (back + 2 * BULGE, 0, 0.5)
            shoulder = lambda c: (back + 0.6 * (1 - back), 0.6 * end, c)
            out += _curve(kind, "body", 0, 0, [top, shoulder(0), tip]) + _curve(kind, "body", 0, 1, [tip, shoulder(1), bottom], 1) + _curve(kind, "body", 0, 2, [bottom, hollow, top], 1)
            if back:
                out += _curve(kind, "xor_curve", 0, 0, [(0, 0, 0), (2 * BULGE, 0, 0.5), (0, 0, 1)])
            for k, down in enumerate((0.25, 0.75)):  # from the ports to the hollow back
                out += _line(kind, "stubs", k, (0, 0, down), (back + 4 * down * (1 - down) * BULGE, 0, down))
        if inverted:
            out += _arc(kind, "bubble", 0, 0, (1, end + BUBBLE, 0.5), (-BUBBLE, 0), (0, -BUBBLE), 2 * pi, 12)
    return out


def component_pieces() -> list[Piece]:
    start, finish, begin, end = (0, 0, 0), (1, 0, 0), (0.5, -0.5, 0), (0.5, 0.5, 0)
    mid = lambda b, c=0.0: (0.5, b, c)
    zig = [mid(-0.5 + (k + 0.5) / 6, 0.17 * (-1) ** k) for k in range(6)]
    out = _line("resistor", "body", 0, start, begin, *zig, end, finish)
    for kind, short in (("capacitor", 0.225), ("battery", 0.1125)):
        out += _line(kind, "lead_a", 0, start, mid(-0.06)) + _line(kind, "body", 0, mid(-0.06, -0.225), mid(-0.06, 0.225))
        out += _line(kind, "body", 1, mid(0.06, -short), mid(0.06, short)) + _line(kind, "lead_b", 0, mid(0.06), finish)
    out += _line("inductor", "body", 0, start, begin)
    for k in range(4):
        out += _arc("inductor", "body", 0, 2 + k, mid(-0.5 + (2 * k + 1) / 8), (0, -0.2), (-0.125, 0), pi, 8, 1)
    out += _line("inductor", "body", 0, finish, seq=6)
    out += _line("diode", "lead_a", 0, start, mid(-0.35)) + _line("diode", "body", 0, mid(-0.35, -0.3), mid(-0.35, 0.3), mid(0.35), mid(-0.35, -0.3))
    out += _line("diode", "body", 1, mid(0.35, -0.3), mid(0.35, 0.3)) + _line("diode", "lead_b", 0, mid(0.35), finish)
    for kind in ("voltage_source", "current_source"):
        out += _line(kind, "lead_a", 0, start, mid(-0.5)) + _arc(kind, "body", 0, 0, mid(0), (-0.5, 0), (0, -0.5), 2 * pi, 28, form="ring") + _line(kind, "lead_b", 0, mid(0.5), finish)
    sign = [[mid(-0.25, -0.125), mid(-0.25, 0.125)], [mid(-0.375), mid(-0.125)], [mid(0.25, -0.125), mid(0.25, 0.125)]]
    arrow = [[mid(0.275), mid(-0.275)], [mid(-0.1, -0.15), mid(-0.275), mid(-0.1, 0.15)]]
    for kind, strokes in (("voltage_source", sign), ("current_source", arrow)):
        for k, points in enumerate(strokes):
            out += _line(kind, "sign", k, *points)
    out += _line("ground", "lead", 0, start, (0, 0, 8.0))
    for k, (half, down) in enumerate(((8.0, 8.0), (4.8, 11.2), (2.0, 14.4))):
        out += _line("ground", "body", k, (0, -half, down), (0, half, down))
    return out + _arc("terminal", "body", 0, 0, start, (-2.5, 0), (0, -2.5), 2 * pi, 12, form="ring")


def _traced(form: str, p: list[float]) -> list[tuple[float, ...]]:
    """Points ``(a, b, c)`` of a piece in any symbol's frame, and how far right and down of there by its unit."""
    if form == "point":
        return [(*p, 0.0, 0.0)]
    out = []
    for i in range(int(p[9]), 17 if form == "curve" else int(p[8]) + 1):
        if form == "curve":
            t = i / 16
            out.append((*((1 - t) * (1 - t) * p[k] + 2 * (1 - t) * t * p[3 + k] + t * t * p[6 + k] for k in range(3)), 0.0, 0.0))
            continue
        sine, cosine = sin(p[7] * i / p[8]), cos(p[7] * i / p[8])
        right, down = p[3] * sine + p[5] * cosine, p[4] * sine + p[6] * cosine
        out.append((*p[:3], right, down) if form == "ring" else (p[0], p[1] + right, p[2] + down, 0.0, 0.0))
    return out


def _drawings(pieces: list[Piece]) -> dict[str, list[tuple[str, int, np.ndarray, np.ndarray, np.ndarray]]]:
    """By kind, each stroke: part, number, its points' ``n``, and what their x and y take of a frame, a column each."""
    own: dict[tuple, list] = {}
    for kind, part, stroke, seq, form, p in pieces:
        own.setdefault((kind, part, stroke), []).append((seq, form, [float(v) for v in p]))
    out: dict[str, list] = {}
    for (kind, part, stroke), strokes in own.items():
        points = [(seq * 100 + k, *q) for seq, form, p in sorted(strokes) for k, q in enumerate(_traced(form, p))]
        n, a, b, c, right, down = (np.array(v) for v in zip(*points))
        x, y = (np.stack([np.ones(len(n)), a, b, c, by]) for by in (right, down))
        out.setdefault(kind, []).append((part, stroke, n.astype(np.int32), x, y))
    return out


def _strokes(framed: DataFrame, pieces: list[Piece], *keys: str, summary: Summary | None = None) -> DataFrame:
    """``*keys, kind, part, stroke, points array<struct<n, x, y>>``, or what ``summary`` makes of the points: symbols of a batch are drawn together.

    A point is a fixed sum of a symbol's frame, so that the points of a stroke are a
    product of matrices, and none is put together by a shuffle or a step for each.
    """
    drawings, names = _drawings(pieces), [*keys, "kind"]
    points = ArrayType(StructType([StructField("n", IntegerType()), StructField("x", DoubleType()), StructField("y", DoubleType())]))
    more, function = summary or ([("points", points)], None)
    fields = [StructField(n, framed.schema[n].dataType) for n in names]
    schema = StructType([*fields, StructField("part", StringType()), StructField("stroke", IntegerType()), *(StructField(*m) for m in more)])

    def column(values: np.ndarray, null: np.ndarray) -> pa.Array:
        """Values without what a null in a frame has made NaN."""
        return pa.array(values, mask=null & np.isnan(values) if null.any() and values.dtype.kind == "f" else None)

    def listed(n: np.ndarray, x: np.ndarray, y: np.ndarray, null: np.ndarray) -> pa.Array:
        lost = np.repeat(null, len(n))
        values = [pa.array(np.tile(n, len(x))), column(x.ravel(), lost), column(y.ravel(), lost)]
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(n)), pa.StructArray.from_arrays(values, names=["n", "x", "y"]))

    def drawn(some: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        columns = [some.column(k) for k in range(len(names), some.num_columns)]
        frame = np.stack([c.cast(pa.float64()).to_numpy(zero_copy_only=False) for c in columns], 1)
        nulls = np.any([c.is_null().to_numpy(zero_copy_only=False) for c in columns], 0)
        kinds, rows, parts, strokes, values = some.column(len(keys)).dictionary_encode(), [], [], [], []
        codes = kinds.indices.fill_null(-1).to_numpy()
        for code, kind in enumerate(kinds.dictionary.to_pylist()):
            at = np.flatnonzero(codes == code)
            in_x, in_y, null = frame[at][:, X_FRAME], frame[at][:, Y_FRAME], nulls[at]
            for part, stroke, n, of_x, of_y in drawings.get(kind, ()):
                x, y = in_x @ of_x, in_y @ of_y
                values.append([column(v, null) for v in function(x, y)] if function else [listed(n, x, y, null)])
                rows.append(at)
                parts += [part] * len(at)
                strokes.append(np.full(len(at), stroke, np.int32))
        if rows:
            own = pa.array(np.concatenate(rows))
            out = [some.column(k).take(own) for k in range(len(names))] + [pa.array(parts, pa.string()), pa.array(np.concatenate(strokes))]
            yield pa.RecordBatch.from_arrays(out + [pa.concat_arrays(v) for v in zip(*values)], names=schema.names)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, ROWS):
                yield from drawn(batch.slice(first, ROWS))

    return framed.select(*names, *FRAME).mapInArrow(draw, schema)


def _outlines(strokes: DataFrame, *keys: str) -> DataFrame:
    rows = strokes.select(*keys, "kind", "part", "stroke", F.explode("points").alias("at"))
    return rows.select(*keys, "kind", "part", "stroke", "at.n", "at.x", "at.y")


def gate_strokes(boxes: DataFrame, *keys: str, summary: Summary | None = None) -> DataFrame:
    """``boxes(*keys, kind, l, t, r, b)`` -> ``*keys, kind, part, stroke, points array<struct<n, x, y>>``: the strokes of each gate, points in order; with ``summary`` its columns instead of them."""
    w, h, none = F.col("r") - F.col("l"), F.col("b") - F.col("t"), F.lit(0.0)
    frame = {"ox": F.col("l"), "oy": F.col("t"), "ax": w, "ay": none, "bx": h, "by": none, "cx": none, "cy": h, "unit": h}
    return _strokes(boxes.select(*keys, "kind", *[c.alias(n) for n, c in frame.items()]), gate_pieces(), *keys, summary=summary)


def gate_outlines(boxes: DataFrame, *keys: str) -> DataFrame:
    """The points of ``gate_strokes`` as rows: ``*keys, kind, part, stroke, n, x, y``, in order of ``n`` in a stroke of a part."""
    return _outlines(gate_strokes(boxes, *keys), *keys)


def component_strokes(placed: DataFrame, *keys: str, summary: Summary | None = None) -> DataFrame:
    """``placed(*keys, kind, ax, ay, bx, by, size)`` -> strokes as in ``gate_strokes``.

    Bodies are 30 units long times ``size``, at most 0.7 of the way; grounds and
    terminals have no second end.  Other components without length raise.
    """
    dx, dy, single = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"), F.col("kind").isin(*ONE_PORT)
    length = F.sqrt(dx * dx + dy * dy)
    checked = F.when(~single & (length < 1e-6), F.raise_error(F.lit("a component has no length"))).otherwise(length)
    rows = placed.select("*", F.when(single, F.lit(1.0)).otherwise(checked).alias("__l"), F.when(single, F.lit(1.0)).otherwise(dx).alias("__x"), F.when(single, F.lit(0.0)).otherwise(dy).alias("__y"))
    unit = F.when(single, F.col("size")).otherwise(F.least(BODY * F.col("size"), BODY_SHARE * F.col("__l")))
    ux, uy = F.col("__x") / F.col("__l"), F.col("__y") / F.col("__l")
    frame = {"ox": F.col("ax"), "oy": F.col("ay"), "ax": F.col("__x"), "ay": F.col("__y"), "bx": ux * unit, "by": uy * unit, "cx": -uy * unit, "cy": ux * unit, "unit": unit}
    return _strokes(rows.select(*keys, "kind", *[c.alias(n) for n, c in frame.items()]), component_pieces(), *keys, summary=summary)


def component_outlines(placed: DataFrame, *keys: str) -> DataFrame:
    """The points of ``component_strokes`` as rows, as in ``gate_outlines``."""
    return _outlines(component_strokes(placed, *keys), *keys)
