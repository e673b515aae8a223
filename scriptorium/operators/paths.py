"""Stroke paths in long form: ``ink_id, stroke_id, point_id, x, y``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .lineage import dealt

#: Points of a task, about, where each becomes many samples.
TASK_ROWS = 200_000


def _stroke() -> WindowSpec:
    return Window.partitionBy("ink_id", "stroke_id").orderBy("point_id")


def _ink() -> WindowSpec:
    return Window.partitionBy("ink_id").orderBy("stroke_id", "point_id")


def _segments(points: DataFrame) -> DataFrame:
    """Each point with its predecessor in the stroke and the distance to it."""
    rows = points.withColumns({"px": F.lag("x").over(_stroke()), "py": F.lag("y").over(_stroke())})
    return rows.withColumn("d", F.coalesce(F.hypot(F.col("x") - F.col("px"), F.col("y") - F.col("py")), F.lit(0.0)))


def arc_length(points: DataFrame) -> DataFrame:
    """Add ``s``: the way along the stroke up to each point."""
    return _segments(points).withColumn("s", F.sum("d").over(_stroke().rowsBetween(Window.unboundedPreceding, 0))).drop("px", "py", "d")


def densify(points: DataFrame, step: float) -> DataFrame:
    """Points at most ``step`` apart: each segment in ceil(d / step) parts. Returns ``ink_id, stroke_id, point_id, part, x, y``."""
    rows = _segments(points).withColumn("n", F.greatest(F.ceil(F.col("d") / step), F.lit(1)).cast("int"))
    part = F.explode(F.when(F.col("px").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(1), F.col("n"))))
    rows = rows.select("*", part.alias("part"))
    on = lambda a, b: F.coalesce(F.col(a) + (F.col(b) - F.col(a)) * F.col("part") / F.col("n"), F.col(b))
    return rows.select("ink_id", "stroke_id", "point_id", "part", on("px", "x").alias("x"), on("py", "y").alias("y"))


def densified(strokes: Column, step: float) -> Column:
    """The points of ``densify`` for strokes given as arrays of points (x, y), as one array."""

    def between(a: Column, b: Column) -> Column:
        n = F.greatest(F.ceil(F.hypot(b["x"] - a["x"], b["y"] - a["y"]) / step), F.lit(1)).cast("int")
        on = lambda e, c, k: e["a"][c] + (e["b"][c] - e["a"][c]) * k / e["n"]
        # as a list of one, so that the parts are counted once
        return F.transform(F.array(F.struct(a.alias("a"), b.alias("b"), n.alias("n"))), lambda e: F.transform(F.sequence(F.lit(1), e["n"]), lambda k: F.struct(on(e, "x", k).alias("x"), on(e, "y", k).alias("y"))))[0]

    def stroke(s: Column) -> Column:
        later = F.flatten(F.transform(F.slice(s, F.lit(2), F.size(s)), lambda b, i: between(F.get(s, i), b)))
        return F.concat(F.slice(s, 1, 1), later)

    return F.flatten(F.transform(strokes, stroke))


def resample(points: DataFrame, spacing: float, *labels: str) -> DataFrame:
    """Points evenly spaced along each stroke, both ends kept: ``ink_id, stroke_id, sample, x, y``, and ``labels`` of the first point at or past each sample.

    The stroke is cut in ceil(length / spacing) equal parts. Samples
    are made segment by segment, each from the share of the way it covers, so
    no join is needed. A stroke without length is one point.
    """
    way = arc_length(points).withColumn("total", F.max("s").over(Window.partitionBy("ink_id", "stroke_id")))
    way = way.withColumn("n", F.ceil(F.col("total") / spacing).cast("int")).withColumn("gap", F.try_divide(F.col("total"), F.col("n")))
    way = way.withColumns({"px": F.lag("x").over(_stroke()), "py": F.lag("y").over(_stroke()), "ps": F.lag("s").over(_stroke()), "end": F.lead("s").over(_stroke()).isNull()})
    # samples k with ps < k * gap <= s; the first point is sample 0, the last point sample n
    part = lambda c: F.floor(F.try_divide(F.col(c), F.col("gap")))
    low, high = part("ps") + 1, F.when(F.col("s") == F.col("total"), F.col("n")).otherwise(part("s"))
    low = F.when(F.col("ps") == F.col("total"), F.col("n") + 1).otherwise(low)
    inner = F.when((F.col("s") > F.col("ps")) & (high >= low), F.sequence(low.cast("int"), high.cast("int"))).otherwise(F.array().cast("array<int>"))
    rows = way.select("*", F.explode(F.when(F.col("ps").isNull(), F.array(F.lit(0))).otherwise(inner)).alias("sample"))
    share = F.try_divide(F.col("sample") * F.col("gap") - F.col("ps"), F.col("s") - F.col("ps"))
    at = lambda a, b: F.when(F.col("ps").isNull() | ((F.col("sample") == F.col("n")) & (F.col("s") == F.col("total"))), F.col(b)).otherwise(F.col(a) + (F.col(b) - F.col(a)) * share)
    return rows.select("ink_id", "stroke_id", "sample", at("px", "x").alias("x"), at("py", "y").alias("y"), *labels)


def shared_counts(sizes: Column, n: int) -> Column:
    """How many of ``n`` points each stroke gets: its share of all points, rounded half to even, and one at least; the first largest gives or takes until the sum is n (or the number of strokes, if that is more)."""
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda acc, v: acc + v)
    want = F.greatest(F.lit(n).cast("long"), F.size(sizes).cast("long"))
    start = F.transform(sizes, lambda k: F.greatest(F.lit(1).cast("long"), F.bround(k * want / total(sizes)).cast("long")))
    off = want - total(start)

    def step(counts: Column, i: Column) -> Column:
        top = F.array_position(counts, F.array_max(counts)) - 1
        return F.transform(counts, lambda c, k: F.when(k == top, c + F.signum(off).cast("long")).otherwise(c))

    times = F.when(off == 0, F.array().cast("array<long>")).otherwise(F.sequence(F.lit(1).cast("long"), F.abs(off)))
    return F.aggregate(times, start, step)


def resample_to(strokes: Column, n: int) -> Column:
    """Strokes (arrays of points x, y) drawn with ``n`` points in all, evenly by index; each point has ``label``, the index of the nearest old point, halves to even."""
    counts = shared_counts(F.transform(strokes, lambda s: F.size(s).cast("long")), n)

    def point(s: Column, m: Column, i: Column) -> Column:
        t = F.when(m == 1, F.lit(0.0)).otherwise(i * (F.size(s) - 1) / (m - 1))
        low = F.least(F.floor(t), F.size(s).cast("long") - 1).cast("int")
        a, b = F.get(s, low), F.get(s, F.least(low + 1, F.size(s) - 1))
        on = lambda c: a[c] + (b[c] - a[c]) * (t - low)
        return F.struct(on("x").alias("x"), on("y").alias("y"), F.bround(t).cast("int").alias("label"))

    stroke = lambda z: F.transform(F.sequence(F.lit(0).cast("long"), z["m"] - 1), lambda i: point(z["s"], z["m"], i))
    return F.transform(F.arrays_zip(strokes.alias("s"), counts.alias("m")), stroke)


def to_offsets(points: DataFrame) -> DataFrame:
    """Positions as ``dx, dy, eos`` in writing order; the first is at the origin, each stroke's last point ends it."""
    d = lambda c: F.coalesce(F.col(c) - F.lag(c).over(_ink()), F.lit(0.0))
    return points.withColumns({"dx": d("x"), "dy": d("y"), "eos": F.lead("x").over(_stroke()).isNull()}).drop("x", "y")


def to_positions(offsets: DataFrame) -> DataFrame:
    """The reverse, from the origin."""
    upto = _ink().rowsBetween(Window.unboundedPreceding, 0)
    return offsets.withColumns({"x": F.sum("dx").over(upto), "y": F.sum("dy").over(upto)}).drop("dx", "dy")


def stroke_numbers(offsets: DataFrame, order: str = "point_id") -> DataFrame:
    """Add ``stroke``: how many strokes have ended before each point; the flags alone say so."""
    w = Window.partitionBy("ink_id").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return offsets.withColumn("stroke", F.coalesce(F.sum(F.col("eos").cast("int")).over(w), F.lit(0)))


def unit_scale(points: DataFrame) -> DataFrame:
    """``ink_id, unit``: the median over strokes of their longer side; null (unusable) unless positive."""
    size = points.groupBy("ink_id", "stroke_id").agg(F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y")).alias("side"))
    return size.groupBy("ink_id").agg(F.median("side").alias("unit")).withColumn("unit", F.when(F.col("unit") > 0, F.col("unit")))


def centred(points: DataFrame, least: float = 1e-6) -> DataFrame:
    """Points centred on their ink's mean and divided by its height; ``pen`` is 1 at a stroke's end, else -1."""
    w = Window.partitionBy("ink_id")
    h = F.greatest(F.max("y").over(w) - F.min("y").over(w), F.lit(least))
    pen = F.when(F.lead("x").over(_stroke()).isNull(), 1).otherwise(-1)
    return points.select("ink_id", "stroke_id", "point_id", ((F.col("x") - F.avg("x").over(w)) / h).alias("x"), ((F.col("y") - F.avg("y").over(w)) / h).alias("y"), pen.alias("pen"))


def to_line(points: DataFrame) -> DataFrame:
    """Points moved so that the least x and the second percentile of y are 0."""
    base = points.groupBy("ink_id").agg(F.min("x").alias("x0"), F.percentile("y", 0.02).alias("y0"))
    return points.join(base, "ink_id").withColumns({"x": F.col("x") - F.col("x0"), "y": F.col("y") - F.col("y0")}).drop("x0", "y0")


def line_scale(height: float) -> Column:
    """Scale that makes the middle 96 % of y ``height`` high; an aggregate."""
    p = F.percentile("y", F.array(F.lit(0.02), F.lit(0.98)))
    return F.lit(height) / (p[1] - p[0])


def subsample(points: Column, most: int) -> Column:
    """At most ``most`` elements of an array at even steps, first and last kept."""
    at = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.bround(i * (F.size(points) - 1) / (most - 1)).cast("int"))
    return F.when(F.size(points) <= most, points).otherwise(F.transform(at, lambda i: F.get(points, i)))


def extent(points: DataFrame) -> DataFrame:
    return points.groupBy("ink_id").agg((F.max("x") - F.min("x")).alias("width"), (F.max("y") - F.min("y")).alias("height"))


def curvature_mean(c: str, by: str, order: str, reach: int = 3) -> Column:
    """Moving sum over ``reach`` neighbours on each side, always divided by the full width."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(-reach, reach)
    return F.sum(c).over(w) / (2 * reach + 1)


def to_spacing(points: DataFrame, scale: float, spacing: float) -> DataFrame:
    """Ink in another unit and sampling: positions times ``scale``, each stroke resampled, as offsets ``ink_id, stroke_id, point_id, dx, dy, eos``."""
    small = points.withColumns({c: F.col(c) * scale for c in "xy"})
    return to_offsets(resample(small, spacing).withColumnRenamed("sample", "point_id"))


def plausible(points: DataFrame, labels: DataFrame, height: float = 1200, narrow: float = 60, wide: float = 400) -> DataFrame:
    """The ``ink_id`` of inks that can be their label: ``labels(ink_id, label)``.

    Two points or more; the 2nd to 98th percentile of y less than ``height``
    apart; a width between ``narrow`` and ``wide`` for each character, ends
    excluded; no fewer strokes than words.
    """
    size = points.groupBy("ink_id").agg(
        F.count("*").alias("n"), (F.percentile("y", 0.98) - F.percentile("y", 0.02)).alias("tall"), (F.max("x") - F.min("x")).alias("width"), F.count_distinct("stroke_id").alias("strokes")
    )
    words = F.size(F.filter(F.split("label", r"\s+"), lambda x: x != ""))
    rows = size.join(labels, "ink_id").withColumn("each", F.col("width") / F.greatest(F.length("label"), F.lit(1)))
    return rows.filter((F.col("n") >= 2) & (F.col("tall") < height) & (F.col("each") > narrow) & (F.col("each") < wide) & (F.col("strokes") >= words)).select("ink_id")


def trimmed(points: DataFrame) -> DataFrame:
    """Points whose ``char`` says the character they belong to, of a text of ``n`` characters: ``.., char, eos``.

    Strokes at the end that begin past the text go; characters are clipped to
    the text; the last point that stays ends a stroke.
    """
    first = F.first_value("char").over(_stroke())
    later = Window.partitionBy("ink_id").orderBy("stroke_id").rangeBetween(Window.currentRow, Window.unboundedFollowing)
    rows = points.withColumn("__past", first >= F.col("n")).withColumn("__cut", F.min("__past").over(later)).filter(~F.col("__cut"))
    last = F.lead("point_id").over(_ink()).isNull()
    ends = F.lead("point_id").over(_stroke()).isNull()
    return rows.withColumns({"char": F.greatest(F.least("char", F.col("n") - 1), F.lit(0)), "eos": last | ends}).drop("__past", "__cut")


def timed(points: DataFrame, rate: float, short: float = 0.002) -> DataFrame:
    """Strokes written at ``speed`` (a column at each point) and sampled at ``rate`` a second: ``ink_id, stroke_id, sample, x, y, t``.

    A segment takes its length by the mean speed of its ends.  Samples are at
    k / rate before the stroke's end, and at its end; the last but one goes
    where it is within ``short`` of the end.  A point is between the two that
    its time is between.
    """
    w = _stroke()
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    way = _segments(dealt(points, TASK_ROWS, "ink_id", "stroke_id")).withColumn("t", F.sum(F.coalesce(F.col("d") / ((F.col("speed") + F.lag("speed").over(w)) / 2), F.lit(0.0))).over(upto))
    way = way.withColumns({"pt": F.lag("t").over(w), "end": F.max("t").over(Window.partitionBy("ink_id", "stroke_id")), "first": F.row_number().over(w) == 2, "last": F.lead("t").over(w).isNull()})
    k = F.sequence(F.greatest(F.floor(F.col("pt") * rate) - 1, F.lit(0)), F.ceil(F.col("t") * rate) + 1)
    # the sample at the end, number -1, is made with the others, so that a stroke's rows stay where they are
    none, ends = F.array().cast("array<bigint>"), F.col("k") == -1
    ks = F.concat(F.when(F.col("pt").isNull(), none).otherwise(k), F.when(F.col("last"), F.array(F.lit(-1).cast("long"))).otherwise(none))
    at = way.withColumn("k", F.explode(ks)).withColumn("at", F.col("k") / F.lit(float(rate)))
    n = F.ceil(F.col("end") * rate)
    dropped = (n > 1) & (F.col("k") == n - 1) & (F.col("end") - F.col("at") < short)
    at = at.filter(ends | ((F.col("at") > F.col("pt")) | (F.col("first") & (F.col("k") == 0))) & (F.col("at") <= F.col("t")) & (F.col("k") < n) & ~dropped)
    share = F.coalesce(F.try_divide(F.col("at") - F.col("pt"), F.col("t") - F.col("pt")), F.lit(0.0))
    place = lambda c: F.col(f"p{c}") + share * (F.col(c) - F.col(f"p{c}"))
    rows = at.select("ink_id", "stroke_id", *[F.when(ends, F.col(c)).otherwise(place(c)).alias(c) for c in "xy"], F.when(ends, F.col("end")).otherwise(F.col("at")).alias("t"))
    number = F.row_number().over(Window.partitionBy("ink_id", "stroke_id").orderBy("t")) - 1
    return rows.withColumn("sample", number).select("ink_id", "stroke_id", "sample", "x", "y", "t")


def strictly_rising(rows: DataFrame, t: str, by: str, order: str, gap: Column | float, out: str = "t_fixed") -> DataFrame:
    """Add ``out``: times at least ``gap`` after one another, by the running maximum of t - gap * i."""
    w = Window.partitionBy(by).orderBy(order)
    rows = rows.withColumn("__i", F.row_number().over(w) - 1)
    low = F.max(F.col(t) - F.col("__i") * gap).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn(out, low + F.col("__i") * gap).drop("__i")
