"""Places in a global order, without sorting everything in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut


def ranked(rows: DataFrame, order: list[str], by: str | None = None, out: str = "rank", size: str | None = None) -> DataFrame:
    """Add ``out``: the place of each row from 0 in the order of the columns ``order``, within its ``by`` if named; ``size`` adds how many rows are ordered.

    Rows are dealt by ranges of the order and numbered where they lie; sums of
    the ranges' sizes, a row for each, say where a range begins.  A group is
    spread over as many ranges as it fills, and joined with where it began by
    range and group, so that no task sees a large one whole.  Rows that tie in
    all columns are in any order; an empty table gives an empty one.
    """
    keys = [*([by] if by else []), *order]
    # the ranges are kept, as they are drawn anew whenever they are computed; the number holds a row's range and its place there
    placed = cut(rows.repartitionByRange(*keys).sortWithinPartitions(*keys)).withColumn("__id", F.monotonically_increasing_id())
    placed = placed.withColumn("__range", F.shiftright("__id", 33))
    ranges = placed.groupBy("__range").agg(F.count("*").alias("__n"))
    ranges = ranges.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    numbered = placed.join(F.broadcast(ranges.drop("__n")), "__range").withColumn(out, F.col("__before") + inside).drop("__id", "__before")
    if by is None:
        numbered = numbered.drop("__range")
        return numbered.crossJoin(F.broadcast(placed.agg(F.count("*").alias(size)))) if size else numbered
    parts = numbered.groupBy("__range", F.col(by).alias("__by")).agg(F.min(out).alias("__least"), F.count("*").alias("__n"))
    groups = parts.groupBy(F.col("__by").alias("__g")).agg(F.min("__least").alias("__first"), F.sum("__n").alias(size or "__size"))
    parts = parts.join(groups, parts["__by"].eqNullSafe(groups["__g"])).drop("__g", "__least", "__n").withColumnRenamed("__range", "__r")
    joined = numbered.join(parts, (F.col("__range") == F.col("__r")) & numbered[by].eqNullSafe(parts["__by"])).withColumn(out, F.col(out) - F.col("__first"))
    return joined.drop("__by", "__first", "__size", "__range", "__r")


def middle(rows: DataFrame, column: str) -> DataFrame:
    """A row with the median of ``column``, as ``F.median`` has it, exactly; ``rows`` are read four times.

    Sketched bounds around the middle are counted out, and only what lies between
    them is ordered, by ranges; were they to miss the middle, all would be.
    """
    own = rows.select(column).filter(F.col(column).isNotNull())
    (low, high), n = own.agg(F.percentile_approx(column, [0.499, 0.501], 10_000), F.count("*")).first() if own.limit(1).count() else ((None, None), 0)
    band = F.col(column).between(F.lit(low), F.lit(high))
    below, within = own.agg(F.count_if(F.col(column) < F.lit(low)), F.count_if(band)).first()
    first, last = (n - 1) // 2, n // 2
    if below <= first and last < below + within:
        own, first, last = own.filter(band), first - below, last - below
    own = own.withColumn("__tie", F.monotonically_increasing_id())  # equal values may lie in many ranges
    return ranked(own, [column, "__tie"], out="__at").filter(F.col("__at").isin(first, last)).agg(F.avg(column).alias(column))
