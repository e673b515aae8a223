"""Writing order: runs, targets, clocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut


def islands(rows: DataFrame, by: str, order: str, holds: Column) -> DataFrame:
    """Add ``island``: the number of the run of consecutive rows for which ``holds`` is true or false."""
    w = Window.partitionBy(by).orderBy(order)
    rows = rows.withColumn("__h", F.coalesce(holds, F.lit(False)))
    change = (F.col("__h") != F.coalesce(F.lag("__h").over(w), ~F.col("__h"))).cast("int")
    return rows.withColumn("__c", change).withColumn("island", F.sum("__c").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumnRenamed("__h", "in_run").drop("__c")


def run_targets(rows: DataFrame, by: str, order: str, member: Column) -> DataFrame:
    """Completion targets at the starts of runs: ``by, after, first, last, n``; what stands before a run is its context.

    A run at the very start has no context and gives no target.
    """
    runs = islands(rows, by, order, member).groupBy(by, "island", "in_run").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n"))
    w = Window.partitionBy(by).orderBy("island")
    return runs.withColumn("after", F.lag("last").over(w)).filter("in_run and after is not null").select(by, "after", "first", "last", "n")


def counts_up(texts: DataFrame, by: str, order: str, text: str = "text") -> DataFrame:
    """``by, up``: whether the texts are prefix, whole number and suffix with one non-zero step, three at least."""
    part = lambda k: F.regexp_extract(text, r"^(\D*)(\d+)(\D*)$", k)
    w = Window.partitionBy(by).orderBy(order)
    rows = texts.withColumns({"__p": part(1), "__n": F.expr(f"try_cast(regexp_extract({text}, '^(\\\\D*)(\\\\d+)(\\\\D*)$', 2) as long)"), "__s": part(3)})
    rows = rows.withColumn("__d", F.col("__n") - F.lag("__n").over(w))
    fixed = (F.count("*") >= 3) & (F.count("__n") == F.count("*")) & (F.count_distinct("__p") == 1) & (F.count_distinct("__s") == 1)
    return rows.groupBy(by).agg((fixed & (F.count_distinct("__d") == 1) & (F.max("__d") != 0)).alias("up"))


def until(rows: DataFrame, t: str, end: float) -> DataFrame:
    """What was written up to a time."""
    return rows.filter(F.col(t) <= end)


def trace_numbers(traces: DataFrame, by: str, t: str, *ties: str) -> DataFrame:
    """Add ``trace``: places in order of start time across writers."""
    return traces.withColumn("trace", F.row_number().over(Window.partitionBy(by).orderBy(t, *ties)) - 1)


def resolved(targets: DataFrame, spans: DataFrame) -> DataFrame:
    """``targets(id, after, item)`` with ``spans(item, t0, t1)``: ``id, context_end, first_start``; only targets all of whose ink starts after the context ends."""
    end = spans.select(F.col("item").alias("after"), F.col("t1").alias("context_end"))
    rows = targets.join(end, "after").join(spans.select("item", "t0"), "item")
    return rows.groupBy("id", "context_end").agg(F.min("t0").alias("first_start")).filter("first_start > context_end")


def closure(edges: DataFrame, most: int = 50) -> DataFrame:
    """All (src, dst) reachable in ``edges(src, dst)``, by doubling paths until nothing is new; cycles end it too.

    Raises RuntimeError if that takes over ``most`` rounds, which would be paths of over 2 ** ``most`` edges.
    """
    now = cut(edges.select("src", "dst").distinct())
    seen = now.count()
    for _ in range(most):
        now = cut(now.unionByName(now.alias("a").join(now.alias("b"), F.col("a.dst") == F.col("b.src")).select("a.src", "b.dst")).distinct())
        n = now.count()
        if n == seen:
            return now
        seen = n
    raise RuntimeError("the closure isn't complete")


def clocked(items: DataFrame, writers: DataFrame, pause: float) -> DataFrame:
    """When each item is written: ``items(page, item, writer, pos, length)`` in writing order and ``writers(page, writer, start_after)`` -> ``page, item, writer, start, end, trace``.

    A writer writes item after item with a pause between, from time 0, or from
    a pause after the end of the other writer's item ``start_after``.  ``trace``
    numbers the items of a page by start, ties by ``pos``, so writers interleave.
    Writers that wait for each other in a circle have no times, and their items go.
    """
    w = Window.partitionBy("page", "writer").orderBy("pos")
    own = items.withColumn("__before", F.coalesce(F.sum(F.col("length") + pause).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    ends = own.select("page", F.col("item").alias("start_after"), F.col("writer").alias("__of"), (F.col("__before") + F.col("length")).alias("__at"))
    waits = writers.join(ends, ["page", "start_after"], "left")
    known = cut(waits.filter("start_after is null").select("page", "writer", F.lit(0.0).alias("__base")))
    open_ = cut(waits.filter("start_after is not null and __of is not null").select("page", "writer", "__of", "__at"))
    while True:  # as many rounds as writers wait in a row
        more = open_.join(known.select("page", F.col("writer").alias("__of"), "__base"), ["page", "__of"]).select("page", "writer", (F.col("__base") + F.col("__at") + pause).alias("__base"))
        more = cut(more)
        if more.isEmpty():
            break
        known = cut(known.unionByName(more))
        open_ = cut(open_.join(more, ["page", "writer"], "left_anti"))
    timed = own.join(known, ["page", "writer"]).withColumn("start", F.col("__base") + F.col("__before")).withColumn("end", F.col("start") + F.col("length"))
    trace = F.row_number().over(Window.partitionBy("page").orderBy("start", "pos")) - 1
    return timed.withColumn("trace", trace).select("page", "item", "writer", "start", "end", "trace")
