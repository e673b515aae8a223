"""Connected components over an edge table, without collecting anything."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT_SHARE, drop_table, join_hot, table_written

#: Edges of a node up to which no join treats it as a hub.
HUB_EDGES = 1000


def _measured(edges: DataFrame) -> tuple[int, int, int]:
    """Number of edges, a sum of their hashes, and the most edges of a node."""
    ends = edges.select(F.xxhash64("u", "v").cast("decimal(38,0)").alias("h"), F.explode(F.array("u", "v")).alias("x"))
    found = ends.groupBy("x").agg(F.count("*").alias("n"), F.sum("h").alias("h")).agg(F.sum("n"), F.sum("h"), F.max("n")).first()
    return (found[0] or 0) // 2, int(found[1] or 0), found[2] or 0


def _joined(rows: DataFrame, least: DataFrame, total: int, most: int) -> DataFrame:
    """``rows`` with the ``m`` of their ``u``; where a node is a hub, its rows stay where they are."""
    if most > HUB_EDGES and most * HOT_SHARE > total:
        return join_hot(rows, least, ["u"], total)
    # a merge join, as many small broadcasts would pile up in the driver
    return rows.join(least.drop("n").hint("merge"), "u")


def _large_star(edges: DataFrame, total: int, most: int) -> DataFrame:
    """Larger neighbours of each node move to its least one. ``total``: edges, ``most``: of one node."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count_if(F.col("v") > F.col("u")).alias("n"))
    moved = _joined(both.filter("v > u"), least, total, most)
    return moved.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()


def _small_star(edges: DataFrame, total: int, most: int) -> DataFrame:
    """Smaller neighbours of each node, and itself, move to its least one."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    across = _joined(down, least, total, most).filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return across.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``edges(u long, v long)`` -> ``(node long, root long)``: each node that has a link, with the smallest node it reaches, itself left out.

    Large-star and small-star steps alternate until the edges stand still; each
    step is a table in the shared folder.  Edges of hubs aren't shuffled by
    their hub.  Self-links, repeated links and nulls have no effect; no edges
    give an empty table.
    """
    now = edges.filter("u is not null and v is not null and u != v")
    now = table_written(now.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = None
    while True:
        n, mark, most = _measured(now)
        if n == 0 or (n, mark) == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = n, mark
        large = table_written(_large_star(now, n, most), "edges")
        drop_table(now)
        n, _, most = _measured(large)
        now = table_written(_small_star(large, n, most), "edges")
        drop_table(large)
