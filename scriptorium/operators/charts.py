"""Reading order of charts: depth-first from the nodes that nothing leads to, with the edges that lead back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_STATE = "struct<found:array<int>,stack:array<struct<node:int,next:int>>,back:array<struct<src:int,dst:int>>>"


def walked(outs: Column, roots: Column, steps: Column) -> Column:
    """``struct<found, stack, back>`` of a depth-first walk: ``outs`` lists the targets of nodes 0, 1, .., ``roots`` where to begin, in order.

    A fold with a stack: each step enters a node, follows one edge or leaves a node.
    """

    def state(found: Column, stack: Column, back: Column) -> Column:
        return F.struct(found.alias("found"), stack.alias("stack"), back.alias("back")).cast(_STATE)

    def step(s: Column, _: Column) -> Column:
        found, stack, back = s["found"], s["stack"], s["back"]
        top = F.element_at(stack, F.size(stack))
        below = F.slice(stack, F.lit(1), F.size(stack) - 1)
        targets = F.element_at(outs, top["node"] + 1)
        to = F.element_at(targets, top["next"] + 1)
        entered = lambda n: F.array(F.struct(n.alias("node"), F.lit(0).alias("next")))
        moved = F.concat(below, F.array(F.struct(top["node"].alias("node"), (top["next"] + 1).alias("next"))))
        root = F.get(F.filter(roots, lambda r: ~F.array_contains(found, r)), F.lit(0))
        return (
            F.when((F.size(stack) == 0) & root.isNull(), s)
            .when(F.size(stack) == 0, state(F.concat(found, F.array(root)), entered(root), back))
            .when(top["next"] >= F.size(targets), state(found, below, back))
            .when(F.array_contains(stack["node"], to), state(found, moved, F.array_union(back, F.array(F.struct(top["node"].alias("src"), to.alias("dst"))))))
            .when(F.array_contains(found, to), state(found, moved, back))
            .otherwise(state(F.concat(found, F.array(to)), F.concat(moved, entered(to)), back))
        )

    none = F.array()
    return F.aggregate(F.sequence(F.lit(1), F.greatest(steps, F.lit(1))), state(none, none, none), step)


def chart_order(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``nodes(chart, node, place)`` and ``edges(chart, at, src, dst)`` -> ``chart, nodes, back``.

    ``nodes`` lists a chart's nodes depth-first: from those without edges to
    them, then from what is left, both by place; edges are followed by ``at``.
    ``back`` holds the edges (``src, dst``) to a node that the walk is still in,
    loops included, once each.  Edges of unknown nodes go.  A chart is a row: it
    is what one page holds.
    """
    listed = nodes.groupBy("chart").agg(F.sort_array(F.collect_list(F.struct("place", "node"))).alias("n")).select("chart", F.col("n.node").alias("names"))
    lines = edges.groupBy("chart").agg(F.sort_array(F.collect_list(F.struct("at", "src", "dst"))).alias("edges"))
    rows = listed.join(lines, "chart", "left")
    at = lambda n: (F.array_position("names", n) - 1).cast("int")
    known = F.filter(F.coalesce("edges", F.array()), lambda e: F.array_contains("names", e["src"]) & F.array_contains("names", e["dst"]))
    rows = rows.withColumn("e", F.transform(known, lambda e: F.struct(at(e["src"]).alias("src"), at(e["dst"]).alias("dst"))))
    every = F.sequence(F.lit(0), F.size("names") - 1)
    rows = rows.withColumn("outs", F.transform(every, lambda n: F.transform(F.filter("e", lambda e: e["src"] == n), lambda e: e["dst"])))
    rows = rows.withColumn("roots", F.concat(F.filter(every, lambda n: ~F.array_contains(F.col("e.dst"), n)), every))
    rows = rows.withColumn("w", walked(F.col("outs"), F.col("roots"), 2 * F.size("names") + F.size("e")))
    name = lambda n: F.element_at("names", n + 1)
    back = F.transform("w.back", lambda b: F.struct(name(b["src"]).alias("src"), name(b["dst"]).alias("dst")))
    return rows.select("chart", F.transform("w.found", name).alias("nodes"), back.alias("back"))
