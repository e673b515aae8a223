"""Completion targets: what the structure of a page says should come next, once it is written up to an item.

Items are rows ``page, pos, leaf`` in writing order; targets are rows
``page, kind, element, after, after_pos, target``, leaves in writing order.
A page's items are few, so a page's lists stay small.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The two labels of a decision, each with the one that goes with it.
OTHER_LABEL = {"yes": "no", "no": "yes", "y": "n", "n": "y", "true": "false", "false": "true", "t": "f", "f": "t", "1": "0", "0": "1", "ok": "fail", "fail": "ok", "pass": "fail"}


def _in_order(leaf: str = "leaf", pos: str = "pos") -> Column:
    return F.transform(F.sort_array(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(leaf).alias("x")))), lambda s: s["x"])


def _target(kind: str, element: Column, after: Column, after_pos: Column, target: Column) -> list[Column]:
    return ["page", F.lit(kind).alias("kind"), element.alias("element"), after.alias("after"), after_pos.alias("after_pos"), target.alias("target")]


def runs(items: DataFrame, key: str, *first: str) -> DataFrame:
    """Neighbouring items of a page with one key that isn't null: ``page, key, start, n, leaves, before``, and of the run's first item the columns ``first``.

    ``before`` is (pos, leaf) of what stands in front of the run, null at the page's start.
    """
    w = Window.partitionBy("page").orderBy("pos")
    new = F.lag("pos").over(w).isNull() | ~F.col(key).eqNullSafe(F.lag(key).over(w))
    rows = items.withColumns({"__new": new.cast("int"), "__before": F.lag(F.struct("pos", "leaf")).over(w)})
    rows = rows.withColumn("__run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).filter(F.col(key).isNotNull())
    of_first = [F.min_by(c, "pos").alias(c) for c in first]
    out = rows.groupBy("page", key, "__run").agg(F.min("pos").alias("start"), F.count("*").alias("n"), _in_order().alias("leaves"), F.min_by("__before", "pos").alias("before"), *of_first)
    return out.drop("__run")


def table_inputs(items: DataFrame, key: str = "table", inputs_per_row: str = "n_in") -> DataFrame:
    """Input cells of counting tables, once two rows of them are written; ``key`` is null for any other item.

    Adds ``span``: the next run, and all that remain if those are more.
    """
    own = Window.partitionBy("page", key).orderBy("start")
    # runs follow one another, so what a run has before and after it is other runs
    written = F.coalesce(F.sum("n").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.array_compact(F.flatten(F.collect_list("leaves").over(own.rowsBetween(0, Window.unboundedFollowing))))
    due = runs(items, key, inputs_per_row).withColumns({"written": written, "rest": rest}).filter(F.col("before").isNotNull() & (F.col("written") >= 2 * F.col(inputs_per_row)))
    spans = [F.struct(F.lit("next").alias("span"), F.col("leaves").alias("target")), F.when(F.size("rest") > F.col("n"), F.struct(F.lit("remaining").alias("span"), F.col("rest").alias("target")))]
    due = due.withColumn("s", F.explode(F.array_compact(F.array(*spans))))
    return due.select(*_target("truth_table_inputs", F.col(key), F.col("before.leaf"), F.col("before.pos"), F.col("s.target")), "s.span")


def table_outputs(items: DataFrame, definitions: DataFrame, key: str = "column") -> DataFrame:
    """Runs of an output column's cells, once what defines it is begun: ``definitions(page, <key>, defined)`` holds the first position of that."""
    due = runs(items, key).join(definitions, ["page", key]).filter(F.col("before.pos") >= F.col("defined"))
    return due.select(*_target("truth_table_outputs", F.col(key), F.col("before.leaf"), F.col("before.pos"), F.col("leaves")))


def table_rules(items: DataFrame, key: str = "table") -> DataFrame:
    """The rules drawn straight after a table's first rule; ``key`` is null for items that are no rules."""
    first = Window.partitionBy("page", key).orderBy("start")
    rows = runs(items, key).withColumn("__k", F.row_number().over(first)).filter("__k = 1 and n > 1")
    return rows.select(*_target("table_rules", F.col(key), F.get("leaves", F.lit(0)), F.col("start"), F.slice("leaves", 2, F.col("n").cast("int"))))


def header_sequences(cells: DataFrame, counting: DataFrame) -> DataFrame:
    """``cells(page, element, pos, leaf)`` of headers that count up, ``counting(page, element)``: what is left after each written cell but the first and the last."""
    every = F.sort_array(F.collect_list(F.struct("pos", "leaf"))).alias("every")
    lists = cells.join(counting, ["page", "element"], "left_semi").groupBy("page", "element").agg(every)
    rows = lists.select("page", "element", "every", F.posexplode("every").alias("k", "cell")).filter("k > 0").select("page", "element", "cell.pos", "cell.leaf", F.slice("every", F.col("k") + 2, F.size("every")).alias("after"))
    rows = rows.withColumn("rest", F.array_compact(F.col("after.leaf"))).filter(F.size("rest") > 0)
    return rows.select(*_target("header_sequence", F.col("element"), F.col("leaf"), F.col("pos"), F.col("rest")))


def list_markers(markers: DataFrame, texts: DataFrame) -> DataFrame:
    """The next marker of a numbered list after an item's last line; the first item gives none.

    ``markers(page, element, index, pos, leaf)``, ``texts(page, element, index, pos, leaf)``; lines written after the next marker don't count.
    """
    w = Window.partitionBy("page", "element").orderBy("index")
    following = F.lead(F.struct(F.col("pos").alias("next_pos"), F.col("leaf").alias("next"))).over(w)
    due = markers.withColumns({"k": F.row_number().over(w), "f": following}).filter("k > 1 and f is not null").select("page", "element", "index", "f.*")
    lines = due.join(texts, ["page", "element", "index"]).filter("pos < next_pos")
    last = lines.groupBy("page", "element", "index").agg(F.max_by("leaf", "pos").alias("after"), F.max("pos").alias("after_pos"), F.first("next").alias("next"))
    return last.select(*_target("list_marker", F.col("element"), F.col("after"), F.col("after_pos"), F.array("next")))


def branch_labels(edges: DataFrame) -> DataFrame:
    """The other label of a two-way decision: ``edges(page, node, edge, label, pos, leaf)`` out of decisions, by number; ``pos`` is null where the label isn't drawn."""
    other = F.create_map(*[F.lit(x) for pair in OTHER_LABEL.items() for x in pair])
    label = F.lower(F.trim(F.coalesce("label", F.lit("")))).alias("label")
    ways = edges.groupBy("page", "node").agg(F.sort_array(F.collect_list(F.struct("edge", label, "pos", "leaf"))).alias("w")).filter(F.size("w") == 2)
    ways = ways.filter(F.try_element_at(other, F.col("w")[0]["label"]) == F.col("w")[1]["label"]).filter(~F.exists("w", lambda e: e["pos"].isNull()))
    a, b = (F.array_sort(F.transform("w", lambda e: F.struct(e["pos"].alias("pos"), e["leaf"].alias("leaf"))))[k] for k in (0, 1))
    return ways.select(*_target("branch_label", F.col("node"), a["leaf"], a["pos"], F.array(b["leaf"])))


def node_outlines(boxes: DataFrame, texts: DataFrame) -> DataFrame:
    """The outline of a node all of whose text is written first: ``boxes(page, node, pos, leaf)``, ``texts(page, node, pos, leaf)``."""
    last = texts.groupBy("page", "node").agg(F.max("pos").alias("after_pos"), F.max_by("leaf", "pos").alias("after"))
    return boxes.join(last, ["page", "node"]).filter("after_pos < pos").select(*_target("node_outline", F.col("node"), F.col("after"), F.col("after_pos"), F.array("leaf")))


def numbered(*targets: DataFrame) -> DataFrame:
    """All targets with ``id``: ``tgt_0`` and on by page, in the order of element, kind and place."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), targets)
    w = Window.partitionBy("page").orderBy("element", "kind", "after_pos", F.size("target"))
    return rows.withColumn("id", F.concat(F.lit("tgt_"), (F.row_number().over(w) - 1).cast("string")))
