"""Targets, diagram rules and changes by chance against small cases and plain loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptorium.functions import geometry as g
from scriptorium.operators import augment, diagrams, evaluation, paths, splines, targets, validation


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_table_inputs(spark):
    order = "xaabaaxaa"  # a: input cells of one table
    items = spark.createDataFrame([(1, i, f"l{i}", "a" if c == "a" else None, 1) for i, c in enumerate(order)], "page int, pos int, leaf string, table string, n_in int")
    got = rows_of(targets.table_inputs(items), "after", "span", "target")
    assert got == [("l3", "next", ["l4", "l5"]), ("l3", "remaining", ["l4", "l5", "l7", "l8"]), ("l6", "next", ["l7", "l8"])]
    rules = rows_of(targets.table_rules(items.filter("pos < 6")), "after", "target")
    assert rules == [("l1", ["l2"])]


def test_run_at_page_start_has_no_context(spark):
    items = spark.createDataFrame([(1, 0, "a", "t"), (1, 1, "b", "t"), (2, 0, "c", None)], "page int, pos int, leaf string, table string")
    assert [r.before for r in targets.runs(items, "table").collect()] == [None]


def test_branch_labels(spark):
    rows = [(1, "d", 1, "Yes", 4, "y"), (1, "d", 2, " no", 2, "n"), (1, "e", 1, "fail", 0, "a"), (1, "e", 2, "pass", 1, "b"), (1, "f", 1, "yes", None, "c"), (1, "f", 2, "no", 3, "d")]
    edges = spark.createDataFrame(rows, "page int, node string, edge int, label string, pos int, leaf string")
    assert rows_of(targets.branch_labels(edges), "element", "after", "target") == [("d", "n", ["y"])]


def test_header_and_markers(spark):
    cells = spark.createDataFrame([(1, "h", i, f"c{i}") for i in range(4)], "page int, element string, pos int, leaf string")
    assert rows_of(targets.header_sequences(cells, cells.select("page", "element").distinct()), "after", "target") == [("c1", ["c2", "c3"]), ("c2", ["c3"])]
    markers = spark.createDataFrame([(1, "l", i, i * 3, f"m{i}") for i in range(3)], "page int, element string, index int, pos int, leaf string")
    texts = spark.createDataFrame([(1, "l", 1, 4, "a"), (1, "l", 1, 5, "b"), (1, "l", 1, 9, "late")], markers.schema)
    assert rows_of(targets.list_markers(markers, texts), "after", "target") == [("b", ["m2"])]


@pytest.mark.parametrize("gates,want", [
    ([(1, "in", 0, 0, 1), (2, "not", 1, 0, None), (3, "nor", 2, 1, None)], {1: 1, 2: 0, 3: 0}),
    ([(1, "and", 2, 2, None), (2, "or", 1, 1, None)], None),
    ([(1, "xor", 7, 8, None)], None),
])
def test_settle(gates, want):
    assert diagrams.settle([dict(zip(("id", "type", "a", "b", "bit"), x)) for x in gates]) == want


def test_shapes(spark):
    box = g.Box(*(F.lit(float(v)) for v in (0, 0, 20, 10)))
    at = lambda kind, x, y: diagrams.inside(F.lit(kind), box, F.lit(float(x)), F.lit(float(y)))
    row = spark.range(1).select(at("box", 1, 1), at("diamond", 1, 1), at("diamond", 10, 5), at("ellipse", 2, 2), at("parallelogram", 2, 1), at("parallelogram", 10, 5)).first()
    assert list(row) == [True, False, True, False, False, True]
    d = spark.range(1).select(diagrams.outline_distance(F.lit("box"), box, F.lit(10.0), F.lit(4.0)), diagrams.outline_distance(F.lit("box"), box, F.lit(23.0), F.lit(14.0))).first()
    assert list(d) == pytest.approx([4, 5])
    far = g.Box(*(F.lit(float(v)) for v in (30, 0, 40, 10)))
    a = spark.range(1).select(diagrams.arrow_between(box, far, 1.0), diagrams.arrow_between(box, box, 1.0)).first()
    assert tuple(a[0]) == (21, 5, 29, 5) and a[1] is None


def test_annotations_cover(spark):
    items = spark.createDataFrame([(1, "t", "e", None, 0), (1, "t.marker", "e", None, 1), (1, "t.l1", "x", "t", None)], "page int, leaf string, element string, line_of string, row int")
    refs = spark.createDataFrame([(1, 1, "t"), (1, 2, "e.r1"), (1, 3, "x"), (1, 4, "none")], "page int, ann int, ref string")
    assert rows_of(diagrams.covered(refs, items), "ann", "leaf") == [(1, "t"), (1, "t.l1"), (1, "t.marker"), (2, "t.marker"), (3, "t.l1")]


def test_wires(spark):
    ports = spark.createDataFrame([(1, 1, False), (1, 2, True), (1, 3, True)], "page int, port int, is_input boolean")
    wires = spark.createDataFrame([(1, 1, 2), (1, 1, 2), (1, 9, 2)], "page int, src int, dst int")
    assert rows_of(diagrams.wire_problems(ports, wires), "port", "problem") == [(2, "driven twice"), (3, "not connected"), (9, "no port")]


def test_nesting(spark):
    chain = spark.createDataFrame([(i, i - 1 if i else None) for i in range(6)], "item int, parent int")
    assert rows_of(validation.too_deep(chain), "item") == [(3,), (4,), (5,)]


def loop_counts(sizes, n):
    n = max(n, len(sizes))
    counts = [max(1, round(k * n / sum(sizes))) for k in sizes]
    while sum(counts) != n:
        counts[counts.index(max(counts))] += 1 if sum(counts) < n else -1
    return counts


def test_shared_counts(spark):
    r = random.Random(3)
    cases = [([r.randint(1, 40) for _ in range(r.randint(1, 9))], 24) for _ in range(60)] + [([1] * 30, 24)]
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], "i int, sizes array<bigint>")
    got = dict(df.select("i", paths.shared_counts(F.col("sizes"), 24)).collect())
    assert got == {i: loop_counts(c, n) for i, (c, n) in enumerate(cases)}


def test_decoded_splines(spark):
    for m in (1, 2, 3, 4, 9):
        w = splines.decode_weights(m, 4)
        assert w.shape == (1 if m == 1 else (m - 1) * 4 + 1, m) and np.allclose(w.sum(1), 1)
        assert w[0, 0] == pytest.approx(1) and w[-1, -1] == pytest.approx(1)
    df = spark.createDataFrame([([(0.0, 0.0), (1.0, 2.0)],), ([],), (None,)], "c array<struct<x:double,y:double>>")
    line, none, null = (r[0] for r in df.select(splines.decoded(F.col("c"), 2)).collect())
    assert [tuple(p) for p in line] == [(0, 0, 0), (0.5, 1, 0), (1, 2, 1)] and none == [] and not null


def test_rounding_and_rising(spark):
    values = [2.675, 1.005, -0.125, 0.375, 1e9 + 0.005]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(augment.rounded(F.col("v"))).collect()]
    assert got == [round(v, 2) for v in values]
    fit = spark.createDataFrame([([3.0, 1.0, 2.0, 5.0, 4.0],), ([],)], "v array<double>").select(augment.rising_fit(F.col("v"))).collect()
    assert [list(r[0]) for r in fit] == [[2, 2, 2, 4.5, 4.5], []]


def test_typos_differ(spark):
    words = ["ab", "word", "letters", "aaaa", "x"]
    got = {(r.w, r.t) for r in spark.range(200).select(F.explode(F.array(*map(F.lit, words))).alias("w"), "id").withColumn("t", augment.typo(F.col("w"), F.col("id"), F.col("w"))).collect()}
    assert all((w != t) == (len(w) > 1) and abs(len(w) - len(t)) < len(w) for w, t in got) and len({t for w, t in got if w == "letters"}) > 10


def test_digitizer_keeps_ends_and_order(spark):
    points = spark.createDataFrame([(1, i * 0.01, i * 0.3, 0.1) for i in range(300)], "s int, t double, x double, y double")
    rows = augment.digitized(points, "s", "t", 0.2, 0.1, 0.05, 0.02, 0.002).orderBy("t").collect()
    times = [r.t for r in rows]
    assert rows[0].sample == 1 and rows[-1].sample == 300 and 150 < len(rows) < 290
    assert all(b - a > 0.0019 for a, b in zip(times, times[1:])) and all(abs(r.x / 0.2 - round(r.x / 0.2)) < 1e-9 for r in rows)


def test_edit_script_in_blocks(monkeypatch):
    r = random.Random(5)
    cases = [("".join(r.choices("abc", k=r.randint(0, 30))), "".join(r.choices("abc", k=r.randint(0, 30)))) for _ in range(40)]
    whole = [evaluation.edit_script(list(a), list(b)) for a, b in cases]
    monkeypatch.setattr(evaluation, "BLOCK_CELLS", 1)
    assert [evaluation.edit_script(list(a), list(b)) for a, b in cases] == whole
