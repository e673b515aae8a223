"""Unit fixtures of the ink operators, and folds against plain loops."""

import random
from itertools import product

import pytest
from pyspark.sql import functions as F

from scriptorium.functions import geometry as g
from scriptorium.functions import text as tx
from scriptorium.operators import codec, evaluation, paths, sequences, spatial, splines, validation
from scriptorium.sources import ink as source


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def xy(*points):
    return F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in points))


def ints(*v):
    return F.array(*map(F.lit, v)).cast("array<int>")


def strokes_of(row):
    return [[(p["x"], p["y"]) for p in s] for s in row]


def test_tokens_and_plain_text(spark):
    assert one(spark, tx.tokens_of(F.lit("hello<ink_token_450><ink_token_10><ink_token_235>")))[0] == [450, 10, 235]
    cases = {"<ink_token_450>volt<ink_token_12><ink_token_300>age": "voltage", "<extra_id_0> Neat:<ink_token_450>": "Neat:", "<extra_id_0> V<ink_token_12>out</s>": "Vout", "<extra_id_0>  a<ink_token_1>   b  ": "a b"}
    assert all(one(spark, tx.plain(F.lit(k)))[0] == v for k, v in cases.items())


def test_detokenize(spark):
    cases = {
        (450, 10, 235, 20, 245): [[(10, 10), (20, 20)]],
        (450, 1, 226, 450, 5, 230): [[(1, 1)], [(5, 5)]],
        (450, 3, 228, 99): [[(3, 3)]],
        (450, 3, 228, 99, 450, 4, 229): [[(3, 3)], [(4, 4)]],
        (450, 10, 100, 20, 245): [[(20, 20)]],
    }
    for tokens, want in cases.items():
        assert strokes_of(one(spark, codec.detokenize(ints(*tokens)))[0]) == want
    assert one(spark, codec.invalid_tokens(ints(450, 451, -1)))[0] == [451, -1]


def test_round_trip_and_rounding(spark):
    s = F.array(xy((0, 0), (12, 200), (224, 224)), xy((100, 3), (7, 99)))
    t = codec.tokenize(s)
    row = one(spark, t.alias("t"), codec.detokenize(t).alias("s"))
    assert row.t[0] == 450 and strokes_of(row.s) == [[(0, 0), (12, 200), (224, 224)], [(100, 3), (7, 99)]]
    assert one(spark, codec.tokenize(F.array(xy((10.4, 10.6), (-5, 900)))))[0] == [450, 10, 236, 0, 449]
    assert one(spark, codec.tokenize(F.array(xy((2.5, 3.5)))))[0] == [450, 2, 229]
    with pytest.raises(Exception, match="off the grid"):
        one(spark, codec.tokenize(F.array(xy((300, 0))), strict=True))


def test_half_away(spark):
    got = one(spark, *[g.half_away(F.lit(x)).alias(str(i)) for i, x in enumerate((0.5, -0.5, 2.5, 0.49999999999999994, -1.2))])
    assert list(got) == [1, -1, 3, 1, -1]


def loop_walk(dx, dy):
    """The line walk with a running error, as a loop."""
    x = y = 0
    sx, sy, ax, ay = (dx > 0) - (dx < 0), (dy > 0) - (dy < 0), abs(dx), abs(dy)
    error, out = ax - ay, []
    while (x, y) != (dx, dy):
        px, py, e = x, y, 2 * error
        if e > -ay:
            error, x = error - ay, x + sx
        if e < ax:
            error, y = error + ax, y + sy
        out.append((x - px, y - py))
    return out


def test_walk(spark):
    moves = list(product(range(-6, 7), range(-6, 7)))
    rows = spark.createDataFrame(moves, "dx int, dy int").select("dx", "dy", codec.walk(F.col("dx"), F.col("dy")).alias("w")).collect()
    assert all([codec.DIRECTIONS[c] for c in r.w] == loop_walk(r.dx, r.dy) for r in rows)
    assert one(spark, codec.walk(F.lit(4), F.lit(2)))[0] == [4, 5, 4, 5]


POINTS = "ink_id long, stroke_id int, point_id int, x double, y double"


def ink(spark, *strokes):
    return spark.createDataFrame([(1, s, p, float(x), float(y)) for s, ps in enumerate(strokes) for p, (x, y) in enumerate(ps)], POINTS)


def test_scribe(spark):
    enc = codec.encode_scribe(ink(spark, [(10, 20), (14, 20), (14, 24)], [(20, 30), (18, 30)], [(7, 17)]), 2.0)
    row = enc.first()
    assert (row.origin_x, row.origin_y) == (10, 20) and row.tokens.count(0) == row.tokens.count(1) == 3
    back = codec.decode_scribe(enc, 2.0).orderBy("stroke_id", "point_id").collect()
    assert [sum(r.stroke_id == k for r in back) for k in range(3)] == [5, 2, 1] and (back[-1].x, back[-1].y) == (6, 16)
    for bad in ([1], [0], [0, 0, 1]):
        with pytest.raises(Exception, match="bad pen state"):
            codec.decode_scribe(spark.createDataFrame([(1, 0.0, 0.0, bad)], "ink_id long, origin_x double, origin_y double, tokens array<int>")).collect()


def test_merges_are_lossless(spark):
    enc = spark.createDataFrame([(1, [0, 4, 5, 4, 5, 1]), (2, [0, 4, 5, 4, 1, 6]), (3, [0, 4, 5, 1])], "ink_id long, tokens array<int>")
    runs = codec.runs(enc)
    m = codec.fit_merges(runs, 2)
    assert m.vocabulary()[10:] == [(4, 5), (4, 5, 4)] or m.vocabulary()[10] == (4, 5)
    assert runs.filter(m.decode(m.encode(F.col("run"))) != F.col("run")).count() == 0


def test_resample_and_offsets(spark):
    rows = paths.resample(ink(spark, [(0, 0), (1, 0), (1, 0), (1, 3)], [(5, 5), (5, 5)]), 0.5).orderBy("stroke_id", "sample").collect()
    first = [(r.x, r.y) for r in rows if r.stroke_id == 0]
    assert len(first) == 9 and first[0] == (0, 0) and first[-1] == (1, 3) and first[3] == pytest.approx((1, 0.5))
    assert [(r.x, r.y) for r in rows if r.stroke_id == 1] == [(5, 5)]
    back = paths.to_positions(paths.to_offsets(ink(spark, [(3, 4), (5, 6)], [(1, 1)]))).orderBy("stroke_id", "point_id").collect()
    assert [(r.x, r.y, r.eos) for r in back] == [(0, 0, False), (2, 2, True), (-2, -3, True)]


def test_boxes(spark):
    b = spark.createDataFrame([(1, 1, 0.0, 0.0, 10.0, 10.0, 0.9), (1, 2, 1.0, 1.0, 11.0, 11.0, 0.8), (1, 3, 50.0, 50.0, 60.0, 60.0, 0.1)], "page int, idx int, l double, t double, r double, b double, score double")
    assert sorted(r.idx for r in spatial.suppressed(b, 0.5).collect()) == [1, 3]
    m = spatial.greedy_matches(b.filter("idx < 3"), b.filter("idx = 1")).collect()
    assert [(r.cand, r.ref, r.score) for r in m] == [(1, 1, 1.0)]
    q = one(spark, spatial.quad_box(F.array(*[F.array(F.lit(float(x)), F.lit(float(y))) for x, y in ((10, 20), (40, 18), (42, 35), (12, 37))]), F.lit(0.95)))[0]
    assert tuple(q) == (10, 18, 42, 37, 95)


def test_suppression_against_a_loop(spark):
    rng = random.Random(1)
    rows = [(p, i, x := rng.randint(0, 20), y := rng.randint(0, 20), x + rng.randint(1, 20), y + rng.randint(1, 20), rng.randint(0, 3) / 3) for p in range(8) for i in range(9)]
    rows = [(p, i, *map(float, r)) for p, i, *r in rows]
    area = lambda r: (r[4] - r[2]) * (r[5] - r[3])

    def share(a, b):
        w, h = max(0, min(a[4], b[4]) - max(a[2], b[2])), max(0, min(a[5], b[5]) - max(a[3], b[3]))
        return w * h / (area(a) + area(b) - w * h)

    want = set()
    for p in range(8):
        kept = []
        for r in sorted((r for r in rows if r[0] == p), key=lambda r: (-r[6], -area(r), r[1])):
            if all(share(r, k) < 0.4 for k in kept):
                kept.append(r)
        want |= {(p, r[1]) for r in kept}
    df = spark.createDataFrame(rows, "page int, idx int, l double, t double, r double, b double, score double")
    assert {(r.page, r.idx) for r in spatial.suppressed(df, 0.4).collect()} == want


def test_fit(spark):
    f = one(spark, *[v.alias(k) for k, v in g.fit(F.lit(448.0), F.lit(224.0)).items()])
    assert (f.ratio, f.dx, f.dy) == (0.5, 0, 56)


def test_latex_tokens(spark):
    cases = {r"\frac{\alpha}{x_1}": 9, r"\begin{matrix}a\\ b\end{matrix}": 6, r"\{x\}": 3}
    assert all(len(one(spark, tx.latex_tokens(F.lit(k)))[0]) == n for k, n in cases.items())


def test_simplify_and_wrap(spark):
    got = one(spark, g.simplified(xy((0, 0), (0, 0), (1, 0), (2, 0), (2, 3))))[0]
    assert [(p.x, p.y) for p in got] == [(0, 0), (2, 0), (2, 3)]
    assert one(spark, tx.wrapped(F.array(*map(F.lit, ("aa", "bbb", "c", "dddddddd"))), 6))[0] == ["aa bbb", "c", "dddddddd"]


def test_expressions():
    names = {"A": 1, "B": 0, "AB": 0}
    cases = {"A + B": 1, "AB": 0, "A B'": 1, "A xor A": 0, "~(A B) + 0": 1, "A ^ B ^ 1": 0, "A⊕B·A": 1}
    assert all(validation.boolean(k, names) == v for k, v in cases.items())
    for bad in ("A +", "(A", "Q", "A)"):
        with pytest.raises(ValueError):
            validation.boolean(bad, names)
    assert validation.chain_holds("2^3 = 8 = 4*2", {}) and validation.chain_holds("1 = 2", {}) is False
    assert validation.chain_holds("__import__('os') = 1", {}) is None and validation.chain_holds("x + 1 = 3", {"x": 2})


def test_edit_script(spark):
    assert evaluation.edit_script(list("abc"), list("abd")) == [("sub", "d", "c")]
    assert evaluation.edit_script(list("ab"), list("abc")) == [("drop", "c", None)] and evaluation.edit_script(list("abc"), list("ab")) == [("add", None, "c")]
    a, b = (tx.char_tokens(F.lit(x)) for x in ("kitten", "sitting"))
    assert one(spark, tx.token_distance(a, b))[0] == 3


def test_spline_basis():
    import numpy as np

    u = np.linspace(0, 1, 33)
    for m in range(1, 9):
        b = splines.basis(u, m)
        assert np.allclose(b.sum(1), 1) and (b > -1e-12).all() and np.isclose(b[0, 0], 1) and np.isclose(b[-1, -1], 1)
    line = np.c_[u, 2 * u]
    assert splines.fit(line, 4)[1] < 1e-12


def test_graphs_and_targets(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (7, 8), (9, 9)], "u long, v long")
    assert {(r.node, r.root) for r in validation.labels_of_components(edges).collect()} == {(1, 1), (2, 1), (3, 1), (7, 7), (8, 7), (9, 9)}
    rows = spark.createDataFrame([("p", i, k) for i, k in enumerate("abbabaa")], "page string, pos int, k string")
    got = sequences.run_targets(rows, "page", "pos", F.col("k") == "b").orderBy("first").collect()
    assert [(r.after, r.first, r.last, r.n) for r in got] == [(0, 1, 2, 2), (3, 4, 4, 1)]
    up = spark.createDataFrame([(1, i, f"Q{2 * i}") for i in range(4)] + [(2, i, "x") for i in range(4)], "t int, i int, text string")
    assert {(r.t, r.up) for r in sequences.counts_up(up, "t", "i").collect()} == {(1, True), (2, False)}


def test_sources(spark, tmp_path):
    (tmp_path / "a.inkml").write_text('<ink><annotation type="label">x</annotation><trace id="t1">1 2 0, 3 4 0.5</trace></ink>')
    rows = source.read_inkml(spark, str(tmp_path / "a.inkml")).orderBy("seq").collect()
    assert [(r.trace_id, r.x, r.y, r.t) for r in rows] == [("t1", 1, 2, 0), ("t1", 3, 4, 0.5)]
    assert source.read_inkml_labels(spark, str(tmp_path / "a.inkml")).first().value == "x"
    s = one(spark, source.svg(F.array(xy((2, 3), (7, 8)), xy((4, 5)))))[0]
    assert 'viewBox="-6 -5 21 21"' in s and s.count("<path") == 1 and s.count("<circle") == 1
    doc = one(spark, source.strokes_to_json(F.array(xy((1, 2)))))[0]
    assert strokes_of(one(spark, source.strokes_from_json(F.lit(doc)))[0]) == [[(1, 2)]]


def test_stream(spark, tmp_path):
    from scriptorium.streaming import pen

    schema = "writer long, seq long, code int"
    spark.createDataFrame([(1, 0, 0), (1, 1, 4), (1, 2, 5), (1, 3, 1), (2, 0, 1)], schema).write.parquet(str(tmp_path / "in"))
    q = pen.pen_states(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("pen").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    rows = {(r.writer, r.seq): (r.x, r.y, r.down, r.ok) for r in spark.table("pen").collect()}
    assert rows[1, 2] == (2, 1, True, True) and rows[1, 3] == (2, 1, False, True) and rows[2, 0][3] is False
