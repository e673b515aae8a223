"""Steps whose figures grow no faster than their input: plans without what grew, and the same results."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

import __spark_entry__ as contract
from scriptorium.operators import corpus, formulas, lineage, packing, ranks, routing, spatial, splines, symbols
from scriptorium.operators.codec import DIRECTIONS
from scriptorium.plans import shapes
from scriptorium.streaming import tracking


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_routes_keep_no_rounds(spark):
    asks = spark.range(3).select(F.col("id").alias("page"), F.lit(0).alias("net"), *[F.lit(v).alias(c) for c, v in (("si", 0), ("sj", 0), ("ti", 3), ("tj", 0))])
    walls = spark.range(1).select(F.lit(1).cast("long").alias("page"), F.lit(1).alias("i"), F.lit(0).alias("j"))
    found = routing.routes(asks, walls, walls.select("page", F.lit(9).alias("i"), "j", F.lit(True).alias("level")), 4, 3)
    assert "ExistingRDD" not in plan(found)  # of the rounds' checkpoints
    assert sorted((r.page, r.cost, r.path) for r in found.collect()) == [(0, 3.0, "RRR"), (1, 11.0, "DRRRU"), (2, 3.0, "RRR")]


def test_middle_without_one_task(spark):
    for values in ([], [None], [3.0], [4.0, 1.0, None], [2.0] * 50 + [1.0, 9.0], [float(k * 37 % 101) for k in range(100)]):
        rows = spark.createDataFrame([(v,) for v in values], "q double")
        found = ranks.middle(rows, "q")
        assert found.first()[0] == rows.agg(F.median("q")).first()[0]
    assert "percentile" not in plan(found) and "median" not in plan(found)


def query(spark, name):
    return contract.queries()[name](spark, "/root/testdata/sf0.001")


def test_rows_are_dealt_by_number(spark):
    assert lineage.dealt(spark.range(100), 10, "id").rdd.getNumPartitions() == 10
    assert lineage.dealt(spark.range(0), 10, "id").rdd.getNumPartitions() == 4
    for name in ("t1_latex_tokens", "t16_formula_nodes", "w4_table_inputs", "w6_header_sequences", "w11_timed_samples"):
        assert "REPARTITION_BY_NUM" in plan(query(spark, name))


def test_outlines_need_no_aggregate(spark):
    for name in ("g25_gate_shapes", "g26_component_shapes"):
        assert "Aggregate" not in plan(query(spark, name))


def test_strokes_are_fitted_together(spark):
    for name in ("p19_spline_fit", "p21_spline_ratio"):
        assert "InPandas" not in plan(query(spark, name))
    rng = np.random.default_rng(3)
    for k in (1, 2, 3, 8, 13):
        points = np.concatenate([rng.normal(size=(20, k, 2)), np.ones((1, k, 2)), np.repeat(rng.normal(size=(1, 1, 2)), k, axis=1)])
        assert np.allclose(splines.errors(points, 4), [splines.fit(p, 4)[1] for p in points], atol=1e-9)


def test_crops_are_scored_once(spark):
    assert plan(query(spark, "m2_scored_pages")).count("MapInArrow") == 1


def test_turns_of_corners_are_constants(spark):
    assert "COS(" not in plan(query(spark, "g24_outlines")).upper()


def test_strokes_are_encoded_once(spark):
    for name in ("c12_encode_merges", "c14_decode_merges"):
        assert "Window" not in plan(query(spark, name))


def test_unreadable_lines(spark):
    lines = spark.createDataFrame([(1, ["a", "b"]), (2, ["a", "c", "c"]), (3, []), (4, None)], "key int, tokens array<string>")
    known = spark.createDataFrame([("a",), ("b",)], "token string")
    assert [r.key for r in corpus.unreadable(lines, known, "key").collect()] == [2]
    assert sorted(r.key for r in corpus.readable(lines, known, "key").collect()) == [1, 3, 4]


def test_near_pairs_without_rows_of_pairs(spark, monkeypatch):
    for name in ("j9_near_ink", "v12_clearance"):
        assert "cx" not in "".join(x for x in plan(query(spark, name)).splitlines() if "Exchange" in x or "Aggregate" in x)
    rng = np.random.default_rng(5)
    n, r = 70, 3
    item, x, y = rng.integers(0, n, 900), rng.integers(-40, 40, 900) ** 3, rng.integers(0, 9, 900)
    own = item % 3 > 0
    want = np.zeros((n, n), int)
    for p, u, v in {(int(a), int(b), int(c)) for a, b, c, d in zip(item, x, y, own) if d}:
        want[p, np.unique(item[(x - u) ** 2 + (y - v) ** 2 <= r * r])] += 1
    for cells in (1 << 20, 0):
        monkeypatch.setattr(spatial, "DENSE_CELLS", cells)
        assert (spatial._hits(item, own, x, y, n, r) == want).all()


class Handle:
    """One state and its timers, as a block of writers has them."""

    def __init__(self):
        self.value, self.timers = None, set()
        self.exists, self.get, self.registerTimer, self.deleteTimer = lambda: self.value is not None, lambda: self.value, self.timers.add, self.timers.remove

    def getValueState(self, name, schema):
        return self

    def update(self, value):
        self.value = value


class Writer:
    """A writer's rows one by one, given up by time."""

    def __init__(self):
        self.x = self.y = self.next = 0
        self.down, self.waiting, self.due = False, {}, None

    def go_on(self):
        while self.next in self.waiting:
            code = self.waiting.pop(self.next)
            status = "bad code" if not 0 <= code <= 9 else "bad pen" if code < 2 and (code == 0) == self.down else "ok"
            dx, dy = DIRECTIONS.get(code, (0, 0))
            self.x, self.y, self.down = self.x + dx, self.y + dy, code == 0 if 0 <= code < 2 else self.down
            yield self.next, self.x, self.y, self.down, status
            self.next += 1
        self.due = self.due if self.waiting else None

    def batch(self, rows, patience):
        late = []
        for seq, code, ms in rows:
            if seq < self.next or seq in self.waiting:
                late.append(seq)
            else:
                self.waiting[seq] = code
        self.due = max(r[2] for r in rows) + patience
        return [*self.go_on(), *((seq, self.x, self.y, self.down, "late") for seq in late)]

    def time(self, watermark, patience):
        if self.due is None or self.due >= watermark:
            return []
        self.next, self.due = min(self.waiting), watermark + patience
        return list(self.go_on())


def listed(frames):
    return [r for f in frames for r in f.itertuples(index=False, name=None)]


def test_writers_of_a_block_share_a_state():
    rng = np.random.default_rng(7)
    handle, tracker, writers, seen = Handle(), tracking.PenTracker(15), {w: Writer() for w in range(-2, 5)}, set()
    tracker.init(handle)
    for k in range(99):
        n = int(rng.integers(1, 12))
        rows = pd.DataFrame({"writer": rng.integers(-2, 5, n), "seq": rng.integers(max(k - 4, 0), k + 4, n), "code": rng.integers(-1, 12, n), "ms": k * 10 + rng.integers(0, 9, n)})
        got = listed(tracker.handleInputRows((0,), iter([rows[: n // 2], rows[n // 2 :]]), None))
        want = [(w, *r) for w, of in rows.groupby("writer") for r in writers[w].batch(list(of[["seq", "code", "ms"]].itertuples(index=False, name=None)), 15)]
        assert sorted(got) == sorted(want)
        seen |= {r[-1] for r in got}
        assert handle.timers == {min(d for w in writers.values() if (d := w.due) is not None)} if any(w.due is not None for w in writers.values()) else not handle.timers
        watermark = k * 10 + 9
        for timer in [t for t in handle.timers if t < watermark]:
            values = type("Values", (), {"getCurrentWatermarkInMs": lambda self: watermark})()
            got = listed(tracker.handleExpiredTimer((0,), values, None))
            handle.timers.discard(timer)
            want = [(w, *r) for w in writers for r in writers[w].time(watermark, 15)]
            assert sorted(got) == sorted(want) and want
            seen.add("given up")
    assert seen == {"ok", "bad pen", "bad code", "late", "given up"}


def laid_out(blocks, width, height, gap, column_gap, margin):
    """``attempt, scale, places`` of a page's blocks (w, h), one spot after the other."""
    for a in range(12):
        s, board = 0.92 ** min(max(a - 2, 0), 3), (1, 1.25, 1.5)[(a >= 6) + (a >= 9)]
        placed, column = [], 0.0
        for w, h in ((w * s, h * s) for w, h in blocks):
            near = gap * s * 0.6
            free = lambda x, y: (
                x >= margin / 2 and y >= margin / 2 and x + w <= width * board - margin / 2 and y + h <= height * board - margin / 2  # noqa: B023
                and not any(x - near < p + pw and p - near < x + w and y - near < q + ph and q - near < y + h for p, q, pw, ph in placed)  # noqa: B023
            )
            spots = [(margin, margin, True)]
            if placed:
                x, y, lw, lh = placed[-1]
                spots = [(column, y + lh + gap * s, False), (x + lw + column_gap * s, y, True)][:: -1 if a % 2 else 1] + [(max(p[0] + p[2] for p in placed) + column_gap * s, margin, True)]
            spots += [(margin + i * 10, margin + j * 10, True) for j in range(max(int((height * board - h - margin) // 10), 0) + 1) for i in range(max(int((width * board - w - margin) // 10), 0) + 1)]
            spot = next((c for c in spots if free(*c[:2])), None)
            if spot is None:
                break
            placed.append((*spot[:2], w, h))
            column = spot[0] if spot[2] else column
        else:
            return a, s, [p[:2] for p in placed]
    return None


def test_pages_are_packed_together(spark, monkeypatch):
    rng = np.random.default_rng(11)
    pages = [[(float(w), float(h)) for w, h in zip(rng.integers(5, 75, n), rng.integers(5, 60, n))] for n in rng.integers(1, 15, 150)]
    pages += [[(9.0, 7.0)] * 70, [(400.0, 3.0)], [(20.0, 20.0), (3.0, 500.0)], [(155.0, 125.0)] * 2]
    sheet = (160.0, 130.0, 4.0, 6.0, 5.0)
    want = [laid_out(p, *sheet) for p in pages]
    assert None in want and len({w[0] for w in want if w}) > 5
    n = np.array([len(p) for p in pages])
    w, h = (np.array([[b[k] for b in p] + [0.0] * (n.max() - len(p)) for p in pages]) for k in (0, 1))
    for cells in (1 << 20, 100, 1):
        monkeypatch.setattr(packing, "CELLS", cells)
        attempt, scale, x, y = packing._fitted(w, h, n, *sheet)
        for k, own in enumerate(want):
            assert attempt[k] == (own[0] if own else -1)
            assert own is None or (abs(scale[k] - own[1]) < 1e-9 and np.allclose(np.stack([x[k, : n[k]], y[k, : n[k]]], 1), own[2]))
    # keys of any kind, places back in their order, sizes that are missing
    rows = [(None if p % 50 == 7 else f"p{p}", f"b{k:02}", *b) for p, own in enumerate(pages) if p % 50 != 7 or p < 50 for k, b in enumerate(own)] + [("gone", "b00", None, 3.0)]
    found = packing.layouts(spark.createDataFrame(rows, "page string, idx string, w double, h double"), *sheet)
    assert "MapInArrow" in plan(found) and "aggregate(" not in plan(found)
    got = {(r.page, r.idx): (r.attempt, r.x, r.y) for r in found.collect()}
    assert len(got) == len(rows) and got["gone", "b00"] == (None, None, None)
    for page, idx, *_ in rows[:-1]:
        own = want[int(page[1:]) if page else 7]
        a, *at = got[page, idx]
        assert a is None if own is None else (a == own[0] and np.allclose(at, own[2][int(idx[1:])]))


def test_formulas_are_read_in_their_rows(spark):
    text = plan(query(spark, "t16_formula_nodes"))
    assert "Window" not in text and "Join" not in text and text.count("Exchange") == 1 and text.count("MapInArrow") == 1
    # indexes in an index, keys that are missing or stand twice, and texts of several batches
    latex = [r"\sqrt[\sqrt[a]b]c", "x^2", "x^2", "{a", None, *(" " * 400_000 + c for c in "efgh")]
    rows = spark.createDataFrame([(None if k < 2 else "twice" if k < 4 else str(k), t) for k, t in enumerate(latex)], "formula string, latex string").coalesce(1)
    got = {}
    for r in formulas.formula_nodes(rows).collect():
        got.setdefault(r.formula, []).append(tuple(r)[1:])
    x = [(0, None, 0, "symbol", "x", None), (1, 0, 0, "script", "^", None), (2, 1, 0, "symbol", "2", None)]
    root = [(0, None, 0, "command", "\\sqrt", None), (1, 0, 0, "index", None, None), (2, 1, 0, "command", "\\sqrt", None), (3, 2, 0, "index", None, None)]
    root += [(4, 3, 0, "symbol", "a", None), (6, 2, 1, "symbol", "b", None), (8, 0, 1, "symbol", "c", None)]
    sort = lambda rows: sorted(rows, key=str)
    assert sort(got.pop(None)) == sort(root + x) and sort(got.pop("twice")) == sort([*x, (None,) * 5 + ("unbalanced",)])
    assert got == {"4": [(None,) * 6]} | {str(k): [(400_000, None, 0, "symbol", c, None)] for k, c in zip(range(5, 9), "efgh")}


def gate(kind, l, t, r, b):
    """The points of a gate's strokes by part and number, one after the other."""
    w, h, ym = r - l, b - t, (t + b) / 2
    bend = lambda p, q, s: [tuple((1 - i / 16) ** 2 * u + 2 * (1 - i / 16) * (i / 16) * v + (i / 16) ** 2 * z for u, v, z in zip(p, q, s)) for i in range(17)]
    inverted, back = kind in ("nand2", "nor2", "xnor2", "not"), l + 0.12 * w * (kind in ("xor2", "xnor2"))
    end, out = r - 0.14 * h * inverted, {}
    if kind in ("and2", "nand2"):
        arc = [(end - h / 2 + h / 2 * np.sin(np.pi * i / 16), ym - h / 2 * np.cos(np.pi * i / 16)) for i in range(17)]
        out["body", 0] = [(l, t), (end - h / 2, t), *arc, (l, b), (l, t)]
    elif kind in ("not", "buf"):
        out["body", 0] = [(l, t), (end, ym), (l, b), (l, t)]
    else:
        at = back + 0.6 * (end - back)
        out["body", 0] = bend((back, t), (at, t), (end, ym)) + bend((end, ym), (at, b), (back, b))[1:] + bend((back, b), (back + 0.24 * w, ym), (back, t))[1:]
        if back > l:
            out["xor_curve", 0] = bend((l, t), (l + 0.24 * w, ym), (l, b))
        out |= {("stubs", k): [(l, t + s * h), (back + 0.09 * w, t + s * h)] for k, s in ((0, 0.25), (1, 0.75))}
    if inverted:
        out["bubble", 0] = [(end + 0.07 * h - 0.07 * h * np.sin(np.pi * i / 6), ym - 0.07 * h * np.cos(np.pi * i / 6)) for i in range(13)]
    return out


def test_symbols_are_drawn_together(spark):
    for name in ("g25_gate_shapes", "g26_component_shapes"):
        text = plan(query(spark, name))
        assert text.count("MapInArrow") == 1 and "lambda" not in text and "Join" not in text
    rng = np.random.default_rng(13)
    kinds = [*symbols.GATES, "coil", None]
    rows = [(k, kinds[k % 10], *(float(v) for v in (l, t, l + w, t + h))) for k, (l, t, w, h) in enumerate(rng.uniform(1, 90, (300, 4)))]
    rows.append((300, "buf", None, 1.0, 3.0, 5.0))
    boxes = spark.createDataFrame(rows, "id int, kind string, l double, t double, r double, b double").coalesce(1)
    got = {(r.id, r.part, r.stroke): r.points for r in symbols.gate_strokes(boxes, "id").collect()}
    lost = got.pop((300, "body", 0))
    assert [(q.x, q.y) for q in lost] == [(None, y) for y in (1, 3, 5, 1)]
    want = {(k, *stroke): p for k, kind, *box in rows[:300] if kind in symbols.GATES for stroke, p in gate(kind, *box).items()}
    assert set(got) == set(want)
    for key, points in want.items():
        assert np.allclose([(q.x, q.y) for q in got[key]], points, atol=1e-9) and [q.n for q in got[key]] == sorted(q.n for q in got[key])
    # more symbols than are drawn at once, and sums that have no value
    many = spark.range(symbols.ROWS + 500).select(F.col("id"), F.lit("nor2").alias("kind"), *[F.when(F.col("id") != 7, F.lit(v)).alias(c) for c, v in zip("ltrb", (0.0, 0.0, 4.0, 2.0))]).coalesce(1)
    sums = symbols.gate_strokes(many, "id", summary=shapes._SUMMED)
    assert sums.columns == ["id", "kind", "part", "stroke", *"points x y xy x0 y0 x1 y1".split()]
    assert sums.filter("part = 'bubble'").agg(F.count("*"), F.count_distinct("id"), F.count("x"), F.min("points")).first() == (symbols.ROWS + 500, symbols.ROWS + 500, symbols.ROWS + 499, 13)
    assert list(shapes._rounded(np.array([0.25, -0.25, 1.04, 3e17]), 1)) == [0.3, -0.3, 1.0, 3e17] and np.isnan(shapes._rounded(np.array([np.nan]), 1)[0])
