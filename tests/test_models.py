"""Scoring, formulas, charts, wires and packing against plain loops."""

import heapq
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scriptorium.operators import charts, codec, evaluation, formulas, packing, routing, scoring, symbols

# --- scoring --------------------------------------------------------------------------------------------------------

BOXES = "page int, idx int, l double, t double, r double, b double, raw string"


def ink(*points):
    return "".join(f"<ink_token_{t}>" for t in [450, *[v for x, y in points for v in (x, 225 + y)]])


def test_strokes_come_back_in_page_coordinates(spark):
    boxes = spark.createDataFrame([(1, 0, 100.0, 200.0, 324.0, 424.0, "a"), (1, 1, 0.0, 0.0, 448.0, 224.0, "b")], BOXES)
    replies = {0: "vol" + ink((0, 0), (224, 224)) + "tage", 1: ink((112, 112))}
    model = lambda: lambda part, prompt: [replies[i] for i in part.column("idx").to_pylist()]
    got = {r.idx: r for r in scoring.derendered(boxes, model).collect()}
    assert [tuple(p) for p in got[0].strokes[0]] == [(100, 200), (324, 424)] and got[0].text == "voltage" and not got[0].used_fallback
    assert [tuple(p) for p in got[1].strokes[0]] == [(224, 112)]
    page = scoring.merged_pages(scoring.derendered(boxes, model)).first()
    assert len(page.strokes) == 2 and page.text == "voltage" and page.any_fallback is False


def test_only_failures_are_scored_again(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"r{i}") for i in range(50)], "idx int, raw string").coalesce(1)
    log, seen = str(tmp_path / "log"), ink((1, 1))

    def load():
        def model(part, prompt):
            with open(log, "a") as out:
                out.writelines(f"{i} {prompt}\n" for i in part.column("idx").to_pylist())
            return [seen if i % 3 or prompt == "again" and i % 2 else None for i in part.column("idx").to_pylist()]

        return model

    got = scoring.scored(rows, load, "first", "again", batch_rows=7).collect()
    calls = open(log).read().split("\n")[:-1]
    assert [r.idx for r in got] == list(range(50))
    assert all(r.used_fallback == (r.idx % 3 == 0) and r.passes == 1 + (r.idx % 3 == 0) and ("ink_token" in r.raw) == bool(r.idx % 3 or r.idx % 2) for r in got)
    assert sorted(calls) == sorted([f"{i} first" for i in range(50)] + [f"{i} again" for i in range(0, 50, 3)])
    once = scoring.scored(rows, load, "first", None).collect()
    assert {r.passes for r in once} == {1} and not any(r.used_fallback for r in once)


def test_an_empty_table_loads_no_model(spark):
    def load():
        raise AssertionError("loaded")

    assert scoring.scored(spark.createDataFrame([], "idx int"), load).collect() == []
    with pytest.raises(Exception, match="texts for 1 rows"):
        scoring.scored(spark.createDataFrame([(1,)], "idx int"), lambda: lambda part, prompt: []).collect()


# --- formulas -------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("latex,want", [
    (r"\frac{a}{b_1}", "0 command - \\frac|1 group 0 -|2 symbol 1 a|4 group 0 -|5 symbol 4 b|6 script 5 _|7 symbol 6 1"),
    (r"\frac a\frac12 y", "0 command - \\frac|2 symbol 0 a|3 command 0 \\frac|4 symbol 3 1|5 symbol 3 2|7 symbol - y"),
    (r"\sqrt[3]{x}^2", "0 command - \\sqrt|1 index 0 -|2 symbol 1 3|4 group 0 -|5 symbol 4 x|7 script 0 ^|8 symbol 7 2"),
    (r"\left( a \right]_2", "0 fence - (]|3 symbol 0 a|7 script 0 _|8 symbol 7 2"),
    (r"^2 x", "0 script - ^|1 symbol 0 2|3 symbol - x"),
    (r"\sqrt[{a]b}]{c}", "0 command - \\sqrt|1 index 0 -|2 group 1 -|3 symbol 2 a|4 symbol 2 ]|5 symbol 2 b|8 group 0 -|9 symbol 8 c"),
    (r"\begin{matrix}a&b\end{matrix}", "0 matrix - -|1 symbol 0 a|2 symbol 0 &|3 symbol 0 b"),
    ("{a", "unbalanced"), ("a}", "unbalanced"), (r"\left(a}", "unbalanced"), (r"{a\right)", "unbalanced"), ("}{", "unbalanced"),
    (r"\frac{a}", "missing argument"), (r"x^", "missing argument"), (r"\frac^2b", "missing argument"), (r"{\sqrt}x", "missing argument"),
    ("x^2^3", "double script"), (r"x^2_3^4", "double script"), (r"\left(a\right", "missing delimiter"), ("", ""), ("  ", ""),
])
def test_formulas(spark, latex, want):
    rows = formulas.formula_nodes(spark.createDataFrame([(1, latex)], "formula int, latex string")).orderBy("node").collect()
    if rows[0].node is None:
        assert [r.error or "" for r in rows] == [want]
    else:
        assert "|".join(f"{r.node} {r.kind} {'-' if r.parent is None else r.parent} {r.value or '-'}" for r in rows) == want


# --- charts ---------------------------------------------------------------------------------------------------------


def preorder(nodes, edges):
    out = {n: [d for s, d in edges if s == n] for n in nodes}
    found, open_, back = [], [], []

    def visit(n):
        found.append(n)
        open_.append(n)
        for m in out[n]:
            if m in open_:
                back.append((n, m)) if (n, m) not in back else None
            elif m not in found:
                visit(m)
        open_.pop()

    for n in [n for n in nodes if all(d != n for _, d in edges)] + list(nodes):
        if n not in found:
            visit(n)
    return found, back


def test_chart_order(spark):
    rng = random.Random(6)
    nodes, edges, want = [], [], {}
    for chart in range(60):
        names = rng.sample(range(100), rng.randint(1, 8))
        own = [(rng.choice(names), rng.choice(names)) for _ in range(rng.randint(0, 12))]
        nodes += [(chart, n, k) for k, n in enumerate(names)]
        edges += [(chart, k, s, d) for k, (s, d) in enumerate(own)] + [(chart, 99, 1000, names[0])]
        want[chart] = preorder(names, own)
    got = charts.chart_order(spark.createDataFrame(nodes, "chart int, node int, place int"), spark.createDataFrame(edges, "chart int, at int, src int, dst int")).collect()
    assert {r.chart: (r.nodes, [tuple(b) for b in r.back]) for r in got} == want


# --- wires ----------------------------------------------------------------------------------------------------------


def cheapest(ask, walls, wires, columns, rows):
    (si, sj, ti, tj), best = ask, {}
    heap = [(0.0, "", si, sj, d) for d in range(4)]
    lies = {(i, j): {w[2] for w in wires if w[:2] == (i, j)} for i, j, _ in wires}
    while heap:
        cost, path, i, j, d = heapq.heappop(heap)
        if (i, j) == (ti, tj):
            return cost, path
        if (i, j, d) in best:
            continue
        best[i, j, d] = cost
        for o in range(4):
            if o == (d + 2) % 4 or ((i, j) in lies and o != d):
                continue
            x, y = i + routing.STEPS[o][0], j + routing.STEPS[o][1]
            if not (0 <= x < columns and 0 <= y < rows):
                continue
            more, level = 1 + (routing.BEND if o != d else 0), o % 2 == 0
            if (x, y) != (ti, tj):
                if (x, y) in walls or level in lies.get((x, y), ()):
                    continue
                more += routing.CROSSING if (x, y) in lies else 0
                beside = [(x, y - 1), (x, y + 1)] if level else [(x - 1, y), (x + 1, y)]
                more += routing.BESIDE * sum(level in lies.get(c, ()) for c in beside)
            heapq.heappush(heap, (cost + more, path + "RDLU"[o], x, y, o))
    return None, None


def test_routes_are_the_cheapest(spark):
    rng = random.Random(8)
    asks, walls, wires, want = [], [], [], {}
    for page in range(12):
        spot = lambda: (rng.randint(0, 5), rng.randint(0, 4))
        own_walls, own_wires = {spot() for _ in range(page)}, [(*spot(), rng.random() < 0.5) for _ in range(5)]
        for net in range(2):
            ask = (*spot(), *spot())
            asks.append((page, net, *ask))
            want[page, net] = cheapest(ask, own_walls, own_wires, 6, 5)
        walls += [(page, *w) for w in own_walls]
        wires += [(page, *w) for w in own_wires]
    requests = spark.createDataFrame(asks, "page int, net int, si int, sj int, ti int, tj int")
    found = routing.routes(requests, spark.createDataFrame(walls, "page int, i int, j int"), spark.createDataFrame(wires, "page int, i int, j int, level boolean"), 6, 5)
    got = {(r.page, r.net): (r.cost, r.path) for r in found.collect()}
    assert got == want and any(c is None for c, _ in want.values())
    cells = [(r.at, r.i, r.j) for r in routing.cells(found, requests).collect()]
    assert {(n, *a[4:]) for a in asks for n in [len(want[a[:2]][1] or "")] if want[a[:2]][1] is not None} <= set(cells)


# --- packing --------------------------------------------------------------------------------------------------------


def test_packing(spark):
    rng = random.Random(4)
    blocks = [(page, k, rng.random() < 0.3, float(rng.randint(10, 70)), float(rng.randint(5, 60))) for page in range(40) for k in range(rng.randint(1, 9))]
    rows = spark.createDataFrame(blocks, "page int, idx int, heading boolean, w double, h double")
    kept = packing.kept_with_next(rows, 3.0)
    for r in kept.collect():
        own = [b for b in blocks if b[0] == r.page and b[1] in [m.idx for m in r.members]]
        assert all(b[2] for b in own[:-1]) and [m.idx for m in r.members] == list(range(own[0][1], own[-1][1] + 1))
        assert r.h == sum(b[4] for b in own) + 3 * (len(own) - 1) and r.w == max(b[3] for b in own)
    sizes = {(r.page, r.idx): (r.w, r.h) for r in kept.collect()}
    places, lost = {}, set()
    for r in packing.layouts(kept, 160.0, 130.0, 4.0, 6.0, 5.0).collect():
        if r.attempt is None:
            lost.add(r.page)
        else:
            w, h = (v * r.scale for v in sizes[r.page, r.idx])
            places.setdefault(r.page, []).append((r.x, r.y, r.x + w, r.y + h))
            assert r.x >= 2.5 and r.x + w <= 160 * packing.BOARDS[(r.attempt >= 6) + (r.attempt >= 9)] - 2.5
    for own in places.values():
        assert all(a[2] <= b[0] or b[2] <= a[0] or a[3] <= b[1] or b[3] <= a[1] for k, a in enumerate(own) for b in own[:k])
    assert set(places) | lost == set(range(40)) and len(places) > 25


# --- shapes ---------------------------------------------------------------------------------------------------------


def test_wires_touch_their_symbols(spark):
    boxes = spark.createDataFrame([(k, kind, 10.0, 20.0, 50.0, 40.0) for k, kind in enumerate(symbols.GATES)], "id int, kind string, l double, t double, r double, b double")
    ports = {(r.id, r.port): (r.x, r.y) for r in symbols.gate_ports(boxes).collect()}
    points = {}
    for r in symbols.gate_outlines(boxes, "id").collect():
        points.setdefault(r.id, []).append((r.x, r.y))
    assert len(ports) == 22
    for (k, port), (x, y) in ports.items():
        near = min(abs(x - a) + abs(y - b) for a, b in points[k])
        assert near < 1e-9 or boxes.collect()[k].kind in ("and2", "nand2", "not", "buf") and port != "y"
    rows = [(k, kind, 3.0, 4.0, 30.0, 40.0, 1.0) for k, kind in enumerate(symbols.COMPONENTS)]
    placed = spark.createDataFrame(rows, "id int, kind string, ax double, ay double, bx double, by double, size double")
    drawn = symbols.component_outlines(placed, "id").collect()
    for p in symbols.component_ports(placed).collect():
        assert p.kind == "terminal" or any(abs(p.x - r.x) + abs(p.y - r.y) < 1e-9 for r in drawn if r.id == p.id)
    with pytest.raises(Exception, match="no length"):
        symbols.component_outlines(placed.withColumn("bx", F.col("ax")).withColumn("by", F.col("ay")), "id").collect()


def test_edit_script_in_sql(spark):
    evaluation.register_edit_script(spark)
    rows = [("a", ["x", "y"], ["x", "z"]), ("b", [], ["k"]), ("c", ["q"], []), ("d", None, ["w"]), ("e", ["s"], ["s"])]
    pairs = spark.createDataFrame(rows, "id string, read array<string>, label array<string>")
    got = sorted(map(tuple, spark.sql("SELECT * FROM edit_script(TABLE(SELECT * FROM {p}) PARTITION BY id)", p=pairs).collect()))
    assert got == [("a", 1, "sub", "z", "y"), ("b", 1, "drop", "k", None), ("c", 1, "add", None, "q")]


def test_models_keep_the_codec(spark):
    strokes = spark.createDataFrame([([[(1.0, 2.0)], [(3.0, 4.0), (5.0, 6.0)]],)], "s array<array<struct<x:double,y:double>>>")
    assert pa.array(strokes.select(codec.tokenize(F.col("s")).alias("t")).first().t).to_pylist()[0] == 450
