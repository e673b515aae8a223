"""Readers and writers on small files."""

import json

import pytest
from pyspark.sql import functions as F

from scriptorium.operators import augment, corpus, spatial
from scriptorium.sources import documents
from scriptorium.sources import ink as source


def test_ink_results(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"text": "x", "used_fallback": False, "ink": {"strokes": [{"points": [[1, 2], [3, 4]]}]}}, indent=1))
    r = source.read_ink_results(spark, str(tmp_path / "a.json")).first()
    assert r.text == "x" and [(p.x, p.y) for p in r.strokes[0]] == [(1, 2), (3, 4)]


ANNOTATION = """<doc><symbols>
<symbol id="s1" name="process"><bounds x="1" y="2" width="10" height="5"/></symbol>
<symbol id="s2" name="decision"><bounds x="90" y="2" width="40" height="5"/></symbol>
<symbol id="t1" name="text"><bounds x="3" y="3" width="2" height="1"/><textMeaning> Start </textMeaning></symbol>
<symbol id="t2" name="text"><bounds x="30" y="3" width="2" height="1"/><textMeaning>yes</textMeaning></symbol>
<symbol id="none" name="text"/></symbols>
<relations><relation name="arrow_label"><symbolView symbolDataRef="t2"/><symbolView symbolDataRef="a1"/></relation>
<relation name="arrow_connection"><symbolView symbolDataRef="a1"/><symbolView symbolDataRef="s1"/><symbolView symbolDataRef="s2"/></relation>
<relation name="arrow_connection"><symbolView symbolDataRef="a1"/><symbolView symbolDataRef="s1"/><symbolView symbolDataRef="t1"/></relation></relations></doc>"""


def test_annotations(spark, tmp_path):
    (tmp_path / "a.xml").write_text(ANNOTATION)
    symbols, relations = source.read_annotations(spark, str(tmp_path / "a.xml")), documents.read_relations(spark, str(tmp_path / "a.xml"))
    got = {r.id: (r.name, r.l, r.t, r.r, r.b, r.label) for r in symbols.collect()}
    assert got["s1"] == ("process", 1, 2, 11, 7, "process") and got["t1"][-1] == "Start" and set(got) == {"s1", "s2", "t1", "t2"}
    crops = {r.id: tuple(r.crop) for r in documents.crop_regions(symbols, relations, 0.1, 2.0, 100.0, 50.0).collect()}
    assert crops == {"s1": (0, 0, 13, 9), "s2": (86, 0, 100, 11), "t2": (28, 1, 34, 6)}
    flow = documents.flow_constraints(symbols.filter("name != 'text'"), relations).collect()
    assert [(r.before, r.after) for r in flow] == [("s1", "s2")]


def test_inkml_groups(spark, tmp_path):
    note = lambda k, v: f'<annotation type="{k}">{v}</annotation>'
    unit = f'<traceGroup>{note("label", "a")}<traceView traceDataRef="#t0"/><traceView traceDataRef="#t1"/></traceGroup>'
    group = f'<traceGroup>{note("element_id", "x.l1")}{note("kind", "text")}{note("element", "x")}{unit}</traceGroup>'
    (tmp_path / "g.inkml").write_text(f'<ink xmlns="http://www.w3.org/2003/InkML"><trace xml:id="t0">1 2 0</trace><traceGroup>{group}</traceGroup></ink>')
    got = documents.read_inkml_groups(spark, str(tmp_path / "g.inkml")).collect()
    assert sorted(tuple(r)[1:] for r in got) == [("x.l1", "text", "", "x", 0, "a", "t0"), ("x.l1", "text", "", "x", 0, "a", "t1")]


def test_svg_font(spark, tmp_path):
    glyphs = '<glyph unicode="I" horiz-adv-x="300" d="M1 0L1 7"/><glyph unicode="U" d="M 0 0 C 0 2 4 2 4 0"/><glyph unicode="fi" d="M0 0L1 1"/><glyph unicode="." d="M5 5"/>'
    (tmp_path / "f.svg").write_text(f'<svg xmlns="http://www.w3.org/2000/svg"><defs><font horiz-adv-x="400">{glyphs}</font></defs></svg>')
    got = {r.ch: r for r in documents.read_svg_glyphs(spark, str(tmp_path / "f.svg")).collect()}
    assert set(got) == {"I", "U", "."} and got["I"].advance == 300 and got["U"].advance == 400 and got["."].strokes == []
    assert [tuple(p) for p in got["I"].strokes[0]] == [(1, 0), (1, 7)] and len(got["U"].strokes[0]) == 9 and tuple(got["U"].strokes[0][4]) == (2, 1.5)
    with pytest.raises(ValueError):
        documents.glyph_strokes("M0 0 Q 1 1 2 2")


def test_strings_reports_lists(spark, tmp_path):
    texts = ['{"a": ["x\\n y ", {"b": "' + "z" * 51 + '"}], "n": 1, "key": null}', "not json", None, '"top"', "[" * 30 + '"deep"' + "]" * 30, '["x", "x"]', "[]", "7"]
    df = spark.createDataFrame(list(enumerate(texts)), "key int, t string")
    got = sorted(map(tuple, documents.json_lines(df, "key", "t").collect()))
    assert got == [(0, "x"), (0, "y"), (3, "top"), (4, "deep"), (5, "x")]
    html = documents.html_report(spark.createDataFrame([("<b>", None)], "a string, b int"), "a", "b").first().html
    assert html == "<table><tr><th>a</th><th>b</th></tr><tr><td>&lt;b&gt;</td><td></td></tr></table>"
    results = spark.createDataFrame([("p", "a", []), ("p", "b", [str(i) for i in range(12)])], "page string, file string, problems array<string>")
    row = documents.manifest(results).first()
    assert row.renders == ["a"] and [(r.file, len(r.problems)) for r in row.rejected] == [("b", 10)]
    documents.write_json(results, str(tmp_path / "j"), "page")
    documents.write_json(results, str(tmp_path / "j"), "page", mode="append")
    assert spark.read.json(str(tmp_path / "j")).count() == 4
    documents.write_lines(spark.createDataFrame([("a b",), ("",)], "line string"), str(tmp_path / "l"))
    assert [r.line for r in documents.read_lines(spark, str(tmp_path / "l")).collect()] == ["a b"]


def test_held_out_lines_stop(spark):
    lines = spark.createDataFrame([("train", 1), ("test", 2)], "split string, k int")
    assert corpus.only_for_training(lines.filter("k = 1")).count() == 1
    with pytest.raises(Exception, match="held-out"):
        corpus.only_for_training(lines).collect()


def test_writing_steps(spark):
    cases = {
        1: ("abcd", [(1, "xy", "strike", None)]), 2: ("abcd", [(1, "x", "overwrite", 2), (2, "q", "strike", None)]), 3: ("ab", [(1, "first", "strike", None), (1, "z", "scribble", None), (7, "w", "strike", None)]),
        4: ("ab", None), 5: (None, []), 6: ("abc", [(1, "pqr", "overwrite", None)]), 7: ("abc", [(0, "", "strike", None)]),
    }
    rows = spark.createDataFrame([(k, *v) for k, v in cases.items()], "id int, text string, fixes array<struct<index:int,wrong:string,style:string,replace:int>>")
    plans = {}
    for r in augment.writing_steps(rows).orderBy("id", "step").collect():
        plans.setdefault(r.id, []).append(r)
    plan, over = plans[1], plans[2]
    assert [s.ch for s in plan] == ["a", "x", "y", None, "b", "c", "d"] and (plan[3].first, plan[3].last) == (1, 2)
    assert [(s["at"], s.over) for s in over] == [(0, None), (None, None), (1, 1), (2, None), (3, None)]
    assert [(s.kind, s.ch) for s in plans[3]] == [("char", "a"), ("char", "z"), ("scribble", None), ("char", "b")]
    assert [s.ch for s in plans[4]] == ["a", "b"] and 5 not in plans
    assert [(s["at"], s.over, s.deleted) for s in plans[6]] == [(0, None, False), (None, None, True), (None, None, True), (None, None, True), (1, 1, False), (2, 2, False)]
    assert (plans[7][0].first, plans[7][0].last) == (0, -1)


def test_ocr_rows(spark, tmp_path):
    rows = ["left\ttop\twidth\theight\tconf\ttext", "10\t20\t30\t12\t92.5\tStart", "10\t20\t30\t12\t5\tlow", "a\t20\t30\t12\t90\tbad", "1\t1\t0\t5\t90\tflat", '1\t1\t4\t5\t90\t"'] 
    (tmp_path / "a.tsv").write_text("\n".join(rows) + "\n")
    got = spatial.text_rows(source.read_tsv(spark, str(tmp_path / "a.tsv"))).orderBy("l").collect()
    assert [tuple(r) for r in got] == [(1, 1, 5, 6, 90, '"'), (10, 20, 40, 32, 92.5, "Start")]


def test_documents(spark, tmp_path):
    page = {"page_id": "p", "elements": [{"id": "t1", "type": "text", "text": "hi"}, {"id": "m", "type": "math", "latex": "x"}]}
    (tmp_path / "page.json").write_text(json.dumps(page, indent=1))
    got = source.read_pages(spark, str(tmp_path / "page.json")).orderBy("ord").collect()
    assert [(r.page_id, r.ord, r.element_id, r.type) for r in got] == [("p", 0, "t1", "text"), ("p", 1, "m", "math")] and json.loads(got[0].element)["text"] == "hi"
    layout = {"items": {"a": {"kind": "text", "role": "cell", "row": "header", "col": 1, "bbox": [0, 1, 2, 3]}, "b": {"kind": "dot", "row": 2}}, "writing_order": ["b", "a"]}
    (tmp_path / "layout.json").write_text(json.dumps(layout))
    items = {r.leaf: r for r in source.read_layout_items(spark, str(tmp_path / "layout.json")).collect()}
    assert items["a"].row == "header" and items["b"].row == "2" and items["a"].bbox == [0, 1, 2, 3]
    order = source.read_writing_order(spark, str(tmp_path / "layout.json")).orderBy("place").collect()
    assert [r.leaf for r in order] == ["b", "a"]


def test_inkml_round_trip(spark, tmp_path):
    rows = [("p", 1, 0, 1.5, 2.0, 0.0), ("p", 1, 1, 3.0, 4.25, 0.5), ("p", 2, 0, 9.0, 9.0, 1.0)]
    xml = source.inkml(spark.createDataFrame(rows, "page string, trace_id long, seq int, x double, y double, t double")).first().xml
    (tmp_path / "a.inkml").write_text(xml)
    back = source.read_inkml(spark, str(tmp_path / "a.inkml")).orderBy("trace_id", "seq").collect()
    assert [(int(r.trace_id), r.seq, r.x, r.y, r.t) for r in back] == [r[1:] for r in rows]


def test_corpus(spark, tmp_path):
    lines = spark.createDataFrame([("train", 0, "a"), ("valid", 1, "b")], "split string, shard int, text string")
    source.write_corpus(lines, str(tmp_path / "c"))
    source.write_corpus(lines.filter("shard = 1").withColumn("text", F.lit("new")), str(tmp_path / "c"))
    assert {(r.split, r.text) for r in source.read_corpus(spark, str(tmp_path / "c")).collect()} == {("train", "a"), ("valid", "new")}
    assert source.read_corpus(spark, str(tmp_path / "c"), "valid").count() == 1
    (tmp_path / "f").write_bytes(b"abc")
    assert source.checksums(spark, str(tmp_path / "f")).first().sha256.startswith("ba7816bf")
