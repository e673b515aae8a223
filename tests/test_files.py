"""Ink files as data sources, and pen states of streams that are out of order."""

import datetime
import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from scriptorium.sources import datasource
from scriptorium.streaming import tracking

INK = """<ink xmlns="http://www.w3.org/2003/InkML"><annotation type="truth"> a &lt; b </annotation>
<traceFormat><channel name="T"/><channel name="F"/><channel name="Y"/><channel name="X"/></traceFormat>
<trace id="t0" brushRef="#p">1 0 20 10, 2 0 21 11</trace><trace id="t1">3 0 22 12</trace><trace id="t2"> </trace>
<traceGroup><traceGroup><annotation type="element_id">leaf</annotation><annotation type="kind">glyph</annotation><annotation type="element">e</annotation>
<traceGroup><annotation type="label">A</annotation><traceView traceDataRef="#t0"/><traceView traceDataRef="#t2"/></traceGroup></traceGroup></traceGroup></ink>"""


def test_groups_and_channels_are_read(spark, tmp_path):
    (tmp_path / "a.inkml").write_text(INK)
    (tmp_path / "b.inkml").write_text('<ink><trace id="x">1 2, 3 4</trace></ink>')
    (tmp_path / ".c.inkml").write_text("unfinished")
    rows = datasource.read_ink_documents(spark, str(tmp_path)).orderBy("file", "trace_id", "seq").collect()
    assert [(r.file, r.trace_id, r.seq, r.x, r.y, r.t, r.leaf, r.label, r.brush) for r in rows] == [
        ("a.inkml", "t0", 0, 10, 20, 1, "leaf", "A", "p"), ("a.inkml", "t0", 1, 11, 21, 2, "leaf", "A", "p"), ("a.inkml", "t1", 0, 12, 22, 3, None, None, None),
        ("b.inkml", "x", 0, 1, 2, None, None, None, None), ("b.inkml", "x", 1, 3, 4, None, None, None, None),
    ]
    assert rows[0].notes == {"truth": "a < b"} and rows[0].role == "" and rows[-1].notes == {}
    reader = datasource.InkmlReader(str(tmp_path), 10)
    assert [len(p.paths) for p in reader.partitions()] == [1, 1]


@pytest.mark.parametrize("body,said", [
    ('<trace id="a">1 2, \'3 4</trace>', "difference"), ('<traceFormat><channel name="X"/></traceFormat><trace id="a">1</trace>', "no X and Y"), ('<trace id="a">1</trace>', "1 of 2 values"),
    ('<trace id="a">1 2</trace><traceGroup><traceGroup><traceGroup><traceView traceDataRef="#b"/></traceGroup></traceGroup></traceGroup>', "unknown traces"),
])
def test_what_cannot_be_read(spark, tmp_path, body, said):
    (tmp_path / "a.inkml").write_text(f"<ink>{body}</ink>")
    with pytest.raises(Exception, match=said):
        datasource.read_ink_documents(spark, str(tmp_path)).collect()


def test_a_failed_run_leaves_no_shard_and_a_restart_goes_on(spark, tmp_path):
    at = str(tmp_path / "corpus")
    lines = spark.range(100).select("id", (F.col("id") % 5).cast("int").alias("shard"))
    datasource.write_shards(lines.filter("shard < 2"), at)
    before = {f: os.stat(f"{at}/{f}").st_mtime_ns for f in os.listdir(at)}
    assert sorted(before) == ["shard-00000.parquet", "shard-00001.parquet"]
    broken = lines.withColumn("id", F.when(F.col("id") == 98, F.raise_error(F.lit("broken")).cast("long")).otherwise(F.col("id")))
    with pytest.raises(Exception, match="broken"):
        datasource.write_shards(broken, at)
    assert {f: os.stat(f"{at}/{f}").st_mtime_ns for f in os.listdir(at)} == before
    datasource.write_shards(lines, at)
    assert sorted(os.listdir(at)) == [f"shard-{k:05d}.parquet" for k in range(5)]
    assert all(os.stat(f"{at}/{f}").st_mtime_ns == t for f, t in before.items())
    assert sorted(map(tuple, spark.read.parquet(at).collect())) == sorted((i, i % 5) for i in range(100))


def test_documents_are_written_once(spark, tmp_path):
    at = str(tmp_path / "docs")
    rows = spark.createDataFrame([("a", "<ink/>"), ("b", INK)], "name string, xml string")
    datasource.write_ink_documents(rows, at)
    datasource.write_ink_documents(rows.withColumn("xml", F.lit("new")), at)
    assert sorted(os.listdir(at)) == ["a.inkml", "b.inkml"] and (tmp_path / "docs" / "a.inkml").read_text() == "<ink/>"


# --- streams --------------------------------------------------------------------------------------------------------


def test_followed_by_hand():
    rows = pd.DataFrame({"seq": range(7), "code": [1, 0, 4, 0, 1, 12, 5]})
    out = tracking.followed(rows, 0, 0, False)
    assert out.status.tolist() == ["bad pen", "ok", "ok", "bad pen", "ok", "bad code", "ok"]
    assert out.down.tolist() == [False, True, True, True, False, False, False] and out.x.tolist() == [0, 0, 1, 1, 1, 1, 2]


def test_a_stream_out_of_order(spark, tmp_path):
    tracking.use_provider(spark)
    clock = datetime.datetime(2024, 1, 1)

    def batch(n, rows):
        spark.createDataFrame([(w, s, c, clock + datetime.timedelta(minutes=m)) for w, s, c, m in rows], "writer long, seq long, code int, ts timestamp").coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
        stream = spark.readStream.schema("writer long, seq long, code int, ts timestamp").option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
        run = tracking.pen_states(stream, "10 minutes", 600_000).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        run.awaitTermination()
        return sorted((r.writer, r.seq, r.x, r.down, r.status) for r in spark.read.schema(tracking.STATES).parquet(f"{tmp_path}/out").collect())

    assert batch(1, [(1, 0, 0, 0), (1, 2, 1, 0), (2, 0, 4, 0)]) == [(1, 0, 0, True, "ok"), (2, 0, 1, False, "ok")]
    # the missing row comes after a restart, and what waited for it goes on; a number that comes twice is late
    assert batch(2, [(1, 1, 4, 1), (2, 0, 4, 1)])[1:4] == [(1, 1, 1, True, "ok"), (1, 2, 1, False, "ok"), (2, 0, 1, False, "late")]
    batch(3, [(1, 5, 4, 2)])
    got = batch(4, [(3, 0, 0, 60)])  # time goes on, so the gap before 5 is given up
    got = batch(5, [(3, 1, 4, 61), (1, 3, 0, 61)])
    assert (1, 5, 2, False, "ok") in got and (1, 3, 2, False, "late") in got and (3, 1, 1, True, "ok") in got
