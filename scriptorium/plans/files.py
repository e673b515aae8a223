"""Queries that write files into the shared folder and read them again."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.lineage import shared_folder
from ..sources import datasource
from ..streaming import tracking
from . import views
from .queries import query
from .views import table


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/scriptorium/{name}-{uuid.uuid4().hex}"


def _note(kind: str, value: Column) -> Column:
    return F.concat(F.lit(f'<annotation type="{kind}">'), value, F.lit("</annotation>"))


def ink_documents(spark: SparkSession, d: str):
    """Every ink as an InkML document ``name, xml``: channels in two orders, a labelled group for each two strokes, a note, and one trace in no group."""
    text = lambda v: F.round(v, 3).cast("string")
    even = F.col("ink_id") % 2 == 0
    channel = lambda *names: "".join(f'<channel name="{n}"/>' for n in names)

    def trace(s: Column, k: Column) -> Column:
        point = lambda p, i: F.when(even, F.concat_ws(" ", text(p["x"]), text(p["y"]), (k * 100 + i).cast("string"))).otherwise(F.concat_ws(" ", (k * 100 + i).cast("string"), F.lit("0"), text(p["y"]), text(p["x"])))
        points = F.array_join(F.transform(s, point), ", ")
        return F.concat(F.lit('<trace id="t'), k.cast("string"), F.lit('" brushRef="#pen'), (k % 2).cast("string"), F.lit('">'), points, F.lit("</trace>"))

    def group(k: int) -> Column:
        label = F.concat(F.lit("a &amp; "), F.col("ink_id").cast("string"))
        views_ = F.lit(f'<traceView traceDataRef="#t{2 * k}"/>' + (f'<traceView traceDataRef="#t{2 * k + 1}"/>' if k == 0 else ""))
        return F.concat(F.lit("<traceGroup>"), _note("element_id", F.lit(f"leaf{k}")), _note("kind", F.lit("glyph")), _note("element", F.lit("e")), F.lit("<traceGroup>"), _note("label", label), views_, F.lit("</traceGroup></traceGroup>"))

    order = F.when(even, channel("X", "Y", "T")).otherwise(channel("T", "F", "Y", "X"))
    head = F.concat(F.lit('<ink xmlns="http://www.w3.org/2003/InkML"><traceFormat>'), order, F.lit("</traceFormat>"), _note("writer", (F.col("ink_id") % 5).cast("string")))
    body = F.concat(F.array_join(F.transform("strokes", trace), ""), F.lit("<traceGroup>"), group(0), group(1), F.lit("</traceGroup></ink>"))
    return views.inks(spark, d).select(F.format_string("ink%06d", "ink_id").alias("name"), F.concat(head, body).alias("xml"))


@query("""
SELECT printf('ink%06d.inkml', ink_id) AS file, (ink_id % 5)::VARCHAR AS writer, 't' || stroke_id AS trace_id, 'pen' || stroke_id % 2 AS brush, CASE stroke_id WHEN 0 THEN 'leaf0' WHEN 1 THEN 'leaf0' WHEN 2 THEN 'leaf1' END AS leaf,
  CASE WHEN stroke_id < 3 THEN 'a & ' || ink_id END AS label, count(*) AS points, round(sum(round(x, 3)), 3) AS x, round(sum(round(y, 3)), 3) AS y, max(stroke_id * 100 + point_id)::DOUBLE AS last_t
FROM v_ink GROUP BY ALL""", "v_ink")
def io6_documents(spark, d):
    """Ink documents written as files and read again: groups, notes, brushes, and channels in the order that each document names."""
    at = _folder(spark, "documents")
    datasource.write_ink_documents(ink_documents(spark, d), at)
    rows = datasource.read_ink_documents(spark, at)
    return rows.groupBy("file", F.col("notes")["writer"].alias("writer"), "trace_id", "brush", "leaf", "label").agg(
        F.count("*").alias("points"), F.round(F.sum("x"), 3).alias("x"), F.round(F.sum("y"), 3).alias("y"), F.max("t").alias("last_t")
    )


@query("SELECT (ink_id % 7)::INT AS shard, count(*) AS rows_, count(DISTINCT ink_id) AS inks, round(sum(x), 3) AS x, 1 AS files FROM v_ink GROUP BY ALL", "v_ink")
def io16_shards(spark, d):
    """Lines written as shards: some first, then all, as a run that is started again; finished shards are left as they are."""
    at = _folder(spark, "shards")
    lines = views.ink(spark, d).withColumn("shard", (F.col("ink_id") % 7).cast("int"))
    datasource.write_shards(lines.filter("shard < 3"), at)
    datasource.write_shards(lines, at)
    rows = spark.read.parquet(at).withColumn("file", F.col("_metadata.file_name"))
    return rows.groupBy("shard").agg(F.count("*").alias("rows_"), F.countDistinct("ink_id").alias("inks"), F.round(F.sum("x"), 3).alias("x"), F.countDistinct("file").cast("int").alias("files"))


@query("""
WITH c AS (
  SELECT user_id AS writer, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq, (event_id % 11)::INT AS code FROM events
), m AS (
  SELECT *, CASE code WHEN 3 THEN 1 WHEN 4 THEN 1 WHEN 5 THEN 1 WHEN 7 THEN -1 WHEN 8 THEN -1 WHEN 9 THEN -1 ELSE 0 END AS dx, CASE code WHEN 2 THEN -1 WHEN 3 THEN -1 WHEN 9 THEN -1 WHEN 5 THEN 1 WHEN 6 THEN 1 WHEN 7 THEN 1 ELSE 0 END AS dy,
    last_value(CASE WHEN code < 2 THEN code END IGNORE NULLS) OVER (PARTITION BY writer ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM c
)
SELECT writer, seq, sum(dx) OVER w::BIGINT AS x, sum(dy) OVER w::BIGINT AS y, CASE WHEN code < 2 THEN code = 0 ELSE coalesce(before = 0, false) END AS down,
  CASE WHEN code > 9 THEN 'bad code' WHEN code < 2 AND coalesce(before, 1) = code THEN 'bad pen' ELSE 'ok' END AS status
FROM m WINDOW w AS (PARTITION BY writer ORDER BY seq)""")
def st4_pen_states(spark, d):
    """The events as pen codes of their writers, streamed in three parts that are out of order, the stream started anew for each."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, d, "events").select(F.col("user_id").alias("writer"), (F.row_number().over(order) - 1).cast("long").alias("seq"), (F.col("event_id") % 11).cast("int").alias("code"), F.col("ts").cast("timestamp").alias("ts"))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("writer", "seq"), F.lit(3)))
    at = _folder(spark, "codes")
    rows.write.parquet(f"{at}/all")  # numbered once, not for each part
    rows = spark.read.parquet(f"{at}/all")
    tracking.use_provider(spark)
    for part in range(3):
        rows.filter(F.col("part") == part).drop("part").write.mode("append").parquet(f"{at}/in")
        stream = spark.readStream.schema("writer long, seq long, code int, ts timestamp").parquet(f"{at}/in")
        # a watermark as far back as the parts reach keeps rows from being late
        states = tracking.pen_states(stream, late="3650 days", patience_ms=86_400_000)
        run = states.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
        run.awaitTermination()
    return spark.read.schema(tracking.STATES).parquet(f"{at}/out")
