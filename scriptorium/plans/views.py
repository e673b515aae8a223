"""Ink, box and pen views over the driver's tables, in Spark and as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.lineage import dealt

#: Boxes of a task, about.
BOX_ROWS = 250_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ink_id, stroke_id 0-3, point_id 0-7, x, y: four strokes of each vector."""
    p = F.explode(F.sequence(F.lit(0), F.lit(31)))
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("ink_id"), "embedding", p.alias("p"))
    at = lambda k: F.get("embedding", F.col("p") * 2 + k).cast("double") * 300 + 112
    return rows.select("ink_id", F.expr("p div 8").cast("int").alias("stroke_id"), F.expr("p % 8").cast("int").alias("point_id"), at(0).alias("x"), at(1).alias("y"))


def inks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ink_id, strokes array<array<struct<x, y>>>: the same, a row for each ink, without a shuffle."""
    return inks_of(table(spark, sf_dir, "embeddings"))


def inks_of(vectors: DataFrame, *more: str) -> DataFrame:
    """``inks`` of rows ``vec_id, embedding``, with the columns ``more``."""
    xy = lambda s, q: F.struct(*((F.get("embedding", s * 16 + q * 2 + k).cast("double") * 300 + 112).alias(n) for k, n in enumerate("xy")))
    strokes = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda s: F.transform(F.sequence(F.lit(0), F.lit(7)), lambda q: xy(s, q)))
    return vectors.select(*more, F.col("vec_id").alias("ink_id"), strokes.alias("strokes"))


def pen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """writer, t (microseconds), x, y: the events as pen samples."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("writer"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), F.col("value").alias("x"), F.get_json_object("props", "$.k").cast("double").alias("y")
    )


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page, idx, l, t, r, b, score, label: the lines of an order as boxes of a page."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate")
    rows = dealt(table(spark, sf_dir, "lineitem"), BOX_ROWS, "l_orderkey").withColumn("idx", F.row_number().over(w))
    left, top = (F.col("l_partkey") % 40).cast("double"), (F.col("l_suppkey") % 20).cast("double")
    return rows.select(
        F.col("l_orderkey").alias("page"), "idx", left.alias("l"), top.alias("t"), (left + 20 + F.col("l_quantity")).alias("r"), (top + 30 + F.col("l_linenumber") * 5).alias("b"),
        F.col("l_discount").alias("score"), F.concat("l_returnflag", "l_linestatus").alias("label"),
    )


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The boxes as page items, with ``pos``: their place in writing order, from the top."""
    return boxes(spark, sf_dir).withColumn("pos", F.row_number().over(Window.partitionBy("page").orderBy("t", "l", "idx")))


SQL = {
    "v_ink": """SELECT vec_id AS ink_id, (p // 8)::INT AS stroke_id, (p % 8)::INT AS point_id, embedding[2 * p + 1]::DOUBLE * 300::DOUBLE + 112::DOUBLE AS x, embedding[2 * p + 2]::DOUBLE * 300::DOUBLE + 112::DOUBLE AS y
        FROM embeddings, (SELECT unnest(range(32)) AS p)""",
    "v_pen": "SELECT user_id AS writer, epoch_us(ts) AS t, value AS x, (props::JSON->>'$.k')::DOUBLE AS y FROM events",
    "v_box": """SELECT l_orderkey AS page, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_shipdate) AS idx,
        (l_partkey % 40)::DOUBLE AS l, (l_suppkey % 20)::DOUBLE AS t, (l_partkey % 40)::DOUBLE + 20 + l_quantity AS r, (l_suppkey % 20)::DOUBLE + 30 + l_linenumber * 5 AS b,
        l_discount AS score, l_returnflag || l_linestatus AS label FROM lineitem""",
    "v_item": "SELECT *, row_number() OVER (PARTITION BY page ORDER BY t, l, idx) AS pos FROM v_box",
}


def with_views(sql: str, *names: str) -> str:
    """SQL with the named views before it; a WITH of its own is joined on."""
    head = ", ".join(f"{n} AS ({SQL[n]})" for n in names)
    body = sql.strip()
    recursive = body.startswith("WITH RECURSIVE")
    if body.startswith("WITH"):
        rest = body.removeprefix("WITH RECURSIVE").removeprefix("WITH")
        return f"WITH {'RECURSIVE ' if recursive else ''}{head}, {rest.strip()}"
    return f"WITH {head} {body}"
