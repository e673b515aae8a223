"""Readers and writers: ink JSON, InkML, annotations, OCR rows, SVG, corpora."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

INK_JSON = "struct<strokes:array<struct<points:array<array<double>>>>>"
INKML = "traceFormat struct<channel:array<struct<_name:string>>>, trace array<struct<_VALUE:string,_id:string,_brushRef:string>>, annotation array<struct<_VALUE:string,_type:string>>"


def _decimal(v: Column, pattern: str) -> Column:
    return F.call_function("format_number", v, F.lit(pattern))


def strokes_from_json(text: Column) -> Column:
    """Ink JSON as array<array<struct<x, y>>>; null if the text can't be read."""
    ink = F.from_json(text, INK_JSON)
    return F.transform(ink["strokes"], lambda s: F.transform(s["points"], lambda p: F.struct(F.get(p, 0).alias("x"), F.get(p, 1).alias("y"))))


def strokes_to_json(strokes: Column) -> Column:
    return F.to_json(F.struct(F.transform(strokes, lambda s: F.struct(F.transform(s, lambda p: F.array(p["x"], p["y"])).alias("points"))).alias("strokes")))


def read_ink_results(spark: SparkSession, path: str) -> DataFrame:
    """A file or folder of results, each a JSON document: ``text, used_fallback, strokes``."""
    rows = spark.read.text(path, wholetext=True)
    doc = F.from_json("value", f"struct<ink:{INK_JSON},text:string,used_fallback:boolean>")
    return rows.select(doc.alias("d")).select("d.text", "d.used_fallback", F.transform(F.col("d.ink.strokes"), lambda s: F.transform(s["points"], lambda p: F.struct(F.get(p, 0).alias("x"), F.get(p, 1).alias("y")))).alias("strokes"))


def result_at(rows: DataFrame, column: str = "value", index: int = 0) -> DataFrame:
    """Add ``strokes``, ``image`` and ``error`` to JSON texts: an ink, a result that holds one, or a list of results, of which the one at ``index`` counts.

    ``image`` is the result's, where it is a text.  Where there is no ink,
    strokes are null and ``error`` says why: ``invalid JSON``, ``index out of
    range``, ``no object``, ``no strokes`` or ``invalid ink``; null texts are
    invalid JSON.
    """
    is_a = lambda c, kind: F.coalesce(F.expr(f"startswith(schema_of_variant({c}), '{kind}')"), F.lit(False))
    out = rows.withColumn("__v", F.try_parse_json(column))
    listed = is_a("__v", "ARRAY")
    out = out.withColumn("__far", listed & (F.lit(index < 0) | (F.coalesce(F.json_array_length(column), F.lit(0)) <= index)))
    out = out.withColumn("__e", F.when(listed, F.expr(f"try_variant_get(__v, '$[{max(index, 0)}]', 'variant')")).otherwise(F.col("__v")))
    holds = is_a("__e", "OBJECT") & F.array_contains(F.json_object_keys(F.to_json("__e")), "ink")
    out = out.withColumn("__r", F.when(holds, F.expr("try_variant_get(__e, '$.ink', 'variant')")).otherwise(F.col("__e")))
    strokes = F.expr("try_variant_get(__r, '$.strokes', 'array<struct<points:array<array<double>>>>')")
    strokes = F.transform(strokes, lambda s: F.transform(s["points"], lambda p: F.struct(F.get(p, 0).alias("x"), F.get(p, 1).alias("y"))))
    image = F.when(holds & is_a("try_variant_get(__e, '$.image', 'variant')", "STRING"), F.expr("try_variant_get(__e, '$.image', 'string')"))
    out = out.withColumns({"strokes": strokes, "image": image})
    whole = F.forall("strokes", lambda s: s.isNotNull() & F.forall(s, lambda p: p["x"].isNotNull() & p["y"].isNotNull()))
    named = is_a("__r", "OBJECT") & F.coalesce(F.array_contains(F.json_object_keys(F.to_json("__r")), "strokes"), F.lit(False))
    error = (
        F.when(F.col("__v").isNull(), "invalid JSON").when(F.col("__far"), "index out of range").when(~is_a("__e", "OBJECT"), "no object")
        .when(~named, "no strokes").when(~F.coalesce(whole, F.lit(False)), "invalid ink")
    )
    out = out.withColumn("error", error).withColumn("strokes", F.when(F.col("error").isNull(), F.col("strokes")))
    return out.drop("__v", "__far", "__e", "__r")


def read_inkml(spark: SparkSession, path: str) -> DataFrame:
    """InkML files -> ``file, trace_id, brush, seq, x, y, t``; time is null where the format has two channels.

    Raises on difference encoding (values led by quotes), which needs the values before.
    """
    rows = spark.read.format("xml").option("rowTag", "trace").schema("_VALUE string, _id string, _brushRef string").load(path)
    rows = rows.select(F.col("_metadata.file_path").alias("file"), F.col("_id").alias("trace_id"), F.col("_brushRef").alias("brush"), F.posexplode(F.split(F.trim("_VALUE"), r"\s*,\s*")).alias("seq", "point"))
    point = F.when(F.col("point").rlike("['\"*!]"), F.raise_error(F.lit("difference encoding isn't supported"))).otherwise(F.split("point", r"\s+"))
    at = lambda k: F.get(point, k).cast("double")
    return rows.select("file", "trace_id", "brush", "seq", at(0).alias("x"), at(1).alias("y"), at(2).alias("t"))


def read_inkml_labels(spark: SparkSession, path: str) -> DataFrame:
    """``file, type, value`` of the annotations of InkML files."""
    rows = spark.read.format("xml").option("rowTag", "annotation").schema("_VALUE string, _type string").load(path)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_type").alias("type"), F.trim("_VALUE").alias("value"))


def inkml(traces: DataFrame) -> DataFrame:
    """``traces(page, trace_id, seq, x, y, t)`` -> ``page, xml``: one document for each page."""
    point = F.concat_ws(" ", *(_decimal(F.col(c), "0.####") for c in "xyt"))
    lines = traces.groupBy("page", "trace_id").agg(F.array_join(F.sort_array(F.collect_list(F.struct("seq", point.alias("p"))))["p"], ", ").alias("v"))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("trace_id", "v"))), lambda s: F.concat(F.lit('<trace id="'), s["trace_id"].cast("string"), F.lit('">'), s["v"], F.lit("</trace>"))), "\n")
    head = '<ink xmlns="http://www.w3.org/2003/InkML">\n<traceFormat><channel name="X"/><channel name="Y"/><channel name="T"/></traceFormat>\n'
    return lines.groupBy("page").agg(F.concat(F.lit(head), body, F.lit("\n</ink>")).alias("xml"))


def svg(strokes: Column, margin: float = 8.0) -> Column:
    """An SVG document: paths for strokes, circles for single points, a view box with a margin."""
    each = F.flatten(strokes)
    side = lambda f, k: F.coalesce(f(F.transform(each, lambda p: p[k])), F.lit(0.0))
    x0, y0 = side(F.array_min, "x") - margin, side(F.array_min, "y") - margin
    w, h = side(F.array_max, "x") + margin - x0, side(F.array_max, "y") + margin - y0
    n = lambda v: _decimal(v, "0.##")
    xy = lambda p: F.concat(n(p["x"]), F.lit(" "), n(p["y"]))

    def shape(s: Column) -> Column:
        dot = F.concat(F.lit('<circle r="1" cx="'), n(s[0]["x"]), F.lit('" cy="'), n(s[0]["y"]), F.lit('"/>'))
        return F.when(F.size(s) == 1, dot).otherwise(F.concat(F.lit('<path fill="none" stroke="black" d="M '), F.array_join(F.transform(s, xy), " L "), F.lit('"/>')))

    body = F.array_join(F.transform(F.filter(strokes, lambda s: F.size(s) > 0), shape), "")
    return F.concat(F.lit('<svg xmlns="http://www.w3.org/2000/svg" viewBox="'), n(x0), F.lit(" "), n(y0), F.lit(" "), n(w), F.lit(" "), n(h), F.lit('">'), body, F.lit("</svg>"))


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """Detection annotations (XML) -> ``file, id, name, l, t, r, b, label``; symbols without bounds go. The label is a text's meaning, and a shape's own kind."""
    schema = "_id string, _name string, bounds struct<_x:double,_y:double,_width:double,_height:double>, textMeaning string"
    rows = spark.read.format("xml").option("rowTag", "symbol").schema(schema).load(path).filter("bounds is not null")
    edge = lambda at, size: (F.col(f"bounds.{at}") + F.col(f"bounds.{size}"))
    label = F.when(F.col("_name") == "text", F.trim(F.coalesce("textMeaning", F.lit("")))).otherwise(F.col("_name"))
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_id").alias("id"), F.col("_name").alias("name"), F.col("bounds._x").alias("l"), F.col("bounds._y").alias("t"),
                       edge("_x", "_width").alias("r"), edge("_y", "_height").alias("b"), label.alias("label"))


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    """OCR rows of strings, tab-separated with a header; see ``operators.spatial.text_rows``."""
    return spark.read.option("sep", "\t").option("header", True).option("quote", "").csv(path)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Content documents (JSON) -> ``page_id, ord, element_id, type, element`` with the element as JSON text."""
    rows = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("doc"))
    rows = rows.select(F.variant_get("doc", "$.page_id", "string").alias("page_id"), F.posexplode(F.variant_get("doc", "$.elements", "array<variant>")).alias("ord", "e"))
    return rows.select("page_id", "ord", F.variant_get("e", "$.id", "string").alias("element_id"), F.variant_get("e", "$.type", "string").alias("type"), F.to_json("e").alias("element"))


def read_layout_items(spark: SparkSession, path: str) -> DataFrame:
    """Layout documents (JSON) -> ``file, leaf, kind, role, element, writer, text, row, col, bbox``; ``row`` stays text as it may be a word."""
    item = "struct<kind:string,role:string,element:string,writer:string,text:string,row:string,col:int,bbox:array<double>>"
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.from_json("value", f"struct<items:map<string,{item}>,writing_order:array<string>>").alias("d"))
    return rows.select("file", F.explode("d.items").alias("leaf", "i")).select("file", "leaf", "i.*")


def read_writing_order(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.from_json("value", "struct<writing_order:array<string>>").alias("d"))
    return rows.select("file", F.posexplode("d.writing_order").alias("place", "leaf"))


def write_corpus(lines: DataFrame, path: str) -> None:
    """Lines as Parquet by split and shard; only the shards that are written are replaced, so a restart resumes."""
    lines.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("split", "shard").parquet(path)


def read_corpus(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    rows = spark.read.parquet(path)
    return rows if split is None else rows.filter(F.col("split") == split)


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """``path, sha256`` of files."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))
