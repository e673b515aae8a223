"""Readers and writers around pages: grouped InkML, annotations' relations, SVG fonts, strings in JSON, reports, manifests, lists."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import Box
from ..operators.lineage import cut

_NOTES = "annotation array<struct<_VALUE:string,_type:string>>"
_GROUPS = f"traceGroup struct<traceGroup:array<struct<{_NOTES.replace(' ', ':', 1)},traceGroup:array<struct<{_NOTES.replace(' ', ':', 1)},traceView:array<struct<_traceDataRef:string>>>>>>>"


def _note(notes: Column, kind: str) -> Column:
    return F.trim(F.get(F.filter(notes, lambda a: a["_type"] == kind), F.lit(0))["_VALUE"])


def read_inkml_groups(spark: SparkSession, path: str) -> DataFrame:
    """Labelled groups of InkML files -> ``file, leaf, kind, role, element, unit, label, trace_id``; a row for each trace that a unit names."""
    rows = spark.read.format("xml").option("rowTag", "ink").schema(_GROUPS).load(path)
    rows = rows.select(F.col("_metadata.file_path").alias("file"), F.explode("traceGroup.traceGroup").alias("g"))
    about = [_note(F.col("g.annotation"), n).alias(out) for n, out in (("element_id", "leaf"), ("kind", "kind"), ("role", "role"), ("element", "element"))]
    rows = rows.select("file", *about, F.posexplode("g.traceGroup").alias("unit", "u"))
    return rows.select("file", "leaf", "kind", F.coalesce("role", F.lit("")).alias("role"), "element", "unit", _note(F.col("u.annotation"), "label").alias("label"), F.explode("u.traceView").alias("v")).select(
        "file", "leaf", "kind", "role", "element", "unit", "label", F.ltrim(F.col("v._traceDataRef"), F.lit("#")).alias("trace_id")
    )


def read_relations(spark: SparkSession, path: str) -> DataFrame:
    """Relations of detection annotations -> ``file, name, ids``: the symbols that each one joins, in order."""
    rows = spark.read.format("xml").option("rowTag", "relation").schema("_name string, symbolView array<struct<_symbolDataRef:string>>").load(path)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_name").alias("name"), F.col("symbolView._symbolDataRef").alias("ids"))


def crop_box(box: Box, share: float, least: float, width: Column | float, height: Column | float) -> Column:
    """A box with a margin of a share of its longer side, ``least`` at least, kept on the page."""
    m = F.greatest(F.lit(least), F.greatest(box.right - box.left, box.bottom - box.top) * share)
    low, high = (lambda v: F.greatest(F.lit(0.0), v - m)), (lambda v, end: F.least(F.lit(end) if isinstance(end, float) else end, v + m))
    return F.struct(low(box.left).alias("l"), low(box.top).alias("t"), high(box.right, width).alias("r"), high(box.bottom, height).alias("b"))


def crop_regions(symbols: DataFrame, relations: DataFrame, share: float, least: float, width: float, height: float) -> DataFrame:
    """Symbols (``file, id, name, l, t, r, b``) to cut out, with ``crop``: all shapes, and of the texts only labels of arrows."""
    labels = relations.filter("name = 'arrow_label' and size(ids) > 0").select("file", F.col("ids")[0].alias("id")).distinct()
    texts = symbols.filter("name = 'text'").join(labels, ["file", "id"], "left_semi")
    return symbols.filter("name != 'text'").unionByName(texts).withColumn("crop", crop_box(Box.of(), share, least, width, height))


def flow_constraints(shapes: DataFrame, relations: DataFrame) -> DataFrame:
    """``file, before, after``: the second and third symbol of an arrow's connection, where both are among ``shapes(file, id)``."""
    ends = relations.filter("name = 'arrow_connection' and size(ids) >= 3").select("file", F.col("ids")[1].alias("before"), F.col("ids")[2].alias("after"))
    for end in ("before", "after"):
        ends = ends.join(shapes.select("file", F.col("id").alias(end)).distinct(), ["file", end], "left_semi")
    return ends.select("file", "before", "after")


def glyph_strokes(d: str | None, steps: int = 8) -> list[list[tuple[float, float]]]:
    """Strokes of a path with absolute M, L and C commands, curves in ``steps`` parts; strokes of one point go. Raises ValueError on other commands."""
    strokes: list[list[tuple[float, float]]] = []
    for command, rest in re.findall(r"([A-Za-z])([^A-Za-df-z]*)", d or ""):
        n = [float(v) for v in re.findall(r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?", rest)]
        pairs = list(zip(n[::2], n[1::2]))
        if command == "M":
            strokes.append(pairs)
        elif command == "L":
            strokes[-1].extend(pairs)
        elif command == "C":
            for p1, p2, p3 in zip(pairs[::3], pairs[1::3], pairs[2::3]):
                p0 = strokes[-1][-1]
                for t in (k / steps for k in range(1, steps + 1)):
                    w = ((1 - t) ** 3, 3 * (1 - t) ** 2 * t, 3 * (1 - t) * t * t, t**3)
                    strokes[-1].append(tuple(sum(a * p[c] for a, p in zip(w, (p0, p1, p2, p3))) for c in (0, 1)))
        else:
            raise ValueError(f"path command {command!r} isn't supported")
    return [s for s in strokes if len(s) > 1]


def read_svg_glyphs(spark: SparkSession, path: str) -> DataFrame:
    """Glyphs of single-line SVG fonts -> ``file, ch, advance, strokes`` in font units, the baseline at 0 and y upward; glyphs of more than one character go."""

    def run(paths: pd.Series) -> pd.Series:
        return paths.map(lambda d: [[{"x": x, "y": y} for x, y in s] for s in glyph_strokes(d)])

    run.__annotations__ = {"paths": pd.Series, "return": pd.Series}
    strokes = F.pandas_udf(run, "array<array<struct<x:double,y:double>>>")
    name = F.col("_metadata.file_path").alias("file")
    glyphs = spark.read.format("xml").option("rowTag", "glyph").option("ignoreSurroundingSpaces", False).schema("_unicode string, `_horiz-adv-x` double, _d string").load(path).select(name, "*")
    fonts = spark.read.format("xml").option("rowTag", "font").schema("`_horiz-adv-x` double").load(path).select(name, F.col("_horiz-adv-x").alias("usual"))
    rows = glyphs.filter(F.length("_unicode") == 1).join(fonts, "file", "left")
    return rows.select("file", F.col("_unicode").alias("ch"), F.coalesce("_horiz-adv-x", "usual", F.lit(500.0)).alias("advance"), strokes("_d").alias("strokes"))


def json_lines(rows: DataFrame, key: str, text: str, most: int = 50) -> DataFrame:
    """The distinct lines, trimmed, of all strings at any depth of JSON texts: ``key, line``; empty lines and those over ``most`` characters go.

    Texts that aren't JSON, and nulls, have none.  Objects and arrays are opened one level a round, all rows at once, so
    there are as many rounds as the deepest text has levels; strings leave as soon as they are reached.
    """
    spark = rows.sparkSession
    open_ = rows.select(F.col(key).alias("__k"), F.try_parse_json(text).alias("v")).filter("v is not null")
    kind = F.schema_of_variant("v")
    found = []
    while True:
        open_ = cut(open_.withColumn("kind", kind))
        found.append(open_.filter("kind = 'STRING'").select("__k", F.variant_get("v", "$", "string").alias("s")))
        inner = open_.filter(F.col("kind").startswith("OBJECT") | F.col("kind").startswith("ARRAY"))
        if not inner.limit(1).count():
            break
        open_ = inner.lateralJoin(spark.tvf.variant_explode(F.col("v").outer())).select("__k", F.col("value").alias("v")).filter("v is not null")
    every = found[0]
    for part in found[1:]:
        every = every.unionByName(part)
    space = r"^[\s\x1C-\x1F\x85\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]+"
    line = F.regexp_replace(F.regexp_replace("line", space, ""), space[1:] + "$", "")
    lines = every.select("__k", F.explode(F.split("s", "\n")).alias("line")).select("__k", line.alias("line"))
    return lines.filter(F.length("line").between(1, most)).distinct().withColumnRenamed("__k", key)


def manifest(results: DataFrame, most: int = 10) -> DataFrame:
    """``results(page, file, problems array<string>)`` -> ``page, renders, rejected``: files without problems, and the others with their first ones, by name."""
    fine = F.size("problems") == 0
    kept = F.array_sort(F.collect_list(F.when(fine, F.col("file"))))
    lost = F.array_sort(F.collect_list(F.when(~fine, F.struct("file", F.slice("problems", 1, most).alias("problems")))))
    return results.groupBy("page").agg(kept.alias("renders"), lost.alias("rejected"))


def html_report(rows: DataFrame, *columns: str) -> DataFrame:
    """A page with one table of a summary's rows, in their order by the columns: ``html``."""
    shown = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        shown = [F.replace(c, F.lit(a), F.lit(b)) for c in shown]
    cell = lambda tag, cells: F.concat(F.lit("<tr>"), *[F.concat(F.lit(f"<{tag}>"), c, F.lit(f"</{tag}>")) for c in cells], F.lit("</tr>"))
    body = F.transform(F.sort_array(F.collect_list(F.struct(*columns, cell("td", shown).alias("__row")))), lambda s: s["__row"])
    return rows.agg(F.concat(F.lit("<table>"), cell("th", map(F.lit, columns)), F.array_join(body, ""), F.lit("</table>")).alias("html"))


def write_json(rows: DataFrame, path: str, *by: str, mode: str = "errorifexists") -> None:
    """Rows as JSON lines in folders by ``by``: layouts by page and seed, target lists by render, reports. ``append`` mode keeps a log of metrics."""
    rows.write.mode(mode).partitionBy(*by).json(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``line`` of text files; empty ones go."""
    return spark.read.text(path).select(F.rtrim("value").alias("line")).filter("line != ''")


def write_lines(lines: DataFrame, path: str, column: str = "line") -> None:
    lines.select(column).write.text(path)
