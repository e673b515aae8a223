"""Lines of text as glyphs: lookup by ordered fallback over a pool of fonts, places from summed advances."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The capitals whose height is a font's text height.
CAPITALS = ("H", "E")


def cap_scaled(glyphs: DataFrame) -> DataFrame:
    """``glyphs(font, ch, advance, strokes)`` in font units, the baseline at 0 -> the same in text heights. A font without H and E raises."""
    tops = F.transform(F.flatten("strokes"), lambda p: p["y"])
    cap = glyphs.withColumn("top", F.when(F.col("ch").isin(*CAPITALS), F.array_max(tops))).groupBy("font").agg(F.max("top").alias("cap"))
    cap = cap.withColumn("cap", F.when(F.col("cap").isNull(), F.raise_error(F.lit("a font has no capital to measure"))).otherwise(F.col("cap")))
    rows = glyphs.join(cap, "font")
    scaled = F.transform("strokes", lambda s: F.transform(s, lambda p: F.struct((p["x"] / F.col("cap")).alias("x"), (p["y"] / F.col("cap")).alias("y"))))
    return rows.select("font", "ch", (F.col("advance") / F.col("cap")).alias("advance"), scaled.alias("strokes"))


def pool_advances(glyphs: DataFrame, fonts: DataFrame) -> DataFrame:
    """``ch, advance``: widths that are safe for every font of ``fonts(font)``: the largest advance of each character that all have."""
    rows = glyphs.join(fonts.select("font").distinct(), "font")
    every = fonts.agg(F.countDistinct("font").alias("fonts"))
    counted = rows.groupBy("ch").agg(F.max("advance").alias("advance"), F.countDistinct("font").alias("n"))
    return counted.join(F.broadcast(every), F.col("n") == F.col("fonts")).select("ch", "advance")


def _looked_up(labels: DataFrame, table: DataFrame, *values: str) -> DataFrame:
    """``labels(id, text)`` as ``id, at, ch`` and the values of the character, null where ``table(ch, *values)`` has none.

    The table is what fonts hold, some thousand characters, so it goes along as one map.
    """
    one = table.agg(F.map_from_entries(F.collect_list(F.struct("ch", F.struct(*values)))).alias("__m"))
    rows = labels.select("id", F.posexplode(F.filter(F.split("text", ""), lambda c: c != "")).alias("at", "ch"))
    return rows.join(F.broadcast(one)).withColumn("__v", F.try_element_at("__m", F.col("ch"))).select("id", "at", "ch", "__v.*")


def text_widths(labels: DataFrame, advances: DataFrame) -> DataFrame:
    """``labels(id, text)``, ``advances(ch, advance)`` -> ``id, width, missing``: summed advances, and how many characters have none. A null text has width 0."""
    rows = _looked_up(labels, advances, "advance").groupBy("id").agg(F.coalesce(F.sum("advance"), F.lit(0.0)).alias("width"), F.count_if(F.col("advance").isNull()).alias("missing"))
    return labels.select("id").join(rows, "id", "left").select("id", F.coalesce("width", F.lit(0.0)).alias("width"), F.coalesce("missing", F.lit(0)).alias("missing"))


def laid_out(labels: DataFrame, glyphs: DataFrame, pool: DataFrame) -> DataFrame:
    """``labels(id, text)`` -> ``id, at, ch, font, x, advance, strokes``: every character in the first font of ``pool(font, place)`` that has it.

    ``x`` is the sum of the advances before; strokes are moved there. A character that no font has is null and takes no room.
    """
    first = glyphs.join(pool, "font").groupBy("ch").agg(F.min_by(F.struct("font", "advance", "strokes"), F.struct("place", "font")).alias("g")).select("ch", "g.*")
    rows = _looked_up(labels, first, "font", "advance", "strokes")
    before = Window.partitionBy("id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("x", F.coalesce(F.sum("advance").over(before), F.lit(0.0)))
    moved = F.transform("strokes", lambda s: F.transform(s, lambda p: F.struct((p["x"] + F.col("x")).alias("x"), p["y"].alias("y"))))
    return rows.select("id", "at", "ch", "font", "x", "advance", moved.alias("strokes"))
