"""Changes of inks and labels whose chance comes from hashes of keys, so that any partitioning gives the same."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def chance(*key: Column | str) -> Column:
    """A number in [0, 1) from the first 32 bits of the MD5 of the key's parts, joined by colons."""
    parts = [k.cast("string") if isinstance(k, Column) else F.lit(k) for k in key]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def stretch_factor(most: float, share: float, *key: Column | str) -> Column:
    """A factor between 1 / most and most, uniform in its logarithm, for a share of the keys; 1 for the others."""
    u = chance(*key, "factor") * 2 - 1
    return F.when(chance(*key, "whether") < share, F.exp(u * F.log(F.lit(most)))).otherwise(F.lit(1.0))


def affine(points: DataFrame, by: str, turn: float = 0.1, shear: float = 0.2, stretch: float = 0.15, jitter: float = 0.003) -> DataFrame:
    """Ink ``by, stroke_id, point_id, x, y`` turned by up to ``turn``, sheared by up to ``shear`` and stretched in x by exp(-/+ ``stretch``), by chance of its key; points move by a normal deviate times ``jitter``."""
    ink = lambda width, name: (chance(F.col(by), name) * 2 - 1) * width

    def normal(name: str) -> Column:
        u, v = (chance(F.col(by), F.col("stroke_id"), F.col("point_id"), f"{name}{k}") for k in (1, 2))
        return F.sqrt(-2 * F.log(1 - u)) * F.cos(2 * F.pi() * v) * jitter

    rows = points.withColumns({"__a": ink(turn, "turn"), "__s": ink(shear, "shear"), "__w": F.exp(ink(stretch, "stretch")), "__x": F.col("x"), "__y": F.col("y")})
    x = F.expr("cos(__a) * __w * __x + (cos(__a) * __s - sin(__a)) * __y") + normal("x")
    y = F.expr("sin(__a) * __w * __x + (sin(__a) * __s + cos(__a)) * __y") + normal("y")
    return rows.withColumns({"x": x, "y": y}).drop("__a", "__s", "__w", "__x", "__y")


def typo(word: Column, *key: Column | str) -> Column:
    """A misspelling of a word of two letters or more: neighbours swapped, a letter dropped or doubled, or only a beginning."""
    n = F.length(word)
    at = lambda name, low, count: (low + F.floor(chance(*key, name) * count)).cast("int")
    cut = lambda start, length: F.substring(word, start, length)
    kind = F.floor(chance(*key, "kind") * 4)
    s, d, e = at("swap", 2, n - 3), at("drop", 2, n - 1), at("double", 1, n)
    begin = cut(F.lit(1), at("prefix", 1, F.greatest(F.lit(1), n - 2)))
    swapped = F.concat(cut(F.lit(1), s - 1), cut(s + 1, F.lit(1)), cut(s, F.lit(1)), cut(s + 2, n))
    dropped = F.concat(cut(F.lit(1), d - 1), cut(d + 1, n))
    doubled = F.concat(cut(F.lit(1), e), cut(e, n))
    out = F.when((kind == 0) & (n > 3), swapped).when(kind == 1, dropped).when(kind == 2, doubled).otherwise(begin)
    return F.when(n < 2, word).otherwise(F.when(out == word, cut(F.lit(1), n - 1)).otherwise(out))


def digitized(points: DataFrame, by: str, t: str, quantum: float, drop: float, burst: float, jitter: float, gap: float) -> DataFrame:
    """Pen samples (``by, t, x, y``; t in seconds) as a device would record them; the first and the last of a stroke always stay.

    Samples are dropped by chance alone or as one of the 2 to 6 from the start
    of a burst; positions are rounded to the quantum, inner times shifted
    by up to ``jitter`` and kept ``gap`` apart.
    """
    w = Window.partitionBy(by).orderBy(t)
    rows = points.withColumns({"__i": F.row_number().over(w), "__last": F.lead(t).over(w).isNull()})
    of = lambda name: chance(F.col(by), F.col("__i"), name)
    end = F.when(of("burst") < burst, F.col("__i") + 1 + F.floor(of("length") * 5))
    inner = (F.col("__i") > 1) & ~F.col("__last")
    rows = rows.withColumn("__lost", F.max(F.when(inner, end)).over(w.rowsBetween(-5, 0)) >= F.col("__i"))
    kept = rows.filter(~(inner & (F.coalesce("__lost", F.lit(False)) | (of("drop") < drop))))
    shifted = F.when(inner, F.col(t) + (of("jitter") * 2 - 1) * jitter).otherwise(F.col(t))
    kept = kept.withColumns({"x": F.bround(F.col("x") / quantum) * quantum, "y": F.bround(F.col("y") / quantum) * quantum, "__t": shifted})
    kept = kept.withColumn("__k", F.row_number().over(w) - 1)
    low = F.max(F.col("__t") - F.col("__k") * gap).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return kept.withColumn(t, low + F.col("__k") * gap).select(by, F.col("__i").alias("sample"), t, "x", "y")


def random_lines(spark_rows: DataFrame, words: DataFrame, most_words: int = 7, most_chars: int = 50) -> DataFrame:
    """``line``: distinct lines of 1 to ``most_words`` words, one tried for each ``id`` of the rows; longer ones than ``most_chars`` go.

    ``words(word)`` are numbered by code point and joined by number, so the
    list may be long.
    """
    numbered = words.select("word").distinct().withColumn("k", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("word").cast("binary"))) - 1)
    size = numbered.agg(F.count("*").alias("size"))
    count = (1 + F.floor(chance(F.col("id"), "words") * most_words)).cast("int")
    picks = spark_rows.select("id", F.explode(F.sequence(F.lit(1), count)).alias("place")).crossJoin(F.broadcast(size))  # one row
    picks = picks.withColumn("k", F.floor(chance(F.col("id"), F.col("place"), "word") * F.col("size")).cast("int"))
    lines = picks.join(numbered, "k").groupBy("id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "word"))), lambda s: s["word"]), " ").alias("line"))
    return lines.filter(F.length("line") <= most_chars).select("line").distinct()


def rising_fit(values: Column) -> Column:
    """The non-decreasing sequence nearest to an array by least squares: neighbours in the wrong order are pooled until none is left."""

    def fit(row) -> list[float]:
        pools: list[tuple[float, int]] = []
        for v in row:
            total, n = float(v), 1
            while pools and pools[-1][0] * n > total * pools[-1][1]:
                total, n = total + pools[-1][0], n + pools[-1][1]
                pools.pop()
            pools.append((total, n))
        return [total / n for total, n in pools for _ in range(n)]

    def run(rows: pd.Series) -> pd.Series:
        return rows.map(lambda r: None if r is None else fit(r))

    run.__annotations__ = {"rows": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "array<double>")(values)


def rounded(values: Column, digits: int = 2) -> Column:
    """Doubles rounded by their exact binary value, half to even, as JSON writers in Python do; decimal rounding differs for 2.675."""

    def run(rows: pd.Series) -> pd.Series:
        return rows.map(lambda v: None if pd.isna(v) else round(float(v), digits))

    run.__annotations__ = {"rows": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "double")(values)


def writing_steps(lines: DataFrame) -> DataFrame:
    """The steps in which lines are written with their corrections: ``lines(id, text, fixes array<struct<index, wrong, style, replace>>)`` -> rows by step.

    ``id, step, kind, at, ch, deleted, over, first, last``: kind ``char`` writes ``ch``, the text's character ``at``, or one that is
    wrong (``at`` null, ``deleted``), or over the wrong one of step ``over``; any other kind is a mark through the steps from ``first`` to
    ``last``.  ``wrong`` is written where text ``index`` begins.  A strike or scribble then crosses it out; an overwrite puts ``replace``
    characters of the text, null: as many as are wrong, on top.  Of fixes at one place the last counts; one inside overwritten
    characters or outside the text is passed over.  Null texts have no steps.
    """
    wide = lambda f: F.when(f["style"] == "overwrite", F.coalesce(f["replace"], F.length(f["wrong"]))).otherwise(0)
    # by place, so that the last of one place is known by the next one being elsewhere
    placed = F.array_sort(F.transform(F.coalesce("fixes", F.array()), lambda f, k: F.struct(f["index"].alias("index"), k.alias("k"), f["wrong"].alias("wrong"), f["style"].alias("style"), wide(f).cast("int").alias("wide"))))
    rows = lines.filter("text is not null").select("id", "text", placed.alias("f"))
    known = F.filter("f", lambda f, k: (f["index"] >= 0) & (f["index"] < F.length("text")) & ~F.coalesce(F.get("f", k + 1)["index"] == f["index"], F.lit(False)))
    rows = rows.withColumn("f", known)
    free = F.aggregate("f", F.struct(F.lit(0).alias("end"), F.slice("f", 1, 0).alias("kept")), lambda acc, f: F.when(f["index"] < acc["end"], acc).otherwise(
        F.struct(F.least(f["index"] + f["wide"], F.length("text")).alias("end"), F.concat(acc["kept"], F.array(f)).alias("kept"))), lambda acc: acc["kept"])
    rows = rows.withColumn("f", free)
    # an event's place in the line: where it belongs, then wrong characters, a mark, the right ones on top, or plain text
    event = lambda anchor, turn, k, kind, at, ch, back: F.struct(anchor.alias("anchor"), F.lit(turn).alias("turn"), k.alias("k"), kind.alias("kind"), at.cast("int").alias("at"), ch.alias("ch"), back.cast("int").alias("back"))
    none, every = F.lit(None), lambda n: F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda k: k < n)
    letter = lambda text, k: F.substr(text, k + 1, F.lit(1))
    end = lambda f: F.least(f["index"] + f["wide"], F.length("text"))

    def fixed(f: Column) -> Column:
        n = F.length(f["wrong"])
        wrong = F.transform(every(n), lambda k: event(f["index"], 0, k, F.lit("char"), none, letter(f["wrong"], k), none))
        mark = event(f["index"], 1, F.lit(0), f["style"], none, none.cast("string"), n)
        right = F.transform(every(end(f) - f["index"]), lambda k: event(f["index"], 2, k, F.lit("char"), f["index"] + k, letter(F.col("text"), f["index"] + k), F.when(k < n, n)))
        return F.concat(wrong, F.when(f["style"] == "overwrite", right).otherwise(F.array(mark)))

    covered = lambda k: F.exists("f", lambda f: (f["index"] <= k) & (k < end(f)))
    plain = F.transform(F.filter(every(F.length("text")), lambda k: ~covered(k)), lambda k: event(k, 3, F.lit(0), F.lit("char"), k, letter(F.col("text"), k), none))
    events = rows.select("id", F.explode(F.concat(F.flatten(F.transform("f", fixed)), plain)).alias("e")).select("id", "e.*")
    step = F.row_number().over(Window.partitionBy("id").orderBy("anchor", "turn", "k")) - 1
    char = F.col("kind") == "char"
    back = F.col("step") - F.col("back")
    return events.withColumn("step", step).select(
        "id", "step", "kind", "at", "ch", F.when(char, F.col("at").isNull()).alias("deleted"), F.when(char, back).alias("over"), F.when(~char, back).alias("first"), F.when(~char, F.col("step") - 1).alias("last")
    )
