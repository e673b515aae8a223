"""Training corpora: vocabularies, statistics, splits, shards, batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import ranked


def _distinct_tokens(tokens: DataFrame, column: str) -> DataFrame:
    """Each line gives each of its tokens once, before any shuffle."""
    return tokens.select(F.explode(F.array_distinct(column)).alias("token")).distinct()


def charset(tokens: DataFrame, column: str = "tokens") -> DataFrame:
    """``token, id``: the distinct tokens in code-point order, from 2 (0 pads, 1 separates)."""
    distinct = _distinct_tokens(tokens, column)
    return distinct.withColumn("id", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("token").cast("binary"))) + 1)


def extended(base: DataFrame, tokens: DataFrame, column: str = "tokens") -> DataFrame:
    """A charset with the new tokens of ``tokens`` after the old ones, whose ids stay."""
    new = _distinct_tokens(tokens, column).join(base, "token", "left_anti")
    first = base.agg(F.coalesce(F.max("id"), F.lit(1)).alias("m"))
    number = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("token").cast("binary")))
    return base.unionByName(new.withColumn("k", number).crossJoin(F.broadcast(first)).select("token", (F.col("m") + F.col("k")).cast("int").alias("id")))


def encoded(lines: DataFrame, vocabulary: DataFrame, key: str, column: str = "tokens") -> DataFrame:
    """``key, ids``: token ids in order; lines with a token outside the vocabulary go."""
    rows = lines.select(key, F.posexplode(column).alias("pos", "token")).join(vocabulary, "token", "left")
    out = rows.groupBy(key).agg(F.count_if(F.col("id").isNull()).alias("bad"), F.sort_array(F.collect_list(F.struct("pos", "id")))["id"].alias("ids"))
    return out.filter("bad = 0").select(key, "ids")


def unreadable(lines: DataFrame, vocabulary: DataFrame, key: str, column: str = "tokens") -> DataFrame:
    """The ``key`` of lines with a token outside the vocabulary."""
    return lines.select(key, F.explode(F.array_distinct(column)).alias("token")).join(vocabulary, "token", "left_anti").select(key).distinct()


def readable(lines: DataFrame, vocabulary: DataFrame, key: str, column: str = "tokens") -> DataFrame:
    """Lines all of whose tokens are in the vocabulary."""
    return lines.join(unreadable(lines, vocabulary, key, column), key, "left_anti")


def offset_statistics(offsets: DataFrame) -> DataFrame:
    """Mean and population deviation of the offsets."""
    return offsets.agg(*[f(c).alias(f"{n}_{c}") for c in ("dx", "dy") for n, f in (("mu", F.avg), ("std", F.stddev_pop))])


def sharded(lines: DataFrame, key: str, size: int, seed: int = 0) -> DataFrame:
    """Add ``shard``: lines in a seeded random order (by MD5 of seed and key), ``size`` to a shard."""
    rows = ranked(lines.withColumn("__draw", drawn(seed, key)), ["__draw", key], out="__rank")
    return rows.withColumn("shard", F.expr(f"__rank div {size}").cast("int")).drop("__draw", "__rank")


def drawn(seed: int, key: str) -> Column:
    """A random order that any partitioning and any engine gives alike."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def chunked(lines: DataFrame, key: str, size: int) -> DataFrame:
    """Add ``shard``: lines in the order of ``key``, ``size`` to a shard."""
    return ranked(lines, [key], out="__rank").withColumn("shard", F.expr(f"__rank div {size}").cast("int")).drop("__rank")


def stratified(lines: DataFrame, by: str, order: list[str], steps: int) -> DataFrame:
    """Lines at even steps of each group's order, about ``steps`` of them."""
    rows = ranked(lines, order, by, "__rank", "__size")
    return rows.filter(F.col("__rank") % F.greatest(F.expr(f"__size div {steps}"), F.lit(1)) == 0).drop("__rank", "__size")


def split(lines: DataFrame, last: int, shard: str = "shard") -> DataFrame:
    """Add ``split``: the last shards by name are ``valid``, the others ``train``."""
    names = lines.select(shard).distinct().withColumn("__r", F.dense_rank().over(Window.partitionBy(F.lit(0)).orderBy(F.desc(shard))))
    return lines.join(F.broadcast(names.filter(F.col("__r") <= last)), shard, "left").withColumn("split", F.when(F.col("__r").isNotNull(), "valid").otherwise("train")).drop("__r")


def picked(lines: DataFrame, by: str, key: str, n: int, seed: int = 0) -> DataFrame:
    """``n`` lines of each group without replacement, in a random order; the first ``n`` are found before the shuffle already."""
    w = Window.partitionBy(by).orderBy(drawn(seed, key), key)
    return lines.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= n).drop("__r")


def batches(lines: DataFrame, pool: str, key: str, length: str, budget: int, chunk: int = 4096) -> DataFrame:
    """``pool, key, length, chunk, batch``: lines of a pool by length, in batches whose padded size (lines times longest) keeps in the budget; a longer line has its own.

    Each pool is cut in chunks of so many lines in the order of length, and an
    ordered fold goes over each chunk, so no pool, however large, meets in one row.
    """
    start = F.struct(F.lit(0).alias("batch"), F.lit(0).alias("n"), F.array().cast("array<int>").alias("out"))

    def step(acc, x):
        new = (acc["n"] > 0) & (x[length] * (acc["n"] + 1) > budget)
        b = F.when(new, acc["batch"] + 1).otherwise(acc["batch"])
        return F.struct(b.alias("batch"), F.when(new, F.lit(1)).otherwise(acc["n"] + 1).alias("n"), F.concat(acc["out"], F.array(b)).alias("out"))

    placed = ranked(lines, [length, key], pool, "__rank").withColumn("chunk", F.expr(f"__rank div {chunk}"))
    rows = placed.groupBy(pool, "chunk").agg(F.sort_array(F.collect_list(F.struct(F.col(length).cast("int").alias(length), key))).alias("all"))
    rows = rows.withColumn("b", F.aggregate("all", start, step, lambda a: a["out"]))
    return rows.select(pool, "chunk", F.explode(F.arrays_zip("all", "b")).alias("z")).select(pool, "chunk", F.col(f"z.all.{key}").alias(key), F.col(f"z.all.{length}").alias(length), F.col("z.b").alias("batch"))


def new_only(rows: DataFrame, manifest: DataFrame, key: str) -> DataFrame:
    """Rows that a manifest doesn't list: what a push or a restarted write still has to do."""
    return rows.join(manifest, key, "left_anti")


def only_for_training(lines: DataFrame, split: str = "split") -> DataFrame:
    """The same lines; a held-out one (``valid`` or ``test``) stops the job, so that none is ever rendered."""
    held = F.col(split).isin("valid", "test")
    return lines.withColumn(split, F.when(held, F.raise_error(F.concat(F.lit("held-out line of split "), F.col(split)))).otherwise(F.col(split)))


def dropped(lines: DataFrame, tokens: str, points: str, most_tokens: int = 50, most_points: int = 2000) -> DataFrame:
    """``lines`` with ``reason``: ``tokens`` or ``points`` where a line has too many (tokens are asked first), null where it stays."""
    return lines.withColumn("reason", F.when(F.size(tokens) > most_tokens, "tokens").when(F.col(points) > most_points, "points"))


def learning_rate(step: Column, warm: int, total: int, peak: float) -> Column:
    """Rises linearly over ``warm`` steps, then falls along half a cosine to nothing at ``total``."""
    fall = 0.5 * (1 + F.cos(F.pi() * (step - warm) / float(total - warm)))
    return peak * F.when(step < warm, (step + 1) / float(warm)).otherwise(fall)
