"""Scores of detections and readings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .ranks import ranked


def ratio(top: Column, bottom: Column) -> Column:
    """A quotient, null where the bottom is zero."""
    return F.try_divide(top, bottom)


def page_metrics(expected: DataFrame, found: DataFrame, matches: DataFrame) -> DataFrame:
    """Counts by page of ``expected(page, idx)``, ``found(page, idx)`` and one-to-one ``matches(page)``, with recall and false rate."""
    n = lambda df, name: df.groupBy("page").agg(F.count("*").alias(name))
    rows = n(expected, "n_expected").join(n(found, "n_found"), "page", "full").join(n(matches, "n_matched"), "page", "left").fillna(0)
    return rows.withColumns({"recall": ratio(F.col("n_matched"), F.col("n_expected")), "false_rate": ratio(F.col("n_found") - F.col("n_matched"), F.col("n_found"))})


def micro(metrics: DataFrame) -> DataFrame:
    """All pages together: sums first, ratios of the sums then."""
    s = metrics.agg(*[F.sum(c).alias(c) for c in ("n_expected", "n_found", "n_matched")])
    return s.withColumns({"recall": ratio(F.col("n_matched"), F.col("n_expected")), "false_rate": ratio(F.col("n_found") - F.col("n_matched"), F.col("n_found"))})


def error_rate(reads: DataFrame, *by: str) -> DataFrame:
    """``reads(errors, tokens)`` -> token error rate and share of exact readings."""
    return reads.groupBy(*by).agg(F.count("*").alias("n"), ratio(F.sum("errors"), F.sum("tokens")).alias("error_rate"), F.avg((F.col("errors") == 0).cast("int")).alias("exact"))


def bucket(length: Column, *edges: int) -> Column:
    """Name of the range that a length falls in: ``1-5``, ``6-10`` and so on; null beyond."""
    out = F.lit(None).cast("string")
    for low, high in reversed(list(zip((1, *(e + 1 for e in edges)), edges))):
        out = F.when(length.between(low, high), f"{low}-{high}").otherwise(out)
    return out


def order_score(constraints: DataFrame, places: DataFrame) -> DataFrame:
    """``constraints(page, before, after)`` held against ``places(page, idx, place)``: how many there are and hold, by page."""
    at = lambda n: places.select("page", F.col("idx").alias(n), F.col("place").alias(f"{n}_place"))
    rows = constraints.join(at("before"), ["page", "before"]).join(at("after"), ["page", "after"])
    return rows.groupBy("page").agg(F.count("*").alias("n"), F.count_if(F.col("before_place") < F.col("after_place")).alias("held"))


def evenly(rows: DataFrame, k: int, *order: str) -> DataFrame:
    """``k`` rows at even steps of an order, first and last among them; all rows if there are no more."""
    n = ranked(rows, list(order), out="__i", size="__n")
    at = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.floor(i * (F.col("__n") - 1) / max(k - 1, 1)))
    return n.filter((F.col("__n") <= k) | F.array_contains(at, F.col("__i").cast("long"))).drop("__i", "__n")


#: Cells of the cost matrix that a block may hold without another thought.
BLOCK_CELLS = 2_000_000


def _next_row(row: np.ndarray, token: int, label: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """The row of least costs below ``row``; drops along it are a running minimum."""
    out = np.concatenate([row[:1] + 1, np.minimum(row[:-1] + (label != token), row[1:] + 1)])
    return np.minimum.accumulate(out - steps) + steps


def edit_script(read: list[str], label: list[str]) -> list[tuple[str, str | None, str | None]]:
    """(kind, label token, read token) of the mistakes of a least alignment, from the end; matches and exchanges go before drops, those before additions.

    Whole rows at a time, in blocks of BLOCK_CELLS or sqrt(len(read)) rows; of
    all but the last block only the first row is kept, and the others are made
    again on the way back, so memory grows with sqrt(len(read)) * len(label).
    """
    numbers = {t: i for i, t in enumerate(dict.fromkeys([*read, *label]))}
    r, t = (np.array([numbers[x] for x in side], np.int64) for side in (read, label))
    n, m = len(read), len(label)
    steps, size = np.arange(m + 1), max(int(np.sqrt(n)), BLOCK_CELLS // (m + 1), 1)
    kept, cost = [steps], [steps]  # rows at the starts of blocks; the rows of the last block
    for i in range(1, n + 1):
        cost.append(_next_row(cost[-1], r[i - 1], t, steps))
        if i % size == 0 and i < n:
            kept.append(cost[-1])
            cost = cost[-1:]
    out: list[tuple[str, str | None, str | None]] = []
    i, j, base = n, m, max(n - 1, 0) // size
    while i > 0 or j > 0:
        if i > 0 and (i - 1) // size != base:
            base = (i - 1) // size
            cost = [kept[base]]
            for k in range(base * size, min((base + 1) * size, n)):
                cost.append(_next_row(cost[-1], r[k], t, steps))
        at = i - base * size
        same = i > 0 and j > 0 and read[i - 1] == label[j - 1]
        if i > 0 and j > 0 and cost[at][j] == cost[at - 1][j - 1] + (not same):
            i, j = i - 1, j - 1
            if not same:
                out.append(("sub", label[j], read[i]))
        elif j > 0 and (i == 0 or cost[at][j] == cost[at][j - 1] + 1):
            j -= 1
            out.append(("drop", label[j], None))
        else:
            i -= 1
            out.append(("add", None, read[i]))
    return out


def edit_ops(read: Column, label: Column) -> Column:
    """``edit_script`` of two token lists, by batches."""

    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(("kind", "label", "read"), op)) for op in edit_script(list(x), list(y))] for x, y in zip(a, b)])

    run.__annotations__ = {"a": pd.Series, "b": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "array<struct<kind:string,label:string,read:string>>")(read, label)


#: What the SQL function ``edit_script`` returns.
SCRIPT_COLUMNS = "id string, place long, kind string, label_token string, read_token string"


def register_edit_script(spark: SparkSession, name: str = "edit_script") -> None:
    """Make the SQL table function known: ``SELECT * FROM edit_script(TABLE(pairs) PARTITION BY id)``.

    ``pairs(id string, read array<string>, label array<string>)``, other columns ignored, gives the mistakes of
    each pair, counted from the end as in ``edit_script``: ``id, place, kind, label_token, read_token``.  A pair
    with a null list has none.  Batches pass as Arrow; the rows of one id are dealt to one task.
    """

    class EditScript:
        def eval(self, pairs: pa.RecordBatch) -> Iterator[pa.Table]:
            out: dict[str, list] = {n: [] for n in ("id", "place", "kind", "label_token", "read_token")}
            for key, read, label in zip(*(pairs.column(c).to_pylist() for c in ("id", "read", "label"))):
                for place, op in enumerate(edit_script(read, label) if read is not None and label is not None else [], 1):
                    for column, value in zip(out.values(), (key, place, *op)):
                        column.append(value)
            types = {"place": pa.int64()}
            yield pa.table({n: pa.array(v, types.get(n, pa.string())) for n, v in out.items()})

    spark.udtf.register(name, F.arrow_udtf(EditScript, returnType=SCRIPT_COLUMNS))
