"""Scoring of page crops by a pluggable model: the boundary behind which models run.

A model sees prepared crops and a prompt and returns text that may hold ink
tokens.  All else is here: second tries, results in the crops' order, text
apart from ink, and strokes in the coordinates of the page.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geometry as g
from ..functions import text as tx
from .codec import detokenize

# The prompts of the model, and the mark of a text that holds ink.
RECOGNIZE, DERENDER = "Recognize and derender.", "Derender the ink."
INK_MARK = "<ink_token_"
#: Crops that a model gets at once.
BATCH_ROWS = 64

#: Texts for the rows of a batch, in their order, under a prompt.
Model = Callable[[pa.RecordBatch, str], list[str | None]]


def scored(rows: DataFrame, load: Callable[[], Model], prompt: str = RECOGNIZE, second: str | None = DERENDER, batch_rows: int = BATCH_ROWS) -> DataFrame:
    """Add ``raw string``, ``used_fallback boolean`` and ``passes int`` to ``rows``.

    ``load`` makes the model, once in each task that has rows, so weights are
    neither collected nor sent.  A model gets at most ``batch_rows`` rows.  Rows whose text holds no
    ink are scored again under ``second``, together, and only these; the second
    text stands whatever it holds.  Rows stay where and in which order they
    are; columns of the new names are replaced; an empty table loads no model.
    A model that returns more or fewer texts than rows is an error.
    """
    rows = rows.drop("raw", "used_fallback", "passes")

    def texts(model: Model, part: pa.RecordBatch, ask: str) -> list[str]:
        found = ["" if t is None else t for t in model(part, ask)]
        if len(found) != part.num_rows:
            raise ValueError(f"the model returned {len(found)} texts for {part.num_rows} rows")
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        for batch in batches:
            for at in range(0, batch.num_rows, batch_rows):
                part = batch.slice(at, batch_rows)
                model = model or load()
                raw = texts(model, part, prompt)
                again = [i for i, t in enumerate(raw) if INK_MARK not in t] if second is not None else []
                for i, t in zip(again, texts(model, part.take(pa.array(again, pa.int64())), second) if again else []):
                    raw[i] = t
                tried = pc.is_in(pa.array(range(part.num_rows), pa.int64()), pa.array(again, pa.int64()))
                new = [pa.array(raw, pa.string()), tried, pc.add(pc.cast(tried, pa.int32()), pa.scalar(1, pa.int32()))]
                yield pa.RecordBatch.from_arrays([*part.columns, *new], [*part.schema.names, "raw", "used_fallback", "passes"])

    more = [T.StructField("raw", T.StringType()), T.StructField("used_fallback", T.BooleanType()), T.StructField("passes", T.IntegerType())]
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, *more]))


def with_crops(boxes: DataFrame, size: int = 224) -> DataFrame:
    """Add how each box (``l, t, r, b``) is cut out and fitted to the model's square: ``ox, oy`` (origin, kept exact), ``ratio, dx, dy``.

    A crop's pixels begin and end at whole numbers, and it has one at least.
    """
    pixels = lambda low, high: F.greatest(F.col(high).cast("int") - F.col(low).cast("int"), F.lit(1))
    fitted = g.fit(pixels("l", "r"), pixels("t", "b"), size)
    return boxes.withColumns({"ox": F.col("l"), "oy": F.col("t"), "ratio": fitted["ratio"], "dx": fitted["dx"], "dy": fitted["dy"]})


def on_page(strokes: Column) -> Column:
    """Strokes of a crop in page coordinates, by the crop's ``ox, oy, ratio, dx, dy``."""
    at = lambda v, shift, origin: g.unfit(v, F.col("ratio"), F.col(shift), F.col(origin))
    return F.transform(strokes, lambda s: F.transform(s, lambda p: F.struct(at(p["x"], "dx", "ox").alias("x"), at(p["y"], "dy", "oy").alias("y"))))


def derendered(boxes: DataFrame, load: Callable[[], Model], prompt: str = RECOGNIZE, second: str | None = DERENDER, batch_rows: int = BATCH_ROWS) -> DataFrame:
    """``boxes(.., l, t, r, b, ..)`` with ``text`` and page ``strokes`` of what the model makes of each; see ``scored``."""
    out = scored(with_crops(boxes), load, prompt, second, batch_rows)
    return out.withColumns({"text": tx.plain(F.col("raw")), "strokes": on_page(detokenize(tx.tokens_of(F.col("raw"))))})


def merged_pages(results: DataFrame, *more: Column) -> DataFrame:
    """``results(page, idx, text, strokes, used_fallback)`` -> ``page, text, strokes, any_fallback``: the crops of a page in order, as one ink; ``more`` are other aggregates of a page."""
    parts = F.sort_array(F.collect_list(F.struct("idx", "text", "strokes")))
    rows = results.groupBy("page").agg(parts.alias("p"), F.max("used_fallback").alias("any_fallback"), *more)
    texts = F.array_join(F.filter(F.col("p.text"), lambda t: t != ""), " ")
    return rows.select("page", texts.alias("text"), F.flatten("p.strokes").alias("strokes"), *[c for c in rows.columns if c not in ("page", "p")])
