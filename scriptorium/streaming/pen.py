"""Pen samples as streams (an extension: Structured Streaming over the ink model)."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def activity(samples: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """``samples(writer, ts, x, y)`` -> samples and bounds by writer and tumbling window; rows later than the watermark are dropped."""
    rows = samples.withWatermark("ts", late) if samples.isStreaming else samples
    out = rows.groupBy(F.window("ts", width), "writer").agg(F.count("*").alias("n"), F.min("x").alias("x0"), F.max("x").alias("x1"))
    return out.select(F.col("window.start").alias("start"), "writer", "n", "x0", "x1")


def sessions(samples: DataFrame, gap: str = "2 hours", late: str = "1 hour") -> DataFrame:
    """Strokes by pause: sessions of a writer's samples with gaps below ``gap``."""
    rows = samples.withWatermark("ts", late) if samples.isStreaming else samples
    out = rows.groupBy(F.session_window("ts", gap), "writer").agg(F.count("*").alias("n"))
    return out.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "writer", "n")


def pen_states(codes: DataFrame) -> DataFrame:
    """``codes(writer, seq, code)`` -> ``writer, seq, x, y, down, ok``: positions and pen states kept for each writer from batch to batch.

    Rows of a writer are taken in ``seq`` order within a batch.
    """
    from ..operators.codec import DIRECTIONS

    def run(key: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        x, y, down = state.get if state.exists else (0, 0, 0)
        rows = pd.concat(list(frames)).sort_values("seq")
        out = []
        for seq, code in zip(rows.seq, rows.code):
            ok = True
            if code in (0, 1):
                ok = down == code
                down = 1 - code
            else:
                dx, dy = DIRECTIONS[int(code)]
                x, y = x + dx, y + dy
            out.append((key[0], seq, x, y, bool(down), ok))
        state.update((int(x), int(y), int(down)))
        yield pd.DataFrame(out, columns=["writer", "seq", "x", "y", "down", "ok"])

    return codes.groupBy("writer").applyInPandasWithState(run, "writer long, seq long, x int, y int, down boolean, ok boolean", "x int, y int, down int", "append", GroupStateTimeout.NoTimeout)
