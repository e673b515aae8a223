"""Pen states of code streams that come in disorder: the order is kept in state, gaps are given up by timers."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.codec import DIRECTIONS, DOWN, UP

#: States of these streams lie in RocksDB, which the session must name for them.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATES = "writer long, seq long, x long, y long, down boolean, status string"
_STEP_X = np.array([DIRECTIONS.get(c, (0, 0))[0] for c in range(10)], np.int64)
_STEP_Y = np.array([DIRECTIONS.get(c, (0, 0))[1] for c in range(10)], np.int64)
_STATUS = np.array(["ok", "bad pen", "bad code", "late"], object)
#: Writers and waiting rows as states have them, packed; ``due`` is when a writer's gap is given up.
_WRITERS = np.dtype([("writer", "<i8"), ("x", "<i8"), ("y", "<i8"), ("down", "?"), ("next", "<i8"), ("due", "<i8")])
_ROWS = np.dtype([("writer", "<i8"), ("seq", "<i8"), ("code", "i1")])
_NEVER, _NO_TIME = 2**63 - 1, -(2**63)


def _packed(writer, seq: pd.Series, code: pd.Series) -> np.ndarray:
    """An array of ``_ROWS``; codes outside 0-9 become -1."""
    out = np.empty(len(seq), _ROWS)
    code = code.astype("int64").to_numpy()
    out["writer"], out["seq"], out["code"] = writer, seq.astype("int64"), np.where((code >= 0) & (code < len(_STEP_X)), code, -1)
    return out


def _follow(rows: np.ndarray, own: np.ndarray, writers: np.ndarray) -> pd.DataFrame:
    """States after each of ``rows``, which lie by writer and in order; ``own`` is a row's place in ``writers``, which go on to their last row."""
    at, n = np.arange(len(rows)), len(rows)
    first = np.concatenate([[True], own[1:] != own[:-1]])[:n]
    start = np.maximum.accumulate(np.where(first, at, 0))
    code = rows["code"].astype(np.int64)
    good = code >= 0
    step = np.where(good, code, DOWN)
    mark = good & ((step == DOWN) | (step == UP))
    # the pen after a row is that of its writer's last mark
    last = np.maximum.accumulate(np.where(mark, at, -1))
    after = np.where(last >= start, step[np.maximum(last, 0)] == DOWN, writers["down"][own])
    before = np.where(first, writers["down"][own], np.concatenate([[False], after[:-1]])[:n])
    status = np.where(~good, 2, np.where(mark & (before == (step == DOWN)), 1, 0))
    out = {"writer": rows["writer"], "seq": rows["seq"]}
    for name, steps in (("x", _STEP_X), ("y", _STEP_Y)):
        moved = np.where(good, steps[step], 0)
        total = np.cumsum(moved)
        out[name] = writers[name][own] + total - (total - moved)[start]
    out |= {"down": after, "status": _STATUS[status]}
    end = np.append(first[1:], True)[:n]
    for name in ("x", "y", "down"):
        writers[name][own[end]] = out[name][end]
    writers["next"][own[end]] = rows["seq"][end] + 1
    return pd.DataFrame(out)


def followed(rows: pd.DataFrame, x: int, y: int, down: bool) -> pd.DataFrame:
    """Position and pen after each of ``rows(seq, code)``, in order, from a position and pen before; ``bad pen`` where the pen goes where it is, ``bad code`` outside 0-9."""
    return _follow(_packed(0, rows.seq, rows.code), np.zeros(len(rows), int), np.array([(0, x, y, down, 0, _NEVER)], _WRITERS)).drop(columns="writer")


class PenTracker(StatefulProcessor):
    """Of a block of writers: position, pen and the next number of each, the rows that came too early and the timer, packed in one value state.

    Rows are taken strictly by number. What comes twice, or after its gap was
    given up, is ``late`` and changes nothing.  While a writer's rows wait for a missing one, time
    runs from the latest of them; when it is over, the gap is given up, and what waited goes on.  A block's event-time
    timer is that of its first writer whose time is over.  Rows without a time wait for one with a time.
    """

    def __init__(self, patience_ms: int) -> None:
        self.patience_ms = patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pens = handle.getValueState("pens", "writers binary, early binary, timer long")

    def _go_on(self, new: np.ndarray, times: np.ndarray, watermark_ms: int | None = None) -> pd.DataFrame:
        """Follow what has no gap before it, keep the rest; gaps whose time is before a watermark count as none."""
        packed, early, timer = self.pens.get() if self.pens.exists() else (b"", b"", None)
        writers = np.frombuffer(packed, _WRITERS)
        unseen = np.setdiff1d(new["writer"], writers["writer"])
        more = np.zeros(len(unseen), _WRITERS)
        more["writer"], more["due"] = unseen, _NEVER
        writers = np.concatenate([writers, more])
        writers = writers[np.argsort(writers["writer"])]
        # the latest time of a writer's new rows counts for all that wait
        latest = np.full(len(writers), _NO_TIME)
        np.maximum.at(latest, np.searchsorted(writers["writer"], new["writer"]), times)
        writers["due"] = np.where(latest > _NO_TIME, latest + self.patience_ms, writers["due"])

        rows = np.concatenate([np.frombuffer(early, _ROWS), new])
        rows = rows[np.lexsort((rows["seq"], rows["writer"]))]  # stable: of equal rows the one that waited is first
        own = np.searchsorted(writers["writer"], rows["writer"])
        late = rows["seq"] < writers["next"][own]
        late[1:] |= (own[1:] == own[:-1]) & (rows["seq"][1:] == rows["seq"][:-1])
        lost, losers, rows, own = rows[late], own[late], rows[~late], own[~late]
        waiting, start = np.unique(own, return_index=True)
        if watermark_ms is not None:
            over = writers["due"][waiting] < watermark_ms
            writers["next"][waiting[over]] = rows["seq"][start[over]]
            writers["due"][waiting[over]] = watermark_ms + self.patience_ms  # a second gap waits no longer than the first
        place = np.arange(len(rows)) - np.repeat(start, np.diff(np.append(start, len(rows))))
        ready = rows["seq"] == writers["next"][own] + place
        out = _follow(rows[ready], own[ready], writers)
        if len(lost):
            states = {name: writers[name][losers] for name in ("x", "y", "down")}
            out = pd.concat([out, pd.DataFrame({"writer": lost["writer"], "seq": lost["seq"]} | states | {"status": "late"})])
        done = np.ones(len(writers), bool)
        done[own[~ready]] = False
        writers["due"][done] = _NEVER
        due = int(writers["due"].min(initial=_NEVER))
        self._set_timer(timer, due if due < _NEVER else None, fired=watermark_ms is not None)
        self.pens.update((writers.tobytes(), rows[~ready].tobytes(), due if due < _NEVER else None))
        return out

    def _set_timer(self, old: int | None, new: int | None, fired: bool) -> None:
        if old == new:
            return
        if old is not None and not fired:  # one that fired goes by itself
            self.handle.deleteTimer(old)
        if new is not None:
            self.handle.registerTimer(new)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [(_packed(r.writer.astype("int64"), r.seq, r.code), r.ms.astype("int64").to_numpy()) for r in rows]
        out = self._go_on(*map(np.concatenate, zip(*new)))
        if len(out):
            yield out

    def handleExpiredTimer(self, key: Any, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = self._go_on(np.array([], _ROWS), np.array([], np.int64), timerValues.getCurrentWatermarkInMs())
        if len(out):
            yield out


def pen_states(codes: DataFrame, late: str = "1 hour", patience_ms: int = 3_600_000, block: int = 16) -> DataFrame:
    """A stream of ``codes(writer, seq, code, ts)`` -> ``writer, seq, x, y, down, status``, in whichever order the rows come.

    ``seq`` counts a writer's codes from 0.  Status: ``ok``, ``bad pen``, ``bad code`` or ``late``; see ``PenTracker``.
    The writers of ``block`` neighbouring numbers share a state, as calls for each state cost far more than rows do.
    """
    ms = F.coalesce(F.unix_millis("ts"), F.lit(_NO_TIME))
    rows = codes.select("writer", "seq", "code", "ts").withWatermark("ts", late).withColumn("ms", ms).withColumn("block", F.expr(f"writer div {block}"))
    return rows.groupBy("block").transformWithStateInPandas(PenTracker(patience_ms), STATES, "append", "EventTime")


def use_provider(spark: SparkSession) -> None:
    """Let the session keep states in RocksDB."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
