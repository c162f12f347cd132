"""Streams: confirmed prices, cache replay, frame gate, and prices converted as they come.

State is one small row a key (one frame of levels for the gate). Rows of a micro-batch are taken in event
order; rows that come in a later batch are taken as later, as arrival order is the truth here. With `idle_s`
given, a key that is silent for longer in event time starts afresh, and its state goes when the watermark (`delay`
behind the newest row) has passed that time; rows older than the watermark are then dropped as late.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from fiatscan.functions import text_price
from fiatscan.functions.times import clock, micros
from fiatscan.operators.frames import sharpness
from fiatscan.operators.rates import convert
from fiatscan.schemas import MAX_MOTION, MIN_CONTRAST, MIN_SHARPNESS


DELAY = "10 minutes"


class _Idle:
    """Event-time expiry of a key's state: none without `idle_s`."""

    def __init__(self, idle_s: float | None, delay: str):
        self.us = None if idle_s is None else int(idle_s * 1_000_000)
        self.delay = delay
        self.timeout = GroupStateTimeout.NoTimeout if idle_s is None else GroupStateTimeout.EventTimeTimeout

    def watched(self, rows: DataFrame) -> DataFrame:
        return rows if self.us is None else rows.withColumn("_at", clock(F.col("ts"))).withWatermark("_at", self.delay)

    def columns(self) -> list[str]:
        return [] if self.us is None else ["_at"]

    def times(self, rows: pd.DataFrame) -> list[int] | itertools.repeat:
        return itertools.repeat(None) if self.us is None else [int(t) for t in rows["us"].fillna(0)]

    def over(self, last: int | None, us: int | None) -> bool:
        """Whether the key was silent for too long before a row."""
        return self.us is not None and last is not None and us - last > self.us

    def wait(self, state: GroupState, last: int | None) -> None:
        if self.us is not None:
            state.setTimeoutTimestamp(max((last + self.us) // 1000, state.getCurrentWatermarkMs() + 1))


def _ended(state: GroupState) -> bool:
    """Drops the state of a key whose time is over."""
    if state.hasTimedOut:
        state.remove()
    return state.hasTimedOut


def _in_order(batches: Iterator[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    return pd.concat(list(batches), ignore_index=True).sort_values(by, ignore_index=True)


def stable_prices(readings: DataFrame, idle_s: float | None = None, delay: str = DELAY) -> DataFrame:
    """session_id, seq, amount, currency of confirmed readings; the state is the price that waits for its like."""
    idle = _Idle(idle_s, delay)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if _ended(state):
            return
        *waiting, last = state.get if state.exists else (None, None, None)
        out, rows = [], _in_order(batches, ["us", "seq"])
        for us, (seq, amount, currency) in zip(idle.times(rows), rows[["seq", "amount", "currency"]].itertuples(index=False)):
            if idle.over(last, us):
                waiting = (None, None)
            last = us
            price = (None, None) if amount is None or np.isnan(amount) else (amount, currency)
            if price[0] is not None and price == tuple(waiting):
                out.append((key[0], seq, *price))
                price = (None, None)
            waiting = price
        state.update((*waiting, last))
        idle.wait(state, last)
        if out:
            yield pd.DataFrame(out, columns=["session_id", "seq", "amount", "currency"])

    rows = idle.watched(readings).select("session_id", "seq", micros(F.col("ts")).alias("us"), "amount", "currency", *idle.columns())
    return rows.groupBy("session_id").applyInPandasWithState(step, "session_id long, seq long, amount double, currency string", "amount double, currency string, last long", "append", idle.timeout)


def cache_replay(requests: DataFrame, ttl_s: int, idle_s: float | None = None, delay: str = DELAY) -> DataFrame:
    """instance_id, seq, status, served_seq; the state is the time and number of the last good fetch."""
    idle = _Idle(idle_s, delay)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if _ended(state):
            return
        at, served, last = state.get if state.exists else (None, None, None)
        out, rows = [], _in_order(batches, ["us", "seq"])
        for time, (seq, us, ok) in zip(idle.times(rows), rows[["seq", "us", "fetch_ok"]].itertuples(index=False)):
            if idle.over(last, time):
                at, served = None, None
            last = time
            if at is not None and us - at < ttl_s * 1_000_000:
                status = "cached"
            elif ok:
                status, at, served = "fetched", int(us), int(seq)
            else:
                status = "error" if at is None else "stale"
            out.append((key[0], seq, status, served))
        if at is not None:
            state.update((at, served, last))
            idle.wait(state, last)
        elif state.exists:
            state.remove()
        made = pd.DataFrame(out, columns=["instance_id", "seq", "status", "served_seq"])
        yield made.astype({"served_seq": "Int64"})

    rows = idle.watched(requests).select("instance_id", "seq", micros(F.col("ts")).alias("us"), "fetch_ok", *idle.columns())
    return rows.groupBy("instance_id").applyInPandasWithState(step, "instance_id long, seq long, status string, served_seq long", "at long, served long, last long", "append", idle.timeout)


def gate(gray: np.ndarray, width: int, height: int, before: np.ndarray | None) -> tuple[float, float, float, str | None]:
    """Sharpness, contrast, motion and the reason of rejection of one frame."""
    sharp, contrast = sharpness(gray, width, height), float(gray.std()) if len(gray) else 0.0
    moved = float(np.abs(gray.astype(int) - before).mean()) if before is not None and len(before) == len(gray) and len(gray) else 0.0
    reason = "blur" if sharp < MIN_SHARPNESS else "low-contrast" if contrast < MIN_CONTRAST else "motion" if moved > MAX_MOTION else None
    return sharp, contrast, moved, reason


def frame_gate(frames: DataFrame, idle_s: float | None = None, delay: str = DELAY) -> DataFrame:
    """frame_id, sharpness, contrast, motion, reason; the state is the session's frame before. Frames need `ts` only with `idle_s`."""
    idle = _Idle(idle_s, delay)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if _ended(state):
            return
        before, last = (np.asarray(state.get[0]), state.get[1]) if state.exists else (None, None)
        out, rows = [], _in_order(batches, ["seq"])
        for us, (frame_id, width, height, gray) in zip(idle.times(rows), rows[["frame_id", "width", "height", "gray"]].itertuples(index=False)):
            if idle.over(last, us):
                before = None
            last = us
            gray = np.asarray(gray)
            out.append((frame_id, *gate(gray, width, height, before)))
            before = gray
        state.update((before.tolist(), last))
        idle.wait(state, last)
        yield pd.DataFrame(out, columns=["frame_id", "sharpness", "contrast", "motion", "reason"])

    times = [] if idle_s is None else ["_at", micros(F.col("ts")).alias("us")]
    rows = idle.watched(frames).select("session_id", "seq", "frame_id", "width", "height", "gray", *times)
    return rows.groupBy("session_id").applyInPandasWithState(step, "frame_id long, sharpness double, contrast double, motion double, reason string", "gray array<int>, last long", "append", idle.timeout)


def priced(texts: DataFrame, rates: DataFrame, text: str = "text") -> DataFrame:
    """A stream of texts joined with rates that do not change: no state."""
    return convert(text_price.detect(texts, text), rates)


def recognised(images: DataFrame, recognise: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """Readings of a text recogniser that a caller brings; it gets and gives batches of rows."""
    return images.mapInPandas(recognise, schema)
