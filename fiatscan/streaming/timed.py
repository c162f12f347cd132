"""Streams that wait for event time: rates that went stale, and events at the rate of their time.

Nothing is said before the watermark has passed the time it is about, so rows may come in any order within `delay`, and the
result does not depend on how they fell into batches. Rows older than the watermark are dropped as late.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from fiatscan.functions.times import clock, from_micros, micros
from fiatscan.schemas import RATES_STALE_S

DELAY = "10 minutes"
NEVER = 1 << 62


def _now(state: GroupState) -> int:
    """The watermark in microseconds."""
    return state.getCurrentWatermarkMs() * 1000


def stale_rates(ticks: DataFrame, stale_s: float = RATES_STALE_S, delay: str = DELAY) -> DataFrame:
    """ticks (asset, fiat, ts, stale) -> asset, fiat, last_ts, stale_ts: a row each time that no good tick came for `stale_s`.

    A good tick has a time and is not flagged stale; one that comes exactly at the limit is in time. The state of a key is the times of
    its good ticks that are not decided yet: those within limit and delay of the newest.
    """
    limit = int(stale_s * 1_000_000)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, held = _now(state), [np.asarray(state.get[0], np.int64)] if state.exists else []
        for pdf in batches:
            held.append(pdf.loc[pdf["good"].astype(bool), "us"].to_numpy(np.int64))
        times = np.unique(np.concatenate(held)) if held else np.empty(0, np.int64)
        decided = int(np.searchsorted(times, now - limit))
        after = np.append(times[1:], NEVER)[:decided]
        gone, open_ = times[:decided][after - times[:decided] > limit], times[decided:]
        if len(open_):
            state.update((open_.tolist(),))
            state.setTimeoutTimestamp(int(open_[0] + limit) // 1000)
        elif state.exists:
            state.remove()
        if len(gone):
            yield pd.DataFrame({"asset": key[0], "fiat": key[1], "us": gone})

    good = F.col("ts").isNotNull() & ~F.coalesce("stale", F.lit(False))  # a flag, as a filter would be pushed below the watermark and hold it back
    rows = ticks.withColumn("_at", clock(F.col("ts"))).withWatermark("_at", delay).select("asset", "fiat", "_at", F.coalesce(micros(F.col("ts")), F.lit(0)).alias("us"), good.alias("good"))
    out = rows.groupBy("asset", "fiat").applyInPandasWithState(step, "asset string, fiat string, us long", "times array<long>", "append", GroupStateTimeout.EventTimeTimeout)
    return out.select("asset", "fiat", from_micros(F.col("us")).alias("last_ts"), from_micros(F.col("us") + limit).alias("stale_ts"))


def _packed(rows: pd.DataFrame) -> bytes:
    table, sink = pa.Table.from_pandas(rows, preserve_index=False), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(bytes(data)).read_pandas()


def as_of(events: DataFrame, ticks: DataFrame, keys: list[str], delay: str = DELAY, spread: int = 8) -> DataFrame:
    """A stream of events with the latest tick (event_id, rate) of a second stream at or before each: `rate`, `tick_ts`; both null before the first tick.

    An event leaves when the watermark of both streams together has passed it. The state of a key is the events that wait, the ticks since the
    watermark, and the last one before. There are few keys and many events, so those of a key are dealt out over `spread` groups, and each gets all
    ticks. Of ticks at one time the one with the greatest event_id counts. An event without a time leaves at once without a rate, a tick without one is dropped.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = _now(state)
        parts = [_unpacked(state.get[0])] if state.exists else []
        parts += [pdf for pdf in batches if len(pdf)]
        if not parts:
            return
        rows = pd.concat(parts, ignore_index=True)
        is_tick = rows["_is_tick"].astype(bool)
        known, asked = rows[is_tick].sort_values(["_us", "_tick_id"]), rows[~is_tick]
        times, us = known["_us"].to_numpy(np.int64), asked["_us"].to_numpy(np.int64)
        due = asked[us < now]
        place = np.searchsorted(times, us[us < now], "right") - 1
        found, waiting = place >= 0, asked[us >= now]
        known_rates = known["_rate"].to_numpy(float)
        kept = pd.concat([known.iloc[max(int(np.searchsorted(times, now)) - 1, 0) :], waiting], ignore_index=True)
        if len(kept):
            state.update((_packed(kept),))
            if len(waiting):
                state.setTimeoutTimestamp(int(waiting["_us"].min()) // 1000)
        elif state.exists:
            state.remove()
        if len(due):
            rate, tick = pd.Series(np.nan, due.index, dtype=float), pd.Series(pd.NA, due.index, dtype="Int64")
            rate[found], tick[found] = known_rates[place[found]], times[place[found]]
            yield due[names].assign(_rate=rate, _tick_us=tick)

    names = events.columns
    never = F.lit(-NEVER)
    group = F.pmod(F.xxhash64(*names), F.lit(spread)).cast("int")
    asked = events.select("*", group.alias("_group"), F.lit(False).alias("_is_tick"), F.coalesce(micros(F.col("ts")), never).alias("_us"))
    groups = F.explode(F.sequence(F.lit(0), F.lit(spread - 1)))
    known = ticks.where(F.col("ts").isNotNull()).select(*keys, "ts", groups.alias("_group"), F.lit(True).alias("_is_tick"), micros(F.col("ts")).alias("_us"), F.col("event_id").alias("_tick_id"), F.col("rate").alias("_rate"))
    both = asked.unionByName(known, allowMissingColumns=True).withColumn("_at", clock(F.col("ts"))).withWatermark("_at", delay)
    schema = StructType([*events.schema.fields]).add("_rate", "double").add("_tick_us", "long")
    out = both.groupBy(*keys, "_group").applyInPandasWithState(step, schema, "rows binary", "append", GroupStateTimeout.EventTimeTimeout)
    return out.select(*names, F.col("_rate").alias("rate"), from_micros(F.col("_tick_us")).alias("tick_ts"))
