"""Rate snapshots: checked, joined by equality or as of a time, aged, and replayed through a cache."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fiatscan.functions.times import micros
from fiatscan.schemas import ASSETS, FIATS, RATES_STALE_S, RATES_TTL_S


def normalise(feeds: DataFrame, assets: Sequence[tuple[str, str]] = ASSETS, fiats: Sequence[str] = FIATS) -> DataFrame:
    """feeds (snapshot_id, rates map) -> snapshot_id, asset, fiat, rate of complete snapshots; assets: (name, feed id).

    A snapshot that lacks a price for any asset and fiat is rejected as a whole; so is one that did not parse. No shuffle.
    """
    rate = lambda feed_id, fiat: F.try_element_at(F.try_element_at("rates", F.lit(feed_id)), F.lit(fiat.lower()))
    pairs = F.array(*[F.struct(F.lit(asset).alias("asset"), F.lit(fiat).alias("fiat"), rate(feed_id, fiat).alias("rate")) for asset, feed_id in assets for fiat in fiats])
    parsed = feeds.select("snapshot_id", F.explode(F.array("rates")).alias("rates"))  # a generator, so that a payload is parsed once and not for every pair
    complete = parsed.select("snapshot_id", pairs.alias("_pairs")).where(F.forall("_pairs", lambda p: p["rate"].isNotNull()))
    return complete.select("snapshot_id", F.inline("_pairs"))


def convert(prices: DataFrame, rates: DataFrame) -> DataFrame:
    """prices (amount, currency) x rates (asset, fiat, rate): a row for each asset, for amounts above 0."""
    known = rates.select("asset", F.col("fiat").alias("currency"), "rate")
    return prices.where(F.col("amount") > 0).join(known, "currency").withColumn("asset_amount", F.try_divide("amount", "rate"))


def as_of(events: DataFrame, ticks: DataFrame, keys: list[str], bucket_s: int = 86_400) -> DataFrame:
    """events with the latest tick at or before each: `rate`, `tick_ts`; both null before the first tick.

    There are few keys, so time is cut into buckets and each key and bucket is a group of its own: the last
    tick of earlier buckets is carried in by a window over bucket ends, one row for each key and bucket. Of
    ticks at one time the one with the greatest event_id counts.
    """
    bucket = F.floor(micros(F.col("ts")) / (bucket_s * 1_000_000)).alias("_bucket")
    tick = F.struct(F.col("ts").alias("ts"), F.col("event_id").alias("event_id"), F.col("rate").alias("rate"))
    asked = events.select(*keys, bucket, "ts", F.lit(1).alias("_side"), F.struct(*events.columns).alias("_row"))
    marks = ticks.select(*keys, bucket, "ts", F.lit(0).alias("_side"), F.lit(None).cast(asked.schema["_row"].dataType).alias("_row"), tick.alias("_tick"))
    both = marks.unionByName(asked, allowMissingColumns=True)
    ends = ticks.select(*keys, bucket, tick.alias("_tick")).groupBy(*keys, "_bucket").agg(F.max("_tick").alias("_last"))
    wanted = asked.select(*keys, "_bucket").distinct().withColumn("_last", F.lit(None).cast(ends.schema["_last"].dataType))
    all_buckets = ends.unionByName(wanted).groupBy(*keys, "_bucket").agg(F.max("_last").alias("_last"))
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = all_buckets.select(*keys, "_bucket", F.max("_last").over(earlier).alias("_carried"))
    inside = Window.partitionBy(*keys, "_bucket").orderBy("ts", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = both.withColumn("_seen", F.max("_tick").over(inside)).where("_side = 1")
    found = seen.join(carried, [*keys, "_bucket"], "left").withColumn("_t", F.coalesce("_seen", "_carried"))
    return found.select("_row.*", F.col("_t.rate").alias("rate"), F.col("_t.ts").alias("tick_ts"))


def latest(ticks: DataFrame, now: Column, stale_s: int = RATES_STALE_S) -> DataFrame:
    """ticks (asset, fiat, ts, event_id, rate, stale) -> the last one of each asset and fiat, its age at `now`, and whether it is stale and still usable.

    `now` is an aggregate or a literal, such as max("ts") or a time. A rate is stale if its feed said so or its age is above the limit; it is
    usable up to that age.
    """
    last = ticks.groupBy("asset", "fiat").agg(F.max(F.struct("ts", "event_id", "rate", "stale")).alias("t"))
    clock = ticks.agg(now.alias("now"))
    age = (micros(F.col("now")) - micros(F.col("t.ts"))) / 1e6
    timed = last.crossJoin(F.broadcast(clock)).withColumn("age_s", age)  # a clock is one row
    return timed.select("asset", "fiat", F.col("t.ts").alias("ts"), "now", F.col("t.rate").alias("rate"), "age_s", (F.coalesce("t.stale", F.lit(False)) | (F.col("age_s") > stale_s)).alias("stale"), (F.col("age_s") <= stale_s).alias("usable"))


def _links(ttl_us: int):
    """Good fetches, sorted by instance and time -> those that the cache made; the last link of an instance is carried over batches."""

    def jump(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        instance, due = None, 0
        for pdf in batches:
            names, times, taken = pdf["instance_id"].to_numpy(), pdf["ts_us"].to_numpy(), []
            starts = np.flatnonzero(np.r_[True, names[1:] != names[:-1]]) if len(pdf) else []
            for low, high in zip(starts, np.append(starts[1:], len(pdf)).astype(int)):
                if names[low] != instance:
                    instance, due = names[low], times[low]
                at = low + int(np.searchsorted(times[low:high], due))
                while at < high:
                    taken.append(at)
                    due = times[at] + ttl_us
                    at = max(at + 1, low + int(np.searchsorted(times[low:high], due)))
            yield pdf.iloc[taken]

    return jump


def replay(requests: DataFrame, ttl_s: int = RATES_TTL_S) -> DataFrame:
    """requests (instance_id, seq, ts, fetch_ok) -> instance_id, seq, status, served_seq.

    A request within the TTL of the last good fetch is `cached`. Later, it fetches: `fetched` if that works, else
    `stale` with the last good snapshot, or `error` without one; failed fetches are tried again by every
    request. Good fetches form a chain: the next good request at least a TTL after the last link. The chain is
    found by jumps over the sorted good requests, one jump for each link, in batches of bounded size; every request then
    takes the link before it.
    """
    us = micros(F.col("ts")).alias("ts_us")
    good = requests.where("fetch_ok").select("instance_id", "seq", us)

    good = good.repartition("instance_id").sortWithinPartitions("instance_id", "ts_us", "seq")
    links = good.mapInPandas(_links(ttl_s * 1_000_000), "instance_id long, seq long, ts_us long").select("instance_id", "seq", F.lit(True).alias("is_link"))
    timeline = Window.partitionBy("instance_id").orderBy("ts_us", "seq")
    marked = requests.select("instance_id", "seq", "fetch_ok", us).join(links, ["instance_id", "seq"], "left")
    link = F.when(F.col("is_link"), F.struct("ts_us", "seq"))
    last = F.last(link, ignorenulls=True).over(timeline.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = marked.withColumn("_last", last)
    status = F.when(F.col("is_link"), "fetched").when(F.col("_last").isNull(), "error").when(F.col("ts_us") - F.col("_last.ts_us") < ttl_s * 1_000_000, "cached").otherwise("stale")
    return out.select("instance_id", "seq", status.alias("status"), F.col("_last.seq").alias("served_seq"))
