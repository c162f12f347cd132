"""The streams over stored tables; each must equal its batch form, as far as its watermark has come."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fiatscan.functions import text_price
from fiatscan.functions.times import micros
from fiatscan.operators import rates as rate_ops
from fiatscan.sources.tables import new_path
from fiatscan.streaming import kept, runner, stateful, timed

from .core import job
from .fixtures import load, with_tables
from .frame_jobs import QUALITY_SQL, STABLE_SQL
from .price_jobs import detect_sql
from .rate_jobs import AS_OF_SQL, DAY_S, LATEST_SQL, REPLAY_SQL, converted, described


@job(STABLE_SQL + " select session_id, seq, amount, currency from s")
def stream_stable_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confirmed prices from a stream of readings."""
    readings = load(spark, sf_dir, "readings", runner.read_stored(spark, sf_dir, "events"))
    return runner.drain(stateful.stable_prices(readings), "stable")


@job(REPLAY_SQL)
def stream_cache_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a cache answers to a stream of requests."""
    requests = load(spark, sf_dir, "rate_requests", runner.read_stored(spark, sf_dir, "events"))
    return runner.drain(stateful.cache_replay(requests, DAY_S), "replay")


@job(QUALITY_SQL)
def stream_frame_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gate over a stream of frames."""
    frames = load(spark, sf_dir, "frames", runner.read_stored(spark, sf_dir, "embeddings"))
    out = runner.drain(stateful.frame_gate(frames), "gate")
    return out.select("frame_id", *[F.round(c, 6).alias(c) for c in ("sharpness", "contrast", "motion")], "reason")


@job(with_tables("price_labels", "rates") + "," + detect_sql("price_labels") + " select label_id, asset, currency, amount, amount / rate as asset_amount from detected join rates on fiat = currency where amount > 0")
def stream_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels detected and converted as they come."""
    labels = load(spark, sf_dir, "price_labels", runner.read_stored(spark, sf_dir, "orders"))
    out = stateful.priced(labels, load(spark, sf_dir, "rates")).select("label_id", "asset", "currency", "amount", "asset_amount")
    return runner.drain(out, "prices")


# The watermark of a stream is the newest time in it, in milliseconds, less ten minutes.
_WATERMARK = "(select epoch_us(max(ts)) // 1000 * 1000 - 600000000 from {})"


@job(with_tables("rate_ticks") + f""", good as (select distinct asset, fiat, epoch_us(ts) as us from rate_ticks where not stale),
gaps as (select *, lead(us) over (partition by asset, fiat order by us) as after from good)
select asset, fiat, us as last_us, us + 300000000 as stale_us from gaps where (after is null or after > us + 300000000) and us + 300000000 < {_WATERMARK.format("rate_ticks")}""")
def stream_stale_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each time that a rate went stale for want of a good tick."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    out = runner.drain_in_time(events, "ts", lambda stream: timed.stale_rates(load(spark, sf_dir, "rate_ticks", stream)), "stale")
    return out.select("asset", "fiat", micros(F.col("last_ts")).alias("last_us"), micros(F.col("stale_ts")).alias("stale_us"))


@job(AS_OF_SQL + f" where epoch_us(e.ts) < {_WATERMARK.format('(select ts from priced_events union all select ts from rate_ticks)')}")
def stream_rate_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events converted at the rate of their time, from two streams; events that the watermark has not passed wait."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")

    def made(stream: DataFrame) -> DataFrame:
        return timed.as_of(load(spark, sf_dir, "priced_events", stream), load(spark, sf_dir, "rate_ticks", stream), ["asset", "fiat"])

    return converted(runner.drain_in_time(events, "ts", made, "as-of"))


@job(LATEST_SQL)
def stream_latest_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of latest rates that a stream keeps, stopped and started again between slices of time."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    path, progress = new_path(spark, "latest"), new_path(spark, "latest-progress")
    runner.feed(events, "ts", lambda stream: kept.keep_latest(load(spark, sf_dir, "rate_ticks", stream), path, progress), "latest")
    return described(rate_ops.latest(kept.read_latest(spark, path), F.max("ts")))


SCANNED = "frame_id long, text string, confidence int"
_SCANNED_SQL = """, scanned as (select frame_id, case when list_sum(gray) >= 128 * len(gray) then '€ ' else 'CHF ' end || cast(list_sum(gray[1:8]) as bigint) || case when gray[9] % 3 = 0 then ' ' else '.' end || lpad(cast(gray[10] % 100 as varchar), 2, '0') as text,
  cast(list_max(gray) * 100 // 255 as int) as confidence from frames),"""


def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A stand-in for a text recogniser, whose readings follow from the levels: a price of the first line, light frames in euros."""
    for pdf in batches:
        texts, confidences = [], []
        for gray in map(np.asarray, pdf["gray"]):
            sign, gap = "€" if gray.mean() >= 128 else "CHF", " " if gray[8] % 3 == 0 else "."
            texts.append(f"{sign} {gray[:8].sum()}{gap}{gray[9] % 100:02d}")
            confidences.append(int(gray.max()) * 100 // 255)
        yield pd.DataFrame({"frame_id": pdf["frame_id"], "text": texts, "confidence": confidences})


@job(with_tables("frames") + _SCANNED_SQL + detect_sql("scanned") + " select frame_id, text, confidence, amount, currency from detected")
def stream_recognised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames through a recogniser, and the prices in what it reads."""
    frames = load(spark, sf_dir, "frames", runner.read_stored(spark, sf_dir, "embeddings"))
    read = stateful.recognised(frames.select("frame_id", "gray"), scan, SCANNED)
    return runner.drain(text_price.detect(read, "text"), "recognised")
