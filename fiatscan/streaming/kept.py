"""The latest rates as a table that a stream keeps up to date.

Each micro-batch writes a version of the table under its own number, made from the newest complete version below that number and
the batch. So the names of the versions are the ledger: a batch that is run again after a failure reads the same version and writes the same
one over. A reader takes the newest complete version; the one before stays until the next batch. The table has a row for each asset and fiat, so
its rewriting does not grow with the ticks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

SCHEMA = "asset string, fiat string, ts timestamp_ntz, event_id long, rate double, stale boolean"


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the complete versions, rising."""
    at, fs = _fs(spark, path)
    if not fs.exists(at):
        return []
    done = spark._jvm.org.apache.hadoop.fs.Path
    names = [f.getPath().getName() for f in fs.listStatus(at)]
    return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit() and fs.exists(done(f"{path}/{n}/_SUCCESS")))


def merge(batch: DataFrame, batch_id: int, path: str) -> None:
    """Writes version `batch_id`: the last tick of each asset and fiat by time, then event_id. Ticks without time are older than any other."""
    spark = batch.sparkSession
    before = [v for v in versions(spark, path) if v < batch_id]
    ticks = batch.select("asset", "fiat", F.col("ts").cast("timestamp_ntz").alias("ts"), "event_id", "rate", "stale")
    if before:
        ticks = ticks.unionByName(spark.read.schema(SCHEMA).parquet(f"{path}/v{before[-1]}"))
    last = ticks.groupBy("asset", "fiat").agg(F.max(F.struct("ts", "event_id", "rate", "stale")).alias("t"))
    last.select("asset", "fiat", "t.*").write.mode("overwrite").parquet(f"{path}/v{batch_id}")
    for old in before[:-1]:
        at, fs = _fs(spark, f"{path}/v{old}")
        fs.delete(at, True)


def keep_latest(ticks: DataFrame, path: str, progress: str) -> StreamingQuery:
    """Starts the stream that keeps the table at `path`, up to the end of what its source holds now."""
    return ticks.writeStream.foreachBatch(lambda batch, batch_id: merge(batch, batch_id, path)).option("checkpointLocation", progress).trigger(availableNow=True).start()


def read_latest(spark: SparkSession, path: str) -> DataFrame:
    """The newest complete version; empty before the first."""
    found = versions(spark, path)
    return spark.read.schema(SCHEMA).parquet(f"{path}/v{found[-1]}") if found else spark.createDataFrame([], SCHEMA)
