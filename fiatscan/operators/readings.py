"""Readings of a scan session: the prices that are read twice in a row."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType


BUCKET_SECONDS = 3600


def stable(readings: DataFrame, bucket_seconds: int = BUCKET_SECONDS) -> DataFrame:
    """Readings (session_id, seq, ts, amount, currency) at which a price is confirmed.

    A price is confirmed by the second equal reading in a row, and then counting starts over; a null
    reading breaks the row. Equal readings form runs, and every second place of a run confirms.

    A session is dealt out by buckets of time, so that a very long one is spread over tasks. Runs are found inside the buckets. A bucket is then one row: its first and last
    reading, the length of its last run, and whether it is one run as a whole. Over these rows runs are carried on, and a bucket's
    first run goes on from the length that is carried in.
    """
    key = ["session_id", "_bucket"]
    order = Window.partitionBy(*key).orderBy("ts", "seq")
    price = F.when(F.col("amount").isNotNull(), F.struct("amount", "currency"))
    time = F.col("ts") if isinstance(readings.schema["ts"].dataType, NumericType) else F.col("ts").cast("timestamp")
    marked = readings.withColumns({"_price": price, "_bucket": F.floor(time.cast("double") / bucket_seconds)})
    changed = (F.row_number().over(order) == 1) | ~F.col("_price").eqNullSafe(F.lag("_price").over(order))
    runs = marked.withColumn("_new", changed.cast("int")).withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    runs = runs.withColumn("_place", F.row_number().over(Window.partitionBy(*key, "_run").orderBy("ts", "seq")))
    at = F.struct("ts", "seq")
    buckets = runs.groupBy(*key).agg(F.min_by("_price", at).alias("first"), F.max_by("_price", at).alias("last"), F.max_by("_place", at).alias("tail"), (F.max("_run") == 1).alias("whole"))
    by_time = Window.partitionBy("session_id").orderBy("_bucket")
    goes_on = (F.row_number().over(by_time) > 1) & F.col("first").eqNullSafe(F.lag("last").over(by_time))
    buckets = buckets.withColumn("goes_on", goes_on).withColumn("begins", (~(F.col("goes_on") & F.col("whole"))).cast("int"))
    buckets = buckets.withColumn("chain", F.sum("begins").over(by_time.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    along = Window.partitionBy("session_id", "chain").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    buckets = buckets.withColumn("after", F.sum("tail").over(along))
    carried = buckets.select(*key, F.when(F.col("goes_on"), F.lag("after").over(by_time)).otherwise(0).alias("_carried"))
    place = F.col("_place") + F.when(F.col("_run") == 1, F.col("_carried")).otherwise(0)
    out = runs.where(F.col("_price").isNotNull()).join(carried, key).where(place % 2 == 0)
    return out.select(*readings.columns)


def first_stable(confirmed: DataFrame) -> DataFrame:
    """The first confirmed price of each session, at which a scan stops."""
    return confirmed.groupBy("session_id").agg(F.min_by(F.struct("seq", "ts", "amount", "currency"), F.struct("ts", "seq")).alias("r")).select("session_id", "r.*")
