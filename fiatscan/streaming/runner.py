"""Running a stream over what is stored, once, into a table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fiatscan.functions.times import from_micros, micros
from fiatscan.sources.tables import new_path

MAX_FILES = 16
SLICES = 3


def read_stored(spark: SparkSession, sf_dir: str, table: str, max_files: int = MAX_FILES) -> DataFrame:
    """A stored table as a stream, in its own schema, at most so many files a micro-batch."""
    schema = spark.read.parquet(f"{sf_dir}/{table}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("maxFilesPerTrigger", max_files).parquet(f"{sf_dir}/{table}.parquet*")


def _started(stream: DataFrame, base: str) -> StreamingQuery:
    return stream.writeStream.format("parquet").outputMode("append").option("path", f"{base}/rows").option("checkpointLocation", f"{base}/progress").trigger(availableNow=True).start()


def drain(stream: DataFrame, name: str) -> DataFrame:
    """Runs a stream until its source is empty and reads what it wrote."""
    base = new_path(stream.sparkSession, name)
    _started(stream, base).awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{base}/rows")


def feed(table: DataFrame, time: str, start: Callable[[DataFrame], StreamingQuery], name: str, slices: int = SLICES) -> None:
    """Gives a stored table to a stream in slices of rising time: after each the stream ends, and starts again where it was.

    A stored table lies in no order of time, and a watermark drops what comes too late. So each slice is appended to the
    stream's source and taken as one micro-batch; state holds what a slice leaves open. Rows without a time come first.
    """
    spark, source = table.sparkSession, new_path(table.sparkSession, f"{name}-source")
    cuts = table.agg(F.percentile_approx(micros(F.col(time)), [k / slices for k in range(1, slices)])).first()[0] if slices > 1 else None
    cuts = sorted(set(cuts or []))
    at = lambda us: from_micros(F.lit(us)).cast(table.schema[time].dataType)
    for low, high in zip([None, *cuts], [*cuts, None]):
        part = table if low is None else table.where(F.col(time) >= at(low))
        part = part if high is None else part.where((F.col(time) < at(high)) | (F.col(time).isNull() if low is None else F.lit(False)))
        part.write.mode("append").parquet(source)
        start(spark.readStream.schema(table.schema).parquet(source)).awaitTermination()


def drain_in_time(table: DataFrame, time: str, made: Callable[[DataFrame], DataFrame], name: str, slices: int = SLICES) -> DataFrame:
    """What the stream `made` of a stored table, fed in slices of time, wrote."""
    spark, base, schemas = table.sparkSession, new_path(table.sparkSession, name), []

    def start(stream: DataFrame) -> StreamingQuery:
        out = made(stream)
        schemas.append(out.schema)
        return _started(out, base)

    feed(table, time, start, name, slices)
    return spark.read.schema(schemas[0]).parquet(f"{base}/rows")
