"""What the operators share: the shared folder, tables written into it, and bounded Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines see: spark.checkpoint.dir, or one of our own where that is unset and all runs on one machine (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_PATHS: list[str] = []
_TABLES: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    _PATHS.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _PATHS[-1]


def new_table(spark: SparkSession, name: str) -> tuple[str, str]:
    """A name for the session's catalog, as bucketed tables need one, and a path in the shared folder."""
    path = new_path(spark, name)
    _TABLES.append(path.rsplit("/", 1)[1].replace("-", "_"))
    return _TABLES[-1], path


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """The session's setting, as long as the block runs."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def clear(spark: SparkSession) -> None:
    """Deletes the tables that this session's operators have put in the shared folder. Call it when their results are written."""
    while _TABLES:
        spark.sql(f"drop table if exists {_TABLES.pop()}")
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    while _PATHS:
        path = spark._jvm.org.apache.hadoop.fs.Path(_PATHS.pop())
        path.getFileSystem(conf).delete(path, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read back: its lineage is cut and each consumer reads only its columns."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Arrow batches of few rows, so that a run of very long texts stays small in a Python worker."""
    spark.conf.set(ARROW_ROWS, str(rows))
    spark.conf.set(ARROW_BYTES, str(16 << 20))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_of_id(column: str = "doc_id"):
    """crc32 of a row's id as text, the rule by which rows are held out of training."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df does not have, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while f"_{name}" in taken:
        name = f"{name}_"
    return f"_{name}"
