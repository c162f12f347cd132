"""Tables between the steps of a job, in the folder that all machines share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a folder of our own where that is unset and all runs on one machine (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_PATHS: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    _PATHS.append(f"{folder(spark)}/{name}-{uuid.uuid4().hex}")
    return _PATHS[-1]


def clear(spark: SparkSession) -> None:
    """Deletes what this session has put in the folder. Call it when the results are written."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    while _PATHS:
        path = spark._jvm.org.apache.hadoop.fs.Path(_PATHS.pop())
        path.getFileSystem(conf).delete(path, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """df written once and read back by each of its consumers."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
