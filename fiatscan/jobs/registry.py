"""The registered queries and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import fragment_jobs, frame_jobs, price_jobs, rate_jobs, stream_jobs, wallet_jobs  # noqa: F401
from .core import JOBS, ORACLES, Job


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return price_jobs.price_summary(spark, sf_dir)


def queries() -> dict[str, Job]:
    return dict(JOBS)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
