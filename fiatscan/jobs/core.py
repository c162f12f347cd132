"""Registering a job: its name, its function of (spark, sf_dir), and the DuckDB SQL of equal result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Job = Callable[[SparkSession, str], DataFrame]
JOBS: dict[str, Job] = {}
ORACLES: dict[str, str] = {}


def job(oracle: str | None = None) -> Callable[[Job], Job]:
    def register(f: Job) -> Job:
        JOBS[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register
