"""Registry of named jobs: a Spark callable ``(spark, sf_dir) -> DataFrame``
and, where the result is expressible in SQL, its DuckDB oracle text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.fixtures import duck_with, view

JOBS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def job(name: str, oracle: str | None = None):
    def deco(fn):
        if name in JOBS:
            raise ValueError(f"duplicate job {name}")
        JOBS[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn
    return deco


def v(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return view(spark, sf_dir, name)


def w(*names: str) -> str:
    return duck_with(*names)


def ts_text(col):
    """Timestamp as text with microseconds: identical in both engines' results."""
    from pyspark.sql import functions as F
    c = F.col(col) if isinstance(col, str) else col
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def duck_ts(col: str) -> str:
    return f"strftime({col}, '%Y-%m-%d %H:%M:%S.%f')"
