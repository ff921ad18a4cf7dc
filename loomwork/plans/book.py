"""Where modules enter their queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Tables:
    """The tables of a folder, read when they are asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


class Book:
    """Queries by name, and SQL for those that SQL can express."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracle: dict[str, str] = {}

    def add(self, name: str, make: Callable[[Tables], DataFrame], sql: str | None = None) -> None:
        if name in self.queries:
            raise ValueError(f"{name} is entered twice")
        self.queries[name] = lambda spark, sf_dir: _plain_zero(make(Tables(spark, sf_dir)))
        if sql:
            self.oracle[name] = sql


def _plain_zero(df: DataFrame) -> DataFrame:
    """Negative zeros, which rounding leaves, as zero."""
    return df.withColumns({c: F.col(c) + 0.0 for c, kind in df.dtypes if kind == "double"})
