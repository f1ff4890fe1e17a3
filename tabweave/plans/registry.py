"""Where queries over the reference operators are registered, each with the SQL that states the same."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabweave.session import ship

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


class Tables:
    """The tables of a folder, read when they are named."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def wide_integers(df: DataFrame) -> DataFrame:
    """All integers as bigint, so that results compare by value."""
    return df.select(*(F.col(f"`{n}`").cast("bigint").alias(n) if k in ("int", "smallint", "tinyint") else F.col(f"`{n}`") for n, k in df.dtypes))


def query(sql: str | None = None) -> Callable[[Callable[[Tables], DataFrame]], Query]:
    """Registers a function of the tables under its name."""

    def add(f: Callable[[Tables], DataFrame]) -> Query:
        @wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return wide_integers(f(Tables(spark, sf_dir)))

        QUERIES[f.__name__] = run
        if sql:
            ORACLE[f.__name__] = sql
        return run

    return add
