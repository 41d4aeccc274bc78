"""A registry of queries: each has a plan on the session's tables and, where SQL can say it, the same in SQL.

Both sides return the columns that a query's ``columns`` names, with ``:f`` as doubles rounded to six places and ``:i`` as
64-bit integers, so that engines which add up in different orders agree.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """Tables of one folder, read when asked for."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder
        spark.conf.set("spark.sql.session.timeZone", "UTC")  # days and sessions are defined in UTC

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def _spec(columns: str) -> list[tuple[str, str]]:
    return [(c.partition(":")[0], c.partition(":")[2]) for c in columns.split()]


def finish(df: DataFrame, columns: str) -> DataFrame:
    """Select and round."""
    out = []
    for c, kind in _spec(columns):
        x = F.col(c)
        if kind == "f":
            x = x.cast("double")
            x = F.round(F.when(~F.isnan(x), x), 6) + F.lit(0.0)
        elif kind == "i":
            x = x.cast("bigint")
        out.append(x.alias(c))
    return df.select(*out)


def sql_of(body: str, columns: str, ctes: str = "") -> str:
    kinds = {"f": "round(CAST({0} AS DOUBLE), 6) + 0.0", "i": "CAST({0} AS BIGINT)", "": "{0}"}
    select = ", ".join(f"{kinds[k].format(c)} AS {c}" for c, k in _spec(columns))
    return f"{'WITH ' + ctes if ctes else ''} SELECT {select} FROM ({body}) AS result_"


def query(columns: str, sql: str | None = None, ctes: str = ""):
    """Register a plan under its function's name."""

    def add(f: Callable[[Tables], DataFrame]):
        QUERIES[f.__name__] = lambda spark, folder: finish(f(Tables(spark, folder)), columns)
        if sql is not None:
            SQL[f.__name__] = sql_of(sql, columns, ctes)
        return f

    return add
