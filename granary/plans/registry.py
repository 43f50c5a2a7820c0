"""Where queries register: a name, a function of (spark, folder), and SQL for the same rows if there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from granary.functions.storage import on_workers_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function):
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = function
        if sql:
            SQL[name] = sql
        return function

    return register


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    on_workers_path(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6, **places: int) -> DataFrame:
    """All doubles rounded, without negative zeros."""
    from pyspark.sql import functions as F

    return df.select(*[(F.round(F.col(f"`{n}`"), places.get(n, digits)) + F.lit(0.0)).alias(n) if t == "double" else F.col(f"`{n}`") for n, t in df.dtypes])


def share_sql(*keys) -> str:
    """SQL of ``granary.functions.order.share_of``: ``keys`` are columns (strings) or numbers."""
    return f"(('0x' || substr(md5(concat_ws(':', {', '.join(map(str, keys))})), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)"


def gaussian_sql(*keys) -> str:
    """SQL of ``granary.sources.generators.gaussian``, beginning with the id."""
    return f"(sqrt(-2 * ln(1 - {share_sql(*keys, 1)})) * cos({share_sql(*keys, 2)} * 6.283185307179586::DOUBLE))"
