"""Readers and writers: declared schemas, named index columns, models and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Columns of market prices by ticker and date.
PRICES = "date timestamp_ntz, ticker string, open double, high double, low double, close double, volume double"


def read_csv(spark: SparkSession, path: str, schema: str, header: bool = True) -> DataFrame:
    """With a declared schema, so that the file is not read twice; NaN and empty fields are null."""
    from granary.functions.columns import nan_to_null

    return nan_to_null(spark.read.schema(schema).option("header", header).csv(path))


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    from granary.functions.columns import nan_to_null

    return nan_to_null(spark.read.parquet(path))


def write_parquet(df: DataFrame, path: str, partition_by: list[str] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def save_model(model, path: str) -> None:
    """A fitted pyspark.ml model."""
    model.write().overwrite().save(path)


def load_model(kind, path: str):
    return kind.load(path)
