"""Row-shaped preparation: encodings, labels, and windows over an ordered key within a series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ordinal_encode(df: DataFrame, c: str, out: str | None = None) -> DataFrame:
    """0-based place of each category in sorted order; the categories, not the rows, are ranked."""
    places = df.filter(F.col(c).isNotNull()).select(F.col(c).alias("__v")).distinct().withColumn("__place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("__v")) - 1)
    return df.join(places, F.col(c) == F.col("__v"), "left").withColumn(out or c, F.col("__place")).drop("__v", "__place")


def one_hot(df: DataFrame, c: str, categories: list | None = None, most: int = 1000) -> DataFrame:
    """A 0/1 column per category but the first; all are -1 where the value is not among the fitted categories.

    Fits at most ``most`` categories, since each becomes a column; more raise ValueError.
    """
    if categories is None:
        categories = sorted(r[0] for r in df.filter(F.col(c).isNotNull()).select(c).distinct().limit(most + 1).collect())
        if len(categories) > most:
            raise ValueError(f"column {c!r} has more than {most} categories")
    known = F.col(c).isin(*categories)
    return df.withColumns({f"{c}_{v}": F.when(F.col(c) == F.lit(v), 1).when(known, 0).otherwise(-1) for v in categories[1:]})


def lead_label(df: DataFrame, series: list[str], order: str, high: str, low: str, name: str = "target") -> DataFrame:
    """1 if the next row of the series has ``high`` above ``low``, else 0; null in a series' last row."""
    at = Window.partitionBy(*series).orderBy(order)
    return df.withColumn(name, F.lead(F.when(F.col(high) > F.col(low), 1).otherwise(0)).over(at))


def difference(df: DataFrame, series: list[str], order: str, c: str, name: str | None = None) -> DataFrame:
    at = Window.partitionBy(*series).orderBy(order)
    return df.withColumn(name or f"{c}_diff", F.col(c) - F.lag(c).over(at))


def indicators(df: DataFrame, series: list[str], order: str, close: str, high: str, low: str, length: int = 7) -> DataFrame:
    """sma, roc, willr, cci, trima and rsi over ``length`` rows; null until a window is full.

    ``rsi`` compares the simple means of gains and losses. All share one window order, hence one sort.
    """
    at = Window.partitionBy(*series).orderBy(order)
    last = at.rowsBetween(1 - length, 0)
    full = lambda v: F.when(F.count(close).over(last) == length, v)
    typical = (F.col(high) + F.col(low) + F.col(close)) / 3
    step = F.col(close) - F.lag(close).over(at)
    rows = df.withColumns({"__typical": typical, "__gain": F.when(step.isNotNull(), F.greatest(step, F.lit(0.0))), "__loss": F.when(step.isNotNull(), F.greatest(-step, F.lit(0.0)))})
    top, bottom = F.max(high).over(last), F.min(low).over(last)
    rows = rows.withColumns({
        "sma": full(F.avg(close).over(last)),
        "roc": 100 * (F.col(close) / F.nullif(F.lag(close, length).over(at), F.lit(0.0)) - 1),
        "willr": full(-100 * (top - F.col(close)) / F.nullif(top - bottom, F.lit(0.0))),
        "__mean": F.avg("__typical").over(last),
        "__all": F.collect_list("__typical").over(last),
        "__up": F.sum("__gain").over(last), "__down": F.sum("__loss").over(last), "__steps": F.count("__gain").over(last),
    })
    spread = F.aggregate("__all", F.lit(0.0), lambda a, x: a + F.abs(x - F.col("__mean"))) / length
    half = -(-length // 2)
    short = at.rowsBetween(1 - half, 0)
    rows = rows.withColumns({"cci": full((F.col("__typical") - F.col("__mean")) / F.nullif(0.015 * spread, F.lit(0.0))), "__half": F.avg(close).over(short), "rsi": F.when(F.col("__steps") == length, 100 * F.col("__up") / F.nullif(F.col("__up") + F.col("__down"), F.lit(0.0)))})
    rows = rows.withColumn("trima", full(F.avg("__half").over(at.rowsBetween(half - length, 0))))
    return rows.drop("__typical", "__gain", "__loss", "__mean", "__all", "__up", "__down", "__steps", "__half")


def join_series(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Align two series by their key, keeping the rows of both."""
    return left.join(right, key, "full_outer")


def select_features(df: DataFrame, cols: list[str], places: list[int]) -> DataFrame:
    return df.select(*[cols[i] for i in places])


def select_sequence_features(sequence: str, places: list[int]) -> Column:
    """The inner arrays of a sequence column, reduced to ``places``."""
    return F.transform(sequence, lambda r: F.array(*[F.get(r, F.lit(i)) for i in places]))
