"""Scalers and the quantile transform: one aggregate job to fit, a projection or a join to transform."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.functions.columns import numeric
from granary.functions.distributions import normal_ppf, normal_ppf_of
from granary.functions.order import exact_quantiles, value_ranks
from granary.functions.storage import materialize


@dataclass
class ScalerModel:
    """(x - center) / scale per column; a scale of 0 gives null."""

    center: dict[str, float]
    scale: dict[str, float]

    def transform(self, df: DataFrame) -> DataFrame:
        numeric(df, list(self.center))
        return df.withColumns({c: (F.col(c).cast("double") - F.lit(m)) / F.nullif(F.lit(self.scale[c]), F.lit(0.0)) for c, m in self.center.items()})

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.col(c) * F.lit(self.scale[c]) + F.lit(m) for c, m in self.center.items()})


KINDS = ("standard", "minmax", "robust")


@dataclass
class Scaler:
    """``standard``: mean and population deviation; ``minmax``: minimum and range; ``robust``: median and quartile range."""

    kind: str
    cols: list[str]

    def __post_init__(self):
        if self.kind not in KINDS:
            raise ValueError(f"unknown kind {self.kind!r}")

    def fit(self, df: DataFrame) -> ScalerModel:
        cols = numeric(df, self.cols)
        if self.kind == "robust":
            found = exact_quantiles(df, cols, [0.25, 0.5, 0.75])
            return ScalerModel({c: q[1] for c, q in found.items()}, {c: None if q[0] is None else q[2] - q[0] for c, q in found.items()})
        pair = (F.avg, F.stddev_pop) if self.kind == "standard" else (F.min, F.max)
        got = df.agg(*[f(F.col(c).cast("double")) for c in cols for f in pair]).first()
        center, other = dict(zip(cols, got[::2])), dict(zip(cols, got[1::2]))
        if self.kind == "minmax":
            other = {c: None if v is None else v - center[c] for c, v in other.items()}
        return ScalerModel(center, other)

    def fit_transform(self, df: DataFrame) -> DataFrame:
        return self.fit(df).transform(df)


@dataclass
class QuantileModel:
    """The distinct values of the training column with their ranks stay a distributed table."""

    distribution: str
    tables: dict[str, DataFrame]
    totals: dict[str, int]
    extremes: dict[str, tuple[float, float]] = field(default_factory=dict)

    def transform(self, df: DataFrame, suffix: str = "") -> DataFrame:
        """Share of training rows at or below each value; ``normal`` maps it by the normal quantile.

        A value of the training column is a join on it. Others take the rank of the next lower training value, which a
        union sorted by value finds. Beyond the ends, the normal form is clamped to the outermost finite quantiles.
        """
        from pyspark.sql import Window

        from granary.functions.order import bounds_of, range_of

        for c, table in self.tables.items():
            n = self.totals[c]
            known = table.select(F.col("value").cast("double").alias("__v"), ((F.col("below") + F.col("n")) / F.lit(n)).alias("__u"))
            asked = df.select(F.col(c).cast("double").alias("__v")).distinct().filter("__v IS NOT NULL").join(known, "__v", "left")
            gaps = asked.filter("__u IS NULL").select("__v", F.lit(None).cast("double").alias("__u"))
            both = gaps.unionByName(known)
            ranged = both.withColumn("__range", range_of(F.col("__v"), bounds_of(table, F.col("value"))))
            tops = ranged.groupBy("__range").agg(F.max("__u").alias("__top"))
            upto = Window.partitionBy(F.lit(0)).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
            tops = tops.select("__range", F.max("__top").over(upto).alias("__lower"))
            own = F.max("__u").over(Window.partitionBy("__range").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0))
            ecdf = ranged.withColumn("__own", own).join(F.broadcast(tops), "__range").select("__v", F.coalesce("__own", "__lower", F.lit(0.0)).alias("__e"))
            out = F.col("__e")
            if self.distribution == "normal":
                low, high = self.extremes[c]
                e = F.col("__e")
                inner = F.least(F.greatest(normal_ppf_of(e), F.lit(low)), F.lit(high))
                out = F.when(e <= 0, F.lit(low)).when(e >= 1, F.lit(high)).otherwise(inner)
            found = ecdf.select(F.col("__v"), out.alias("__out"))
            df = df.join(found, F.col(c).cast("double") == F.col("__v"), "left").drop("__v")
            df = df.withColumn(c + suffix, F.col("__out")).drop("__out")
        return df


@dataclass
class QuantileTransformer:
    cols: list[str]
    distribution: str = "normal"

    def __post_init__(self):
        if self.distribution not in ("normal", "uniform"):
            raise ValueError(f"unknown distribution {self.distribution!r}")

    def fit(self, df: DataFrame) -> QuantileModel:
        tables, totals, ends = {}, {}, {}
        for c in numeric(df, self.cols):
            tables[c] = materialize(value_ranks(df, c), "quantiles")  # it is read several times
            first, second, total = tables[c].agg(F.min(F.col("below") + F.col("n")), F.max("below"), F.sum("n")).first()
            totals[c] = total or 0
            n = max(totals[c], 1)
            ends[c] = (normal_ppf((first or 0) / n), normal_ppf((second or 0) / n))
            if math.isinf(ends[c][0]) or math.isinf(ends[c][1]):
                ends[c] = (min(0.0, ends[c][1]) if math.isinf(ends[c][0]) else ends[c][0], max(0.0, ends[c][0]) if math.isinf(ends[c][1]) else ends[c][1])
        return QuantileModel(self.distribution, tables, totals, ends)

    def fit_transform(self, df: DataFrame) -> DataFrame:
        return self.fit(df).transform(df)
