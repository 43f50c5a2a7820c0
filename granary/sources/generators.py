"""Synthetic tables with a known truth, drawn from hashes of the row id: the same rows on any cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions.order import share_of


def uniform(seed: int, *keys) -> Column:
    """In [0, 1), from a hash of the row id."""
    return share_of("id", seed, *keys)


def gaussian(seed: int, *keys) -> Column:
    return F.sqrt(-2 * F.ln(1 - uniform(seed, *keys, 1))) * F.cos(uniform(seed, *keys, 2) * 6.283185307179586)


def planted_pair(spark: SparkSession, n: int = 1000, m: int = 10, scale: float = 10.0, a: int = 3, b: int = 8, problem: str = "classification", seed: int = 17) -> DataFrame:
    """id, x0 ..., y: only features a and b matter; classes are split at the median of their product."""
    rows = spark.range(n).select("id", *[(uniform(seed, i) * scale).alias(f"x{i}") for i in range(m)])
    product = F.col(f"x{a}") * F.col(f"x{b}")
    if problem == "regression":
        return rows.withColumn("y", 0.5 * F.col(f"x{a}") + 0.5 * F.col(f"x{b}"))
    cut = rows.agg(F.median(product)).first()[0]
    return rows.withColumn("y", F.when(product < F.lit(cut), 0).otherwise(1))


def planted_linear(spark: SparkSession, n: int = 1000, m: int = 5, seed: int = 17) -> DataFrame:
    """id, x0 ..., y = x0 + 2 x2 with standard normal features."""
    rows = spark.range(n).select("id", *[gaussian(seed, i).alias(f"x{i}") for i in range(m)])
    return rows.withColumn("y", F.col("x0") + 2 * F.col("x2"))


def blobs(spark: SparkSession, n: int = 1000, centers: list[tuple[float, float]] = ((0.0, 0.0),), sd: float = 0.5, seed: int = 17) -> DataFrame:
    """id, x, y, blob."""
    which = (F.col("id") % len(centers)).cast("int")
    at = lambda i: F.get(F.array(*[F.lit(float(c[i])) for c in centers]), which)
    return spark.range(n).select("id", (at(0) + gaussian(seed, 0) * sd).alias("x"), (at(1) + gaussian(seed, 1) * sd).alias("y"), which.alias("blob"))


def rings(spark: SparkSession, radii: list[tuple[float, int]] = ((500.0, 1000), (300.0, 700), (100.0, 300)), noise: float = 30.0, background: int = 300, seed: int = 17) -> DataFrame:
    """id, x, y, ring: points on noisy circles, and uniform ones (ring -1)."""
    out = None
    for k, (r, n) in enumerate(radii):
        angle = F.col("id") * (6.283185307179586 / n)
        one = spark.range(n).select((F.col("id") + k * 1_000_000).alias("id"), (F.cos(angle) * r + gaussian(seed, k, 1) * noise).alias("x"), (F.sin(angle) * r + gaussian(seed, k, 2) * noise).alias("y"), F.lit(k).alias("ring"))
        out = one if out is None else out.unionByName(one)
    rest = spark.range(background).select((F.col("id") + 1_000_000_000).alias("id"), (uniform(seed, 8) * 1200 - 600).alias("x"), (uniform(seed, 9) * 1200 - 600).alias("y"), F.lit(-1).alias("ring"))
    return out.unionByName(rest)


def informative(spark: SparkSession, n: int = 10_000, m: int = 50, k: int = 20, problem: str = "classification", seed: int = 17) -> DataFrame:
    """id, x0 ..., y: the first k features carry the label."""
    rows = spark.range(n).select("id", *[gaussian(seed, i).alias(f"x{i}") for i in range(m)])
    total = sum((F.col(f"x{i}") * (1.0 + i % 3) for i in range(k)), F.lit(0.0))
    return rows.withColumn("y", F.when(total > 0, 1).otherwise(0) if problem == "classification" else total)
