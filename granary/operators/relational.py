"""Table-shaped steps of data preparation that need more than one DataFrame call."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.order import exact_quantiles, share_of, with_row_id


def merge_by_position(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """The i-th row of one table beside the i-th of the other, in the order of numeric keys; rows without a partner stay."""
    a, b = with_row_id(left, left_key, name="__place"), with_row_id(right, right_key, name="__place")
    return a.join(b, "__place", "full_outer").drop("__place")


def labels_of(rows: DataFrame, kept: DataFrame, key: str) -> DataFrame:
    """Rows whose key survives in ``kept``."""
    return rows.join(kept.select(key).distinct(), key, "left_semi")


def without(rows: DataFrame, dropped: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not in ``dropped``."""
    return rows.join(dropped.select(key).distinct(), key, "left_anti")


def in_all(key: str, *tables: DataFrame) -> DataFrame:
    """Keys that every table has."""
    out = tables[0].select(key).distinct()
    for t in tables[1:]:
        out = out.intersect(t.select(key))
    return out


def agreement(found: DataFrame, truth: DataFrame, universe: DataFrame, key: str) -> DataFrame:
    """One row: tp, fp, fn, tn of a found set of keys against the true one, within a universe."""
    side = lambda t, name: t.select(key).distinct().withColumn(name, F.lit(True))
    rows = universe.select(key).distinct().join(side(found, "f"), key, "left").join(side(truth, "t"), key, "left")
    f, t = F.coalesce("f", F.lit(False)), F.coalesce("t", F.lit(False))
    return rows.agg(F.count_if(f & t).alias("tp"), F.count_if(f & ~t).alias("fp"), F.count_if(~f & t).alias("fn"), F.count_if(~f & ~t).alias("tn"))


def subsets(names: list[str], most: int = 16) -> list[tuple[str, ...]]:
    """All non-empty subsets, the small ones first; more than ``most`` names raise ValueError."""
    if len(names) > most:
        raise ValueError(f"{len(names)} names have too many subsets")
    return [s for n in range(1, len(names) + 1) for s in itertools.combinations(names, n)]


def hash_sample(rows: DataFrame, key: str, share: float, seed: int = 17) -> DataFrame:
    """``rows`` with ``sampled``: a simple random sample by a hash of the key, and the rest."""
    return rows.withColumn("sampled", share_of(key, seed) < share)


def clamp(c: Column, low: float | None = None, high: float | None = None) -> Column:
    out = c.cast("double")
    out = out if low is None else F.greatest(out, F.lit(float(low)))
    return out if high is None else F.least(out, F.lit(float(high)))


def class_scatter(df: DataFrame, cols: list[str], label: str) -> DataFrame:
    """(a, b, within, between) for each pair of columns: sums of products around class means, and of class means."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    d = lambda c: F.col(c).cast("double")
    groups = df.groupBy(label).agg(F.count("*").alias("__n"), *[F.avg(d(c)).alias(f"__m_{c}") for c in cols], *[(F.covar_pop(d(a), d(b)) * F.count("*")).alias(f"__s_{a}_{b}") for a, b in pairs])
    means = groups.agg(*[(F.sum(F.col("__n") * F.col(f"__m_{c}")) / F.sum("__n")).alias(f"__t_{c}") for c in cols])
    joined = groups.crossJoin(F.broadcast(means))  # a row per class beside one row
    gap = lambda c: F.col(f"__m_{c}") - F.col(f"__t_{c}")
    sums = joined.agg(*[F.sum(f"__s_{a}_{b}").alias(f"w{i}") for i, (a, b) in enumerate(pairs)], *[F.sum(F.col("__n") * gap(a) * gap(b)).alias(f"b{i}") for i, (a, b) in enumerate(pairs)])
    rows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"w{i}").alias("within"), F.col(f"b{i}").alias("between")) for i, (a, b) in enumerate(pairs)])
    return sums.select(F.explode(rows).alias("r")).select("r.*")


def both_ranked_high(scores: DataFrame, name: str, first: str, second: str, q: float = 0.75) -> DataFrame:
    """Rows whose two ranks both reach their quantile ``q``."""
    cuts = exact_quantiles(scores, [first, second], [q])
    return scores.filter((F.col(first) >= F.lit(cuts[first][0])) & (F.col(second) >= F.lit(cuts[second][0]))).select(name, first, second)
