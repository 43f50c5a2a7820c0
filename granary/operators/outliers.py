"""Outlier flags: fitted limits of one column, Mahalanobis distance, local outlier factor, isolation forest."""

from __future__ import annotations

import math
import random
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.columns import numeric
from granary.functions.distributions import chi2_isf
from granary.functions.order import exact_quantiles
from granary.functions.storage import materialize
from granary.operators.nearby import GRID_METRICS, near_lists, nearest


@dataclass
class LimitModel:
    """A value is an outlier if it lies outside [low, high]."""

    column: str
    low: float
    high: float

    def flag(self) -> Column:
        x = F.col(self.column).cast("double")
        return F.coalesce((x < F.lit(self.low)) | (x > F.lit(self.high)), F.lit(False))

    def find_outliers(self, df: DataFrame) -> DataFrame:
        return df.filter(self.flag())

    def remove_outliers(self, df: DataFrame) -> DataFrame:
        return df.filter(~self.flag())


def fit_limits(df: DataFrame, column: str, method: str = "z", threshold: float = 3.0, const: float = 0.6745) -> LimitModel:
    """``std`` and ``z``: mean and population deviation; ``robust``: median and median absolute deviation; ``iqr``: quartiles."""
    x = F.col(numeric(df, [column])[0]).cast("double")
    if method in ("std", "z"):
        m, s = df.agg(F.avg(x), F.stddev_pop(x)).first()
        t = 3.0 if method == "std" else threshold
        return LimitModel(column, m - t * s, m + t * s)
    if method == "robust":
        m = exact_quantiles(df, [column], [0.5])[column][0]
        mad = exact_quantiles(df.select(F.abs(x - F.lit(m)).alias("gap")), ["gap"], [0.5])["gap"][0]
        return LimitModel(column, m - threshold * mad / const, m + threshold * mad / const)
    if method == "iqr":
        q1, q3 = exact_quantiles(df, [column], [0.25, 0.75])[column]
        return LimitModel(column, q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1))
    raise ValueError(f"unknown method {method!r}")


def flagged_by_all(df: DataFrame, models: list[LimitModel]) -> DataFrame:
    """Rows that every model flags."""
    out = df
    for m in models:
        out = out.filter(m.flag())
    return out


@dataclass
class MahalanobisModel:
    cols: list[str]
    mean: list[float]
    inverse: list[list[float]]
    threshold: float

    def distance(self) -> Column:
        gaps = [F.col(c).cast("double") - F.lit(m) for c, m in zip(self.cols, self.mean)]
        total = F.lit(0.0)
        for i, a in enumerate(gaps):
            for j, b in enumerate(gaps):
                total = total + a * b * F.lit(self.inverse[i][j])
        return F.sqrt(total)

    def find_outliers(self, df: DataFrame) -> DataFrame:
        return df.filter(self.distance() > F.lit(self.threshold))

    def remove_outliers(self, df: DataFrame) -> DataFrame:
        return df.filter(~(self.distance() > F.lit(self.threshold)))


def covariance(df: DataFrame, cols: list[str]) -> tuple[np.ndarray, np.ndarray, int]:
    """Means, sample covariance matrix and row count of columns, in one aggregate job."""
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    d = [F.col(c).cast("double") for c in numeric(df, cols)]
    got = df.agg(F.count("*"), *[F.avg(x) for x in d], *[F.covar_samp(d[i], d[j]) for i, j in pairs]).first()
    matrix = np.zeros((len(cols), len(cols)))
    for (i, j), v in zip(pairs, got[1 + len(cols) :]):
        matrix[i, j] = matrix[j, i] = v
    return np.array(got[1 : 1 + len(cols)], float), matrix, got[0]


def fit_mahalanobis(df: DataFrame, cols: list[str], alpha: float = 0.05) -> MahalanobisModel:
    mean, matrix, _ = covariance(df, cols)
    return MahalanobisModel(cols, mean.tolist(), np.linalg.inv(matrix).tolist(), math.sqrt(chi2_isf(alpha, len(cols))))


#: Distances between two arrays of doubles.
def distance(x: Column, y: Column, metric: str = "euclidean") -> Column:
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda u, v: u + v)
    gaps = F.zip_with(x, y, lambda a, b: F.abs(a - b))
    if metric == "euclidean":
        return F.sqrt(total(F.transform(gaps, lambda d: d * d)))
    if metric == "manhattan":
        return total(gaps)
    if metric == "gap_ratio":  # the sum of gaps over the product of the sums
        return total(gaps) / F.nullif(total(x) * total(y), F.lit(0.0))
    if metric == "cosine":
        return 1 - total(F.zip_with(x, y, lambda a, b: a * b)) / F.sqrt(total(F.transform(x, lambda a: a * a)) * total(F.transform(y, lambda b: b * b)))
    raise ValueError(f"unknown metric {metric!r}")


def neighbours(df: DataFrame, key: str, cols: list[str], k: int, metric: str = "euclidean") -> DataFrame:
    """(a, b, d, r): the ``k`` nearest other rows of each row, by distance, then key.

    Metrics that a grid can serve go to :func:`granary.operators.nearby.nearest`; ``gap_ratio`` and ``cosine`` compare all pairs.
    """
    if metric in GRID_METRICS:
        return nearest(df, key, cols, k, metric)
    v = F.array(*[F.col(c).cast("double") for c in numeric(df, cols)])
    one, two = df.select(F.col(key).alias("a"), v.alias("x")), df.select(F.col(key).alias("b"), v.alias("y"))
    pairs = one.join(two, F.col("a") != F.col("b")).select("a", "b", distance(F.col("x"), F.col("y"), metric).alias("d"))
    return pairs.withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy("d", "b"))).filter(F.col("r") <= k)


def local_outlier_factor(df: DataFrame, key: str, cols: list[str], k: int = 20, metric: str = "euclidean", reach: bool = False) -> DataFrame:
    """(key, lrd, lof): density k / sum of neighbour distances, and the neighbours' mean density over the row's own.

    ``reach`` takes the textbook's reachability distances instead. On metrics that a grid can serve, equal rows are one
    point with one density and one factor, so no list is made for each row: the lists' least keys stand for all.
    """
    if metric in GRID_METRICS:
        return _factor_of_points(df, key, cols, k, metric, reach)
    near = materialize(neighbours(df, key, cols, k, metric), "neighbours")
    if reach:
        far = near.groupBy(F.col("a").alias("b")).agg(F.max("d").alias("kd"))
        near = near.join(far, "b").withColumn("d", F.greatest("d", "kd"))
    lrd = near.groupBy("a").agg((F.lit(k) / F.nullif(F.sum("d"), F.lit(0.0))).alias("lrd"))
    of = near.join(lrd.select(F.col("a").alias("b"), F.col("lrd").alias("other")), "b").groupBy("a").agg(F.sum("other").alias("s"))
    return of.join(lrd, "a").select(F.col("a").alias(key), "lrd", (F.col("s") / (F.lit(k) * F.col("lrd"))).alias("lof"))


def _factor_of_points(df: DataFrame, key: str, cols: list[str], k: int, metric: str, reach: bool) -> DataFrame:
    rows, points, lists = near_lists(df, key, cols, k, metric)
    if lists is None:
        return rows.select(F.col("a").alias(key), F.lit(0.0).alias("lrd"), F.lit(0.0).alias("lof")).filter(F.lit(False))
    others = F.slice(F.filter("near", lambda o: o["b"] != F.col("p")), 1, k)
    near = materialize(lists.select("p", others.alias("near")), "near-lists")
    members = points.select("p", F.explode("keys").alias("b"))
    pairs = near.select("p", F.explode("near").alias("o")).select("p", "o.*")
    total = F.aggregate("near", F.lit(0.0), lambda u, o: u + o["d"])
    if reach:
        far = near.select("p", F.get("near.d", F.size("near") - 1).alias("kd"))
        near = pairs.join(far.join(members, "p").drop("p"), "b").groupBy("p").agg(F.sum(F.greatest("d", "kd")).alias("total"))
        total = F.col("total")
    density = materialize(near.select("p", (F.lit(k) / F.nullif(total, F.lit(0.0))).alias("lrd")), "densities")
    of = pairs.join(density.join(members, "p").drop("p"), "b").groupBy("p").agg(F.sum("lrd").alias("s"))
    scored = of.join(density, "p").join(points, "p").select("c", "x", "lrd", (F.col("s") / (F.lit(k) * F.col("lrd"))).alias("lof"))
    return rows.join(scored, ["c", "x"]).select(F.col("a").alias(key), "lrd", "lof")


def above_quantile(scores: DataFrame, column: str, q: float = 0.95) -> DataFrame:
    cut = exact_quantiles(scores, [column], [q])[column][0]
    return scores.filter(F.col(column) > F.lit(cut))


def path_constant(n: float) -> float:
    """Mean path length of an unsuccessful search among ``n`` rows."""
    return 0.0 if n <= 1 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


@dataclass
class IsolationForestModel:
    cols: list[str]
    trees: list[list[tuple]]  # per tree: (feature, cut, left, right, rows), children as places in the list
    n_train: int
    threshold: float

    def score_samples(self, df: DataFrame, name: str = "anomaly_score") -> DataFrame:
        """2 ** (-mean path length / path_constant(n)); the trees, of bounded size, travel with the task."""
        from pyspark.sql.functions import pandas_udf

        packed = []
        for tree in self.trees:
            f, c, l, r, n = (np.array(x) for x in zip(*tree))
            packed.append((f.astype(int), c.astype(float), l.astype(int), r.astype(int), np.array([path_constant(x) for x in n])))
        unit = path_constant(self.n_train) or 1.0

        @pandas_udf("double")
        def score(rows: pd.DataFrame) -> pd.Series:
            x = rows.to_numpy(float)
            total = np.zeros(len(x))
            for f, cut, left, right, rest in packed:
                at, depth, live = np.zeros(len(x), int), np.zeros(len(x)), np.arange(len(x))
                while len(live):
                    node = at[live]
                    inner = f[node] >= 0
                    live, node = live[inner], node[inner]
                    at[live] = np.where(x[live, f[node]] < cut[node], left[node], right[node])
                    depth[live] += 1
                total += depth + rest[at]
            return pd.Series(2.0 ** (-total / len(packed) / unit))

        return df.withColumn(name, score(F.struct(*[F.col(c).cast("double") for c in self.cols])))

    def predict(self, df: DataFrame) -> DataFrame:
        """``is_outlier`` is 1 where the score reaches the threshold."""
        return self.score_samples(df).withColumn("is_outlier", (F.col("anomaly_score") >= self.threshold).cast("int"))


def fit_isolation_forest(df: DataFrame, cols: list[str], threshold: float = 0.5, n_estimators: int = 100, max_samples: int = 256, max_features: int | str | None = None, bootstrap: bool = True, seed: int = 17, key: list[str] | None = None) -> IsolationForestModel:
    """Trees on samples of ``max_samples`` rows; of ten random cuts per feature, the most unbalanced is taken.

    The driver gets at most n_estimators * max_samples sampled rows, a bound that does not grow with the data. They are the
    first by a hash of the columns ``key``, which tell rows apart, or without them by a seeded random number per row, so
    that repeated values enter in proportion; only with ``key`` is the sample the same however the table is partitioned.
    """
    n = df.count()
    m = {None: len(cols), "sqrt": max(1, int(math.sqrt(len(cols)))), "log2": max(1, int(math.log2(len(cols))))}.get(max_features, max_features)
    rng = random.Random(seed)
    want = min(n, n_estimators * max_samples)
    place = F.xxhash64(F.lit(seed), *key) if key else F.rand(seed)
    wide = df.select(*[F.col(c).cast("double") for c in numeric(df, cols)], place.alias("__h"))
    pool = np.array([r[:-1] for r in wide.orderBy("__h", *cols).limit(want).collect()], float).reshape(-1, len(cols))

    def grow(x: np.ndarray, depth: int, nodes: list) -> int:
        place = len(nodes)
        nodes.append(None)
        best = None
        if depth < math.ceil(math.log2(max(max_samples, 2))) and len(np.unique(x, axis=0)) > 1:
            for f in rng.sample(range(len(cols)), m):
                lo, hi = x[:, f].min(), x[:, f].max()
                for _ in range(10 if hi > lo else 0):
                    cut = rng.uniform(lo, hi)
                    left = int((x[:, f] < cut).sum())
                    if 0 < left < len(x) and (best is None or abs(2 * left - len(x)) > best[0]):
                        best = (abs(2 * left - len(x)), f, cut)
        if best is None:
            nodes[place] = (-1, 0.0, -1, -1, len(x))
        else:
            side = x[:, best[1]] < best[2]
            nodes[place] = (best[1], best[2], grow(x[side], depth + 1, nodes), grow(x[~side], depth + 1, nodes), len(x))
        return place

    trees = []
    for _ in range(n_estimators if len(pool) else 0):
        size = min(max_samples, len(pool))
        take = [rng.randrange(len(pool)) for _ in range(size)] if bootstrap else rng.sample(range(len(pool)), size)
        nodes: list = []
        grow(pool[take], 0, nodes)
        trees.append(nodes)
    return IsolationForestModel(list(cols), trees, n, threshold)
