"""Scores of predictions, confusion counts, and the numbers behind charts."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.columns import numeric
from granary.functions.order import group_quantiles, with_rank


def regression_metrics(df: DataFrame, y: str, p: str) -> DataFrame:
    """One row: mse, rmse, mae, mape, medae, msle."""
    a, b = F.col(y).cast("double"), F.col(p).cast("double")
    gap = a - b
    log = F.ln(F.abs(1 + a)) - F.ln(F.abs(1 + b))
    sums = df.agg(
        F.avg(gap * gap).alias("mse"), F.sqrt(F.avg(gap * gap)).alias("rmse"), F.avg(F.abs(gap)).alias("mae"),
        F.avg(F.abs(gap / F.nullif(a, F.lit(0.0)))).alias("mape"), F.avg(log * log).alias("msle"),
    )
    middle = group_quantiles(df.select(F.abs(gap).alias("gap")), "gap", [0.5]).select(F.col("q0").alias("medae"))
    return sums.join(F.broadcast(middle), F.lit(True), "left").select("mse", "rmse", "mae", "mape", "medae", "msle")


def accuracy(df: DataFrame, y: str, p: str) -> DataFrame:
    return df.agg(F.avg((F.col(y) == F.col(p)).cast("double")).alias("accuracy"))


def roc_auc(df: DataFrame, y: str, score: str) -> DataFrame:
    """Area under the curve of a binary ``y`` by average ranks of the score."""
    rows = with_rank(df.filter(F.col(y).isNotNull() & F.col(score).isNotNull()), score, "__rank")
    sums = rows.agg(F.sum(F.when(F.col(y) == 1, F.col("__rank"))).alias("s"), F.count(F.when(F.col(y) == 1, 1)).alias("p"), F.count(F.when(F.col(y) == 0, 1)).alias("q"))
    return sums.select(((F.col("s") - F.col("p") * (F.col("p") + 1) / 2) / F.nullif(F.col("p") * F.col("q"), F.lit(0))).alias("roc_auc"))


def confusion_matrix(df: DataFrame, y: str, p: str) -> DataFrame:
    """(actual, predicted, n, share): counts, and their share of the actual class."""
    counts = df.groupBy(F.col(y).alias("actual"), F.col(p).alias("predicted")).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("actual")))


def multilabel_confusion(df: DataFrame, y: str, p: str) -> DataFrame:
    """(label, tp, fp, fn, tn) of each class against the rest."""
    cells = confusion_matrix(df, y, p).select("actual", "predicted", "n")
    sides = cells.select(F.explode(F.array_distinct(F.array("actual", "predicted"))).alias("label"), "actual", "predicted", "n")
    a, b = F.col("actual") == F.col("label"), F.col("predicted") == F.col("label")
    one = sides.groupBy("label").agg(F.sum(F.when(a & b, F.col("n")).otherwise(0)).alias("tp"), F.sum(F.when(~a & b, F.col("n")).otherwise(0)).alias("fp"), F.sum(F.when(a & ~b, F.col("n")).otherwise(0)).alias("fn"))
    total = cells.agg(F.sum("n").alias("t"))
    return one.crossJoin(F.broadcast(total)).select("label", "tp", "fp", "fn", (F.col("t") - F.col("tp") - F.col("fp") - F.col("fn")).alias("tn"))


def histogram(df: DataFrame, c: str, n: int = 20) -> DataFrame:
    """(bin, low, high, n): equal-width bins between the extremes, empty ones included."""
    from granary.operators.information import bins

    lo, hi = df.agg(F.min(numeric(df, [c])[0]), F.max(c)).first()
    counts = bins(df.filter(F.col(c).isNotNull()), [c], n).groupBy(F.col(f"{c}_bin").alias("bin")).agg(F.count("*").alias("n"))
    width = (float(hi) - float(lo)) / n
    every = df.sparkSession.range(n).select(F.col("id").cast("int").alias("bin"))
    return every.join(F.broadcast(counts), "bin", "left").select("bin", (F.col("bin") * width + float(lo)).alias("low"), ((F.col("bin") + 1) * width + float(lo)).alias("high"), F.coalesce("n", F.lit(0)).alias("n"))


def kde(df: DataFrame, c: str, points: list[float], bandwidth: float | None = None) -> DataFrame:
    """(at, density): a Gaussian kernel estimate at given points, one aggregate each; Scott's bandwidth if none is given."""
    x = F.col(numeric(df, [c])[0]).cast("double")
    if bandwidth is None:
        n, sd = df.agg(F.count(x), F.stddev_samp(x)).first()
        bandwidth = sd * n ** (-1 / 5)
    scale = bandwidth * math.sqrt(2 * math.pi)
    sums = df.agg(*[(F.avg(F.exp(F.pow((x - F.lit(float(p))) / F.lit(float(bandwidth)), 2) * -0.5)) / scale).alias(f"d{i}") for i, p in enumerate(points)])
    rows = F.array(*[F.struct(F.lit(float(p)).alias("at"), F.col(f"d{i}").alias("density")) for i, p in enumerate(points)])
    return sums.select(F.explode(rows).alias("r")).select("r.*")


def five_numbers(df: DataFrame, c: str, by: str | None = None) -> DataFrame:
    """Minimum, quartiles and maximum, in groups of ``by`` if given."""
    ends = df.groupBy((F.lit(0) if by is None else F.col(by)).alias("group")).agg(F.min(c).alias("low"), F.max(c).alias("high"))
    ends = ends if by is not None else df.agg(F.lit(0).alias("group"), F.min(c).alias("low"), F.max(c).alias("high"))
    inner = group_quantiles(df, c, [0.25, 0.5, 0.75], by).toDF("g", "q1", "median", "q3")
    both = ends.join(inner, F.col("group").eqNullSafe(F.col("g")), "left")
    return both.select(*([F.col("group").alias(by)] if by else []), "low", "q1", "median", "q3", "high")


def frequencies(df: DataFrame, c: str) -> DataFrame:
    """(value, n, share) of each value."""
    counts = df.groupBy(F.col(c).alias("value")).agg(F.count("*").alias("n"))
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("t")))).select("value", "n", (F.col("n") / F.col("t")).alias("share"))


def correlation_pairs(df: DataFrame, cols: list[str], digits: int = 3) -> DataFrame:
    """(a, b, r) below the diagonal."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[:i]]
    got = df.agg(*[F.round(F.corr(a, b), digits).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    return got.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{i}").alias("r")) for i, (a, b) in enumerate(pairs)])).alias("p")).select("p.*")


def dense_rank_features(scores: DataFrame, feature: str, importance: str) -> DataFrame:
    """(feature, importance, scaled, rank): min-max scaled, 1 for the most important. A row per feature."""
    one = Window.partitionBy(F.lit(0))
    lo, hi = F.min(importance).over(one), F.max(importance).over(one)
    scaled = scores.withColumn("scaled", (F.col(importance) - lo) / F.nullif(hi - lo, F.lit(0.0)))
    return scaled.select(feature, importance, "scaled", F.dense_rank().over(one.orderBy(F.desc("scaled"))).alias("rank"))


def cumulative_share(values: DataFrame, order: str, value: str) -> DataFrame:
    """(order, value, share): running share of the total, for a row per component."""
    one = Window.partitionBy(F.lit(0))
    run = F.sum(value).over(one.orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return values.select(order, value, (run / F.sum(value).over(one)).alias("share"))


def knee(values: DataFrame, x: str, y: str) -> DataFrame:
    """One row: the x that maximises (1 - x) - y on min-max scaled axes, for a falling curve of few points."""
    one = Window.partitionBy(F.lit(0))
    scaled = lambda c: (F.col(c) - F.min(c).over(one)) / F.nullif((F.max(c).over(one) - F.min(c).over(one)).cast("double"), F.lit(0.0))
    gaps = values.select(x, (1 - scaled(x) - scaled(y)).alias("gap"))
    return gaps.agg(F.max_by(x, F.struct("gap", F.negate(x))).alias(x), F.max("gap").alias("gap"))


def normalized_curve(values: DataFrame, x: str, y: str) -> DataFrame:
    """The curve with both axes scaled to 0 to 1 (x, y), beside the falling diagonal.

    ``foot_x`` and ``foot_y`` are the foot of the perpendicular on the diagonal, ``distance`` its length, ``diagonal`` the
    diagonal's height at x (the perpendicular turned by 45 degrees ends there), ``difference`` what the curve lies below it.
    """
    ends = values.agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"))
    a = (F.col(x) - F.col("x0")) / F.nullif((F.col("x1") - F.col("x0")).cast("double"), F.lit(0.0))
    b = (F.col(y) - F.col("y0")) / F.nullif((F.col("y1") - F.col("y0")).cast("double"), F.lit(0.0))
    names = [F.col(c) for c in (x, y) if c not in ("x", "y")]
    rows = values.crossJoin(F.broadcast(ends)).select(*names, a.alias("x"), b.alias("y"))  # beside one row
    x, y = F.col("x"), F.col("y")
    return rows.withColumns({
        "foot_x": (x - y + 1) / 2, "foot_y": (y - x + 1) / 2, "distance": F.abs(x + y - 1) / math.sqrt(2), "diagonal": 1 - x, "difference": 1 - x - y,
    })


def elbow(values: DataFrame, k: str, sse: str, share: float = 0.05) -> DataFrame:
    """One row: the first inner k whose neighbours' errors differ by less than ``share`` of the total error."""
    at = Window.partitionBy(F.lit(0)).orderBy(k)
    rows = values.select(k, (F.lag(sse).over(at) - F.lead(sse).over(at)).alias("fall"), F.sum(sse).over(Window.partitionBy(F.lit(0))).alias("total"))
    return rows.filter(F.col("fall") < F.col("total") * share).agg(F.min(k).alias(k))
