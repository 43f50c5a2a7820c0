"""Statistical tests. Each reduces the data by aggregates and returns a frame of one row."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.functions import distributions as dist
from granary.functions.columns import numeric, one_row, row
from granary.functions.order import bounds_of, group_quantiles, range_of, value_ranks, with_rank
from granary.functions.storage import materialize


#: Up to so many narrow rows a counted side of a join is broadcast.
MOST_BROADCAST = 400_000


def _verdict(statistic: float, p: float, critical: float, alpha: float) -> dict:
    return {"test_statistic": statistic, "p_value": p, "critical_value": critical, "keep_h0": bool(p >= alpha)}


def crosstab(df: DataFrame, x: str, y: str) -> DataFrame:
    """(x, y, n, margin): cell counts with margins; ``margin`` is 0 for a cell, 1 and 2 for row and column sums, 3 for all."""
    return df.cube(x, y).agg(F.count("*").alias("n"), F.grouping_id().cast("int").alias("margin"))


def chi_square_parts(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: chi2, n, rows, cols, share_expected_above_5, min_expected; null categories are left out."""
    cells = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(x).alias("x"), F.col(y).alias("y")).agg(F.count("*").alias("o"))
    rows = cells.groupBy("x").agg(F.sum("o").alias("rx"))
    cols = cells.groupBy("y").agg(F.sum("o").alias("cy"))
    e = F.col("rx") * F.col("cy") / F.col("n")
    total = cells.agg(F.sum("o").alias("n"))
    # A cell without rows adds what is expected there; together that is what the other cells leave of n.
    filled = cells.join(rows, "x").join(cols, "y").crossJoin(F.broadcast(total))
    seen = filled.agg(F.sum((F.col("o") - e) * (F.col("o") - e) / e).alias("gap"), F.sum(e).alias("expected"), F.max("n").alias("n"))
    # Shares of cells need only the different sums of rows and columns: at most the root of 2 n of each.
    sums = rows.groupBy("rx").agg(F.count("*").alias("a")).crossJoin(cols.groupBy("cy").agg(F.count("*").alias("b"))).crossJoin(F.broadcast(total))
    many = F.col("a") * F.col("b")
    grid = sums.agg((F.sum(F.when(e > 5, many).otherwise(0)) / F.sum(many)).alias("share_expected_above_5"), F.min(e).alias("min_expected"))
    sizes = rows.agg(F.count("*").alias("rows")).crossJoin(cols.agg(F.count("*").alias("cols")))
    chi2 = F.col("gap") + F.greatest(F.col("n") - F.col("expected"), F.lit(0.0))
    return seen.crossJoin(sizes).crossJoin(grid).select(chi2.alias("chi2"), "n", "rows", "cols", "share_expected_above_5", "min_expected")


def chi_square(df: DataFrame, x: str, y: str, alpha: float = 0.05) -> DataFrame:
    """Test of independence with Cramer's V; the assumption holds if 80 % of the expected counts are above 5."""
    p = row(chi_square_parts(df, x, y))
    dof = (p["rows"] - 1) * (p["cols"] - 1)
    value = dist.chi2_sf(p["chi2"], dof)
    v = math.sqrt(p["chi2"] / (p["n"] * min(p["rows"] - 1, p["cols"] - 1)))
    return one_row(df, {**_verdict(p["chi2"], value, dist.chi2_isf(alpha, dof), alpha), "df": dof, "cramers_v": v, "assumption": p["share_expected_above_5"] >= 0.8})


def group_summary(df: DataFrame, x: str, y: str) -> DataFrame:
    """(group, n, mean, ss): count, mean and squared deviations of y in each group."""
    value = F.col(numeric(df, [y])[0]).cast("double")
    rows = df.filter(F.col(x).isNotNull() & value.isNotNull())
    return rows.groupBy(F.col(x).alias("group")).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), (F.var_pop(value) * F.count("*")).alias("ss"))


def f_parts(groups: DataFrame) -> DataFrame:
    """One row: f, df1, df2 and the two sums of squares, from (group, n, mean, ss)."""
    total = groups.agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("m"), F.count("*").alias("c"))
    joined = groups.withColumnRenamed("n", "k").crossJoin(F.broadcast(total))
    parts = joined.agg(F.sum(F.col("k") * F.pow(F.col("mean") - F.col("m"), 2)).alias("ssb"), F.sum("ss").alias("sse"), F.max("n").alias("n"), F.max("c").alias("c"))
    f = (F.col("ssb") / (F.col("c") - 1)) / F.nullif(F.col("sse") / (F.col("n") - F.col("c")), F.lit(0.0))
    return parts.select(f.alias("f"), (F.col("c") - 1).alias("df1"), (F.col("n") - F.col("c")).alias("df2"), "ssb", "sse")


def _f_test(df: DataFrame, parts: dict, alpha: float, extra: dict | None = None) -> DataFrame:
    p = dist.f_sf(parts["f"], parts["df1"], parts["df2"])
    return one_row(df, {**_verdict(parts["f"], p, dist.f_isf(alpha, parts["df1"], parts["df2"]), alpha), "df1": parts["df1"], "df2": parts["df2"], **(extra or {})})


def anova(df: DataFrame, x: str, y: str, alpha: float = 0.05) -> DataFrame:
    return _f_test(df, row(f_parts(group_summary(df, x, y))), alpha)


def levene_groups(df: DataFrame, x: str, y: str, center: str = "median") -> DataFrame:
    """Group summary of the absolute deviations from each group's mean or median."""
    if center not in ("mean", "median"):
        raise ValueError(f"unknown center {center!r}")
    value = F.col(numeric(df, [y])[0]).cast("double")
    rows = df.filter(F.col(x).isNotNull() & value.isNotNull()).select(F.col(x).alias("x"), value.alias("y"))
    centers = rows.groupBy("x").agg(F.avg("y").alias("c")) if center == "mean" else group_quantiles(rows, "y", [0.5], "x").toDF("x", "c")
    centers = materialize(centers, "centers")
    # a few groups are broadcast, so that no task gets all rows of one
    known = F.broadcast(centers) if centers.count() <= MOST_BROADCAST else centers
    return group_summary(rows.join(known, "x").withColumn("z", F.abs(F.col("y") - F.col("c"))), "x", "z")


def levene(df: DataFrame, x: str, y: str, alpha: float = 0.05, center: str = "median") -> DataFrame:
    return _f_test(df, row(f_parts(levene_groups(df, x, y, center))), alpha)


def kruskal_parts(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: h, c, n, by average ranks."""
    rows = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(x, y)
    parts = f_parts(group_summary(with_rank(rows, y, "__rank"), x, "__rank"))
    n = F.col("df1") + F.col("df2") + 1
    return parts.select(((n - 1) * F.col("ssb") / (F.col("ssb") + F.col("sse"))).alias("h"), (F.col("df1") + 1).alias("c"), n.alias("n"))


def kruskal_wallis(df: DataFrame, x: str, y: str, alpha: float = 0.05) -> DataFrame:
    """H on average ranks; ``p_value`` from F(C-1, N-C), ``p_value_chi2`` from chi-square with C-1 degrees."""
    p = row(kruskal_parts(df, x, y))
    d1, d2 = p["c"] - 1, p["n"] - p["c"]
    return one_row(df, {**_verdict(p["h"], dist.f_sf(p["h"], d1, d2), dist.f_isf(alpha, d1, d2), alpha), "p_value_chi2": dist.chi2_sf(p["h"], d1)})


def jarque_bera(df: DataFrame, c: str, alpha: float = 0.05) -> DataFrame:
    """n/6 (S^2 + (K-3)^2 / 4) with moments of divisor n - 1; p is exp(-JB/2). One aggregate, no second job."""
    from granary.operators.impute import kurtosis, skewness

    parts = df.agg(F.count(c).alias("n"), skewness(numeric(df, [c])[0]).alias("s"), kurtosis(c).alias("k"))
    jb = F.col("n") / 6 * (F.col("s") * F.col("s") + (F.col("k") - 3) * (F.col("k") - 3) / 4)
    p = F.exp(-jb / 2)
    return parts.select(jb.alias("test_statistic"), p.alias("p_value"), F.lit(-2 * math.log(alpha)).alias("critical_value"), (p >= alpha).alias("keep_h0"))


def _correlation(df: DataFrame, r: float, n: int, alpha: float) -> DataFrame:
    ref = r * n / (n - 1)
    inside = 1 - ref * ref
    t = ref * math.sqrt(n - 2) / math.sqrt(inside) if inside > 0 else math.inf * (1 if ref > 0 else -1)
    p = 0.0 if math.isinf(t) else 2 * dist.t_sf(abs(t), n - 2)
    return one_row(df, {"correlation": r, "correlation_ref": ref, **_verdict(t, p, dist.t_isf(alpha / 2, n - 2), alpha)})


def pearson(df: DataFrame, x: str, y: str, alpha: float = 0.05) -> DataFrame:
    """``correlation`` and ``correlation_ref`` = correlation * n / (n - 1), on which t and p are based."""
    numeric(df, [x, y])
    got = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).agg(F.corr(x, y), F.count("*")).first()
    return _correlation(df, got[0], got[1], alpha)


def spearman(df: DataFrame, x: str, y: str, alpha: float = 0.05) -> DataFrame:
    """The same on average ranks."""
    rows = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(x, y)
    return pearson(with_rank(with_rank(rows, x, "__rx"), y, "__ry"), "__rx", "__ry", alpha)


#: Rows of a stretch of an order that one task counts, and the most stretches: the table of counts between them has their square.
STRETCH, MOST_STRETCHES = 200_000, 512


def _ordered(cells: DataFrame, first: str, second: str, name: str) -> DataFrame:
    """``cells`` (x, y, w) with the place in the order of two columns, the weight before it, and the weight before and at its ``first``."""
    rows = cells.withColumn("part", range_of(F.col(first).cast("double"), bounds_of(cells, F.col(first))))
    upto = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    parts = rows.groupBy("part").agg(F.count("*").alias("m"), F.sum("w").alias("v"))
    parts = parts.select("part", F.coalesce(F.sum("m").over(upto), F.lit(0)).alias("rows"), F.coalesce(F.sum("v").over(upto), F.lit(0)).alias("weight"))
    order = Window.partitionBy("part").orderBy(first, second)
    run = F.coalesce(F.sum("w").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = rows.withColumns({"nth": F.row_number().over(order) - 1, "run": run})
    tied = Window.partitionBy("part", first)
    placed = placed.withColumns({"least": F.min("run").over(tied), f"n{name}": F.sum("w").over(tied)}).join(F.broadcast(parts), "part")
    found = {f"p{name}": F.col("rows") + F.col("nth"), f"w{name}": F.col("weight") + F.col("run"), f"b{name}": F.col("weight") + F.col("least")}
    return placed.withColumns({c: v.cast("long") for c, v in found.items()}).drop("part", "nth", "run", "least", "rows", "weight")


def weight_before(keys: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """For each element of a sequence the weight of the earlier ones with a lesser whole-number key.

    An earlier element has a lesser key if it has the 0 in the highest binary digit in which the keys differ, so each digit
    adds, to elements with the 1, a running sum over those that share the digits above.
    """
    out = np.zeros(len(keys), np.int64)
    if not len(keys):
        return out
    keys = np.unique(keys, return_inverse=True)[1]
    for bit in range(int(keys.max()).bit_length()):
        order = np.argsort(keys >> (bit + 1), kind="stable")
        group, one = keys[order] >> (bit + 1), (keys[order] >> bit) & 1
        zeros = np.where(one == 0, weights[order], 0)
        before = np.cumsum(zeros) - zeros
        starts = np.maximum.accumulate(np.where(np.r_[True, group[1:] != group[:-1]], np.arange(len(keys)), 0))
        out[order] += np.where(one == 1, before - before[starts], 0)
    return out


def quadrants(df: DataFrame, x: str, y: str) -> DataFrame:
    """(w, r, s, q) of each distinct (x, y): its rows, the rows below it by x, by y, and by both; ties count a half each.

    Points have a place by (x, y) and one by (y, x), in stretches of ``STRETCH`` places. Those below by both places lie in a
    lower stretch by each (a table of sums per pair of stretches), in the same stretch by x, or in the same by y and a lower
    one by x: one task counts a stretch, whatever the ties. Each point is shuffled twice for it, and no pairs are made.
    Below by both places are also the ties by one column, which then count a half. The row itself counts as a tie; nulls
    are left out.
    """
    points = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).alias("x"), F.col(y).alias("y"))
    cells = materialize(points.groupBy("x", "y").agg(F.count("*").alias("w")), "quadrants")
    cells = materialize(_ordered(materialize(_ordered(cells, "x", "y", "x"), "quadrants"), "y", "x", "y"), "quadrants")
    size = max(STRETCH, -(-cells.count() // MOST_STRETCHES))
    placed = cells.withColumns({f"g{c}": F.floor(F.col(f"p{c}") / size).cast("int") for c in "xy"})
    sums = placed.groupBy("gx", "gy").agg(F.sum("w")).collect()
    grid = np.zeros((max([r[0] for r in sums], default=0) + 2, max([r[1] for r in sums], default=0) + 2), np.int64)
    for i, j, w in sums:
        grid[i + 1, j + 1] = w
    grid = grid.cumsum(0).cumsum(1)  # at (i, j): the weight in stretches below i by x and below j by y

    def by_x(pdf):
        pdf = pdf.sort_values("px")
        return pdf.assign(q=grid[pdf["gx"], pdf["gy"]] + weight_before(pdf["py"].to_numpy(), pdf["w"].to_numpy()))

    def by_y(pdf):
        pdf = pdf.sort_values("py")
        return pdf.assign(q=pdf["q"] + weight_before(pdf["gx"].to_numpy(), pdf["w"].to_numpy()))

    kinds = "gx int, gy int, px long, py long, w long, wx long, wy long, bx long, by long, nx long, ny long"
    narrow = placed.select(*[k.split()[0] for k in kinds.split(", ")])
    counted = narrow.groupBy("gx").applyInPandas(by_x, kinds + ", q long").groupBy("gy").applyInPandas(by_y, kinds + ", q long")
    ties = (F.col("wx") - F.col("bx") + F.col("wy") - F.col("by")) / 2
    half = lambda c: F.col(f"b{c}") + F.col(f"n{c}") / 2
    return counted.select("w", half("x").alias("r"), half("y").alias("s"), (F.col("q") - ties + F.col("w") / 4).alias("q"))


def hoeffding(df: DataFrame, key: str, x: str, y: str, alpha: float = 0.05) -> DataFrame:
    """Hoeffding's D from ranks (:func:`quadrants`); ``bound``, meant for ten rows at most, depends on n and alpha only.

    ``key`` tells rows apart for the caller and is not needed here; rows with a null in x or y are left out.
    """
    counts = quadrants(df, x, y).select("w", (F.col("q") + 0.75).alias("q"), (F.col("r") + 0.5).alias("r"), (F.col("s") + 0.5).alias("s"))
    c = F.col
    sums = counts.agg(
        F.coalesce(F.sum("w"), F.lit(0)).cast("double").alias("n"), F.sum(c("w") * (c("q") - 1) * (c("q") - 2)).alias("d1"),
        F.sum(c("w") * (c("r") - 1) * (c("r") - 2) * (c("s") - 1) * (c("s") - 2)).alias("d2"), F.sum(c("w") * (c("r") - 2) * (c("s") - 2) * (c("q") - 1)).alias("d3"),
    )
    n = c("n")
    d = 30 * ((n - 2) * (n - 3) * c("d1") + c("d2") - 2 * (n - 2) * c("d3")) / F.nullif(n * (n - 1) * (n - 2) * (n - 3) * (n - 4), F.lit(0.0))
    out = sums.select(n, d.alias("hoeffding_d"))
    bound = F.sqrt(2 * (n * n + 5 * n - 32) / F.nullif(9 * n * (n - 1) * (n - 3) * (n - 4) * alpha, F.lit(0.0)))
    return out.select("hoeffding_d", ((n - 1) * math.pi**4 * c("hoeffding_d") / 60 + math.pi**4 / 72).alias("test_statistic"), bound.alias("bound"))


def correlation_matrix(df: DataFrame, cols: list[str], method: str = "pearson") -> np.ndarray:
    """Correlations of columns in one aggregate job (after ranking, for ``spearman``)."""
    from granary.operators.outliers import covariance

    names = numeric(df, list(cols))
    if method == "spearman":
        names = [f"__r{i}" for i in range(len(cols))]
        for c, r in zip(cols, names):
            df = with_rank(df, c, r)
    _, s, _ = covariance(df, names)
    d = np.sqrt(np.diag(s))
    return s / np.outer(d, d)


def vif(df: DataFrame, cols: list[str]) -> DataFrame:
    """(feature, vif): the diagonal of the inverse correlation matrix."""
    inverse = np.linalg.inv(correlation_matrix(df, cols))
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.lit(float(inverse[i, i])).alias("vif")) for i, c in enumerate(cols)])
    return df.sparkSession.range(1).select(F.explode(rows).alias("r")).select("r.*")


def bartlett_sphericity(df: DataFrame, cols: list[str], textbook: bool = False) -> DataFrame:
    """-(n - 1 - (2m - 5)/6) ln det(R + 1e-8 I); ``textbook`` takes 2m + 5."""
    m, n = len(cols), df.count()
    r = correlation_matrix(df, cols) + 1e-8 * np.eye(m)
    statistic = -(n - 1 - (2 * m + (5 if textbook else -5)) / 6) * math.log(np.linalg.det(r))
    dof = (m * m - m) // 2
    return one_row(df, {"test_statistic": float(statistic), "df": dof, "p_value": dist.chi2_sf(float(statistic), dof)})


def kaiser_meyer_olkin(df: DataFrame, cols: list[str]) -> DataFrame:
    """Squared rank correlations over themselves plus squared partial ones, off the diagonal."""
    r = correlation_matrix(df, cols, "spearman")
    v = np.linalg.inv(r)
    p = -v / np.sqrt(np.outer(np.diag(v), np.diag(v)))
    off = ~np.eye(len(cols), dtype=bool)
    return one_row(df, {"kmo": float((r[off] ** 2).sum() / ((r[off] ** 2).sum() + (p[off] ** 2).sum()))})


def correlation_selection(df: DataFrame, cols: list[str], y: str, threshold: float) -> DataFrame:
    """(feature, kept): of each pair with |r| above the threshold, the one less correlated with y goes."""
    r = correlation_matrix(df, [*cols, y])
    gone: set[int] = set()
    for i in range(len(cols)):
        for j in range(i):
            if abs(r[i, j]) > threshold and i not in gone and j not in gone:
                gone.add(j if abs(r[j, -1]) < abs(r[i, -1]) else i)
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.lit(i not in gone).alias("kept")) for i, c in enumerate(cols)])
    return df.sparkSession.range(1).select(F.explode(rows).alias("r")).select("r.*")


def variance_threshold(df: DataFrame, cols: list[str], threshold: float = 0.0) -> list[str]:
    """Columns whose population variance is above the threshold."""
    got = df.agg(*[F.var_pop(c).alias(f"v{i}") for i, c in enumerate(numeric(df, cols))]).first()
    return [c for i, c in enumerate(cols) if got[f"v{i}"] is not None and got[f"v{i}"] > threshold]


def adf_p_value(t: float) -> float:
    """MacKinnon's approximate p value of a Dickey-Fuller t statistic with a constant."""
    if t > 2.74 or t < -18.83:
        return float(t > 0)
    # fixed values: the published polynomials below and above -1.61
    terms = (2.1659, 1.4412, 0.038269) if t <= -1.61 else (1.7339, 0.93202, -0.12745, -0.010368)
    return NormalDist().cdf(sum(c * t**i for i, c in enumerate(terms)))


def adf(df: DataFrame, order: str, c: str, lags: int = 1) -> DataFrame:
    """Augmented Dickey-Fuller t statistic with a constant; the normal equations are summed in Spark.

    ``stationary`` compares it with -2.86, the 5 % point for long series; ``p_value`` is MacKinnon's approximation.
    """
    from granary.functions.order import with_row_id

    rows = with_row_id(df.select(F.col(order).cast("double").alias("o"), F.col(c).cast("double").alias("x")), "o", "x")
    need = rows.select(F.explode(F.sequence(F.col("row_id"), F.col("row_id") + lags + 1)).alias("t"), "row_id", "x")
    wide = need.groupBy("t").agg(F.array_sort(F.collect_list(F.struct((-F.col("row_id")).alias("o"), "x"))).alias("s")).filter(F.size("s") == lags + 2).select(F.col("s.x").alias("s"))
    terms = [F.lit(1.0), F.get("s", F.lit(1)), *[F.get("s", F.lit(i)) - F.get("s", F.lit(i + 1)) for i in range(1, lags + 1)]]
    target = F.get("s", F.lit(0)) - F.get("s", F.lit(1))
    k = len(terms)
    sums = wide.agg(F.count("*"), F.sum(target * target), *[F.sum(a * target) for a in terms], *[F.sum(a * b) for a in terms for b in terms]).first()
    n, yy, xy, xx = sums[0], sums[1], np.array(sums[2 : 2 + k], float), np.array(sums[2 + k :], float).reshape(k, k)
    beta = np.linalg.solve(xx, xy)
    sigma = (yy - beta @ xy) / (n - k)
    t = float(beta[1] / math.sqrt(sigma * np.linalg.inv(xx)[1, 1]))
    return one_row(df, {"adf_statistic": t, "p_value": adf_p_value(t), "stationary": t < -2.86, "n": n})
