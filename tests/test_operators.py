"""Operators against NumPy, hand-made data and invariants."""

import inspect
import math
import random

import numpy as np
import pytest
from granary.functions import distributions as d
from granary.functions import order
from granary.functions.columns import columns_of_type, nan_to_null, numeric
from granary.operators import cluster, explain, impute, information, metrics, outliers, reduce, scale, select, series, splits, stats
from granary.plans import catalog
from granary.sources import generators, tables
from granary.streaming import score
from pyspark.sql import functions as F
from pyspark.sql import types as T


@pytest.fixture(scope="module")
def jvm(spark):
    return spark.sparkContext._jvm.org.apache.commons.math3


def test_distributions_equal_the_jvm(jvm):
    for d1, d2, x in [(1, 5, 0.3), (2, 6, 3.0), (4, 9, 1.2), (10, 200, 0.9), (3, 3, 20.0)]:
        f = jvm.distribution.FDistribution(float(d1), float(d2))
        assert abs(d.f_sf(x, d1, d2) - (1 - f.cumulativeProbability(x))) < 1e-9
        assert abs(d.f_isf(0.05, d1, d2) / f.inverseCumulativeProbability(0.95) - 1) < 1e-6
    for k, x in [(1, 0.5), (2, 3.0), (7, 12.0), (30, 20.0)]:
        c = jvm.distribution.ChiSquaredDistribution(float(k))
        assert abs(d.chi2_sf(x, k) - (1 - c.cumulativeProbability(x))) < 1e-9
        assert abs(d.chi2_isf(0.05, k) / c.inverseCumulativeProbability(0.95) - 1) < 1e-6
    for k, x in [(1, 0.5), (5, -2.0), (50, 1.96)]:
        t = jvm.distribution.TDistribution(float(k))
        assert abs(d.t_sf(x, k) - (1 - t.cumulativeProbability(x))) < 1e-9
        assert abs(d.t_isf(0.025, k) / t.inverseCumulativeProbability(0.975) - 1) < 1e-6
    for x in (0.3, 1.0, 4.5, 40.0):
        assert abs(d.digamma(x) - jvm.special.Gamma.digamma(x)) < 1e-7
    assert d.f_sf(3, 2, 6) == pytest.approx(0.125)
    assert abs(d.normal_ppf(0.975) - 1.959964) < 1e-5 and d.normal_ppf(1) == math.inf
    assert sum(d.binomial_pmf(k, 9) for k in range(10)) == pytest.approx(1)


def test_order_in_ranges(spark, monkeypatch):
    monkeypatch.setattr(order, "ROWS_PER_RANGE", 7)
    monkeypatch.setattr(order.bounds_of, "__defaults__", (7,))
    rng = random.Random(1)
    values = [rng.randint(0, 30) for _ in range(200)] + [None, None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "k long, v long")
    got = {r.k: r for r in order.with_row_id(df, "v", "k").collect()}
    ranked = sorted(range(len(values)), key=lambda i: (values[i] is not None, values[i], i))
    assert [got[i].row_id for i in ranked] == list(range(len(values)))
    ranks = {r.k: r.r for r in order.with_rank(df, "v", "r").collect()}
    known = [v for v in values if v is not None]
    for i, v in enumerate(values):
        assert ranks[i] == (None if v is None else sum(x < v for x in known) + (known.count(v) + 1) / 2)
    ecdf = {r.k: r.r for r in order.with_rank(df, "v", "r", "ecdf").collect()}
    assert all(v is None or ecdf[i] == sum(x <= v for x in known) / len(known) for i, v in enumerate(values))


@pytest.mark.parametrize("bounds", [[], [5], list(range(0, 900, 7)), [1 << 60, (1 << 60) + 1], list(range(0, 448, 7))])
def test_range_of_a_key(spark, bounds):
    keys = [-1, 0, 5, 6, 7, 448, 449, 895, 896, 10_000, 1 << 60, (1 << 60) + 1, None]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    got = [r.r for r in df.select(order.range_of(F.col("k"), bounds).alias("r")).collect()]
    assert got == [0 if k is None else sum(b <= k for b in bounds) for k in keys]


def test_quantiles_are_the_same_either_way(spark):
    rng = random.Random(4)
    values = [rng.choice([None, rng.random(), 0.5]) for _ in range(301)]
    df = spark.createDataFrame([(v, None) for v in values], "v double, w double")
    shares = [0.0, 0.05, 0.25, 0.5, 0.77, 1.0]
    known = [v for v in values if v is not None]
    for most in (10, 1000):
        got = order.exact_quantiles(df, ["v", "w"], shares, most)
        assert got["v"] == pytest.approx(np.quantile(known, shares).tolist()) and got["w"] == [None] * 6


@pytest.mark.parametrize("rows", [200_000, 15])
def test_group_quantiles(spark, monkeypatch, rows):
    monkeypatch.setattr(order.bounds_of, "__defaults__", (rows,))
    rng = random.Random(rows)
    values = [(rng.choice(["a", "b", None]), rng.choice([rng.random(), 0.25, None])) for _ in range(200)] + [("one", 3.0), ("none", None)]
    got = {r.group: (r.q0, r.q1, r.q2) for r in order.group_quantiles(spark.createDataFrame(values, "g string, v double"), "v", [0.0, 0.3, 0.5], "g").collect()}
    groups = {g: [v for h, v in values if h == g and v is not None] for g in ("a", "b", None, "one")}
    assert got == {g: tuple(pytest.approx(float(np.quantile(v, q))) for q in (0, 0.3, 0.5)) for g, v in groups.items()}
    five = metrics.five_numbers(spark.createDataFrame(values, "g string, v double"), "v", "g").collect()
    assert {r.g for r in five} == {"a", "b", None, "one", "none"} and next(r for r in five if r.g == "none").median is None
    assert metrics.five_numbers(spark.createDataFrame([], "v double"), "v").first().median is None


def test_checks(spark):
    df = spark.createDataFrame([(1, "a", math.nan)], "i int, s string, x double")
    with pytest.raises(TypeError):
        numeric(df, ["s"])
    with pytest.raises(ValueError):
        scale.Scaler("other", ["i"])
    assert columns_of_type(df, T.StringType) == ["s"]
    assert nan_to_null(df).first().x is None


def test_scalers_and_nulls(spark):
    df = spark.createDataFrame([(1, 2.0, 5.0), (2, 4.0, 5.0), (3, None, 5.0), (4, 9.0, None)], "k int, a double, b double")
    out = scale.Scaler("standard", ["a", "b"]).fit_transform(df).collect()
    a = np.array([2.0, 4.0, 9.0])
    assert [r.a for r in out if r.a is not None] == pytest.approx(((a - a.mean()) / a.std()).tolist())
    assert all(r.b is None for r in out)  # no spread


def test_normal_quantiles_are_finite_and_monotone(spark):
    df = spark.range(50).select("id", (F.col("id") % 17).cast("double").alias("x"))
    model = scale.QuantileTransformer(["x"], "normal").fit(df)
    z = {r.x0: r.x for r in model.transform(df.withColumn("x0", F.col("x"))).collect()}
    assert all(math.isfinite(v) for v in z.values()) and [z[k] for k in sorted(z)] == sorted(z.values())
    low, high = (r.x for r in model.transform(spark.createDataFrame([(1, -5.0), (2, 99.0)], "id long, x double")).orderBy("id").collect())
    assert low <= min(z.values()) and high >= max(z.values())


def test_splits_partition_the_rows(spark):
    rows = spark.range(23).select(F.col("id").alias("row_id"), (F.col("id") % 3).alias("c"))
    for out in (splits.kfold(rows, 4), splits.shuffled_kfold(rows, 4, F.xxhash64("row_id")), splits.shuffled_kfold(rows, 4, F.xxhash64("row_id"), "c")):
        got = out.collect()
        tests = [r.row_id for r in got if r.role == "test"]
        assert sorted(tests) == list(range(23)) and len(got) == 23 * 4
    sizes = [r["n"] for r in splits.shuffled_kfold(rows, 4, F.xxhash64("row_id"), "c").filter("role = 'test'").groupBy("c", "split").agg(F.count("*").alias("n")).collect()]
    assert max(sizes) - min(sizes) <= 1
    boot = splits.block_bootstrap(rows, 2).collect()
    for s in (1, 2):
        own = [r for r in boot if r.split == s]
        assert len(own) == 23 and sum(r.times for r in own) == 23 and all((r.times == 0) == (r.role == "test") for r in own)
    assert splits.time_series_bounds(10, 3) == [(1, "train", 0, 2), (1, "test", 2, 4), (2, "train", 0, 4), (2, "test", 4, 6), (3, "train", 0, 6), (3, "test", 6, 8)]


def test_iterative_imputer_recovers_a_line(spark):
    df = spark.range(60).select("id", F.col("id").cast("double").alias("a"), F.when(F.col("id") % 10 != 0, 3 * F.col("id") + 1.0).alias("b"))
    got = impute.IterativeImputer(["a", "b"]).fit_transform(df).collect()
    assert all(abs(r.b - (3 * r.id + 1)) < 1e-3 for r in got)
    assert impute.column_order(df.withColumn("c", F.lit(None).cast("double")), ["a", "b", "c"], "descending") == ["c", "b"]


def test_weighted_neighbours(spark):
    train = spark.createDataFrame([(1, 0.0, 10.0), (2, 1.0, 20.0), (3, 9.0, 90.0)], "k int, a double, b double")
    asked = spark.createDataFrame([(7, 0.2, None), (8, 5.0, 1.0)], "k int, a double, b double")
    got = {r.k: r.b for r in impute.knn_impute(train, asked, "k", ["a", "b"], 2, "weighted").collect()}
    assert got == {7: pytest.approx((2 * 10 + 20) / 3), 8: 1.0}


def test_isolation_forest_finds_a_far_point(spark):
    df = generators.blobs(spark, 300).select("id", "x", "y").unionByName(spark.createDataFrame([(999, 9.0, -9.0)], "id long, x double, y double"))
    model = outliers.fit_isolation_forest(df, ["x", "y"], n_estimators=30)
    scores = {r.id: r.anomaly_score for r in model.score_samples(df).collect()}
    assert max(scores, key=scores.get) == 999
    assert abs(outliers.path_constant(256) - 10.2448) < 1e-3


def test_isolation_forest_samples_rows_not_values(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 0.0).otherwise(1.0).alias("x"))
    for key in (["id"], None):
        trees = outliers.fit_isolation_forest(df, ["x"], n_estimators=20, max_samples=16, key=key).trees
        low = [t[t[0][2]][4] if t[0][0] >= 0 else 0 for t in trees]
        assert abs(sum(low) / (20 * 16) - 1 / 3) < 0.12


def test_statistics_of_toy_data(spark):
    df = spark.createDataFrame([(1, 2.3), (1, 2.1), (1, 2.5), (2, 3.2), (2, 3.0), (2, 3.4), (3, 1.8), (3, 1.9), (3, 2.0)], "g int, y double")
    got = stats.anova(df, "g", "y").first()
    groups = [[2.3, 2.1, 2.5], [3.2, 3.0, 3.4], [1.8, 1.9, 2.0]]
    between = sum(3 * (np.mean(g) - 2.4667) ** 2 for g in groups) / 2
    assert got.test_statistic == pytest.approx(between / (sum(np.var(g) * 3 for g in groups) / 6), rel=1e-3)
    assert got.p_value == pytest.approx((1 + 2 * got.test_statistic / 6) ** -3)
    cells = spark.createDataFrame(list(zip("ABABA", ["Yes", "No", "Yes", "No", "Yes"])), "x string, y string")
    chi = stats.chi_square(cells, "x", "y").first()
    assert chi.test_statistic == pytest.approx(5) and chi.cramers_v == pytest.approx(1) and not chi.assumption


def test_hoeffding_is_symmetric(spark):
    rng = random.Random(2)
    df = spark.createDataFrame([(i, rng.random(), rng.random()) for i in range(30)], "k int, x double, y double")
    assert stats.hoeffding(df, "k", "x", "y").first().hoeffding_d == pytest.approx(stats.hoeffding(df, "k", "y", "x").first().hoeffding_d)


@pytest.mark.parametrize("values, rows", [(5, 200_000), (40, 200_000), (40, 10), (1000, 25)])
def test_quadrants_against_brute_force(spark, monkeypatch, values, rows):
    from granary.functions.order import bounds_of

    monkeypatch.setattr(stats, "bounds_of", lambda df, key: bounds_of(df, key, rows))
    rng = random.Random(values)
    points = [(float(rng.randrange(values)), float(rng.randrange(values))) for _ in range(150)] + [(2.0, 3.0)] * 50
    half = lambda a, b: 1.0 if a > b else 0.5 if a == b else 0.0
    want = sorted((points.count((x, y)), sum(half(x, u) for u, _ in points), sum(half(y, v) for _, v in points), sum(half(x, u) * half(y, v) for u, v in points)) for x, y in set(points))
    df = spark.createDataFrame([*points, (None, 1.0), (1.0, None)], "x double, y double")
    assert sorted((r.w, r.r, r.s, r.q) for r in stats.quadrants(df, "x", "y").collect()) == want
    assert stats.hoeffding(df.limit(0), "x", "x", "y").first().hoeffding_d is None


@pytest.mark.parametrize("metric, dims, k, by, rows", [("euclidean", 2, 3, None, 200_000), ("manhattan", 1, 1, "c", 30), ("chebyshev", 4, 20, None, 40), ("euclidean", 2, 300, "c", 20)])
def test_nearest_against_brute_force(spark, monkeypatch, metric, dims, k, by, rows):
    from granary.functions.order import bounds_of
    from granary.operators import nearby

    monkeypatch.setattr(nearby, "bounds_of", lambda df, key: bounds_of(df, key, rows))
    rng = random.Random(dims)
    kinds = (lambda: rng.gauss(0, 1), lambda: rng.gauss(1000, 0.001), lambda: float(rng.randrange(3)), lambda: -1e6 * rng.random())
    points = [(i, rng.choice("uvw"), *[rng.choice(kinds)() for _ in range(dims)]) for i in range(150)]
    points += [(1000 + i, "u", *[1.0] * dims) for i in range(60)] + [(2000, "z", *[5.0] * dims)]
    odd = [(2001, None, *[1.0] * dims)] if by else []
    odd += [(2002, "u", None, *[1.0] * (dims - 1)), (2003, "u", math.nan, *[1.0] * (dims - 1))]
    size = {"euclidean": lambda g: math.sqrt(sum(v * v for v in g)), "manhattan": sum, "chebyshev": max}[metric]
    want = []
    for a, c, *x in points:
        others = sorted((size([abs(p - q) for p, q in zip(x, y)]), b) for b, e, *y in points if b != a and (not by or c == e))
        want += [(a, b, r + 1, pytest.approx(d)) for r, (d, b) in enumerate(others[:k])]
    cols = [f"x{i}" for i in range(dims)]
    df = spark.createDataFrame(points + odd, "id int, c string, " + ", ".join(f"{c} double" for c in cols))
    found = nearby.nearest(df, "id", cols, k, metric, by).orderBy("a", "r").collect()
    assert [(n.a, n.b, n.r, n.d) for n in found] == sorted(want, key=lambda w: (w[0], w[2]))
    assert nearby.nearest(df.limit(0), "id", cols, k, metric, by).count() == 0


@pytest.mark.parametrize("reach", [False, True])
def test_local_outlier_factor_of_copies_by_points(spark, monkeypatch, reach):
    written, write = [], outliers.materialize
    monkeypatch.setattr(outliers, "materialize", lambda df, name: written.append(write(df, name)) or written[-1])
    rng, k = random.Random(9), 4
    places = [(rng.gauss(0, 1), rng.gauss(0, 1)) for _ in range(25)]
    points = [(i, *places[i]) for i in range(25)] + [(100 + i, *places[i % 3]) for i in range(9)] + [(200 + i, *places[20]) for i in range(300)]
    near = {}
    for a, x, y in points:
        near[a] = sorted((math.dist((x, y), (u, v)), b) for b, u, v in points if b != a)[:k]
    far = {a: max(d for d, _ in near[a]) for a in near}
    total = {a: sum(max(d, far[b]) if reach else d for d, b in near[a]) for a in near}
    lrd = {a: k / t if t else None for a, t in total.items()}
    other = {a: [lrd[b] for _, b in near[a] if lrd[b] is not None] for a in near}
    df = spark.createDataFrame(points, "id long, x double, y double")
    got = {r.id: (r.lrd, r.lof) for r in outliers.local_outlier_factor(df, "id", ["x", "y"], k, reach=reach).collect()}
    assert set(got) == set(near) and lrd[200] is None and lrd[0] is not None
    for a in near:
        assert got[a] == (pytest.approx(lrd[a]), pytest.approx(sum(other[a]) / (k * lrd[a])) if lrd[a] and other[a] else None)
    assert max(t.count() for t in written) <= 25  # a row per point, not k per row
    assert outliers.local_outlier_factor(df.limit(0), "id", ["x", "y"], k, reach=reach).count() == 0


def test_count_near_against_brute_force(spark):
    rng = random.Random(8)
    rows = [(i, round(rng.choice([rng.random(), 0.5]), 2), round(rng.random() / 4, 2)) for i in range(200)]
    df = spark.createDataFrame([*rows, (-1, None, 0.1), (-2, 0.5, None)], "i int, v double, e double")
    got = {r.i: r.n for r in order.count_near(df, "v", "e", "n").collect()}
    values = [v for _, v, _ in rows] + [0.5]
    assert got == {-1: None, -2: None} | {i: sum(round(abs(v - u), 9) < e for u in values) for i, v, e in rows}


def test_digamma_of_a_column(spark):
    got = spark.range(1, 400).select("id", d.digamma_of(F.col("id")).alias("v")).collect()
    assert all(r.v == pytest.approx(d.digamma(r.id), abs=1e-12) for r in got)


def test_information_without_pairs(spark):
    df = spark.createDataFrame([(1, 1.0, "a"), (2, None, "a"), (3, 2.0, "b")], "id int, x double, c string")
    assert information.continuous_discrete(df, "x", "c").first()[0] == 0.0
    assert information.continuous_continuous(df, "id", "x", "id").first()[0] == 0.0
    same = spark.range(50).select("id", F.lit(1.0).alias("x"), (F.col("id") % 2).cast("string").alias("c"))
    assert information.continuous_discrete(same, "x", "c").first()[0] >= 0.0


def test_factors_of_other_rows(spark):
    import numpy as np

    h = np.array([[1.0, 0.0, 2.0], [0.0, 3.0, 1.0]])
    rows = spark.createDataFrame([(i, float(i), 3.0 * (9 - i), 2.0 * i + 9 - i) for i in range(10)], "id int, a double, b double, c double")
    got = reduce.nnmf_scores(rows, ["a", "b", "c"], h).collect()
    assert all(r.w0 == pytest.approx(r.id, abs=1e-6) and r.w1 == pytest.approx(9 - r.id, abs=1e-6) for r in got)


def test_chi_square_parts_against_brute_force(spark):
    rng = random.Random(4)
    pairs = [(rng.randrange(9), min(rng.randrange(12), rng.randrange(12))) for _ in range(120)]
    xs, ys = [x for x, _ in pairs], [y for _, y in pairs]
    grid = [(pairs.count((x, y)), xs.count(x) * ys.count(y) / 120) for x in set(xs) for y in set(ys)]
    got = stats.chi_square_parts(spark.createDataFrame([*pairs, (None, 1)], "x int, y int"), "x", "y").first()
    assert got.chi2 == pytest.approx(sum((o - e) ** 2 / e for o, e in grid)) and (got.n, got.rows, got.cols) == (120, len(set(xs)), len(set(ys)))
    assert got.share_expected_above_5 == pytest.approx(sum(e > 5 for _, e in grid) / len(grid)) and got.min_expected == pytest.approx(min(e for _, e in grid))


def test_information_of_dependent_columns(spark):
    df = spark.range(400).select("id", generators.gaussian(1, 1).alias("x"), generators.gaussian(1, 2).alias("e"))
    df = df.withColumn("same", F.col("x") + 0.1 * F.col("e")).withColumn("c", (F.col("x") > 0).cast("int"))
    strong, weak = (information.continuous_continuous(df, "id", "x", c).first()[0] for c in ("same", "e"))
    assert strong > 1.5 and weak < 0.15
    assert 0.6 < information.continuous_discrete(df, "x", "c").first()[0] < 0.75  # ln 2


def test_dbscan_of_rings_and_order(spark):
    rows = generators.rings(spark, radii=[(100.0, 150), (30.0, 60)], noise=1.0, background=0)
    got = {r.id: r.cluster for r in cluster.dbscan(rows, "id", ["x", "y"], 8.0, 3).collect()}
    truth = {r.id: r.ring for r in rows.collect()}
    assert len({got[i] for i in truth if truth[i] == 0}) == 1 and len({got[i] for i in truth if truth[i] == 1}) == 1 and len(set(got.values())) == 2


def test_kmeans_finds_blobs(spark):
    rows = generators.blobs(spark, 200, [(0.0, 0.0), (8.0, 8.0)])
    out = cluster.fit_kmeans(rows, ["x", "y"], 2).transform(rows).groupBy("blob").agg(F.countDistinct("cluster").alias("n")).collect()
    assert all(r["n"] == 1 for r in out)
    errors = spark.createDataFrame([(1, 100.0), (2, 20.0), (3, 18.0), (4, 17.0)], "k int, sse double")
    assert metrics.knee(errors, "k", "sse").first().k == 2 and metrics.elbow(errors, "k", "sse").first().k == 3


def test_single_linkage_is_the_spanning_tree(spark):
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate([0, 1, 3, 7, 15])], "k int, x double")
    got = cluster.agglomerate(df, "k", ["x"], linkage="single").orderBy("step").collect()
    assert [r.distance for r in got] == [1, 2, 4, 8] and got[-1]["size"] == 5


def test_reductions(spark):
    df = generators.planted_linear(spark, 300).withColumn("x1", F.col("x0") * 2 + 0.01 * F.col("x1"))
    cols = [f"x{i}" for i in range(5)]
    x = np.array(df.select(*cols).collect())
    pca = reduce.fit_pca(df, cols, 2)
    u, s, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
    assert np.allclose(np.abs(pca.components @ vt[:2].T), np.eye(2), atol=1e-6)
    assert reduce.explained_variance(df, cols).agg(F.max("cumulative")).first()[0] == pytest.approx(1)
    assert np.allclose(reduce.fit_svd(df, cols, 2).explained, np.linalg.svd(x)[1][:2])
    factors = reduce.fit_factor_analysis(df, cols, 1)
    assert factors.log_likelihood == sorted(factors.log_likelihood) and factors.communalities()[0] > 0.9 * x[:, 0].var()
    two = df.withColumn("c", (F.col("x0") > 0).cast("int"))
    lda = reduce.fit_lda(two, ["x0", "x3"], "c")
    assert abs(lda.components[0][0]) > 5 * abs(lda.components[0][1])
    w, h = reduce.fit_nnmf(df.select("id", F.abs("x0").alias("a"), F.abs("x3").alias("b")), "id", ["a", "b"], 2, max_iter=300)
    assert (h >= 0).all() and w.agg(F.min("w0")).first()[0] >= 0
    linear = reduce.fit_kernel_pca(df, "id", cols, 2, "linear").transform(df).select("k0").collect()
    plain = pca.transform(df).select("c0").collect()
    assert abs(np.corrcoef([r.k0 for r in linear], [r.c0 for r in plain])[0, 1]) > 0.999
    with pytest.raises(ValueError):
        reduce.tsne(df, "id", cols, most=10)


def test_kernel_pca_drops_no_rows(spark):
    df = generators.planted_linear(spark, 30)
    assert len(reduce.fit_kernel_pca(df, "id", ["x0", "x1"], 1, most=30).landmarks) == 30
    with pytest.raises(ValueError):
        reduce.fit_kernel_pca(df, "id", ["x0", "x1"], 1, most=29)


def test_tsne_separates_blobs(spark):
    rows = generators.blobs(spark, 60, [(0.0, 0.0), (20.0, 20.0)])
    got = reduce.tsne(rows, "id", ["x", "y"], perplexity=8, n_iter=300, learning_rate=50).join(rows, "id").select("t0", "t1", "blob").collect()
    a, b = (np.array([[r.t0, r.t1] for r in got if r.blob == k]) for k in (0, 1))
    assert np.linalg.norm(a.mean(0) - b.mean(0)) > 2 * max(a.std(), b.std())


def test_queries_iterate_to_the_end(spark, small, monkeypatch):
    calls = []

    def spy(module, name, result):
        own = inspect.signature(getattr(module, name))

        def run(*args, **options):
            bound = own.bind(*args, **options)
            bound.apply_defaults()
            calls.append((name, bound.arguments))
            return result(bound.arguments)

        monkeypatch.setattr(module, name, run)

    spy(cluster, "fit_kmeans", lambda a: cluster.KMeansModel(a["cols"], [[0.0, 0.0]] * a["k"]))
    spy(reduce, "tsne", lambda a: a["df"])
    for name in ("elbow_sse", "gap_statistic", "tsne"):
        catalog.QUERIES[name](spark, small)
    fits = [a for n, a in calls if n == "fit_kmeans"]
    assert len(fits) == 4 + 3 * (5 + 1) and {(a["n_init"], a["max_iter"]) for a in fits} == {(10, 300)}
    assert [a["n_iter"] for n, a in calls if n == "tsne"] == [1000]


def test_shapley_values_add_up(spark):
    got = select.shapley(["a", "b", "c"], lambda s: 3.0 * ("a" in s) + 2.0 * ("a" in s and "b" in s))
    assert got == {"a": pytest.approx(4), "b": pytest.approx(1), "c": 0}
    nodes = [(0, 0.5, 1, 2, 10.0, 0.0), (-1, 0, -1, -1, 4.0, 1.0), (1, 0.5, 3, 4, 6.0, 0.0), (-1, 0, -1, -1, 3.0, 5.0), (-1, 0, -1, -1, 3.0, 9.0)]
    df = spark.createDataFrame([(0.0, 0.0, 1.0), (1.0, 1.0, 1.0)], "a double, b double, c double")
    mean = 0.4 * 1 + 0.6 * 7
    for r, f in zip(explain.tree_shap(df, ["a", "b", "c"], nodes).collect(), (1.0, 9.0)):
        assert r.shap_a + r.shap_b + r.shap_c == pytest.approx(f - mean) and r.shap_c == 0


def test_selection_finds_planted_features(spark):
    from pyspark.ml.regression import LinearRegression

    rows = generators.planted_linear(spark, 300, 4).withColumnRenamed("id", "row_id").persist()
    features = [f"x{i}" for i in range(4)]
    e = select.Evaluation(rows, "y", LinearRegression(), "rmse")
    assert set(select.forward(e, features)) >= {"x0", "x2"} and set(select.backward(e, features)) >= {"x0", "x2"}
    ranks = {r.feature: r["rank"] for r in select.leave_one_feature_out(e, features).collect()}
    assert ranks["x2"] == 1 and ranks["x0"] == 2
    noisy = {r.feature: r["rank"] for r in select.perturbation(e, ["x0", "x1", "x2"], 2).collect()}
    assert set(noisy) == {"x0", "x1", "x2"}
    verdicts = {r.feature: r.verdict for r in select.boruta(e, features, max_iter=6).collect()}
    assert verdicts["x0"] == verdicts["x2"] == "important"
    assert select.selection_accuracy(["x0", "x2"], ["x0", "x2"], features) == 1
    assert select.boruta_limits(20) == (6, 14)


def test_boruta_query_finds_a_planted_feature(spark, tmp_path):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.lit("word "), F.repeat(F.lit("#"), (F.col("id") % 10).cast("int")), F.repeat(F.lit("x"), F.pmod(F.hash("id"), F.lit(40)))).alias("text"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs.select("doc_id", (F.col("doc_id") % 10 > 4).cast("int").alias("quality")).write.parquet(f"{tmp_path}/labels.parquet")
    verdicts = {r.feature: r.verdict for r in catalog.QUERIES["select_boruta"](spark, str(tmp_path)).collect()}
    assert verdicts["n_marks"] == "important" and verdicts["n_lines"] == "unimportant"


def sent_to_driver(spark, since: int = -1) -> tuple[int, int]:
    """Bytes of the results of the stages after ``since``, and the last stage."""
    store, sc = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    lists = sc._jvm.java.util.ArrayList
    stages = store.stageList(lists(), False, False, sc._gateway.new_array(sc._jvm.double, 0), lists())
    found = [(stages.apply(i).stageId(), stages.apply(i).resultSize()) for i in range(stages.size())]
    return sum(size for k, size in found if k > since), max(k for k, _ in found)


def test_boruta_sends_no_rows_to_the_driver(spark):
    from pyspark.ml.classification import DecisionTreeClassifier

    rows = spark.range(0, 60_000, 1, 2).select(F.col("id").alias("row_id"), F.rand(1).alias("a"), F.rand(2).alias("b")).withColumn("y", (F.col("a") > 0.5).cast("double")).localCheckpoint()
    e = select.Evaluation(rows, "y", DecisionTreeClassifier(maxDepth=2, seed=1), "accuracy")
    last = sent_to_driver(spark)[1]
    assert {r.feature: r.hits for r in select.boruta(e, ["a", "b"], max_iter=2).collect()}["a"] == 2
    assert sent_to_driver(spark, last)[0] < 1_500_000


def test_shadows_are_the_values_in_hash_order(spark, monkeypatch):
    monkeypatch.setattr(select, "ROWS_PER_RANGE", 30)
    rng = random.Random(5)
    values = [(i, rng.choice([None, math.nan, rng.random()]), rng.randrange(9)) for i in range(300)]
    rows = spark.createDataFrame(values, "row_id long, x double, n int")
    hashes = rows.select("row_id", *[F.xxhash64("row_id", F.lit(1017 + i)).cast("double").alias(f"h{i}") for i in range(2)]).collect()
    want = [[values[h.row_id][1 + i] for h in sorted(hashes, key=lambda h: (h[f"h{i}"], h.row_id))] for i in range(2)]
    got = select._with_shadows(rows, ["x", "n"], 300, 1017).orderBy("row_id").collect()
    assert repr([(r.x, r.n, r["__shadow0"], r["__shadow1"]) for r in got]) == repr([(x, n, a, float(b)) for (_, x, n), a, b in zip(values, *want)])


def test_shuffled_folds_move_no_rows(spark, monkeypatch):
    from granary.functions.order import bounds_of

    monkeypatch.setattr(order, "bounds_of", lambda df, key: bounds_of(df, key, 20))
    monkeypatch.setattr(splits, "ROWS_PER_RANGE", 20, raising=False)
    rng = random.Random(3)
    for n, k in ((157, 5), (3, 5), (0, 2), (40, 1)):
        keys = [(i, rng.choice([None, math.nan, math.inf, 0.0, rng.gauss(0, 1), 7.0])) for i in range(n)]
        rows = spark.createDataFrame(keys, "row_id long, v double")
        sizes = [n // k + (j < n % k) for j in range(k)]
        folds = [j + 1 for j in range(k) for _ in range(sizes[j])]
        plain = sorted(keys, key=lambda r: (r[1] is not None, r[1] is not None and math.isnan(r[1]), 0 if r[1] is None or math.isnan(r[1]) else r[1], r[0]))
        shares = {r.row_id: r.s for r in rows.select("row_id", order.share_of("row_id", 18).alias("s")).collect()}
        drawn = sorted(range(n), key=lambda i: (shares[i], i))
        for found, want, more in (
            (splits.shuffled_kfold(rows, k, F.col("v")), {r[0]: f for r, f in zip(plain, folds)}, 0),
            (splits.repeated_kfold(rows, k, 2).filter(f"split > {k}"), dict(zip(drawn, folds)), k),
        ):
            assert "Window" not in found._jdf.queryExecution().executedPlan().toString()
            got = found.collect()
            assert len(got) == n * k and {(r.split - more, r.row_id) for r in got if r.role == "test"} == {(f, i) for i, f in want.items()}
    many = splits.shuffled_kfold(spark.range(150).withColumnRenamed("id", "row_id"), 70, -F.col("row_id"))
    assert {r.split: r.n for r in many.filter("role = 'test'").groupBy("split").agg(F.count("*").alias("n")).collect()} == {j: 3 if j <= 10 else 2 for j in range(1, 71)}


def test_encodings(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("c",)], "v string")
    assert [(r.v, r.o) for r in series.ordinal_encode(df, "v", "o").orderBy("v").collect()] == [(None, None), ("a", 0), ("b", 1), ("c", 2)]
    assert series.one_hot(df, "v").filter("v = 'c'").first()["v_c"] == 1
    with pytest.raises(ValueError):
        series.one_hot(df, "v", most=2)


def test_csv_and_models(spark, tmp_path):
    from pyspark.ml.regression import LinearRegression, LinearRegressionModel
    from pyspark.ml.feature import VectorAssembler

    path = str(tmp_path / "t.csv")
    (tmp_path / "t.csv").write_text("ticker,returns\na,0.5\nb,NaN\nc,\n")
    got = tables.read_csv(spark, path, "ticker string, returns double").orderBy("ticker").collect()
    assert [r.returns for r in got] == [0.5, None, None]
    tables.write_parquet(generators.planted_linear(spark, 20), str(tmp_path / "p"))
    rows = VectorAssembler(inputCols=["x0", "x2"], outputCol="features").transform(tables.read_parquet(spark, str(tmp_path / "p")))
    tables.save_model(LinearRegression(labelCol="y").fit(rows), str(tmp_path / "m"))
    assert tables.load_model(LinearRegressionModel, str(tmp_path / "m")).coefficients[1] == pytest.approx(2, abs=1e-3)


def test_models_score_streams(spark, tmp_path):
    rows = spark.range(40).select("id", F.col("id").cast("double").alias("x"), F.timestamp_seconds(F.col("id") * 600).alias("t"))
    rows.write.parquet(str(tmp_path / "in"))
    model = scale.Scaler("minmax", ["x"]).fit(rows)
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    run = score.score_stream(stream, model).writeStream.format("memory").queryName("scored").trigger(availableNow=True).start()
    run.awaitTermination(60)
    assert spark.table("scored").agg(F.max("x")).first()[0] == 1
    run = score.windowed_summary(stream, "t", "x").writeStream.outputMode("complete").format("memory").queryName("summary").trigger(availableNow=True).start()
    run.awaitTermination(60)
    assert spark.table("summary").agg(F.sum("n")).first()[0] == 40


def test_normal_quantile_column(spark):
    from statistics import NormalDist

    from granary.functions.distributions import normal_ppf_of

    shares = [1e-12, 1e-6, 0.01, 0.02425, 0.3, 0.5, 0.7, 0.98, 0.999999]
    got = spark.createDataFrame([(p,) for p in [*shares, 0.0, 1.0, None]], "p double").select("p", normal_ppf_of(F.col("p")).alias("z")).collect()
    for r in got:
        if r.p in shares:
            assert abs(r.z - NormalDist().inv_cdf(r.p)) < 1e-7
        else:
            assert r.z is None


def test_adf_p_value():
    from granary.operators.stats import adf_p_value

    assert abs(adf_p_value(-2.86) - 0.05) < 0.002 and abs(adf_p_value(-3.43) - 0.01) < 0.001 and abs(adf_p_value(-2.57) - 0.10) < 0.003
    assert adf_p_value(3.0) == 1.0 and adf_p_value(-20.0) == 0.0


def test_recursive_elimination_and_benchmark(spark):
    from granary.operators import select, splits
    from pyspark.ml.regression import LinearRegression

    rows = generators.planted_linear(spark, 400, 4).withColumnRenamed("id", "row_id")
    e = select.Evaluation(rows, "y", LinearRegression(), "rmse", splits.kfold(rows.select("row_id"), 2))
    features = [f"x{i}" for i in range(4)]
    assert sorted(select.rfe(e, features, 2)) == ["x0", "x2"] and {"x0", "x2"} <= set(select.rfecv(e, features))
    out = select.benchmark(e, {"rfe": lambda: select.rfe(e, features, 2), "one": lambda: ["x2"]}, ["x0", "x2"], features).collect()
    assert [(r.selector, r.selection_accuracy) for r in out] == [("rfe", 1.0), ("one", 0.75)] and out[0].valid_score > out[1].valid_score


def test_leaf_counts(spark):
    from granary.operators import cluster

    points = spark.createDataFrame([(0, 0.0), (1, 0.1), (2, 5.0), (3, 5.3), (4, 20.0)], "k int, x double")
    rows = cluster.leaf_counts(cluster.agglomerate(points, "k", ["x"], linkage="single")).orderBy("step").collect()
    assert [(r.left_leaves, r.right_leaves, r.leaves) for r in rows] == [(1, 1, 2), (1, 1, 2), (2, 2, 4), (1, 4, 5)]


def test_scratch_tables_go(spark, tmp_path, monkeypatch):
    import os

    from granary.functions import storage

    storage.sweep(spark)
    monkeypatch.setattr(storage, "shared_dir", lambda spark: f"file://{tmp_path}")
    with storage.scratch(spark) as work:
        storage.materialize(spark.range(3), "gone")
        kept = storage.materialize(spark.range(5), "kept")
        work.keep(kept)
    assert len(os.listdir(tmp_path)) == 1 and kept.count() == 5
    with pytest.raises(ZeroDivisionError), storage.scratch(spark) as work:
        work.keep(storage.materialize(spark.range(3), "gone"))
        1 / 0
    assert len(os.listdir(tmp_path)) == 1
    storage.sweep(spark)
    assert not os.listdir(tmp_path)


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from granary.functions import storage

    conf, context = SimpleNamespace(get=lambda key, other: other), SimpleNamespace(master="spark://host:7077", applicationId="a")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        storage.shared_dir(SimpleNamespace(conf=conf, sparkContext=context))


def test_quadrants_by_stretches_without_a_broadcast(spark, monkeypatch):
    monkeypatch.setattr(stats, "STRETCH", 17)
    rng = random.Random(3)
    points = [(float(rng.randrange(20)), float(rng.randrange(30))) for _ in range(300)]
    half = lambda a, b: 1.0 if a > b else 0.5 if a == b else 0.0
    want = sorted((points.count((x, y)), sum(half(x, u) * half(y, v) for u, v in points)) for x, y in set(points))
    got = stats.quadrants(spark.createDataFrame(points, "x double, y double"), "x", "y")
    assert "BroadcastHashJoin" not in got._jdf.queryExecution().toString()
    assert sorted((r.w, r.q) for r in got.collect()) == want


def test_silhouette_in_blocks_and_of_copies(spark, monkeypatch):
    monkeypatch.setattr(cluster, "BLOCK", 7)
    rng = random.Random(5)
    points = [(i, float(rng.randrange(6)), float(rng.randrange(6)), rng.randrange(3)) for i in range(90)]
    got = {r.i: r for r in cluster.silhouette(spark.createDataFrame([*points, (90, None, 1.0, 0)], "i int, x double, y double, g int"), "i", ["x", "y"], "g").collect()}
    for i, x, y, g in points:
        means = {e: [((x - u) ** 2 + (y - v) ** 2) ** 0.5 for j, u, v, h in points if h == e and j != i] for e in range(3)}
        means = {e: sum(d) / len(d) for e, d in means.items()}
        assert got[i].a == pytest.approx(means[g]) and got[i].b == pytest.approx(min(m for e, m in means.items() if e != g))
    assert len(got) == 91 and got[90].silhouette == 0


def test_dbscan_writes_no_pairs_of_close_points(spark, monkeypatch):
    from granary.functions.storage import materialize

    written = []

    def counted(df, name, *more):
        table = materialize(df, name, *more)
        written.append(table.count())
        return table

    monkeypatch.setattr(cluster, "materialize", counted)
    monkeypatch.setattr(cluster, "UNIT", 16)
    rows = spark.range(300).select("id", (F.col("id") / 1000).alias("x"), F.lit(0.0).alias("y"))
    assert {r.cluster for r in cluster.dbscan(rows, "id", ["x", "y"], 1.0, 4).collect()} == {0}
    assert max(written) <= 300
    assert {r.n for r in cluster.core_points(rows, "id", ["x", "y"], 1.0, 4).collect()} == {300}


def test_kernel_pca_of_a_smooth_kernel_has_no_limit_of_rows(spark):
    df = generators.blobs(spark, 3100, [(0.0, 0.0), (3.0, 1.0)])
    few = df.filter("id < 200")
    dense = reduce.fit_kernel_pca(few, "id", ["x", "y"], 2, "rbf", 0.05).transform(few).orderBy("id").collect()
    found = reduce.fit_low_rank_kernel_pca(few, ["x", "y"], 2, "rbf", 0.05).transform(few).orderBy("id").collect()
    assert np.allclose([[r.k0, r.k1] for r in dense], [[r.k0, r.k1] for r in found], atol=1e-6)
    assert reduce.fit_low_rank_kernel_pca(df, ["x", "y"], 2, "rbf", 0.05).transform(df).count() == 3100
    with pytest.raises(ValueError):
        reduce.fit_low_rank_kernel_pca(few, ["x", "y"], 2, "rbf", 1e6, most=50)


def test_knn_impute_by_patterns_of_nulls(spark, monkeypatch):
    monkeypatch.setattr(impute, "UNIT", 2)
    rng = random.Random(9)
    rows = [(i, *[float(rng.randrange(5)) if rng.random() < 0.7 else None for _ in range(3)]) for i in range(80)]
    got = {r.i: r for r in impute.knn_impute(*[spark.createDataFrame(rows, "i int, x double, y double, z double")] * 2, "i", ["x", "y", "z"], 4, "weighted").collect()}
    for row in rows:
        near = []
        for other in rows:
            gaps = [(p - q) ** 2 for p, q in zip(row[1:], other[1:]) if p is not None and q is not None]
            if gaps and other[0] != row[0]:
                near.append(((3 / len(gaps) * sum(gaps)) ** 0.5, other[0], other[1:]))
        near = sorted(near)[:4]
        for c, v in enumerate(row[1:]):
            known = [(4 - r, o[2][c]) for r, o in enumerate(near) if o[2][c] is not None]
            want = v if v is not None else sum(w * u for w, u in known) / sum(w for w, _ in known) if known else None
            assert got[row[0]][1 + c] == (want if want is None else pytest.approx(want))


def test_levene_centers_are_not_shuffled_by_group(spark):
    df = spark.range(60).select((F.col("id") % 2).alias("x"), F.col("id").cast("double").alias("y"))
    bound = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "SortMergeJoin" not in stats.levene_groups(df, "x", "y")._jdf.queryExecution().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", bound)
