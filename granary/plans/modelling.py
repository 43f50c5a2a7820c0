"""Queries of clustering, reduction, selection, tuning and explanation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from granary.functions.order import with_row_id
from granary.functions.storage import materialize
from granary.operators import cluster, explain, metrics, reduce, select, splits
from granary.plans.registry import gaussian_sql, load, query, rounded, share_sql
from granary.sources import generators

_CENTERS = [[10.0, 20000.0], [30.0, 40000.0], [45.0, 80000.0]]
_XY = ["l_quantity", "l_extendedprice"]
_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
_NEAR = "WITH d AS (SELECT *, " + ", ".join(f"(l_quantity - {a}) * (l_quantity - {a}) + (l_extendedprice - {b}) * (l_extendedprice - {b}) AS d{i}" for i, (a, b) in enumerate(_CENTERS)) + " FROM lineitem), a AS (SELECT *, CASE WHEN d0 <= d1 AND d0 <= d2 THEN 0 WHEN d1 <= d2 THEN 1 ELSE 2 END AS cluster FROM d) "


@query("kmeans_assign", _NEAR + f"SELECT {', '.join(_KEY)}, cluster, round(least(d0, d1, d2), 4) AS squared_distance FROM a")
def kmeans_assign(spark, folder):
    return rounded(cluster.KMeansModel(_XY, _CENTERS).transform(load(spark, folder, "lineitem")).select(*_KEY, "cluster", "squared_distance"), 4)


@query("kmeans_step", _NEAR + "SELECT cluster, round(avg(l_quantity), 6) AS c0, round(avg(l_extendedprice), 4) AS c1 FROM a GROUP BY cluster")
def kmeans_step(spark, folder):
    centers = cluster.KMeansModel(_XY, _CENTERS).step(load(spark, folder, "lineitem")).centers
    return rounded(spark.createDataFrame([(i, *c) for i, c in enumerate(centers)], "cluster int, c0 double, c1 double"), c1=4)


@query("cluster_sse", _NEAR + "SELECT cluster, count(*) AS n, round((var_pop(l_quantity) + var_pop(l_extendedprice)) * count(*) / 1e6, 2) AS sse FROM a GROUP BY cluster")
def cluster_sse(spark, folder):
    rows = cluster.KMeansModel(_XY, _CENTERS).transform(load(spark, folder, "lineitem"))
    return rounded(cluster.cluster_sse(rows, _XY, "cluster").withColumn("sse", F.col("sse") / 1e6), 2)


def suppliers(spark, folder):
    return load(spark, folder, "supplier").select("s_suppkey", (F.col("s_acctbal") / 100).alias("a"), F.col("s_nationkey").cast("double").alias("b"))


_S = "s AS (SELECT s_suppkey AS k, s_acctbal / 100 AS a, s_nationkey::DOUBLE AS b FROM supplier), p AS (SELECT q.k AS i, t.k AS j, sqrt((q.a - t.a) * (q.a - t.a) + (q.b - t.b) * (q.b - t.b)) AS d FROM s q JOIN s t ON q.k <> t.k)"


@query("kmeans_fit")
def kmeans_fit(spark, folder):
    rows = suppliers(spark, folder)
    return rounded(cluster.fit_kmeans(rows, ["a", "b"], 4).transform(rows))


@query("elbow_sse")
def elbow_sse(spark, folder):
    return rounded(cluster.sse_by_k(suppliers(spark, folder), ["a", "b"], [1, 2, 3, 4]), 4)


@query("gap_statistic")
def gap_statistic(spark, folder):
    return rounded(cluster.gap_statistic(suppliers(spark, folder), ["a", "b"], [1, 2, 3]), 4)


@query("silhouette", f"WITH {_S}, m AS (SELECT i, i % 3 AS c, j % 3 AS e, avg(d) AS m FROM p GROUP BY ALL), x AS (SELECT i, c, min(m) FILTER (c = e) AS a, min(m) FILTER (c <> e) AS b FROM m GROUP BY ALL) SELECT i AS s_suppkey, c AS g, round(a, 6) AS a, round(b, 6) AS b, round((b - a) / greatest(a, b), 6) + 0.0 AS silhouette FROM x")
def silhouette(spark, folder):
    rows = suppliers(spark, folder).withColumn("g", F.col("s_suppkey") % 3)
    return rounded(cluster.silhouette(rows, "s_suppkey", ["a", "b"], "g"))


@query("k_distances", f"WITH {_S}, n AS (SELECT i, avg(d) AS d FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d, j) AS r FROM p) WHERE r <= 4 GROUP BY i) SELECT i AS s_suppkey, round(d, 6) AS d FROM n")
def k_distances(spark, folder):
    return rounded(cluster.k_distances(suppliers(spark, folder), "s_suppkey", ["a", "b"], 5).drop("place"))


@query("dbscan_core_points", f"WITH {_S}, n AS (SELECT i, count(*) AS m FROM p WHERE d <= 4 GROUP BY i) SELECT k AS s_suppkey, coalesce(m, 0) + 1 AS n, coalesce(m, 0) + 1 >= 4 AS core FROM s LEFT JOIN n ON i = k")
def dbscan_core_points(spark, folder):
    return cluster.core_points(suppliers(spark, folder), "s_suppkey", ["a", "b"], 4.0, 4)


@query(
    "dbscan",
    f"""WITH RECURSIVE {_S}, e AS (SELECT * FROM p WHERE d <= 4), c AS (SELECT i FROM e GROUP BY i HAVING count(*) + 1 >= 4),
    l AS (SELECT i, j FROM e WHERE i IN (FROM c) AND j IN (FROM c)), reach AS (SELECT i, i AS j FROM c UNION SELECT r.i, l.j FROM reach r JOIN l ON l.i = r.j),
    lab AS (SELECT i, min(j) AS label FROM reach GROUP BY i),
    b AS (SELECT i, arg_min(label, (d, label)) AS label FROM (SELECT e.i, e.d, lab.label FROM e JOIN lab ON lab.i = e.j WHERE e.i NOT IN (FROM c)) GROUP BY i),
    f AS (SELECT * FROM lab UNION ALL SELECT * FROM b), n AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS c FROM (SELECT DISTINCT label FROM lab))
    SELECT k AS s_suppkey, CAST(coalesce(n.c, -1) AS INT) AS cluster FROM s LEFT JOIN f ON f.i = k LEFT JOIN n USING (label)""",
)
def dbscan(spark, folder):
    return cluster.dbscan(suppliers(spark, folder), "s_suppkey", ["a", "b"], 4.0, 4).select("s_suppkey", F.col("cluster").cast("int").alias("cluster"))


def _nations(spark, folder):
    return load(spark, folder, "customer").groupBy("c_nationkey").agg(F.avg("c_acctbal").alias("m"), F.count("*").cast("double").alias("n"))


for _linkage in ("single", "complete", "average", "ward"):

    def _agglomerate(spark, folder, linkage=_linkage):
        return rounded(cluster.agglomerate(_nations(spark, folder), "c_nationkey", ["m", "n"], linkage=linkage))

    query(f"agglomerative_{_linkage}")(_agglomerate)

_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("explained_variance", "SELECT unnest([1, 2]) AS component, round(unnest([(a + c) / 2 + sqrt((a - c) * (a - c) / 4 + b * b), (a + c) / 2 - sqrt((a - c) * (a - c) / 4 + b * b)]), 3) AS eigenvalue FROM (SELECT var_samp(x) AS a, var_samp(y) AS c, covar_samp(x, y) AS b FROM (SELECT l_quantity AS x, l_extendedprice / 1000 AS y FROM lineitem))")
def explained_variance(spark, folder):
    rows = load(spark, folder, "lineitem").select(F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"))
    return rounded(reduce.explained_variance(rows, ["x", "y"]).select("component", "eigenvalue"), 3)


def _projected(name, fit):
    @query(name)
    def run(spark, folder):
        rows = load(spark, folder, "lineitem").withColumn("l_extendedprice", F.col("l_extendedprice") / 1000)
        model = fit(rows)
        return rounded(model.transform(rows).select(*_KEY, *[c for c in model.transform(rows).columns if c not in rows.columns]), 4)


_projected("pca", lambda rows: reduce.fit_pca(rows, _NUM, 2))
_projected("svd", lambda rows: reduce.fit_svd(rows, _NUM, 2))
_projected("lda", lambda rows: reduce.fit_lda(rows, _NUM, "l_returnflag"))
_projected("factor_analysis", lambda rows: reduce.fit_factor_analysis(rows, _NUM, 2))


def _axes(matrix: str, centered: bool) -> str:
    """SQL of the two components of x and y by a matrix (m11, m12, m21, m22) and, if centered, means (mx, my)."""
    x, y = ("(x - mx)", "(y - my)") if centered else ("x", "y")
    half = "sqrt((m11 + m22) * (m11 + m22) / 4 - (m11 * m22 - m12 * m21))"
    return f"""WITH t AS (SELECT {', '.join(_KEY)}, l_returnflag, l_quantity AS x, l_extendedprice / 1000 AS y FROM lineitem), {matrix},
    v AS (SELECT *, m12 AS p, (m11 + m22) / 2 + {half} - m11 AS q, (m11 + m22) / 2 - {half} - m11 AS r FROM m),
    u AS (SELECT *, p / sqrt(p * p + q * q) AS a0, q / sqrt(p * p + q * q) AS b0, p / sqrt(p * p + r * r) AS a1, r / sqrt(p * p + r * r) AS b1 FROM v),
    w AS (SELECT *, CASE WHEN abs(a0) >= abs(b0) THEN sign(a0) ELSE sign(b0) END AS s0, CASE WHEN abs(a1) >= abs(b1) THEN sign(a1) ELSE sign(b1) END AS s1 FROM u)
    SELECT {', '.join(_KEY)}, round(s0 * (a0 * {x} + b0 * {y}), 4) + 0.0 AS c0, round(s1 * (a1 * {x} + b1 * {y}), 4) + 0.0 AS c1 FROM t, w"""


def _two(name, fit, matrix, centered):
    @query(f"{name}_two_columns", _axes(matrix, centered))
    def run(spark, folder):
        rows = load(spark, folder, "lineitem").select(*_KEY, "l_returnflag", F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"))
        out = fit(rows).transform(rows, "c")
        return rounded(out.select(*_KEY, "c0", "c1"), 4)


_two("pca", lambda rows: reduce.fit_pca(rows, ["x", "y"], 2), "m AS (SELECT avg(x) AS mx, avg(y) AS my, var_samp(x) AS m11, covar_samp(x, y) AS m12, covar_samp(x, y) AS m21, var_samp(y) AS m22 FROM t)", True)
_two("svd", lambda rows: reduce.fit_svd(rows, ["x", "y"], 2), "m AS (SELECT sum(x * x) AS m11, sum(x * y) AS m12, sum(x * y) AS m21, sum(y * y) AS m22 FROM t)", False)
_two(
    "lda",
    lambda rows: reduce.fit_lda(rows, ["x", "y"], "l_returnflag"),
    """g AS (SELECT count(*) AS n, avg(x) AS gx, avg(y) AS gy, var_pop(x) * count(*) AS sxx, covar_pop(x, y) * count(*) AS sxy, var_pop(y) * count(*) AS syy FROM t GROUP BY l_returnflag),
    o AS (SELECT avg(x) AS ox, avg(y) AS oy FROM t),
    h AS (SELECT sum(sxx) AS a, sum(sxy) AS b, sum(syy) AS c, sum(n * (gx - ox) * (gx - ox)) AS d, sum(n * (gx - ox) * (gy - oy)) AS e, sum(n * (gy - oy) * (gy - oy)) AS f FROM g, o),
    m AS (SELECT (c * d - b * e) / (a * c - b * b) AS m11, (c * e - b * f) / (a * c - b * b) AS m12, (a * e - b * d) / (a * c - b * b) AS m21, (a * f - b * e) / (a * c - b * b) AS m22 FROM h)""",
    False,
)


@query("kernel_pca")
def kernel_pca(spark, folder):
    rows = suppliers(spark, folder)
    return rounded(reduce.fit_low_rank_kernel_pca(rows, ["a", "b"], 2, "rbf", 0.001).transform(rows), 4)


@query("nnmf")
def nnmf(spark, folder):
    rows = load(spark, folder, "nation").join(_nations(spark, folder), F.col("n_nationkey") == F.col("c_nationkey")).select("n_nationkey", (F.abs("m") / 1000).alias("m"), (F.col("n") / 50).alias("n"))
    return rounded(reduce.fit_nnmf(rows, "n_nationkey", ["m", "n"], 2)[0], 4)


@query("tsne")
def tsne(spark, folder):
    return rounded(reduce.tsne(_nations(spark, folder).withColumn("m", F.col("m") / 1000), "c_nationkey", ["m", "n"], perplexity=5), 3)


_FEATURES = ["n_chars", "n_lines", "n_marks"]


def documents(spark, folder):
    """Documents with a quality label and three counts as features, numbered by id."""
    text = F.coalesce("text", F.lit(""))
    marks = F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]+", ""))
    rows = load(spark, folder, "documents").select("doc_id", F.length(text).cast("double").alias("n_chars"), F.size(F.split(text, "\n", -1)).cast("double").alias("n_lines"), marks.cast("double").alias("n_marks"))
    rows = rows.join(load(spark, folder, "labels").select("doc_id", F.col("quality").cast("double").alias("quality")), "doc_id")
    return with_row_id(materialize(rows, "labelled"), "doc_id")  # read for the bounds and the ranges, too


def evaluation(spark, folder, folds: bool = False, **options):
    from pyspark.ml.classification import DecisionTreeClassifier

    rows = materialize(documents(spark, folder), "evaluation")
    return select.Evaluation(rows, "quality", DecisionTreeClassifier(maxDepth=3, seed=1), "accuracy", splits.kfold(rows.select("row_id"), 2) if folds else None, **options)


def _names(spark, names):
    return spark.createDataFrame([(i, n) for i, n in enumerate(names)], "place int, feature string")


@query("cross_validation")
def cross_validation(spark, folder):
    return rounded(select.cross_validate(evaluation(spark, folder, folds=True), _FEATURES))


@query("select_forward")
def select_forward(spark, folder):
    return _names(spark, select.forward(evaluation(spark, folder), _FEATURES))


@query("select_backward")
def select_backward(spark, folder):
    return _names(spark, select.backward(evaluation(spark, folder), _FEATURES))


@query("select_exhaustive")
def select_exhaustive(spark, folder):
    return _names(spark, select.exhaustive(evaluation(spark, folder), _FEATURES))


@query("select_leave_one_out")
def select_leave_one_out(spark, folder):
    return rounded(select.leave_one_feature_out(evaluation(spark, folder), _FEATURES))


@query("select_perturbation")
def select_perturbation(spark, folder):
    return rounded(select.perturbation(evaluation(spark, folder), _FEATURES))


@query("select_boruta")
def select_boruta(spark, folder):
    return select.boruta(evaluation(spark, folder), _FEATURES)


@query("select_rfe_information")
def select_rfe_information(spark, folder):
    from granary.operators import information

    e = evaluation(spark, folder)
    known = {f: information.continuous_discrete(e.rows, f, "quality").first()[0] for f in _FEATURES}
    return _names(spark, select.rfe_mutual_information(e, _FEATURES, known))


@query("random_search")
def random_search(spark, folder):
    space = {"maxDepth": ("int", (1, 4)), "minInfoGain": ("float", (0.0, 0.05)), "impurity": ("categorical", ["gini", "entropy"])}
    return rounded(select.random_search(evaluation(spark, folder), _FEATURES, space))


_B = [0.5, -2.0]


@query("components_curve")
def components_curve(spark, folder):
    return rounded(select.components_curve(evaluation(spark, folder), _FEATURES, [1, 2, 3]))


@query("shap_linear", f"WITH m AS (SELECT avg(l_quantity) AS a, avg(l_discount) AS b FROM lineitem) SELECT {', '.join(_KEY)}, round({_B[0]} * (l_quantity - a), 6) + 0.0 AS shap_l_quantity, round({_B[1]} * (l_discount - b), 6) + 0.0 AS shap_l_discount FROM lineitem, m")
def shap_linear(spark, folder):
    return rounded(explain.linear_shap(load(spark, folder, "lineitem"), ["l_quantity", "l_discount"], _B).select(*_KEY, "shap_l_quantity", "shap_l_discount"))


@query("shap_tree")
def shap_tree(spark, folder):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import DecisionTreeRegressor

    rows = documents(spark, folder)
    model = DecisionTreeRegressor(featuresCol="f", labelCol="quality", maxDepth=3, seed=1).fit(VectorAssembler(inputCols=_FEATURES, outputCol="f").transform(rows))
    out = explain.tree_shap(rows.select("doc_id", *_FEATURES), _FEATURES, explain.tree_nodes(model))
    return rounded(out.select("doc_id", *[f"shap_{f}" for f in _FEATURES]))


@query("input_gradients", f"SELECT {', '.join(_KEY)}, round(2 * (l_quantity - l_tax) / n * 0.5 * 1e6, 6) + 0.0 AS grad_l_quantity FROM lineitem, (SELECT count(*) AS n FROM lineitem)")
def input_gradients(spark, folder):
    out = explain.input_gradients(load(spark, folder, "lineitem"), ["l_quantity"], [0.5], "l_tax", "l_quantity")
    return rounded(out.select(*_KEY, (F.col("grad_l_quantity") * 1e6).alias("grad_l_quantity")))


def _generated(m: int, y: str) -> str:
    return "SELECT id, " + ", ".join(f"round(x{i}, 6) + 0.0 AS x{i}" for i in range(m)) + f", {y} AS y"


@query(
    "generator_planted_pair",
    "WITH g AS (SELECT id, " + ", ".join(f"{share_sql('id', 17, i)} * 10 AS x{i}" for i in range(10)) + " FROM (SELECT range AS id FROM range(1000))), m AS (SELECT median(x3 * x8) AS m FROM g) " + _generated(10, "CASE WHEN x3 * x8 < m THEN 0 ELSE 1 END") + " FROM g, m",
)
def generator_planted_pair(spark, folder):
    return rounded(generators.planted_pair(spark))


def _normal(n: int, m: int) -> str:
    return "WITH g AS (SELECT id, " + ", ".join(f"{gaussian_sql('id', 17, i)} AS x{i}" for i in range(m)) + f" FROM (SELECT range AS id FROM range({n}))) "


@query("generator_planted_linear", _normal(1000, 5) + _generated(5, "round(x0 + 2 * x2, 6) + 0.0") + " FROM g")
def generator_planted_linear(spark, folder):
    return rounded(generators.planted_linear(spark))


@query("generator_blobs", _normal(1000, 2) + "SELECT id, round((id % 2) * 5 + 0.5::DOUBLE * x0, 6) + 0.0 AS x, round((id % 2) * 5 + 0.5::DOUBLE * x1, 6) + 0.0 AS y, CAST(id % 2 AS INT) AS blob FROM g")
def generator_blobs(spark, folder):
    return rounded(generators.blobs(spark, centers=[(0.0, 0.0), (5.0, 5.0)]))


_RINGS = [
    f"""SELECT id + {k * 1_000_000} AS id, round(cos(id * (6.283185307179586::DOUBLE / {n})) * {r} + {gaussian_sql('id', 17, k, 1)} * 30, 6) + 0.0 AS x,
    round(sin(id * (6.283185307179586::DOUBLE / {n})) * {r} + {gaussian_sql('id', 17, k, 2)} * 30, 6) + 0.0 AS y, {k} AS ring FROM (SELECT range AS id FROM range({n}))"""
    for k, (r, n) in enumerate(((500, 1000), (300, 700), (100, 300)))
]
_REST = f"SELECT id + 1000000000 AS id, round({share_sql('id', 17, 8)} * 1200 - 600, 6) AS x, round({share_sql('id', 17, 9)} * 1200 - 600, 6) AS y, -1 AS ring FROM (SELECT range AS id FROM range(300))"


@query("generator_rings", " UNION ALL ".join([*_RINGS, _REST]))
def generator_rings(spark, folder):
    return rounded(generators.rings(spark))


@query("generator_informative", _normal(1000, 10) + _generated(10, "CASE WHEN x0 + x1 * 2 + x2 * 3 + x3 > 0 THEN 1 ELSE 0 END") + " FROM g")
def generator_informative(spark, folder):
    return rounded(generators.informative(spark, 1000, 10, 4))


_CURVE = "c AS (SELECT a.p_size AS k, count(*) AS sse FROM (SELECT DISTINCT p_size FROM part) a JOIN part b ON b.p_size >= a.p_size GROUP BY 1)"
_SCALED = "z AS (SELECT *, (k - min(k) OVER ()) / (max(k) OVER () - min(k) OVER ())::DOUBLE AS x, (sse - min(sse) OVER ()) / (max(sse) OVER () - min(sse) OVER ())::DOUBLE AS y FROM c)"


def curve(spark, folder):
    """A falling curve: parts of a size or more, by size."""
    sizes = load(spark, folder, "part").groupBy("p_size").agg(F.count("*").alias("n"))
    return sizes.select(F.col("p_size").alias("k"), F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy(F.desc("p_size"))).alias("sse"))  # a row per size


@query(
    "elbow_normalized",
    f"""WITH {_CURVE}, {_SCALED} SELECT k, sse, round(x, 6) AS x, round(y, 6) AS y, round((x - y + 1) / 2, 6) AS foot_x, round((y - x + 1) / 2, 6) AS foot_y,
    round(abs(x + y - 1) / sqrt(2), 6) AS distance, round(1 - x, 6) + 0.0 AS diagonal, round(1 - x - y, 6) + 0.0 AS difference FROM z""",
)
def elbow_normalized(spark, folder):
    return rounded(metrics.normalized_curve(curve(spark, folder), "k", "sse"))


@query("elbow", f"WITH {_CURVE} SELECT min(k) AS k FROM (SELECT k, lag(sse) OVER w - lead(sse) OVER w AS fall, sum(sse) OVER () AS total FROM c WINDOW w AS (ORDER BY k)) WHERE fall < 0.05 * total")
def elbow(spark, folder):
    return metrics.elbow(curve(spark, folder), "k", "sse")


@query("difference_curve", f"WITH {_CURVE}, {_SCALED} SELECT arg_max(k, (round(1 - x - y, 12), -k)) AS k, round(max(1 - x - y), 6) AS gap FROM z")
def difference_curve(spark, folder):
    return rounded(metrics.knee(curve(spark, folder), "k", "sse"))


@query("cumulative_share", "SELECT c_nationkey, n, round(sum(n) OVER (ORDER BY c_nationkey) / sum(n) OVER (), 6) AS share FROM (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1)")
def cumulative_share(spark, folder):
    counts = load(spark, folder, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"))
    return rounded(metrics.cumulative_share(counts, "c_nationkey", "n"))


_NEAREST = f"WITH {_S}, n AS (SELECT i, avg(d) AS d FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d, j) AS r FROM p) WHERE r <= 4 GROUP BY i), o AS (SELECT i, d, row_number() OVER (ORDER BY d DESC, i) - 1 AS place, count(*) OVER () AS m FROM n), z AS (SELECT i, d, place / (m - 1)::DOUBLE AS x, (d - min(d) OVER ()) / (max(d) OVER () - min(d) OVER ()) AS y FROM o)"


@query("k_distances_normalized", _NEAREST + " SELECT round(x, 6) AS x, round(y, 6) AS y, round(1 - x - y, 6) + 0.0 AS difference FROM z")
def k_distances_normalized(spark, folder):
    near = cluster.k_distances(suppliers(spark, folder), "s_suppkey", ["a", "b"], 5)
    return rounded(metrics.normalized_curve(near, "place", "d").select("x", "y", "difference"))


@query("difference_curve_epsilon", _NEAREST + " SELECT round(arg_max(d, (1 - x - y, -x)), 6) AS epsilon FROM z")
def difference_curve_epsilon(spark, folder):
    return rounded(cluster.best_epsilon(suppliers(spark, folder), "s_suppkey", ["a", "b"], 5))


@query("silhouette_by_k", " UNION ALL ".join(f"SELECT {k} AS k, round(avg((b - a) / greatest(a, b)), 6) AS silhouette FROM (SELECT i, min(m) FILTER (c = e) AS a, min(m) FILTER (c <> e) AS b FROM (SELECT i, i % {k} AS c, j % {k} AS e, avg(d) AS m FROM p GROUP BY ALL) GROUP BY i)" for k in (2, 3, 4)).replace("SELECT 2 AS k", f"WITH {_S} SELECT 2 AS k", 1))
def silhouette_by_k(spark, folder):
    rows = suppliers(spark, folder).withColumns({f"g{k}": F.col("s_suppkey") % k for k in (2, 3, 4)})
    return rounded(cluster.silhouette_by_k(rows, "s_suppkey", ["a", "b"], {k: f"g{k}" for k in (2, 3, 4)}))


@query("dendrogram_leaves")
def dendrogram_leaves(spark, folder):
    return cluster.leaf_counts(cluster.agglomerate(_nations(spark, folder), "c_nationkey", ["m", "n"]))


@query("select_rfe")
def select_rfe(spark, folder):
    return _names(spark, select.rfe(evaluation(spark, folder), _FEATURES, 2))


@query("select_rfecv")
def select_rfecv(spark, folder):
    return _names(spark, select.rfecv(evaluation(spark, folder, folds=True), _FEATURES))


@query("select_benchmark")
def select_benchmark(spark, folder):
    e = evaluation(spark, folder)
    ways = {"forward": lambda: select.forward(e, _FEATURES), "rfe": lambda: select.rfe(e, _FEATURES, 2)}
    return rounded(select.benchmark(e, ways, ["n_chars", "n_marks"], _FEATURES).drop("seconds"))
