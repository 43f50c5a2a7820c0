"""Queries of statistical tests, association measures and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.operators import information, metrics, stats
from granary.plans.registry import load, query, rounded

_CELLS = """WITH c AS (SELECT l_returnflag AS x, l_linestatus AS y, count(*) AS o FROM lineitem GROUP BY ALL),
r AS (SELECT x, sum(o) AS rx FROM c GROUP BY x), k AS (SELECT y, sum(o) AS cy FROM c GROUP BY y), t AS (SELECT sum(o) AS n FROM c),
g AS (SELECT x, y, rx * cy / n AS e, coalesce(o, 0) AS o, n FROM r CROSS JOIN k CROSS JOIN t LEFT JOIN c USING (x, y)),
s AS (SELECT sum((o - e) * (o - e) / e) AS chi2, any_value(n) AS n, count(DISTINCT x) AS a, count(DISTINCT y) AS b, avg((e > 5)::INT) AS share FROM g) """


@query("crosstab_margins", "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(grouping(l_returnflag, l_linestatus) AS INT) AS margin FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def crosstab_margins(spark, folder):
    return stats.crosstab(load(spark, folder, "lineitem"), "l_returnflag", "l_linestatus")


@query("chi_square", _CELLS + "SELECT round(chi2, 4) AS test_statistic, round(exp(-chi2 / 2), 6) AS p_value, round(-2 * ln(0.05), 6) AS critical_value, exp(-chi2 / 2) >= 0.05 AS keep_h0, (a - 1) * (b - 1) AS df, round(sqrt(chi2 / (n * least(a - 1, b - 1))), 6) AS cramers_v, share >= 0.8 AS assumption FROM s")
def chi_square(spark, folder):
    return rounded(stats.chi_square(load(spark, folder, "lineitem"), "l_returnflag", "l_linestatus"), test_statistic=4)


def _f(groups: str, tail: str) -> str:
    return f"""WITH {groups}, t AS (SELECT sum(n) AS n, sum(n * m) / sum(n) AS m, count(*) AS c FROM g),
    s AS (SELECT sum(g.n * (g.m - t.m) * (g.m - t.m)) AS ssb, sum(ss) AS sse, any_value(t.n) AS n, any_value(t.c) AS c FROM g, t),
    f AS (SELECT (ssb / (c - 1)) / (sse / (n - c)) AS f, c - 1 AS df1, n - c AS df2, ssb, sse FROM s) {tail}"""


#: The tail of F with two numerator degrees has a closed form.
_F2 = "SELECT round(f, 6) AS test_statistic, round(pow(1 + 2 * f / df2, -df2 / 2.0), 6) AS p_value, pow(1 + 2 * f / df2, -df2 / 2.0) >= 0.05 AS keep_h0, CAST(df1 AS BIGINT) AS df1, CAST(df2 AS BIGINT) AS df2, round((pow(0.05, -2.0 / df2) - 1) * df2 / 2, 6) AS critical_value FROM f"
_BY = "SELECT {x} AS x, count(*) AS n, avg({y}) AS m, var_pop({y}) * count(*) AS ss FROM {t} GROUP BY 1"


@query("anova", _f("g AS (" + _BY.format(x="l_returnflag", y="l_extendedprice", t="lineitem") + ")", _F2))
def anova(spark, folder):
    return rounded(stats.anova(load(spark, folder, "lineitem"), "l_returnflag", "l_extendedprice"))


@query("anova_groups", "SELECT o_orderpriority AS \"group\", count(*) AS n, round(avg(o_totalprice), 4) AS mean FROM orders GROUP BY 1")
def anova_groups(spark, folder):
    return rounded(stats.group_summary(load(spark, folder, "orders"), "o_orderpriority", "o_totalprice").drop("ss"), 4)


def _levene(center: str, sql: str):
    z = f"c AS (SELECT l_returnflag AS x, {sql}(l_extendedprice) AS c FROM lineitem GROUP BY 1), z AS (SELECT l_returnflag, abs(l_extendedprice - c) AS z FROM lineitem JOIN c ON x = l_returnflag), g AS (" + _BY.format(x="l_returnflag", y="z", t="z") + ")"

    @query(f"levene_{center}", _f(z, _F2))
    def run(spark, folder):
        return rounded(stats.levene(load(spark, folder, "lineitem"), "l_returnflag", "l_extendedprice", center=center))


_levene("mean", "avg")
_levene("median", "median")
_RANKED = "SELECT {k}, rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS r FROM {t}"


@query(
    "kruskal_wallis",
    _f("z AS (" + _RANKED.format(k="l_returnflag", c="l_quantity", t="lineitem") + "), g AS (" + _BY.format(x="l_returnflag", y="r", t="z") + ")", "SELECT round(h, 6) AS test_statistic, round(pow(1 + 2 * h / df2, -df2 / 2.0), 6) AS p_value, round((pow(0.05, -2.0 / df2) - 1) * df2 / 2, 6) AS critical_value, pow(1 + 2 * h / df2, -df2 / 2.0) >= 0.05 AS keep_h0, round(exp(-h / 2), 6) AS p_value_chi2 FROM (SELECT (df1 + df2) * ssb / (ssb + sse) AS h, df2 FROM f)"),
)
def kruskal_wallis(spark, folder):
    return rounded(stats.kruskal_wallis(load(spark, folder, "lineitem"), "l_returnflag", "l_quantity"))


@query("jarque_bera", "WITH m AS (SELECT avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS s, count(*) AS n FROM orders), k AS (SELECT any_value(n) AS n, sum(pow((o_totalprice - m) / s, 3)) / (any_value(n) - 1) AS a, sum(pow((o_totalprice - m) / s, 4)) / (any_value(n) - 1) AS b FROM orders, m), j AS (SELECT n / 6 * (a * a + (b - 3) * (b - 3) / 4) AS jb FROM k) SELECT round(jb, 4) AS test_statistic, round(exp(-jb / 2), 6) AS p_value, round(-2 * ln(0.05), 6) AS critical_value, exp(-jb / 2) >= 0.05 AS keep_h0 FROM j")
def jarque_bera(spark, folder):
    return rounded(stats.jarque_bera(load(spark, folder, "orders"), "o_totalprice"), test_statistic=4)


_R = "SELECT round(r, 6) AS correlation, round(r * n / (n - 1), 6) AS correlation_ref, round(q * sqrt(n - 2) / sqrt(1 - q * q), 4) AS test_statistic FROM (SELECT r, n, r * n / (n - 1) AS q FROM (SELECT corr({x}, {y}) AS r, count(*) AS n FROM {t}))"


@query("pearson", _R.format(x="l_quantity", y="l_extendedprice", t="lineitem"))
def pearson(spark, folder):
    return rounded(stats.pearson(load(spark, folder, "lineitem"), "l_quantity", "l_extendedprice").select("correlation", "correlation_ref", "test_statistic"), test_statistic=4)


@query("spearman", _R.format(x="a", y="b", t="(SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS a, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0 AS b FROM lineitem)"))
def spearman(spark, folder):
    return rounded(stats.spearman(load(spark, folder, "lineitem"), "l_quantity", "l_extendedprice").select("correlation", "correlation_ref", "test_statistic"), test_statistic=4)


@query("correlation_p_values")
def correlation_p_values(spark, folder):
    return rounded(stats.pearson(load(spark, folder, "lineitem"), "l_discount", "l_tax"))


_H = "(CASE WHEN {0}.{2} > {1}.{2} THEN 1.0 WHEN {0}.{2} = {1}.{2} THEN 0.5 ELSE 0.0 END)"


def _hoeffding(name: str, table: str, key: str, x: str, y: str):
    sql = f"""WITH s AS (SELECT {key} AS k, {x} AS x, {y} AS y FROM {table}),
    q AS (SELECT a.k, 0.75 + sum({_H.format('a', 'b', 'x')} * {_H.format('a', 'b', 'y')}) AS q, 0.5 + sum({_H.format('a', 'b', 'x')}) AS r, 0.5 + sum({_H.format('a', 'b', 'y')}) AS s FROM s a, s b GROUP BY a.k),
    d AS (SELECT count(*)::DOUBLE AS n, sum((q - 1) * (q - 2)) AS d1, sum((r - 1) * (r - 2) * (s - 1) * (s - 2)) AS d2, sum((r - 2) * (s - 2) * (q - 1)) AS d3 FROM q),
    h AS (SELECT n, 30 * ((n - 2) * (n - 3) * d1 + d2 - 2 * (n - 2) * d3) / (n * (n - 1) * (n - 2) * (n - 3) * (n - 4)) AS h FROM d)
    SELECT round(h, 6) + 0.0 AS hoeffding_d, round((n - 1) * pow(pi(), 4) * h / 60 + pow(pi(), 4) / 72, 6) AS test_statistic, round(sqrt(2 * (n * n + 5 * n - 32) / (9 * n * (n - 1) * (n - 3) * (n - 4) * 0.05)), 6) AS bound FROM h"""

    @query(name, sql)
    def run(spark, folder):
        return rounded(stats.hoeffding(load(spark, folder, table), key, x, y))


_hoeffding("hoeffding", "supplier", "s_suppkey", "s_acctbal", "s_nationkey")
_hoeffding("hoeffding_orders", "orders", "o_orderkey", "o_totalprice", "o_custkey")


@query("vif", "WITH r AS (SELECT corr(l_quantity, l_extendedprice) AS r FROM lineitem) SELECT unnest(['l_quantity', 'l_extendedprice']) AS feature, round(1 / (1 - r * r), 6) AS vif FROM r")
def vif(spark, folder):
    return rounded(stats.vif(load(spark, folder, "lineitem"), ["l_quantity", "l_extendedprice"]))


@query("bartlett_sphericity", "WITH r AS (SELECT corr(l_quantity, l_extendedprice) AS r, count(*) AS n FROM lineitem) SELECT round(-(n - 1 + 1 / 6.0) * ln((1 + 1e-8) * (1 + 1e-8) - r * r), 2) AS test_statistic, 1 AS df FROM r")
def bartlett_sphericity(spark, folder):
    return rounded(stats.bartlett_sphericity(load(spark, folder, "lineitem"), ["l_quantity", "l_extendedprice"]).select("test_statistic", F.col("df").cast("int").alias("df")), 2)


@query(
    "kaiser_meyer_olkin",
    """WITH k AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS a, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0 AS b,
      rank() OVER (ORDER BY l_discount) + (count(*) OVER (PARTITION BY l_discount) - 1) / 2.0 AS c FROM lineitem),
    r AS (SELECT corr(a, b) AS ab, corr(a, c) AS ac, corr(b, c) AS bc FROM k),
    p AS (SELECT *, (ab - ac * bc) / sqrt((1 - ac * ac) * (1 - bc * bc)) AS pab, (ac - ab * bc) / sqrt((1 - ab * ab) * (1 - bc * bc)) AS pac, (bc - ab * ac) / sqrt((1 - ab * ab) * (1 - ac * ac)) AS pbc FROM r)
    SELECT round((ab * ab + ac * ac + bc * bc) / (ab * ab + ac * ac + bc * bc + pab * pab + pac * pac + pbc * pbc), 6) AS kmo FROM p""",
)
def kaiser_meyer_olkin(spark, folder):
    return rounded(stats.kaiser_meyer_olkin(load(spark, folder, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"]))


@query("correlation_pairs", "SELECT unnest([{'a': 'l_extendedprice', 'b': 'l_quantity', 'r': round(corr(l_extendedprice, l_quantity), 3)}, {'a': 'l_tax', 'b': 'l_quantity', 'r': round(corr(l_tax, l_quantity), 3)}, {'a': 'l_tax', 'b': 'l_extendedprice', 'r': round(corr(l_tax, l_extendedprice), 3)}], recursive := true) FROM lineitem")
def correlation_pairs(spark, folder):
    return rounded(metrics.correlation_pairs(load(spark, folder, "lineitem"), ["l_quantity", "l_extendedprice", "l_tax"]))


@query(
    "correlation_selection",
    """WITH x AS (SELECT l_quantity AS a, l_quantity + 20 * l_discount AS b, l_quantity + 40 * l_tax + l_discount AS c, l_extendedprice AS y FROM lineitem),
    r AS (SELECT corr(a, b) AS ba, corr(a, c) AS ca, corr(b, c) AS cb, abs(corr(a, y)) AS ay, abs(corr(b, y)) AS byy, abs(corr(c, y)) AS cy FROM x),
    g AS (SELECT *, CASE WHEN abs(ba) > 0.9 THEN CASE WHEN ay < byy THEN 'a' ELSE 'b' END ELSE '' END AS g1 FROM r),
    h AS (SELECT *, CASE WHEN abs(ca) > 0.9 AND g1 <> 'a' THEN CASE WHEN ay < cy THEN 'a' ELSE 'c' END ELSE '' END AS g2 FROM g),
    i AS (SELECT g1, g2, CASE WHEN abs(cb) > 0.9 AND g2 <> 'c' AND 'b' NOT IN (g1, g2) THEN CASE WHEN byy < cy THEN 'b' ELSE 'c' END ELSE '' END AS g3 FROM h)
    SELECT f AS feature, f NOT IN (g1, g2, g3) AS kept FROM i, (SELECT unnest(['a', 'b', 'c']) AS f)""",
)
def correlation_selection(spark, folder):
    q = F.col("l_quantity")
    made = [q.alias("a"), (q + 20 * F.col("l_discount")).alias("b"), (q + 40 * F.col("l_tax") + F.col("l_discount")).alias("c"), F.col("l_extendedprice").alias("y")]
    return stats.correlation_selection(load(spark, folder, "lineitem").select(*made), ["a", "b", "c"], "y", 0.9)


@query(
    "variance_threshold",
    " UNION ALL ".join(f"SELECT '{c}' AS feature FROM lineitem HAVING var_pop({c}) > 0.0007" for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")),
)
def variance_threshold(spark, folder):
    kept = stats.variance_threshold(load(spark, folder, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], 0.0007)
    return spark.createDataFrame([(c,) for c in kept], "feature string")


@query(
    "g_test",
    """WITH c AS (SELECT o_orderstatus AS x, o_orderpriority AS y, count(*) AS n FROM orders GROUP BY ALL), m AS (SELECT *, sum(n) OVER (PARTITION BY x) AS nx, sum(n) OVER (PARTITION BY y) AS ny, sum(n) OVER () AS t FROM c)
    SELECT round(2 * sum(n * ln(n * t / (nx * ny))), 4) AS g, round(sum(n * ln(n * t / (nx * ny))) / any_value(t), 8) AS mutual_information FROM m""",
)
def g_test(spark, folder):
    return rounded(information.g_test(load(spark, folder, "orders"), "o_orderstatus", "o_orderpriority"), 8, g=4)


@query(
    "information_prepared",
    "WITH s AS (SELECT stddev_pop(c_acctbal) AS a, stddev_pop(c_nationkey) AS b FROM customer) SELECT c_custkey, round(c_acctbal / a, 6) AS c_acctbal, round(c_nationkey / b, 6) AS c_nationkey FROM customer, s",
)
def information_prepared(spark, folder):
    rows = load(spark, folder, "customer").select("c_custkey", "c_acctbal", F.col("c_nationkey").cast("double").alias("c_nationkey"))
    return rounded(information.prepared(rows, ["c_acctbal", "c_nationkey"], "c_custkey"))


@query("mutual_information_discrete", "WITH c AS (SELECT l_returnflag AS x, l_linestatus AS y, count(*) AS n FROM lineitem GROUP BY ALL), m AS (SELECT *, sum(n) OVER (PARTITION BY x) AS nx, sum(n) OVER (PARTITION BY y) AS ny, sum(n) OVER () AS t FROM c) SELECT round(sum(n / t * ln(n * t / (nx * ny))), 6) + 0.0 AS mutual_information FROM m")
def mutual_information_discrete(spark, folder):
    return rounded(information.of_counts(load(spark, folder, "lineitem"), "l_returnflag", "l_linestatus"))


@query("entropy", "SELECT round(-sum(p * log2(p)), 6) AS entropy FROM (SELECT count(*) / sum(count(*)) OVER () AS p FROM orders GROUP BY o_orderpriority, o_orderstatus)")
def entropy(spark, folder):
    return rounded(information.entropy(load(spark, folder, "orders"), "o_orderpriority", "o_orderstatus"))


def _mi(a: str, b: str) -> str:
    cell = "least(floor(({c} - (SELECT min({c}) FROM lineitem)) / ((SELECT max({c}) - min({c}) FROM lineitem) / 5)), 4)"
    h = lambda *k: f"(SELECT -sum(p * log2(p)) FROM (SELECT sum(n) / (SELECT sum(n) FROM z) AS p FROM z GROUP BY {', '.join(k)}))"
    return f"SELECT '{a}' AS a, '{b}' AS b, round({h('x')} + {h('y')} - {h('x', 'y')}, 6) + 0.0 AS mutual_information FROM (SELECT 1) WHERE 1 = 1".replace("FROM z", f"FROM (SELECT {cell.format(c=a)} AS x, {cell.format(c=b)} AS y, count(*) AS n FROM lineitem GROUP BY ALL) z")


_PAIRS = [("l_quantity", "l_quantity"), ("l_quantity", "l_extendedprice"), ("l_extendedprice", "l_extendedprice")]


@query("mutual_information_histogram", " UNION ALL ".join(_mi(a, b) for a, b in _PAIRS))
def mutual_information_histogram(spark, folder):
    return rounded(information.histogram_matrix(load(spark, folder, "lineitem"), ["l_quantity", "l_extendedprice"], 5))


_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount"]
_NORM_PAIRS = [(a, b) for i, a in enumerate(_COLUMNS) for b in _COLUMNS[i:]]
_BINNED = "least(floor(({c} - (SELECT min({c}) FROM lineitem)) / ((SELECT max({c}) - min({c}) FROM lineitem) / 5)), 4)"
_CELLS = ", ".join(f"z{i} AS (SELECT {_BINNED.format(c=a)} AS x, {_BINNED.format(c=b)} AS y, count(*) AS n FROM lineitem GROUP BY ALL)" for i, (a, b) in enumerate(_NORM_PAIRS))
_PSI = "dg AS (SELECT i + 1 AS n, -0.57721566490153286::DOUBLE + sum(CASE WHEN i = 0 THEN 0 ELSE 1.0::DOUBLE / i END) OVER (ORDER BY i) AS psi FROM range(200000) t(i))"


def _ross(table: str, x: str, y: str) -> str:
    """SQL of Ross's estimate with three neighbours, as a table ``ross``."""
    return f"""{_PSI}, v AS (SELECT row_number() OVER () AS i, {x} AS x, {y} AS y, count(*) OVER (PARTITION BY {y}) AS ny FROM {table}), u AS (SELECT * FROM v WHERE ny > 1),
    k AS (SELECT a.i, abs(a.x - b.x) AS d, row_number() OVER (PARTITION BY a.i ORDER BY abs(a.x - b.x)) AS nth, least(3, a.ny - 1) AS k FROM u a JOIN u b ON a.y = b.y AND a.i <> b.i),
    e AS (SELECT i, d, k FROM k WHERE nth = k), w AS (SELECT a.i, any_value(e.k) AS k, any_value(a.ny) AS ny, greatest(count(*) FILTER (abs(a.x - b.x) < e.d), 1) AS m FROM u a JOIN e ON e.i = a.i CROSS JOIN u b GROUP BY a.i),
    ross AS (SELECT greatest(0, (SELECT psi FROM dg WHERE n = (SELECT count(*) FROM u)) + avg(p.psi - q.psi - s.psi)) AS mi FROM w JOIN dg p ON p.n = w.k JOIN dg q ON q.n = w.ny JOIN dg s ON s.n = w.m)"""


_NORM = " UNION ALL ".join(
    f"""SELECT '{a}' AS a, '{b}' AS b, round((hx + hy - hxy) / sqrt(hx * hy), 6) + 0.0 AS mutual_information FROM (SELECT {', '.join(f"(SELECT -sum(p * log2(p)) FROM (SELECT sum(n) / (SELECT sum(n) FROM z{i}) AS p FROM z{i} GROUP BY {k})) AS h{k.replace(', ', '')}" for k in ('x', 'y', 'x, y'))})"""
    for i, (a, b) in enumerate(_NORM_PAIRS)
)


@query("mutual_information_normalized", f"WITH {_CELLS} {_NORM}")
def mutual_information_normalized(spark, folder):
    return rounded(information.histogram_matrix(load(spark, folder, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"], 5, normalized=True))


@query("mutual_information_ross", f"WITH {_ross('customer', 'c_acctbal', 'c_mktsegment')} SELECT round(mi, 6) + 0.0 AS mutual_information FROM ross")
def mutual_information_ross(spark, folder):
    return rounded(information.continuous_discrete(load(spark, folder, "customer"), "c_acctbal", "c_mktsegment"))


@query(
    "mutual_information_ksg",
    f"""WITH {_PSI}, s AS (SELECT s_suppkey AS i, s_acctbal AS x, s_acctbal * 2 + s_nationkey AS y FROM supplier),
    p AS (SELECT a.i, abs(a.x - b.x) AS dx, abs(a.y - b.y) AS dy FROM s a JOIN s b ON a.i <> b.i),
    e AS (SELECT i, d FROM (SELECT i, greatest(dx, dy) AS d, row_number() OVER (PARTITION BY i ORDER BY greatest(dx, dy)) AS r FROM p) WHERE r = 3),
    c AS (SELECT p.i, count(*) FILTER (dx < d) + 1 AS nx, count(*) FILTER (dy < d) + 1 AS ny FROM p JOIN e ON e.i = p.i GROUP BY p.i)
    SELECT round(greatest(0, (SELECT psi FROM dg WHERE n = (SELECT count(*) FROM s)) + (SELECT psi FROM dg WHERE n = 3) - avg(a.psi + b.psi)), 6) + 0.0 AS mutual_information FROM c JOIN dg a ON a.n = c.nx JOIN dg b ON b.n = c.ny""",
)
def mutual_information_ksg(spark, folder):
    return rounded(information.continuous_continuous(load(spark, folder, "supplier").withColumn("z", F.col("s_acctbal") * 2 + F.col("s_nationkey")), "s_suppkey", "s_acctbal", "z"))


@query(
    "stationarity",
    """WITH e AS (SELECT value - lag(value) OVER w AS y, lag(value) OVER w AS a, lag(value) OVER w - lag(value, 2) OVER w AS b FROM events WINDOW w AS (ORDER BY event_id)),
    s AS (SELECT count(*) AS n, var_pop(a) * count(*) AS saa, var_pop(b) * count(*) AS sbb, covar_pop(a, b) * count(*) AS sab, covar_pop(a, y) * count(*) AS say, covar_pop(b, y) * count(*) AS sby, var_pop(y) * count(*) AS syy FROM e WHERE b IS NOT NULL),
    r AS (SELECT *, saa * sbb - sab * sab AS det FROM s), c AS (SELECT *, (sbb * say - sab * sby) / det AS p, (saa * sby - sab * say) / det AS q FROM r)
    SELECT round(p / sqrt((syy - p * say - q * sby) / (n - 3) * sbb / det), 4) AS adf_statistic, p / sqrt((syy - p * say - q * sby) / (n - 3) * sbb / det) < -2.86 AS stationary, n FROM c""",
)
def stationarity(spark, folder):
    return rounded(stats.adf(load(spark, folder, "events"), "event_id", "value").drop("p_value"), 4)


_PRED = "SELECT l_extendedprice AS y, l_quantity * 2000 AS p FROM lineitem"


@query("regression_metrics", f"SELECT round(avg((y - p) * (y - p)), 2) AS mse, round(sqrt(avg((y - p) * (y - p))), 4) AS rmse, round(avg(abs(y - p)), 4) AS mae, round(avg(abs((y - p) / y)), 6) AS mape, round(median(abs(y - p)), 4) AS medae, round(avg(pow(ln(abs(1 + y)) - ln(abs(1 + p)), 2)), 6) AS msle FROM ({_PRED})")
def regression_metrics(spark, folder):
    rows = load(spark, folder, "lineitem").select(F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 2000).alias("p"))
    return rounded(metrics.regression_metrics(rows, "y", "p"), mse=2, rmse=4, mae=4, medae=4)


def labelled(spark, folder):
    return load(spark, folder, "labels").join(load(spark, folder, "documents").select("doc_id", "n_chars"), "doc_id")


@query("roc_auc", "WITH r AS (SELECT quality, rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2.0 AS r FROM labels JOIN documents USING (doc_id)) SELECT round((sum(r) FILTER (quality = 1) - count(*) FILTER (quality = 1) * (count(*) FILTER (quality = 1) + 1) / 2.0) / (count(*) FILTER (quality = 1) * count(*) FILTER (quality = 0)), 6) AS roc_auc FROM r")
def roc_auc(spark, folder):
    return rounded(metrics.roc_auc(labelled(spark, folder), "quality", "n_chars"))


_GUESS = "SELECT quality AS y, (n_chars > 1000)::INT AS p FROM labels JOIN documents USING (doc_id)"


def guesses(spark, folder):
    return labelled(spark, folder).select(F.col("quality").alias("y"), (F.col("n_chars") > 1000).cast("int").alias("p"))


@query("accuracy", f"SELECT round(avg((y = p)::INT), 6) AS accuracy FROM ({_GUESS})")
def accuracy(spark, folder):
    return rounded(metrics.accuracy(guesses(spark, folder), "y", "p"))


@query("confusion_matrix", f"SELECT y AS actual, p AS predicted, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY y), 6) AS share FROM ({_GUESS}) t GROUP BY y, p")
def confusion_matrix(spark, folder):
    return rounded(metrics.confusion_matrix(guesses(spark, folder), "y", "p"))


@query("multilabel_confusion", f"WITH g AS ({_GUESS}), l AS (SELECT y AS label FROM g UNION SELECT p FROM g) SELECT label, CAST(sum((y = label AND p = label)::INT) AS BIGINT) AS tp, CAST(sum((y <> label AND p = label)::INT) AS BIGINT) AS fp, CAST(sum((y = label AND p <> label)::INT) AS BIGINT) AS fn, CAST(sum((y <> label AND p <> label)::INT) AS BIGINT) AS tn FROM g, l GROUP BY label")
def multilabel_confusion(spark, folder):
    return metrics.multilabel_confusion(guesses(spark, folder), "y", "p")


@query(
    "mutual_information_mixed",
    f"""WITH {_ross('customer', 'c_acctbal', 'c_mktsegment')}, c AS (SELECT c_nationkey AS x, c_mktsegment AS y, count(*) AS n FROM customer GROUP BY ALL),
    t AS (SELECT n, sum(n) OVER (PARTITION BY x) AS nx, sum(n) OVER (PARTITION BY y) AS ny, sum(n) OVER () AS t FROM c)
    SELECT 'c_acctbal' AS feature, round(mi, 6) + 0.0 AS mutual_information FROM ross UNION ALL SELECT 'nation', round(sum(n / t * ln(n * t / (nx * ny))), 6) + 0.0 FROM t""",
)
def mutual_information_mixed(spark, folder):
    rows = load(spark, folder, "customer").select("c_custkey", "c_acctbal", "c_mktsegment", F.col("c_nationkey").cast("string").alias("nation"))
    return rounded(information.mutual_information(rows, "c_custkey", ["c_acctbal", "nation"], "c_mktsegment", discrete=["nation"], target_discrete=True))


@query("kde", "WITH p AS (SELECT unnest([0.0, 5000.0, 10000.0])::DOUBLE AS place) SELECT place, round(avg(exp(-0.5 * pow((c_acctbal - place) / 500, 2))) / (500 * sqrt(2 * pi())) * 1e6, 4) AS density FROM customer, p GROUP BY place")
def kde(spark, folder):
    out = metrics.kde(load(spark, folder, "customer"), "c_acctbal", [0.0, 5000.0, 10000.0], 500.0)
    return rounded(out.select(F.col("at").alias("place"), (F.col("density") * 1e6).alias("density")), 4)
