"""Queries of scalers, imputers, outlier limits, transforms and encodings."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.functions.distributions import PPF_CUT, PPF_MIDDLE, PPF_TAIL
from granary.operators import impute, metrics, outliers, scale, series
from granary.plans.registry import load, query, rounded

KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_KEYS = ", ".join(KEY)
#: Missing cells made by rule, with a different count per column.
HOLES = {"l_quantity": "l_linenumber = 3", "l_discount": "l_partkey % 5 = 0", "l_tax": "l_suppkey % 7 = 1"}
_HOLED = "SELECT " + _KEYS + ", l_extendedprice, l_returnflag, " + ", ".join(f"CASE WHEN NOT ({w}) THEN {c} END AS {c}" for c, w in HOLES.items()) + " FROM lineitem"


def items(spark, folder):
    return load(spark, folder, "lineitem").select(*KEY, *FEATURES, "l_returnflag")


def holed(spark, folder):
    return items(spark, folder).withColumns({c: F.when(~F.expr(w), F.col(c)) for c, w in HOLES.items()})


def _scaler(kind: str, center: str, spread: str):
    stats = ", ".join(f"{center.format(c=c)} AS m{i}, {spread.format(c=c)} AS s{i}" for i, c in enumerate(FEATURES))
    out = ", ".join(f"round(({c} - m{i}) / s{i}, 6) + 0.0 AS {c}" for i, c in enumerate(FEATURES))
    sql = f"WITH s AS (SELECT {stats} FROM lineitem) SELECT {_KEYS}, {out} FROM lineitem, s"

    @query(f"scaler_{kind}", sql)
    def run(spark, folder):
        return rounded(scale.Scaler(kind, FEATURES).fit_transform(items(spark, folder)).select(*KEY, *FEATURES))

    @query(f"scaler_{kind}_inverse", f"SELECT {_KEYS}, " + ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in FEATURES) + " FROM lineitem")
    def back(spark, folder):
        rows = items(spark, folder)
        model = scale.Scaler(kind, FEATURES).fit(rows)
        return rounded(model.inverse_transform(model.transform(rows)).select(*KEY, *FEATURES))


_scaler("standard", "avg({c})", "stddev_pop({c})")
_scaler("minmax", "min({c})", "(max({c}) - min({c}))")
_scaler("robust", "median({c})", "(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25))")


@query("quantile_uniform", "SELECT o_orderkey, round(cume_dist() OVER (ORDER BY o_totalprice), 6) AS u FROM orders")
def quantile_uniform(spark, folder):
    rows = load(spark, folder, "orders").select("o_orderkey", F.col("o_totalprice").alias("u"))
    return rounded(scale.QuantileTransformer(["u"], "uniform").fit_transform(rows))


@query(
    "quantile_unseen",
    """WITH t AS (SELECT o_totalprice AS x FROM orders), n AS (SELECT count(*) AS n FROM t), c AS (SELECT DISTINCT c_acctbal * 40 AS v FROM customer),
    e AS (SELECT v, sum(k) OVER (ORDER BY v, k DESC) AS below, k FROM (SELECT x AS v, 1 AS k FROM t UNION ALL SELECT v, 0 FROM c)),
    b AS (SELECT v, max(below) AS below FROM e WHERE k = 0 GROUP BY v)
    SELECT c_custkey, round(below / n, 6) AS u FROM customer JOIN b ON b.v = c_acctbal * 40, n""",
)
def quantile_unseen(spark, folder):
    model = scale.QuantileTransformer(["u"], "uniform").fit(load(spark, folder, "orders").select(F.col("o_totalprice").alias("u")))
    return rounded(model.transform(load(spark, folder, "customer").select("c_custkey", (F.col("c_acctbal") * 40).alias("u"))))


def _poly(coefficients, x: str) -> str:
    out = repr(coefficients[0])
    for c in coefficients[1:]:
        out = f"({out} * {x} + {c!r})"
    return out


def _ppf_sql(p: str) -> str:
    """SQL of ``granary.functions.distributions.normal_ppf_of``."""
    q, r = f"({p} - 0.5::DOUBLE)", f"sqrt(-2 * ln(least({p}, 1 - {p})))"
    middle = f"{q} * {_poly(PPF_MIDDLE[0], f'({q} * {q})')} / {_poly(PPF_MIDDLE[1], f'({q} * {q})')}"
    tail = f"{_poly(PPF_TAIL[0], r)} / {_poly(PPF_TAIL[1], r)}"
    return f"CASE WHEN {p} < {PPF_CUT} THEN {tail} WHEN {p} > 1 - {PPF_CUT} THEN -({tail}) ELSE {middle} END"


@query("quantile_normal", "WITH u AS (SELECT o_orderkey, cume_dist() OVER (ORDER BY o_totalprice) AS u FROM orders), h AS (SELECT o_orderkey, least(u, max(u) FILTER (u < 1) OVER ()) AS p FROM u) SELECT o_orderkey, round(" + _ppf_sql("p") + ", 6) + 0.0 AS z FROM h")
def quantile_normal(spark, folder):
    rows = load(spark, folder, "orders").select("o_orderkey", F.col("o_totalprice").alias("z"))
    return rounded(scale.QuantileTransformer(["z"], "normal").fit_transform(rows))


def _simple(strategy: str, stat: str):
    cols = list(HOLES)
    sql = f"WITH h AS ({_HOLED}), s AS (SELECT " + ", ".join(f"{stat.format(c=c)} AS v{i}" for i, c in enumerate(cols)) + f" FROM h) SELECT {_KEYS}, " + ", ".join(f"round(coalesce({c}, v{i}), 6) + 0.0 AS {c}" for i, c in enumerate(cols)) + " FROM h, s"

    @query(f"impute_{strategy}", sql)
    def run(spark, folder):
        return rounded(impute.SimpleImputer(cols, strategy=strategy).fit_transform(holed(spark, folder)).select(*KEY, *cols))


_simple("mean", "avg({c})")
_simple("median", "median({c})")
_LEAST_MODE = "(SELECT v FROM (SELECT {c} AS v, count(*) AS n FROM h WHERE {c} IS NOT NULL GROUP BY {c}) ORDER BY n DESC, v LIMIT 1)"
_simple("mode", "any_value(" + _LEAST_MODE + ")")


@query(
    "impute_mode_categorical",
    f"""WITH h AS (SELECT {_KEYS}, CASE WHEN l_linenumber <> 2 THEN l_returnflag END AS l_returnflag FROM lineitem),
    s AS (SELECT l_returnflag AS v FROM h WHERE l_returnflag IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
    SELECT {_KEYS}, coalesce(l_returnflag, v) AS l_returnflag FROM h, s""",
)
def impute_mode_categorical(spark, folder):
    rows = items(spark, folder).withColumn("l_returnflag", F.when(F.col("l_linenumber") != 2, F.col("l_returnflag")))
    return impute.SimpleImputer([], ["l_returnflag"]).fit_transform(rows).select(*KEY, "l_returnflag")


@query("impute_constant", f"WITH h AS ({_HOLED}) SELECT {_KEYS}, " + ", ".join(f"coalesce({c}, -99) AS {c}" for c in HOLES) + " FROM h")
def impute_constant(spark, folder):
    return impute.fill_constant(holed(spark, folder), list(HOLES)).select(*KEY, *HOLES)


@query("drop_missing", f"WITH h AS ({_HOLED}) SELECT {_KEYS}, " + ", ".join(HOLES) + " FROM h WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in HOLES))
def drop_missing(spark, folder):
    return impute.drop_missing(holed(spark, folder)).select(*KEY, *HOLES)


@query("drop_missing_subset", f"WITH h AS ({_HOLED}) SELECT {_KEYS}, l_tax FROM h WHERE l_tax IS NOT NULL")
def drop_missing_subset(spark, folder):
    return impute.drop_missing(holed(spark, folder), ["l_tax"]).select(*KEY, "l_tax")


@query("null_ratio", f"WITH h AS ({_HOLED}) SELECT " + ", ".join(f"round(avg(({c} IS NULL)::INT), 6) AS {c}" for c in HOLES) + " FROM h")
def null_ratio(spark, folder):
    return rounded(impute.null_ratio(holed(spark, folder), list(HOLES)))


@query(
    "missing_order",
    f"WITH h AS ({_HOLED}), c AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, {i} AS place, count(*) FILTER ({c} IS NULL) AS n FROM h" for i, c in enumerate(HOLES)) + ") SELECT feature, CAST(row_number() OVER (ORDER BY n, place) AS INT) AS nth FROM c WHERE n > 0",
)
def missing_order(spark, folder):
    order = impute.column_order(holed(spark, folder), list(HOLES))
    return spark.createDataFrame([(c, i + 1) for i, c in enumerate(order)], "feature string, nth int")


@query("impute_iterative")
def impute_iterative(spark, folder):
    return rounded(impute.IterativeImputer(FEATURES).fit_transform(holed(spark, folder)).select(*KEY, *FEATURES), 4)


@query(
    "impute_iterative_pair",
    f"""WITH h AS (SELECT {_KEYS}, l_extendedprice, CASE WHEN l_linenumber <> 3 THEN l_quantity END AS q FROM lineitem),
    s AS (SELECT regr_slope(q, l_extendedprice) AS a, regr_intercept(q, l_extendedprice) AS b FROM h)
    SELECT {_KEYS}, l_extendedprice, round(coalesce(q, a * l_extendedprice + b), 4) AS l_quantity FROM h, s""",
)
def impute_iterative_pair(spark, folder):
    rows = items(spark, folder).withColumn("l_quantity", F.when(F.col("l_linenumber") != 3, F.col("l_quantity")))
    cols = ["l_extendedprice", "l_quantity"]
    return rounded(impute.IterativeImputer(cols).fit_transform(rows).select(*KEY, *cols), 4, l_extendedprice=9)


@query("impute_outliers_iterative")
def impute_outliers_iterative(spark, folder):
    rows = items(spark, folder)
    flag = outliers.fit_limits(rows, "l_extendedprice", "iqr").flag()
    masked = rows.withColumn("odd", flag | (F.col("l_linenumber") == 7))
    return rounded(impute.IterativeImputer(FEATURES, masks={"l_extendedprice": "odd"}).fit_transform(masked).select(*KEY, *FEATURES), 4)


@query(
    "impute_knn",
    """WITH s AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 5 <> 0 THEN s_acctbal END AS a, CAST(s_nationkey AS DOUBLE) AS b FROM supplier),
    d AS (SELECT q.k, t.k AS j, t.a AS ta, sqrt(2.0 / ((q.a IS NOT NULL AND t.a IS NOT NULL)::INT + 1) * (coalesce((q.a - t.a) * (q.a - t.a), 0) + (q.b - t.b) * (q.b - t.b))) AS dist FROM s q JOIN s t ON q.k <> t.k WHERE q.a IS NULL),
    r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY dist, j) AS r FROM d),
    m AS (SELECT k, avg(ta) AS v FROM r WHERE r <= 20 GROUP BY k)
    SELECT s.k AS s_suppkey, round(coalesce(a, v), 6) AS s_acctbal, b AS s_nationkey FROM s LEFT JOIN m USING (k)""",
)
def impute_knn(spark, folder):
    rows = load(spark, folder, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 5 != 0, F.col("s_acctbal")).alias("s_acctbal"), F.col("s_nationkey").cast("double").alias("s_nationkey"))
    return rounded(impute.knn_impute(rows, rows, "s_suppkey", ["s_acctbal", "s_nationkey"]))


_CLIPPED = ["l_extendedprice", "l_quantity"]


@query(
    "winsorize_continuous",
    "WITH q AS (SELECT " + ", ".join(f"quantile_cont({c}, 0.05) AS a{i}, quantile_cont({c}, 0.95) AS b{i}" for i, c in enumerate(_CLIPPED)) + f" FROM lineitem) SELECT {_KEYS}, " + ", ".join(f"round(least(greatest({c}, a{i}), b{i}), 6) AS {c}" for i, c in enumerate(_CLIPPED)) + " FROM lineitem, q",
)
def winsorize_continuous(spark, folder):
    return rounded(impute.Winsorizer(_CLIPPED).fit_transform(items(spark, folder)).select(*KEY, *_CLIPPED))


@query(
    "winsorize_categorical",
    """WITH c AS (SELECT c_nationkey AS v FROM customer GROUP BY 1 HAVING count(*) >= 0.04 * (SELECT count(*) FROM customer))
    SELECT c_custkey, CASE WHEN c_nationkey IN (SELECT v FROM c) THEN CAST(c_nationkey AS VARCHAR) ELSE '-99' END AS c_nationkey FROM customer""",
)
def winsorize_categorical(spark, folder):
    rows = load(spark, folder, "customer").select("c_custkey", "c_nationkey")
    return impute.Winsorizer([], ["c_nationkey"], percentage=0.04).fit_transform(rows)


_MOMENTS = "WITH m AS (SELECT avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS s, count(*) AS n FROM orders) "


@query("skewness", _MOMENTS + "SELECT round(sum(pow((o_totalprice - m) / s, 3)) / (any_value(n) - 1), 6) AS skewness, round(sum(pow((o_totalprice - m) / s, 4)) / (any_value(n) - 1), 6) AS kurtosis FROM orders, m")
def skewness(spark, folder):
    return rounded(load(spark, folder, "orders").agg(impute.skewness("o_totalprice").alias("skewness"), impute.kurtosis("o_totalprice").alias("kurtosis")))


@query("skew_transforms", f"SELECT {_KEYS}, round(ln(l_extendedprice), 6) AS log, round(sqrt(l_extendedprice), 6) AS sqrt, round(ln(l_extendedprice), 6) AS boxcox0, round((pow(l_extendedprice, 0.5) - 1) / 0.5, 6) AS boxcox5 FROM lineitem")
def skew_transforms(spark, folder):
    x = "l_extendedprice"
    return rounded(items(spark, folder).select(*KEY, impute.log_transform(x).alias("log"), impute.sqrt_transform(x).alias("sqrt"), impute.box_cox(x).alias("boxcox0"), impute.box_cox(x, 0.5).alias("boxcox5")))


_GRID = [-1.0, -0.5, 0.0, 0.5, 1.0, 2.0]


@query(
    "box_cox_lambda",
    "WITH " + ", ".join(f"g{i} AS (SELECT {lam}::DOUBLE AS lam, ({lam} - 1) * sum(ln(o_totalprice)) - count(*) / 2.0 * ln(var_pop({'ln(o_totalprice)' if lam == 0 else f'(pow(o_totalprice, {lam}) - 1) / ({lam})'})) AS v FROM orders)" for i, lam in enumerate(_GRID)) + " SELECT lam, round(v, 3) AS log_likelihood FROM (" + " UNION ALL ".join(f"SELECT * FROM g{i}" for i in range(len(_GRID))) + ")",
)
def box_cox_lambda(spark, folder):
    return rounded(impute.box_cox_lambda(load(spark, folder, "orders"), "o_totalprice", _GRID).withColumnRenamed("lambda", "lam"), 3)


_EVENTS = "SELECT event_id, round(value, 6) AS value FROM events, s WHERE "
_LIMITS = {
    "std": "WITH s AS (SELECT avg(value) AS m, stddev_pop(value) AS d FROM events) " + _EVENTS + "value < m - 3 * d OR value > m + 3 * d",
    "z": "WITH s AS (SELECT avg(value) AS m, stddev_pop(value) AS d FROM events) " + _EVENTS + "abs((value - m) / d) > 2",
    "robust": "WITH a AS (SELECT median(value) AS m FROM events), s AS (SELECT any_value(m) AS m, median(abs(value - m)) AS d FROM events, a) " + _EVENTS + "abs(0.6745 * (value - m) / d) > 2",
    "iqr": "WITH s AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events) " + _EVENTS + "value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a)",
}
_T = {"std": 3.0, "z": 2.0, "robust": 2.0, "iqr": 1.5}


def _limits(method: str, sql: str):
    @query(f"outliers_{method}", sql)
    def found(spark, folder):
        rows = load(spark, folder, "events").select("event_id", "value")
        return rounded(outliers.fit_limits(rows, "value", method, _T[method]).find_outliers(rows))

    @query(f"outliers_{method}_removed", f"SELECT event_id, round(value, 6) AS value FROM events WHERE event_id NOT IN (SELECT event_id FROM ({sql}))")
    def removed(spark, folder):
        rows = load(spark, folder, "events").select("event_id", "value")
        return rounded(outliers.fit_limits(rows, "value", method, _T[method]).remove_outliers(rows))


for _method, _sql in _LIMITS.items():
    _limits(_method, _sql)


@query("outliers_by_all", f"SELECT event_id, value FROM ({_LIMITS['z']}) JOIN (SELECT event_id FROM ({_LIMITS['robust']})) USING (event_id)")
def outliers_by_all(spark, folder):
    rows = load(spark, folder, "events").select("event_id", "value")
    return rounded(outliers.flagged_by_all(rows, [outliers.fit_limits(rows, "value", m, 2.0) for m in ("z", "robust")]))


@query(
    "outliers_mahalanobis",
    f"""WITH s AS (SELECT avg(l_quantity) AS mx, avg(l_extendedprice) AS my, var_samp(l_quantity) AS a, var_samp(l_extendedprice) AS c, covar_samp(l_quantity, l_extendedprice) AS b FROM lineitem),
    d AS (SELECT {_KEYS}, l_quantity - mx AS x, l_extendedprice - my AS y, a, b, c FROM lineitem, s)
    SELECT {_KEYS}, round(sqrt((c * x * x - 2 * b * x * y + a * y * y) / (a * c - b * b)), 6) AS distance FROM d
    WHERE sqrt((c * x * x - 2 * b * x * y + a * y * y) / (a * c - b * b)) > sqrt(-2 * ln(0.05))""",
)
def outliers_mahalanobis(spark, folder):
    rows = items(spark, folder)
    model = outliers.fit_mahalanobis(rows, ["l_quantity", "l_extendedprice"])
    return rounded(model.find_outliers(rows).select(*KEY, model.distance().alias("distance")))


def _lof(name: str, reach: bool, table: str = "supplier", p: str = "s"):
    key = {"s": "s_suppkey", "c": "c_custkey"}[p]
    kd = "d" if not reach else "greatest(d, kd)"
    sql = f"""WITH s AS (SELECT {key} AS k, {p}_acctbal AS a, CAST({p}_nationkey AS DOUBLE) AS b FROM {table}),
    p AS (SELECT q.k AS i, t.k AS j, sqrt((q.a - t.a) * (q.a - t.a) + (q.b - t.b) * (q.b - t.b)) AS d FROM s q JOIN s t ON q.k <> t.k),
    n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d, j) AS r FROM p) WHERE r <= 20),
    f AS (SELECT i AS j, max(d) AS kd FROM n GROUP BY i), m AS (SELECT i, j, {kd} AS d FROM n JOIN f USING (j)),
    l AS (SELECT i, 20 / sum(d) AS lrd FROM m GROUP BY i),
    o AS (SELECT m.i, sum(l.lrd) AS s FROM m JOIN l ON l.i = m.j GROUP BY m.i)
    SELECT l.i AS {key}, round(lrd, 6) AS lrd, round(s / (20 * lrd), 6) AS lof FROM o JOIN l USING (i)"""

    @query(name, sql)
    def run(spark, folder):
        rows = load(spark, folder, table).select(key, f"{p}_acctbal", F.col(f"{p}_nationkey").cast("double").alias("n"))
        return rounded(outliers.local_outlier_factor(rows, key, [f"{p}_acctbal", "n"], 20, reach=reach))


_lof("outliers_lof", False)
_lof("outliers_lof_reach", True)
_lof("outliers_lof_customers", False, "customer", "c")


@query("outliers_isolation_forest")
def outliers_isolation_forest(spark, folder):
    rows = items(spark, folder)
    return rounded(outliers.fit_isolation_forest(rows, ["l_quantity", "l_extendedprice"], n_estimators=20, key=KEY).predict(rows).select(*KEY, "anomaly_score", "is_outlier"))


@query("ordinal_encode", "SELECT o_orderkey, CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS INT) AS priority FROM orders")
def ordinal_encode(spark, folder):
    return series.ordinal_encode(load(spark, folder, "orders"), "o_orderpriority", "priority").select("o_orderkey", F.col("priority").cast("int").alias("priority"))


@query(
    "one_hot_drop_first",
    "SELECT c_custkey, " + ", ".join(f"""CASE WHEN c_mktsegment = '{s}' THEN 1 WHEN c_mktsegment = 'HOUSEHOLD' THEN -1 ELSE 0 END AS seg_{s.lower()}""" for s in ("BUILDING", "FURNITURE", "MACHINERY")) + " FROM customer",
)
def one_hot_drop_first(spark, folder):
    fitted = ["AUTOMOBILE", "BUILDING", "FURNITURE", "MACHINERY"]
    out = series.one_hot(load(spark, folder, "customer"), "c_mktsegment", fitted)
    return out.select("c_custkey", *[F.col(f"c_mktsegment_{s}").alias(f"seg_{s.lower()}") for s in fitted[1:]])


_SERIES = "OVER (PARTITION BY user_id ORDER BY event_id"


@query("lead_label", f"SELECT event_id, lead(CASE WHEN value > user_id THEN 1 ELSE 0 END) {_SERIES}) AS target FROM events")
def lead_label(spark, folder):
    return series.lead_label(load(spark, folder, "events"), ["user_id"], "event_id", "value", "user_id").select("event_id", "target")


@query("difference", f"SELECT event_id, round(value - lag(value) {_SERIES}), 6) + 0.0 AS value_diff FROM events")
def difference(spark, folder):
    return rounded(series.difference(load(spark, folder, "events"), ["user_id"], "event_id", "value").select("event_id", "value_diff"))


@query(
    "indicators",
    f"""WITH p AS (SELECT event_id, user_id, 100 + value AS c, 101 + value AS h, 98 + value AS l FROM events),
    t AS (SELECT *, (h + l + c) / 3 AS tp, c - lag(c) {_SERIES}) AS step, count(*) {_SERIES} ROWS 6 PRECEDING) AS n, avg(c) {_SERIES} ROWS 3 PRECEDING) AS half FROM p),
    w AS (SELECT *, list(tp) {_SERIES} ROWS 6 PRECEDING) AS a, avg(tp) {_SERIES} ROWS 6 PRECEDING) AS m, max(h) {_SERIES} ROWS 6 PRECEDING) AS top, min(l) {_SERIES} ROWS 6 PRECEDING) AS bottom,
      sum(greatest(step, 0)) {_SERIES} ROWS 6 PRECEDING) AS up, sum(greatest(-step, 0)) {_SERIES} ROWS 6 PRECEDING) AS down, count(step) {_SERIES} ROWS 6 PRECEDING) AS steps,
      avg(c) {_SERIES} ROWS 6 PRECEDING) AS mean, lag(c, 7) {_SERIES}) AS before, avg(half) {_SERIES} ROWS 3 PRECEDING) AS tri FROM t)
    SELECT event_id, CASE WHEN n = 7 THEN round(mean, 6) END AS sma, round(100 * (c / before - 1), 6) + 0.0 AS roc, CASE WHEN n = 7 THEN round(-100 * (top - c) / (top - bottom), 6) + 0.0 END AS willr,
      CASE WHEN n = 7 THEN round((tp - m) / nullif(0.015 * (list_sum(list_transform(a, lambda x: abs(x - m))) / 7), 0), 6) + 0.0 END AS cci,
      CASE WHEN n = 7 THEN round(tri, 6) END AS trima, CASE WHEN steps = 7 THEN round(100 * up / nullif(up + down, 0), 6) + 0.0 END AS rsi FROM w""",
)
def indicators(spark, folder):
    rows = load(spark, folder, "events").select("event_id", "user_id", (100 + F.col("value")).alias("c"), (101 + F.col("value")).alias("h"), (98 + F.col("value")).alias("l"))
    out = series.indicators(rows, ["user_id"], "event_id", "c", "h", "l")
    return rounded(out.select("event_id", "sma", "roc", "willr", "cci", "trima", "rsi"), 6)


@query(
    "join_series",
    """WITH a AS (SELECT c_nationkey AS k, round(avg(c_acctbal), 6) AS a FROM customer GROUP BY 1), b AS (SELECT s_nationkey AS k, round(avg(s_acctbal), 6) AS b FROM supplier GROUP BY 1)
    SELECT k, a, b FROM a FULL JOIN b USING (k)""",
)
def join_series(spark, folder):
    side = lambda table, c, name: load(spark, folder, table).groupBy(F.col(f"{c}_nationkey").alias("k")).agg(F.round(F.avg(f"{c}_acctbal"), 6).alias(name))
    return series.join_series(side("customer", "c", "a"), side("supplier", "s", "b"), "k")


@query("histogram", "WITH s AS (SELECT min(o_totalprice) AS a, (max(o_totalprice) - min(o_totalprice)) / 20 AS w FROM orders), c AS (SELECT least(floor((o_totalprice - a) / w), 19) AS bin, count(*) AS n FROM orders, s GROUP BY 1) SELECT CAST(i AS INT) AS bin, round(a + i * w, 4) AS low, round(a + (i + 1) * w, 4) AS high, coalesce(n, 0) AS n FROM range(20) r(i) CROSS JOIN s LEFT JOIN c ON c.bin = i")
def histogram(spark, folder):
    return rounded(metrics.histogram(load(spark, folder, "orders"), "o_totalprice", 20), 4)


@query("five_numbers", "SELECT o_orderpriority, round(min(o_totalprice), 6) AS low, round(quantile_cont(o_totalprice, 0.25), 6) AS q1, round(median(o_totalprice), 6) AS median, round(quantile_cont(o_totalprice, 0.75), 6) AS q3, round(max(o_totalprice), 6) AS high FROM orders GROUP BY 1")
def five_numbers(spark, folder):
    return rounded(metrics.five_numbers(load(spark, folder, "orders"), "o_totalprice", "o_orderpriority"))


@query("frequencies", "SELECT o_orderpriority AS value, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM orders GROUP BY 1")
def frequencies(spark, folder):
    return rounded(metrics.frequencies(load(spark, folder, "orders"), "o_orderpriority"))


@query("top_features", "WITH f AS (SELECT * FROM (VALUES ('l_quantity', (SELECT abs(corr(l_quantity, l_extendedprice)) FROM lineitem)), ('l_discount', (SELECT abs(corr(l_discount, l_extendedprice)) FROM lineitem)), ('l_tax', (SELECT abs(corr(l_tax, l_extendedprice)) FROM lineitem))) t(feature, importance)) SELECT feature, round(importance, 6) AS importance, round((importance - min(importance) OVER ()) / (max(importance) OVER () - min(importance) OVER ()), 6) AS scaled, CAST(dense_rank() OVER (ORDER BY importance DESC) AS INT) AS rank FROM f")
def top_features(spark, folder):
    cols = ["l_quantity", "l_discount", "l_tax"]
    got = items(spark, folder).agg(*[F.abs(F.corr(c, "l_extendedprice")).alias(c) for c in cols])
    scores = got.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("importance")) for c in cols])).alias("s")).select("s.*")
    return rounded(metrics.dense_rank_features(scores, "feature", "importance"))
