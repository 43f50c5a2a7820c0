"""Missing and outlying values: statistics, constants, neighbours and models; winsorizing; skew transforms."""

from __future__ import annotations

import random
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.columns import numeric
from granary.functions.order import exact_quantiles
from granary.functions.storage import materialize


def null_ratio(df: DataFrame, cols: list[str]) -> DataFrame:
    """One row: the share of nulls of each column."""
    return df.agg(*[F.avg(F.col(c).isNull().cast("int")).alias(c) for c in cols])


def drop_missing(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Rows without a null (in ``cols``)."""
    return df.na.drop("any", subset=cols)


def fill_constant(df: DataFrame, cols: list[str], value: float = -99.0) -> DataFrame:
    return df.na.fill(value, subset=cols)


#: A column's statistic; the mode of ties is the least value.
STATISTICS = {"mean": lambda c: F.avg(c), "median": lambda c: F.median(c), "mode": lambda c: F.mode(c, True)}


@dataclass
class StatisticModel:
    values: dict[str, object]

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in self.values.items()})


@dataclass
class SimpleImputer:
    """Fill ``continuous`` columns by mean, median or mode and ``categorical`` ones by mode."""

    continuous: list[str]
    categorical: list[str] = ()
    strategy: str = "mean"

    def fit(self, df: DataFrame) -> StatisticModel:
        if self.strategy not in STATISTICS:
            raise ValueError(f"unknown strategy {self.strategy!r}")
        numeric(df, list(self.continuous))
        one = "mode" if self.strategy == "median" else self.strategy
        aggregated = {c: STATISTICS["mode"] for c in self.categorical} | {c: STATISTICS[one] for c in self.continuous if self.strategy != "median"}
        values = {}
        if aggregated:
            values = dict(zip(aggregated, df.agg(*[f(c) for c, f in aggregated.items()]).first()))
        if self.strategy == "median" and self.continuous:
            values |= {c: q[0] for c, q in exact_quantiles(df, list(self.continuous), [0.5]).items()}
        return StatisticModel(values)

    def fit_transform(self, df: DataFrame) -> DataFrame:
        return self.fit(df).transform(df)


def column_order(df: DataFrame, cols: list[str], order: str = "ascending", seed: int = 17) -> list[str]:
    """Columns with a missing cell, by how many (ties: as given), or shuffled."""
    counts = df.agg(*[F.count(F.when(F.col(c).isNull(), 1)).alias(f"n{i}") for i, c in enumerate(cols)]).first()
    missing = [(counts[f"n{i}"], i, c) for i, c in enumerate(cols) if counts[f"n{i}"]]
    if order == "random":
        random.Random(seed).shuffle(missing)
    elif order in ("ascending", "descending"):
        missing.sort(key=lambda x: (x[0] if order == "ascending" else -x[0], x[1]))
    else:
        raise ValueError(f"unknown order {order!r}")
    return [c for _, _, c in missing]


@dataclass
class IterativeImputer:
    """One sweep: fill by a statistic, then predict each column's flagged cells from the other columns as filled so far.

    ``regressor`` is a pyspark.ml estimator (default: linear regression); ``classifier`` serves ``categorical`` columns
    of whole numbers. A cell is flagged if it is null, or by the Boolean column that ``masks`` names for its column.
    """

    cols: list[str]
    categorical: list[str] = ()
    strategy: str = "mean"
    order: str = "ascending"
    regressor: object = None
    classifier: object = None
    masks: dict[str, str] | None = None
    seed: int = 17

    def _flagged(self, df: DataFrame) -> DataFrame:
        flag = lambda c: F.col(c).isNull() | F.coalesce(F.col(self.masks[c]), F.lit(False)) if self.masks and c in self.masks else F.col(c).isNull()
        return df.withColumns({f"__flag_{c}": flag(c) for c in self.cols}).withColumns({c: F.when(~F.col(f"__flag_{c}"), F.col(c).cast("double")) for c in self.cols})

    def fit(self, df: DataFrame) -> IterativeModel:
        from pyspark.ml.classification import DecisionTreeClassifier
        from pyspark.ml.feature import VectorAssembler
        from pyspark.ml.regression import LinearRegression

        flagged = self._flagged(df)
        base = SimpleImputer([c for c in self.cols if c not in self.categorical], list(self.categorical), self.strategy).fit(flagged)
        filled, steps = base.transform(flagged), []
        for c in column_order(flagged, self.cols, self.order, self.seed):
            inputs = [x for x in self.cols if x != c]
            features = VectorAssembler(inputCols=inputs, outputCol="__features")
            estimator = (self.classifier or DecisionTreeClassifier(seed=self.seed)) if c in self.categorical else (self.regressor or LinearRegression())
            model = estimator.copy().setFeaturesCol("__features").setLabelCol(c).setPredictionCol("__prediction").fit(features.transform(filled.filter(~F.col(f"__flag_{c}"))))
            steps.append((c, features, model))
            filled = _predicted(filled, *steps[-1])
        return IterativeModel(self, base, steps)

    def fit_transform(self, df: DataFrame) -> DataFrame:
        return self.fit(df).transform(df)


def _predicted(filled: DataFrame, column: str, features, model) -> DataFrame:
    scored = model.transform(features.transform(filled))
    return scored.withColumn(column, F.when(F.col(f"__flag_{column}"), F.col("__prediction")).otherwise(F.col(column))).select(*filled.columns)


@dataclass
class IterativeModel:
    imputer: IterativeImputer
    base: StatisticModel
    steps: list

    def transform(self, df: DataFrame) -> DataFrame:
        filled = self.base.transform(self.imputer._flagged(df))
        for step in self.steps:
            filled = _predicted(filled, *step)
        return filled.drop(*[f"__flag_{c}" for c in self.imputer.cols])


#: Projected rows that ask and are compared by one unit of work, the most partitions for that, and the most pairs of patterns of nulls.
UNIT, MOST_PARTS, MOST_PATTERNS = 256, 512, 4096


def knn_impute(train: DataFrame, test: DataFrame, key: str, cols: list[str], k: int = 20, weights: str = "uniform") -> DataFrame:
    """Fill nulls of ``test`` from the ``k`` nearest rows of ``train`` (other than the row itself, by ``key``).

    The distance is Euclidean over the columns that both rows have, scaled up by their share. ``uniform`` averages the
    neighbours that have a value, ``weighted`` weighs them k, k-1, ..., 1 by rank.

    The columns that both have depend on the rows' patterns of nulls only. So for each pair of patterns, rows that ask and rows
    that give are cut down to those columns and equal ones are one point, of which k + 1 keys can matter; points are
    compared, not rows. That is few where the known columns have few values, and all pairs of points where each
    row has its own. More than ``MOST_PATTERNS`` pairs of patterns raise ValueError.
    """
    if weights not in ("uniform", "weighted"):
        raise ValueError(f"unknown weights {weights!r}")
    m = len(numeric(train, cols))
    values = F.array(*[F.col(c).cast("double") + 0.0 for c in cols])
    known = sum((F.col(c).isNotNull().cast("int") * (1 << i) for i, c in enumerate(cols)), F.lit(0))
    asked = test.filter(known < (1 << m) - 1).select(F.col(key).alias("a"), values.alias("x"), known.alias("o"))
    given = train.select(F.col(key).alias("b"), values.alias("y"), known.alias("g"))
    asking, giving = ([r[0] for r in df.select(c).distinct().limit(MOST_PATTERNS + 1).collect()] for df, c in ((asked, "o"), (given, "g")))
    if len(asking) * len(giving) > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} pairs of patterns of nulls")
    shared = sorted({(g, o & g) for o in asking for g in giving if o & g})
    pairs = F.array(*[F.struct(F.lit(g).alias("g"), F.lit(c).alias("c")) for g, c in shared]) if shared else F.expr("CAST(array() AS ARRAY<STRUCT<g: INT, c: INT>>)")
    cut = lambda v: F.transform(v, lambda u, i: F.when(F.col("c").bitwiseAND(F.pow(F.lit(2.0), i).cast("int")) != 0, u))
    each = materialize(asked.select("x", "o").distinct(), "knn-asked")
    sent = each.select("x", "o", F.explode(F.filter(pairs, lambda p: F.col("o").bitwiseAND(p["g"]) == p["c"])).alias("p")).select("x", F.col("p")["g"].alias("g"), F.col("p")["c"].alias("c"))
    sent = materialize(sent.withColumn("px", cut(F.col("x"))), "knn-sent")
    offered = given.withColumn("p", F.explode(F.filter(pairs, lambda p: p["g"] == F.col("g")))).withColumn("c", F.col("p")["c"]).withColumn("py", cut(F.col("y")))
    least = Window.partitionBy("g", "c", "py").orderBy("b")
    offered = offered.withColumn("nth", F.row_number().over(least)).filter(F.col("nth") <= k + 1)
    points = materialize(offered.groupBy("g", "c", "py").agg(F.collect_list(F.struct("b", "y")).alias("rows")), "knn-points")

    asks = sent.select("g", "c", "px").distinct()
    units = max(1, min(MOST_PARTS, -(-asks.count() // UNIT)))
    asks = asks.withColumn("unit", F.pmod(F.xxhash64("px"), F.lit(units)).cast("int")).repartition(units, "unit")
    dealt = points.withColumn("unit", F.explode(F.sequence(F.lit(0), F.lit(units - 1)))).repartition(units, "unit")
    squares = F.filter(F.zip_with("px", "py", lambda p, q: (p - q) * (p - q)), lambda d: d.isNotNull())
    met = asks.hint("merge").join(dealt, ["g", "c", "unit"]).withColumn("s", squares)
    met = met.withColumn("d", F.sqrt(F.lit(float(m)) / F.size("s") * F.aggregate("s", F.lit(0.0), lambda u, v: u + v)))
    met = met.select("g", "c", "px", "d", F.explode("rows").alias("r")).select("g", "c", "px", "d", "r.b", "r.y")
    first = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("d", "b"))
    near = met.withColumn("nth", first("g", "c", "px")).filter(F.col("nth") <= k + 1).drop("nth")
    near = sent.join(near, ["g", "c", "px"]).withColumn("nth", first("x")).filter(F.col("nth") <= k + 1)
    lists = near.groupBy("x").agg(F.array_sort(F.collect_list(F.struct("d", "b", "y"))).alias("near"))

    others = F.slice(F.filter("near", lambda o: o["b"] != F.col("a")), 1, k)
    weigh = lambda i: F.lit(1.0) if weights == "uniform" else (F.lit(k) - i).cast("double")
    found = asked.join(lists, "x").select("a", F.transform(others, lambda o, i: F.struct(o["y"].alias("y"), weigh(i).alias("w"))).alias("others"))
    total = lambda of: F.aggregate(of, F.lit(0.0), lambda u, v: u + v)

    def mean_of(i: int):
        having = F.filter("others", lambda o: F.get(o["y"], F.lit(i)).isNotNull())
        return total(F.transform(having, lambda o: F.get(o["y"], F.lit(i)) * o["w"])) / F.nullif(total(F.transform(having, lambda o: o["w"])), F.lit(0.0))

    picked = [mean_of(i).alias(f"__fill_{c}") for i, c in enumerate(cols)]
    filled = found.select(F.col("a").alias("__fill_key"), *picked)
    joined = test.join(filled, F.col(key) == F.col("__fill_key"), "left")
    return joined.withColumns({c: F.coalesce(F.col(c).cast("double"), F.col(f"__fill_{c}")) for c in cols}).select(*test.columns)


@dataclass
class WinsorModel:
    bounds: dict[str, tuple[float, float]]
    kept: dict[str, DataFrame]

    def transform(self, df: DataFrame) -> DataFrame:
        out = df.withColumns({c: F.least(F.greatest(F.col(c).cast("double"), F.lit(lo)), F.lit(hi)) for c, (lo, hi) in self.bounds.items()})
        for c, table in self.kept.items():
            known = table.select(F.col(c).alias("__v"), F.lit(True).alias("__kept"))
            out = out.join(known, F.col(c).eqNullSafe(F.col("__v")), "left").withColumn(c, F.when(F.col("__kept"), F.col(c).cast("string")).otherwise(F.lit("-99"))).drop("__v", "__kept")
        return out


@dataclass
class Winsorizer:
    """Clip ``continuous`` columns at their ``percentile`` and its complement; categories rarer than ``percentage`` become -99."""

    continuous: list[str]
    categorical: list[str] = ()
    percentile: float = 0.05
    percentage: float = 0.01

    def fit(self, df: DataFrame) -> WinsorModel:
        cols = numeric(df, list(self.continuous))
        bounds = {}
        if cols:
            bounds = {c: tuple(q) for c, q in exact_quantiles(df, cols, [self.percentile, 1 - self.percentile]).items()}
        kept = {}
        for c in self.categorical:
            n = df.agg(F.count("*")).first()[0]
            kept[c] = df.groupBy(c).count().filter(F.col("count") >= F.lit(self.percentage * n)).select(c)
        return WinsorModel(bounds, kept)

    def fit_transform(self, df: DataFrame) -> DataFrame:
        return self.fit(df).transform(df)


def skewness(c: str):
    """Third standardised moment with divisor n - 1."""
    return F.skewness(c) * F.count(c) / F.nullif(F.count(c) - 1, F.lit(0))


def kurtosis(c: str):
    """Fourth standardised moment with divisor n - 1."""
    return (F.kurtosis(c) + 3) * F.count(c) / F.nullif(F.count(c) - 1, F.lit(0))


def log_transform(c: str):
    return F.ln(F.col(c).cast("double"))


def sqrt_transform(c: str):
    return F.sqrt(F.col(c).cast("double"))


def box_cox(c: str, lam: float = 0.0):
    x = F.col(c).cast("double")
    return F.ln(x) if lam == 0 else (F.pow(x, F.lit(float(lam))) - 1) / F.lit(float(lam))


def box_cox_lambda(df: DataFrame, c: str, grid: list[float]) -> DataFrame:
    """(lambda, log_likelihood) of each value of the grid, in one aggregate job; the best is the maximum."""
    x = F.col(c).cast("double")
    sums = df.filter(x > 0).agg(F.count(c).alias("n"), F.sum(F.ln(x)).alias("s"), *[F.var_pop(box_cox(c, lam)).alias(f"v{i}") for i, lam in enumerate(grid)])
    rows = F.array(*[F.struct(F.lit(float(lam)).alias("lambda"), ((lam - 1) * F.col("s") - F.col("n") / 2 * F.ln(F.col(f"v{i}"))).alias("log_likelihood")) for i, lam in enumerate(grid)])
    return sums.select(F.explode(rows).alias("r")).select("r.*")
