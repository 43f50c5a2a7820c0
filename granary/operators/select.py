"""Feature selection, tuning and cross-validated evaluation around pyspark.ml estimators."""

from __future__ import annotations

import itertools
import math
import random
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.distributions import binomial_pmf
from granary.functions.order import MOST_RANGES, ROWS_PER_RANGE, exact_quantiles
from granary.functions.storage import materialize, scratch
from granary.operators import metrics


def score_of(predictions: DataFrame, label: str, metric: str) -> float:
    """The higher the better: accuracy, roc_auc, and the negated mse, rmse, mae."""
    if metric == "accuracy":
        return metrics.accuracy(predictions, label, "prediction").first()[0]
    if metric == "roc_auc":
        from pyspark.ml.functions import vector_to_array

        scored = predictions.withColumn("__score", vector_to_array("probability")[1]) if "probability" in predictions.columns else predictions.withColumn("__score", F.col("prediction"))
        return metrics.roc_auc(scored, label, "__score").first()[0]
    if metric in ("mse", "rmse", "mae"):
        return -metrics.regression_metrics(predictions, label, "prediction").first()[metric]
    raise ValueError(f"unknown metric {metric!r}")


@dataclass
class Evaluation:
    """Fits an estimator on some features and scores it: by folds of (split, row_id, role), or by an ordered share.

    ``rows`` has row_id, the label and the features. Candidates of a step are independent fits, run ``parallel`` at a time.
    """

    rows: DataFrame
    label: str
    estimator: object
    metric: str
    splits: DataFrame | None = None
    train_share: float = 0.8
    parallel: int = 4
    scores: dict = field(default_factory=dict)

    def _one(self, features: tuple[str, ...], train: DataFrame, test: DataFrame, params: dict | None) -> tuple[float, float]:
        assembler = VectorAssembler(inputCols=list(features), outputCol="__features")
        estimator = self.estimator.copy({self.estimator.getParam(k): v for k, v in (params or {}).items()})
        model = estimator.setFeaturesCol("__features").setLabelCol(self.label).fit(assembler.transform(train))
        return tuple(score_of(model.transform(assembler.transform(part)), self.label, self.metric) for part in (train, test))

    def both(self, features: list[str], params: dict | None = None) -> tuple[float, float]:
        """Mean train and validation score."""
        features = tuple(features)
        if self.splits is None:
            cut = int(self.rows.count() * self.train_share)
            return self._one(features, self.rows.filter(F.col("row_id") < cut), self.rows.filter(F.col("row_id") >= cut), params)
        got = []
        for (k,) in self.splits.select("split").distinct().orderBy("split").collect():
            side = self.rows.join(self.splits.filter(F.col("split") == k).select("row_id", "role"), "row_id")
            got.append(self._one(features, side.filter("role = 'train'"), side.filter("role = 'test'"), params))
        return tuple(sum(g[i] for g in got) / len(got) for i in (0, 1))

    def score(self, features: list[str]) -> float:
        key = tuple(sorted(features))
        if key not in self.scores:
            self.scores[key] = self.both(list(key))[1]
        return self.scores[key]

    def many(self, candidates: list[list[str]]) -> list[float]:
        with ThreadPoolExecutor(self.parallel) as pool:
            return list(pool.map(self.score, candidates))


def cross_validate(evaluation: Evaluation, features: list[str]) -> DataFrame:
    train, valid = evaluation.both(features)
    return evaluation.rows.sparkSession.range(1).select(F.lit(train).alias("train_score"), F.lit(valid).alias("valid_score"))


def forward(evaluation: Evaluation, features: list[str], ties: bool = False) -> list[str]:
    """The best single feature, then the first candidate in order that improves the score, again and again."""
    scores = evaluation.many([[f] for f in features])
    best = max(scores)
    chosen = [features[scores.index(best)]]
    while True:
        for f in [f for f in features if f not in chosen]:
            s = evaluation.score([*chosen, f])
            if s > best or ties and s == best:
                best, chosen = s, [*chosen, f]
                break
        else:
            return chosen


def backward(evaluation: Evaluation, features: list[str]) -> list[str]:
    """Drop the feature whose removal scores best until one is left; the best set seen."""
    current, seen = list(features), [(evaluation.score(features), list(features))]
    while len(current) > 1:
        options = [[f for f in current if f != g] for g in current]
        scores = evaluation.many(options)
        current = options[scores.index(max(scores))]
        seen.append((max(scores), current))
    return max(seen, key=lambda s: (s[0], -len(s[1])))[1]


def importances(evaluation: Evaluation, features: list[str]) -> dict[str, float]:
    """What the estimator, fitted on all rows, says of each feature: tree importances, or absolute coefficients."""
    rows = VectorAssembler(inputCols=list(features), outputCol="__features").transform(evaluation.rows)
    model = evaluation.estimator.copy().setFeaturesCol("__features").setLabelCol(evaluation.label).fit(rows)
    found = model.featureImportances if hasattr(model, "featureImportances") else model.coefficients
    return {f: abs(float(v)) for f, v in zip(features, found.toArray())}


def rfe(evaluation: Evaluation, features: list[str], n: int | None = None) -> list[str]:
    """Recursive elimination: drop the least important feature (ties: the last) until ``n``, or half of them, are left."""
    left = list(features)
    while len(left) > (n or max(1, len(features) // 2)):
        known = importances(evaluation, left)
        left.remove(min(reversed(left), key=known.get))
    return left


def rfecv(evaluation: Evaluation, features: list[str]) -> list[str]:
    """Of all sets that :func:`rfe` passes through the one that scores best; of equal ones the smallest."""
    sets = [rfe(evaluation, features, n) for n in range(1, len(features) + 1)]
    scores = evaluation.many(sets)
    return sets[max(range(len(sets)), key=lambda i: (scores[i], -i))]


def benchmark(evaluation: Evaluation, selectors: dict[str, Callable[[], list[str]]], truth: list[str], features: list[str]) -> DataFrame:
    """(selector, features, seconds, train_score, valid_score, selection_accuracy) of each selector's choice."""
    rows = []
    for name, choose in selectors.items():
        began = time.perf_counter()
        chosen = choose()
        took = time.perf_counter() - began
        train, valid = evaluation.both(chosen)
        rows.append((name, ",".join(sorted(chosen)), took, float(train), float(valid), selection_accuracy(chosen, truth, features)))
    kinds = "selector string, features string, seconds double, train_score double, valid_score double, selection_accuracy double"
    return evaluation.rows.sparkSession.createDataFrame(rows, kinds)


def exhaustive(evaluation: Evaluation, features: list[str], most: int = 12) -> list[str]:
    """The best of all non-empty subsets; more than ``most`` features raise ValueError."""
    if len(features) > most:
        raise ValueError(f"{len(features)} features have too many subsets")
    options = [list(s) for n in range(1, len(features) + 1) for s in itertools.combinations(features, n)]
    scores = evaluation.many(options)
    return options[scores.index(max(scores))]


def _importances(evaluation: Evaluation, features: list[str], values: list[float]) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(float(v)).alias("importance")) for f, v in zip(features, values)])
    return metrics.dense_rank_features(evaluation.rows.sparkSession.range(1).select(F.explode(rows).alias("r")).select("r.*"), "feature", "importance")


def leave_one_feature_out(evaluation: Evaluation, features: list[str]) -> DataFrame:
    """(feature, importance, scaled, rank): the score with all features less that without one."""
    base = evaluation.score(features)
    return _importances(evaluation, features, [base - s for s in evaluation.many([[f for f in features if f != g] for g in features])])


def perturbation(evaluation: Evaluation, features: list[str], n_repeats: int = 5, cumulative: bool = False, seed: int = 17) -> DataFrame:
    """The score less that with uniform noise of up to a feature's median added to it; one fit, then predictions only."""
    assembler = VectorAssembler(inputCols=features, outputCol="__features")
    cut = int(evaluation.rows.count() * evaluation.train_share)
    train, test = evaluation.rows.filter(F.col("row_id") < cut), evaluation.rows.filter(F.col("row_id") >= cut)
    model = evaluation.estimator.copy().setFeaturesCol("__features").setLabelCol(evaluation.label).fit(assembler.transform(train))
    base = score_of(model.transform(assembler.transform(test)), evaluation.label, evaluation.metric)
    medians = [q[0] for q in exact_quantiles(evaluation.rows, features, [0.5]).values()]
    values = []
    for i, f in enumerate(features):
        total, noisy = 0.0, F.col(f).cast("double")
        for r in range(n_repeats):
            unit = F.pmod(F.xxhash64("row_id", F.lit(seed + 1000 * i + r)), F.lit(1 << 30)) / (1 << 30)  # the same noise in each run
            noisy = (noisy if cumulative else F.col(f).cast("double")) + (unit * 2 - 1) * F.lit(float(medians[i]))
            total += score_of(model.transform(assembler.transform(test.withColumn(f, noisy))), evaluation.label, evaluation.metric)
        values.append(base - total / n_repeats)
    return _importances(evaluation, features, values)


def rfe_mutual_information(evaluation: Evaluation, features: list[str], information: dict[str, float]) -> list[str]:
    """Remove the feature of least mutual information step by step; the set that scores best."""
    order = sorted(features, key=lambda f: (information[f], f))
    options = [[f for f in features if f not in order[:k]] for k in range(len(features))]
    scores = evaluation.many(options)
    return options[scores.index(max(scores))]


def boruta_limits(n: int, alpha: float = 0.05) -> tuple[int, int]:
    """Hits below the first are unimportant, above the second important: the tails of a fair binomial."""
    total, low = 0.0, 0
    for k in range(n + 1):
        total += binomial_pmf(k, n)
        if total >= alpha:
            low = k
            break
    return low, n - low


def _with_shadows(rows: DataFrame, features: list[str], n: int, seed: int) -> DataFrame:
    """The ``n`` ``rows`` with __shadow0, __shadow1, ...: each feature's value of the row whose id has the same place in a hash order.

    Hashes are spread evenly, so ranges of them need no quantiles. All features are placed in one shuffle and come back to
    their rows in another; only the ranges' totals are broadcast, never a table with a row per row.
    """
    parts = max(1, min(MOST_RANGES, -(-n // ROWS_PER_RANGE)))
    each = F.array(*[F.struct(F.lit(i).alias("i"), F.col(f).cast("double").alias("v")) for i, f in enumerate(features)])
    values = rows.select(F.col("row_id").alias("r"), F.explode(each).alias("x")).select("r", "x.*")
    values = values.withColumn("o", F.xxhash64("r", F.col("i") + F.lit(seed)).cast("double"))
    values = values.withColumn("part", F.least(F.floor((F.col("o") / 2.0**64 + 0.5) * parts), F.lit(parts - 1)).cast("int"))
    upto = Window.partitionBy("i").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # at most as many rows as ranges
    before = values.groupBy("i", "part").agg(F.count("*").alias("w")).select("i", "part", F.coalesce(F.sum("w").over(upto), F.lit(0)).alias("before"))
    placed = values.withColumn("nth", F.row_number().over(Window.partitionBy("i", "part").orderBy("o", "r")) - 1).join(F.broadcast(before), ["i", "part"])
    moved = placed.groupBy((F.col("before") + F.col("nth")).cast("long").alias("row_id"))
    moved = moved.agg(*[F.max(F.when(F.col("i") == i, F.col("v"))).alias(f"__shadow{i}") for i in range(len(features))])
    return rows.hint("merge").join(moved, "row_id")


def boruta(evaluation: Evaluation, features: list[str], max_iter: int = 20, seed: int = 17) -> DataFrame:
    """(feature, hits, verdict): how often a feature's importance exceeds that of all shuffled copies.

    The estimator's model must have featureImportances or coefficients. A shuffled copy takes the value of the row whose
    id has the same place in another hash order: a join on places, not a sort in one task. Each iteration's table is written
    for its fit and removed after it.
    """
    hits = dict.fromkeys(features, 0)
    rows = evaluation.rows.select("row_id", evaluation.label, *features)
    n = rows.count()
    names = [*features, *[f"__shadow{i}" for i in range(len(features))]]
    assembler = VectorAssembler(inputCols=names, outputCol="__features")
    for it in range(max_iter):
        with scratch(rows.sparkSession):
            table = materialize(_with_shadows(rows, features, n, seed + it * 1000), "shadows")
            model = evaluation.estimator.copy().setFeaturesCol("__features").setLabelCol(evaluation.label).fit(assembler.transform(table))
        values = [abs(float(v)) for v in (model.featureImportances if hasattr(model, "featureImportances") else model.coefficients).toArray()]
        top = max(values[len(features) :])
        for f, v in zip(features, values):
            hits[f] += v > top
    low, high = boruta_limits(max_iter)
    verdict = lambda h: "important" if h > high else "unimportant" if h < low else "maybe"
    return evaluation.rows.sparkSession.createDataFrame([(f, h, verdict(h)) for f, h in hits.items()], "feature string, hits int, verdict string")


def random_parameter(rng: random.Random, kind: str, values) -> object:
    """One draw: ``categorical`` from a list, ``float`` or ``int`` from (low, high), the ends included."""
    if kind == "categorical":
        return rng.choice(list(values))
    if kind == "float":
        return rng.uniform(*values)
    if kind == "int":
        return rng.randint(*values)
    raise ValueError(f"unknown kind {kind!r}")


def random_search(evaluation: Evaluation, features: list[str], space: dict[str, tuple], n_trials: int = 10, seed: int = 17) -> DataFrame:
    """(trial, params, train_score, valid_score), the best first; trials are independent draws and all folds serve each."""
    rng = random.Random(seed)
    draws = [{k: random_parameter(rng, kind, values) for k, (kind, values) in space.items()} for _ in range(n_trials)]
    with ThreadPoolExecutor(evaluation.parallel) as pool:
        scores = list(pool.map(lambda p: evaluation.both(features, p), draws))
    rows = [(i, str(p), float(t), float(v)) for i, (p, (t, v)) in enumerate(zip(draws, scores))]
    return evaluation.rows.sparkSession.createDataFrame(rows, "trial int, params string, train_score double, valid_score double").orderBy(F.desc("valid_score"), "trial")


def components_curve(evaluation: Evaluation, features: list[str], ks: list[int]) -> DataFrame:
    """(k, train_score, valid_score) of the first k principal components; components come from all rows' covariance."""
    from dataclasses import replace

    from granary.operators.reduce import fit_pca

    rows = []
    for k in ks:
        scored = fit_pca(evaluation.rows, features, k).transform(evaluation.rows, "pc")
        train, valid = replace(evaluation, rows=scored, scores={}).both([f"pc{i}" for i in range(k)])
        rows.append((k, float(train), float(valid)))
    return evaluation.rows.sparkSession.createDataFrame(rows, "k int, train_score double, valid_score double")


def selection_accuracy(chosen: list[str], truth: list[str], features: list[str]) -> float:
    """Share of features on which the choice and the truth agree."""
    return sum((f in chosen) == (f in truth) for f in features) / len(features)


def combinations(features: list[str], value: Callable[[tuple], float]) -> dict[tuple, float]:
    """``value`` of every subset of features."""
    return {s: value(s) for n in range(len(features) + 1) for s in itertools.combinations(features, n)}


def shapley(features: list[str], value: Callable[[tuple], float]) -> dict[str, float]:
    """Exact Shapley values of a set function."""
    v, m = combinations(features, value), len(features)
    return {f: sum((v[tuple(x for x in features if x in s or x == f)] - v[s]) / (m * math.comb(m - 1, len(s))) for s in v if f not in s) for f in features}
