"""Shapley values of linear and tree models, as columns."""

from __future__ import annotations

import itertools
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def linear_shap(df: DataFrame, cols: list[str], coefficients: list[float]) -> DataFrame:
    """``shap_<column>`` = coefficient * (value - mean): for a linear model the closed form of the exact values."""
    means = df.agg(*[F.avg(c) for c in cols]).first()
    return df.withColumns({f"shap_{c}": F.lit(float(b)) * (F.col(c).cast("double") - F.lit(float(m))) for c, b, m in zip(cols, coefficients, means)})


def tree_nodes(model) -> list[tuple]:
    """(feature, threshold, left, right, rows, value) of a pyspark.ml tree model, children as places in the list."""
    nodes: list = []

    def visit(node) -> int:
        place = len(nodes)
        nodes.append(None)
        rows = float(node.impurityStats().count())
        if node.numDescendants() == 0:
            nodes[place] = (-1, 0.0, -1, -1, rows, float(node.prediction()))
        else:
            split = node.split()
            nodes[place] = (split.featureIndex(), float(split.threshold()), visit(node.leftChild()), visit(node.rightChild()), rows, float(node.prediction()))
        return place

    visit(model._call_java("rootNode"))
    return nodes


def tree_shap(df: DataFrame, cols: list[str], nodes: list[tuple], most: int = 12) -> DataFrame:
    """``shap_<column>`` by all coalitions: a split on an absent feature averages both children by their rows.

    The tree travels with the task; rows are scored in batches, all at once for each coalition. Costs 2^features
    evaluations, so more than ``most`` used features raise ValueError; features that no split uses have 0.
    """
    used = sorted({n[0] for n in nodes if n[0] >= 0})
    if len(used) > most:
        raise ValueError(f"a tree on {len(used)} features has too many coalitions")
    m = len(used)

    def values(x: np.ndarray, present: frozenset) -> np.ndarray:
        def at(place: int) -> np.ndarray:
            f, cut, left, right, _, value = nodes[place]
            if f < 0:
                return np.full(len(x), value)
            a, b = at(left), at(right)
            if f in present:
                return np.where(x[:, f] <= cut, a, b)
            return (nodes[left][4] * a + nodes[right][4] * b) / (nodes[left][4] + nodes[right][4])

        return at(0)

    def explained(parts):
        for pdf in parts:
            x = pdf[cols].to_numpy(float)
            v = {frozenset(s): values(x, frozenset(s)) for n in range(m + 1) for s in itertools.combinations(used, n)}
            out = {f"shap_{c}": np.zeros(len(x)) for c in cols}
            for f in used:
                out[f"shap_{cols[f]}"] = sum(((v[s | {f}] - v[s]) / (m * math.comb(m - 1, len(s))) for s in v if f not in s), np.zeros(len(x)))
            yield pdf.assign(**out)

    fields = ", ".join(f"`{n}` {t}" for n, t in df.dtypes) + "".join(f", `shap_{c}` double" for c in cols)
    return df.mapInPandas(explained, fields)


def input_gradients(df: DataFrame, cols: list[str], coefficients: list[float], y: str, p: str, loss: str = "mse") -> DataFrame:
    """``grad_<column>``: the gradient of the mean loss with respect to a linear model's inputs."""
    n = df.count()
    gap = F.col(p).cast("double") - F.col(y).cast("double")
    if loss not in ("mse", "mae"):
        raise ValueError(f"unknown loss {loss!r}")
    slope = 2 * gap / n if loss == "mse" else F.signum(gap) / n
    return df.withColumns({f"grad_{c}": slope * F.lit(float(b)) for c, b in zip(cols, coefficients)})
