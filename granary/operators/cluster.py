"""Clustering: k-means, DBSCAN and agglomerative merges, with the numbers by which clusterings are judged."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce as fold

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.columns import numeric
from granary.functions.order import with_row_id
from granary.functions.storage import materialize
from granary.operators.nearby import gap
from granary.operators.outliers import distance


def _vector(cols: list[str]) -> Column:
    return F.array(*[F.col(c).cast("double") for c in cols])


def _squared(v: Column, center: list[float]) -> Column:
    total = F.lit(0.0)
    for i, c in enumerate(center):
        d = F.get(v, F.lit(i)) - F.lit(float(c))
        total = total + d * d
    return total


@dataclass
class KMeansModel:
    cols: list[str]
    centers: list[list[float]]

    def transform(self, df: DataFrame) -> DataFrame:
        """``cluster`` (0-based, ties to the first center) and ``squared_distance``; the centers are literals."""
        near = F.array_min(F.array(*[F.struct(_squared(_vector(self.cols), c).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(self.centers)]))
        return df.withColumn("__near", near).withColumns({"cluster": F.col("__near")["i"], "squared_distance": F.col("__near")["d"]}).drop("__near")

    def step(self, df: DataFrame) -> KMeansModel:
        """One Lloyd step; a center without rows stays."""
        means = {r["cluster"]: [r[f"m{i}"] for i in range(len(self.cols))] for r in self.transform(df).groupBy("cluster").agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(self.cols)]).collect()}
        return KMeansModel(self.cols, [means.get(i, c) for i, c in enumerate(self.centers)])

    def sse(self, df: DataFrame) -> float:
        return self.transform(df).agg(F.sum("squared_distance")).first()[0] or 0.0


def fit_kmeans(df: DataFrame, cols: list[str], k: int = 8, n_init: int = 10, max_iter: int = 300, tol: float = 1e-4, seed: int = 17) -> KMeansModel:
    """The best of ``n_init`` uniform starts in the bounding box by error (judged in one job), then Lloyd steps."""
    numeric(df, cols)
    got = df.agg(*[f(c) for c in cols for f in (F.min, F.max)]).first()
    low, high = np.array(got[::2], float), np.array(got[1::2], float)
    rng = np.random.default_rng(seed)
    starts = [rng.uniform(low, high, (k, len(cols))).tolist() for _ in range(n_init)]
    errors = df.agg(*[F.sum(F.least(*[_squared(_vector(cols), c) for c in s]) if k > 1 else _squared(_vector(cols), s[0])) for s in starts]).first()
    model = KMeansModel(cols, starts[int(np.argmin([e if e is not None else math.inf for e in errors]))])
    for _ in range(max_iter):
        after = model.step(df)
        moved = float(np.abs(np.array(after.centers) - np.array(model.centers)).sum())
        model = after
        if moved < tol:
            break
    return model


def cluster_sse(df: DataFrame, cols: list[str], cluster: str) -> DataFrame:
    """(cluster, n, sse) around each cluster's own mean."""
    return df.groupBy(F.col(cluster).alias("cluster")).agg(F.count("*").alias("n"), sum((F.var_pop(F.col(c).cast("double")) for c in cols), F.lit(0.0)).alias("v")).select("cluster", "n", (F.col("v") * F.col("n")).alias("sse"))


def sse_by_k(df: DataFrame, cols: list[str], ks: list[int], **options) -> DataFrame:
    """(k, sse): one fit per k."""
    rows = [(k, float(fit_kmeans(df, cols, k, **options).sse(df))) for k in ks]
    return df.sparkSession.range(1).select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(s).alias("sse")) for k, s in rows])).alias("r")).select("r.*")


def gap_statistic(df: DataFrame, cols: list[str], ks: list[int], n_references: int = 5, seed: int = 17, **options) -> DataFrame:
    """(k, gap, sd, chosen) against uniform references of as many rows in the bounding box."""
    n = df.count()
    got = df.agg(*[f(c) for c in cols for f in (F.min, F.max)]).first()
    rows = []
    for k in ks:
        logs = []
        for r in range(n_references):
            reference = df.sparkSession.range(n).select(*[(F.lit(float(got[2 * i])) + F.rand(seed + 1000 * r + i) * F.lit(float(got[2 * i + 1]) - float(got[2 * i]))).alias(c) for i, c in enumerate(cols)])
            logs.append(math.log(max(fit_kmeans(reference, cols, k, **options).sse(reference), 1e-300)))
        own = math.log(max(fit_kmeans(df, cols, k, **options).sse(df), 1e-300))
        rows.append((k, float(math.log(np.mean(np.exp(logs))) - own), float(np.std(logs))))
    chosen = next((rows[i][0] for i in range(len(rows) - 1) if rows[i][1] >= rows[i + 1][1] - rows[i + 1][2]), rows[-1][0])
    return df.sparkSession.range(1).select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(g).alias("gap"), F.lit(s).alias("sd"), F.lit(k == chosen).alias("chosen")) for k, g, s in rows])).alias("r")).select("r.*")


#: Points of a cell that one unit of work compares with those around it, and the most partitions for that.
UNIT, MOST_PARTS = 512, 512


def _whole(cols: list[str]) -> Column:
    return fold(lambda a, b: a & b, [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in cols])


def _points(df: DataFrame, key: str, cols: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows (a, x), x null where a coordinate is null or NaN, and distinct points (x, w, a): their rows and least key."""
    values = F.array(*[F.col(c).cast("double") + 0.0 for c in numeric(df, cols)])
    rows = df.select(F.col(key).alias("a"), F.when(_whole(cols), values).alias("x"))
    return rows, materialize(rows.filter("x IS NOT NULL").groupBy("x").agg(F.count("*").alias("w"), F.min("a").alias("a")), "points")


def _meetings(one: DataFrame, two: DataFrame, dims: int, epsilon: float) -> DataFrame:
    """All columns of ``one`` (x, ...) and ``two`` (y, ...) for pairs within ``epsilon``, with their distance d; not for writing.

    They meet on cells of an ``epsilon`` grid over the first columns (three at most) and their neighbours. A cell with many
    points of ``one`` is dealt out over units, to each of which all of ``two`` around it goes. The partitions are fixed: by
    bytes, which are few, the work would end up in one task.
    """
    g = [f"g{i}" for i in range(min(3, dims))]
    cell = lambda v, i: F.floor(F.get(v, F.lit(i)) / F.lit(epsilon)).cast("long")
    one = one.withColumns({c: cell(F.col("x"), i) for i, c in enumerate(g)})
    units = one.groupBy(*g).agg(F.ceil(F.count("*") / UNIT).cast("int").alias("units"))
    two = two.withColumns({c: cell(F.col("y"), i) for i, c in enumerate(g)})
    for c in g:
        two = two.withColumn(c, F.explode(F.sequence(F.col(c) - 1, F.col(c) + 1)))
    parts = max(8, min(MOST_PARTS, -(-one.count() // UNIT)))
    one = one.join(units, g).withColumn("unit", F.pmod(F.xxhash64("x"), F.col("units")).cast("int")).drop("units").repartition(parts, *g, "unit")
    two = two.join(units, g).withColumn("unit", F.explode(F.sequence(F.lit(0), F.col("units") - 1))).drop("units").repartition(parts, *g, "unit")
    met = one.hint("merge").join(two, [*g, "unit"]).withColumn("d", gap(F.col("x"), F.col("y"), dims, "euclidean"))
    return met.filter(F.col("d") <= epsilon).drop(*g, "unit")


def _counted(points: DataFrame, dims: int, epsilon: float) -> DataFrame:
    """``points`` (x, w, a) with n, the rows within ``epsilon``; pairs are summed where they meet."""
    met = _meetings(points.select("x"), points.select(F.col("x").alias("y"), "w"), dims, epsilon)
    return points.join(met.groupBy("x").agg(F.sum("w").alias("n")), "x")


def core_points(df: DataFrame, key: str, cols: list[str], epsilon: float, min_points: int) -> DataFrame:
    """(key, n, core): rows within ``epsilon``, the row itself included; a row with a null or NaN has itself only.

    Equal rows are one point, so copies cost nothing; pairs of points are counted, never written or shuffled.
    """
    rows, points = _points(df, key, cols)
    n = F.coalesce("n", F.lit(1))
    found = rows.join(_counted(points, len(cols), epsilon).select("x", "n"), "x", "left")
    return found.select(F.col("a").alias(key), n.alias("n"), (n >= min_points).alias("core"))


def dbscan(df: DataFrame, key: str, cols: list[str], epsilon: float, min_points: int) -> DataFrame:
    """(key, cluster): clusters are numbered by their least core key; noise is -1.

    Equal rows are one point. Core points in one cell whose diagonal is within ``epsilon`` belong together, so cells are
    linked where two of their core points are close, and linked cells take the least core key among them until none
    changes: links grow with the occupied area, not with pairs of rows. A border row joins the nearest core row's cluster
    (ties: least key), so the result does not depend on an order of visits.
    """
    dims, side = len(cols), epsilon / math.sqrt(len(cols)) * (1 - 1e-9)
    rows, points = _points(df, key, cols)
    counted = materialize(_counted(points, dims, epsilon), "dbscan-points")
    cells = F.transform("x", lambda v: F.floor(v / F.lit(side)).cast("long"))
    core = counted.filter(F.col("n") >= min_points).select("x", "a", cells.alias("h"))
    core = materialize(core.join(core.groupBy("h").agg(F.min("a").alias("cell")), "h").select("x", "cell"), "dbscan-core")
    met = _meetings(core.select("x", F.col("cell").alias("a")), core.select(F.col("x").alias("y"), F.col("cell").alias("b")), dims, epsilon)
    links = materialize(met.filter("a != b").select("a", "b").distinct(), "dbscan-links")
    labels = materialize(core.select(F.col("cell").alias("a"), F.col("cell").alias("label")).distinct(), "dbscan-labels")
    while True:
        near = links.join(labels.withColumnRenamed("a", "b"), "b").groupBy("a").agg(F.min("label").alias("m"))
        least = labels.join(near, "a", "left").select("a", F.col("label").alias("old"), F.least("label", F.coalesce("m", "label")).alias("label"))
        jump = labels.select(F.col("a").alias("label"), F.col("label").alias("next"))
        after = materialize(least.join(jump, "label", "left").select("a", F.least("label", F.coalesce("next", "label")).alias("label"), "old"), "dbscan-labels")
        labels = after.select("a", "label")
        if after.filter("label != old").isEmpty():
            break
    inner = materialize(core.join(labels.withColumnRenamed("a", "cell"), "cell").select("x", "label"), "dbscan-inner")
    rest = counted.filter(F.col("n") < min_points).select("x")
    border = _meetings(rest, inner.select(F.col("x").alias("y"), "label"), dims, epsilon).groupBy("x").agg(F.min(F.struct("d", "label"))["label"].alias("label"))
    found = rows.join(inner.unionByName(border), "x", "left").select("a", F.coalesce("label", F.when(F.col("x").isNull() & F.lit(min_points <= 1), F.col("a"))).alias("label"))
    found = materialize(found, "dbscan-found")
    names = materialize(found.filter("label IS NOT NULL").select("label").distinct(), "dbscan-names")
    number = with_row_id(names, "label", name="c").withColumn("c", F.col("c").cast("int"))
    return found.join(number, "label", "left").select(F.col("a").alias(key), F.coalesce("c", F.lit(-1)).alias("cluster"))


def agglomerate(df: DataFrame, key: str, cols: list[str], metric: str = "euclidean", linkage: str = "ward", most: int = 2000) -> DataFrame:
    """(step, left, right, distance, size): merges of a hierarchical clustering; node n + step is the new cluster.

    The merge order is a chain of n dependent steps on an n by n matrix, which the driver holds: more than ``most`` rows
    raise ValueError. Rows are numbered by key.
    """
    rows = df.select(key, _vector(numeric(df, cols)).alias("v")).orderBy(key).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"agglomerative clustering takes at most {most} rows")
    x = np.array([r["v"] for r in rows], float).reshape(len(rows), -1)
    n = len(x)
    gaps = np.abs(x[:, None] - x[None])
    if metric == "euclidean":
        base = np.sqrt((gaps**2).sum(-1))
    elif metric == "manhattan":
        base = gaps.sum(-1)
    elif metric == "gap_ratio":
        base = gaps.sum(-1) / np.outer(x.sum(1), x.sum(1))
    else:
        raise ValueError(f"unknown metric {metric!r}")
    d = np.full((2 * n, 2 * n), np.inf)
    d[:n, :n] = base
    np.fill_diagonal(d, np.inf)
    size, center = np.ones(2 * n), np.zeros((2 * n, x.shape[1]))
    center[:n] = x
    alive, merges = list(range(n)), []
    for step in range(n - 1):
        sub = d[np.ix_(alive, alive)]
        p = int(np.argmin(sub))
        i, j = sorted((alive[p // len(alive)], alive[p % len(alive)]))
        new = n + step
        size[new], center[new] = size[i] + size[j], (size[i] * center[i] + size[j] * center[j]) / (size[i] + size[j])
        merges.append((step, i, j, float(d[i, j]), int(size[new])))
        alive = [a for a in alive if a not in (i, j)]
        for a in alive:
            if linkage == "single":
                v = min(d[i, a], d[j, a])
            elif linkage == "complete":
                v = max(d[i, a], d[j, a])
            elif linkage == "average":
                v = (size[i] * d[i, a] + size[j] * d[j, a]) / size[new]
            elif linkage == "ward":
                v = math.sqrt(size[new] * size[a] / (size[new] + size[a])) * float(np.sqrt(((center[new] - center[a]) ** 2).sum()))
            else:
                raise ValueError(f"unknown linkage {linkage!r}")
            d[new, a] = d[a, new] = v
        alive.append(new)
    return df.sparkSession.createDataFrame(merges, "step int, left int, right int, distance double, size int")


#: Points of a block; pairs of blocks are the units of work of :func:`distance_sums`.
BLOCK = 8192


def distance_sums(points: DataFrame, cols: list[str], weights: list[str], metric: str) -> DataFrame:
    """(x, sums): for each point the sums of its distances to all points, one for each column of ``weights``.

    All pairs of points are computed, by NumPy in tiles of a block against a block, so a task holds two blocks and a tile,
    whatever the number of points; a block travels to as many tasks as there are blocks.
    """
    d, n = len(cols), len(weights)
    blocks = max(1, -(-points.count() // BLOCK))

    def pack(pdf):
        return pd.DataFrame({"i": [int(pdf["i"].iloc[0])], "p": [pdf[[*cols, *weights]].to_numpy(float).tobytes()]})

    packed = points.select(F.pmod(F.xxhash64(*cols), F.lit(blocks)).cast("int").alias("i"), *cols, *weights).groupBy("i").applyInPandas(pack, "i int, p binary")
    packed = materialize(packed, "blocks")

    def sums(parts):
        for pdf in parts:
            for i, p, q in zip(pdf["i"], pdf["p"], pdf["q"]):
                a, b = np.frombuffer(p).reshape(-1, d + n)[:, :d], np.frombuffer(q).reshape(-1, d + n)
                at, weight, out = np.ascontiguousarray(b[:, :d].T), np.ascontiguousarray(b[:, d:]), np.empty((len(a), n))
                for s in range(0, len(a), 64):
                    gaps = [np.abs(a[s : s + 64, c, None] - at[c]) for c in range(d)]
                    total = fold(np.add, [g * g for g in gaps] if metric == "euclidean" else gaps)
                    out[s : s + 64] = (np.sqrt(total) if metric == "euclidean" else total) @ weight
                yield pd.DataFrame({"i": [i], "t": [out.tobytes()]})

    every, parts = F.sequence(F.lit(0), F.lit(blocks - 1)), min(blocks * blocks, 2000)
    one = packed.withColumn("j", F.explode(every)).repartition(parts, "i", "j")
    two = packed.select(F.col("i").alias("j"), F.col("p").alias("q")).withColumn("i", F.explode(every)).repartition(parts, "i", "j")
    partial = one.hint("merge").join(two, ["i", "j"]).select("i", "p", "q").mapInPandas(sums, "i int, t binary")

    def unpack(own, found):
        total = fold(np.add, [np.frombuffer(t).reshape(-1, n) for t in found["t"]])
        x = np.frombuffer(own["p"].iloc[0]).reshape(-1, d + n)[:, :d]
        return pd.DataFrame({"x": list(x), "sums": list(total)})

    return packed.groupBy("i").cogroup(partial.groupBy("i")).applyInPandas(unpack, "x array<double>, sums array<double>")


def _silhouettes(df: DataFrame, key: str, cols: list[str], clusters: list[str], metric: str) -> DataFrame:
    """(i, c0, a0, b0, c1, ...): mean distances within the own and to the nearest other cluster, for each clustering.

    One pass over the pairs of distinct points serves all clusterings: a point carries its number of rows in each cluster.
    """
    values = F.array(*[F.col(c).cast("double") + 0.0 for c in numeric(df, cols)])
    rows = df.select(F.col(key).alias("i"), F.when(_whole(cols), values).alias("x"), *[F.col(c).alias(f"c{n}") for n, c in enumerate(clusters)])
    rows = materialize(rows, "silhouette-rows")
    known = rows.filter("x IS NOT NULL")
    sizes = [[(r[0], r[1]) for r in known.filter(f"c{n} IS NOT NULL").groupBy(f"c{n}").count().orderBy(f"c{n}").collect()] for n in range(len(clusters))]
    flat = [(n, label) for n, found in enumerate(sizes) for label, _ in found]
    points = known.groupBy("x").agg(*[F.count(F.when(F.col(f"c{n}") == F.lit(label), 1)).alias(f"w{i}") for i, (n, label) in enumerate(flat)])
    points = materialize(points.select(*[F.get("x", F.lit(i)).alias(f"x{i}") for i in range(len(cols))], *[f"w{i}" for i in range(len(flat))]), "silhouette-points")
    sums = distance_sums(points, [f"x{i}" for i in range(len(cols))], [f"w{i}" for i in range(len(flat))], metric)
    joined, out, at = rows.join(sums, "x", "left"), ["i"], 0
    for n, found in enumerate(sizes):
        own, means = F.col(f"c{n}"), []
        a = F.lit(None).cast("double")
        for i, (label, size) in enumerate(found):
            total = F.get("sums", F.lit(at + i))
            a = F.when(own == F.lit(label), total / F.lit(size - 1) if size > 1 else F.lit(None).cast("double")).otherwise(a)
            means.append(F.when(own != F.lit(label), total / F.lit(size)))
        at += len(found)
        out += [own, a.alias(f"a{n}"), (F.array_min(F.array(*means)) if means else F.lit(None).cast("double")).alias(f"b{n}")]
    return joined.select(*out)


def _coefficient(a: Column, b: Column) -> Column:
    return F.when(a.isNull(), 0.0).otherwise((b - a) / F.nullif(F.greatest(a, b), F.lit(0.0)))


def silhouette(df: DataFrame, key: str, cols: list[str], cluster: str, metric: str = "euclidean") -> DataFrame:
    """(key, cluster, a, b, silhouette) by all pairs of rows; 0 for a cluster of one row.

    For ``euclidean`` and ``manhattan``, :func:`distance_sums` of distinct points take the place of pairs of rows, and a row
    with a null or NaN coordinate is no one's neighbour.
    """
    if metric in ("euclidean", "manhattan"):
        found = _silhouettes(df, key, cols, [cluster], metric)
        return found.select(F.col("i").alias(key), F.col("c0").alias(cluster), F.col("a0").alias("a"), F.col("b0").alias("b"), _coefficient(F.col("a0"), F.col("b0")).alias("silhouette"))
    one = df.select(F.col(key).alias("i"), F.col(cluster).alias("c"), _vector(numeric(df, cols)).alias("x"))
    two = one.select(F.col("i").alias("j"), F.col("c").alias("e"), F.col("x").alias("y"))
    means = one.join(two, F.col("i") != F.col("j")).groupBy("i", "c", "e").agg(F.avg(distance(F.col("x"), F.col("y"), metric)).alias("m"))
    sides = means.groupBy("i", "c").agg(F.min(F.when(F.col("c") == F.col("e"), F.col("m"))).alias("a"), F.min(F.when(F.col("c") != F.col("e"), F.col("m"))).alias("b"))
    return sides.select(F.col("i").alias(key), F.col("c").alias(cluster), "a", "b", _coefficient(F.col("a"), F.col("b")).alias("silhouette"))


def k_distances(df: DataFrame, key: str, cols: list[str], min_points: int) -> DataFrame:
    """(key, d, place): mean distance to the min_points - 1 nearest other rows, the largest first."""
    from granary.operators.outliers import neighbours

    near = neighbours(df, key, cols, min_points - 1).groupBy("a").agg(F.avg("d").alias("d")).select(F.col("a").alias(key), "d")
    return with_row_id(near.withColumn("__o", -F.col("d")), "__o", key, name="place").drop("__o")


def best_epsilon(df: DataFrame, key: str, cols: list[str], min_points: int) -> DataFrame:
    """One row: the neighbour distance at which the scaled curve of :func:`k_distances` lies farthest below the diagonal."""
    from granary.operators.metrics import normalized_curve

    scaled = normalized_curve(k_distances(df, key, cols, min_points), "place", "d")
    return scaled.agg(F.max_by("d", F.struct("difference", F.negate("x"))).alias("epsilon"))


def silhouette_by_k(df: DataFrame, key: str, cols: list[str], clusterings: dict[int, str]) -> DataFrame:
    """(k, silhouette): the mean coefficient of each clustering, a column of ``df`` by number of clusters."""
    found = _silhouettes(df, key, cols, list(clusterings.values()), "euclidean")
    means = found.agg(*[F.avg(_coefficient(F.col(f"a{n}"), F.col(f"b{n}"))).alias(f"s{n}") for n in range(len(clusterings))])
    each = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"s{n}").alias("silhouette")) for n, k in enumerate(clusterings)])
    return means.select(F.explode(each).alias("r")).select("r.*")


def leaf_counts(merges: DataFrame) -> DataFrame:
    """(step, left_leaves, right_leaves, leaves) of the merges of :func:`agglomerate`: rows under each branch."""
    n = merges.count() + 1
    sizes = merges.select((F.col("step") + n).alias("node"), F.col("size").alias("of"))
    side = lambda rows, name: rows.join(F.broadcast(sizes), F.col(name) == F.col("node"), "left").withColumn(f"{name}_leaves", F.coalesce("of", F.lit(1))).drop("node", "of")
    return side(side(merges, "left"), "right").select("step", "left_leaves", "right_leaves", F.col("size").alias("leaves"))
