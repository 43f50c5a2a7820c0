"""Exact nearest neighbours without all pairs of rows: a bound on each point's reach, then a join on grid cells."""

from __future__ import annotations

from functools import reduce as fold

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.columns import numeric
from granary.functions.order import bounds_of, range_of
from granary.functions.storage import materialize

#: Metrics in which no coordinate's gap exceeds the distance, so that a grid can tell far points apart.
GRID_METRICS = ("euclidean", "manhattan", "chebyshev")
#: Coordinates that the grid and the curve use, and the digits of a place on the curve.
GRID_COLUMNS, DIGITS = 3, 60


def gap(x: Column, y: Column, n: int, metric: str) -> Column:
    """Distance of two arrays of ``n`` doubles as plain arithmetic, so that it stays in generated code."""
    gaps = [F.abs(F.get(x, F.lit(i)) - F.get(y, F.lit(i))) for i in range(n)]
    if metric == "euclidean":
        return F.sqrt(fold(lambda a, b: a + b, [g * g for g in gaps]))
    if metric == "manhattan":
        return fold(lambda a, b: a + b, gaps)
    if metric == "chebyshev":
        return F.greatest(*gaps) if n > 1 else gaps[0]
    raise ValueError(f"unknown metric {metric!r}")


def _curve(cells: list[Column]) -> Column:
    """Place on the Z-order curve: the binary digits of the cells' numbers in turn."""
    g = len(cells)
    bits = [F.shiftleft(F.shiftright(c, b).bitwiseAND(F.lit(1).cast("long")), b * g + i) for i, c in enumerate(cells) for b in range(DIGITS // g)]
    return fold(lambda a, b: a.bitwiseOR(b), bits)


def near_lists(df: DataFrame, key: str, cols: list[str], k: int, metric: str = "euclidean", by: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """The rows (a, c, x), their points (p, c, x, keys), and of each point (p, c, x, near): its k + 1 nearest rows (d, b), sorted.

    ``p`` is a point's least key, ``keys`` its first k + 1 keys. ``key`` is unique. Rows with a null or NaN in ``cols`` or
    ``by`` are left out; without rows there are no lists. Equal rows are one point, of which k + 1 keys can matter, so any
    number of copies costs nothing. Points next to each other on a Z-order curve give each point a reach within which k
    others lie for sure. Points within reach meet on a grid whose cells are the least power of two above the reach, at
    most three a column, on the first three columns. So a point is compared with those of its cells; it is many only for
    a point far out whose reach holds a dense region. What has met is sorted by the number ``p``, not by values.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    if metric not in GRID_METRICS:
        raise ValueError(f"unknown metric {metric!r}")
    n, g = len(cols), min(GRID_COLUMNS, len(cols))
    values = [F.col(c).cast("double") for c in numeric(df, cols)]
    whole = fold(lambda a, b: a & b, [v.isNotNull() & ~F.isnan(v) for v in values])
    group = F.lit(0) if by is None else F.col(by)
    rows = df.filter(whole & group.isNotNull()).select(F.col(key).alias("a"), group.alias("c"), F.array(*[v + 0.0 for v in values]).alias("x"))

    first = rows.withColumn("nth", F.row_number().over(Window.partitionBy("c", "x").orderBy("a"))).filter(F.col("nth") <= k + 1)
    grouped = first.groupBy("c", "x").agg(F.array_sort(F.collect_list("a")).alias("keys"))
    points = materialize(grouped.select(F.get("keys", F.lit(0)).alias("p"), "c", "x", "keys"), "near-points")
    at = [F.get("x", F.lit(i)) for i in range(n)]
    ends = points.agg(*[f(v) for v in at for f in (F.min, F.max)]).first()
    if ends[0] is None:
        return rows, points, None
    low, wide = ends[0::2], [ends[2 * i + 1] - ends[2 * i] for i in range(n)]
    unit = max(wide[:g]) / ((1 << DIGITS // g) - 1)  # one for all columns: the curve follows distances
    curve = _curve([F.floor((at[i] - F.lit(low[i])) / F.lit(unit)).cast("long") if unit else F.lit(0).cast("long") for i in range(g)])
    placed = points.withColumn("z", curve)
    placed = placed.withColumn("part", range_of(F.col("z").cast("double"), bounds_of(placed, F.col("z"))))

    span = 2 * (k + 1)
    beside = F.collect_list("x").over(Window.partitionBy("c", "part").orderBy("z", "x").rowsBetween(-span, span))
    gaps = F.array_sort(F.transform(beside, lambda y: gap(F.col("x"), y, n, metric)))
    everything = sum(wide) or 1.0  # no two points are farther apart
    reach = F.coalesce(F.get(gaps, F.lit(k)), F.lit(everything))
    # a little more than the reach, so that rounding loses no point
    reach = reach * (1 + 1e-9) + fold(lambda a, b: a + b, [F.abs(v) for v in at]) * 1e-14
    level = F.ceil(F.log2("e")).cast("int")
    asked = materialize(placed.select("p", "c", "x", reach.alias("e")).withColumn("level", level), "near-reach")
    levels = [r[0] for r in asked.select("level").distinct().collect()]  # exponents of doubles: a bounded number

    cell = lambda v: F.floor(v / F.pow(F.lit(2.0), F.col("level"))).cast("long")
    given = points.select("c", F.col("x").alias("y"), "keys", F.explode(F.array(*[F.lit(v) for v in levels])).alias("level"))
    given = given.withColumns({f"g{i}": cell(F.get("y", F.lit(i))) for i in range(g)})
    for i in range(g):
        asked = asked.withColumn(f"g{i}", F.explode(F.sequence(cell(at[i] - F.col("e")), cell(at[i] + F.col("e")))))
    inside = fold(lambda a, b: a & b, [F.abs(F.get("x", F.lit(i)) - F.get("y", F.lit(i))) <= F.col("e") for i in range(g)])
    # a small file of points is a large table once each point stands on each level: it is not broadcast
    met = asked.join(given.hint("merge"), ["c", "level", *[f"g{i}" for i in range(g)]]).filter(inside)
    met = met.select("p", "c", "x", "e", "keys", gap(F.col("x"), F.col("y"), n, metric).alias("d")).filter(F.col("d") <= F.col("e"))
    found = met.select("p", "c", "x", "d", F.explode("keys").alias("b"))
    found = found.withColumn("nth", F.row_number().over(Window.partitionBy("p").orderBy("d", "b"))).filter(F.col("nth") <= k + 1)
    return rows, points, found.groupBy("p", "c", "x").agg(F.array_sort(F.collect_list(F.struct("d", "b"))).alias("near"))


def nearest(df: DataFrame, key: str, cols: list[str], k: int, metric: str = "euclidean", by: str | None = None) -> DataFrame:
    """(a, b, d, r): the ``k`` nearest other rows ``b`` of each row ``a``, by distance, then key; r counts from 1.

    With ``by``, neighbours share its value. ``key`` is unique. Rows with a null or NaN in ``cols`` or ``by`` are left
    out; where fewer than ``k`` others exist, all of them are returned. How: :func:`near_lists`.
    """
    rows, _, lists = near_lists(df, key, cols, k, metric, by)
    if lists is None:
        return rows.select("a", F.col("a").alias("b"), F.lit(0.0).alias("d"), F.lit(1).alias("r")).filter(F.lit(False))
    others = F.slice(F.filter("near", lambda o: o["b"] != F.col("a")), 1, k)
    each = rows.join(lists.drop("p"), ["c", "x"]).select("a", F.posexplode(others).alias("place", "o"))
    return each.select("a", F.col("o")["b"].alias("b"), F.col("o")["d"].alias("d"), (F.col("place") + 1).alias("r"))
