"""Global order without a single-task window: ranges by quantiles, windows within ranges, and the ranges' totals."""

from __future__ import annotations

from functools import reduce as fold

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.storage import materialize

ROWS_PER_RANGE, MOST_RANGES = 200_000, 16_384


def share_of(*keys) -> Column:
    """In [0, 1), from the MD5 of whole numbers (columns or literals): the same in any engine, and spread evenly."""
    parts = [k if isinstance(k, Column) else F.col(k) if isinstance(k, str) else F.lit(k) for k in keys]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("double") / float(1 << 52)


def bounds_of(df: DataFrame, key: Column, rows: int = ROWS_PER_RANGE) -> list[float]:
    """Cuts of a numeric ``key`` into ranges of about ``rows`` rows, ascending; the rows' number is not collected."""
    one = df.select(key.cast("double").alias("k"))
    n, least = one.agg(F.count("k"), F.min("k")).first()
    parts = min(MOST_RANGES, -(-n // rows))
    if parts < 2:
        return []
    cuts = one.agg(F.percentile_approx("k", [i / parts for i in range(1, parts)], max(10_000, 20 * parts))).first()[0]
    return sorted({x for x in cuts if x > least})


def range_of(key: Column, bounds: list) -> Column:
    """The number of ``bounds`` (ascending, of the key's own kind) at or below ``key``; nulls belong to the first range.

    Plain comparisons of up to 16 bounds; beyond, a binary search in one array, so that a row costs the logarithm of their number.
    """
    if not bounds:
        return F.lit(0)
    if len(bounds) <= 16:
        found = F.size(F.array_remove(F.array(*[key >= F.lit(b) for b in bounds]), F.lit(False)))
    else:
        cuts, steps = F.array(*[F.lit(b) for b in bounds]), [1 << i for i in reversed(range(len(bounds).bit_length()))]
        # beyond the last bound ``get`` is null, which is not at or below any key
        at_or_below = lambda n, step: F.coalesce(key >= F.get(cuts, n + step - 1), F.lit(False))
        found = F.aggregate(F.array(*[F.lit(i) for i in steps]), F.lit(0), lambda n, step: F.when(at_or_below(n, step), n + step).otherwise(n))
    return F.when(key.isNull(), 0).otherwise(found).cast("int")


def _before(df: DataFrame, weight: Column) -> DataFrame:
    """(range, before): the sum of ``weight`` in all lower ranges; a row per range."""
    totals = df.groupBy("__range").agg(F.sum(weight).alias("__w"))
    upto = Window.partitionBy(F.lit(0)).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # a bounded number of rows
    return totals.select("__range", F.coalesce(F.sum("__w").over(upto), F.lit(0)).alias("__before"))


def with_row_id(df: DataFrame, *order: str, name: str = "row_id") -> DataFrame:
    """``df`` with a 0-based position in the order of the columns ``order``, of which the first is numeric."""
    rows = df.withColumn("__range", range_of(F.col(order[0]).cast("double"), bounds_of(df, F.col(order[0]))))
    placed = rows.withColumn("__nth", F.row_number().over(Window.partitionBy("__range").orderBy(*order)) - 1)
    placed = placed.join(F.broadcast(_before(rows, F.lit(1))), "__range")
    return placed.withColumn(name, (F.col("__before") + F.col("__nth")).cast("long")).drop("__range", "__nth", "__before")


def rows_at(df: DataFrame, order: list[str], places: list[int], part: Column | None = None) -> list[tuple]:
    """Values of the columns ``order`` of the rows at 0-based ``places`` of that order, ascending; places without a row are left out.

    Rows are counted by ranges of the first column, which is numeric, and only ranges that hold a place are sorted. ``part``
    is the number of a row's range, where ranges are known beforehand.
    """
    if part is None:
        part = range_of(F.col(order[0]).cast("double"), bounds_of(df, F.col(order[0])))
    rows = df.select(*order, part.alias("__range"))
    wanted, below = [], 0
    for number, size in sorted(map(tuple, rows.groupBy("__range").count().collect())):
        wanted += [(number, p - below) for p in sorted(set(places)) if below <= p < below + size]
        below += size
    if not wanted:
        return []
    held = rows.filter(F.col("__range").isin(sorted({number for number, _ in wanted})))
    placed = held.withColumn("__nth", F.row_number().over(Window.partitionBy("__range").orderBy(*order)) - 1)
    hit = fold(lambda a, b: a | b, [(F.col("__range") == number) & (F.col("__nth") == nth) for number, nth in wanted])
    found = {(r["__range"], r["__nth"]): tuple(r[c] for c in order) for r in placed.filter(hit).collect()}
    return [found[w] for w in wanted]


def value_ranks(df: DataFrame, column: str, weight: Column | None = None) -> DataFrame:
    """(value, n, below): each distinct value of ``column``, its rows and the rows with lesser values; nulls are left out.

    With ``weight`` its sums take the place of numbers of rows; a place of weight 0 gets a rank and counts for nothing.
    """
    size = F.count("*") if weight is None else F.sum(weight)
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(size.alias("n"))
    rows = counts.withColumn("__range", range_of(F.col("value").cast("double"), bounds_of(counts, F.col("value"))))
    run = F.sum("n").over(Window.partitionBy("__range").orderBy("value").rowsBetween(Window.unboundedPreceding, -1))
    rows_ = rows.withColumn("__run", F.coalesce(run, F.lit(0))).join(F.broadcast(_before(rows, F.col("n"))), "__range")
    return rows_.select("value", "n", (F.col("__before") + F.col("__run")).cast("long").alias("below"))


def count_near(df: DataFrame, column: str, radius: str, name: str) -> DataFrame:
    """``df`` with the number of rows whose ``column`` is nearer than ``radius`` to the row's own, itself included.

    0 where the radius is 0. Values at a distance of ``radius`` up to one part in 10^12 count as not nearer, so that
    rounding in the sum of value and radius cannot decide. Ranks, not pairs, are compared; nulls get null.
    """
    x, r = F.col(column).cast("double"), F.col(radius).cast("double")
    slack = F.least((F.abs(x) + r) * 1e-12, r / 2)
    ends = df.withColumns({"__low": x - r + slack, "__high": x + r - slack})
    places = ends.select(F.explode(F.array(*[F.struct(v.alias("v"), F.lit(w).alias("w")) for v, w in ((x, 1), (F.col("__low"), 0), (F.col("__high"), 0))])).alias("p")).select("p.*")
    ranks = value_ranks(places, "v", F.col("w"))
    out = ends.join(ranks.select(F.col("value").alias("__low"), F.col("below").alias("__under")), "__low", "left")
    out = out.join(ranks.select(F.col("value").alias("__high"), (F.col("below") + F.col("n")).alias("__upto")), "__high", "left")
    return out.withColumn(name, F.when(r > 0, F.col("__upto") - F.col("__under")).when(r == 0, 0)).drop("__low", "__high", "__under", "__upto")


def with_rank(df: DataFrame, column: str, name: str, kind: str = "average") -> DataFrame:
    """``df`` with the rank of ``column``: ``average`` of ties, or ``ecdf`` (share of rows at or below)."""
    ranks = value_ranks(df, column)
    if kind == "average":
        rank = F.col("below") + (F.col("n") + 1) / 2
    else:
        total = df.agg(F.count(column)).first()[0]
        rank = (F.col("below") + F.col("n")) / F.lit(max(total, 1))
    found = ranks.select(F.col("value").alias("__value"), rank.cast("double").alias(name))
    return df.join(found, F.col(column) == F.col("__value"), "left").drop("__value")


#: Up to so many rows a column's exact quantiles come from one aggregate, which holds its distinct values in one task.
MOST_IN_ONE_TASK = 5_000_000


def exact_quantiles(df: DataFrame, cols: list[str], shares: list[float], most: int = MOST_IN_ONE_TASK) -> dict[str, list[float | None]]:
    """Linearly interpolated quantiles of columns, nulls left out; None for a column without values.

    Beyond ``most`` rows they are read off the distributed table of distinct values with their ranks: the same values,
    without a task that holds a column.
    """
    doubles = df.select(*[F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
    counts = doubles.agg(*[F.count(f"c{i}") for i in range(len(cols))]).first()
    if max(counts, default=0) <= most:
        at = F.array(*[F.lit(float(q)) for q in shares])
        got = doubles.agg(*[F.percentile(f"c{i}", at) for i in range(len(cols))]).first()
        return {c: list(got[i]) if got[i] is not None else [None] * len(shares) for i, c in enumerate(cols)}
    out = {}
    for i, c in enumerate(cols):
        n = counts[i]
        places = [q * (n - 1) for q in shares]
        needed = sorted({int(p) for p in places} | {min(int(p) + 1, n - 1) for p in places}) if n else []
        ranks = value_ranks(doubles.select(f"c{i}"), f"c{i}")
        hit = F.filter(F.array(*[F.lit(k).cast("long") for k in needed]), lambda k: (k >= F.col("below")) & (k < F.col("below") + F.col("n")))
        rows = ranks.withColumn("hit", hit).filter(F.size("hit") > 0).select("value", F.explode("hit").alias("k")).collect() if n else []
        value = {r.k: r.value for r in rows}
        out[c] = [value[int(p)] + (p - int(p)) * (value[min(int(p) + 1, n - 1)] - value[int(p)]) if n else None for p in places]
    return out


def group_quantiles(df: DataFrame, c: str, shares: list[float], by: str | None = None) -> DataFrame:
    """(group, q0, q1, ...): linearly interpolated quantiles of ``c`` in each group of ``by``, or in the one group 0.

    Read off distinct values with their numbers of rows, ranked in ranges: no task holds a group. Null is a group of its
    own; null values are left out, and a group without values has no row.
    """
    rows = df.select((F.lit(0) if by is None else F.col(by)).alias("group"), F.col(c).cast("double").alias("v")).filter("v IS NOT NULL")
    counts = materialize(rows.groupBy("group", "v").agg(F.count("*").alias("n")), "group-values")
    placed = counts.withColumn("part", range_of(F.col("v"), bounds_of(counts, F.col("v"))))
    upto = Window.partitionBy("group").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # at most as many rows as ranges
    parts = placed.groupBy(F.col("group").alias("g"), F.col("part").alias("p")).agg(F.sum("n").alias("all"))
    parts = parts.select(F.col("g").alias("group"), F.col("p").alias("part"), "all").withColumns({"before": F.coalesce(F.sum("all").over(upto), F.lit(0)), "total": F.sum("all").over(Window.partitionBy("group"))})
    run = F.sum("n").over(Window.partitionBy("group", "part").orderBy("v").rowsBetween(Window.unboundedPreceding, -1))
    sides = placed.withColumn("run", F.coalesce(run, F.lit(0))).alias("a").join(parts.alias("b"), F.col("a.group").eqNullSafe(F.col("b.group")) & (F.col("a.part") == F.col("b.part")))
    ranked = sides.select("a.group", "v", "n", "total", (F.col("before") + F.col("run")).alias("below"))
    found = []
    for i, share in enumerate(shares):
        place = F.lit(float(share)) * (F.col("total") - 1)
        low, high = F.floor(place), F.ceil(place)
        at = lambda k: F.max(F.when((F.col("below") <= k) & (k < F.col("below") + F.col("n")), F.col("v")))
        found += [at(low).alias(f"l{i}"), at(high).alias(f"h{i}"), F.max(place - low).alias(f"s{i}")]
    ends = ranked.groupBy("group").agg(*found)
    return ends.select("group", *[F.when(F.col(f"s{i}") == 0, F.col(f"l{i}")).otherwise((1 - F.col(f"s{i}")) * F.col(f"l{i}") + F.col(f"s{i}") * F.col(f"h{i}")).alias(f"q{i}") for i in range(len(shares))])
