"""Dataset splitters: long tables (split, row_id, role). Row ids are 0-based positions over a declared key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.order import ROWS_PER_RANGE, rows_at, share_of
from granary.functions.storage import materialize

#: Up to so many folds a row's fold is found by comparisons with the folds' first rows.
MOST_CUT_FOLDS = 64


def _roles(rows: DataFrame, fold: Column, k: int, keep: list[str] = ()) -> DataFrame:
    splits = rows.select("row_id", *keep, fold.alias("fold"), F.explode(F.sequence(F.lit(1), F.lit(k))).alias("split"))
    return splits.select("split", "row_id", F.when(F.col("fold") == F.col("split"), "test").otherwise("train").alias("role"), *keep)


def _even_fold(place: Column, n: Column, k: int) -> Column:
    """1-based fold of a 0-based place among n: the first n % k folds have one row more. Computed, not windowed."""
    size, rest = F.floor(n / k), n % k
    return F.when(place < rest * (size + 1), F.floor(place / (size + 1))).otherwise(rest + F.floor((place - rest * (size + 1)) / F.greatest(size, F.lit(1)))).cast("int") + 1


def kfold(rows: DataFrame, k: int) -> DataFrame:
    """Contiguous folds of ``rows`` (row_id)."""
    n = rows.agg(F.count("*")).first()[0]
    return _roles(rows, _even_fold(F.col("row_id"), F.lit(n), k), k)


def _cut_folds(keyed: DataFrame, n: int, k: int, part: Column | None = None) -> DataFrame:
    """Folds of the ``n`` rows (row_id, __key) in the order of __key, then row_id, by the first rows of the folds: no row is moved.

    ``part``: ranges of __key, as in :func:`granary.functions.order.rows_at`.
    """
    starts = [j * (n // k) + min(j, n % k) for j in range(1, k)]
    key, row = F.col("__key"), F.col("row_id")
    number = F.lit(1)
    for cut, first in rows_at(keyed, ["__key", "row_id"], [s for s in starts if s < n], part):
        after = key.isNotNull() | (row >= first) if cut is None else (key > F.lit(cut)) | (key == F.lit(cut)) & (row >= first)
        number = number + F.coalesce(after, F.lit(False)).cast("int")  # nulls come first
    return _roles(keyed, number, k)


def shuffled_kfold(rows: DataFrame, k: int, key: Column, stratify: str | None = None) -> DataFrame:
    """Folds in the order of ``key`` (a hash or another permutation of row_id), within each class of ``stratify``."""
    from granary.functions.order import with_row_id

    # written once: a fold needs several passes
    keyed = materialize(rows.select("row_id", key.cast("double").alias("__key"), *([stratify] if stratify else [])), "keyed")
    if stratify is None:
        n = keyed.count()
        if k <= MOST_CUT_FOLDS:
            return _cut_folds(keyed, n, k)
        return _roles(with_row_id(keyed, "__key", "row_id", name="__place"), _even_fold(F.col("__place"), F.lit(n), k), k)
    # salted: a class is dealt by rank within each of 64 hash cells, whose offsets make one rank of the class
    cell = F.floor(share_of("row_id") * 64).cast("int")
    counts = keyed.groupBy(F.col(stratify).alias("__c"), cell.alias("__cell")).agg(F.count("*").alias("__m"))
    one = Window.partitionBy("__c")
    counts = counts.withColumns({"__before": F.coalesce(F.sum("__m").over(one.orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "__n": F.sum("__m").over(one)})
    placed = keyed.withColumn("__cell", cell).withColumn("__nth", F.row_number().over(Window.partitionBy(stratify, "__cell").orderBy("__key", "row_id")) - 1)
    placed = placed.join(counts.withColumnRenamed("__cell", "__cell2"), F.col(stratify).eqNullSafe(F.col("__c")) & (F.col("__cell") == F.col("__cell2")))
    return _roles(placed, _even_fold(F.col("__before") + F.col("__nth"), F.col("__n"), k), k, [stratify])


def n_splits(kind: str, n: int, k: int = 5, repeats: int = 5) -> int:
    """How many splits a splitter makes of ``n`` rows: all rows for ``leave_one_out``, ``repeats`` times k, or k."""
    return n if kind == "leave_one_out" else k * repeats if kind == "repeated_kfold" else k


def stratified_regression_kfold(rows: DataFrame, y: str, k: int, key: Column, bins: int = 30) -> DataFrame:
    """Folds within the ``bins`` of a continuous target; with the bin of each row."""
    return shuffled_kfold(stratify_bins(rows, y, bins), k, key, "bin")


def stratify_bins(rows: DataFrame, y: str, bins: int = 30) -> DataFrame:
    """``rows`` with ``bin``: the share of rows at or below y, cut at ``bins`` even points (1 to ``bins``)."""
    from granary.functions.order import with_rank

    return with_rank(rows, y, "__ecdf", "ecdf").withColumn("bin", (F.floor(F.col("__ecdf") * (bins - 1)) + 1).cast("int")).drop("__ecdf")


def repeated_kfold(rows: DataFrame, k: int, repeats: int = 5, seed: int = 17, stratify: str | None = None) -> DataFrame:
    """Shuffled folds for each repeat, within each class of ``stratify``, numbered on: split = repeat * k + fold."""
    rows = materialize(rows.select("row_id", *([stratify] if stratify else [])), "fold-rows")  # read in each repeat
    n, out = rows.count(), None
    parts = max(1, -(-n // ROWS_PER_RANGE))
    for r in range(repeats):
        key = share_of("row_id", seed + r)
        if stratify is None and k <= MOST_CUT_FOLDS:  # shares are spread evenly, so ranges of them are known
            one = _cut_folds(rows.withColumn("__key", key), n, k, F.floor(F.col("__key") * parts).cast("int"))
        else:
            one = shuffled_kfold(rows, k, key, stratify)
        one = one.withColumn("split", F.col("split") + r * k)
        out = one if out is None else out.unionByName(one)
    return out


def leave_one_out(rows: DataFrame) -> DataFrame:
    """(split, row_id): each row is the test set of its own split and trains in all others, which need no listing."""
    return rows.select((F.col("row_id") + 1).alias("split"), "row_id", F.lit("test").alias("role"))


def block_bootstrap(rows: DataFrame, n_splits: int, block: int = 7, seed: int = 17) -> DataFrame:
    """Moving-block bootstrap: (split, row_id, role, times); the test set are the rows that no block draws."""
    n = rows.agg(F.count("*")).first()[0]
    if n == 0:
        return rows.select(F.lit(1).alias("split"), "row_id", F.lit("test").alias("role"), F.lit(0).cast("long").alias("times")).limit(0)
    spark = rows.sparkSession
    blocks = spark.range(n_splits * -(-n // block)).select((F.col("id") % n_splits + 1).cast("int").alias("split"), F.floor(F.col("id") / n_splits).alias("nth"), F.floor(share_of("id", seed) * max(1, n - block + 1)).alias("start"))
    drawn = blocks.select("split", F.explode(F.sequence(F.col("start"), F.least(F.col("start") + block, F.col("start") + F.lit(n) - F.col("nth") * block, F.lit(n)) - 1)).alias("row_id"))
    times = drawn.groupBy("split", "row_id").agg(F.count("*").alias("times"))
    every = rows.select("row_id", F.explode(F.sequence(F.lit(1), F.lit(n_splits))).alias("split"))
    joined = every.join(times, ["split", "row_id"], "left")
    return joined.select("split", "row_id", F.when(F.col("times").isNull(), "test").otherwise("train").alias("role"), F.coalesce("times", F.lit(0)).alias("times"))


def _by_bounds(rows: DataFrame, bounds: list[tuple]) -> DataFrame:
    """Roles from (split, role, start, stop): a few literals, tested row by row."""
    hits = F.array(*[F.when((F.col("row_id") >= a) & (F.col("row_id") < b), F.struct(F.lit(s).alias("split"), F.lit(role).alias("role"))) for s, role, a, b in bounds])
    return rows.select("row_id", F.explode(F.filter(hits, lambda x: x.isNotNull())).alias("h")).select("h.split", "row_id", "h.role")


def time_series_bounds(n: int, k: int) -> list[tuple]:
    t = int(n / (k + 1))
    return [x for i in range(1, k + 1) for x in ((i, "train", 0, i * t), (i, "test", i * t, (i + 1) * t))]


def time_series_split(rows: DataFrame, k: int) -> DataFrame:
    """Expanding train sets, each followed by its test block."""
    return _by_bounds(rows, time_series_bounds(rows.count(), k))


def rolling_bounds(n: int, k: int, test_size: float) -> list[tuple]:
    test, rest, out = int(n * test_size), int(n * (1 - test_size)), []
    for i in range(1, k + 1):
        a, b, c = int((i - 1) * test / k), int(rest + (i - 1) * test / k), int(rest + i * test / k)
        out += [(i, "train", a, b), (i, "test", b, c)]
    return out


def rolling_split(rows: DataFrame, k: int, test_size: float = 0.2) -> DataFrame:
    """Train sets that slide along with the test blocks."""
    return _by_bounds(rows, rolling_bounds(rows.count(), k, test_size))


def blocking_split(rows: DataFrame, k: int, parts: tuple[tuple[str, float], ...] = (("train", 0.8), ("test", None))) -> DataFrame:
    """Disjoint blocks, each cut into ``parts``: (role, share of the block, rounded up); the last part takes the rest."""
    n = rows.count()
    size = max(1, -(-n // k))
    place = F.col("row_id") % size
    role, at = None, 0
    for name, share in parts[:-1]:
        at += -int(-share * size // 1)
        role = F.when(place < at, name) if role is None else role.when(place < at, name)
    return rows.select((F.floor(F.col("row_id") / size) + 1).cast("int").alias("split"), "row_id", role.otherwise(parts[-1][0]).alias("role"))


VALID_PARTS = (("train", 13 / 20), ("valid", 3 / 20), ("test", None))


def ordered_split(rows: DataFrame, train: float = 0.8) -> DataFrame:
    n = rows.count()
    return rows.withColumn("role", F.when(F.col("row_id") < int(n * train), "train").otherwise("test"))


def random_split(rows: DataFrame, train: float = 0.8, seed: int = 17) -> DataFrame:
    """By a hash of the row id: the same row falls on the same side in each run."""
    return rows.withColumn("role", F.when(share_of("row_id", seed) < train, "train").otherwise("test"))


def sequence_windows(rows: DataFrame, cols: list[str], label: str, length: int) -> DataFrame:
    """(window, sequence, label): rows [i, i + length) as an array of arrays, and the label of the last one.

    Each row is sent to the windows it belongs to, so windows are built by grouping, without one ordered task.
    """
    n = rows.agg(F.count("*")).first()[0]
    sent = rows.select("row_id", F.array(*[F.col(c).cast("double") for c in cols]).alias("v"), F.col(label).alias("label"), F.explode(F.sequence(F.greatest(F.col("row_id") - (length - 1), F.lit(0)), F.col("row_id"))).alias("window"))
    grouped = sent.filter(F.col("window") <= n - length).groupBy("window").agg(F.array_sort(F.collect_list(F.struct("row_id", "v"))).alias("s"), F.max_by("label", "row_id").alias("label"))
    return grouped.select("window", F.col("s.v").alias("sequence"), "label")
