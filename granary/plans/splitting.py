"""Queries of splitters and sequence windows over orders and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.functions.order import with_row_id
from granary.operators import splits
from granary.plans.registry import load, query, rounded, share_sql

_ROWS = "r AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS row_id, o_orderkey, o_totalprice, o_orderstatus FROM orders), n AS (SELECT count(*) AS n FROM orders)"
K = 5


def rows(spark, folder):
    return with_row_id(load(spark, folder, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus"), "o_orderkey")


def _fold(place: str, n: str) -> str:
    return f"CAST(CASE WHEN {place} < ({n} % {K}) * ({n} // {K} + 1) THEN {place} // ({n} // {K} + 1) ELSE {n} % {K} + ({place} - ({n} % {K}) * ({n} // {K} + 1)) // ({n} // {K}) END AS INT) + 1"


def _folds(place: str, n: str, source: str, extra: str = "") -> str:
    return f"SELECT CAST(s AS INT) AS split, row_id, CASE WHEN {_fold(place, n)} = s THEN 'test' ELSE 'train' END AS role{extra} FROM {source}, range(1, {K + 1}) t(s)"


@query("kfold", f"WITH {_ROWS} " + _folds("row_id", "n", "r, n"))
def kfold(spark, folder):
    return splits.kfold(rows(spark, folder), K)


_SHUFFLE = "(o_orderkey * 7919) % 10007"


@query("kfold_shuffled", f"WITH {_ROWS}, p AS (SELECT row_id, row_number() OVER (ORDER BY {_SHUFFLE}, row_id) - 1 AS place FROM r) " + _folds("place", "n", "p, n"))
def kfold_shuffled(spark, folder):
    return splits.shuffled_kfold(rows(spark, folder), K, F.col("o_orderkey") * 7919 % 10007)


_CELL = f"floor({share_sql('row_id')} * 64)"


def _dealt(by: str, key: str, source: str = "r") -> str:
    """Places within the classes of ``by``, and how many rows each class has."""
    return f"p AS (SELECT row_id, {by}, row_number() OVER (PARTITION BY {by} ORDER BY {_CELL}, {key}, row_id) - 1 AS place, count(*) OVER (PARTITION BY {by}) AS m FROM {source})"


@query("kfold_stratified", f"WITH {_ROWS}, {_dealt('o_orderstatus', _SHUFFLE)} " + _folds("place", "m", "p", ", o_orderstatus"))
def kfold_stratified(spark, folder):
    return splits.shuffled_kfold(rows(spark, folder), K, F.col("o_orderkey") * 7919 % 10007, "o_orderstatus")


_BINS = "b AS (SELECT *, CAST(floor(cume_dist() OVER (ORDER BY o_totalprice) * 29) AS INT) + 1 AS bin FROM r)"


@query("kfold_stratified_regression", f"WITH {_ROWS}, {_BINS}, {_dealt('bin', _SHUFFLE, 'b')} " + _folds("place", "m", "p", ", bin"))
def kfold_stratified_regression(spark, folder):
    return splits.stratified_regression_kfold(rows(spark, folder), "o_totalprice", K, F.col("o_orderkey") * 7919 % 10007)


@query("stratify_bins", f"WITH {_ROWS} SELECT row_id, CAST(floor(cume_dist() OVER (ORDER BY o_totalprice) * 29) AS INT) + 1 AS bin FROM r")
def stratify_bins(spark, folder):
    return splits.stratify_bins(rows(spark, folder), "o_totalprice").select("row_id", "bin")


def _repeated(repeats: int, places: str, n: str, extra: str = "") -> str:
    one = " UNION ALL ".join(f"SELECT CAST(split + {t * K} AS INT) AS split, row_id, role{extra} FROM ({_folds(f'place{t}', n, 'p, n', extra)})" for t in range(repeats))
    return f"WITH {_ROWS}, p AS (SELECT row_id, {places}) " + one


_PLACES = ", ".join(f"row_number() OVER (ORDER BY {share_sql('row_id', 17 + t)}, row_id) - 1 AS place{t}" for t in range(3)) + " FROM r"
_CLASSED = ", ".join(f"row_number() OVER (PARTITION BY o_orderstatus ORDER BY {_CELL}, {share_sql('row_id', 17 + t)}, row_id) - 1 AS place{t}" for t in range(2))


@query("repeated_kfold", _repeated(3, _PLACES, "n"))
def repeated_kfold(spark, folder):
    return splits.repeated_kfold(rows(spark, folder), K, 3)


@query("repeated_kfold_stratified", _repeated(2, f"o_orderstatus, count(*) OVER (PARTITION BY o_orderstatus) AS m, {_CLASSED} FROM r", "m", ", o_orderstatus"))
def repeated_kfold_stratified(spark, folder):
    return splits.repeated_kfold(rows(spark, folder), K, 2, stratify="o_orderstatus")


@query("n_splits", f"SELECT unnest(['kfold', 'repeated_kfold', 'leave_one_out']) AS splitter, unnest([{K}, {3 * K}, count(*)]) AS n FROM orders")
def n_splits(spark, folder):
    n = rows(spark, folder).count()
    return spark.createDataFrame([(x, splits.n_splits(x, n, K, 3)) for x in ("kfold", "repeated_kfold", "leave_one_out")], "splitter string, n long")


@query("leave_one_out", f"WITH {_ROWS} SELECT row_id + 1 AS split, row_id, 'test' AS role FROM r")
def leave_one_out(spark, folder):
    return splits.leave_one_out(rows(spark, folder))


@query(
    "block_bootstrap",
    f"""WITH {_ROWS}, b AS (SELECT i % 3 + 1 AS split, i // 3 AS nth, CAST(floor({share_sql('i', 17)} * greatest(1, n - 6)) AS BIGINT) AS a, n FROM n, range(3 * CAST(ceil(n / 7) AS BIGINT)) t(i)),
    d AS (SELECT split, unnest(range(a, least(a + 7, a + n - nth * 7, n))) AS row_id FROM b), c AS (SELECT split, row_id, count(*) AS times FROM d GROUP BY ALL)
    SELECT CAST(s AS INT) AS split, r.row_id, CASE WHEN times IS NULL THEN 'test' ELSE 'train' END AS role, coalesce(times, 0) AS times
    FROM r CROSS JOIN range(1, 4) t(s) LEFT JOIN c ON c.split = s AND c.row_id = r.row_id""",
)
def block_bootstrap(spark, folder):
    return splits.block_bootstrap(rows(spark, folder).select("row_id"), 3)


@query("time_series_split", f"WITH {_ROWS}, b AS (SELECT s, n // {K + 1} AS t FROM n, range(1, {K + 1}) x(s)) SELECT CAST(s AS INT) AS split, row_id, CASE WHEN row_id < s * t THEN 'train' ELSE 'test' END AS role FROM r, b WHERE row_id < (s + 1) * t")
def time_series_split(spark, folder):
    return splits.time_series_split(rows(spark, folder), K)


@query(
    "rolling_split",
    f"""WITH {_ROWS}, b AS (SELECT s, floor(n::DOUBLE * 0.2::DOUBLE) AS t, floor(n::DOUBLE * (1::DOUBLE - 0.2::DOUBLE)) AS q FROM n, range(1, {K + 1}) x(s)),
    e AS (SELECT s, floor((s - 1) * t / {K}) AS a, floor(q + (s - 1) * t / {K}) AS b, floor(q + s * t / {K}) AS c FROM b)
    SELECT CAST(s AS INT) AS split, row_id, CASE WHEN row_id < b THEN 'train' ELSE 'test' END AS role FROM r, e WHERE row_id >= a AND row_id < c""",
)
def rolling_split(spark, folder):
    return splits.rolling_split(rows(spark, folder), K)


_BLOCK = f"WITH {_ROWS}, b AS (SELECT CAST(ceil(n / {K}) AS BIGINT) AS b FROM n) SELECT CAST(row_id // b AS INT) + 1 AS split, row_id, "


@query("blocking_split", _BLOCK + "CASE WHEN row_id % b < ceil(0.8::DOUBLE * b) THEN 'train' ELSE 'test' END AS role FROM r, b")
def blocking_split(spark, folder):
    return splits.blocking_split(rows(spark, folder), K)


@query("blocking_split_valid", _BLOCK + "CASE WHEN row_id % b < ceil((13::DOUBLE / 20) * b) THEN 'train' WHEN row_id % b < ceil((13::DOUBLE / 20) * b) + ceil((3::DOUBLE / 20) * b) THEN 'valid' ELSE 'test' END AS role FROM r, b")
def blocking_split_valid(spark, folder):
    return splits.blocking_split(rows(spark, folder), K, splits.VALID_PARTS)


@query("ordered_split", f"WITH {_ROWS} SELECT row_id, CASE WHEN row_id < floor(n * 0.8::DOUBLE) THEN 'train' ELSE 'test' END AS role FROM r, n")
def ordered_split(spark, folder):
    return splits.ordered_split(rows(spark, folder)).select("row_id", "role")


@query("random_split", f"WITH {_ROWS} SELECT row_id, CASE WHEN {share_sql('row_id', 17)} < 0.8::DOUBLE THEN 'train' ELSE 'test' END AS role FROM r")
def random_split(spark, folder):
    return splits.random_split(rows(spark, folder)).select("row_id", "role")


@query(
    "sequence_windows",
    """WITH e AS (SELECT row_number() OVER (ORDER BY event_id) - 1 AS i, value, user_id FROM events),
    w AS (SELECT i - 4 AS "window", list([value, user_id::DOUBLE]) OVER (ORDER BY i ROWS 4 PRECEDING) AS s, user_id AS label FROM e)
    SELECT "window", round(list_sum(list_transform(s, lambda x, j: j * x[1] + x[2])), 4) AS checksum, CAST(len(s) AS INT) AS length, label FROM w WHERE "window" >= 0""",
)
def sequence_windows(spark, folder):
    events = with_row_id(load(spark, folder, "events").select("event_id", "value", "user_id"), "event_id")
    out = splits.sequence_windows(events, ["value", "user_id"], "user_id", 5)
    total = F.aggregate(F.transform("sequence", lambda x, j: (j + 1) * F.get(x, F.lit(0)) + F.get(x, F.lit(1))), F.lit(0.0), lambda a, b: a + b)
    return rounded(out.select("window", total.alias("checksum"), F.size("sequence").alias("length"), "label"), 4)
