"""Small helpers shared by the training-data operators."""

from __future__ import annotations

from collections import Counter
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions.order import range_of
from granary.functions import storage
from granary.functions.storage import on_workers_path, remove, scratch, shared_dir, sweep, work_path  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the synthetic tables, read with Spark's own reader so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str | Column = "text") -> Column:
    """A text, where null counts as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def fresh(columns: list[str], *names: str) -> list[str]:
    """Names made of ``names`` that are not among ``columns``, whatever the case."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def range_bounds(df: DataFrame, key: str, rows_per_bucket: int, most: int = 16_384) -> list[int]:
    """Values of ``key`` that cut ``df`` into ranges of about ``rows_per_bucket`` rows (at most ``most`` ranges).

    One job over the key column alone. The values occur in the data and do not descend; a value that holds several
    quantiles is there as often. They go into the plan as literals, so a row's range is the same in each job and each
    retry. Nulls of the key count as below all values.
    """
    n, least = df.agg(F.count(key), F.min(key)).first()
    parts = max(1, min(most, -(-n // rows_per_bucket)))
    if n == 0 or parts == 1:
        return []
    at = [i / parts for i in range(1, parts)]
    found = sorted(int(x) for x in df.agg(F.percentile_approx(key, at, max(10_000, 20 * parts))).first()[0])
    return [x for i, x in enumerate(found) if x > least or found[i : i + 2] == [x, x]]


def range_bucket(key: str | Column, bounds: list[int], spread: Column | None = None) -> Column:
    """Number of bounds at or below the key; 0 for a null key.

    Rows of a key that holds m bounds are dealt over the last m ranges up to there by ``spread``, a 64-bit hash: the order
    of ranges is that of (key, spread).
    """
    column = F.col(key) if isinstance(key, str) else key
    own = range_of(column, bounds)
    times = Counter(bounds)
    hot = {x: m for x, m in times.items() if m > 1}
    if spread is None or not hot:
        return own
    many = F.element_at(F.create_map(*[F.lit(x) for pair in hot.items() for x in pair]), column)
    part = F.floor((spread.cast("double") + 2.0**63) / 2.0**64 * many)
    return F.coalesce(own - many + 1 + F.greatest(F.least(part, many - 1), F.lit(0)), own).cast("int")


ROWS_PER_BATCH, _BATCH = 1000, "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def small_batches(spark: SparkSession):
    """Jobs started inside send Python at most ``ROWS_PER_BATCH`` rows at once; the session's setting is put back.

    Whole texts are long rows, and both sides hold a batch or two per task.
    """
    before = spark.conf.get(_BATCH)
    if not 0 < int(before) <= ROWS_PER_BATCH:
        spark.conf.set(_BATCH, str(ROWS_PER_BATCH))
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)


def materialize(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder, in small batches of whole texts, and read it back."""
    with small_batches(df.sparkSession):
        return storage.materialize(df, name, codec)


def map_arrow(df: DataFrame, function, schema: str) -> DataFrame:
    """``mapInArrow`` whose workers find this package, and give what a task has freed back to the system after it.

    A result that is handed out lazily is run with the session's own spark.sql.execution.arrow.maxRecordsPerBatch.
    """
    spark = df.sparkSession
    on_workers_path(spark)

    def run(parts):
        try:
            yield from function(parts)
        finally:
            release()

    return df.mapInArrow(run, schema)


def slices(parts, column: int, most: int = 1 << 20):
    """Record batches cut to about ``most`` bytes of text in ``column``: strings are made of a slice, not of a batch.

    A longer text stands alone.
    """
    import numpy as np
    import pyarrow.compute as pc

    for part in parts:
        sizes = np.asarray(pc.fill_null(pc.binary_length(part.column(column)), 0)).astype(np.int64)
        total = np.concatenate([[0], np.cumsum(sizes)])
        first = 0
        while first < part.num_rows:
            last = max(first + 1, int(np.searchsorted(total, total[first] + most, "right")) - 1)
            yield part.slice(first, last - first)
            first = last


def batches(texts: list, most: int):
    """Ranges of a list of strings of about ``most`` characters each; a longer string stands alone."""
    first = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > first and size + n > most:
            yield first, i
            first, size = i, 0
        size += n
    if first < len(texts):
        yield first, len(texts)


def release() -> None:
    """Give freed memory back to the system."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


#: A side of a join is broadcast up to this many narrow rows (keys and a number or two, about 40 MB); beyond, it is shuffled.
MOST_BROADCAST = 400_000


def keyed_side(df: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """``df``, a written table of narrow rows, marked for broadcast if its counted rows are few enough."""
    return F.broadcast(df) if df.count() <= most else df
