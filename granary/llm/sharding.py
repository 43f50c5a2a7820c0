"""Contiguous shards of near-equal bytes from global prefix sums, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.llm.common import materialize, range_bounds, range_bucket, table, text_of


def assign_shards(df: DataFrame, key: str, size: str, shards: int, rows_per_range: int = 20_000) -> DataFrame:
    """``df`` with ``shard`` and ``slot``: cut at equal targets of the running sum of ``size`` in the order of ``key``.

    The key's quantiles make ranges (a bounded number); the ranges' totals, a row each, give the sum before each range,
    and a running sum within a range completes it. A row belongs to the shard in which the middle of its bytes falls,
    so a shard is off its target by at most the sizes of the two rows at its ends. ``slot`` counts the rows of a shard
    from 0 in the same order. Rows that tie on ``key`` are ordered by a hash of their number in the table; if they are so
    many that they hold several ranges, they are dealt over these by it. A null key stands first, a null size counts as 0; an
    empty table gives no rows; columns named ``shard`` and ``slot`` are replaced and others stay.

    ``df`` is read once, into a written table in which each row has a number, so that it stands at the same place in each
    job and each retry. It should hold keys and sizes rather than texts.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns])  # apart from the columns made here, whatever their names
    rows = df.select(whole.alias("row"), F.col(key).alias("key"), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("size"))
    rows = materialize(rows.withColumn("spread", F.xxhash64(F.monotonically_increasing_id())), "rows")
    bounds = range_bounds(rows, "key", rows_per_range)
    rows = rows.withColumn("range", range_bucket("key", bounds, F.col("spread")))
    order = [F.col("key").asc_nulls_first(), F.col("spread")]
    totals = rows.groupBy("range").agg(F.sum("size").alias("bytes"))
    every = Window.partitionBy(F.lit(0))  # over as many rows as there are ranges
    before = totals.select(
        F.col("range").alias("r"),
        F.coalesce(F.sum("bytes").over(every.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        F.sum("bytes").over(every).alias("total"),
    )
    own = Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    run = F.coalesce(F.sum("size").over(own), F.lit(0))
    placed = rows.withColumn("run", run).join(F.broadcast(before), F.col("range") == F.col("r"))
    middle = (F.col("before") + F.col("run")) * 2 + F.col("size")
    shard = F.least(F.floor(middle * shards / F.greatest(F.col("total") * 2, F.lit(1))), F.lit(shards - 1)).cast("int")
    nth = F.row_number().over(Window.partitionBy("range", "shard").orderBy("run", *order))
    cut = placed.withColumn("shard", F.when(F.col("total") == 0, 0).otherwise(shard)).withColumn("nth", nth)
    counts = cut.groupBy("range", "shard").agg(F.count("*").alias("n"))  # at most ranges + shards rows
    ahead = F.sum("n").over(Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    ahead = counts.select(F.col("range").alias("r2"), F.col("shard").alias("s2"), F.coalesce(ahead, F.lit(0)).alias("ahead"))
    placed = cut.join(F.broadcast(ahead), (F.col("range") == F.col("r2")) & (F.col("shard") == F.col("s2")))
    kept = [F.col("row").getField(c).alias(c) for c in df.columns if c not in ("shard", "slot")]
    return placed.select(*kept, "shard", (F.col("ahead") + F.col("nth") - 1).cast("long").alias("slot"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = text_of().cast("binary")
    size = (F.octet_length(raw) + 1).cast("long")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), size.alias("size"), F.crc32(raw).alias("text_crc32"))
    placed = assign_shards(docs, "doc_id", "size", 8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
