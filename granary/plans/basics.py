"""Queries of projection, filters, joins, aggregates, ranks, limits and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.functions.columns import columns_of_type
from granary.functions.order import with_rank
from granary.operators import relational, series
from granary.plans.registry import load, query, rounded, share_sql

orders = lambda spark, folder: load(spark, folder, "orders")


@query("project_drop", "SELECT c_custkey, c_nationkey, c_acctbal FROM customer")
def project_drop(spark, folder):
    return load(spark, folder, "customer").drop("c_name", "c_mktsegment")


@query("project_by_type", "SELECT c_custkey, c_nationkey, c_acctbal FROM customer")
def project_by_type(spark, folder):
    rows = load(spark, folder, "customer")
    return rows.select(*columns_of_type(rows, T.NumericType))


@query("project_by_place", "SELECT s_suppkey, s_acctbal FROM supplier")
def project_by_place(spark, folder):
    rows = load(spark, folder, "supplier")
    return series.select_features(rows, rows.columns, [0, 3])




@query("rename", "SELECT s_suppkey AS id, s_acctbal AS balance FROM supplier")
def rename(spark, folder):
    return load(spark, folder, "supplier").select("s_suppkey", "s_acctbal").withColumnRenamed("s_suppkey", "id").withColumnRenamed("s_acctbal", "balance")


@query("filter_equal", "SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT'")
def filter_equal(spark, folder):
    return orders(spark, folder).filter(F.col("o_orderpriority") == "1-URGENT").select("o_orderkey")


@query("filter_not_in", "SELECT o_orderkey FROM orders WHERE o_orderstatus NOT IN ('F', 'P')")
def filter_not_in(spark, folder):
    return orders(spark, folder).filter(~F.col("o_orderstatus").isin("F", "P")).select("o_orderkey")


@query("conditional_label", "SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN 1 ELSE 0 END AS label FROM orders")
def conditional_label(spark, folder):
    return orders(spark, folder).select("o_orderkey", F.when(F.col("o_totalprice") > 100000, 1).otherwise(0).alias("label"))


@query("clamp", "SELECT s_suppkey, round(greatest(s_acctbal, 0), 6) AS floor, round(least(greatest(s_acctbal, 1000), 5000), 6) AS both FROM supplier")
def clamp(spark, folder):
    return rounded(load(spark, folder, "supplier").select("s_suppkey", relational.clamp(F.col("s_acctbal"), 0).alias("floor"), relational.clamp(F.col("s_acctbal"), 1000, 5000).alias("both")))


@query("column_names_joined", "SELECT string_agg(upper(column_name), ' ' ORDER BY column_index) AS names FROM duckdb_columns() WHERE table_name = 'supplier'")
def column_names_joined(spark, folder):
    names = load(spark, folder, "supplier").columns
    return spark.range(1).select(F.array_join(F.transform(F.array(*[F.lit(n) for n in names]), F.upper), " ").alias("names"))


@query("merge_by_position", "WITH a AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) AS i FROM supplier), b AS (SELECT n_nationkey, row_number() OVER (ORDER BY n_nationkey) AS i FROM nation) SELECT s_suppkey, n_nationkey FROM a FULL JOIN b USING (i)")
def merge_by_position(spark, folder):
    return relational.merge_by_position(load(spark, folder, "supplier").select("s_suppkey"), load(spark, folder, "nation").select("n_nationkey"), "s_suppkey", "n_nationkey")


@query("semi_join", "SELECT doc_id, quality FROM labels WHERE doc_id IN (SELECT doc_id FROM documents WHERE n_chars > 1000)")
def semi_join(spark, folder):
    return relational.labels_of(load(spark, folder, "labels").select("doc_id", "quality"), load(spark, folder, "documents").filter("n_chars > 1000"), "doc_id")


@query("anti_join", "SELECT doc_id, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_join(spark, folder):
    return relational.without(load(spark, folder, "documents").select("doc_id", "n_chars"), load(spark, folder, "labels"), "doc_id")


@query("union_rows", "SELECT n_nationkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region")
def union_rows(spark, folder):
    return load(spark, folder, "nation").select(F.col("n_nationkey").alias("k")).unionByName(load(spark, folder, "region").select(F.col("r_regionkey").alias("k")))


@query("intersect_keys", "SELECT doc_id FROM labels INTERSECT SELECT doc_id FROM documents WHERE n_chars < 2000")
def intersect_keys(spark, folder):
    return relational.in_all("doc_id", load(spark, folder, "labels"), load(spark, folder, "documents").filter("n_chars < 2000"))


@query("set_agreement", "SELECT count(*) FILTER (n_chars > 1000 AND quality = 1) AS tp, count(*) FILTER (n_chars > 1000 AND quality <> 1) AS fp, count(*) FILTER (n_chars <= 1000 AND quality = 1) AS fn, count(*) FILTER (n_chars <= 1000 AND quality <> 1) AS tn FROM labels JOIN documents USING (doc_id)")
def set_agreement(spark, folder):
    labels, docs = load(spark, folder, "labels"), load(spark, folder, "documents")
    return relational.agreement(labels.join(docs.filter("n_chars > 1000").select("doc_id"), "doc_id"), labels.filter("quality = 1"), labels, "doc_id")


@query(
    "feature_subsets",
    """WITH RECURSIVE f AS (SELECT s AS name, row_number() OVER (ORDER BY s) AS i FROM (SELECT DISTINCT o_orderstatus AS s FROM orders)),
    p AS (SELECT name AS features, i FROM f UNION ALL SELECT p.features || ',' || f.name, f.i FROM p JOIN f ON f.i > p.i) SELECT features FROM p""",
)
def feature_subsets(spark, folder):
    names = sorted(r[0] for r in orders(spark, folder).select("o_orderstatus").distinct().collect())
    return spark.createDataFrame([(",".join(s),) for s in relational.subsets(names)], "features string")


@query("column_moments", "SELECT round(avg(o_totalprice), 4) AS mean, round(stddev_pop(o_totalprice), 4) AS sd, round(min(o_totalprice), 4) AS low, round(max(o_totalprice), 4) AS high, count(DISTINCT o_custkey) AS customers FROM orders")
def column_moments(spark, folder):
    x = "o_totalprice"
    return rounded(orders(spark, folder).agg(F.avg(x).alias("mean"), F.stddev_pop(x).alias("sd"), F.min(x).alias("low"), F.max(x).alias("high"), F.countDistinct("o_custkey").alias("customers")), 4)


@query("average_rank", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0::DOUBLE AS r FROM lineitem")
def average_rank(spark, folder):
    return with_rank(load(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"), "l_quantity", "r").drop("l_quantity")


@query("cheapest_by_group", "SELECT o_orderpriority, arg_min(o_orderkey, (o_totalprice, o_orderkey)) AS low, arg_max(o_orderkey, (o_totalprice, o_orderkey)) AS high FROM orders GROUP BY 1")
def cheapest_by_group(spark, folder):
    by = F.struct("o_totalprice", "o_orderkey")
    return orders(spark, folder).groupBy("o_orderpriority").agg(F.min_by("o_orderkey", by).alias("low"), F.max_by("o_orderkey", by).alias("high"))


@query("top_rows", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def top_rows(spark, folder):
    return orders(spark, folder).orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10).select("o_orderkey", "o_totalprice")


@query("above_quantile", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > (SELECT quantile_cont(o_totalprice, 0.95) FROM orders)")
def above_quantile(spark, folder):
    from granary.operators.outliers import above_quantile as cut

    return cut(orders(spark, folder).select("o_orderkey", "o_totalprice"), "o_totalprice")


@query("class_scatter", "WITH m AS (SELECT l_returnflag, count(*) AS n, avg(l_quantity) AS a, avg(l_tax) AS b, var_pop(l_quantity) * count(*) AS saa, covar_pop(l_quantity, l_tax) * count(*) AS sab, var_pop(l_tax) * count(*) AS sbb FROM lineitem GROUP BY 1), t AS (SELECT sum(n * a) / sum(n) AS ta, sum(n * b) / sum(n) AS tb FROM m) SELECT unnest([{'a': 'l_quantity', 'b': 'l_quantity', 'within': round(sum(saa), 2), 'between': round(sum(n * (a - ta) * (a - ta)), 4) + 0.0}, {'a': 'l_quantity', 'b': 'l_tax', 'within': round(sum(sab), 2), 'between': round(sum(n * (a - ta) * (b - tb)), 4) + 0.0}, {'a': 'l_tax', 'b': 'l_tax', 'within': round(sum(sbb), 2), 'between': round(sum(n * (b - tb) * (b - tb)), 4) + 0.0}], recursive := true) FROM m, t")
def class_scatter(spark, folder):
    return rounded(relational.class_scatter(load(spark, folder, "lineitem"), ["l_quantity", "l_tax"], "l_returnflag"), 4, within=2)


@query("sample_sizes", f"SELECT {share_sql('o_orderkey', 17)} < 0.7::DOUBLE AS sampled, count(*) AS n FROM orders GROUP BY 1")
def sample_sizes(spark, folder):
    return relational.hash_sample(orders(spark, folder), "o_orderkey", 0.7).groupBy("sampled").agg(F.count("*").alias("n"))


@query("features_ranked_high", "WITH c AS (SELECT c_nationkey, count(*) AS n, round(avg(c_acctbal), 6) AS m FROM customer GROUP BY 1) SELECT c_nationkey, n, m FROM c WHERE n >= (SELECT quantile_cont(n, 0.5) FROM c) AND m >= (SELECT quantile_cont(m, 0.5) FROM c)")
def features_ranked_high(spark, folder):
    rows = load(spark, folder, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"), F.round(F.avg("c_acctbal"), 6).alias("m"))
    return relational.both_ranked_high(rows, "c_nationkey", "n", "m", 0.5)
