"""Entropy and mutual information: from counts, from histograms, and from nearest neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.functions.columns import numeric
from granary.functions.distributions import digamma, digamma_of
from granary.functions.order import count_near
from granary.functions.storage import materialize
from granary.operators.nearby import nearest


def entropy(df: DataFrame, *cols: str, base: float = 2.0) -> DataFrame:
    """One row: the joint entropy of columns."""
    counts = df.groupBy(*cols).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("t"))
    p = F.col("n") / F.col("t")
    return counts.crossJoin(F.broadcast(total)).agg((-F.sum(p * F.ln(p)) / F.ln(F.lit(base))).alias("entropy"))


def of_counts(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: mutual information of two discrete columns in nats, and half the G statistic over n (the same number)."""
    cells = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(x).alias("x"), F.col(y).alias("y")).agg(F.count("*").alias("n"))
    cells = cells.join(cells.groupBy("x").agg(F.sum("n").alias("nx")), "x").join(cells.groupBy("y").agg(F.sum("n").alias("ny")), "y")
    total = cells.agg(F.sum("n").alias("t"))
    mi = F.sum(F.col("n") / F.col("t") * F.ln(F.col("n") * F.col("t") / (F.col("nx") * F.col("ny"))))
    return cells.crossJoin(F.broadcast(total)).agg(mi.alias("mutual_information"))


def g_test(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: the G statistic of two discrete columns, and mutual information as half of it over n, in nats."""
    n = F.lit(df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).count())
    return of_counts(df, x, y).select((F.col("mutual_information") * 2 * n).alias("g"), "mutual_information")


def prepared(df: DataFrame, cols: list[str], key: str, noise: float = 1e-10, seed: int = 17) -> DataFrame:
    """Continuous columns for nearest-neighbour estimates: divided by their standard deviation, with a little noise.

    The noise is normal, drawn by a hash of the whole-number ``key``, and scaled by the mean size of the values, 1 at least.
    It settles ties; a column that does not vary becomes null.
    """
    from granary.functions.order import share_of

    got = df.agg(*[f(c) for c in numeric(df, cols) for f in (F.stddev_pop, lambda c: F.avg(F.abs(F.col(c))))]).first()
    out = {}
    for i, c in enumerate(cols):
        sd, size = got[2 * i], got[2 * i + 1]
        normal = F.sqrt(-2 * F.ln(1 - share_of(key, seed, i, 1))) * F.cos(share_of(key, seed, i, 2) * 6.283185307179586)
        out[c] = F.col(c) / F.lit(sd) + normal * F.lit(noise * max(1.0, size / sd)) if sd else F.lit(None).cast("double")
    return df.withColumns(out)


def bins(df: DataFrame, cols: list[str], n: int) -> DataFrame:
    """``df`` with ``<column>_bin``: equal-width bins 0 to n - 1 between each column's extremes."""
    ends = df.agg(*[f(c).alias(f"{k}{i}") for i, c in enumerate(numeric(df, cols)) for k, f in (("a", F.min), ("b", F.max))]).first()
    place = lambda c, a, b: F.lit(0) if b == a else F.least(F.floor((F.col(c) - F.lit(a)) / F.lit((b - a) / n)), F.lit(n - 1))
    return df.withColumns({f"{c}_bin": F.when(F.col(c).isNotNull(), place(c, float(ends[f"a{i}"]), float(ends[f"b{i}"])).cast("int")) for i, c in enumerate(cols)})


def histogram_matrix(df: DataFrame, cols: list[str], n: int = 5, normalized: bool = False) -> DataFrame:
    """(a, b, mutual_information) of all pairs of columns by equal-width bins, in bits; normalised by the geometric mean."""
    binned = bins(df, cols, n)
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    sides = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"{a}_bin").alias("x"), F.col(f"{b}_bin").alias("y")) for a, b in pairs])
    cells = binned.select(F.explode(sides).alias("s")).select("s.*").filter("x IS NOT NULL AND y IS NOT NULL").groupBy("a", "b", "x", "y").agg(F.count("*").alias("n"))

    def h(*keys: str) -> DataFrame:
        c = cells.groupBy("a", "b", *keys).agg(F.sum("n").alias("n"))
        t = cells.groupBy("a", "b").agg(F.sum("n").alias("t"))
        p = F.col("n") / F.col("t")
        return c.join(t, ["a", "b"]).groupBy("a", "b").agg((-F.sum(p * F.log2(p))).alias("h" + "".join(keys)))

    joined = h("x").join(h("y"), ["a", "b"]).join(h("x", "y"), ["a", "b"])
    mi = F.col("hx") + F.col("hy") - F.col("hxy")
    return joined.select("a", "b", (mi / F.nullif(F.sqrt(F.col("hx") * F.col("hy")), F.lit(0.0)) if normalized else mi).alias("mutual_information"))


def continuous_discrete(df: DataFrame, x: str, y: str, k: int = 3) -> DataFrame:
    """Ross's estimate for a continuous x and a discrete y, in nats; 0 without a class of two rows.

    The k-th neighbour of a row within its class comes from :func:`nearest`, the rows of all classes nearer than that from
    ranks. A smaller class takes as many neighbours as it has; classes of one row and rows with nulls are left out.
    """
    rows = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).cast("double").alias("x"), F.col(y).cast("string").alias("y"))
    sizes = rows.groupBy("y").agg(F.count("*").alias("size")).filter("size > 1")
    kept = materialize(rows.join(sizes, "y").withColumn("id", F.monotonically_increasing_id()), "classes")  # ids are fixed once written
    reach = nearest(kept, "id", ["x"], k, by="y").groupBy(F.col("a").alias("id")).agg(F.max("d").alias("e"), F.count("*").alias("k"))
    counted = count_near(kept.join(reach, "id"), "x", "e", "m")
    terms = counted.agg(F.count("*").alias("n"), F.avg(digamma_of(F.col("k")) - digamma_of(F.col("size")) - digamma_of(F.greatest("m", F.lit(1)))).alias("mean"))
    return terms.select(F.when(F.col("n") > 0, F.greatest(F.lit(0.0), digamma_of(F.col("n")) + F.col("mean"))).otherwise(0.0).alias("mutual_information"))


def continuous_continuous(df: DataFrame, key: str, x: str, y: str, k: int = 3) -> DataFrame:
    """The estimate of Kraskov, Stoegbauer and Grassberger in nats; 0 for k rows or fewer.

    The k-th neighbour by the greater of both gaps comes from :func:`nearest`, the rows nearer than that in each column from
    ranks: no pairs of all rows. ``key`` is unique; rows with nulls are left out.
    """
    rows = df.select(F.col(key).alias("id"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna()
    reach = nearest(rows, "id", ["x", "y"], k, "chebyshev").filter(F.col("r") == k).select(F.col("a").alias("id"), F.col("d").alias("e"))
    counted = count_near(count_near(materialize(rows.join(reach, "id"), "reach"), "x", "e", "nx"), "y", "e", "ny")
    # the row itself is counted wherever the reach is not 0
    terms = counted.agg(F.count("*").alias("n"), F.avg(digamma_of(F.greatest("nx", F.lit(1))) + digamma_of(F.greatest("ny", F.lit(1)))).alias("mean"))
    return terms.select(F.when(F.col("n") > 0, F.greatest(F.lit(0.0), digamma_of(F.col("n")) + F.lit(digamma(k)) - F.col("mean"))).otherwise(0.0).alias("mutual_information"))


def mutual_information(df: DataFrame, key: str, features: list[str], y: str, discrete: list[str] = (), target_discrete: bool = False, k: int = 3) -> DataFrame:
    """(feature, mutual_information) of each feature with ``y``, by the estimate that fits the two kinds of columns."""
    values = []
    for f in features:
        if f in discrete and target_discrete:
            one = of_counts(df, f, y)
        elif f in discrete:
            one = continuous_discrete(df, y, f, k)
        elif target_discrete:
            one = continuous_discrete(df, f, y, k)
        else:
            one = continuous_continuous(df, key, f, y, k)
        values.append((f, float(one.first()[0])))
    rows = F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(v).alias("mutual_information")) for f, v in values])
    return df.sparkSession.range(1).select(F.explode(rows).alias("r")).select("r.*")

