"""Exact interpolated quantiles of many groups at once.

Works on value counts (one row per group and distinct value), never on a
buffer holding a whole group. Approximate edges split each group's values into
buckets; bucket totals locate the buckets that contain the wanted order
statistics, and only those buckets are ordered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from renewlens.functions.scalars import bins_below

BUCKETS = 32
SKETCH_ACCURACY = 2000


def exact_quantiles(
    counts: DataFrame,
    probs: Sequence[float],
    *,
    keys: Sequence[str] = (),
    value: str = "value",
    weight: str = "n",
    buckets: int = BUCKETS,
) -> DataFrame:
    """Linear-interpolated quantiles: one row per group and probability.

    ``counts`` must have one row per (keys, value) with a positive weight and a
    non-null value, and should be a stored table (it is read twice). Returns
    the keys, ``q`` and ``quantile``.
    """
    spark = counts.sparkSession
    keys = list(keys)
    inner = [i / buckets for i in range(1, buckets)]
    sketch = counts.groupBy(*keys).agg(
        F.percentile_approx(value, inner, SKETCH_ACCURACY).alias("edges")
    )
    # One short array per group. Fixing the edges as data keeps both passes below
    # consistent even when a lost executor forces part of the work to be redone.
    fixed = spark.createDataFrame(sketch.collect(), sketch.schema)
    if keys:
        tagged = counts.join(fixed, keys, "inner")
    else:
        tagged = counts.withColumn("edges", fixed.select("edges").scalar())
    tagged = tagged.withColumn(
        "bucket", bins_below(F.array_distinct("edges"), value)
    ).drop("edges")

    ordered = Window.partitionBy(*keys).orderBy("bucket")
    totals = (
        tagged.groupBy(*keys, "bucket")
        .agg(F.sum(weight).alias("w"))
        .withColumn(
            "before", F.sum("w").over(ordered.rowsBetween(Window.unboundedPreceding, 0)) - F.col("w")
        )
        .withColumn("n", F.sum("w").over(Window.partitionBy(*keys)))
    )
    position = F.col("q") * (F.col("n") - 1)
    wanted = (
        totals.withColumn("q", F.explode(F.array(*[F.lit(float(p)) for p in probs])))
        .withColumn("lo", F.floor(position))
        .withColumn("hi", F.ceil(position))
        .withColumn("frac", position - F.col("lo"))
    )

    def inside(r: str):
        return (F.col(r) >= F.col("before")) & (F.col(r) < F.col("before") + F.col("w"))

    targets = (
        wanted.filter(inside("lo") | inside("hi"))
        .groupBy(*keys, "bucket", "before")
        .agg(F.collect_list(F.struct("q", "lo", "hi", "frac")).alias("targets"))
    )
    within = Window.partitionBy(*keys, "bucket").orderBy(value)
    located = (
        tagged.join(targets, [*keys, "bucket"], "inner")
        .withColumn(
            "upto",
            F.sum(weight).over(within.rowsBetween(Window.unboundedPreceding, 0)) + F.col("before"),
        )
        .withColumn("from", F.col("upto") - F.col(weight))
        .withColumn("t", F.explode("targets"))
        .select(
            *keys,
            F.col("t.q").alias("q"),
            F.col("t.frac").alias("frac"),
            F.when(
                (F.col("t.lo") >= F.col("from")) & (F.col("t.lo") < F.col("upto")), F.col(value)
            ).alias("v_lo"),
            F.when(
                (F.col("t.hi") >= F.col("from")) & (F.col("t.hi") < F.col("upto")), F.col(value)
            ).alias("v_hi"),
        )
        .filter("v_lo is not null or v_hi is not null")
    )
    return (
        located.groupBy(*keys, "q")
        .agg(F.max("v_lo").alias("a"), F.max("v_hi").alias("b"), F.max("frac").alias("frac"))
        .select(*keys, "q", (F.col("a") + (F.col("b") - F.col("a")) * F.col("frac")).alias("quantile"))
    )


def value_counts(df: DataFrame, value: str, *, keys: Sequence[str] = ()) -> DataFrame:
    """Rows per distinct non-null value (partial aggregation does most of the work)."""
    return (
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).cast("double").alias("value"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
