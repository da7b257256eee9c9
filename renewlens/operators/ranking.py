"""Global ranks and running sums without a global window.

The order is cut into buckets that are consistent with it; each bucket's totals
(a small table) give the offset every bucket starts from, and the exact rank is
then computed inside buckets only. Buckets come from quantile edges of the
score. A score value so frequent that it spans several quantiles gets a bucket
of its own, and that bucket is divided further by the leading digits of the
tie-break hash, which is the order inside equal scores anyway. So neither a
skewed score distribution nor one score shared by a third of all users puts an
unbounded group into one task.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from renewlens.functions.scalars import seeded_hash
from renewlens.sources.schemas import KEY

BUCKETS = 64  # at least; more where a bucket would hold over BUCKET_ROWS rows
BUCKET_ROWS = 1_000_000
HASH_DIGITS = 3


def order_edges(df: DataFrame, column: str, buckets: int) -> tuple[list[float], list[float]]:
    """Inner bucket edges and the values that are too frequent for one bucket."""
    probabilities = [i / buckets for i in range(1, buckets)]
    found = df.approxQuantile(column, probabilities, 0.25 / buckets)
    hot = sorted({v for v in found if found.count(v) > 1})
    edges = set(found) | {math.nextafter(v, math.inf) for v in hot}
    return sorted(edges), hot


def _bucketed(
    df: DataFrame, score: str, buckets: int, tie: str | None
) -> DataFrame:
    edges, hot = order_edges(df, score, buckets)
    splits = [-math.inf, *edges, math.inf]
    if len(splits) > 2:
        model = Bucketizer(
            splits=splits, inputCol=score, outputCol="bucket", handleInvalid="keep"
        )
        out = model.transform(df).withColumn("bucket", F.col("bucket").cast("int"))
    else:
        out = df.withColumn("bucket", F.lit(0))
    if tie is None or not hot:
        return out.withColumn("slot", F.lit(""))
    prefix = F.substring(F.col(tie), 1, HASH_DIGITS)
    return out.withColumn("slot", F.when(F.col(score).isin(*hot), prefix).otherwise(F.lit("")))


def ranked(
    df: DataFrame,
    score: str,
    *,
    sums: Sequence[str] = (),
    by: Sequence[str] = (),
    key: str | None = KEY,
    descending: bool = True,
    buckets: int | None = None,
) -> DataFrame:
    """Add ``rank`` (1-based), ``cum_<c>`` for each summed column and ``n_total``.

    Ties are ordered by a hash of the user key, then the key itself; pass
    ``key=None`` when the scores are already distinct within ``by``. Summed
    columns should be integers when bitwise repeatability matters. ``df`` is
    read three times, so give it a stored table (see ``session.stage``).
    """
    by = list(by)
    if buckets is None:
        buckets = max(BUCKETS, math.ceil(df.count() / BUCKET_ROWS))
    rows = df if key is None else df.withColumn("tie_hash", seeded_hash("tie", key))
    tagged = _bucketed(rows, score, buckets, None if key is None else "tie_hash")
    score_order = F.col(score).desc() if descending else F.col(score).asc()
    bucket_order = F.col("bucket").desc() if descending else F.col("bucket").asc()

    totals = tagged.groupBy(*by, "bucket", "slot").agg(
        F.count(F.lit(1)).alias("bucket_n"), *[F.sum(c).alias(f"bucket_{c}") for c in sums]
    )
    before = Window.partitionBy(*by).orderBy(bucket_order, F.col("slot")).rowsBetween(
        Window.unboundedPreceding, -1
    )
    everything = Window.partitionBy(*by)
    offsets = totals.select(
        *by,
        "bucket",
        "slot",
        F.coalesce(F.sum("bucket_n").over(before), F.lit(0)).alias("before_n"),
        *[
            F.coalesce(F.sum(f"bucket_{c}").over(before), F.lit(0)).alias(f"before_{c}")
            for c in sums
        ],
        F.sum("bucket_n").over(everything).alias("n_total"),
    )
    keys = [*by, "bucket", "slot"]
    ties = [] if key is None else [F.col("tie_hash"), F.col(key)]
    order = Window.partitionBy(*keys).orderBy(score_order, *ties)
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = tagged.join(_null_safe(offsets, keys), _null_safe_on(tagged, keys), "inner")
    kept = [c for c in df.columns]
    return joined.select(
        *[tagged[c] for c in kept],
        (F.row_number().over(order) + F.col("before_n")).cast("bigint").alias("rank"),
        *[(F.sum(c).over(running) + F.col(f"before_{c}")).alias(f"cum_{c}") for c in sums],
        "n_total",
    )


def _null_safe(offsets: DataFrame, keys: Sequence[str]) -> DataFrame:
    return offsets.select(
        *[F.col(k).alias(f"offset_{k}") for k in keys],
        *[c for c in offsets.columns if c not in keys],
    )


def _null_safe_on(df: DataFrame, keys: Sequence[str]) -> Column:
    condition = F.lit(True)
    for k in keys:
        condition = condition & df[k].eqNullSafe(F.col(f"offset_{k}"))
    return condition


def hash_rank(
    df: DataFrame,
    *,
    seed: int | str,
    strata: Sequence[str] = (),
    key: Sequence[str] | str = KEY,
    digits: int = HASH_DIGITS,
) -> DataFrame:
    """Exact rank of every row in hash order inside its stratum.

    Adds ``hash_rank`` (1-based) and ``stratum_n``. The hash is uniform, so its
    leading digits are balanced buckets whatever the strata look like: a
    stratum holding most of the table is still spread over 16**digits groups.
    """
    keys = [key] if isinstance(key, str) else list(key)
    strata = list(strata)
    tagged = df.withColumn("order_hash", seeded_hash(seed, *keys)).withColumn(
        "bucket", F.substring("order_hash", 1, digits)
    )
    before = Window.partitionBy(*strata).orderBy("bucket").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = (
        tagged.groupBy(*strata, "bucket")
        .agg(F.count(F.lit(1)).alias("bucket_n"))
        .select(
            *[F.col(s).alias(f"offset_{s}") for s in strata],
            F.col("bucket").alias("offset_bucket"),
            F.coalesce(F.sum("bucket_n").over(before), F.lit(0)).alias("before_n"),
            F.sum("bucket_n").over(Window.partitionBy(*strata)).alias("stratum_n"),
        )
    )
    order = Window.partitionBy(*strata, "bucket").orderBy("order_hash", *keys)
    joined = tagged.join(offsets, _null_safe_on(tagged, [*strata, "bucket"]), "inner")
    return joined.select(
        *[tagged[c] for c in df.columns],
        (F.row_number().over(order) + F.col("before_n")).cast("bigint").alias("hash_rank"),
        "stratum_n",
    )


def top_fraction(ranked_df: DataFrame, k: float) -> DataFrame:
    """First ``rint(k * n)`` rows of a ranking, at least one."""
    if not 0 < k <= 1:
        raise ValueError(f"k must lie in (0, 1]: {k}")
    size = F.greatest(F.rint(F.lit(k) * F.col("n_total")), F.lit(1.0))
    return ranked_df.filter(F.col("rank") <= size)


def equidistant_sample(ranked_df: DataFrame, n: int) -> DataFrame:
    """``n`` rows evenly spaced along a ranking, both ends included.

    Positions are computed from the row count, so the list is described as a
    whole instead of by its most extreme head.
    """
    if n < 1:
        raise ValueError(f"n must be positive: {n}")
    # Position i of n is rint(i * (N - 1) / (n - 1)); a row is picked when it is the
    # position of some i, which is tested from the row's own rank.
    zero_based = F.col("rank") - 1
    if n == 1:
        return ranked_df.filter(zero_based == 0)
    gap = (F.col("n_total") - 1) / F.lit(float(n - 1))
    nearest = F.rint(zero_based / gap)
    picked = F.rint(nearest * gap) == zero_based
    small = F.col("n_total") <= n
    return ranked_df.filter(small | picked)


def head_n(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """Top rows of a report (one TakeOrderedAndProject, no full sort)."""
    return df.orderBy(*order).limit(n)


def argmax_row(df: DataFrame, value: str, first: str) -> DataFrame:
    """The row with the largest ``value``; the smallest ``first`` on ties."""
    return df.orderBy(F.col(value).desc(), F.col(first).asc()).limit(1)


def winner_row(df: DataFrame, loss: str, size: str, digits: int = 4) -> DataFrame:
    """Lowest rounded loss; among equals the smallest model."""
    return df.orderBy(F.round(loss, digits), F.col(size)).limit(1)
