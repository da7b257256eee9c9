"""Null-aware arithmetic shared by the operators."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(num: Column | str, den: Column | str) -> Column:
    """``num / den`` where the denominator is positive, null elsewhere."""
    n, d = as_col(num).cast("double"), as_col(den).cast("double")
    return F.when(d > 0, n / d)


def ratio_sql(num: str, den: str) -> str:
    """SQL text of :func:`ratio`."""
    return f"case when {den} > 0 then cast({num} as double) / cast({den} as double) end"


def sum_across(cols: Sequence[Column | str]) -> Column:
    """Row-wise sum that skips nulls; all-null rows give 0."""
    return reduce(lambda a, b: a + b, [F.coalesce(as_col(c), F.lit(0)) for c in cols])


def mean_across(cols: Sequence[Column | str]) -> Column:
    """Row-wise mean of the non-null values; null when there are none."""
    total = sum_across([as_col(c).cast("double") for c in cols])
    present = reduce(lambda a, b: a + b, [as_col(c).isNotNull().cast("int") for c in cols])
    return ratio(total, present)


def any_across(flags: Sequence[Column]) -> Column:
    """Row-wise OR in which an unknown flag counts as false."""
    return reduce(lambda a, b: a | b, [F.coalesce(f, F.lit(False)) for f in flags])


def clip(c: Column | str, lo: float, hi: float) -> Column:
    x = as_col(c)
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(lo)), F.lit(hi)))


def platform_exp(x: Column) -> Column:
    """``exp`` of the platform. Spark's own is the portable one, whose last bit differs from the C
    library's in a tenth of the arguments; the JVM's differs in some thousandths."""
    return F.when(x.isNotNull(), F.reflect(F.lit("java.lang.Math"), F.lit("exp"), x).cast("double"))


def sigmoid(z: Column, exp: Callable[[Column], Column] = F.exp) -> Column:
    """Logistic function that only ever exponentiates a non-positive number."""
    e = exp(-F.abs(z))
    return F.when(z >= 0, 1.0 / (1.0 + e)).otherwise(e / (1.0 + e))


def seeded_hash(seed: int | str, *keys: Column | str) -> Column:
    """32 hex digits that order rows by key alone: same order on any partitioning."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[as_col(k).cast("string") for k in keys]))


def bins_below(edges: Column, x: Column | str) -> Column:
    """Left-closed bin number: how many edges are <= x."""
    value = as_col(x)
    return F.size(F.filter(edges, lambda e: e <= value))
