"""Renewal labels from the transaction history.

The documented comparator orders a user's transactions by date, then by a
concatenated text key (descending), then non-cancel before cancel, then by
expiry. Rows equal in the first three keys only differ in expiry, and only the
extremes matter, so the history is compacted to one row per such key first: a
hot user shrinks before anything is shuffled on the user alone, and neither a
sort nor a window over raw rows is needed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from renewlens.functions.dates import days_between_sql
from renewlens.sources.schemas import KEY, NO_RENEWAL_GAP

CHURN_GAP_DAYS = 30

# Printable ASCII mirrored, so that an ascending comparison of the mapped text
# is a descending comparison of the original. The terminator sorts last and
# makes "12" come after "123" once reversed.
_PRINTABLE = "".join(chr(i) for i in range(32, 127))
_TERMINATOR = chr(127)


@dataclass(frozen=True)
class LabelSpec:
    """Which history decides the expiry, and which expiries make a candidate."""

    name: str
    history_start: int
    history_end: int
    expire_start: int
    expire_end: int


# The published months and the two rebuilt ones.
LABEL_SPECS: dict[str, LabelSpec] = {
    s.name: s
    for s in (
        LabelSpec("feb", 20170101, 20170131, 20170201, 20170228),
        LabelSpec("mar", 20170201, 20170228, 20170301, 20170331),
        LabelSpec("dec2016", 20161101, 20161130, 20161201, 20161231),
        LabelSpec("jan2017", 20161201, 20161231, 20170101, 20170131),
    )
}


def _descending_text(c: Column) -> Column:
    return F.concat(F.translate(c, _PRINTABLE, _PRINTABLE[::-1]), F.lit(_TERMINATOR))


def official_keys(tx: DataFrame) -> DataFrame:
    """Compact the text transactions to the distinct sort keys of each user.

    ``first_expire`` / ``last_expire`` are the expiries of the first and last
    row of the run: cancels sort by descending, others by ascending expiry.
    """
    cancel = F.col("is_cancel") == "1"
    sig = F.concat("plan_list_price", "payment_plan_days", "payment_method_id")
    return (
        tx.select(
            KEY,
            F.col("transaction_date").cast("int").alias("day"),
            _descending_text(sig).alias("sig_desc"),
            cancel.cast("int").alias("cancel"),
            F.col("membership_expire_date").cast("int").alias("expire"),
        )
        .groupBy(KEY, "day", "sig_desc", "cancel")
        .agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.min("expire").alias("lo"),
            F.max("expire").alias("hi"),
        )
        .select(
            KEY,
            "day",
            "sig_desc",
            "cancel",
            "n_rows",
            "lo",
            F.when(F.col("cancel") == 1, F.col("lo")).otherwise(F.col("hi")).alias("last_expire"),
        )
    )


def row_index_per_user(tx: DataFrame) -> DataFrame:
    """0-based position of every distinct sort key in the official order.

    Runs over the compacted keys, so the per-user window is bounded by the
    number of distinct days and plans rather than by raw rows.
    """
    w = Window.partitionBy(KEY).orderBy("day", "sig_desc", "cancel")
    before = F.sum("n_rows").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return official_keys(tx).select(
        KEY,
        F.col("day").alias("transaction_date"),
        F.col("cancel").alias("is_cancel"),
        "n_rows",
        (before - F.col("n_rows")).alias("first_index"),
    )


def last_expire(tx: DataFrame, spec: LabelSpec) -> DataFrame:
    """Expiry declared by the last history row in the official order."""
    history = tx.filter(
        F.col("transaction_date").between(str(spec.history_start), str(spec.history_end))
    )
    return (
        official_keys(history)
        .groupBy(KEY)
        .agg(F.max_by("last_expire", F.struct("day", "sig_desc", "cancel")).alias("last_expire"))
    )


def label_candidates(tx: DataFrame, spec: LabelSpec) -> DataFrame:
    """Users whose last declared expiry falls in the window."""
    return last_expire(tx, spec).filter(
        F.col("last_expire").between(spec.expire_start, spec.expire_end)
    )


def first_renewal(keys: DataFrame) -> DataFrame:
    """Position and day of the first transaction that is not a cancellation."""
    return (
        keys.filter("cancel = 0")
        .groupBy(KEY)
        .agg(F.min(F.struct("day", "sig_desc")).alias("renewal"))
    )


def earliest_cancel_before_renewal(keys: DataFrame, renewals: DataFrame) -> DataFrame:
    """Earliest expiry among the cancellations placed before the first renewal.

    At an equal (day, text key) the non-cancel row comes first, so the
    comparison is strict.
    """
    return (
        keys.filter("cancel = 1")
        .join(renewals, KEY, "inner")
        .filter(F.struct("day", "sig_desc") < F.col("renewal"))
        .groupBy(KEY)
        .agg(F.min("lo").alias("cancel_expire"))
    )


def renewal_gap(tx: DataFrame, candidates: DataFrame, spec: LabelSpec) -> DataFrame:
    """Days from the effective expiry to the first renewal; may be negative.

    The walk "cancellations pull the expiry forward until a renewal settles it"
    only ever lowers the expiry, so a minimum replaces the row-by-row state.
    """
    keys = official_keys(tx.filter(F.col("transaction_date") > str(spec.history_end)))
    renewals = first_renewal(keys)
    cancels = earliest_cancel_before_renewal(keys, renewals)
    days = days_between_sql("renewal_day", "effective")
    return (
        candidates.join(renewals, KEY, "left")
        .join(cancels, KEY, "left")
        .selectExpr(
            KEY,
            "last_expire",
            "renewal.day as renewal_day",
            "least(last_expire, cancel_expire) as effective",
        )
        .selectExpr(
            KEY,
            "last_expire",
            f"case when renewal_day is null then {NO_RENEWAL_GAP} else {days} end as gap",
        )
    )


def build_labels(
    tx: DataFrame, spec: LabelSpec, *, churn_gap_days: int = CHURN_GAP_DAYS
) -> DataFrame:
    """Candidates with their gap and the 0/1 churn label."""
    gaps = renewal_gap(tx, label_candidates(tx, spec), spec)
    return gaps.select(
        KEY, (F.col("gap") >= churn_gap_days).cast("int").alias("is_churn"), "gap", "last_expire"
    )
