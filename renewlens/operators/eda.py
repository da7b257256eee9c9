"""Descriptive reports over the as-of table: one grouping each."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from renewlens.sources.schemas import AGE_RANGE, EXPIRY_SENTINELS


def _size_and_rate() -> list[Column]:
    return [F.count(F.lit(1)).alias("n_users"), F.avg("is_churn").alias("churn_rate")]


def _rates(df: DataFrame, *by: Column | str) -> DataFrame:
    return df.groupBy(*by).agg(*_size_and_rate())


def cohort_rates(train: DataFrame, valid: DataFrame) -> DataFrame:
    """Churn rate of both cohorts, relative change, loss of predicting the first on the second."""
    first = train.agg(F.avg("is_churn")).scalar()
    rows = valid.agg(F.avg("is_churn").alias("valid_rate")).withColumn("train_rate", first)
    loss = -(
        F.col("valid_rate") * F.ln("train_rate")
        + (1 - F.col("valid_rate")) * F.ln(1 - F.col("train_rate"))
    )
    return rows.select(
        "train_rate",
        "valid_rate",
        (F.col("valid_rate") / F.col("train_rate") - 1).alias("relative_change"),
        loss.alias("constant_log_loss"),
    )


def history_bins(cohort: DataFrame) -> DataFrame:
    """Churn rate by length of the transaction history."""
    n = F.col("n_tx")
    label = (
        F.when(n <= 2, "1-2").when(n <= 6, "3-6").when(n <= 12, "7-12").when(n <= 24, "13-24")
    ).otherwise("25+")
    return _rates(cohort, label.alias("bin"))


def cancel_x_autorenew(cohort: DataFrame) -> DataFrame:
    """Cross of the two last-day flags; unknown is a level of its own.

    Grouping sets add each flag alone in the same pass; ``level`` says which.
    """
    cube = cohort.cube("last_is_cancel", "last_is_auto_renew").agg(
        F.grouping("last_is_cancel").alias("no_cancel"),
        F.grouping("last_is_auto_renew").alias("no_renew"),
        *_size_and_rate(),
    )
    level = (
        F.when((F.col("no_cancel") == 0) & (F.col("no_renew") == 0), "both")
        .when(F.col("no_cancel") == 0, "cancel")
        .when(F.col("no_renew") == 0, "auto_renew")
    )
    return cube.withColumn("level", level).filter("level is not null").drop("no_cancel", "no_renew")


def rule_segments(cohort: DataFrame) -> DataFrame:
    """Cancelled, auto-renewal off, rest (in that order), with shares of users and churn."""
    segment = (
        F.when(F.col("last_is_cancel") == 1, "A_cancelled")
        .when(F.col("last_is_auto_renew") == 0, "B_auto_renew_off")
        .otherwise("C_rest")
    )
    totals = cohort.agg(
        F.struct(F.count(F.lit(1)).alias("n"), F.sum("is_churn").alias("k"))
    ).scalar()
    return (
        cohort.groupBy(segment.alias("segment"))
        .agg(*_size_and_rate(), F.sum("is_churn").alias("n_churn"))
        .withColumn("t", totals)
        .select(
            "segment",
            "n_users",
            "n_churn",
            "churn_rate",
            (F.col("n_users") / F.col("t.n")).alias("user_share"),
            (F.col("n_churn") / F.nullif(F.col("t.k"), F.lit(0))).alias("churn_share"),
        )
    )


def age_validity(cohort: DataFrame) -> DataFrame:
    """Churn by plausibility of the age, with counts of the odd values."""
    age = F.col("bd")
    group = (
        F.when(age.isNull(), "null").when(age.between(*AGE_RANGE), "valid").otherwise("outlier")
    )
    return cohort.groupBy(group.alias("age_group")).agg(
        *_size_and_rate(),
        F.count_if(age == 0).alias("n_zero"),
        F.count_if(age < 0).alias("n_negative"),
        F.count_if(age > AGE_RANGE[1]).alias("n_over"),
    )


def gender_rates(cohort: DataFrame) -> DataFrame:
    return _rates(cohort, F.coalesce("gender", F.lit("(missing)")).alias("gender"))


def member_coverage(cohort: DataFrame) -> DataFrame:
    return _rates(cohort, "in_members")


def payment_method_churn(cohort: DataFrame, min_users: int = 500) -> DataFrame:
    """Methods with enough users for a stable rate."""
    return _rates(cohort, "last_payment_method_id").filter(F.col("n_users") >= min_users)


def plan_days_churn(cohort: DataFrame) -> DataFrame:
    total = cohort.agg(F.count(F.lit(1))).scalar()
    return _rates(cohort, "last_payment_plan_days").withColumn(
        "user_share", F.col("n_users") / total
    )


def sentinel_census(tx: DataFrame, far: int = 20180101) -> DataFrame:
    """Odd values over all transactions, in one pass."""
    expire, day = F.col("membership_expire_date"), F.col("transaction_date")
    paid, price = F.col("actual_amount_paid"), F.col("plan_list_price")
    return tx.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(expire == EXPIRY_SENTINELS[0]).alias("expire_epoch"),
        F.count_if(expire > far).alias("expire_far"),
        F.count_if(day > expire).alias("recorded_after_expire"),
        F.count_if(paid == 0).alias("paid_zero"),
        F.count_if(paid < price).alias("paid_below_price"),
    )


def flag_profile(features: DataFrame, column: str = "last_is_cancel") -> DataFrame:
    """How often a flag is set or unknown in a feature table."""
    flag = F.col(column)
    return features.agg(
        F.count_if(flag == 1).alias("n_set"),
        F.avg(F.coalesce((flag == 1).cast("int"), F.lit(0))).alias("set_share"),
        F.count_if(flag.isNull()).alias("n_missing"),
    )


