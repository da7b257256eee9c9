"""Smoothed target encoding, out of fold by subtraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from renewlens.operators.guards import Finding, GuardViolation
from renewlens.operators.split import folds_stratified
from renewlens.sources.schemas import KEY

SMOOTHING = 100.0
N_FOLDS = 5


def reject_identifier(column: str) -> None:
    """The user key encodes one label each: naive encoding copies it, OOF is constant."""
    if column in (KEY, "msno"):
        raise ValueError(f"{column!r} identifies a single user and must not be target-encoded")


def category_stats(df: DataFrame, column: str, label: str = "is_churn") -> DataFrame:
    """Positives and rows per category (null is a category of its own)."""
    return df.groupBy(column).agg(F.sum(label).alias("pos"), F.count(F.lit(1)).alias("n"))


def smoothed(pos: Column, n: Column, prior: Column, smoothing: float) -> Column:
    return (pos + prior * smoothing) / (n + smoothing)


def target_encode_fit(
    train: DataFrame, column: str, label: str = "is_churn", smoothing: float = SMOOTHING
) -> DataFrame:
    """Category -> encoding, plus the prior, from training rows only."""
    prior = train.agg(
        F.coalesce(
            F.avg(label), F.raise_error(F.lit("no rows to fit the encoder on")).cast("double")
        )
    ).scalar()
    stats = category_stats(train, column, label).withColumn("prior", prior)
    return stats.select(
        column,
        "n",
        "pos",
        smoothed(F.col("pos"), F.col("n"), F.col("prior"), smoothing).alias("encoding"),
        "prior",
    )


def target_encode_apply(
    df: DataFrame, encoder: DataFrame, column: str, out: str | None = None
) -> DataFrame:
    """Left join on the category; unseen categories get the prior, not null."""
    name = out or f"{column}_te"
    table = encoder.select(F.col(column).alias("encoder_key"), F.col("encoding").alias(name))
    prior = encoder.agg(F.max("prior")).scalar()
    joined = df.join(table, df[column].eqNullSafe(F.col("encoder_key")), "left")
    return joined.drop("encoder_key").withColumn(name, F.coalesce(name, prior))


def target_encode_oof(
    df: DataFrame,
    column: str,
    *,
    label: str = "is_churn",
    k: int = N_FOLDS,
    seed: int = 42,
    smoothing: float = SMOOTHING,
    out: str | None = None,
) -> DataFrame:
    """Each row encoded from the other folds: totals minus the row's own fold.

    One grouping on (category, fold) serves all folds. A category that exists
    in one fold only has nothing left after the subtraction and falls back to
    that fold's prior by the formula itself.
    """
    reject_identifier(column)
    name = out or f"{column}_te"
    rows = folds_stratified(df, k=k, seed=seed, label=label)
    per = rows.groupBy(column, "fold").agg(F.sum(label).alias("pos"), F.count(F.lit(1)).alias("n"))
    by_category = per.groupBy(F.col(column).alias("c_key")).agg(
        F.sum("pos").alias("c_pos"), F.sum("n").alias("c_n")
    )
    by_fold = per.groupBy(F.col("fold").alias("f_key")).agg(
        F.sum("pos").alias("f_pos"), F.sum("n").alias("f_n")
    )
    overall = per.agg(F.struct(F.sum("pos").alias("pos"), F.sum("n").alias("n"))).scalar()
    table = (
        per.join(by_category, per[column].eqNullSafe(F.col("c_key")))
        .join(by_fold, F.col("fold") == F.col("f_key"))
        .withColumn("all", overall)
    )
    rest = F.col("all.n") - F.col("f_n")
    prior = (F.col("all.pos") - F.col("f_pos")) / F.nullif(rest, F.lit(0))
    encoded = table.select(
        F.col(column).alias("encoder_key"),
        F.col("fold").alias("encoder_fold"),
        smoothed(F.col("c_pos") - F.col("pos"), F.col("c_n") - F.col("n"), prior, smoothing).alias(
            name
        ),
    )
    joined = rows.join(
        encoded,
        rows[column].eqNullSafe(F.col("encoder_key")) & (rows["fold"] == F.col("encoder_fold")),
        "left",
    )
    return joined.drop("encoder_key", "encoder_fold")


def target_encode_naive(
    df: DataFrame, column: str, *, label: str = "is_churn", smoothing: float = SMOOTHING
) -> DataFrame:
    """Fit and apply on the same rows. A control for the leakage experiment only."""
    return target_encode_apply(df, target_encode_fit(df, column, label, smoothing), column)


def find_leaked_labels(df: DataFrame, encoded: str, label: str = "is_churn", tolerance: float = 1e-9) -> Finding:
    """G6 as a finding: an encoding equal to the label row by row has seen that label."""
    row = df.agg(F.max(F.abs(F.col(encoded) - F.col(label))).alias("gap"), F.count(F.lit(1)).alias("n")).first()
    seen = row["gap"] is None or row["gap"] <= tolerance
    return Finding("encoding_is_oof", encoded, row["n"] if seen else 0, None, "equal the label in every row")


def check_encoding_is_oof(
    df: DataFrame, encoded: str, label: str = "is_churn", tolerance: float = 1e-9
) -> None:
    found = find_leaked_labels(df, encoded, label, tolerance)
    found.verify()
    if df.isEmpty():
        raise GuardViolation(f"encoding_is_oof: {encoded} has no rows to judge")


def category_levels(train: DataFrame, column: str, missing: int = -1) -> DataFrame:
    """Distinct non-missing categories of the training rows."""
    return (
        train.select(F.col(column).alias("level"))
        .filter(F.col("level").isNotNull() & (F.col("level") != missing))
        .distinct()
    )
