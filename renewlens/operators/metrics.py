"""Score metrics, overall and by segment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from renewlens.functions.scalars import as_col, clip
from renewlens.operators.ranking import ranked
from renewlens.sources.schemas import KEY

EPS = 1e-15
ALL = "all"
REPEAT = "repeat"
NEW = "new"


def row_log_loss(y: Column | str, p: Column | str, eps: float = EPS) -> Column:
    """Per-row loss; the probability is clipped so that a certain miss stays finite."""
    label, q = as_col(y), clip(as_col(p), eps, 1.0 - eps)
    return -F.when(label == 1, F.ln(q)).otherwise(F.ln(1.0 - q))


def log_loss(y: Column | str = "is_churn", p: Column | str = "p") -> Column:
    """Aggregate expression: mean clipped log loss."""
    return F.avg(row_log_loss(y, p))


def brier_score(y: Column | str = "is_churn", p: Column | str = "p") -> Column:
    error = as_col(p) - as_col(y)
    return F.avg(error * error)


def _require_rows(df: DataFrame, columns: list[Column]) -> DataFrame:
    """One-row aggregate that fails on empty input instead of answering null."""
    guarded = F.when(
        F.count(F.lit(1)) == 0, F.raise_error(F.lit("no rows: the metric is undefined"))
    ).otherwise(F.count(F.lit(1)))
    return df.agg(guarded.cast("bigint").alias("n"), *columns)


def log_loss_report(df: DataFrame, y: str = "is_churn", p: str = "p") -> DataFrame:
    return _require_rows(df, [log_loss(y, p).alias("log_loss"), brier_score(y, p).alias("brier")])


def constant_log_loss(df: DataFrame, prior: Column | float, y: str = "is_churn") -> DataFrame:
    """Loss of predicting one probability for everybody, from the mean label alone."""
    base = prior if isinstance(prior, Column) else F.lit(float(prior))
    stats = _require_rows(df, [F.avg(y).alias("rate")]).withColumn("prior", base)
    q = clip(F.col("prior"), EPS, 1.0 - EPS)
    loss = -(F.col("rate") * F.ln(q) + (1.0 - F.col("rate")) * F.ln(1.0 - q))
    return stats.select("n", "rate", "prior", loss.alias("constant_log_loss"))


def roc_auc(
    df: DataFrame, y: str = "is_churn", p: str = "p", *, by: tuple[str, ...] = ()
) -> DataFrame:
    """Mann-Whitney AUC; equal scores count half. One class only is an error.

    Labels are summed per distinct score first, and the negatives ranked below
    come from bucketed prefix sums. ``df`` should be a stored table.
    """
    per_score = df.groupBy(*by, p).agg(
        F.sum(y).alias("pos"), (F.count(F.lit(1)) - F.sum(y)).alias("neg")
    )
    running = ranked(per_score, p, sums=["neg"], by=by, key=None, descending=False)
    below = F.col("cum_neg") - F.col("neg")
    stats = running.groupBy(*by).agg(
        F.sum("pos").alias("n_pos"),
        F.sum("neg").alias("n_neg"),
        F.sum(F.col("pos") * (2 * below + F.col("neg"))).alias("wins2"),
    )
    pairs = F.col("n_pos").cast("double") * F.col("n_neg").cast("double")
    auc = F.when(
        pairs == 0, F.raise_error(F.lit("AUC needs both classes")).cast("double")
    ).otherwise(F.col("wins2") / (2.0 * pairs))
    return stats.select(*by, "n_pos", "n_neg", auc.alias("auc"))


def pr_auc(
    df: DataFrame, y: str = "is_churn", p: str = "p", *, by: tuple[str, ...] = ()
) -> DataFrame:
    """Average precision: precision at every distinct score, weighted by the recall it adds.

    Works like :func:`roc_auc`: labels per distinct score, then bucketed prefix sums from the top.
    Without a positive it is an error. ``df`` should be a stored table.
    """
    per_score = df.groupBy(*by, p).agg(F.sum(y).alias("pos"), F.count(F.lit(1)).alias("users"))
    running = ranked(per_score, p, sums=["pos", "users"], by=by, key=None)
    stats = running.groupBy(*by).agg(
        F.sum("pos").alias("n_pos"), F.sum(F.col("pos") * F.col("cum_pos") / F.col("cum_users")).alias("area")
    )
    area = F.when(
        F.col("n_pos") == 0, F.raise_error(F.lit("average precision needs a positive")).cast("double")
    ).otherwise(F.col("area") / F.col("n_pos"))
    return stats.select(*by, area.alias("pr_auc"))


def repeat_vs_new(df: DataFrame, previous: DataFrame, column: str = "segment") -> DataFrame:
    """Tag users already present in the previous cohort. For evaluation only, never a feature."""
    seen = previous.select(KEY).distinct().withColumn("seen", F.lit(True))
    return (
        df.join(seen, KEY, "left")
        .withColumn(column, F.when(F.col("seen"), REPEAT).otherwise(NEW))
        .drop("seen")
    )


def segment_report(
    df: DataFrame, segment: str = "segment", y: str = "is_churn", p: str = "p"
) -> DataFrame:
    """Per segment and in total: size, share, actual rate, mean prediction, log loss.

    ``rollup`` gives the total in the same pass; ``grouping`` tells it apart
    from a segment that happens to be null.
    """
    report = df.rollup(segment).agg(
        F.grouping(segment).alias("is_total"),
        F.count(F.lit(1)).alias("n"),
        F.avg(y).alias("actual_rate"),
        F.avg(p).alias("mean_pred"),
        log_loss(y, p).alias("log_loss"),
    )
    total = df.agg(F.count(F.lit(1))).scalar()
    return report.select(
        F.when(F.col("is_total") == 1, ALL).otherwise(F.col(segment)).alias("segment"),
        "n",
        (F.col("n") / total).alias("share"),
        "actual_rate",
        "mean_pred",
        "log_loss",
    )
