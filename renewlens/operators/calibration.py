"""Calibration diagnosis and the isotonic calibrator."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from renewlens.functions.scalars import bins_below
from renewlens.operators.metrics import ALL, brier_score, log_loss, roc_auc, row_log_loss
from renewlens.operators.quantiles import exact_quantiles, value_counts
from renewlens.session import stage

DEFAULT_BINS = 10
MIN_BIN_COUNT = 1000
JEFFREYS = 0.5


def calibration_in_the_large(df: DataFrame, y: str = "is_churn", p: str = "p") -> DataFrame:
    """Signed bias of the mean prediction."""
    stats = df.agg(
        F.count(F.lit(1)).alias("n"), F.avg(y).alias("actual_rate"), F.avg(p).alias("mean_pred")
    )
    return stats.select(
        "*",
        (F.col("mean_pred") - F.col("actual_rate")).alias("bias"),
        F.when(
            F.col("actual_rate") > 0, F.col("mean_pred") / F.col("actual_rate") - 1
        ).alias("relative_bias"),
    )


def _edges(df: DataFrame, p: str, bins: int, strategy: str, by: list[str]) -> DataFrame:
    """Bin edges as one sorted array per group, stored: both uses must see the same edges."""
    if strategy == "uniform":
        ticks = F.array(*[F.lit(i / bins) for i in range(bins + 1)])
        groups = df.select(*by).distinct() if by else df.sparkSession.range(1)
        return groups.withColumn("edges", ticks).select(*by, "edges")
    if strategy != "quantile":
        raise ValueError(f"unknown binning strategy {strategy!r}: use 'quantile' or 'uniform'")
    counts = stage(value_counts(df, p, keys=by), "score-counts")
    return stage(
        exact_quantiles(counts, [i / bins for i in range(bins + 1)], keys=by)
        .groupBy(*by)
        .agg(F.array_sort(F.collect_set("quantile")).alias("edges")),
        "edges",
    )


def reliability_curve(
    df: DataFrame,
    y: str = "is_churn",
    p: str = "p",
    *,
    n_bins: int = DEFAULT_BINS,
    strategy: str = "quantile",
    min_count: int = MIN_BIN_COUNT,
    by: tuple[str, ...] = (),
) -> DataFrame:
    """Mean prediction against observed rate per bin (per ``by`` group if given).

    Quantile edges are exact and deduplicated; a bin is the number of inner
    edges <= p. Bins without rows are dropped but keep their number; thin bins
    stay, flagged ``enough = false``.
    """
    keys = list(by)
    edges = _edges(df, p, n_bins, strategy, keys)

    def attach(table: DataFrame) -> DataFrame:
        """Edges next to each row: a join on the group, one scalar without groups."""
        if keys:
            return table.join(edges, keys, "inner")
        return table.withColumn("edges", edges.select("edges").scalar())

    tagged = attach(df)
    inner_edges = F.slice("edges", F.lit(2), F.greatest(F.size("edges") - 2, F.lit(0)))
    rows = tagged.filter(F.size("edges") > 1).select(
        *keys, (bins_below(inner_edges, p) + 1).alias("bin"), F.col(y).alias("y"), p
    )
    curve = rows.groupBy(*keys, "bin").agg(
        F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_pred"), F.avg("y").alias("actual_rate")
    )
    return attach(curve).select(
        *keys,
        "bin",
        F.element_at("edges", F.col("bin")).alias("lo"),
        F.element_at("edges", F.col("bin") + 1).alias("hi"),
        "n",
        "mean_pred",
        "actual_rate",
        (F.col("mean_pred") - F.col("actual_rate")).alias("gap"),
        (F.col("n") >= min_count).alias("enough"),
    )


def ece(curve: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Size-weighted mean absolute gap, and the largest gap among well-filled bins."""
    gap = F.abs(F.col("mean_pred") - F.col("actual_rate"))
    return curve.groupBy(*by).agg(
        (F.sum(F.col("n") * gap) / F.sum("n")).alias("ece"),
        F.max(F.when(F.col("enough"), gap)).alias("mce"),
        F.count(F.lit(1)).alias("n_bins"),
    )


def mce(curve: DataFrame) -> DataFrame:
    """Largest gap among bins with enough rows; null when there is none."""
    gap = F.abs(F.col("mean_pred") - F.col("actual_rate"))
    return curve.agg(F.max(F.when(F.col("enough"), gap)).alias("mce"))


def tie_profile(df: DataFrame, p: str = "p") -> DataFrame:
    """How much ranking resolution the scores have left."""
    groups = df.groupBy(p).agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(
        F.count(F.lit(1)).alias("n_distinct"),
        (F.max("n") / F.sum("n")).alias("max_tie_share"),
        (F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)) / F.sum("n")).alias("tied_share"),
    )


@dataclass(frozen=True)
class Calibrator:
    """A monotone mapping with bounds that keep the loss finite."""

    model: IsotonicRegressionModel
    n_fit: int
    floor: float
    ceiling: float
    n_zero_block: int

    def apply(self, df: DataFrame, p: str = "p", out: str = "p_calibrated") -> DataFrame:
        """Map and clip; scores outside the fitted range take the end values."""
        model = self.model.copy().setFeaturesCol("score_in").setPredictionCol("score_out")
        rows = df.withColumn("score_in", F.col(p).cast("double"))
        clipped = F.least(F.greatest("score_out", F.lit(self.floor)), F.lit(self.ceiling))
        return model.transform(rows).withColumn(out, clipped).drop("score_in", "score_out")

    def knots(self, df: DataFrame) -> DataFrame:
        """Turning points of the mapping, as a small table."""
        spark = df.sparkSession
        pairs = [
            (float(x), min(max(float(v), self.floor), self.ceiling))
            for x, v in zip(self.model.boundaries, self.model.predictions, strict=True)
        ]
        return spark.createDataFrame(pairs, "raw double, calibrated double")

    def n_levels(self, df: DataFrame) -> DataFrame:
        return self.knots(df).agg(F.countDistinct("calibrated").alias("n_levels"))


def edge_bounds(n_zero: int, n_one: int) -> tuple[float, float]:
    """Floor and ceiling from the sizes of the all-negative and all-positive blocks."""
    floor = JEFFREYS / (n_zero + 1) if n_zero else 0.0
    ceiling = 1.0 - JEFFREYS / (n_one + 1) if n_one else 1.0
    return floor, ceiling


def fit_isotonic(
    df: DataFrame,
    y: str = "is_churn",
    p: str = "p",
    *,
    floor: float | None = None,
    ceiling: float | None = None,
) -> Calibrator:
    """Fit on a held-out segment.

    Rows of exactly equal score are merged to one weighted point first; pooling
    runs inside partitions before the last step, so blocks travel and not users.
    """
    points = stage(
        df.select(F.col(y).cast("double").alias("y"), F.col(p).cast("double").alias("x"))
        .groupBy("x")
        .agg(
            F.avg("y").alias("label"),
            F.count(F.lit(1)).alias("n"),
            F.min("y").alias("y_min"),
            F.max("y").alias("y_max"),
            F.count_if(~F.col("y").isin(0.0, 1.0)).alias("bad"),
        )
        .withColumn("weight", F.col("n").cast("double")),
        "isotonic-points",
    )
    stats = points.agg(F.sum("n"), F.min("y_min"), F.max("y_max"), F.sum("bad")).first()
    if not stats[0]:
        raise ValueError("no rows to fit the calibrator on")
    if stats[3]:
        raise ValueError("calibration labels must be 0 or 1")
    if stats[1] == stats[2]:
        raise ValueError("calibration labels have a single class: the mapping would be constant")
    model = IsotonicRegression(
        featuresCol="x", labelCol="label", weightCol="weight", isotonic=True
    ).fit(points)
    fitted = model.transform(points)
    blocks = fitted.agg(
        F.coalesce(F.sum(F.when(F.col("prediction") <= 0, F.col("n"))), F.lit(0)),
        F.coalesce(F.sum(F.when(F.col("prediction") >= 1, F.col("n"))), F.lit(0)),
    ).first()
    auto_floor, auto_ceiling = edge_bounds(blocks[0], blocks[1])
    return Calibrator(
        model,
        int(stats[0]),
        auto_floor if floor is None else floor,
        auto_ceiling if ceiling is None else ceiling,
        int(blocks[0]),
    )


def with_total_segment(df: DataFrame, segment: str = "segment") -> DataFrame:
    """Each row once for its segment and once for the total."""
    return df.withColumn(segment, F.explode(F.array(F.col(segment), F.lit(ALL))))


def calibration_compare(
    df: DataFrame,
    stages: dict[str, str],
    *,
    y: str = "is_churn",
    segment: str = "segment",
    min_count: int = MIN_BIN_COUNT,
) -> DataFrame:
    """Every metric for each stage (score column) and segment, in long form."""
    scored = with_total_segment(df, segment)
    values = F.array(
        *[F.struct(F.lit(s).alias("stage"), F.col(c).alias("p")) for s, c in stages.items()]
    )
    long = stage(
        scored.select(segment, F.col(y).alias("y"), F.explode(values).alias("v")).select(
            segment, "y", "v.stage", "v.p"
        ),
        "stages",
    )
    keys = ("stage", segment)
    basic = long.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("y").alias("actual_rate"),
        F.avg("p").alias("mean_pred"),
        log_loss("y", "p").alias("log_loss"),
        brier_score("y", "p").alias("brier"),
    )
    curve = reliability_curve(long, "y", "p", by=keys, min_count=min_count)
    return (
        basic.join(ece(curve, keys), list(keys))
        .join(roc_auc(long, "y", "p", by=keys).select(*keys, "auc"), list(keys))
        .withColumn("relative_bias", F.col("mean_pred") / F.col("actual_rate") - 1)
    )


def calibration_summary(
    df: DataFrame,
    y: str = "is_churn",
    p: str = "p",
    *,
    segment: str = "segment",
    min_count: int = MIN_BIN_COUNT,
) -> DataFrame:
    """Per segment: rate, mean prediction, relative bias, loss, Brier, ECE and MCE."""
    scored = stage(
        with_total_segment(df.select(segment, y, p), segment), "calibration-summary"
    )
    basic = scored.groupBy(segment).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(y).alias("actual_rate"),
        F.avg(p).alias("mean_pred"),
        log_loss(y, p).alias("log_loss"),
        brier_score(y, p).alias("brier"),
    )
    curve = reliability_curve(scored, y, p, by=(segment,), min_count=min_count)
    return basic.join(ece(curve, (segment,)), segment).withColumn(
        "relative_bias", F.col("mean_pred") / F.col("actual_rate") - 1
    )


def loss_decomposition(
    df: DataFrame, at_floor, *, y: str = "is_churn", raw: str = "p", cal: str = "p_calibrated"
) -> DataFrame:
    """Loss before and after, split into the floor block and the rest.

    Each part is divided by the total number of rows, so the parts add up to
    the overall loss.
    """
    total = df.agg(F.count(F.lit(1))).scalar()
    part = F.when(at_floor, "floor_block").otherwise("rest")
    return (
        df.groupBy(part.alias("part"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg(y).alias("actual_rate"),
            F.avg(raw).alias("mean_raw"),
            F.avg(cal).alias("mean_calibrated"),
            F.sum(row_log_loss(y, raw)).alias("loss_raw"),
            F.sum(row_log_loss(y, cal)).alias("loss_cal"),
        )
        .select(
            "part",
            "n",
            (F.col("n") / total).alias("share"),
            "actual_rate",
            "mean_raw",
            "mean_calibrated",
            (F.col("loss_raw") / total).alias("contribution_raw"),
            (F.col("loss_cal") / total).alias("contribution_calibrated"),
        )
    )
