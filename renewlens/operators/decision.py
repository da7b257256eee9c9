"""From probabilities to an offer list and its simulated value.

Money sums run over integer score units (1e-6), so the result does not depend
on the order in which partitions are added up.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from renewlens.operators.ranking import argmax_row, ranked, top_fraction
from renewlens.session import stage
from renewlens.sources.schemas import KEY

SCORE_UNITS = 1_000_000
DAYS_PER_MONTH = 30.4


@dataclass(frozen=True)
class BusinessParams:
    """Published offer cost, save rate and month length."""

    c_offer: float = 150.0
    r_save: float = 0.15
    days_per_month: float = DAYS_PER_MONTH


# The published sensitivity grid and curve resolution.
R_GRID = (0.05, 0.10, 0.15, 0.20, 0.25, 0.30)
C_GRID = (10.0, 30.0, 50.0, 100.0, 150.0, 200.0, 250.0, 300.0)
CURVE_STEP = 0.002


def decision_threshold(*, r_save: float, ltv_saved: float, c_offer: float) -> float:
    """Break-even probability of an offer."""
    if r_save <= 0 or ltv_saved <= 0:
        raise ValueError(f"save rate and saved value must be positive: {r_save}, {ltv_saved}")
    if c_offer < 0:
        raise ValueError(f"offer cost must not be negative: {c_offer}")
    return c_offer / (r_save * ltv_saved)


def expected_months(monthly_churn_rate: float) -> float:
    """Expected further months under a constant monthly risk."""
    if not 0 < monthly_churn_rate < 1:
        raise ValueError(f"monthly churn rate must lie in (0, 1): {monthly_churn_rate}")
    return 1.0 / monthly_churn_rate


def _checked(ok: Column, value: Column, message: str) -> Column:
    return F.when(ok, value).otherwise(F.raise_error(F.lit(message)).cast("double"))


def monthly_arpu(features: DataFrame, days_per_month: float = DAYS_PER_MONTH) -> DataFrame:
    """Mean paid price per day of the non-null rows, as a monthly amount.

    Prices are averaged in integer units for a repeatable result.
    """
    units = F.round(F.col("price_per_day") * SCORE_UNITS).cast("bigint")
    mean = F.sum(units) / F.count(units) / float(SCORE_UNITS)
    return features.agg(
        _checked(
            F.count(units) > 0,
            F.when(F.count(units) > 0, mean * days_per_month),
            "price_per_day is null everywhere: monthly revenue cannot be estimated",
        ).alias("monthly_arpu")
    )


def resolve_assumptions(
    features: DataFrame,
    previous: DataFrame,
    params: BusinessParams = BusinessParams(),
    *,
    months_source: str = "previous_cohort_churn_rate",
) -> DataFrame:
    """One row with every assumption and the threshold derived from them.

    The churn rate comes from the *previous* cohort: the evaluated cohort's own
    rate is the answer and may not set a business constant.
    """
    if params.r_save <= 0:
        raise ValueError(f"save rate must be positive: {params.r_save}")
    if params.c_offer < 0:
        raise ValueError(f"offer cost must not be negative: {params.c_offer}")
    rate = previous.agg(F.avg("is_churn")).scalar()
    base = monthly_arpu(features, params.days_per_month).withColumn("prior_churn_rate", rate)
    months = _checked(
        (F.col("prior_churn_rate") > 0) & (F.col("prior_churn_rate") < 1),
        1.0 / F.nullif(F.col("prior_churn_rate"), F.lit(0.0)),
        "previous churn rate must lie in (0, 1)",
    )
    return (
        base.withColumn("expected_months", months)
        .withColumn("ltv_saved", F.col("monthly_arpu") * F.col("expected_months"))
        .withColumn("r_save", F.lit(float(params.r_save)))
        .withColumn("c_offer", F.lit(float(params.c_offer)))
        .withColumn("p_star", F.col("c_offer") / (F.col("r_save") * F.col("ltv_saved")))
        .withColumn("months_source", F.lit(months_source))
    )


def _one(assumptions: DataFrame) -> Column:
    """The single assumptions row as a scalar subquery (evaluated once, no join)."""
    return assumptions.select(
        F.struct("r_save", "c_offer", "ltv_saved", "p_star").alias("a")
    ).scalar()


def with_score_units(df: DataFrame, p: str = "p") -> DataFrame:
    return df.withColumn("p_units", F.round(F.col(p) * SCORE_UNITS).cast("bigint"))


def rank_by_score(
    scored: DataFrame, p: str = "p", y: str = "is_churn", *, by: Sequence[str] = ()
) -> DataFrame:
    """Descending score rank with running score and label sums.

    ``scored`` should be a stored table. Ties fall in hash order of the user.
    """
    return ranked(with_score_units(scored, p), p, sums=["p_units", y], by=by)


def curve_steps(step: float) -> int:
    """Number of curve points for a step in (0, 1]."""
    if not 0 < step <= 1:
        raise ValueError(f"step must lie in (0, 1]: {step}")
    return max(1, math.ceil((1.0 + step / 2 - step) / step))


def campaign_curve(
    scored: DataFrame,
    assumptions: DataFrame,
    *,
    step: float = CURVE_STEP,
    p: str = "p",
    y: str = "is_churn",
    by: Sequence[str] = (),
) -> DataFrame:
    """Value of targeting the top K share, for K = step, 2*step, ... 1.

    The grid of sizes is generated from the row count of each group and meets
    the ranking in an equi-join on the rank, so only the wanted ranks survive.
    """
    by = list(by)
    order = rank_by_score(scored, p, y, by=by)
    totals = scored.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(y).alias("base_rate")
    ) if by else scored.agg(F.count(F.lit(1)).alias("n"), F.avg(y).alias("base_rate"))
    sizes = (
        totals.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(curve_steps(step) - 1))))
        .withColumn("k", F.lit(step) + F.col("i") * F.lit(step))
        .withColumn(
            "size",
            F.greatest(F.least(F.rint(F.col("k") * F.col("n")), F.col("n")), F.lit(1.0)).cast(
                "bigint"
            ),
        )
    )
    points = order.select(
        *by, F.col("rank").alias("size"), F.col(p).alias("threshold_p"), "cum_p_units", f"cum_{y}"
    )
    a = _one(assumptions)
    joined = sizes.join(points, [*by, "size"], "inner").withColumn("a", a)
    gain, cost = F.col("a.r_save") * F.col("a.ltv_saved"), F.col("size") * F.col("a.c_offer")
    precision = F.col(f"cum_{y}") / F.col("size")
    return joined.select(
        *by,
        "k",
        F.col("size").alias("n_targeted"),
        "threshold_p",
        (F.col("cum_p_units") / float(SCORE_UNITS) * gain - cost).alias("expected_net"),
        (F.col(f"cum_{y}") * gain - cost).alias("settled_net"),
        F.col(f"cum_{y}").cast("bigint").alias("hits"),
        precision.alias("precision"),
        F.when(F.col("base_rate") > 0, precision / F.col("base_rate")).alias("lift"),
    )


def optimal_point(curve: DataFrame, by: str = "expected_net") -> DataFrame:
    """The curve row with the largest value, the smallest K on ties."""
    if by not in curve.columns:
        raise KeyError(f"curve has no column {by!r}")
    points = stage(curve, "curve")
    if points.isEmpty():
        raise ValueError("an empty curve has no optimal point")
    return argmax_row(points, by, "k")


def campaign_by_segment(
    scored: DataFrame,
    assumptions: DataFrame,
    *,
    step: float = CURVE_STEP,
    segment: str = "segment",
    p: str = "p",
    y: str = "is_churn",
) -> DataFrame:
    """Best expected point for everybody and for each segment."""
    from renewlens.operators.calibration import with_total_segment

    rows = stage(with_total_segment(scored.select(KEY, segment, y, p), segment), "segments")
    curve = campaign_curve(rows, assumptions, step=step, p=p, y=y, by=[segment])
    best = curve.groupBy(segment).agg(
        F.max_by(
            F.struct(*[c for c in curve.columns if c != segment]),
            F.struct(F.col("expected_net"), -F.col("k")),
        ).alias("best")
    )
    sizes = rows.groupBy(segment).agg(F.count(F.lit(1)).alias("n"))
    return best.select(segment, "best.*").join(sizes, segment).withColumnRenamed("k", "best_share")


def subset_calibration(
    scored: DataFrame, k: float, *, p: str = "p", y: str = "is_churn"
) -> DataFrame:
    """Bias of the top ``k`` share itself, not of the whole cohort."""
    top = top_fraction(ranked(with_score_units(scored, p), p), k)
    stats = top.agg(
        F.count(F.lit(1)).alias("n_targeted"),
        (F.sum("p_units") / F.count(F.lit(1)) / float(SCORE_UNITS)).alias("mean_pred"),
        F.avg(y).alias("actual_rate"),
    )
    return stats.select(
        "*",
        (F.col("mean_pred") - F.col("actual_rate")).alias("bias"),
        F.when(
            F.col("actual_rate") > 0, F.col("mean_pred") / F.col("actual_rate") - 1
        ).alias("relative_bias"),
    )


def fixed_rule_point(
    scored: DataFrame, rule: Column, assumptions: DataFrame, *, label: str, y: str = "is_churn"
) -> DataFrame:
    """Result of a rule that needs no model, on the same scale as a curve row."""
    chosen = F.coalesce(rule, F.lit(False))
    stats = scored.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(chosen).alias("n_targeted"),
        F.coalesce(F.sum(F.when(chosen, F.col(y))), F.lit(0)).cast("bigint").alias("hits"),
        F.avg(y).alias("base_rate"),
    ).withColumn("a", _one(assumptions))
    size = F.when(F.col("n_targeted") > 0, F.col("n_targeted")).otherwise(
        F.raise_error(F.lit(f"rule {label!r} selects nobody")).cast("bigint")
    )
    precision = F.col("hits") / F.col("n_targeted")
    return stats.withColumn("n_targeted", size).select(
        F.lit(label).alias("rule"),
        (F.col("n_targeted") / F.col("n")).alias("k"),
        "n_targeted",
        (
            F.col("hits") * F.col("a.r_save") * F.col("a.ltv_saved")
            - F.col("n_targeted") * F.col("a.c_offer")
        ).alias("settled_net"),
        "hits",
        precision.alias("precision"),
        F.when(F.col("base_rate") > 0, precision / F.col("base_rate")).alias("lift"),
    )


def random_baseline(curve: DataFrame, scored: DataFrame, assumptions: DataFrame) -> DataFrame:
    """Expected value of targeting the same number of users at random."""
    rate = scored.agg(F.avg("is_churn")).scalar()
    rows = curve.withColumn("a", _one(assumptions)).withColumn("rate", rate)
    value = F.col("n_targeted") * (
        F.col("rate") * F.col("a.r_save") * F.col("a.ltv_saved") - F.col("a.c_offer")
    )
    return rows.select("k", "n_targeted", value.alias("random_net"))


def sensitivity_grid(
    scored: DataFrame,
    assumptions: DataFrame,
    *,
    r_values: Sequence[float] = R_GRID,
    c_values: Sequence[float] = C_GRID,
    p: str = "p",
    y: str = "is_churn",
) -> DataFrame:
    """Targeting ``p > p*`` under every (save rate, cost) pair, in one pass.

    Each user falls into the interval between two thresholds; one grouping
    gives the totals per interval and every grid cell adds up the intervals
    above its threshold.
    """
    for r in r_values:
        for c in c_values:
            decision_threshold(r_save=r, ltv_saved=1.0, c_offer=c)
    cells = F.array(
        *[
            F.struct(F.lit(float(r)).alias("r_save"), F.lit(float(c)).alias("c_offer"))
            for r in r_values
            for c in c_values
        ]
    )
    ltv = assumptions.select("ltv_saved").scalar()
    stars = F.array_sort(
        F.transform(cells, lambda x: x["c_offer"] / (x["r_save"] * F.col("ltv")))
    )
    tagged = with_score_units(scored, p).withColumn("ltv", ltv).withColumn("stars", stars)
    value = F.col(p)
    above = F.size(F.filter("stars", lambda t: t < value))
    bands = (
        tagged.select(above.alias("above"), "p_units", F.col(y).alias("y"))
        .groupBy("above")
        .agg(
            F.count(F.lit(1)).alias("n"), F.sum("p_units").alias("units"), F.sum("y").alias("hits")
        )
    )
    # At most one band per grid cell plus one, whatever the number of users.
    packed = bands.agg(
        F.sum("n").alias("n"),
        F.collect_list(F.struct("above", "n", "units", "hits")).alias("bands"),
    ).withColumn("ltv", ltv)
    grid = packed.withColumn("stars", stars).withColumn("cell", F.explode(cells))
    star = F.col("cell.c_offer") / (F.col("cell.r_save") * F.col("ltv"))
    rows = grid.withColumn("p_star", star).withColumn(
        "over", F.expr("filter(bands, b -> b.above > size(filter(stars, t -> t < p_star)))")
    )

    def total(field: str) -> Column:
        return F.aggregate(
            F.transform("over", lambda b: b[field].cast("bigint")),
            F.lit(0).cast("bigint"),
            lambda acc, x: acc + x,
        )

    gain = F.col("cell.r_save") * F.col("ltv")
    sized = rows.select(
        "cell",
        "p_star",
        "n",
        "ltv",
        total("n").alias("size"),
        total("units").alias("units"),
        total("hits").alias("hits"),
    )
    return sized.select(
        F.col("cell.r_save").alias("r_save"),
        F.col("cell.c_offer").alias("c_offer"),
        "p_star",
        (F.col("size") / F.col("n")).alias("best_share"),
        F.col("size").alias("n_targeted"),
        (
            F.col("units") / float(SCORE_UNITS) * gain - F.col("size") * F.col("cell.c_offer")
        ).alias("expected_net"),
        (F.col("hits") * gain - F.col("size") * F.col("cell.c_offer")).alias("settled_net"),
    )


def above_threshold(scored: DataFrame, assumptions: DataFrame, p: str = "p") -> DataFrame:
    """Strictly above the break-even probability."""
    return scored.filter(F.col(p) > assumptions.select("p_star").scalar())


def offer_list(scored: DataFrame, assumptions: DataFrame, p: str = "p") -> DataFrame:
    """Everybody worth an offer, with the expected value of making it.

    Unordered here; sort descending by score at the sink.
    """
    rows = scored.withColumn("a", _one(assumptions)).filter(F.col(p) > F.col("a.p_star"))
    net = F.col(p) * F.col("a.r_save") * F.col("a.ltv_saved") - F.col("a.c_offer")
    return rows.withColumn("expected_net", net).drop("a")


def batch_totals(scored: DataFrame, assumptions: DataFrame, p: str = "p") -> DataFrame:
    """Size, budget and expected value of a batch; value is summed over targeted rows only."""
    rows = with_score_units(scored, p).withColumn("a", _one(assumptions))
    hit = F.col(p) > F.col("a.p_star")
    stats = rows.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(hit).alias("n_targeted"),
        F.coalesce(F.sum(F.when(hit, F.col("p_units"))), F.lit(0)).alias("units"),
    ).withColumn("a", _one(assumptions))
    budget = F.col("n_targeted") * F.col("a.c_offer")
    value = F.col("units") / float(SCORE_UNITS) * F.col("a.r_save") * F.col("a.ltv_saved")
    return stats.select("n", "n_targeted", budget.alias("budget"), (value - budget).alias("expected_net"))


def curve_downsample(curve: DataFrame, digits: int = 4) -> DataFrame:
    """Whole-percent points of a curve, for a chart consumer."""
    percent = F.col("k") * 100
    return curve.filter(F.abs(F.rint(percent) - percent) < 1e-9).select(
        F.round("k", digits).alias("k"), F.round("expected_net", 0).alias("net")
    )


