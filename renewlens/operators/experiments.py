"""Reading experiments: tables of runs in, verdicts out."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from renewlens.functions.scalars import mean_across

def t_critical(freedom: int, level: float = 0.95) -> float:
    """Two-sided critical value of Student's t, by bisection on its distribution.

    With t = sqrt(freedom) * tan(angle), the probability within +-t is a finite sum of powers
    of the angle's cosine.
    """

    def within(angle: float) -> float:
        c, s = math.cos(angle), math.sin(angle)
        odd = freedom % 2
        term = total = (c if odd else 1.0) if freedom > 1 else 0.0
        for k in range(2 if odd else 1, freedom - 1, 2):
            term *= c * c * k / (k + 1)
            total += term
        return (angle + s * total) * 2 / math.pi if odd else s * total

    low, high = 0.0, math.pi / 2
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if within(middle) < level else (low, middle)
    return math.sqrt(freedom) * math.tan(low)


TABLED = 30  # degrees of freedom up to which critical values are tabled
Z_95 = 1.959963984540054  # fixed value: the normal limit


def t_critical_column(freedom: Column) -> Column:
    """95 % critical value per row: exact up to TABLED degrees, beyond by expansion in 1/freedom."""
    table = F.create_map(*[F.lit(x) for k in range(1, TABLED + 1) for x in (k, t_critical(k))])
    z, n = Z_95, freedom.cast("double")
    expansion = (
        F.lit(z)
        + (z**3 + z) / (4 * n)
        + (5 * z**5 + 16 * z**3 + 3 * z) / (96 * n * n)
        + (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / (384 * n * n * n)
    )
    return F.coalesce(table[freedom.cast("int")], expansion)


# Fixed value: paired noise scale of a single comparison.
NOISE_SIGMA = 0.00044


def importance_rank(importance: DataFrame, model: str) -> DataFrame:
    """1-based rank of every feature by gain. One row per feature: a small table."""
    order = Window.orderBy(F.col("gain").desc(), F.col("feature"))
    return importance.select("feature", F.row_number().over(order).alias(model))


def rank_agreement(tables: Mapping[str, DataFrame], top_n: int = 15) -> DataFrame:
    """Ranks of all models side by side with their mean over the models that have one."""
    out: DataFrame | None = None
    for name, table in tables.items():
        ranks = importance_rank(table, name)
        out = ranks if out is None else out.join(ranks, "feature", "outer")
    return (
        out.withColumn("mean_rank", mean_across(list(tables)))
        .orderBy("mean_rank", "feature")
        .limit(top_n)
    )


def comparison_table(runs: DataFrame, reference: str, constant_loss: float) -> DataFrame:
    """Loss of every run against a reference run and the constant baseline."""
    ref = runs.filter(F.col("label") == reference).agg(F.max("log_loss")).scalar()
    return runs.withColumn("relative_to_first", F.col("log_loss") / ref - 1).withColumn(
        "gain_over_constant", 1 - F.col("log_loss") / F.lit(constant_loss)
    )


def null_vs_actual(actual: DataFrame, null_gains: DataFrame) -> DataFrame:
    return null_gains.join(actual, "feature", "inner")


def null_gain_stats(actual: DataFrame, null_gains: DataFrame) -> DataFrame:
    """Null distribution per feature and the share of null runs the real gain beats.

    Quantiles interpolate linearly. A group holds one number per null run.
    """
    p = F.percentile("gain", F.array(F.lit(0.5), F.lit(0.75), F.lit(0.95)))
    return (
        null_vs_actual(actual, null_gains)
        .groupBy("feature", "actual_gain")
        .agg(
            p.alias("q"),
            F.max("gain").alias("null_max"),
            F.avg((F.col("gain") < F.col("actual_gain")).cast("int")).alias("beats_share"),
        )
        .select(
            "feature",
            "actual_gain",
            F.col("q")[0].alias("null_p50"),
            F.col("q")[1].alias("null_p75"),
            F.col("q")[2].alias("null_p95"),
            "null_max",
            "beats_share",
        )
    )


def null_summary(actual: DataFrame, null_gains: DataFrame) -> DataFrame:
    """Adds the ranking score ``ln(1e-10 + actual / (1 + p75))``."""
    score = F.ln(F.lit(1e-10) + F.col("actual_gain") / (1 + F.col("null_p75")))
    return null_gain_stats(actual, null_gains).withColumn("score", score)


def keep_features(actual: DataFrame, null_gains: DataFrame, percentile: int) -> DataFrame:
    """Features whose real gain exceeds their own null percentile, in original order."""
    limit = null_gains.groupBy("feature").agg(
        F.percentile("gain", F.lit(percentile / 100.0)).alias("limit")
    )
    order = ["position"] if "position" in actual.columns else []
    kept = actual.join(limit, "feature").filter("actual_gain > limit")
    return kept.select(*order, "feature", "actual_gain", "limit")


def threshold_sweep(runs: DataFrame, reference: str = "all") -> DataFrame:
    """Selection loss at every threshold, relative to all features."""
    ref = runs.filter(F.col("label") == reference).agg(F.max("sel_log_loss")).scalar()
    return runs.withColumn("relative", F.col("sel_log_loss") / ref - 1)


def before_after(runs: DataFrame) -> DataFrame:
    """Only the runs that were scored on the validation cohort, the full set first."""
    scored = runs.filter(F.col("valid_log_loss").isNotNull())
    ref = scored.agg(F.max_by("valid_log_loss", "n_features")).scalar()
    return scored.withColumn("relative", F.col("valid_log_loss") / ref - 1)


def marginal_spread(runs: DataFrame) -> DataFrame:
    """Spread of each model over seeds (runs: seed, model, log_loss)."""
    return runs.groupBy("model").agg(
        F.avg("log_loss").alias("mean"),
        F.min("log_loss").alias("min"),
        F.max("log_loss").alias("max"),
        F.stddev_samp("log_loss").alias("sigma"),
    )


def model_pairs(runs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Every pair of models inside a group, as model_a < model_b with losses a and b.

    A group is one experiment: a handful of models, packed into an array whose
    tails are paired with each element.
    """
    packed = runs.groupBy(*by).agg(
        F.array_sort(F.collect_list(F.struct("model", "log_loss"))).alias("models")
    )
    return (
        packed.select(*by, "models", F.posexplode("models").alias("i", "first"))
        .withColumn("second", F.explode(F.slice("models", F.col("i") + 2, F.size("models"))))
        .select(
            *by,
            F.col("first.model").alias("model_a"),
            F.col("second.model").alias("model_b"),
            F.col("first.log_loss").alias("a"),
            F.col("second.log_loss").alias("b"),
        )
    )


def multi_seed_paired(runs: DataFrame) -> DataFrame:
    """All pairs of models compared seed by seed; negative means the first is better."""
    pairs = model_pairs(runs, ["seed"]).withColumn("d", F.col("a") - F.col("b"))
    stats = pairs.groupBy("model_a", "model_b").agg(
        F.count(F.lit(1)).alias("n_seeds"),
        F.avg("d").alias("mean_diff"),
        F.stddev_samp("d").alias("sigma"),
        F.count_if(F.col("d") < 0).alias("a_wins"),
        F.count_if(F.col("d") > 0).alias("b_wins"),
    )
    critical = t_critical_column(F.col("n_seeds") - 1)
    half = critical * F.col("sigma") / F.sqrt("n_seeds")
    return (
        stats.withColumn("lo", F.col("mean_diff") - half)
        .withColumn("hi", F.col("mean_diff") + half)
        .withColumn(
            "verdict",
            F.when((F.col("lo") > 0) | (F.col("hi") < 0), "trusted").otherwise("undecided"),
        )
    )


def direction_table(runs: DataFrame, constant_loss: float) -> DataFrame:
    """One direction of a swap test: distance to the best run and to the constant."""
    best = runs.agg(F.min("log_loss")).scalar()
    return runs.withColumn("relative_to_best", F.col("log_loss") / best - 1).withColumn(
        "gain_over_constant", 1 - F.col("log_loss") / F.lit(constant_loss)
    )


def stability_table(forward: DataFrame, reverse: DataFrame) -> DataFrame:
    """Ranks of the models in both directions (a handful of rows)."""
    order = Window.orderBy("log_loss", "model")
    f = forward.select(
        "model", F.col("log_loss").alias("forward_loss"), F.row_number().over(order).alias("forward_rank")
    )
    r = reverse.select(
        "model", F.col("log_loss").alias("reverse_loss"), F.row_number().over(order).alias("reverse_rank")
    )
    return f.join(r, "model").withColumn(
        "same_rank", F.col("forward_rank") == F.col("reverse_rank")
    )


def reverse_validation(
    forward: DataFrame, reverse: DataFrame, sigma: float = NOISE_SIGMA
) -> DataFrame:
    """Pairwise verdict after swapping training and validation cohorts."""

    def pairs(df: DataFrame, name: str) -> DataFrame:
        return model_pairs(df).select(
            "model_a", "model_b", ((F.col("a") - F.col("b")) / F.lit(sigma)).alias(name)
        )

    both = pairs(forward, "forward_sigma").join(
        pairs(reverse, "reverse_sigma"), ["model_a", "model_b"]
    )
    same = (F.col("forward_sigma") < 0) == (F.col("reverse_sigma") < 0)
    big = (F.abs("forward_sigma") >= 1) & (F.abs("reverse_sigma") >= 1)
    small = (F.abs("forward_sigma") < 1) & (F.abs("reverse_sigma") < 1)
    verdict = F.when(same & big, "trusted").when(small, "noise").otherwise("doubtful")
    return both.withColumn("same_direction", same).withColumn("verdict", verdict)


def grouped_vs_random(
    grouped: DataFrame, random: DataFrame, resolution: float = 1.0
) -> DataFrame:
    """Gap between the two fold arms in units of the pooled fold deviation."""
    g = grouped.agg(F.struct(F.avg("log_loss").alias("m"), F.stddev_samp("log_loss").alias("s"))).scalar()
    r = random.agg(F.avg("log_loss").alias("random_mean"), F.stddev_samp("log_loss").alias("rs"))
    rows = r.withColumn("g", g).select(
        F.col("g.m").alias("grouped_mean"),
        "random_mean",
        (F.col("g.m") - F.col("random_mean")).alias("absolute"),
        (F.col("g.m") / F.col("random_mean") - 1).alias("relative"),
        F.sqrt((F.col("g.s") * F.col("g.s") + F.col("rs") * F.col("rs")) / 2).alias("pooled_std"),
    )
    in_sigma = F.col("absolute") / F.nullif(F.col("pooled_std"), F.lit(0.0))
    return rows.withColumn("in_fold_sigma", in_sigma).withColumn(
        "below_resolution", F.coalesce(F.abs("in_fold_sigma") < resolution, F.lit(False))
    )


def gain_shift(base: DataFrame, lead: DataFrame, features: Sequence[str]) -> DataFrame:
    """Gain share of chosen features in two versions of a model."""
    a = base.select("feature", F.col("gain_share").alias("base_share"))
    b = lead.select("feature", F.col("gain_share").alias("lead_share"))
    return (
        a.join(b, "feature", "outer")
        .filter(F.col("feature").isin(*features))
        .select(
            "feature",
            F.coalesce("base_share", F.lit(0.0)).alias("base_share"),
            F.coalesce("lead_share", F.lit(0.0)).alias("lead_share"),
        )
    )


def encoding_variants_report(runs: DataFrame) -> DataFrame:
    """Encoding experiment: only compliant variants may be called best."""
    best = runs.filter("compliant").agg(F.min_by("label", "valid_log_loss")).scalar()
    return runs.withColumn("best_compliant", F.col("label") == best)


