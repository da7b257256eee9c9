"""Model experiments: which fits to run on which rows, and the tables they produce.

A job loops over a few configurations on the driver; every fit, score and
metric inside is a distributed Spark job over the full rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from renewlens.operators import encode, experiments, models
from renewlens.operators.cohort import cutoff_definition
from renewlens.operators.decision import BusinessParams, decision_threshold
from renewlens.operators.features import select_features, variant_columns
from renewlens.operators.guards import check_labels_are_real
from renewlens.operators.metrics import log_loss, repeat_vs_new
from renewlens.operators.split import (
    common_subset,
    dropped_profile,
    folds_grouped,
    folds_random_control,
    merge_cohorts,
    split_two,
)
from renewlens.session import stage
from renewlens.sources.schemas import CATEGORICAL, KEY

ENCODED_COLUMN = "last_payment_method_id"


def feature_names(table: DataFrame) -> list[str]:
    return [c for c in table.columns if c not in (KEY, "is_churn", "segment", "cohort", "fold")]


def tagged_validation(train: DataFrame, valid: DataFrame) -> DataFrame:
    """Validation rows with their repeat/new segment against the training users."""
    return repeat_vs_new(valid, train)


def ablation(
    train: DataFrame,
    valid: DataFrame,
    *,
    params: Mapping[str, Any] | None = None,
    variants: Sequence[str] | None = None,
) -> DataFrame:
    """The same fit on several column sets; loss relative to transactions only."""
    rows, tagged = stage(split_two(train), "ablation"), stage(tagged_validation(train, valid), "v")
    sets = variant_columns(feature_names(train))
    lines = []
    for name in variants or sets:
        columns = sets[name]
        fitted = models.fit_scorer(
            select_features(rows, columns).join(rows.select(KEY, "segment"), KEY),
            columns,
            params=params,
        )
        lines.append(models.run_row(name, fitted, tagged))
    runs = models.runs_table(train.sparkSession, lines)
    ref = runs.filter("label = 'txn_only'").agg(F.max("log_loss")).scalar()
    return runs.withColumn("relative", F.col("log_loss") / ref - 1)


def select_by_null_importance(
    rows: DataFrame,
    valid: DataFrame,
    features: Sequence[str],
    *,
    n_runs: int,
    rounds: int,
    percentiles: Sequence[int] = (50, 75, 90, 95, 99, 100),
    params: Mapping[str, Any] | None = None,
) -> DataFrame:
    """Sweep thresholds on ``sel``; score the validation cohort only for "all" and the winner."""
    spark = rows.sparkSession
    actual, null = models.null_importance(
        rows.filter("segment = 'train'"), features, rounds=rounds, n_runs=n_runs
    )
    held = rows.filter("segment = 'sel'")

    def judge(columns: Sequence[str]) -> tuple[models.Fitted, float]:
        fitted = models.fit_scorer(rows, columns, params=params)
        return fitted, models.evaluate(fitted, held)

    fits: dict[str, tuple[models.Fitted, float]] = {"all": judge(features)}
    seen: dict[tuple[str, ...], str] = {tuple(features): "all"}
    for p in percentiles:
        kept = experiments.keep_features(actual, null, p).orderBy("position").collect()
        columns = tuple(r["feature"] for r in kept)
        if not columns:
            continue
        if columns in seen:
            fits[f"p{p}"] = fits[seen[columns]]
        else:
            fits[f"p{p}"] = judge(columns)
            seen[columns] = f"p{p}"
    winner = min(fits, key=lambda k: (round(fits[k][1], 4), len(fits[k][0].features)))
    lines = []
    for label, (fitted, loss) in fits.items():
        scored = models.evaluate(fitted, valid) if label in ("all", winner) else None
        lines.append((label, len(fitted.features), fitted.rounds, loss, scored))
    return experiments.threshold_sweep(
        spark.createDataFrame(
            lines,
            "label string, n_features int, rounds int, sel_log_loss double, valid_log_loss double",
        )
    )


def multi_seed(
    train: DataFrame,
    valid: DataFrame,
    *,
    seeds: Sequence[int],
    families: Sequence[str] = models.FAMILIES,
    params: Mapping[str, Mapping[str, Any]] | None = None,
) -> DataFrame:
    """Runs table (seed, model, log_loss); all models of a seed share one split."""
    features, lines = feature_names(train), []
    for seed in seeds:
        rows = stage(split_two(train, seed=seed), f"seed{seed}")
        for family in families:
            fitted = models.fit_scorer(
                rows, features, family=family, params=(params or {}).get(family)
            )
            lines.append((seed, family, models.evaluate(fitted, valid)))
    return train.sparkSession.createDataFrame(lines, "seed int, model string, log_loss double")


def swap_directions(
    a: DataFrame,
    b: DataFrame,
    *,
    families: Sequence[str] = models.FAMILIES,
    params: Mapping[str, Mapping[str, Any]] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Train on a and validate on b, then the reverse (model, log_loss each)."""

    def run(train: DataFrame, valid: DataFrame) -> DataFrame:
        rows, lines = stage(split_two(train), "direction"), []
        for family in families:
            fitted = models.fit_scorer(
                rows, feature_names(train), family=family, params=(params or {}).get(family)
            )
            lines.append((family, models.evaluate(fitted, valid)))
        return train.sparkSession.createDataFrame(lines, "model string, log_loss double")

    return run(a, b), run(b, a)


def lead_time(
    base: tuple[DataFrame, DataFrame],
    lead: tuple[DataFrame, DataFrame],
    *,
    params: Mapping[str, Any] | None = None,
) -> dict[str, DataFrame]:
    """Cost of scoring earlier: own losses, losses on shared users, who is lost, gain shift."""
    spark = base[0].sparkSession
    scored, gains, own = {}, {}, []
    for name, (train, valid) in (("base", base), ("lead", lead)):
        rows = stage(split_two(train), f"lead-{name}")
        fitted = models.fit_scorer(rows, feature_names(train), params=params)
        scored[name] = stage(fitted.predict(valid).select(KEY, "is_churn", "p"), f"scored-{name}")
        gains[name] = fitted.importance(spark)
        own.append((name, float(scored[name].agg(log_loss()).first()[0])))
    both = common_subset(scored["base"], scored["lead"])
    return {
        "own": spark.createDataFrame(own, "version string, log_loss double"),
        "common": both.agg(
            F.count(F.lit(1)).alias("n"),
            log_loss().alias("loss_base"),
            log_loss(p="p_lead").alias("loss_lead"),
        ),
        "dropped": dropped_profile(base[1], lead[1]),
        "gain_shift": experiments.gain_shift(
            gains["base"], gains["lead"], ["last_is_cancel", "days_since_last_tx", "cancel_rate"]
        ),
    }


def long_report(parts: Mapping[str, DataFrame]) -> DataFrame:
    """Several small result tables as one: part, name of the row, measure, value."""
    out = None
    for part, table in parts.items():
        named = [c for c, kind in table.dtypes if kind == "string"]
        numbers = [c for c, kind in table.dtypes if kind != "string"]
        cells = [F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("value")) for c in numbers]
        rows = table.select(
            F.lit(part).alias("part"), F.concat_ws("/", *named).alias("name"), F.explode(F.array(*cells)).alias("c")
        ).select("part", "name", "c.measure", "c.value")
        out = rows if out is None else out.unionByName(rows)
    return out


def fold_arms(
    parts: Mapping[str, DataFrame], *, k: int = 4, params: Mapping[str, Any] | None = None
) -> tuple[DataFrame, DataFrame]:
    """Fold losses with whole-user folds and with the ungrouped control."""
    merged = stage(merge_cohorts(parts), "merged")
    features = feature_names(merged)
    grouped = stage(folds_grouped(merged, k=k), "grouped")
    control = stage(folds_random_control(merged, k=k), "control")
    return (
        models.cv_variance(grouped, features, params=params),
        models.cv_variance(control, features, params=params),
    )


def target_encoding_experiment(
    rows: DataFrame, valid: DataFrame, *, params: Mapping[str, Any] | None = None
) -> DataFrame:
    """Native codes, out-of-fold encoding, and three naive controls that may not win.

    ``rows`` carry train/es/sel segments. Encoders are fitted on ``train`` only,
    except in the control that deliberately encodes before the split.
    """
    features = feature_names(rows)
    train = rows.filter("segment = 'train'")
    encoders = {
        label: (column, stage(encode.target_encode_fit(source, column), "encoder"))
        for label, source, column in (
            ("naive", train, ENCODED_COLUMN),
            ("naive_user", train, KEY),
            ("naive_user_presplit", rows, KEY),
        )
    }

    def encoded(df: DataFrame) -> DataFrame:
        """One column per control; ``oof`` differs from ``naive`` on the training rows only."""
        for label, (column, table) in encoders.items():
            df = encode.target_encode_apply(df, table, column, out=label)
        return df

    # All encodings stand side by side, so that rows are joined and stored once for all fits.
    own = encode.target_encode_oof(train, ENCODED_COLUMN, out="oof").drop("fold")
    others = rows.filter("segment <> 'train'").withColumn("oof", F.lit(None).cast("double"))
    oof = F.when(F.col("segment") == "train", F.col("oof")).otherwise(F.col("naive"))
    data = stage(encoded(own.unionByName(others)).withColumn("oof", oof), "encoded")
    late = stage(encoded(valid).withColumn("oof", F.col("naive")), "late")
    encode.check_encoding_is_oof(data.filter("segment = 'train'"), "oof")
    # every fit has the same training rows
    levels = models.training_levels(train, [c for c in CATEGORICAL if c in features])
    lines = []

    def judge(label: str, compliant: bool, table: DataFrame, last: DataFrame, cols: Sequence[str]):
        known = {c: codes for c, codes in levels.items() if c in cols}
        fitted, sel = models.fit_and_judge(table, cols, known, params=params)
        lines.append((label, compliant, fitted.rounds, sel, models.evaluate(fitted, last)))

    judge("native", True, rows, valid, features)
    for label, column in (("oof", ENCODED_COLUMN), *((k, c) for k, (c, _) in encoders.items())):
        name = f"{column}_te"
        cols = [c for c in features if c != column] + [name]
        table = data.select("segment", "is_churn", *features, F.col(label).alias(name))
        judge(label, label == "oof", table, late.select("is_churn", *features, F.col(label).alias(name)), cols)
    runs = rows.sparkSession.createDataFrame(
        lines,
        "label string, compliant boolean, rounds int, sel_log_loss double, valid_log_loss double",
    )
    return experiments.encoding_variants_report(runs)


def bundle_metadata(
    train_spec,
    eval_spec,
    *,
    train_churn_rate: float,
    ltv_saved: float,
    params: BusinessParams,
    model_params: Mapping[str, Any],
) -> dict[str, Any]:
    """Everything a bundle must carry to be used correctly."""
    check_labels_are_real(train_spec, eval_spec)
    p_star = decision_threshold(
        r_save=params.r_save, ltv_saved=ltv_saved, c_offer=params.c_offer
    )
    return {
        "assumptions": {
            "r_save": params.r_save,
            "c_offer": params.c_offer,
            "ltv_saved": ltv_saved,
            "p_star": p_star,
        },
        "cohort": {
            "train": train_spec.name,
            "eval": eval_spec.name,
            "cutoff_definition": cutoff_definition(eval_spec),
            "train_churn_rate": train_churn_rate,
        },
        "params": dict(model_params),
    }
