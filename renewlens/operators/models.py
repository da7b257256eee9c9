"""Model jobs on Spark ML: fitting, comparing, searching, selecting, bundling.

Tree learners of Spark ML reject missing values, so every numeric feature is
fed as a constant-filled value plus a 0/1 missing flag. The filling looks at its
own row only; nothing is imputed from the data.

Categories are categories: trees split them as unordered sets (one nominal input, whose levels each
node sorts by its own target mean), logistic models get one indicator per level. Levels come from
the training rows; a missing code is a level of its own, and so is any code not seen there.
"""

from __future__ import annotations

import json
import math
import random
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    RandomForestClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from renewlens.operators import drift
from renewlens.operators.attribution import LinearScorer
from renewlens.operators.calibration import fit_isotonic
from renewlens.operators.guards import GuardViolation, check_labels_are_real
from renewlens.operators.metrics import log_loss
from renewlens.operators.ranking import hash_rank
from renewlens.operators.score import check_features_match
from renewlens.session import stage, staging_root
from renewlens.sources.schemas import CATEGORICAL, KEY, MISSING_CATEGORY

MISSING_FILL = -999.0
STEP = 1_000_003  # multipliers of the label permutations are primes from here on
GAIN_DIGITS = 12  # gains that agree to here are equal, whatever the order of their sums
MAX_LEVELS = 1000  # levels of a category that a model tells apart; rarer codes count as unseen
FAMILIES = ("gbt", "forest", "logistic")

# Small but fixed budgets; raise them through ``params`` on real data.
DEFAULTS: dict[str, dict[str, Any]] = {
    "gbt": {"maxIter": 20, "maxDepth": 4, "stepSize": 0.1, "seed": 42},
    "forest": {"numTrees": 20, "maxDepth": 6, "seed": 42},
    "logistic": {"maxIter": 50, "regParam": 0.01},
}


@dataclass(frozen=True)
class Fitted:
    """A fitted classifier and the ordered features it was trained on."""

    name: str
    model: PipelineModel
    features: tuple[str, ...]
    rounds: int
    params: Mapping[str, Any] = field(default_factory=dict)
    # of the logistic family: standard deviation and mean of each input on the training rows
    deviations: tuple[float, ...] = ()
    means: tuple[float, ...] = ()
    levels: Mapping[str, tuple[int, ...]] = field(default_factory=dict)

    @property
    def inputs(self) -> list[Input]:
        return model_inputs(self.name, self.features, self.levels)

    def spark(self) -> SparkSession:
        return SparkSession.active()

    def predict(self, df: DataFrame, out: str = "p") -> DataFrame:
        """Churn probability per row; keeps the input columns."""
        scored = self.model.transform(prepare_matrix(df, self.inputs))
        drop = [c for c in scored.columns if c not in df.columns and c != "probability"]
        return (
            scored.drop(*drop)
            .withColumn(out, vector_to_array("probability")[1])
            .drop("probability")
        )

    def importance(self, spark: SparkSession) -> DataFrame:
        return importance_table(self, spark)


@dataclass(frozen=True)
class Input:
    """One model input: its name, the feature it comes from, its SQL, and its levels if nominal."""

    name: str
    feature: str
    sql: str
    size: int = 0


def level_number(feature: str, levels: Sequence[int]) -> str:
    """SQL of a code's place among the levels; then missing, then codes that are not among them."""
    known = " ".join(f"WHEN {code} THEN {i}.0D" for i, code in enumerate(levels))
    n = len(levels)
    missing = f"coalesce(cast(`{feature}` AS bigint), {MISSING_CATEGORY}) = {MISSING_CATEGORY}"
    tail = f"CASE cast(`{feature}` AS bigint) {known} ELSE {n + 1}.0D END" if levels else f"{n + 1}.0D"
    return f"(CASE WHEN {missing} THEN {n}.0D ELSE {tail} END)"


def model_inputs(family: str, features: Sequence[str], levels: Mapping[str, Sequence[int]]) -> list[Input]:
    """Value and missing flag of each number; one nominal input per category, or, for the logistic
    family, an indicator per level and one for missing."""
    values, flags, categories = [], [], []
    for f in features:
        if f not in levels:
            values.append(Input(f"x_{f}", f, f"coalesce(cast(`{f}` AS double), {MISSING_FILL}D)"))
            flags.append(Input(f"m_{f}", f, f"cast(`{f}` IS NULL AS double)"))
        elif family == "logistic":
            # one comparison each: numbering the level first would repeat all levels once per level
            code = f"coalesce(cast(`{f}` AS bigint), {MISSING_CATEGORY})"
            wanted = [*levels[f], MISSING_CATEGORY]
            categories += [Input(f"c_{f}_{i}", f, f"cast({code} = {c} AS double)") for i, c in enumerate(wanted)]
        else:
            categories.append(Input(f"c_{f}", f, level_number(f, levels[f]), len(levels[f]) + 2))
    return [*values, *flags, *categories]


def training_levels(train: DataFrame, categorical: Sequence[str]) -> dict[str, tuple[int, ...]]:
    """Codes of the training rows per category, ascending: the MAX_LEVELS most frequent of each."""
    if not categorical:
        return {}
    codes = train.select(*[F.col(c).cast("bigint").alias(c) for c in categorical])
    counts = codes.unpivot([], list(categorical), "feature", "code").groupBy("feature", "code").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.filter(F.col("code").isNotNull() & (F.col("code") != MISSING_CATEGORY))
    place = F.row_number().over(Window.partitionBy("feature").orderBy(F.desc("n"), "code"))
    kept = counts.withColumn("place", place).filter(F.col("place") <= MAX_LEVELS).collect()
    return {c: tuple(sorted(r["code"] for r in kept if r["feature"] == c)) for c in categorical}


def prepare_matrix(df: DataFrame, inputs: Sequence[Input]) -> DataFrame:
    """The model's inputs next to the original columns; nominal ones say so in their metadata."""
    columns = []
    for x in inputs:
        column = F.expr(x.sql)
        if x.size:
            values = [str(i) for i in range(x.size)]
            column = column.alias(x.name, metadata={"ml_attr": {"type": "nominal", "name": x.name, "vals": values}})
        else:
            column = column.alias(x.name)
        columns.append(column)
    return df.select("*", *columns)


def _estimator(family: str, params: Mapping[str, Any]):
    merged = {**DEFAULTS[family], **params}
    common = {"featuresCol": "vector", "labelCol": "label"}
    if family == "gbt":
        return GBTClassifier(**common, validationIndicatorCol="is_es", **merged)
    if family == "forest":
        return RandomForestClassifier(**common, **merged)
    if family == "logistic":
        return LogisticRegression(**common, standardization=True, **merged)
    raise ValueError(f"unknown family {family!r}: choose one of {FAMILIES}")


def without_summary(model, spark: SparkSession):
    """The model as it is stored. A training summary holds the session, and a session in which any
    table was observed cannot be sent to tasks with the model."""
    if not getattr(model, "hasSummary", False):
        return model
    path = f"{staging_root(spark)}/renewlens/model-{uuid.uuid4().hex}"
    model.save(path)
    return type(model).load(path)


def fit_scorer(
    rows: DataFrame,
    features: Sequence[str],
    *,
    family: str = "gbt",
    params: Mapping[str, Any] | None = None,
    segment: str = "segment",
    fixed_rounds: bool = False,
    categorical: Sequence[str] = CATEGORICAL,
) -> Fitted:
    """Train on ``train``; the boosted family picks its rounds on ``es``.

    Other segments (and the validation cohort) are never seen. With
    ``fixed_rounds`` every row trains and the round count is taken as given.
    """
    if fixed_rounds:
        data = rows.withColumn("is_es", F.lit(False))
    else:
        wanted = ("train", "es") if family == "gbt" else ("train",)
        data = rows.filter(F.col(segment).isin(*wanted)).withColumn(
            "is_es", F.col(segment) == "es"
        )
    levels = training_levels(data.filter("not is_es"), [c for c in categorical if c in features])
    assembler, vectors = assembled(data.withColumn("label", F.col("is_churn").cast("double")), family, features, levels)
    # Several passes read the input: keep the assembled vectors only.
    matrix = vectors.select("vector", "label", "is_es").persist()
    try:
        return _fit_matrix(matrix, assembler, features, levels, family=family, params=params, fixed_rounds=fixed_rounds)
    finally:
        matrix.unpersist()


def assembled(
    df: DataFrame, family: str, features: Sequence[str], levels: Mapping[str, Sequence[int]]
) -> tuple[VectorAssembler, DataFrame]:
    """The assembler of a family's inputs, and ``df`` with them as one column ``vector``."""
    inputs = model_inputs(family, features, levels)
    assembler = VectorAssembler(inputCols=[x.name for x in inputs], outputCol="vector")
    return assembler, assembler.transform(prepare_matrix(df, inputs))


def _fit_matrix(
    matrix: DataFrame,
    assembler: VectorAssembler,
    features: Sequence[str],
    levels: Mapping[str, tuple[int, ...]],
    *,
    family: str = "gbt",
    params: Mapping[str, Any] | None = None,
    fixed_rounds: bool = True,
) -> Fitted:
    """Fit on assembled rows (vector, label, is_es); any stored matrix can serve several fits."""
    estimator = _estimator(family, dict(params or {}))
    most = max((x.size for x in model_inputs(family, features, levels)), default=0)
    if most and estimator.getMaxBins() < most:
        estimator.setMaxBins(most)
    if family == "gbt" and fixed_rounds:
        estimator.clear(estimator.validationIndicatorCol)
    model = estimator.fit(matrix)
    deviations: tuple[float, ...] = ()
    means: tuple[float, ...] = ()
    if family == "logistic":
        spread = matrix.select(Summarizer.metrics("variance", "mean").summary(F.col("vector")).alias("s"))
        s = spread.first().s
        deviations = tuple(math.sqrt(v) for v in s.variance)
        means = tuple(float(v) for v in s.mean)
    rounds = model.getNumTrees if family in ("gbt", "forest") else int(model.summary.totalIterations)
    model = without_summary(model, matrix.sparkSession)
    return Fitted(
        family, PipelineModel([assembler, model]), tuple(features), rounds, dict(params or {}), deviations, means, levels
    )


def fit_candidates(
    rows: DataFrame, features: Sequence[str], families: Sequence[str] = FAMILIES
) -> list[Fitted]:
    """Several families on the same rows, features and split."""
    return [fit_scorer(rows, features, family=f) for f in families]


def mean_ensemble(df: DataFrame, models: Sequence[Fitted], out: str = "p_ensemble") -> DataFrame:
    """Arithmetic mean of the members' probabilities."""
    scored = df
    for m in models:
        scored = m.predict(scored, f"p_{m.name}")
    total = sum(F.col(f"p_{m.name}") for m in models)
    return scored.withColumn(out, total / F.lit(float(len(models))))


def gains(fitted: Fitted) -> dict[str, float]:
    """Importance per feature; all inputs of a feature count together, unused ones are 0."""
    model = fitted.model.stages[-1]
    if fitted.name == "logistic":
        # per standard deviation of the training rows, so that units do not count
        raw = [abs(float(c)) * s for c, s in zip(model.coefficients, fitted.deviations, strict=True)]
    else:
        raw = [float(v) for v in model.featureImportances.toArray()]
    out = dict.fromkeys(fitted.features, 0.0)
    for x, value in zip(fitted.inputs, raw, strict=True):
        out[x.feature] += value
    return out


def importance_table(fitted: Fitted, spark: SparkSession) -> DataFrame:
    values = gains(fitted)
    total = sum(values.values()) or 1.0
    return spark.createDataFrame(
        [(f, g, g / total) for f, g in values.items()], "feature string, gain double, gain_share double"
    )


def linear_scorer(fitted: Fitted, train: DataFrame) -> LinearScorer:
    """A fitted logistic model as an additive scorer around the training means.

    Contribution of a feature = weight * (x - mean); the base absorbs the mean
    of every term, so base plus contributions is exactly the model's log-odds.
    """
    if fitted.name != "logistic":
        raise ValueError("only the logistic family is additive in its features")
    if fitted.levels:
        raise ValueError("categories have no single weight: compile the model instead")
    model = fitted.model.stages[-1]
    n = len(fitted.features)
    weights = [float(c) for c in model.coefficients]
    means = train.agg(*[F.avg(F.col(f).cast("double")).alias(f) for f in fitted.features]).first()
    base = float(model.intercept)
    w, m, missing = {}, {}, {}
    for i, f in enumerate(fitted.features):
        mean = float(means[f]) if means[f] is not None else 0.0
        w[f], m[f] = weights[i], mean
        base += weights[i] * mean
        # A missing row sees the fill value and the flag instead of x.
        missing[f] = weights[i] * (MISSING_FILL - mean) + weights[n + i]
    return LinearScorer(base, w, m, missing)


def evaluate(fitted: Fitted, df: DataFrame) -> float:
    """Mean clipped log loss on labelled rows."""
    return float(fitted.predict(df).agg(log_loss()).first()[0])


def evaluate_assembled(fitted: Fitted, matrix: DataFrame) -> float:
    """:func:`evaluate` on assembled rows (vector, is_churn)."""
    scored = fitted.model.stages[-1].transform(matrix)
    return float(scored.select("is_churn", vector_to_array("probability")[1].alias("p")).agg(log_loss()).first()[0])


def fit_and_judge(
    rows: DataFrame,
    features: Sequence[str],
    levels: Mapping[str, tuple[int, ...]],
    *,
    params: Mapping[str, Any] | None = None,
    held: str = "sel",
) -> tuple[Fitted, float]:
    """The boosted scorer as :func:`fit_scorer` fits it and its loss on ``held``, from one assembled table.

    ``levels`` are the :func:`training_levels` of the ``train`` rows.
    """
    data = rows.filter(F.col("segment").isin("train", "es", held)).select(
        "is_churn",
        "segment",
        *features,
        F.col("is_churn").cast("double").alias("label"),
        (F.col("segment") == "es").alias("is_es"),
    )
    assembler, vectors = assembled(data, "gbt", features, levels)
    matrix = vectors.select("vector", "label", "is_es", "is_churn", "segment").persist()
    try:
        seen = matrix.filter(F.col("segment") != held).select("vector", "label", "is_es")
        fitted = _fit_matrix(seen, assembler, features, levels, params=params, fixed_rounds=False)
        return fitted, evaluate_assembled(fitted, matrix.filter(F.col("segment") == held))
    finally:
        matrix.unpersist()


def run_row(
    label: str, fitted: Fitted, valid: DataFrame, *, segment: str = "segment"
) -> tuple[str, int, int, float, float | None, float | None]:
    """One line of a runs table: label, features, rounds, loss overall and by segment."""
    scored = fitted.predict(valid)
    loss = log_loss()
    row = scored.agg(
        loss.alias("all"),
        F.avg(F.when(F.col(segment) == "repeat", _loss_of())).alias("repeat"),
        F.avg(F.when(F.col(segment) == "new", _loss_of())).alias("new"),
    ).first()
    return (label, len(fitted.features), fitted.rounds, row["all"], row["repeat"], row["new"])


def _loss_of():
    from renewlens.operators.metrics import row_log_loss

    return row_log_loss("is_churn", "p")


RUN_SCHEMA = (
    "label string, n_features int, rounds int, log_loss double, repeat_loss double, new_loss double"
)


def runs_table(spark: SparkSession, rows: Sequence[tuple]) -> DataFrame:
    return spark.createDataFrame(list(rows), RUN_SCHEMA)


def compare_candidates(
    rows: DataFrame, valid: DataFrame, features: Sequence[str], families: Sequence[str] = FAMILIES
) -> tuple[DataFrame, list[Fitted]]:
    """Runs table of all families and their mean ensemble."""
    models = fit_candidates(rows, features, families)
    lines = [run_row(m.name, m, valid) for m in models]
    if len(models) > 1:
        together = mean_ensemble(valid, models, "p")
        row = together.agg(
            log_loss().alias("all"),
            F.avg(F.when(F.col("segment") == "repeat", _loss_of())).alias("repeat"),
            F.avg(F.when(F.col("segment") == "new", _loss_of())).alias("new"),
        ).first()
        lines.append(
            ("ensemble", len(features), 0, row["all"], row["repeat"], row["new"])
        )
    return runs_table(rows.sparkSession, lines), models


@dataclass(frozen=True)
class Baseline:
    fitted: Fitted
    log_loss: float
    constant_log_loss: float
    segments: DataFrame
    importance: DataFrame

    @property
    def beats_constant(self) -> bool:
        return self.log_loss < self.constant_log_loss

    @property
    def improvement(self) -> float:
        return 1.0 - self.log_loss / self.constant_log_loss


def train_baseline(
    rows: DataFrame,
    valid: DataFrame,
    features: Sequence[str],
    *,
    family: str = "gbt",
    params: Mapping[str, Any] | None = None,
    specs: Sequence = (),
) -> Baseline:
    """Fit, score the later cohort, compare with predicting the training rate for all."""
    from renewlens.operators.metrics import constant_log_loss, segment_report

    check_labels_are_real(*specs)
    fitted = fit_scorer(rows, features, family=family, params=params)
    scored = stage(fitted.predict(valid), "validated")
    prior = float(rows.agg(F.avg("is_churn")).first()[0])
    return Baseline(
        fitted,
        float(scored.agg(log_loss()).first()[0]),
        float(constant_log_loss(scored, prior).first()["constant_log_loss"]),
        segment_report(scored),
        fitted.importance(rows.sparkSession),
    )


def cv_variance(
    folds: DataFrame,
    features: Sequence[str],
    *,
    family: str = "gbt",
    params: Mapping[str, Any] | None = None,
) -> DataFrame:
    """Loss per fold at fixed rounds (rows carry ``fold``).

    All folds train and are judged on one assembled table; a fold whose training rows have other
    levels than the fold before gets its own.
    """
    ids = sorted(r["fold"] for r in folds.select("fold").distinct().collect())
    labelled = folds.select("fold", "is_churn", *features, F.col("is_churn").cast("double").alias("label"))
    lines, known, matrix = [], None, None
    try:
        for k in ids:
            train = F.col("fold") != k
            levels = training_levels(folds.filter(train), [c for c in CATEGORICAL if c in features])
            if levels != known:
                if matrix is not None:
                    matrix.unpersist()
                assembler, vectors = assembled(labelled, family, features, levels)
                known, matrix = levels, vectors.select("vector", "label", "is_churn", "fold").persist()
            data = matrix.filter(train).select("vector", "label", F.lit(False).alias("is_es"))
            fitted = _fit_matrix(data, assembler, features, levels, family=family, params=params)
            lines.append((int(k), evaluate_assembled(fitted, matrix.filter(F.col("fold") == k))))
    finally:
        if matrix is not None:
            matrix.unpersist()
    return folds.sparkSession.createDataFrame(lines, "fold int, log_loss double")


def cv_summary(per_fold: DataFrame) -> DataFrame:
    return per_fold.agg(
        F.count(F.lit(1)).alias("n_folds"),
        F.avg("log_loss").alias("mean"),
        F.stddev_samp("log_loss").alias("std"),
    )


def sample_params(rng: random.Random, space: Mapping[str, Mapping[str, Any]]) -> dict[str, Any]:
    """One draw: ``uniform``, ``loguniform`` or ``int`` per parameter."""
    out: dict[str, Any] = {}
    for name, spec in space.items():
        low, high, kind = float(spec["low"]), float(spec["high"]), spec["type"]
        if kind == "loguniform":
            out[name] = math.exp(rng.uniform(math.log(low), math.log(high)))
        elif kind == "uniform":
            out[name] = rng.uniform(low, high)
        elif kind == "int":
            out[name] = round(rng.uniform(low, high))
        else:
            raise ValueError(f"unknown kind {kind!r} for parameter {name}")
    return out


def random_search(
    rows: DataFrame,
    features: Sequence[str],
    space: Mapping[str, Mapping[str, Any]],
    *,
    n_trials: int,
    seed: int = 2026,
    family: str = "gbt",
    base: Mapping[str, Any] | None = None,
) -> DataFrame:
    """Trials judged on ``sel``; trial 0 is the base setting. Best first."""
    rng = random.Random(seed)
    held = rows.filter("segment = 'sel'")
    lines = []
    for i in range(n_trials + 1):
        drawn = {} if i == 0 else sample_params(rng, space)
        fitted = fit_scorer(
            rows, features, family=family, params={**(base or {}), **drawn}
        )
        lines.append((i, json.dumps(drawn, sort_keys=True), fitted.rounds, evaluate(fitted, held)))
    table = rows.sparkSession.createDataFrame(
        lines, "trial int, sampled string, rounds int, sel_log_loss double"
    )
    return table.orderBy("sel_log_loss", "trial")


def run_steps(n: int, runs: int) -> list[int]:
    """One multiplier per run, coprime to ``n``: primes from STEP on that do not divide it."""
    out, candidate = [], STEP
    while len(out) < runs:
        if all(candidate % d for d in range(2, math.isqrt(candidate) + 1)) and n % candidate:
            out.append(candidate)
        candidate += 1
    return out


def permuted_labels(df: DataFrame, runs: int, *, seed: int = 42, label: str = "is_churn") -> DataFrame:
    """``df`` with ``side0`` (the labels) and ``side1`` .. ``side<runs>``: the labels, permuted.

    A permutation of 0/1 labels is a choice of as many rows as there are ones. Rows are numbered once
    in hash order; run r walks the numbers in steps coprime to their count and takes the first ones.
    Nothing is ranked or joined again per run.
    """
    ranked = stage(hash_rank(df, seed=f"null:{seed}").drop("stratum_n"), "null-order")
    size = ranked.agg(F.count(F.lit(1)).alias("n"), F.sum(label).alias("ones")).first()
    place = F.col("hash_rank") - 1
    chosen = [
        (F.pmod(place * step + r, F.lit(size["n"])) < size["ones"]).cast("int").alias(f"side{r}")
        for r, step in enumerate(run_steps(max(size["n"], 1), runs), 1)
    ]
    return ranked.select(*df.columns, F.col(label).cast("int").alias("side0"), *chosen)


def histogram_gains(df: DataFrame, features: Sequence[str], runs: int, *, seed: int = 42) -> DataFrame:
    """Gain of every feature for the labels and for ``runs`` permutations of them: feature, run, gain.

    The gain of a feature is the variance of the label that its bins explain. Bins are fitted once, on
    all rows, and one pass counts ones per feature, bin and run; run 0 has the labels themselves.
    """
    whole = stage(df.select(*features, F.lit(1).alias("side0")), "null-bins")
    fitted = drift.fit_bins(whole, features)
    split = stage(permuted_labels(df.select(KEY, "is_churn", *features), runs, seed=seed), "null-runs")
    schemes = [drift.Scheme(r, x.feature, x.kind, x.edges) for r in range(runs + 1) for x in fitted]
    bins = drift.apply_bins(split.drop(KEY, "is_churn"), schemes).filter("ref_n + cur_n > 0")
    n, ones = F.col("ref_n") + F.col("cur_n"), F.col("ref_n").cast("double")
    total = bins.groupBy("feature", F.col("round").alias("run")).agg(
        F.sum(ones * ones / n).alias("inside"), F.sum("ref_n").cast("double").alias("k"), F.sum(n).cast("double").alias("n")
    )
    gain = (F.col("inside") - F.col("k") * F.col("k") / F.col("n")) / F.col("n")
    return total.select("feature", "run", F.round(gain, GAIN_DIGITS).alias("gain"))


def null_importance(
    rows: DataFrame,
    features: Sequence[str],
    *,
    rounds: int,
    n_runs: int,
    seed: int = 42,
) -> tuple[DataFrame, DataFrame]:
    """Gains with real labels and with shuffled ones, at a fixed number of rounds.

    The model seed never changes: the only difference between runs is whether
    the labels carry information.
    """
    spark = rows.sparkSession
    params = {"maxIter": rounds}
    data = stage(rows.select(KEY, "is_churn", *features), "null-importance")
    real = gains(fit_scorer(data, features, params=params, fixed_rounds=True))
    lines = []
    permuted = stage(permuted_labels(data, n_runs, seed=seed), "permuted")
    # The inputs do not depend on the labels: every run reads one assembled table.
    levels = training_levels(permuted, [c for c in CATEGORICAL if c in features])
    assembler, vectors = assembled(permuted, "gbt", features, levels)
    matrix = vectors.select("vector", *[f"side{run}" for run in range(1, n_runs + 1)]).persist()
    try:
        for run in range(1, n_runs + 1):
            shuffled = matrix.select("vector", F.col(f"side{run}").cast("double").alias("label"))
            null = gains(_fit_matrix(shuffled, assembler, features, levels, params=params))
            lines += [(f, run, g) for f, g in null.items()]
    finally:
        matrix.unpersist()
    actual = spark.createDataFrame(
        [(i, f, g) for i, (f, g) in enumerate(real.items())],
        "position int, feature string, actual_gain double",
    )
    return actual, spark.createDataFrame(lines, "feature string, run int, gain double")


def calibration_decision(
    fitted: Fitted, rows: DataFrame, threshold: float = 0.0
) -> dict[str, Any]:
    """Fit the calibrator on ``cal``, judge it on ``sel``, adopt only if the loss drops."""
    cal = stage(fitted.predict(rows.filter("segment = 'cal'")).select(KEY, "is_churn", "p"), "cal")
    sel = fitted.predict(rows.filter("segment = 'sel'")).select(KEY, "is_churn", "p")
    both = fit_isotonic(cal).apply(sel)
    row = both.agg(
        log_loss().alias("raw"),
        log_loss(p="p_calibrated").alias("calibrated"),
        F.avg("is_churn").alias("actual_rate"),
        F.avg("p").alias("mean_raw"),
        F.avg("p_calibrated").alias("mean_calibrated"),
    ).first()
    return {
        **row.asDict(),
        "delta": row["calibrated"] - row["raw"],
        "adopted": bool(row["raw"] - row["calibrated"] > threshold),
    }


BUNDLE_VERSION = 2
BUNDLE_SECTIONS = ("assumptions", "cohort", "params")
COHORT_KEYS = ("train", "eval", "cutoff_definition", "train_churn_rate")


@dataclass(frozen=True)
class Bundle:
    """A deployable model with everything needed to use it correctly."""

    fitted: Fitted
    meta: Mapping[str, Any]

    @property
    def scores_at_expiry(self) -> bool:
        """Scores on the expiry day itself: too late to send an offer ahead of it."""
        return self.meta["cohort"]["cutoff_definition"] == "expire_date"

    @property
    def deployable(self) -> bool:
        return not self.scores_at_expiry

    @property
    def p_star(self) -> float:
        return float(self.meta["assumptions"]["p_star"])

    def check(self, df: DataFrame) -> None:
        check_features_match(df, self.fitted.features)


def save_bundle(fitted: Fitted, path: str, meta: Mapping[str, Any], spark: SparkSession) -> None:
    """Model and a one-row metadata table; incomplete metadata is refused."""
    missing = [s for s in BUNDLE_SECTIONS if s not in meta]
    if missing:
        raise KeyError(f"bundle metadata lacks the sections {missing}")
    lacking = [k for k in COHORT_KEYS if k not in meta["cohort"]]
    if lacking:
        raise KeyError(f"bundle metadata lacks the cohort entries {lacking}")
    fitted.model.write().overwrite().save(f"{path}/model")
    row = (
        BUNDLE_VERSION,
        fitted.name,
        fitted.rounds,
        list(fitted.features),
        list(fitted.levels),
        json.dumps({"levels": fitted.levels, "means": fitted.means, "deviations": fitted.deviations}),
        json.dumps(dict(fitted.params), sort_keys=True),
        json.dumps(dict(meta), sort_keys=True, default=str),
    )
    spark.createDataFrame(
        [row],
        "version int, family string, rounds int, features array<string>,"
        " categorical array<string>, inputs string, params string, meta string",
    ).write.mode("overwrite").parquet(f"{path}/meta")


def load_bundle(path: str, spark: SparkSession) -> Bundle:
    """Load and verify: version, sections, and that the model has the listed inputs."""
    try:
        row = spark.read.parquet(f"{path}/meta").first()
    except AnalysisException as e:
        raise FileNotFoundError(f"no model bundle at {path}") from e
    if row["version"] != BUNDLE_VERSION:
        raise ValueError(f"bundle version {row['version']} is not supported ({BUNDLE_VERSION})")
    meta = json.loads(row["meta"])
    missing = [s for s in BUNDLE_SECTIONS if s not in meta]
    if missing:
        raise KeyError(f"bundle metadata lacks the sections {missing}")
    model = PipelineModel.load(f"{path}/model")
    features = tuple(row["features"])
    known = json.loads(row["inputs"])
    fitted = Fitted(
        row["family"], model, features, row["rounds"], json.loads(row["params"]),
        tuple(known["deviations"]), tuple(known["means"]), {c: tuple(v) for c, v in known["levels"].items()},
    )
    if list(model.stages[0].getInputCols()) != [x.name for x in fitted.inputs]:
        raise GuardViolation("features_match: the stored model was trained on other features")
    return Bundle(fitted, meta)


def round_trip_check(fitted: Fitted, path: str, rows: DataFrame) -> float:
    """Largest difference between the model and its reloaded copy (must be 0)."""
    loaded = load_bundle(path, rows.sparkSession).fitted
    before = fitted.predict(rows).select(KEY, "p")
    after = loaded.predict(rows).select(KEY, F.col("p").alias("q"))
    gap = before.join(after, KEY).agg(F.max(F.abs(F.col("p") - F.col("q")))).first()[0]
    if gap is None or gap > 0:
        raise GuardViolation(f"round_trip: reloaded scores differ by up to {gap}")
    return float(gap)
