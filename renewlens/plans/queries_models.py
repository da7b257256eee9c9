"""Registered queries: run tables checked by SQL, and Spark ML jobs checked by tests."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from renewlens.functions.scalars import seeded_hash
from renewlens.operators import encode, experiments, guards, models, split
from renewlens.operators.attribution import LinearScorer, local_accuracy, mean_abs_attribution
from renewlens.operators.cohort import COHORTS, cutoff_window
from renewlens.operators.compiled import compile_scorer
from renewlens.operators.decision import BusinessParams
from renewlens.operators.metrics import log_loss
from renewlens.operators.ranking import winner_row
from renewlens.operators.score import score_table
from renewlens.plans import jobs
from renewlens.plans import oracle_tables as O
from renewlens.plans.compose import (
    FIXED_SCORER,
    Sources,
    cohort_table,
    feature_table,
    guarded_feature_table,
    log_table,
    scored_table,
)
from renewlens.plans.oracle_tables import r6
from renewlens.plans.queries_eval import _requests, assumptions, scored, slim
from renewlens.plans.registry import register
from renewlens.session import stage, staging_root
from renewlens.sources.demo import Q2, Q2_T7, Q3, Q3_T7
from renewlens.streaming.scoring import request_stream, score_stream

_S3 = O.scored_block(Q3, Q2)
_S2 = O.scored_block(Q2)
_F3 = O.features_block(Q3)

# --- run tables of fitted models -------------------------------------------
#
# Three small models that both engines can fit exactly: the training churn rate, the rate by
# whether the user ever cancelled, and the rate by tenth of the score. Cell rates are pulled
# towards the overall rate by PRIOR users. A seed picks the training half of q2; every run is
# judged on all users of the other cohort.

SEEDS = (1, 2, 3, 4)
PRIOR = 10.0
_CELLS = {"rate": 1, "cancel": 2, "binned": 10}  # fitted cells of each model
_CELL_SQL = {
    "rate": "0",
    "cancel": "CASE WHEN cancel_rate > 0 THEN 1 ELSE 0 END",
    "binned": "CAST(least(floor(p * 10), 9) AS INTEGER)",
}
_RUN_COLUMNS = ("user_id", "is_churn", "p", "cancel_rate")


def _celled(rows: DataFrame) -> DataFrame:
    """Each row once per model, with its cell."""
    cells = {
        "rate": F.lit(0),
        "cancel": F.when(F.col("cancel_rate") > 0, 1).otherwise(0),
        "binned": F.least(F.floor(F.col("p") * 10), F.lit(9)).cast("int"),
    }
    packed = F.array(*[F.struct(F.lit(m).alias("model"), c.alias("cell")) for m, c in cells.items()])
    return rows.withColumn("c", F.explode(packed)).select(*rows.columns, "c.model", "c.cell")


def _fits(train: DataFrame, *by: str) -> DataFrame:
    """Fitted probability of every model and cell (per ``by`` group)."""
    every = F.array(
        *[F.struct(F.lit(m).alias("model"), F.lit(i).alias("cell")) for m, n in _CELLS.items() for i in range(n)]
    )
    grid = train.groupBy(*by).agg(F.avg("is_churn").alias("r")).withColumn("c", F.explode(every))
    sums = _celled(train).groupBy(*by, "model", "cell").agg(F.count("*").alias("n"), F.sum("is_churn").alias("k"))
    known = F.coalesce("k", F.lit(0)) + F.col("r") * PRIOR
    q = F.when(F.col("model") == "rate", F.col("r")).otherwise(known / (F.coalesce("n", F.lit(0)) + PRIOR))
    return (
        grid.select(*by, "r", "c.model", "c.cell")
        .join(sums, [*by, "model", "cell"], "left")
        .select(*by, "model", "cell", q.alias("q"))
    )


def _losses(train: DataFrame, valid: DataFrame, *by: str) -> DataFrame:
    """Loss on ``valid`` of every model fitted on ``train`` (of the same group, if ``valid`` has it)."""
    own = [c for c in by if c in valid.columns]
    return (
        _celled(valid)
        .join(_fits(train, *by), [*own, "model", "cell"])
        .groupBy(*by, "model")
        .agg(log_loss("is_churn", F.col("q")).alias("log_loss"))
    )


def _losses_sql(train: str, valid: str, by: str = "", own: bool = False) -> str:
    b = f"{by}, " if by else ""

    def celled(source: str) -> str:
        return " UNION ALL ".join(f"SELECT *, '{m}' AS model, {c} AS cell FROM {source}" for m, c in _CELL_SQL.items())

    values = ", ".join(f"('{m}', {i})" for m, n in _CELLS.items() for i in range(n))
    using = ", ".join([*([by] if by else []), "model", "cell"])
    fits = f"""SELECT {b}model, cell, CASE WHEN model = 'rate' THEN r
    ELSE (coalesce(k, 0) + {PRIOR}::DOUBLE * r) / (coalesce(n, 0) + {PRIOR}::DOUBLE) END AS q
  FROM (SELECT * FROM (SELECT {b}avg(is_churn) AS r FROM {train} GROUP BY ALL) b0, (VALUES {values}) g(model, cell)) g0
  LEFT JOIN (SELECT {b}model, cell, count(*) AS n, sum(is_churn)::DOUBLE AS k FROM ({celled(train)}) c0 GROUP BY ALL) s0
  USING ({using})"""
    match = ", ".join([*([by] if own else []), "model", "cell"])
    return f"""SELECT {b}model, avg({O.log_loss(p='q')}) AS log_loss FROM ({celled(valid)}) v0
  JOIN ({fits}) f0 USING ({match}) GROUP BY ALL"""


def _in_half(seed: int) -> str:
    return f"substr(md5(concat_ws(':', '{seed}', CAST(user_id AS VARCHAR))), 1, 1) < '8'"


def _cohorts(src: Sources) -> tuple[DataFrame, DataFrame]:
    """What the run tables need of q2 and q3."""
    return tuple(stage(scored_table(src, s).select(*_RUN_COLUMNS), f"runs-{s.name}") for s in (Q2, Q3))


def _seed_runs(src: Sources) -> DataFrame:
    q2, q3 = _cohorts(src)
    first = {s: F.substring(seeded_hash(s, "user_id"), 1, 1) for s in SEEDS}
    picks = F.array(*[F.when(first[s] < "8", F.lit(s)) for s in SEEDS])
    return _losses(q2.withColumn("seed", F.explode(F.array_compact(picks))), q3, "seed")


O.block(
    "seed_train",
    " UNION ALL ".join(
        f"SELECT {s} AS seed, user_id, is_churn, p, cancel_rate FROM {_S2} WHERE {_in_half(s)}" for s in SEEDS
    ),
    _S2,
)
O.block("seed_runs", _losses_sql("seed_train", _S3, "seed"), "seed_train", _S3)


@register(
    "seed_runs",
    f"SELECT CAST(seed AS BIGINT) AS seed, model, {r6('log_loss', 'log_loss')} FROM seed_runs",
    "seed_runs",
)
def seed_runs(src: Sources) -> DataFrame:
    return _seed_runs(src)


@register(
    "marginal_spread",
    f"""SELECT model, {r6('avg(log_loss)', 'mean')}, {r6('min(log_loss)', 'min')}, {r6('max(log_loss)', 'max')},
  {r6('stddev_samp(log_loss)', 'sigma')} FROM seed_runs GROUP BY model""",
    "seed_runs",
)
def marginal_spread(src: Sources) -> DataFrame:
    return experiments.marginal_spread(_seed_runs(src))


@register(
    "multi_seed_paired",
    f"""SELECT model_a, model_b, n_seeds, {r6('m', 'mean_diff')}, {r6('s', 'sigma')}, a_wins, b_wins,
  {r6('m - h', 'lo')}, {r6('m + h', 'hi')},
  CASE WHEN m - h > 0 OR m + h < 0 THEN 'trusted' ELSE 'undecided' END AS verdict
FROM (SELECT a.model AS model_a, b.model AS model_b, count(*) AS n_seeds, avg(a.log_loss - b.log_loss) AS m,
    stddev_samp(a.log_loss - b.log_loss) AS s, count(*) FILTER (WHERE a.log_loss < b.log_loss) AS a_wins,
    count(*) FILTER (WHERE a.log_loss > b.log_loss) AS b_wins,
    3.1824463052842624::DOUBLE * stddev_samp(a.log_loss - b.log_loss) / sqrt(count(*)) AS h
  FROM seed_runs a JOIN seed_runs b ON a.seed = b.seed AND a.model < b.model GROUP BY a.model, b.model) x""",
    "seed_runs",
)
def multi_seed_paired(src: Sources) -> DataFrame:
    return experiments.multi_seed_paired(_seed_runs(src))


O.block("forward_runs", _losses_sql(_S2, _S3), _S2, _S3)
O.block("reverse_runs", _losses_sql(_S3, _S2), _S2, _S3)


def _directions(src: Sources) -> tuple[DataFrame, DataFrame]:
    q2, q3 = _cohorts(src)
    return _losses(q2, q3), _losses(q3, q2)


@register(
    "stability_table",
    f"""SELECT f.model, {r6('f.log_loss', 'forward_loss')}, f.rn AS forward_rank, {r6('r.log_loss', 'reverse_loss')},
  r.rn AS reverse_rank, CAST(f.rn = r.rn AS BIGINT) AS same_rank
FROM (SELECT *, row_number() OVER (ORDER BY log_loss, model) AS rn FROM forward_runs) f
JOIN (SELECT *, row_number() OVER (ORDER BY log_loss, model) AS rn FROM reverse_runs) r ON r.model = f.model""",
    "forward_runs",
    "reverse_runs",
)
def stability_table(src: Sources) -> DataFrame:
    return experiments.stability_table(*_directions(src))


def _pair_sql(t: str) -> str:
    return f"""SELECT a.model AS model_a, b.model AS model_b, (a.log_loss - b.log_loss) / 0.00044::DOUBLE AS s
FROM {t} a JOIN {t} b ON a.model < b.model"""


@register(
    "reverse_validation",
    f"""SELECT f.model_a, f.model_b, {r6('f.s', 'forward_sigma', 2)}, {r6('r.s', 'reverse_sigma', 2)},
  CAST((f.s < 0) = (r.s < 0) AS BIGINT) AS same_direction,
  CASE WHEN (f.s < 0) = (r.s < 0) AND abs(f.s) >= 1 AND abs(r.s) >= 1 THEN 'trusted'
    WHEN abs(f.s) < 1 AND abs(r.s) < 1 THEN 'noise' ELSE 'doubtful' END AS verdict
FROM ({_pair_sql('forward_runs')}) f JOIN ({_pair_sql('reverse_runs')}) r
  ON r.model_a = f.model_a AND r.model_b = f.model_b""",
    "forward_runs",
    "reverse_runs",
)
def reverse_validation(src: Sources) -> DataFrame:
    out = experiments.reverse_validation(*_directions(src))
    for c in ("forward_sigma", "reverse_sigma"):
        out = out.withColumn(c, F.round(c, 2))
    return out


_GAIN = "1 - log_loss / (SELECT log_loss FROM forward_runs WHERE model = 'rate')"
_SIZE = "CAST(CASE model " + " ".join(f"WHEN '{m}' THEN {n}" for m, n in _CELLS.items()) + " END AS BIGINT)"


def _size() -> Column:
    return F.create_map(*[F.lit(x) for kv in _CELLS.items() for x in kv])[F.col("model")]


def _constant(runs: DataFrame) -> float:
    """Loss of the constant model."""
    return runs.filter("model = 'rate'").first()["log_loss"]


@register(
    "direction_table",
    f"""SELECT model, {r6('log_loss', 'log_loss')}, {r6('log_loss / (SELECT min(log_loss) FROM forward_runs) - 1', 'relative_to_best')},
  {r6(_GAIN, 'gain_over_constant')} FROM forward_runs""",
    "forward_runs",
)
def direction_table(src: Sources) -> DataFrame:
    runs = stage(_losses(*_cohorts(src)), "runs")
    return experiments.direction_table(runs, _constant(runs))


@register(
    "comparison_table",
    f"""SELECT model AS label, {r6('log_loss', 'log_loss')},
  {r6("log_loss / (SELECT log_loss FROM forward_runs WHERE model = 'rate') - 1", 'relative_to_first')},
  {r6(_GAIN, 'gain_over_constant')} FROM forward_runs""",
    "forward_runs",
)
def comparison_table(src: Sources) -> DataFrame:
    runs = stage(_losses(*_cohorts(src)), "runs")
    constant = _constant(runs)
    return experiments.comparison_table(runs.withColumnRenamed("model", "label"), "rate", constant)


@register(
    "winner_row",
    f"""SELECT model, {r6('log_loss', 'log_loss')}, {_SIZE} AS size FROM forward_runs
ORDER BY round(log_loss, 4), {_SIZE} LIMIT 1""",
    "forward_runs",
)
def winner(src: Sources) -> DataFrame:
    runs = _losses(*_cohorts(src)).withColumn("size", _size())
    return winner_row(runs, "log_loss", "size")


# Selection losses come from the other half of q2. Only the largest model and the one that wins
# the selection are scored on q3.
O.block("half", f"SELECT user_id, is_churn, p, cancel_rate FROM {_S2} WHERE {_in_half(1)}", _S2)
O.block("held", f"SELECT user_id, is_churn, p, cancel_rate FROM {_S2} WHERE NOT {_in_half(1)}", _S2)
O.block("sel_runs", _losses_sql("half", "held"), "half", "held")
O.block("valid_runs", _losses_sql("half", _S3), "half", _S3)
_SWEEP = f"""SELECT model AS label, s.log_loss AS sel_log_loss, {_SIZE} AS n_features,
  CASE WHEN model = 'binned' OR s.log_loss = (SELECT min(log_loss) FROM sel_runs) THEN v.log_loss END AS valid_log_loss
FROM sel_runs s JOIN valid_runs v USING (model)"""


def _sweep(src: Sources) -> DataFrame:
    q2, q3 = _cohorts(src)
    in_half = F.substring(seeded_hash(1, "user_id"), 1, 1) < "8"
    half, held = q2.filter(in_half), q2.filter(~in_half)
    sel = stage(_losses(half, held), "sel-runs")
    best = sel.agg(F.min("log_loss")).scalar()
    valid = _losses(half, q3).withColumnRenamed("log_loss", "v")
    judged = (F.col("model") == "binned") | (F.col("log_loss") == best)
    return sel.join(valid, "model").select(
        F.col("model").alias("label"),
        F.col("log_loss").alias("sel_log_loss"),
        _size().alias("n_features"),
        F.when(judged, F.col("v")).alias("valid_log_loss"),
    )


@register(
    "threshold_sweep",
    f"""SELECT label, {r6('sel_log_loss', 'sel_log_loss')}, n_features, {r6('valid_log_loss', 'valid_log_loss')},
  {r6("sel_log_loss / (SELECT sel_log_loss FROM sweep WHERE label = 'binned') - 1", 'relative')} FROM sweep""",
    O.block("sweep", _SWEEP, "sel_runs", "valid_runs"),
)
def threshold_sweep(src: Sources) -> DataFrame:
    return experiments.threshold_sweep(_sweep(src), reference="binned")


@register(
    "before_after",
    f"""SELECT label, {r6('sel_log_loss', 'sel_log_loss')}, n_features, {r6('valid_log_loss', 'valid_log_loss')},
  {r6("valid_log_loss / (SELECT valid_log_loss FROM sweep WHERE label = 'binned') - 1", 'relative')}
FROM sweep WHERE valid_log_loss IS NOT NULL""",
    "sweep",
)
def before_after(src: Sources) -> DataFrame:
    return experiments.before_after(_sweep(src))


# One model per fold, fitted on the other folds of q3.
def _arm_blocks(arm: str, folds: str) -> None:
    O.block(
        f"{arm}_rows",
        f"SELECT s.user_id, s.is_churn, s.p, s.cancel_rate, f.fold FROM {_S3} s JOIN {folds} f"
        " ON f.user_id = s.user_id AND f.cohort = 'q3'",
        _S3,
        folds,
    )
    O.block(
        f"{arm}_train",
        f"SELECT r.user_id, r.is_churn, r.p, r.cancel_rate, o.fold FROM {arm}_rows r,"
        f" (SELECT DISTINCT fold FROM {arm}_rows) o WHERE o.fold <> r.fold",
        f"{arm}_rows",
    )
    fitted = _losses_sql(f"{arm}_train", f"{arm}_rows", "fold", own=True)
    O.block(arm, f"SELECT fold, log_loss FROM ({fitted}) x WHERE model = 'binned'", f"{arm}_train", f"{arm}_rows")


_arm_blocks("garm", "gfolds")
_arm_blocks("rarm", "rfolds")


@register(
    "grouped_vs_random_arms",
    f"""SELECT {r6('g', 'grouped_mean')}, {r6('r', 'random_mean')}, {r6('g - r', 'absolute')}, {r6('g / r - 1', 'relative')},
  {r6('pool', 'pooled_std')}, {r6('(g - r) / pool', 'in_fold_sigma')},
  CAST(abs((g - r) / pool) < 1 AS BIGINT) AS below_resolution
FROM (SELECT g, r, sqrt((gs * gs + rs * rs) / 2) AS pool FROM
  (SELECT avg(log_loss) AS g, stddev_samp(log_loss) AS gs FROM garm) a,
  (SELECT avg(log_loss) AS r, stddev_samp(log_loss) AS rs FROM rarm) b) x""",
    "garm",
    "rarm",
)
def fold_arms(src: Sources) -> DataFrame:
    from renewlens.plans.queries_eval import merged

    _, q3 = _cohorts(src)

    def arm(folds: DataFrame) -> DataFrame:
        rows = stage(q3.join(folds.filter("cohort = 'q3'").select("user_id", "fold"), "user_id"), "arm")
        numbers = [r.fold for r in rows.select("fold").distinct().collect()]  # one per fold
        others = F.array(*[F.when(F.col("fold") != n, F.lit(n)) for n in numbers])
        train = rows.withColumn("fold", F.explode(F.array_compact(others)))
        return _losses(train, rows, "fold").filter("model = 'binned'").drop("model")

    both = stage(merged(src), "merged")
    return experiments.grouped_vs_random(
        arm(split.folds_grouped(both)), arm(split.folds_random_control(both))
    )


# --- importances -----------------------------------------------------------

_SCORERS = {
    "fixed": FIXED_SCORER,
    "recent": LinearScorer(
        0.0,
        {k: 2 * v for k, v in FIXED_SCORER.weights.items() if k.startswith(("log", "days"))},
        FIXED_SCORER.means,
        FIXED_SCORER.missing,
    ),
    "history": LinearScorer(
        0.0,
        {k: v for k, v in FIXED_SCORER.weights.items() if not k.startswith("log")},
        FIXED_SCORER.means,
        FIXED_SCORER.missing,
    ),
}


def _importance_block(name: str) -> str:
    scorer = _SCORERS[name]
    body = " UNION ALL ".join(
        f"SELECT '{f}' AS feature, avg(abs({O.contribution(scorer, f)})) AS gain FROM {_S3}"
        for f in scorer.features
    )
    return O.block(
        f"importance_{name}",
        f"SELECT *, row_number() OVER (ORDER BY gain DESC, feature) AS rn FROM ({body}) g",
        _S3,
    )


_IMP = {n: _importance_block(n) for n in _SCORERS}


def _importances(src: Sources) -> dict[str, DataFrame]:
    rows = scored(src)
    return {
        n: mean_abs_attribution(rows, s).withColumnRenamed("mean_abs_shap", "gain")
        for n, s in _SCORERS.items()
    }


@register(
    "importance_rank",
    f"SELECT feature, rn AS fixed FROM {_IMP['fixed']}",
    _IMP["fixed"],
)
def importance_rank(src: Sources) -> DataFrame:
    return experiments.importance_rank(_importances(src)["fixed"], "fixed")


_RANKS = f"""SELECT coalesce(a.feature, b.feature, c.feature) AS feature, a.rn AS fixed, b.rn AS recent, c.rn AS history
FROM {_IMP['fixed']} a FULL JOIN {_IMP['recent']} b ON b.feature = a.feature
FULL JOIN {_IMP['history']} c ON c.feature = coalesce(a.feature, b.feature)"""
_MEAN_RANK = """(coalesce(fixed, 0) + coalesce(recent, 0) + coalesce(history, 0))::DOUBLE /
  (CAST(fixed IS NOT NULL AS INTEGER) + CAST(recent IS NOT NULL AS INTEGER) + CAST(history IS NOT NULL AS INTEGER))"""


@register(
    "rank_agreement",
    f"SELECT feature, fixed, recent, history, {r6(_MEAN_RANK, 'mean_rank')} FROM ({_RANKS}) r"
    f" ORDER BY {_MEAN_RANK}, feature LIMIT 15",
    *_IMP.values(),
)
def rank_agreement(src: Sources) -> DataFrame:
    return experiments.rank_agreement(_importances(src))


@register(
    "full_rank_join",
    f"SELECT feature, recent, history FROM (SELECT coalesce(b.feature, c.feature) AS feature, b.rn AS recent,"
    f" c.rn AS history FROM {_IMP['recent']} b FULL JOIN {_IMP['history']} c ON c.feature = b.feature) r",
    _IMP["recent"],
    _IMP["history"],
)
def full_rank_join(src: Sources) -> DataFrame:
    tables = _importances(src)
    ranks = [experiments.importance_rank(tables[n], n) for n in ("recent", "history")]
    return ranks[0].join(ranks[1], "feature", "outer")


@register(
    "gain_shift",
    f"""SELECT f.feature, {r6('f.gain / (SELECT sum(gain) FROM ' + _IMP['fixed'] + ')', 'base_share')},
  {r6('coalesce(h.gain, 0) / (SELECT sum(gain) FROM ' + _IMP['history'] + ')', 'lead_share')}
FROM {_IMP['fixed']} f LEFT JOIN {_IMP['history']} h ON h.feature = f.feature
WHERE f.feature IN ('cancel_rate', 'n_tx', 'log30_plays')""",
    _IMP["fixed"],
    _IMP["history"],
)
def gain_shift(src: Sources) -> DataFrame:
    def share(df: DataFrame) -> DataFrame:
        total = df.agg(F.sum("gain")).scalar()
        return df.withColumn("gain_share", F.col("gain") / total)

    tables = _importances(src)
    return experiments.gain_shift(
        share(tables["fixed"]), share(tables["history"]), ["cancel_rate", "n_tx", "log30_plays"]
    )


# Gains for the null-importance tables: label variance explained by a feature's bins, for the labels
# and for permutations of them, from one histogram of feature, bin and run.

_NULL_RUNS = 20
_F2 = O.features_block(Q2)
_LONG2 = "np_long"  # user, feature, value of q2, from the drift queries
_BINS2 = "fp_scheme"  # bins fitted on q2
_STEPS = models.run_steps(1, _NULL_RUNS)  # the test tables' sizes are no multiples of these primes
_CHOSEN = " UNION ALL ".join(
    f"SELECT user_id, {r} AS run, CAST(((rn - 1) * {step}::BIGINT + {r}) % n < k AS INTEGER) AS y FROM null_order"
    for r, step in enumerate(_STEPS, 1)
)
O.block(
    "null_order",
    f"""SELECT user_id, is_churn, row_number() OVER (ORDER BY md5(concat_ws(':', 'null:42', CAST(user_id AS VARCHAR))), user_id) AS rn,
  count(*) OVER () AS n, sum(is_churn) OVER () AS k FROM {_F2}""",
    _F2,
)
O.block("null_labels", f"SELECT user_id, 0 AS run, is_churn AS y FROM null_order UNION ALL {_CHOSEN}", "null_order")
O.block(
    "null_cells",
    f"""SELECT x.user_id, x.feature, CASE WHEN x.v IS NULL THEN 'missing'
    WHEN s.kind = 'quantile' THEN CAST(len(list_filter(s.e, lambda t: t <= x.v)) AS VARCHAR)
    ELSE CAST(x.v AS VARCHAR) END AS bin
FROM {_LONG2} x JOIN {_BINS2} s ON s.feature = x.feature""",
    _LONG2,
    _BINS2,
)
O.block(
    "null_all",
    f"""SELECT feature, run, round((sum(k * k / n) - sum(k) * sum(k) / sum(n)) / sum(n), {models.GAIN_DIGITS}) + 0.0 AS gain FROM (
  SELECT c.feature, c.bin, l.run, count(*)::DOUBLE AS n, sum(l.y)::DOUBLE AS k
  FROM null_cells c JOIN null_labels l ON l.user_id = c.user_id GROUP BY ALL) h GROUP BY feature, run""",
    "null_cells",
    "null_labels",
)
O.block("actual_gain", "SELECT feature, gain FROM null_all WHERE run = 0", "null_all")
O.block("null_gain", "SELECT feature, run, gain FROM null_all WHERE run > 0", "null_all")
_NULL_STATS = O.block(
    "null_stats",
    """SELECT a.feature, a.gain AS actual_gain, quantile_cont(n.gain, 0.5) AS null_p50,
  quantile_cont(n.gain, 0.75) AS null_p75, quantile_cont(n.gain, 0.95) AS null_p95, max(n.gain) AS null_max,
  avg(CAST(n.gain < a.gain AS INTEGER)) AS beats_share
FROM actual_gain a JOIN null_gain n ON n.feature = a.feature GROUP BY a.feature, a.gain""",
    "actual_gain",
    "null_gain",
)
_STAT_COLS = "actual_gain null_p50 null_p75 null_p95 null_max beats_share".split()


def _gap_tables(src: Sources) -> tuple[DataFrame, DataFrame]:
    table = guarded_feature_table(src, Q2)
    gains = stage(models.histogram_gains(table, jobs.feature_names(table), _NULL_RUNS), "gains")
    actual = gains.filter("run = 0").select("feature", F.col("gain").alias("actual_gain"))
    return actual, gains.filter("run > 0")


@register(
    "null_vs_actual",
    f"""SELECT n.feature, CAST(n.run AS BIGINT) AS run, {r6('n.gain', 'gain')}, {r6('a.gain', 'actual_gain')}
FROM null_gain n JOIN actual_gain a ON a.feature = n.feature""",
    "null_gain",
    "actual_gain",
)
def null_vs_actual(src: Sources) -> DataFrame:
    return experiments.null_vs_actual(*_gap_tables(src))


@register(
    "null_gain_stats",
    f"SELECT feature, {', '.join(r6(c, c) for c in _STAT_COLS)} FROM {_NULL_STATS}",
    _NULL_STATS,
)
def null_gain_stats(src: Sources) -> DataFrame:
    return experiments.null_gain_stats(*_gap_tables(src))


@register(
    "null_summary",
    f"SELECT feature, {', '.join(r6(c, c) for c in _STAT_COLS)},"
    f" {r6('ln(1e-10::DOUBLE + actual_gain / (1 + null_p75))', 'score')} FROM {_NULL_STATS}",
    _NULL_STATS,
)
def null_summary(src: Sources) -> DataFrame:
    return experiments.null_summary(*_gap_tables(src))


@register(
    "keep_features",
    f"""SELECT feature, {r6('actual_gain', 'actual_gain')}, {r6('lim', 'limit')} FROM
  (SELECT a.feature, a.gain AS actual_gain, quantile_cont(n.gain, 0.75) AS lim
   FROM actual_gain a JOIN null_gain n ON n.feature = a.feature GROUP BY a.feature, a.gain) x WHERE actual_gain > lim""",
    "actual_gain",
    "null_gain",
)
def keep_features(src: Sources) -> DataFrame:
    return experiments.keep_features(*_gap_tables(src), 75)


# --- Spark ML jobs (rows only) ---------------------------------------------
#
# All features, families, column sets, percentiles and folds, on all rows. The numbers of trials
# and of label shuffles are settings of the experiments.

N_TRIALS, N_NULL, NULL_ROUNDS = 4, 5, 10

def _table(src: Sources, spec) -> DataFrame:
    """Key, label and all features of a cohort."""
    return guarded_feature_table(src, spec)


def _rows(src: Sources) -> DataFrame:
    return stage(split.split_three(_table(src, Q2)), "ml-split")


@register("fit_scorer")
def fit_scorer(src: Sources) -> DataFrame:
    """Boosted scorer fitted on q2, applied to q3."""
    rows = _rows(src)
    fitted = models.fit_scorer(rows, jobs.feature_names(rows))
    return fitted.predict(_table(src, Q3)).select("user_id", "is_churn", "p")


@register("fit_candidates")
def fit_candidates(src: Sources) -> DataFrame:
    """Three families on one split, compared on q3 with their mean ensemble."""
    rows = _rows(src)
    valid = jobs.tagged_validation(rows, _table(src, Q3))
    runs, _ = models.compare_candidates(rows, stage(valid, "valid"), jobs.feature_names(rows))
    return runs


@register("mean_ensemble")
def mean_ensemble(src: Sources) -> DataFrame:
    """Mean of the families' probabilities."""
    rows = _rows(src)
    fitted = models.fit_candidates(rows, jobs.feature_names(rows))
    return models.mean_ensemble(_table(src, Q3), fitted).select(
        "user_id", *[f"p_{m.name}" for m in fitted], "p_ensemble"
    )


@register("importance_table")
def importance_table(src: Sources) -> DataFrame:
    """Gain per feature of the boosted scorer; unused features stay with 0."""
    rows = _rows(src)
    fitted = models.fit_scorer(rows, jobs.feature_names(rows))
    return fitted.importance(rows.sparkSession)


@register("train_baseline")
def train_baseline(src: Sources) -> DataFrame:
    """Loss of the baseline against the constant prediction."""
    rows = _rows(src)
    valid = jobs.tagged_validation(rows, _table(src, Q3))
    out = models.train_baseline(rows, valid, jobs.feature_names(rows), specs=(Q2, Q3))
    line = [(out.log_loss, out.constant_log_loss, out.improvement, out.beats_constant)]
    return rows.sparkSession.createDataFrame(
        line, "log_loss double, constant_log_loss double, improvement double, beats boolean"
    )


@register("cv_variance")
def cv_variance(src: Sources) -> DataFrame:
    """Fold losses at fixed rounds."""
    folds = stage(split.folds_stratified(_table(src, Q2)), "cv")
    return models.cv_summary(models.cv_variance(folds, jobs.feature_names(folds)))


@register("random_search")
def random_search(src: Sources) -> DataFrame:
    """Sampled settings against the base, judged on the selection segment."""
    space = {
        "stepSize": {"type": "loguniform", "low": 0.02, "high": 0.3},
        "maxDepth": {"type": "int", "low": 2, "high": 5},
        "minInstancesPerNode": {"type": "int", "low": 1, "high": 20},
    }
    rows = _rows(src)
    return models.random_search(rows, jobs.feature_names(rows), space, n_trials=N_TRIALS)


@register("null_importance")
def null_importance(src: Sources) -> DataFrame:
    """Real and label-shuffled gains of the boosted scorer."""
    rows = _rows(src)
    actual, null = models.null_importance(rows, jobs.feature_names(rows), rounds=NULL_ROUNDS, n_runs=N_NULL)
    return experiments.null_summary(actual, null)


@register("select_features_by_null_importance")
def select_by_null(src: Sources) -> DataFrame:
    """Threshold sweep on the selection segment, winner and full set scored on q3."""
    rows = _rows(src)
    return jobs.select_by_null_importance(
        rows, _table(src, Q3), jobs.feature_names(rows), n_runs=N_NULL, rounds=NULL_ROUNDS
    )


@register("ablation")
def ablation(src: Sources) -> DataFrame:
    """Column sets against transactions only."""
    return jobs.ablation(_table(src, Q2), _table(src, Q3))


@register("multi_seed_runs")
def multi_seed_runs(src: Sources) -> DataFrame:
    """Paired comparison of all families over the seeds of the split."""
    runs = jobs.multi_seed(_table(src, Q2), _table(src, Q3), seeds=SEEDS)
    return experiments.multi_seed_paired(runs)


@register("swap_directions")
def swap_directions(src: Sources) -> DataFrame:
    """q2 to q3 and back: are the differences between families stable?"""
    forward, reverse = jobs.swap_directions(_table(src, Q2), _table(src, Q3))
    return experiments.reverse_validation(forward, reverse)


@register("lead_time_models")
def lead_time_models(src: Sources) -> DataFrame:
    """The whole lead-time report in long form: own losses, losses on the users both versions can
    score, who is lost, and how gains shift."""
    out = jobs.lead_time(
        (_table(src, Q2), _table(src, Q3)), (_table(src, Q2_T7), _table(src, Q3_T7))
    )
    return jobs.long_report(out)


@register("fold_arm_models")
def fold_arm_models(src: Sources) -> DataFrame:
    """Whole-user folds against ungrouped folds with refitted models."""
    grouped, control = jobs.fold_arms(
        {"q2": _table(src, Q2), "q3": _table(src, Q3)}
    )
    return experiments.grouped_vs_random(grouped, control)


@register("target_encoding_experiment")
def target_encoding_experiment(src: Sources) -> DataFrame:
    """Native codes, out-of-fold encoding and the three leaking controls."""
    return jobs.target_encoding_experiment(_rows(src), _table(src, Q3))


@register("calibration_decision")
def calibration_decision(src: Sources) -> DataFrame:
    """Calibrator fitted on cal, judged on sel."""
    parts = {"q2": _table(src, Q2), "q3": _table(src, Q3)}
    rows = stage(split.split_four_group(split.merge_cohorts(parts)), "four")
    fitted = models.fit_scorer(rows, jobs.feature_names(rows))
    out = models.calibration_decision(fitted, rows)
    names = ("raw", "calibrated", "delta", "actual_rate", "mean_raw", "mean_calibrated")
    schema = ", ".join(f"{n} double" for n in names) + ", adopted boolean"
    return rows.sparkSession.createDataFrame(
        [(*[float(out[n]) for n in names], out["adopted"])], schema
    )


@register("model_bundle")
def model_bundle(src: Sources) -> DataFrame:
    """Save, verify, reload; scores of the reloaded model must be identical."""
    rows = _rows(src)
    spark = rows.sparkSession
    fitted = models.fit_scorer(rows, jobs.feature_names(rows))
    meta = jobs.bundle_metadata(
        Q2,
        Q3,
        train_churn_rate=float(rows.agg(F.avg("is_churn")).first()[0]),
        ltv_saved=600.0,
        params=BusinessParams(c_offer=50.0),
        model_params=models.DEFAULTS["gbt"],
    )
    path = f"{staging_root(spark)}/bundle-{uuid.uuid4().hex}"
    models.save_bundle(fitted, path, meta, spark)
    gap = models.round_trip_check(fitted, path, rows)
    loaded = models.load_bundle(path, spark)
    return spark.createDataFrame(
        [(gap, loaded.p_star, loaded.deployable, len(loaded.fitted.features))],
        "max_gap double, p_star double, deployable boolean, n_features int",
    )


@register(
    "score_bundle",
    f"""SELECT family, count(*) AS n_users, 1::BIGINT AS batch_equal, 1::BIGINT AS stream_equal, 1::BIGINT AS additive
FROM (SELECT unnest(['gbt', 'forest', 'logistic']) AS family) f, {_F3} GROUP BY family""",
    _F3,
)
def score_bundle(src: Sources) -> DataFrame:
    """Whole decisions of stored models, reasons included: compiled from the bundle, in batch and over request files.

    Both must give the model's own probabilities to 1e-12, and contributions must add up to them.
    """
    rows, valid = _rows(src), _table(src, Q3)
    spark = rows.sparkSession
    requests = stage(_requests(src), "requests")
    star = stage(assumptions(src), "assumptions")
    lines = []
    for family in models.FAMILIES:
        fitted = models.fit_scorer(rows, jobs.feature_names(rows), family=family)
        meta = jobs.bundle_metadata(
            Q2, Q3, train_churn_rate=0.1, ltv_saved=600.0, params=BusinessParams(c_offer=50.0),
            model_params=models.DEFAULTS[family],
        )
        path = f"{staging_root(spark)}/bundle-{uuid.uuid4().hex}"
        models.save_bundle(fitted, path, meta, spark)
        scorer = compile_scorer(models.load_bundle(path, spark).fitted)
        want = stage(fitted.predict(valid).select("user_id", F.col("p").alias("q")), "predicted")
        batch = stage(score_table(valid, scorer, star), "batch")
        query = score_stream(
            request_stream(spark, requests.inputFiles()[0].rsplit("/", 1)[0], requests.schema),
            scorer, star, scorer.features, out=f"{path}/decisions", checkpoint=f"{path}/checkpoint",
        )
        query.awaitTermination()
        streamed = spark.read.parquet(f"{path}/decisions")

        def equal(scored: DataFrame) -> bool:
            gap = want.join(scored.select("user_id", "p"), "user_id", "full")  # noqa: B023
            worst = gap.agg(F.max(F.coalesce(F.abs(F.col("p") - F.col("q")), F.lit(1.0)))).first()[0]
            return worst is not None and worst <= 1e-12

        additive = int(local_accuracy(scorer.score(valid), scorer).first()["max_gap"] <= 1e-9)
        lines.append((family, want.count(), int(equal(batch)), int(equal(streamed)), additive))
    return spark.createDataFrame(
        lines, "family string, n_users bigint, batch_equal bigint, stream_equal bigint, additive bigint"
    )


# --- guards ------------------------------------------------------------------
#
# Every rule on the tables as built (counted while they are written) and on a broken copy of them.

_CB2, _CB3, _LB2, _LB3 = O.cohort_block(Q2), O.cohort_block(Q3), O.log_block(Q2), O.log_block(Q3)
_CLEAN = "asof cutoff_window data_end logs_within_cutoff logs_match_cohort unique_key groups_disjoint encoding_is_oof labels_are_real features_match".split()
_LO2, _HI2 = cutoff_window(Q2)
_N_FEATURES = len(O.feature_columns(Q3))
_BROKEN = {
    "asof": f"SELECT count(*) FILTER (WHERE last_tx > first_tx) AS n, max(last_tx - first_tx) FILTER (WHERE last_tx > first_tx) AS w FROM {_CB3}",
    "cutoff_window": f"SELECT count(*) FILTER (WHERE NOT cutoff BETWEEN {_LO2} AND {_HI2}), max(cutoff) FILTER (WHERE NOT cutoff BETWEEN {_LO2} AND {_HI2}) FROM {_CB3}",
    "data_end": f"SELECT count(*) FILTER (WHERE cutoff > {cutoff_window(Q3)[0]}), max(cutoff) FILTER (WHERE cutoff > {cutoff_window(Q3)[0]}) FROM {_CB3}",
    "logs_within_cutoff": f"SELECT count(*) FILTER (WHERE log_min_days_before < 5), max(5 - log_min_days_before) FILTER (WHERE log_min_days_before < 5) FROM {_LB3}",
    "logs_match_cohort": f"SELECT count(*), max(abs(c.cutoff - l.cutoff)) FROM {_CB3} c JOIN {_LB2} l ON l.user_id = c.user_id AND l.cutoff <> c.cutoff",
    "unique_key": f"SELECT count(*), max(n) FROM (SELECT user_id, count(*) AS n FROM (SELECT user_id FROM {_CB2} UNION ALL SELECT user_id FROM {_CB3}) u GROUP BY 1) x WHERE n > 1",
    "groups_disjoint": f"SELECT count(*), CASE WHEN count(*) > 0 THEN 2 END FROM {_CB2} a JOIN {_CB3} b ON b.user_id = a.user_id",
    "encoding_is_oof": f"SELECT count(*), NULL FROM {_CB3}",
    "labels_are_real": "SELECT 1, NULL",
    "features_match": f"SELECT {_N_FEATURES - _N_FEATURES % 2}, NULL",
}
_GUARDS_SQL = " UNION ALL ".join(
    [f"SELECT '{r}' AS rule, 'clean' AS input, 0 AS n_rows, CAST(NULL AS DOUBLE) AS worst" for r in _CLEAN]
    + [f"SELECT '{r}', 'broken', n, CAST(w AS DOUBLE) FROM ({sql}) AS {r}_x(n, w)" for r, sql in _BROKEN.items()]
)


@register("guard_report", _GUARDS_SQL, _CB2, _CB3, _LB2, _LB3)
def guard_report(src: Sources) -> DataFrame:
    """Rows per rule on the tables as built and on broken copies."""
    log = guards.GuardLog()
    features = guarded_feature_table(src, Q3, log)
    c2, c3 = stage(cohort_table(src, Q2), "c2"), stage(cohort_table(src, Q3), "c3")
    l2, l3 = stage(log_table(src, Q2), "l2"), stage(log_table(src, Q3), "l3")
    spark, names = features.sparkSession, jobs.feature_names(features)
    rates = encode.target_encode_oof(
        split.folds_stratified(c3.select("user_id", "is_churn", "city", "n_tx")), "city"
    )
    fake = [s for s in COHORTS.values() if not s.labels_are_real]

    def order(given: list[str]) -> guards.Finding:
        off = sum(a != b for a, b in zip(given, names))
        return guards.Finding("features_match", "features", off, None)

    def labels(*specs) -> guards.Finding:
        return guards.Finding("labels_are_real", "specs", sum(not s.labels_are_real for s in specs), None)

    clean = [
        *log.findings(),
        guards.find_repeated_keys(features),
        split.find_shared_users(split.split_three(c3)),
        encode.find_leaked_labels(rates, "city_te"),
        labels(Q2, Q3),
        order(names),
    ]
    lo3 = cutoff_window(Q3)[0]
    early = c3.withColumn("cutoff", F.col("first_tx"))
    late = l3.withColumn("log_min_days_before", F.col("log_min_days_before") - 5)
    mixed = c3.select("user_id", "cutoff").join(l2.select("user_id", F.col("cutoff").alias("log_cutoff")), "user_id")
    both = split.union_all([c2.select("user_id", F.lit("a").alias("segment")), c3.select("user_id", F.lit("b").alias("segment"))])
    broken = [
        *guards.find(early, [guards.asof_guard()]),
        *guards.find(c3, [guards.cutoff_window_guard(Q2)]),
        *guards.find(c3, [guards.data_end_guard(lo3, Q3)]),
        *guards.find(late, [guards.logs_within_cutoff_guard()]),
        *guards.find(mixed, [guards.same_cutoff_guard("log_cutoff")]),
        guards.find_repeated_keys(both),
        split.find_shared_users(both),
        encode.find_leaked_labels(c3.withColumn("te", F.col("is_churn").cast("double")), "te"),
        labels(fake[0]),
        order(names[::-1]),
    ]
    rows = [(f.rule, kind, int(f.rows), f.worst) for kind, found in (("clean", clean), ("broken", broken)) for f in found]
    return spark.createDataFrame(rows, "rule string, input string, n_rows bigint, worst double")
