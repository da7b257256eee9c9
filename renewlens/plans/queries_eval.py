"""Registered queries: merging, splits, encoding, metrics, calibration, decision, drift, reasons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from renewlens.operators import attribution, calibration, decision, drift, encode, metrics
from renewlens.operators import ranking, reasons, score, split
from renewlens.operators.logs import build_log_features, window_bounds
from renewlens.operators.quantiles import exact_quantiles, value_counts
from renewlens.plans import oracle_tables as O
from renewlens.plans.compose import (
    FIXED_SCORER,
    Sources,
    cohort_table,
    cutoff_table,
    demo_assumptions,
    feature_table,
    offers_with_reasons,
    scored_table,
)
from renewlens.plans.oracle_tables import log_loss, r6
from renewlens.plans.queries_data import ints
from renewlens.plans.registry import register
from renewlens.session import stage
from renewlens.sources.demo import Q2, Q3, Q3_FIXED, Q3_T7
from renewlens.sources.schemas import CATEGORICAL

MIN_BIN = 50
_S3 = O.scored_block(Q3, Q2)
_S2 = O.scored_block(Q2)
_MERGED = O.merged_block((Q2, Q3))
_STRATA = O.strata_block()
_A = O.assumptions_block(Q3, Q2)


def scored(src: Sources) -> DataFrame:
    """The q3 cohort with score and segment, stored because most reports read it repeatedly."""
    return stage(scored_table(src, Q3, Q2), "scored")


def slim(src: Sources) -> DataFrame:
    """User, label, score and segment only."""
    return stage(
        scored_table(src, Q3, Q2).select("user_id", "is_churn", "p", "segment"), "slim"
    )


def merged(src: Sources) -> DataFrame:
    parts = {s.name: cutoff_table(src, s).select("user_id", "is_churn") for s in (Q2, Q3)}
    return split.merge_cohorts(parts)


def assumptions(src: Sources) -> DataFrame:
    return stage(demo_assumptions(src, Q3, Q2), "assumptions")


# --- merging and splits ----------------------------------------------------


@register(
    "merge_cohorts", f"SELECT user_id, {ints('is_churn')}, cohort FROM {_MERGED}", _MERGED
)
def merge(src: Sources) -> DataFrame:
    return merged(src)


@register(
    "union_all",
    "SELECT user_id, CAST(count(*) AS BIGINT) AS n_rows FROM (SELECT user_id FROM tx UNION ALL"
    " SELECT user_id FROM logs) x GROUP BY user_id",
    "tx",
    "logs",
)
def union_all(src: Sources) -> DataFrame:
    both = split.union_all([src.transactions.select("user_id"), src.logs.select("user_id")])
    return both.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_rows"))


@register(
    "cohort_summary",
    f"SELECT cohort, count(*) AS n, {r6('avg(is_churn)', 'churn_rate')} FROM {_MERGED} GROUP BY cohort",
    _MERGED,
)
def cohort_summary(src: Sources) -> DataFrame:
    return split.cohort_summary(merged(src))


@register(
    "shared_users",
    f"SELECT user_id, count(DISTINCT cohort) AS n_cohorts FROM {_MERGED} GROUP BY user_id"
    " HAVING count(DISTINCT cohort) > 1",
    _MERGED,
)
def shared_users(src: Sources) -> DataFrame:
    return split.shared_users(merged(src))


@register(
    "group_strata", f"SELECT user_id, n, k, stratum FROM {_STRATA}", _STRATA
)
def group_strata(src: Sources) -> DataFrame:
    return split.group_strata(merged(src))


_C3 = O.cutoffs_block(Q3)
O.block("rank42", O.hash_rank_sql(_C3, 42, "is_churn"), _C3)


@register(
    "hash_rank_in_stratum",
    f"SELECT user_id, {ints('is_churn')}, hash_rank, stratum_n FROM rank42",
    "rank42",
)
def hash_rank_in_stratum(src: Sources) -> DataFrame:
    base = cutoff_table(src, Q3).select("user_id", "is_churn")
    return ranking.hash_rank(base, seed=42, strata=["is_churn"])


@register(
    "split_two",
    "SELECT user_id, CAST(is_churn AS BIGINT) AS is_churn, CASE WHEN hash_rank <="
    " round_even(0.2::DOUBLE * stratum_n, 0) THEN 'es' ELSE 'train' END AS segment FROM rank42",
    "rank42",
)
def split_two(src: Sources) -> DataFrame:
    return split.split_two(cutoff_table(src, Q3).select("user_id", "is_churn"))


O.block(
    "three",
    """SELECT user_id, is_churn, CASE WHEN hash_rank <= n_sel THEN 'sel'
  WHEN hash_rank <= n_sel + round_even(0.176::DOUBLE * (stratum_n - n_sel), 0) THEN 'es'
  ELSE 'train' END AS segment
FROM (SELECT *, round_even(0.15::DOUBLE * stratum_n, 0) AS n_sel FROM rank42) r""",
    "rank42",
)


@register("split_three", f"SELECT user_id, {ints('is_churn')}, segment FROM three", "three")
def split_three(src: Sources) -> DataFrame:
    return split.split_three(cutoff_table(src, Q3).select("user_id", "is_churn"))


@register(
    "take_rows",
    f"SELECT user_id, {ints('is_churn')} FROM three WHERE segment = 'sel'",
    "three",
)
def take_rows(src: Sources) -> DataFrame:
    from renewlens.operators.features import take_rows as take

    return take(split.split_three(cutoff_table(src, Q3).select("user_id", "is_churn")), "sel")


O.block("grank", O.hash_rank_sql(_STRATA, 42, "stratum"), _STRATA)


@register(
    "split_group",
    f"""SELECT m.user_id, CAST(m.is_churn AS BIGINT) AS is_churn, m.cohort,
  CASE WHEN g.hash_rank <= round_even(0.1::DOUBLE * g.stratum_n, 0) THEN 'take' ELSE 'rest' END AS segment
FROM {_MERGED} m JOIN grank g ON g.user_id = m.user_id""",
    _MERGED,
    "grank",
)
def split_group(src: Sources) -> DataFrame:
    return split.split_group(merged(src), test_size=0.1)


_TENTH = "round_even(0.1::DOUBLE * g.stratum_n, 0)"
O.block(
    "four",
    f"""SELECT m.user_id, m.is_churn, m.cohort, CASE WHEN g.hash_rank <= {_TENTH} THEN 'cal'
  WHEN g.hash_rank <= {_TENTH} + {_TENTH} THEN 'sel'
  WHEN g.hash_rank <= {_TENTH} + {_TENTH} + {_TENTH} THEN 'es' ELSE 'train' END AS segment
FROM {_MERGED} m JOIN grank g ON g.user_id = m.user_id""",
    _MERGED,
    "grank",
)


@register(
    "split_four_group", f"SELECT user_id, {ints('is_churn')}, cohort, segment FROM four", "four"
)
def split_four(src: Sources) -> DataFrame:
    return split.split_four_group(merged(src))


@register(
    "segment_assign_join",
    f"SELECT segment, count(*) AS n, count(DISTINCT user_id) AS n_users,"
    f" {r6('avg(is_churn)', 'churn_rate')} FROM four GROUP BY segment",
    "four",
)
def segment_assign(src: Sources) -> DataFrame:
    return split.split_summary(split.split_four_group(merged(src)))


@register(
    "folds_stratified",
    "SELECT user_id, CAST(is_churn AS BIGINT) AS is_churn, CAST((hash_rank - 1) % 5 AS BIGINT) AS fold FROM rank42",
    "rank42",
)
def folds_stratified(src: Sources) -> DataFrame:
    return split.folds_stratified(cutoff_table(src, Q3).select("user_id", "is_churn"))


O.block(
    "gfolds",
    f"""SELECT m.*, CAST((g.hash_rank - 1) % 4 AS BIGINT) AS fold
FROM {_MERGED} m JOIN grank g ON g.user_id = m.user_id""",
    _MERGED,
    "grank",
)
O.block("rrank", O.hash_rank_sql(_MERGED, 42, "is_churn", "cohort, user_id"), _MERGED)
O.block(
    "rfolds",
    "SELECT user_id, is_churn, cohort, CAST((hash_rank - 1) % 4 AS BIGINT) AS fold FROM rrank",
    "rrank",
)


@register(
    "folds_grouped", f"SELECT user_id, {ints('is_churn')}, cohort, fold FROM gfolds", "gfolds"
)
def folds_grouped(src: Sources) -> DataFrame:
    return split.folds_grouped(merged(src))


@register(
    "folds_random_control",
    f"SELECT user_id, {ints('is_churn')}, cohort, fold FROM rfolds",
    "rfolds",
)
def folds_random(src: Sources) -> DataFrame:
    return split.folds_random_control(merged(src))


def _fold_report_sql(folds: str) -> str:
    return f"""SELECT v.fold, (SELECT count(*) FROM {folds}) - count(*) AS train_rows,
  count(*) AS valid_rows, {r6('avg(v.is_churn)', 'valid_rate')},
  count(DISTINCT CASE WHEN EXISTS (SELECT 1 FROM {folds} o WHERE o.user_id = v.user_id
    AND o.fold <> v.fold) THEN v.user_id END) AS crossing_users,
  round(CAST(count(DISTINCT CASE WHEN EXISTS (SELECT 1 FROM {folds} o WHERE o.user_id = v.user_id
    AND o.fold <> v.fold) THEN v.user_id END) AS DOUBLE) / count(DISTINCT v.user_id), 6) + 0.0 AS crossing_share
FROM {folds} v GROUP BY v.fold"""


@register("fold_report", _fold_report_sql("rfolds"), "rfolds")
def fold_report(src: Sources) -> DataFrame:
    return split.fold_report(stage(split.folds_random_control(merged(src)), "folds"))


@register("fold_report_grouped", _fold_report_sql("gfolds"), "gfolds")
def fold_report_grouped(src: Sources) -> DataFrame:
    return split.fold_report(stage(split.folds_grouped(merged(src)), "folds"))


@register(
    "crossing_users",
    """SELECT user_id, string_agg(seg, '|' ORDER BY seg) AS segments FROM
  (SELECT DISTINCT user_id, concat('f', fold) AS seg FROM rfolds) x GROUP BY user_id HAVING count(*) > 1""",
    "rfolds",
)
def crossing_users(src: Sources) -> DataFrame:
    folds = split.folds_random_control(merged(src))
    return split.crossing_users(folds.withColumn("segment", F.concat(F.lit("f"), "fold")))


# --- encoding --------------------------------------------------------------

_CAT = "last_payment_method_id"
_T2, _T3 = O.tx_features_block(Q2), O.tx_features_block(Q3)
O.block(
    "encoder",
    f"""SELECT {_CAT}, n, pos, (pos + prior * 100.0::DOUBLE) / (n + 100.0::DOUBLE) AS encoding, prior
FROM (SELECT {_CAT}, count(*) AS n, CAST(sum(is_churn) AS BIGINT) AS pos,
  (SELECT avg(is_churn) FROM {_T2}) AS prior FROM {_T2} GROUP BY {_CAT}) x""",
    _T2,
)
_ENC = f"SELECT {ints(_CAT)}, n, pos, {r6('encoding', 'encoding')}, {r6('prior', 'prior')} FROM encoder"


def _train(src: Sources) -> DataFrame:
    return feature_table(src, Q2, with_logs=False).select("user_id", "is_churn", _CAT)


@register("category_stats", f"SELECT {ints(_CAT)}, pos, n FROM encoder", "encoder")
def category_stats(src: Sources) -> DataFrame:
    return encode.category_stats(_train(src), _CAT)


@register("target_encode_fit", _ENC, "encoder")
def target_encode_fit(src: Sources) -> DataFrame:
    return encode.target_encode_fit(_train(src), _CAT)


@register(
    "target_encode_apply",
    f"""SELECT t.user_id, round(coalesce(e.encoding, (SELECT max(prior) FROM encoder)), 6) + 0.0 AS {_CAT}_te
FROM {_T3} t LEFT JOIN encoder e ON e.{_CAT} = t.{_CAT}""",
    _T3,
    "encoder",
)
def target_encode_apply(src: Sources) -> DataFrame:
    encoder = stage(encode.target_encode_fit(_train(src), _CAT), "encoder")
    valid = feature_table(src, Q3, with_logs=False).select("user_id", _CAT)
    return encode.target_encode_apply(valid, encoder, _CAT).drop(_CAT)


O.block("rank_t2", O.hash_rank_sql(_T2, 42, "is_churn"), _T2)
O.block("folds_t2", "SELECT *, (hash_rank - 1) % 5 AS fold FROM rank_t2", "rank_t2")


@register(
    "target_encode_oof",
    f"""SELECT user_id, CAST(fold AS BIGINT) AS fold,
  round((pos + prior * 100.0::DOUBLE) / (n + 100.0::DOUBLE), 6) + 0.0 AS {_CAT}_te FROM (
  SELECT a.user_id, a.fold,
    (SELECT count(*) FROM folds_t2 b WHERE b.fold <> a.fold AND b.{_CAT} = a.{_CAT}) AS n,
    (SELECT coalesce(sum(is_churn), 0) FROM folds_t2 b WHERE b.fold <> a.fold AND b.{_CAT} = a.{_CAT}) AS pos,
    (SELECT avg(is_churn) FROM folds_t2 b WHERE b.fold <> a.fold) AS prior FROM folds_t2 a) x""",
    "folds_t2",
)
def target_encode_oof(src: Sources) -> DataFrame:
    out = encode.target_encode_oof(stage(_train(src), "train"), _CAT)
    return out.select("user_id", "fold", f"{_CAT}_te")


@register(
    "target_encode_naive",
    f"""SELECT t.user_id, round(e.encoding, 6) + 0.0 AS {_CAT}_te
FROM {_T2} t JOIN encoder e ON e.{_CAT} = t.{_CAT}""",
    _T2,
    "encoder",
)
def target_encode_naive(src: Sources) -> DataFrame:
    out = encode.target_encode_naive(stage(_train(src), "train"), _CAT)
    return out.select("user_id", f"{_CAT}_te")


@register(
    "category_levels",
    f"SELECT DISTINCT CAST({_CAT} AS BIGINT) AS level FROM {_T2} WHERE {_CAT} <> -1",
    _T2,
)
def category_levels(src: Sources) -> DataFrame:
    return encode.category_levels(_train(src), _CAT)


# --- metrics ---------------------------------------------------------------

_LL = log_loss()


@register(
    "log_loss",
    f"SELECT count(*) AS n, {r6(f'avg({_LL})', 'log_loss')},"
    f" {r6('avg((p - is_churn) * (p - is_churn))', 'brier')} FROM {_S3}",
    _S3,
)
def log_loss_query(src: Sources) -> DataFrame:
    return metrics.log_loss_report(scored_table(src, Q3))


@register(
    "brier_score",
    f"SELECT segment, {r6('avg((p - is_churn) * (p - is_churn))', 'brier')} FROM {_S3} GROUP BY segment",
    _S3,
)
def brier(src: Sources) -> DataFrame:
    return scored_table(src, Q3, Q2).groupBy("segment").agg(metrics.brier_score().alias("brier"))


@register(
    "constant_log_loss",
    f"""SELECT n, {r6('rate', 'rate')}, {r6('prior', 'prior')},
  {r6('-(rate * ln(prior) + (1 - rate) * ln(1 - prior))', 'constant_log_loss')}
FROM (SELECT count(*) AS n, avg(is_churn) AS rate,
  (SELECT avg(is_churn) FROM {O.cutoffs_block(Q2)}) AS prior FROM {_C3}) x""",
    O.cutoffs_block(Q2),
    _C3,
)
def constant_loss(src: Sources) -> DataFrame:
    prior = cutoff_table(src, Q2).agg(F.avg("is_churn")).scalar()
    return metrics.constant_log_loss(cutoff_table(src, Q3), prior)


@register(
    "roc_auc",
    f"""SELECT n_pos, n_neg, round(wins / (n_pos::DOUBLE * n_neg), 6) + 0.0 AS auc FROM (
  SELECT (SELECT count(*) FROM {_S3} WHERE is_churn = 1) AS n_pos,
    (SELECT count(*) FROM {_S3} WHERE is_churn = 0) AS n_neg,
    (SELECT sum(CASE WHEN a.p > b.p THEN 1.0 WHEN a.p = b.p THEN 0.5 ELSE 0 END)::DOUBLE
     FROM {_S3} a, {_S3} b WHERE a.is_churn = 1 AND b.is_churn = 0) AS wins) x""",
    _S3,
)
def roc_auc(src: Sources) -> DataFrame:
    return metrics.roc_auc(slim(src))


@register(
    "pr_auc",
    f"""SELECT {r6('sum(pos * cum_pos::DOUBLE / cum_n) / sum(pos)', 'pr_auc')} FROM (
  SELECT pos, sum(pos) OVER w AS cum_pos, sum(n) OVER w AS cum_n
  FROM (SELECT p, sum(is_churn) AS pos, count(*) AS n FROM {_S3} GROUP BY p) s WINDOW w AS (ORDER BY p DESC)) x""",
    _S3,
)
def pr_auc(src: Sources) -> DataFrame:
    return metrics.pr_auc(slim(src))


@register(
    "membership_flag",
    f"SELECT user_id, segment FROM {_S3}",
    _S3,
)
def membership_flag(src: Sources) -> DataFrame:
    base = cohort_table(src, Q3).select("user_id")
    return metrics.repeat_vs_new(base, cutoff_table(src, Q2))


@register(
    "repeat_vs_new",
    f"SELECT segment, count(*) AS n, {r6('avg(is_churn)', 'churn_rate')} FROM {_S3} GROUP BY segment",
    _S3,
)
def repeat_vs_new(src: Sources) -> DataFrame:
    tagged = metrics.repeat_vs_new(cohort_table(src, Q3), cutoff_table(src, Q2))
    return tagged.groupBy("segment").agg(
        F.count(F.lit(1)).alias("n"), F.avg("is_churn").alias("churn_rate")
    )


_SEG = f"""count(*) AS n, round(CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM {_S3}), 6) + 0.0 AS share,
  {r6('avg(is_churn)', 'actual_rate')}, {r6('avg(p)', 'mean_pred')}, {r6(f'avg({_LL})', 'log_loss')}"""


@register(
    "segment_report",
    f"SELECT segment, {_SEG} FROM {_S3} GROUP BY segment UNION ALL SELECT 'all', {_SEG} FROM {_S3}",
    _S3,
)
def segment_report(src: Sources) -> DataFrame:
    return metrics.segment_report(slim(src))


# --- calibration -----------------------------------------------------------


@register(
    "calibration_in_the_large",
    f"""SELECT n, {r6('a', 'actual_rate')}, {r6('m', 'mean_pred')}, {r6('m - a', 'bias')},
  {r6('m / a - 1', 'relative_bias')} FROM (SELECT count(*) AS n, avg(is_churn) AS a, avg(p) AS m FROM {_S3}) x""",
    _S3,
)
def in_the_large(src: Sources) -> DataFrame:
    return calibration.calibration_in_the_large(scored_table(src, Q3))


def _curve_block(name: str, source: str, edges: str, by: str = "") -> str:
    """Reliability bins; ``edges`` is a list expression aggregated per group."""
    cols = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    join = f"ON e.{by} = s.{by}" if by else "ON true"
    O.block(f"{name}_edges", f"SELECT {cols}list_sort(list_distinct({edges})) AS e FROM {source} {group}", source)
    O.block(
        name,
        f"""SELECT {cols}bin, e[bin] AS lo, e[bin + 1] AS hi, count(*) AS n, avg(p) AS mean_pred,
  avg(is_churn) AS actual_rate FROM (
  SELECT {f's.{by}, ' if by else ''}s.p, s.is_churn, e.e,
    len(list_filter(e.e[2:len(e.e) - 1], lambda x: x <= s.p)) + 1 AS bin
  FROM {source} s JOIN {name}_edges e {join}) b GROUP BY {cols}bin, e""",
        source,
        f"{name}_edges",
    )
    return name


_DECILES = "[" + ", ".join(f"{i / 10}" for i in range(11)) + "]"
_CURVE = _curve_block("curve", _S3, f"quantile_cont(p, {_DECILES})")
_UCURVE = _curve_block(
    "ucurve", _S3, "any_value([" + ", ".join(f"{i / 10}::DOUBLE" for i in range(11)) + "])"
)
_CURVE_SQL = """SELECT bin, {lo}, {hi}, n, {m}, {a}, {g}, CAST(n >= {k} AS BIGINT) AS enough FROM {t}"""


def _curve_sql(t: str) -> str:
    return _CURVE_SQL.format(
        lo=r6("lo", "lo"),
        hi=r6("hi", "hi"),
        m=r6("mean_pred", "mean_pred"),
        a=r6("actual_rate", "actual_rate"),
        g=r6("mean_pred - actual_rate", "gap"),
        k=MIN_BIN,
        t=t,
    )


@register("reliability_curve", _curve_sql(_CURVE), _CURVE)
def reliability_curve(src: Sources) -> DataFrame:
    return calibration.reliability_curve(slim(src), min_count=MIN_BIN)


@register("reliability_curve_uniform", _curve_sql(_UCURVE), _UCURVE)
def reliability_uniform(src: Sources) -> DataFrame:
    return calibration.reliability_curve(slim(src), strategy="uniform", min_count=MIN_BIN)


_ECE = f"""{r6('sum(n * abs(mean_pred - actual_rate)) / sum(n)', 'ece')},
  {r6(f'max(CASE WHEN n >= {MIN_BIN} THEN abs(mean_pred - actual_rate) END)', 'mce')}, count(*) AS n_bins"""


@register("ece", f"SELECT {_ECE} FROM {_UCURVE}", _UCURVE)
def ece(src: Sources) -> DataFrame:
    return calibration.ece(
        calibration.reliability_curve(scored_table(src, Q3), strategy="uniform", min_count=MIN_BIN)
    )


@register(
    "mce",
    f"SELECT {r6(f'max(CASE WHEN n >= {MIN_BIN} THEN abs(mean_pred - actual_rate) END)', 'mce')} FROM {_CURVE}",
    _CURVE,
)
def mce(src: Sources) -> DataFrame:
    return calibration.mce(calibration.reliability_curve(slim(src), min_count=MIN_BIN))


@register(
    "tie_profile",
    f"""SELECT count(*) AS n_distinct, {r6('max(n)::DOUBLE / sum(n)', 'max_tie_share')},
  {r6('sum(CASE WHEN n > 1 THEN n ELSE 0 END)::DOUBLE / sum(n)', 'tied_share')}
FROM (SELECT p, count(*) AS n FROM {_S3} GROUP BY p) x""",
    _S3,
)
def tie_profile(src: Sources) -> DataFrame:
    return calibration.tie_profile(scored_table(src, Q3))


O.block(
    "scored_all",
    f"SELECT user_id, is_churn, p, segment FROM {_S3} UNION ALL SELECT user_id, is_churn, p, 'all' FROM {_S3}",
    _S3,
)
_SCURVE = _curve_block("scurve", "scored_all", f"quantile_cont(p, {_DECILES})", "segment")
O.block("sece", f"SELECT segment, {_ECE} FROM {_SCURVE} GROUP BY segment", _SCURVE)


@register(
    "calibration_summary",
    f"""SELECT s.*, e.ece, e.mce, e.n_bins FROM (SELECT segment, count(*) AS n,
  {r6('avg(is_churn)', 'actual_rate')}, {r6('avg(p)', 'mean_pred')}, {r6(f'avg({_LL})', 'log_loss')},
  {r6('avg((p - is_churn) * (p - is_churn))', 'brier')}, {r6('avg(p) / avg(is_churn) - 1', 'relative_bias')}
  FROM scored_all GROUP BY segment) s JOIN sece e ON e.segment = s.segment""",
    "scored_all",
    "sece",
)
def calibration_summary(src: Sources) -> DataFrame:
    return calibration.calibration_summary(slim(src), min_count=MIN_BIN)


@register(
    "loss_decomposition",
    f"""SELECT CASE WHEN p <= 0.3 THEN 'floor_block' ELSE 'rest' END AS part, count(*) AS n,
  round(CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM {_S3}), 6) + 0.0 AS share,
  {r6('avg(is_churn)', 'actual_rate')}, {r6('avg(p)', 'mean_raw')}, {r6('avg(greatest(p, 0.3))', 'mean_calibrated')},
  {r6(f'sum({_LL}) / (SELECT count(*) FROM {_S3})', 'contribution_raw')},
  {r6(f"sum({log_loss(p='greatest(p, 0.3)')}) / (SELECT count(*) FROM {_S3})", 'contribution_calibrated')}
FROM {_S3} GROUP BY 1""",
    _S3,
)
def loss_decomposition(src: Sources) -> DataFrame:
    rows = slim(src).withColumn("p_calibrated", F.greatest("p", F.lit(0.3)))
    return calibration.loss_decomposition(rows, F.col("p") <= 0.3)


# Isotonic regression by its min-max form: the fit at a score is the largest, over starts at or below
# it, of the least mean of labels up to an end at or above it.

O.block(
    "iso_points",
    f"""SELECT *, row_number() OVER (ORDER BY x) AS i, sum(n) OVER w AS cn, sum(k) OVER w AS ck FROM (
  SELECT p AS x, count(*) AS n, sum(is_churn) AS k FROM {_S2} GROUP BY p) s WINDOW w AS (ORDER BY x)""",
    _S2,
)
O.block(
    "iso_fit",
    """SELECT i, any_value(x) AS x, any_value(n) AS n, max(least_mean) AS v FROM (
  SELECT a.i AS start, b.i, b.x, b.n, min((b.ck - a.ck + a.k)::DOUBLE / (b.cn - a.cn + a.n)) OVER
    (PARTITION BY a.i ORDER BY b.i DESC ROWS UNBOUNDED PRECEDING) AS least_mean
  FROM iso_points a JOIN iso_points b ON b.i >= a.i) m GROUP BY i""",
    "iso_points",
)
O.block(
    "iso_bounds",
    f"""SELECT CASE WHEN z > 0 THEN {calibration.JEFFREYS} / (z + 1) ELSE 0.0 END::DOUBLE AS lo,
  CASE WHEN o > 0 THEN 1 - {calibration.JEFFREYS} / (o + 1) ELSE 1.0 END::DOUBLE AS hi
FROM (SELECT coalesce(sum(n) FILTER (WHERE v <= 0), 0)::DOUBLE AS z, coalesce(sum(n) FILTER (WHERE v >= 1), 0)::DOUBLE AS o FROM iso_fit) e""",
    "iso_fit",
)
O.block("iso_blocks", "SELECT round(v, 9) AS v, min(x) AS x0, max(x) AS x1 FROM iso_fit GROUP BY round(v, 9)", "iso_fit")


@register(
    "isotonic_fit",
    f"""SELECT {r6('least(greatest(v, lo), hi)', 'calibrated')}, {r6('x0', 'raw_from')}, {r6('x1', 'raw_to')}
FROM iso_blocks, iso_bounds""",
    "iso_blocks",
    "iso_bounds",
)
def isotonic_fit(src: Sources) -> DataFrame:
    """Blocks of the monotone mapping fitted on q2."""
    base = stage(scored_table(src, Q2).select("user_id", "is_churn", "p"), "cal")
    knots = calibration.fit_isotonic(base).knots(base)
    blocks = knots.groupBy(F.round("calibrated", 9).alias("calibrated"))
    return blocks.agg(F.min("raw").alias("raw_from"), F.max("raw").alias("raw_to"))


@register(
    "isotonic_apply",
    f"""SELECT user_id, {r6('p', 'p')}, {r6('least(greatest(CASE WHEN p < x0 THEN coalesce(pv + (v - pv) * (p - px) / (x0 - px), v) ELSE v END, lo), hi)', 'p_calibrated')}
FROM (SELECT s.user_id, s.p, coalesce(b.v, z.v) AS v, coalesce(b.x0, z.x0) AS x0, b.pv, b.px
  FROM {_S3} s LEFT JOIN (SELECT *, lag(v) OVER w AS pv, lag(x1) OVER w AS px FROM iso_blocks WINDOW w AS (ORDER BY x0)) b
    ON s.p <= b.x1 AND s.p > coalesce(b.px, -1), (SELECT * FROM iso_blocks ORDER BY x0 DESC LIMIT 1) z) m, iso_bounds""",
    _S3,
    "iso_blocks",
    "iso_bounds",
)
def isotonic_apply(src: Sources) -> DataFrame:
    """q3 scores through the mapping fitted on q2."""
    base = stage(scored_table(src, Q2).select("user_id", "is_churn", "p"), "cal")
    return calibration.fit_isotonic(base).apply(slim(src)).select("user_id", "p", "p_calibrated")


@register("calibration_compare")
def calibration_compare(src: Sources) -> DataFrame:
    """Raw and calibrated scores, every metric and segment."""
    base = stage(scored_table(src, Q2).select("user_id", "is_churn", "p"), "cal")
    rows = stage(calibration.fit_isotonic(base).apply(slim(src)), "calibrated")
    return calibration.calibration_compare(
        rows, {"raw": "p", "calibrated": "p_calibrated"}, min_count=MIN_BIN
    )


# --- ranking and decision --------------------------------------------------

_R = O.ranked_block(_S3)


@register(
    "rank_by_score", f"SELECT user_id, {r6('p', 'p')}, rank FROM {_R}", _R
)
def rank_by_score(src: Sources) -> DataFrame:
    return decision.rank_by_score(slim(src)).select("user_id", "p", "rank")


@register(
    "prefix_sums", f"SELECT user_id, cum_p_units, cum_is_churn, n_total FROM {_R}", _R
)
def prefix_sums(src: Sources) -> DataFrame:
    return decision.rank_by_score(slim(src)).select(
        "user_id", "cum_p_units", "cum_is_churn", "n_total"
    )


@register(
    "top_fraction",
    f"SELECT user_id, rank FROM {_R} WHERE rank <= greatest(round_even(0.05::DOUBLE * n_total, 0), 1)",
    _R,
)
def top_fraction(src: Sources) -> DataFrame:
    return ranking.top_fraction(decision.rank_by_score(slim(src)), 0.05).select("user_id", "rank")


@register(
    "equidistant_sample",
    f"""SELECT user_id, rank FROM {_R} WHERE rank - 1 IN
  (SELECT round_even(i * (SELECT max(n_total) - 1 FROM {_R})::DOUBLE / 6, 0) FROM range(7) t(i))""",
    _R,
)
def equidistant_sample(src: Sources) -> DataFrame:
    order = decision.rank_by_score(slim(src))
    return ranking.equidistant_sample(order, 7).select("user_id", "rank")


@register(
    "head_n",
    f"SELECT user_id, {r6('p', 'p')} FROM {_S3} ORDER BY p DESC, user_id LIMIT 20",
    _S3,
)
def head_n(src: Sources) -> DataFrame:
    rows = scored_table(src, Q3).select("user_id", "p")
    return ranking.head_n(rows, 20, F.col("p").desc(), F.col("user_id"))


_A_COLS = (
    "monthly_arpu prior_churn_rate expected_months ltv_saved r_save c_offer p_star".split()
)


@register(
    "resolve_assumptions",
    f"SELECT {', '.join(r6(c, c) for c in _A_COLS)},"
    " 'previous_cohort_churn_rate' AS months_source FROM assumptions",
    _A,
)
def resolve(src: Sources) -> DataFrame:
    return demo_assumptions(src, Q3, Q2)


@register(
    "decision_threshold",
    f"SELECT {r6('p_star', 'p_star')}, {r6('ltv_saved', 'ltv_saved')} FROM assumptions",
    _A,
)
def threshold(src: Sources) -> DataFrame:
    return demo_assumptions(src, Q3, Q2).select("p_star", "ltv_saved")


def _curve_points(name: str, ranked_table: str, step: float, by: str = "") -> str:
    n = decision.curve_steps(step)
    cols = f"t.{by}, " if by else ""
    return O.block(
        name,
        f"""SELECT {cols}t.k, t.size AS n_targeted, r.p AS threshold_p,
  r.cum_p_units / 1000000.0::DOUBLE * (a.r_save * a.ltv_saved) - t.size * a.c_offer AS expected_net,
  r.cum_is_churn * (a.r_save * a.ltv_saved) - t.size * a.c_offer AS settled_net,
  r.cum_is_churn AS hits, r.cum_is_churn::DOUBLE / t.size AS precision,
  r.cum_is_churn::DOUBLE / t.size / t.base_rate AS lift
FROM (SELECT {f'{by}, ' if by else ''}k, base_rate,
    CAST(greatest(least(round_even(k * n, 0), n), 1) AS BIGINT) AS size
  FROM (SELECT {f'{by}, ' if by else ''}count(*) AS n, avg(is_churn) AS base_rate FROM {ranked_table}
    {f'GROUP BY {by}' if by else ''}) b,
    (SELECT {O.dbl(step)} + i * {O.dbl(step)} AS k FROM range({n}) g(i)) g) t
JOIN {ranked_table} r ON r.rank = t.size {f'AND r.{by} = t.{by}' if by else ''}, assumptions a""",
        ranked_table,
        _A,
    )


_CP = _curve_points("campaign", _R, 0.002)
_CP_COLS = f"""{r6('k', 'k')}, n_targeted, {r6('threshold_p', 'threshold_p')},
  {r6('expected_net', 'expected_net', 4)}, {r6('settled_net', 'settled_net', 4)}, hits,
  {r6('precision', 'precision')}, {r6('lift', 'lift')}"""


def _money(df: DataFrame) -> DataFrame:
    for c in ("expected_net", "settled_net"):
        if c in df.columns:
            df = df.withColumn(c, F.round(c, 4))
    return df


@register("campaign_curve", f"SELECT {_CP_COLS} FROM {_CP}", _CP)
def campaign_curve(src: Sources) -> DataFrame:
    return _money(decision.campaign_curve(slim(src), assumptions(src)))


@register(
    "optimal_point",
    f"SELECT {_CP_COLS} FROM {_CP} ORDER BY round(expected_net, 6) DESC, campaign.k LIMIT 1",
    _CP,
)
def optimal_point(src: Sources) -> DataFrame:
    return _money(decision.optimal_point(decision.campaign_curve(slim(src), assumptions(src))))


@register(
    "argmax_row",
    f"SELECT {_CP_COLS} FROM {_CP} ORDER BY round(settled_net, 6) DESC, campaign.k LIMIT 1",
    _CP,
)
def argmax_row(src: Sources) -> DataFrame:
    curve = decision.campaign_curve(slim(src), assumptions(src))
    return _money(decision.optimal_point(curve, by="settled_net"))


@register(
    "curve_downsample",
    f"""SELECT {r6('k', 'k', 4)}, round(expected_net, 0) + 0.0 AS net FROM {_CP}
WHERE abs(round_even(k * 100, 0) - k * 100) < 1e-9""",
    _CP,
)
def curve_downsample(src: Sources) -> DataFrame:
    return decision.curve_downsample(decision.campaign_curve(slim(src), assumptions(src)))


@register(
    "random_baseline",
    f"""SELECT {r6('c.k', 'k')}, c.n_targeted, {r6('c.n_targeted * ((SELECT avg(is_churn) FROM ' + _S3 + ') * a.r_save * a.ltv_saved - a.c_offer)', 'random_net', 4)}
FROM {_CP} c, assumptions a""",
    _CP,
    _S3,
)
def random_baseline(src: Sources) -> DataFrame:
    rows, a = slim(src), assumptions(src)
    out = decision.random_baseline(decision.campaign_curve(rows, a), rows, a)
    return out.withColumn("random_net", F.round("random_net", 4))


_RS = O.ranked_block("scored_all", "ranked_seg", "segment")
_CS = _curve_points("campaign_seg", _RS, 0.01, "segment")


@register(
    "campaign_by_segment",
    f"""SELECT segment, {_CP_COLS.replace("AS k,", "AS best_share,", 1)},
  (SELECT count(*) FROM scored_all s WHERE s.segment = c.segment) AS n
FROM (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY expected_net DESC, k) AS rn
  FROM {_CS}) c WHERE rn = 1""",
    _CS,
)
def campaign_by_segment(src: Sources) -> DataFrame:
    return _money(decision.campaign_by_segment(slim(src), assumptions(src), step=0.01))


@register(
    "subset_calibration",
    f"""SELECT n_targeted, {r6('m', 'mean_pred')}, {r6('a', 'actual_rate')}, {r6('m - a', 'bias')},
  {r6('m / a - 1', 'relative_bias')} FROM (SELECT count(*) AS n_targeted,
  sum(CAST(round(p * 1000000) AS BIGINT))::BIGINT::DOUBLE / count(*) / 1000000.0::DOUBLE AS m, avg(is_churn) AS a
  FROM {_R} WHERE rank <= greatest(round_even(0.1::DOUBLE * n_total, 0), 1)) x""",
    _R,
)
def subset_calibration(src: Sources) -> DataFrame:
    return decision.subset_calibration(slim(src), 0.1)


@register(
    "fixed_rule_point",
    f"""SELECT 'all_new_users' AS rule, {r6('m::DOUBLE / n', 'k')}, m AS n_targeted,
  {r6('h * a.r_save * a.ltv_saved - m * a.c_offer', 'settled_net', 4)}, h AS hits,
  {r6('h::DOUBLE / m', 'precision')}, {r6('h::DOUBLE / m / b', 'lift')}
FROM (SELECT count(*) AS n, count(*) FILTER (WHERE segment = 'new') AS m,
  CAST(sum(is_churn) FILTER (WHERE segment = 'new') AS BIGINT) AS h, avg(is_churn) AS b FROM {_S3}) x,
  assumptions a""",
    _S3,
    _A,
)
def fixed_rule(src: Sources) -> DataFrame:
    return _money(
        decision.fixed_rule_point(
            slim(src), F.col("segment") == "new", assumptions(src), label="all_new_users"
        )
    )


_GRID = " UNION ALL ".join(
    f"SELECT {O.dbl(r)} AS r, {O.dbl(c)} AS c" for r in decision.R_GRID for c in decision.C_GRID
)


@register(
    "sensitivity_grid",
    f"""SELECT {r6('r', 'r_save')}, {r6('c', 'c_offer')}, {r6('star', 'p_star')},
  round(count(s.p)::DOUBLE / (SELECT count(*) FROM {_S3}), 6) + 0.0 AS best_share, count(s.p) AS n_targeted,
  {r6('coalesce(sum(CAST(round(s.p * 1000000) AS BIGINT)), 0)::BIGINT / 1000000.0::DOUBLE * (r * ltv) - count(s.p) * c', 'expected_net', 4)},
  {r6('coalesce(sum(s.is_churn), 0)::BIGINT * (r * ltv) - count(s.p) * c', 'settled_net', 4)}
FROM (SELECT r, c, ltv_saved AS ltv, c / (r * ltv_saved) AS star FROM ({_GRID}) g, assumptions) g
LEFT JOIN {_S3} s ON s.p > g.star GROUP BY r, c, star, ltv""",
    _S3,
    _A,
)
def sensitivity_grid(src: Sources) -> DataFrame:
    return _money(decision.sensitivity_grid(slim(src), assumptions(src)))


@register(
    "above_threshold",
    f"SELECT user_id, {r6('p', 'p')} FROM {_S3} WHERE p > (SELECT p_star FROM assumptions)",
    _S3,
    _A,
)
def above_threshold(src: Sources) -> DataFrame:
    return decision.above_threshold(slim(src), assumptions(src)).select("user_id", "p")


@register(
    "offer_list",
    f"""SELECT user_id, {r6('p', 'p')}, {r6('p * a.r_save * a.ltv_saved - a.c_offer', 'expected_net', 4)}
FROM {_S3}, assumptions a WHERE p > a.p_star""",
    _S3,
    _A,
)
def offer_list(src: Sources) -> DataFrame:
    listed = decision.offer_list(slim(src), assumptions(src))
    return _money(listed.select("user_id", "p", "expected_net"))


@register(
    "batch_totals",
    f"""SELECT count(*) AS n, count(*) FILTER (WHERE p > a.p_star) AS n_targeted,
  {r6('count(*) FILTER (WHERE p > a.p_star) * any_value(a.c_offer)', 'budget')},
  {r6('coalesce(sum(CAST(round(p * 1000000) AS BIGINT)) FILTER (WHERE p > a.p_star), 0)::BIGINT / 1000000.0::DOUBLE * any_value(a.r_save) * any_value(a.ltv_saved) - count(*) FILTER (WHERE p > a.p_star) * any_value(a.c_offer)', 'expected_net', 4)}
FROM {_S3}, assumptions a""",
    _S3,
    _A,
)
def batch_totals(src: Sources) -> DataFrame:
    return _money(decision.batch_totals(slim(src), assumptions(src)))


# --- two versions side by side --------------------------------------------

_SF = O.scored_block(Q3_FIXED)
_ST = O.scored_block(Q3_T7)
_COMMON = O.block(
    "common",
    f"""SELECT a.user_id, a.is_churn, a.p, b.p AS p_lead FROM {_S3} a JOIN {_SF} b ON b.user_id = a.user_id""",
    _S3,
    _SF,
)


def _versions(src: Sources) -> tuple[DataFrame, DataFrame]:
    return scored_table(src, Q3), scored_table(src, Q3_FIXED)


@register(
    "common_subset",
    f"SELECT user_id, {ints('is_churn')}, {r6('p', 'p')}, {r6('p_lead', 'p_lead')} FROM common",
    "common",
)
def common_subset(src: Sources) -> DataFrame:
    return split.common_subset(*_versions(src))


@register(
    "lead_time_cost",
    f"""SELECT count(*) AS n, {r6(f'avg({_LL})', 'loss_base')}, {r6(f"avg({log_loss(p='p_lead')})", 'loss_lead')},
  {r6(f"avg({log_loss(p='p_lead')}) / avg({_LL}) - 1", 'relative_cost')}
FROM (SELECT a.user_id, a.is_churn, a.p, b.p AS p_lead FROM {_S3} a JOIN {_ST} b ON b.user_id = a.user_id) c""",
    _S3,
    _ST,
)
def lead_time_cost(src: Sources) -> DataFrame:
    both = split.common_subset(scored_table(src, Q3), scored_table(src, Q3_T7))
    base, lead = metrics.log_loss(), metrics.log_loss(p="p_lead")
    return both.agg(
        F.count(F.lit(1)).alias("n"),
        base.alias("loss_base"),
        lead.alias("loss_lead"),
        (lead / base - 1).alias("relative_cost"),
    )


_FILL = f"""SELECT l.user_id, coalesce(s.p, (SELECT avg(is_churn) FROM {O.cutoffs_block(Q2)})) AS q,
  s.p IS NULL AS prior FROM {O.labels_block(Q3)} l LEFT JOIN {_SF} s ON s.user_id = l.user_id"""


@register(
    "submission_join",
    f"SELECT user_id, {r6('q', 'is_churn')}, CAST(prior AS BIGINT) AS is_prior FROM ({_FILL}) f",
    O.labels_block(Q3),
    _SF,
    O.cutoffs_block(Q2),
)
def submission_join(src: Sources) -> DataFrame:
    prior = cutoff_table(src, Q2).agg(F.avg("is_churn")).scalar()
    return score.fill_prior(src.labels(Q3), scored_table(src, Q3_FIXED), prior)


@register(
    "fill_prior",
    f"SELECT CAST(prior AS BIGINT) AS is_prior, count(*) AS n, {r6('avg(q)', 'mean_p')} FROM ({_FILL}) f GROUP BY prior",
    O.labels_block(Q3),
    _SF,
    O.cutoffs_block(Q2),
)
def fill_prior(src: Sources) -> DataFrame:
    return submission_join(src).groupBy("is_prior").agg(
        F.count(F.lit(1)).alias("n"), F.avg("is_churn").alias("mean_p")
    )


@register(
    "score_checks",
    f"""SELECT count(*) AS n_rows, count(*) FILTER (WHERE q IS NULL) AS n_null,
  count(*) - count(DISTINCT user_id) AS n_repeated,
  count(*) FILTER (WHERE q <= 0 OR q >= 1) AS n_out_of_range,
  (SELECT count(*) FROM {O.labels_block(Q3)}) AS n_requested FROM ({_FILL}) f""",
    O.labels_block(Q3),
    _SF,
    O.cutoffs_block(Q2),
)
def score_checks(src: Sources) -> DataFrame:
    return score.score_checks(src.labels(Q3), submission_join(src))


# --- drift -----------------------------------------------------------------

_FEATURES = O.feature_columns(Q2)
_F2, _F3 = O.features_block(Q2), O.features_block(Q3)


def _long(source: str, extra: str = "") -> str:
    """A row per row and feature: feature, v and the columns named by ``extra``."""
    kept = "".join(f"{c}, " for c in extra.split(", ") if c)
    cells = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in _FEATURES)
    return (
        f"SELECT * FROM (SELECT {kept}{cells} FROM {source}) w"
        f" UNPIVOT INCLUDE NULLS (v FOR feature IN ({', '.join(_FEATURES)}))"
    )


def _psi_blocks(tag: str, ref: str, cur: str, keys: str, cats: list[str], needs: list[str]) -> str:
    """PSI in SQL. ``ref`` and ``cur`` are queries giving keys and v."""
    on = " AND ".join(f"{{a}}.{k} = {{b}}.{k}" for k in keys.split(", "))
    O.block(f"{tag}_ref", ref, *needs)
    O.block(f"{tag}_cur", cur, *needs)
    listed = ", ".join(f"'{c}'" for c in cats) or "''"
    O.block(
        f"{tag}_scheme",
        f"""SELECT {keys}, CASE WHEN feature IN ({listed}) THEN 'category'
    WHEN count(DISTINCT v) <= 10 THEN 'discrete' ELSE 'quantile' END AS kind,
  list_sort(list_distinct(quantile_cont(v, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]))) AS e
FROM {tag}_ref GROUP BY {keys}""",
        f"{tag}_ref",
    )
    O.block(
        f"{tag}_known",
        f"SELECT DISTINCT {keys}, v FROM {tag}_ref WHERE v IS NOT NULL",
        f"{tag}_ref",
    )
    k = ", ".join(f"x.{c}" for c in keys.split(", "))
    label = """CASE WHEN x.v IS NULL THEN '__missing__'
    WHEN s.kind = 'quantile' THEN concat('range_', lpad(CAST(len(list_filter(s.e, lambda t: t <= x.v)) AS VARCHAR), 2, '0'))
    WHEN kn.v IS NOT NULL THEN concat('=', CASE WHEN floor(x.v) = x.v AND abs(x.v) < 1e15 THEN CAST(CAST(x.v AS BIGINT) AS VARCHAR)
      ELSE CAST(x.v AS VARCHAR) END)
    ELSE '__unseen__' END"""

    def binned(side: str, r: int, c: int) -> str:
        return f"""SELECT {k}, s.kind, {label} AS bin, {r} AS r, {c} AS c FROM {tag}_{side} x
  JOIN {tag}_scheme s ON {on.format(a='s', b='x')}
  LEFT JOIN {tag}_known kn ON {on.format(a='kn', b='x')} AND kn.v = x.v"""

    O.block(
        f"{tag}_bins",
        f"""SELECT {keys}, kind, bin, sum(r)::DOUBLE AS r, sum(c)::DOUBLE AS c FROM (
  {binned('ref', 1, 0)} UNION ALL {binned('cur', 0, 1)}
  UNION ALL SELECT {keys}, kind, '__missing__', 0, 0 FROM {tag}_scheme
  UNION ALL SELECT {keys}, kind, '__unseen__', 0, 0 FROM {tag}_scheme WHERE kind <> 'quantile'
  UNION ALL SELECT {keys}, kind, concat('range_', lpad(CAST(i AS VARCHAR), 2, '0')), 0, 0
    FROM (SELECT *, unnest(range(len(e) + 1)) AS i FROM {tag}_scheme WHERE kind = 'quantile') q) u
GROUP BY {keys}, kind, bin""",
        f"{tag}_ref",
        f"{tag}_cur",
        f"{tag}_scheme",
        f"{tag}_known",
    )
    O.block(
        f"{tag}_detail",
        f"""SELECT *, (greatest(p, 1e-6) - greatest(q, 1e-6)) * ln(greatest(p, 1e-6) / greatest(q, 1e-6)) AS contribution
FROM (SELECT {keys}, kind, bin, r / sum(r) OVER (PARTITION BY {keys}) AS p,
  c / sum(c) OVER (PARTITION BY {keys}) AS q FROM {tag}_bins) d""",
        f"{tag}_bins",
    )
    return O.block(
        f"{tag}_psi",
        f"""SELECT {keys}, kind, sum(CASE WHEN p > 0 OR q > 0 THEN contribution ELSE 0 END) AS psi,
  max(CAST((p > 0) <> (q > 0) AS INTEGER)) AS epsilon_floored, count(*) AS n_bins,
  max(CASE WHEN bin = '__missing__' THEN p END) AS reference_missing,
  max(CASE WHEN bin = '__missing__' THEN q END) AS current_missing,
  arg_min(bin, concat(lpad(CAST(CAST(round((10 - round(contribution, 9)) * 1000000000) AS BIGINT) AS VARCHAR), 12, '0'), bin)) AS top_bin
FROM {tag}_detail GROUP BY {keys}, kind""",
        f"{tag}_detail",
    )


_P = _psi_blocks(
    "fp", _long(_F2), _long(_F3), "feature", list(CATEGORICAL), [_F2, _F3]
)
_BAND = "CASE WHEN psi < 0.1 THEN 'stable' WHEN psi < 0.25 THEN 'moderate' ELSE 'significant' END"
_PSI_COLS = f"""kind, {r6('psi', 'psi')}, {_BAND} AS band, CAST(epsilon_floored AS BIGINT) AS epsilon_floored,
  n_bins, {r6('reference_missing', 'reference_missing')}, {r6('current_missing', 'current_missing')},
  {r6('current_missing - reference_missing', 'missing_delta')}, top_bin"""


def _periods(src: Sources) -> tuple[DataFrame, DataFrame]:
    return feature_table(src, Q2), feature_table(src, Q3)


def _split(src: Sources) -> DataFrame:
    return stage(drift.paired(*_periods(src), _FEATURES), "periods")


def _binned(src: Sources) -> DataFrame:
    split = _split(src)
    return drift.apply_bins(split, drift.fit_bins(split, _FEATURES))


@register("psi_table", f"SELECT feature, {_PSI_COLS} FROM {_P}", _P)
def psi_table(src: Sources) -> DataFrame:
    return drift.psi_table(*_periods(src), _FEATURES)


@register(
    "psi_detail",
    f"""SELECT feature, kind, bin, {r6('p', 'reference')}, {r6('q', 'current')}, {r6('contribution', 'contribution')}
FROM fp_detail""",
    "fp_detail",
)
def psi_detail(src: Sources) -> DataFrame:
    return drift.psi_detail(_binned(src)).drop("round")


@register(
    "fit_bins",
    """SELECT feature, kind, CASE WHEN kind = 'quantile' THEN array_to_string(
  list_transform(e, lambda x: CAST(CAST(x AS DECIMAL(28, 4)) AS VARCHAR)), '|') ELSE '' END AS edges FROM fp_scheme""",
    "fp_scheme",
)
def fit_bins(src: Sources) -> DataFrame:
    split = _split(src)
    return drift.scheme_table(split.sparkSession, drift.fit_bins(split, _FEATURES)).select(
        "feature", "kind", F.expr("array_join(transform(edges, e -> cast(cast(e as decimal(28,4)) as string)), '|')").alias("edges")
    )


@register(
    "apply_bins",
    "SELECT feature, kind, bin, CAST(r AS BIGINT) AS ref_n, CAST(c AS BIGINT) AS cur_n FROM fp_bins",
    "fp_bins",
)
def apply_bins(src: Sources) -> DataFrame:
    return _binned(src).drop("round")


@register(
    "psi_band",
    f"SELECT {_BAND} AS band, count(*) AS n_features FROM {_P} GROUP BY 1",
    _P,
)
def psi_bands(src: Sources) -> DataFrame:
    table = drift.psi_table(*_periods(src), _FEATURES)
    return table.groupBy("band").agg(F.count(F.lit(1)).alias("n_features"))


_SP = _psi_blocks(
    "sp",
    f"SELECT 'score' AS feature, p AS v FROM {_S2}",
    f"SELECT 'score' AS feature, p AS v FROM {_S3}",
    "feature",
    [],
    [_S2, _S3],
)


@register("score_psi", f"SELECT feature, {_PSI_COLS} FROM {_SP}", _SP)
def score_psi(src: Sources) -> DataFrame:
    return drift.score_psi(scored_table(src, Q2), scored_table(src, Q3))


_ROUNDS = 5
_HALF = "(CAST(concat('0x', substr(md5(concat_ws(':', '42', CAST(user_id AS VARCHAR))), 1, 15)) AS BIGINT) >> round) & 1"
_NL = O.block("np_long", _long(_F2, "user_id"), _F2)
_NR = f"(SELECT r.round, n.feature, n.v, {_HALF} AS a FROM {_NL} n, (SELECT unnest(range({_ROUNDS})) AS round) r)"


def _halves(side: int) -> str:
    return f"SELECT round, feature, v FROM {_NR} h WHERE a = {side}"


_NP = _psi_blocks("np", _halves(1), _halves(0), "round, feature", list(CATEGORICAL), [_NL])


@register(
    "noise_floor",
    f"""SELECT feature, {r6('avg(psi)', 'psi_mean')}, {r6('max(psi)', 'psi_max')}, count(*) AS rounds,
  round((SELECT quantile_cont(psi, 0.95) FROM {_NP}), 6) + 0.0 AS p95_all FROM {_NP} GROUP BY feature""",
    _NP,
)
def noise_floor(src: Sources) -> DataFrame:
    return drift.noise_floor(feature_table(src, Q2), _FEATURES, rounds=_ROUNDS)


@register(
    "label_drift",
    f"""SELECT {r6('a', 'reference_rate')}, {r6('b', 'current_rate')}, {r6('b / a - 1', 'relative_change')}
FROM (SELECT (SELECT avg(is_churn) FROM {O.cutoffs_block(Q2)}) AS a, (SELECT avg(is_churn) FROM {_C3}) AS b) x""",
    O.cutoffs_block(Q2),
    _C3,
)
def label_drift(src: Sources) -> DataFrame:
    return drift.label_drift(cutoff_table(src, Q2), cutoff_table(src, Q3))


@register(
    "list_share",
    f"""SELECT n, n_targeted, {r6('n_targeted::DOUBLE / n', 'share')} FROM (SELECT count(*) AS n,
  count(*) FILTER (WHERE p > (SELECT p_star FROM assumptions)) AS n_targeted FROM {_S3}) x""",
    _S3,
    _A,
)
def list_share(src: Sources) -> DataFrame:
    star = assumptions(src).select("p_star").scalar()
    return drift.list_share(scored_table(src, Q3), star)


@register(
    "drift_report",
    f"""SELECT 'feature' AS measure, f.feature AS name, {r6('f.psi', 'value')},
  {_BAND.replace('psi', 'f.psi')} AS reading,
  {r6('f.psi / nullif((SELECT quantile_cont(psi, 0.95) FROM ' + _NP + '), 0)', 'times_noise')}
FROM {_P} f
UNION ALL SELECT 'score', 'p', {r6('psi', 'value')}, {_BAND}, NULL FROM {_SP}
UNION ALL SELECT 'list_share', 'reference', {r6('avg(CAST(p > (SELECT p_star FROM assumptions) AS INTEGER))', 'value')}, NULL, NULL FROM {_S2}
UNION ALL SELECT 'list_share', 'current', {r6('avg(CAST(p > (SELECT p_star FROM assumptions) AS INTEGER))', 'value')}, NULL, NULL FROM {_S3}
UNION ALL SELECT 'label', 'relative_change', {r6(f'(SELECT avg(is_churn) FROM {_C3}) / (SELECT avg(is_churn) FROM {O.cutoffs_block(Q2)}) - 1', 'value')}, NULL, NULL""",
    _P,
    _NP,
    _SP,
    _S2,
    _S3,
    _A,
    _C3,
    O.cutoffs_block(Q2),
)
def drift_report(src: Sources) -> DataFrame:
    ref = stage(scored_table(src, Q2), "reference")
    cur = stage(scored_table(src, Q3), "current")
    star = assumptions(src).select("p_star").scalar()
    return drift.drift_report(ref, cur, _FEATURES, star, rounds=_ROUNDS)


@register(
    "exact_quantiles",
    f"""SELECT is_churn::BIGINT AS is_churn, q, round(v, 6) + 0.0 AS quantile FROM (
  SELECT is_churn, unnest([0.1::DOUBLE, 0.5::DOUBLE, 0.9::DOUBLE]) AS q,
    unnest(quantile_cont(mean_paid, [0.1, 0.5, 0.9])) AS v FROM {_T3} GROUP BY is_churn) x""",
    _T3,
)
def quantiles(src: Sources) -> DataFrame:
    table = feature_table(src, Q3, with_logs=False)
    counts = stage(value_counts(table, "mean_paid", keys=["is_churn"]), "counts")
    return exact_quantiles(counts, [0.1, 0.5, 0.9], keys=["is_churn"])


# --- explanation -----------------------------------------------------------

_SCORER = FIXED_SCORER
_ATTR = O.block(
    "attributed",
    " UNION ALL ".join(
        f"SELECT user_id, {i} AS no, '{f}' AS feature, '{reasons.GROUPS[f]}' AS grp,"
        f" {O.contribution(_SCORER, f)} AS shap, CAST({f} AS DOUBLE) AS value FROM {_S3}"
        for i, f in enumerate(_SCORER.features)
    ),
    _S3,
)
_GROUP_NO = {g: i for i, g in enumerate(dict.fromkeys(reasons.GROUPS[f] for f in _SCORER.features))}


def _group_total(g: str) -> str:
    members = [f for f in _SCORER.features if reasons.GROUPS[f] == g]
    return " + ".join(O.contribution(_SCORER, f) for f in members)


_GT = O.block(
    "group_totals",
    " UNION ALL ".join(
        f"SELECT user_id, {no} AS grp_no, '{g}' AS grp, {_group_total(g)} AS total FROM {_S3}"
        for g, no in _GROUP_NO.items()
    ),
    _S3,
)
_TOP = O.block(
    "top3",
    """SELECT t.user_id, t.rank, t.grp, t.total, t.top_total, r.feature, r.shap, r.value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY total DESC, grp_no) AS rank,
    max(total) OVER (PARTITION BY user_id) AS top_total FROM group_totals WHERE total > 0) t
JOIN (SELECT *, row_number() OVER (PARTITION BY user_id, grp ORDER BY shap DESC, no) AS rn
  FROM attributed) r ON r.user_id = t.user_id AND r.grp = t.grp AND r.rn = 1
WHERE t.rank <= 3""",
    _GT,
    _ATTR,
)


@register(
    "attribute",
    f"""SELECT user_id, {r6(str(_SCORER.base), 'base')}, feature, {r6('shap', 'shap')}, {r6('value', 'value')}
FROM {_ATTR}""",
    _ATTR,
)
def attribute(src: Sources) -> DataFrame:
    return attribution.attribute(scored_table(src, Q3), _SCORER)


@register(
    "assert_local_accuracy",
    f"""SELECT count(*) AS n, CAST(max(abs({O.SIGMOID} - p)) <= 1e-6 AS BIGINT) AS holds
FROM (SELECT s.user_id, any_value(s.p) AS p, {O.dbl(_SCORER.base)} + sum(a.shap) AS z
  FROM {_S3} s JOIN {_ATTR} a ON a.user_id = s.user_id GROUP BY s.user_id) x""",
    _S3,
    _ATTR,
)
def local_accuracy(src: Sources) -> DataFrame:
    gap = attribution.local_accuracy(scored_table(src, Q3), _SCORER)
    return gap.select("n", (F.col("max_gap") <= 1e-6).alias("holds"))


@register(
    "group_contributions",
    f"""SELECT user_id, grp AS "group", {r6('total', 'group_shap')} FROM {_GT}""",
    _GT,
)
def group_contributions(src: Sources) -> DataFrame:
    return attribution.group_contributions(scored_table(src, Q3), _SCORER, reasons.GROUPS)


@register(
    "top_contributors",
    f"""SELECT user_id, rank, grp AS "group", {r6('total', 'group_shap')}, feature,
  {r6('shap', 'feature_shap')}, {r6('value', 'value')} FROM {_TOP}""",
    _TOP,
)
def top_contributors(src: Sources) -> DataFrame:
    return attribution.top_contributors(
        scored_table(src, Q3), _SCORER, groups=reasons.GROUPS
    ).drop("top_shap")


@register(
    "representative_in_group",
    f"""SELECT user_id, grp AS "group", feature, {r6('shap', 'feature_shap')} FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, grp ORDER BY shap DESC, no) AS rn FROM {_ATTR}) x
WHERE rn = 1 AND grp = 'log_intensity' OR rn = 1 AND grp = 'tenure'""",
    _ATTR,
)
def representative(src: Sources) -> DataFrame:
    members: dict[str, list[str]] = {}
    for f in _SCORER.features:
        members.setdefault(reasons.GROUPS[f], []).append(f)
    cells = [
        F.struct(
            F.lit(g).alias("group"),
            attribution.representative_in_group(_SCORER, members[g]).alias("rep"),
        )
        for g in ("log_intensity", "tenure")
    ]
    rows = scored_table(src, Q3).select("user_id", F.explode(F.array(*cells)).alias("c"))
    return rows.select(
        "user_id",
        F.col("c.group").alias("group"),
        F.col("c.rep.feature").alias("feature"),
        F.col("c.rep.shap").alias("feature_shap"),
    )


@register(
    "mean_abs_attribution",
    f"SELECT feature, {r6('avg(abs(shap))', 'mean_abs_shap')} FROM {_ATTR} GROUP BY feature",
    _ATTR,
)
def mean_abs(src: Sources) -> DataFrame:
    return attribution.mean_abs_attribution(scored_table(src, Q3), _SCORER)


def _q(text: str | None) -> str:
    return "NULL" if text is None else "'" + text.replace("'", "''") + "'"


def _number(m: dict, x: str) -> str:
    if m["percent"]:
        return f"concat(format('{{:,.{m['digits']}f}}', {x} * 100), '%')"
    return f"format('{{:,.{m['digits']}f}}', {x})"


def _sentence(f: str) -> str:
    """SQL rendering of one feature's sentence, written per feature."""
    m = reasons.wording(f)
    noun, unit = m["noun"], m["unit"]
    absent = _q(noun + " is missing")
    if m["is_log"]:
        absent = f"CASE WHEN t.log_has_logs = 0 THEN 'No activity in the last 90 days' ELSE {absent} END"
    tail = f" {unit}" if unit else ""
    if m["flag_on"]:
        body = f"CASE WHEN value >= 0.5 THEN {_q(m['flag_on'])} ELSE {_q(m['flag_off'])} END"
    elif m["category"]:
        body = (
            f"CASE WHEN value = -1 THEN {_q(noun + ' is unknown')} WHEN value = 0 THEN"
            f" {_q(noun + ' is male')} ELSE {_q(noun + ' is female')} END"
        )
    elif m["template"]:
        body = f"replace({_q(m['template'])}, '{{v}}', {_number(m, 'value')})"
    else:
        body = f"concat({_q(noun + ' ')}, {_number(m, 'value')}, {_q(tail)})"
    if m["context"]:
        earlier = f"((CAST(t.{m['context']} AS DOUBLE) - value) / 2.0)"
        body = (
            f"concat({body}, CASE WHEN {earlier} >= 0 THEN concat(' (average per 30 days over the"
            f" 60 days before: ', {_number(m, earlier)}, {_q(tail + ')')}) ELSE '' END)"
        )
    return f"CASE WHEN value IS NULL THEN {absent} ELSE {body} END"


_HORIZON = " ".join(f"WHEN '{f}' THEN '{reasons.wording(f)['horizon']}'" for f in _SCORER.features)
_MARKED = O.block(
    "marked",
    f"""SELECT x.*, x.total / x.top_total AS relative_to_top, x.total / x.top_total >= 0.05 AS displayed,
  CASE x.feature {_HORIZON} END AS horizon,
  CASE x.feature {' '.join(f"WHEN '{f}' THEN {_sentence(f)}" for f in _SCORER.features)} END AS reason
FROM {_TOP} x JOIN {_S3} t ON t.user_id = x.user_id, assumptions a WHERE t.p > a.p_star""",
    _TOP,
    _S3,
    _A,
)


def _marked(src: Sources) -> DataFrame:
    listed = decision.offer_list(scored(src), assumptions(src))
    return reasons.explain(listed, _SCORER)


_DATED = "CAST(horizon = 'expiry' AS BIGINT)"


@register(
    "add_reasons",
    f"SELECT user_id, rank, reason, horizon, {_DATED} AS expiry_dated FROM {_MARKED}",
    _MARKED,
)
def add_reasons(src: Sources) -> DataFrame:
    return _marked(src).select("user_id", "rank", "reason", "horizon", "expiry_dated")


@register(
    "mark_display",
    f"""SELECT user_id, rank, {r6('relative_to_top', 'relative_to_top')}, CAST(displayed AS BIGINT) AS displayed,
  CASE WHEN NOT displayed THEN 'below_relative_floor(0.05)' END AS suppression_reason FROM {_MARKED}""",
    _MARKED,
)
def mark_display(src: Sources) -> DataFrame:
    return _marked(src).select(
        "user_id", "rank", "relative_to_top", "displayed", "suppression_reason"
    )


@register(
    "relative_to_top",
    f"""SELECT rank, count(*) AS n, {r6('avg(relative_to_top)', 'mean_relative')} FROM {_MARKED} GROUP BY rank""",
    _MARKED,
)
def relative_to_top(src: Sources) -> DataFrame:
    return _marked(src).groupBy("rank").agg(
        F.count(F.lit(1)).alias("n"), F.avg("relative_to_top").alias("mean_relative")
    )


@register(
    "display_impact",
    f"""SELECT candidates, displayed, suppressed, affected_users,
  {r6('affected_users::DOUBLE / users', 'affected_share')}, {r6('middle', 'median_suppressed_share')} FROM (SELECT count(*) AS candidates,
  count(*) FILTER (WHERE displayed) AS displayed, count(*) FILTER (WHERE NOT displayed) AS suppressed,
  count(DISTINCT CASE WHEN NOT displayed THEN user_id END) AS affected_users,
  quantile_cont(CASE WHEN NOT displayed THEN relative_to_top END, 0.5) AS middle,
  count(DISTINCT user_id) AS users FROM {_MARKED}) x""",
    _MARKED,
)
def display_impact(src: Sources) -> DataFrame:
    return reasons.display_impact(stage(_marked(src), "marked"))


@register(
    "expiry_dated_share",
    f"""SELECT count(*) AS sentences, count(*) FILTER (WHERE dated) AS dated_sentences,
  {r6('avg(CAST(dated AS INTEGER))', 'sentence_share')}, count(DISTINCT user_id) AS users,
  count(DISTINCT CASE WHEN dated THEN user_id END) AS dated_users,
  {r6('count(DISTINCT CASE WHEN dated THEN user_id END)::DOUBLE / count(DISTINCT user_id)', 'user_share')},
  {r6('sum(CASE WHEN dated THEN total ELSE 0 END) / sum(total)', 'contribution_share')}
FROM (SELECT *, horizon = 'expiry' AS dated FROM {_MARKED}) x""",
    _MARKED,
)
def expiry_dated_share(src: Sources) -> DataFrame:
    return reasons.expiry_dated_share(_marked(src))


def _cell(k: int) -> str:
    hit = f"FILTER (WHERE m.rank = {k} AND m.displayed)"
    return f"""max(m.reason) {hit} AS reason_{k}, max(m.grp) {hit} AS group_{k},
  round(max(m.total) {hit}, 4) + 0.0 AS group_shap_{k}, max({_DATED}) {hit} AS expiry_dated_{k}"""


@register(
    "wide_reasons",
    f"""SELECT s.user_id, round(any_value(s.p), 6) + 0.0 AS p,
  {r6('any_value(s.p * a.r_save * a.ltv_saved - a.c_offer)', 'expected_net', 4)},
  {', '.join(_cell(k) for k in (1, 2, 3))}
FROM {_S3} s JOIN assumptions a ON s.p > a.p_star LEFT JOIN {_MARKED} m ON m.user_id = s.user_id
GROUP BY s.user_id""",
    _S3,
    _MARKED,
    _A,
)
def wide_reasons(src: Sources) -> DataFrame:
    return _money(offers_with_reasons(scored(src), assumptions(src))[0])


@register(
    "audit_frame",
    f"""SELECT user_id, rank, grp AS "group", {r6('total', 'group_shap')}, {r6('relative_to_top', 'relative_to_top')},
  CAST(displayed AS BIGINT) AS displayed,
  CASE WHEN NOT displayed THEN 'below_relative_floor(0.05)' END AS suppression_reason, feature,
  {r6('shap', 'feature_shap')}, {r6('value', 'value')}, reason, horizon, {_DATED} AS expiry_dated
FROM {_MARKED}""",
    _MARKED,
)
def audit_frame(src: Sources) -> DataFrame:
    return offers_with_reasons(scored(src), assumptions(src))[1]


@register(
    "rank_distribution",
    f"""SELECT n_reasons, count(*) AS n_users, round(count(*)::DOUBLE / sum(count(*)) OVER (), 6) + 0.0 AS share
FROM (SELECT s.user_id, count(m.rank) AS n_reasons FROM {_S3} s LEFT JOIN {_TOP} m ON m.user_id = s.user_id
GROUP BY s.user_id) x GROUP BY n_reasons""",
    _S3,
    _TOP,
)
def rank_distribution(src: Sources) -> DataFrame:
    rows = scored(src)
    top = attribution.top_contributors(rows, _SCORER, groups=reasons.GROUPS)
    return reasons.rank_distribution(top, rows)


@register(
    "top1_groups",
    f"""SELECT grp AS "group", count(*) AS n_users, {r6('avg(total)', 'mean_shap')},
  round(count(*)::DOUBLE / sum(count(*)) OVER (), 6) + 0.0 AS share FROM {_TOP} WHERE rank = 1 GROUP BY grp""",
    _TOP,
)
def top1_groups(src: Sources) -> DataFrame:
    top = attribution.top_contributors(scored(src), _SCORER, groups=reasons.GROUPS)
    return reasons.top1_groups(top)


_PLAIN = ", ".join(f"('{f}', '{reasons.GROUPS[f]}')" for f in _SCORER.features)


@register(
    "grouped_vs_plain_top1",
    f"""SELECT coalesce(g.grp, p.grp) AS "group", coalesce(g.n, 0) AS grouped_users, coalesce(p.n, 0) AS plain_users
FROM (SELECT grp, count(*) AS n FROM {_TOP} WHERE rank = 1 GROUP BY grp) g
FULL JOIN (SELECT grp, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY user_id
    ORDER BY shap DESC, no) AS rn FROM {_ATTR} WHERE shap > 0) x WHERE rn = 1 GROUP BY grp) p
  ON p.grp = g.grp""",
    _TOP,
    _ATTR,
)
def grouped_vs_plain(src: Sources) -> DataFrame:
    return reasons.grouped_vs_plain_top1(scored(src), _SCORER)


# --- batch scoring ---------------------------------------------------------


def _requests(src: Sources) -> DataFrame:
    """Request rows shaped like the batch contract: as-of columns plus log columns."""
    cohort = cohort_table(src, Q3)
    logs = build_log_features(src.logs, cutoff_table(src, Q3), bounds=window_bounds([Q3]))
    base = cohort.select("user_id", *score.REQUEST_FIELDS)
    return base.join(logs.drop("cutoff"), "user_id", "left")


_NAMES = O.feature_columns(Q3)


@register(
    "rows_to_features",
    f"SELECT user_id, {', '.join(r6(c, c) for c in _NAMES)} FROM {_F3}",
    _F3,
)
def rows_to_features(src: Sources) -> DataFrame:
    """The request path must give what the offline path gives, cell by cell."""
    out = score.rows_to_features(stage(_requests(src), "requests"), _NAMES)
    return out.selectExpr("user_id", *[f"cast({c} as double) as {c}" for c in _NAMES])


@register(
    "score_table",
    f"""SELECT s.user_id, {r6('any_value(s.p)', 'p')}, {r6('any_value(a.p_star)', 'p_star')},
  CAST(any_value(s.p > a.p_star) AS BIGINT) AS above_threshold,
  round(any_value(s.p * a.r_save * a.ltv_saved - a.c_offer), 1) + 0.0 AS expected_net,
  count(*) FILTER (WHERE t.total / t.top_total >= 0.05) AS n_reasons,
  count(*) FILTER (WHERE t.total / t.top_total < 0.05) AS n_suppressed
FROM {_S3} s JOIN assumptions a ON true LEFT JOIN {_TOP} t ON t.user_id = s.user_id GROUP BY s.user_id""",
    _S3,
    _TOP,
    _A,
)
def score_table(src: Sources) -> DataFrame:
    out = score.score_table(feature_table(src, Q3), _SCORER, assumptions(src))
    return out.select(
        "user_id",
        "p",
        "p_star",
        "above_threshold",
        "expected_net",
        F.size("reasons").alias("n_reasons"),
        F.size("suppressed").alias("n_suppressed"),
    )


@register(
    "score_warnings",
    f"""SELECT w, count(*) AS n FROM (
  SELECT CASE WHEN l.user_id IS NULL THEN 'no activity supplied: the model sees a user without any'
    WHEN {' OR '.join(f'l.{c} IS NULL' for c in O.log_feature_names())} THEN 'some activity columns were not supplied' END AS w
  FROM {O.cohort_block(Q3)} c LEFT JOIN {O.log_block(Q3)} l ON l.user_id = c.user_id
  UNION ALL SELECT 'registered after the cutoff: member attributes were blanked' FROM {O.cohort_block(Q3)}
  WHERE registration_init_time > cutoff) x WHERE w IS NOT NULL GROUP BY w""",
    O.cohort_block(Q3),
    O.log_block(Q3),
)
def score_warnings(src: Sources) -> DataFrame:
    warned = score.request_warnings(_requests(src))
    return warned.select(F.explode("warnings").alias("w")).groupBy("w").agg(
        F.count(F.lit(1)).alias("n")
    )


@register(
    "lookup_scored_user",
    f"SELECT user_id, {r6('p', 'p')}, segment FROM {_S3} WHERE user_id = (SELECT max(user_id) FROM {_S3})",
    _S3,
)
def lookup(src: Sources) -> DataFrame:
    rows = slim(src)
    wanted = rows.agg(F.max("user_id")).first()[0]
    return score.lookup_scored_user(rows, wanted).select("user_id", "p", "segment")


