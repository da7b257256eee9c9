"""Registered queries: sinks read back, scalar functions, and named views of composed operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from renewlens.functions import dates
from renewlens.functions import scalars as SF
from renewlens.operators import attribution, calibration, cohort, drift, labels, reasons, score
from renewlens.plans import oracle_tables as O
from renewlens.plans import queries_eval as QE
from renewlens.plans.compose import (
    FIXED_SCORER,
    Sources,
    cohort_table,
    cutoff_table,
    feature_table,
    offers_with_reasons,
    scored_table,
)
from renewlens.plans.oracle_tables import day, r6
from renewlens.plans.queries_data import ints
from renewlens.plans.registry import ORACLES, register
from renewlens.session import stage, staging_root
from renewlens.sources import demo, sinks
from renewlens.sources.demo import Q2, Q3, Q3_FIXED

_S3 = O.scored_block(Q3, Q2)
_C2 = O.cutoffs_block(Q2)
_CO = O.cohort_block(Q3)


def _folder(src: Sources, name: str) -> str:
    return f"{staging_root(src.transactions.sparkSession)}/{name}-{uuid.uuid4().hex}"


# --- sinks, read back ------------------------------------------------------


@register("write_submission")
def write_submission(src: Sources) -> DataFrame:
    """Submission as written: every requested user, prior filled in, checks passed."""
    path = _folder(src, "submission")
    scored = stage(scored_table(src, Q3_FIXED).select("user_id", "p"), "scored")
    prior = float(cutoff_table(src, Q2).agg(F.avg("is_churn")).first()[0])
    sinks.write_submission(src.labels(Q3), scored, prior, path, fmt="parquet")
    return src.transactions.sparkSession.read.parquet(path)


ORACLES["write_submission"] = O.query(
    f"SELECT user_id, {r6('q', 'is_churn')} FROM ({QE._FILL}) f",
    O.labels_block(Q3),
    QE._SF,
    _C2,
)


@register("write_offer_list")
def write_offer_list(src: Sources) -> DataFrame:
    path = _folder(src, "offers")
    wide, _ = offers_with_reasons(QE.scored(src), QE.assumptions(src))
    sinks.write_offer_list(wide, path, fmt="parquet")
    return QE._money(src.transactions.sparkSession.read.parquet(path))


ORACLES["write_offer_list"] = ORACLES["wide_reasons"]


@register("write_audit")
def write_audit(src: Sources) -> DataFrame:
    path = _folder(src, "audit")
    _, audit = offers_with_reasons(QE.scored(src), QE.assumptions(src))
    sinks.write_audit(audit, path, fmt="parquet")
    return src.transactions.sparkSession.read.parquet(path)


ORACLES["write_audit"] = ORACLES["audit_frame"]


@register(
    "write_metrics_report",
    f"SELECT 'log_loss' AS metric, {r6(f'avg({O.log_loss()})', 'value')} FROM {_S3}"
    f" UNION ALL SELECT 'brier', {r6('avg((p - is_churn) * (p - is_churn))', 'value')} FROM {_S3}",
    _S3,
)
def write_metrics_report(src: Sources) -> DataFrame:
    from renewlens.operators.metrics import log_loss_report

    spark, path = src.transactions.sparkSession, _folder(src, "metrics")
    report = log_loss_report(scored_table(src, Q3))
    long = report.unpivot([], ["log_loss", "brier"], "metric", "value")
    sinks.write_metrics_report(spark, long, path)
    return spark.read.schema("metric string, value double").json(path)


# --- named views -----------------------------------------------------------


@register(
    "cohort_expiry_day",
    f"SELECT user_id, {ints('is_churn', 'cutoff')} FROM {_C2}",
    _C2,
)
def cohort_expiry_day(src: Sources) -> DataFrame:
    return cutoff_table(src, Q2)


@register(
    "cutoff_window",
    f"""SELECT 'q3_t7' AS spec, min(cutoff)::BIGINT AS lo, max(cutoff)::BIGINT AS hi,
  CAST(min(cutoff) >= 20000624 AND max(cutoff) <= 20000923 AS BIGINT) AS inside
FROM {O.cutoffs_block(demo.Q3_T7)}""",
    O.cutoffs_block(demo.Q3_T7),
)
def cutoff_window(src: Sources) -> DataFrame:
    lo, hi = cohort.cutoff_window(demo.Q3_T7)
    spec = demo.Q3_T7
    return cutoff_table(src, spec).agg(
        F.lit(spec.name).alias("spec"),
        F.min("cutoff").alias("lo"),
        F.max("cutoff").alias("hi"),
        ((F.min("cutoff") >= lo) & (F.max("cutoff") <= hi)).alias("inside"),
    )


@register(
    "first_renewal",
    """SELECT user_id, CAST(min(transaction_date) AS BIGINT) AS renewal_date FROM tx
WHERE is_cancel = 0 AND transaction_date > 20000331 GROUP BY user_id""",
    "tx",
)
def first_renewal(src: Sources) -> DataFrame:
    text = demo.as_text(src.transactions).filter(F.col("transaction_date") > "20000331")
    found = labels.first_renewal(labels.official_keys(text))
    return found.select("user_id", F.col("renewal.day").alias("renewal_date"))


@register(
    "official_sort",
    """SELECT user_id, CAST(transaction_date AS BIGINT) AS transaction_date, CAST(n AS BIGINT) AS first_index FROM (
  SELECT user_id, transaction_date, min(idx) AS n FROM (SELECT *, row_number() OVER (PARTITION BY user_id
    ORDER BY transaction_date, sig DESC, is_cancel, signed_expire) - 1 AS idx FROM txs) t
  GROUP BY user_id, transaction_date) x""",
    "txs",
)
def official_sort(src: Sources) -> DataFrame:
    order = labels.row_index_per_user(demo.as_text(src.transactions))
    return order.groupBy("user_id", "transaction_date").agg(
        F.min("first_index").alias("first_index")
    )


@register(
    "sort_by_user",
    f"SELECT user_id, {ints('is_churn', 'cutoff')} FROM {_C2} ORDER BY user_id",
    _C2,
)
def sort_by_user(src: Sources) -> DataFrame:
    return cohort.sort_by_user(cutoff_table(src, Q2))


@register(
    "topk_per_user",
    f"""SELECT user_id, CAST(rank AS BIGINT) AS rank, grp AS "group", {r6('total', 'group_shap')} FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY total DESC, grp_no) AS rank
  FROM {QE._GT} WHERE total > 0.05) x WHERE rank <= 5""",
    QE._GT,
)
def topk_per_user(src: Sources) -> DataFrame:
    top = attribution.top_contributors(
        scored_table(src, Q3), FIXED_SCORER, groups=reasons.GROUPS, k=5, min_shap=0.05
    )
    return top.select("user_id", "rank", "group", "group_shap")


@register(
    "reason_top_join",
    f"SELECT user_id, CAST(rank AS BIGINT) AS rank, {r6('top_total', 'top_shap')} FROM {QE._TOP}",
    QE._TOP,
)
def reason_top_join(src: Sources) -> DataFrame:
    top = attribution.top_contributors(
        scored_table(src, Q3), FIXED_SCORER, groups=reasons.GROUPS
    )
    return top.select("user_id", "rank", "top_shap")


@register(
    "psi",
    f"SELECT kind, count(*) AS n_features, {r6('max(psi)', 'max_psi')}, {r6('sum(psi)', 'sum_psi')}"
    f" FROM {QE._P} GROUP BY kind",
    QE._P,
)
def psi(src: Sources) -> DataFrame:
    return drift.psi(drift.psi_detail(QE._binned(src))).groupBy("kind").agg(
        F.count(F.lit(1)).alias("n_features"),
        F.max("psi").alias("max_psi"),
        F.sum("psi").alias("sum_psi"),
    )


@register(
    "expected_months",
    f"SELECT {r6('1.0::DOUBLE / avg(is_churn)', 'months')} FROM {_C2}",
    _C2,
)
def months(src: Sources) -> DataFrame:
    return cutoff_table(src, Q2).agg((1.0 / F.avg("is_churn")).alias("months"))


@register(
    "knots",
    f"""SELECT {r6('least(greatest(v, lo), hi)', 'calibrated')}, {r6('x', 'raw')}, {r6('lo', 'floor')}, {r6('hi', 'ceiling')},
  (SELECT count(DISTINCT round(least(greatest(v, lo), hi), 9)) FROM iso_blocks, iso_bounds) AS n_levels
FROM (SELECT v, x0 AS x FROM iso_blocks UNION SELECT v, x1 FROM iso_blocks) k, iso_bounds""",
    "iso_blocks",
    "iso_bounds",
)
def knots(src: Sources) -> DataFrame:
    """Bounds, levels and turning points of the calibrator fitted on q2."""
    base = stage(scored_table(src, Q2).select("user_id", "is_churn", "p"), "cal")
    cal = calibration.fit_isotonic(base)
    turning = stage(cal.knots(base).withColumn("calibrated", F.round("calibrated", 9)), "knots")
    blocks = turning.groupBy("calibrated").agg(F.min("raw").alias("a"), F.max("raw").alias("b"))
    return blocks.select(
        "calibrated",
        F.explode(F.array_distinct(F.array("a", "b"))).alias("raw"),
        F.lit(cal.floor).alias("floor"),
        F.lit(cal.ceiling).alias("ceiling"),
        turning.agg(F.count_distinct("calibrated")).scalar().alias("n_levels"),
    )


@register(
    "score_batch_totals",
    f"""SELECT CAST(p > a.p_star AS BIGINT) AS above_threshold, count(*) AS n,
  round(sum(round(p * a.r_save * a.ltv_saved - a.c_offer, 1)), 1) + 0.0 AS expected_net
FROM {_S3}, assumptions a GROUP BY 1""",
    _S3,
    O.assumptions_block(Q3, Q2),
)
def score_batch_totals(src: Sources) -> DataFrame:
    features = stage(feature_table(src, Q3), "features")
    out = score.score_table(features, FIXED_SCORER, QE.assumptions(src))
    tenths = F.sum(F.round(F.col("expected_net") * 10).cast("bigint")) / 10.0
    return out.groupBy("above_threshold").agg(
        F.count(F.lit(1)).alias("n"), F.round(tenths, 1).alias("expected_net")
    )


# --- scalar functions ------------------------------------------------------

_Z = "(0.3::DOUBLE * n_tx - 3)"


@register(
    "scalar_functions",
    f"""SELECT user_id,
  {day('cutoff')} - {day('last_tx')} AS days,
  CAST(strftime({day('cutoff')} - 7, '%Y%m%d') AS BIGINT) AS shifted,
  CAST(coalesce(last_is_cancel, 0) + coalesce(last_is_auto_renew, 0) AS BIGINT) AS sum_across,
  CAST(least(last_actual_amount_paid, last_plan_list_price) AS BIGINT) AS min_across,
  CAST(coalesce(last_is_cancel = 1, false) OR coalesce(bd < 0, false) AS BIGINT) AS any_across,
  round(CASE WHEN last_is_cancel IS NULL AND bd IS NULL THEN NULL ELSE
    (coalesce(last_is_cancel, 0) + coalesce(bd, 0))::DOUBLE
    / (CAST(last_is_cancel IS NOT NULL AS INTEGER) + CAST(bd IS NOT NULL AS INTEGER)) END, 6) + 0.0 AS mean_across,
  {r6(f"CASE WHEN {_Z} >= 0 THEN 1.0 / (1.0 + exp(-abs({_Z}))) ELSE exp(-abs({_Z})) / (1.0 + exp(-abs({_Z}))) END", 'sigmoid')},
  {r6('CASE WHEN bd IS NOT NULL THEN least(greatest(bd::DOUBLE, 10.0), 100.0) END', 'clipped')},
  {r6('round_even(n_tx / 2.0::DOUBLE, 0)', 'half_even')},
  {r6('ln(n_tx::DOUBLE)', 'ln')},
  CASE WHEN last_plan_list_price > 0 THEN round(last_actual_amount_paid::DOUBLE / last_plan_list_price, 6) + 0.0 END AS ratio,
  CAST(len(list_filter([2, 6, 12, 24], lambda e: e <= n_tx)) AS BIGINT) AS digitized,
  md5(concat_ws(':', '42', CAST(user_id AS VARCHAR))) AS seeded_hash,
  concat(CAST(n_tx AS VARCHAR), '-', CAST(n_cancel_hist AS VARCHAR)) AS joined
FROM {_CO}""",
    _CO,
)
def scalar_functions(src: Sources) -> DataFrame:
    """Every scalar building block on one real table."""
    n = F.col("n_tx")
    edges = F.array(*[F.lit(e) for e in (2, 6, 12, 24)])
    return cohort_table(src, Q3).select(
        "user_id",
        F.expr(dates.days_between_sql("cutoff", "last_tx")).alias("days"),
        F.expr(dates.shift_ymd_sql("cutoff", -7)).alias("shifted"),
        SF.sum_across(["last_is_cancel", "last_is_auto_renew"]).alias("sum_across"),
        F.least("last_actual_amount_paid", "last_plan_list_price").alias("min_across"),
        SF.any_across([F.col("last_is_cancel") == 1, F.col("bd") < 0]).alias("any_across"),
        SF.mean_across(["last_is_cancel", "bd"]).alias("mean_across"),
        SF.sigmoid(F.lit(0.3) * n - 3).alias("sigmoid"),
        SF.clip(F.col("bd").cast("double"), 10.0, 100.0).alias("clipped"),
        F.rint(n / F.lit(2.0)).alias("half_even"),
        F.ln(n.cast("double")).alias("ln"),
        SF.ratio("last_actual_amount_paid", "last_plan_list_price").alias("ratio"),
        SF.bins_below(edges, n).alias("digitized"),
        SF.seeded_hash(42, "user_id").alias("seeded_hash"),
        F.concat_ws("-", "n_tx", "n_cancel_hist").alias("joined"),
    )
