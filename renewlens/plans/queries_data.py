"""Registered queries: sources, cohorts, labels, logs, features, reports."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from renewlens.operators import cohort as C
from renewlens.operators import contracts, eda, features, labels, logs
from renewlens.operators.decision import monthly_arpu
from renewlens.operators.guards import match_logs_cohort
from renewlens.operators.split import dropped_profile, dropped_users
from renewlens.plans import oracle_tables as O
from renewlens.plans.compose import (
    Sources,
    cohort_table,
    cutoff_table,
    feature_table,
    log_table,
    stored_feature_table,
)
from renewlens.plans.oracle_tables import day, r6
from renewlens.plans.registry import register
from renewlens.session import staging_root
from renewlens.sources import demo
from renewlens.sources.demo import Q2, Q2_FIXED, Q2_T7, Q3, Q3_FIXED, Q3_T7
from renewlens.sources.schemas import COHORT_COLUMNS, LAST_COLUMNS, MEMBER_COLUMNS
from renewlens.sources.store import FeatureTableStore

TX_INTS = (
    "payment_method_id payment_plan_days plan_list_price actual_amount_paid is_auto_renew "
    "transaction_date membership_expire_date is_cancel"
).split()
LOG_INTS = "date num_25 num_50 num_75 num_985 num_100 num_unq".split()


def ints(*names: str) -> str:
    return ", ".join(f"CAST({n} AS BIGINT) AS {n}" for n in names)


def _cohort_columns(spec: C.CohortSpec, members: bool = True) -> str:
    extra = ["expire_date"] if spec.fixed_score_date else []
    whole = [
        "is_churn",
        "cutoff",
        *extra,
        "n_tx",
        "first_tx",
        "last_tx",
        "n_cancel_hist",
        *[f"last_{c}" for c in LAST_COLUMNS],
        "last_day_n_tx",
    ]
    sql = (
        f"user_id, {ints(*whole)}, {r6('mean_paid', 'mean_paid')}, "
        "CAST(CAST(last_day_has_conflict AS INTEGER) AS BIGINT) AS last_day_has_conflict"
    )
    if members:
        sql += (
            f", {ints('city', 'bd', 'registered_via', 'registration_init_time')}, gender, "
            "CAST(CAST(in_members AS INTEGER) AS BIGINT) AS in_members"
        )
    return sql


def _feature_columns(names: list[str]) -> str:
    whole = O.INT_FEATURES | {"log_min_days_before", "log_max_days_before"}
    whole |= {n for n in names if n.endswith(("_active_days", "_plays", "_completed", "_unq"))}
    return ", ".join(f"CAST({n} AS BIGINT) AS {n}" if n in whole else r6(n, n) for n in names)


def _tx(src: Sources) -> DataFrame:
    return src.transactions


# --- sources ---------------------------------------------------------------


@register("scan_transactions", f"SELECT user_id, {ints(*TX_INTS)} FROM tx", "tx")
def scan_transactions(src: Sources) -> DataFrame:
    return src.transactions


_TEXT = demo.TEXT_COLUMNS


@register(
    "scan_transactions_str",
    f"SELECT user_id, {', '.join(f'CAST({c} AS VARCHAR) AS {c}' for c in _TEXT)} FROM tx",
    "tx",
)
def scan_transactions_str(src: Sources) -> DataFrame:
    return demo.as_text(src.transactions)


@register(
    "read_members",
    f"SELECT user_id, {ints('city', 'bd', 'registered_via', 'registration_init_time')}, gender"
    " FROM members",
    "members",
)
def read_members(src: Sources) -> DataFrame:
    return src.members


@register(
    "scan_logs", f"SELECT user_id, {ints(*LOG_INTS)}, {r6('total_secs', 'total_secs')} FROM logs", "logs"
)
def scan_logs(src: Sources) -> DataFrame:
    return src.logs


@register(
    "read_labels",
    f"SELECT user_id, {ints('is_churn')} FROM {O.labels_block(Q2)}",
    O.labels_block(Q2),
)
def read_labels(src: Sources) -> DataFrame:
    return src.labels(Q2)


_LO, _HI = O.log_bounds(Q2, Q3)


@register(
    "narrow_logs",
    f"""SELECT user_id, {ints(*LOG_INTS)}, {r6('total_secs', 'total_secs')} FROM logs
WHERE date BETWEEN {_LO} AND {_HI} AND user_id IN (SELECT user_id FROM {O.labels_block(Q2)}
  UNION SELECT user_id FROM {O.labels_block(Q3)})""",
    "logs",
    O.labels_block(Q2),
    O.labels_block(Q3),
)
def narrow_logs(src: Sources) -> DataFrame:
    users = logs.wanted_users(src.labels(Q2), src.labels(Q3))
    return logs.narrow_logs(src.logs, users, *logs.window_bounds([Q2, Q3]))


@register(
    "wanted_users",
    f"SELECT user_id FROM {O.labels_block(Q2)} UNION SELECT user_id FROM {O.labels_block(Q3)}",
    O.labels_block(Q2),
    O.labels_block(Q3),
)
def wanted_users(src: Sources) -> DataFrame:
    return logs.wanted_users(src.labels(Q2), src.labels(Q3))


@register("observed_data_end", f"SELECT CAST(max(transaction_date) AS BIGINT) AS data_end FROM tx", "tx")
def observed_data_end(src: Sources) -> DataFrame:
    return C.observed_data_end(src.transactions)


# --- filters ---------------------------------------------------------------


@register(
    "expire_in_window",
    f"SELECT user_id, {ints(*TX_INTS)} FROM tx WHERE membership_expire_date"
    f" BETWEEN {Q3.expire_start} AND {Q3.expire_end}",
    "tx",
)
def expire_in_window(src: Sources) -> DataFrame:
    return C.expire_in_window(_tx(src), Q3)


@register(
    "observable_at_expiry",
    f"SELECT user_id, {ints(*TX_INTS)} FROM tx WHERE transaction_date <= membership_expire_date",
    "tx",
)
def observable_at_expiry(src: Sources) -> DataFrame:
    return C.observable_at_expiry(_tx(src))


@register(
    "observable_at_score_date",
    f"SELECT user_id, {ints(*TX_INTS)} FROM tx WHERE transaction_date <= {Q3_FIXED.score_date}",
    "tx",
)
def observable_at_score_date(src: Sources) -> DataFrame:
    return C.observable_at_score_date(_tx(src), Q3_FIXED.score_date)


@register(
    "null_sentinels",
    """SELECT user_id, CAST(transaction_date AS BIGINT) AS transaction_date,
  CASE WHEN membership_expire_date NOT IN (19700101, 20361015)
    THEN CAST(membership_expire_date AS BIGINT) END AS membership_expire_date FROM tx""",
    "tx",
)
def null_sentinels(src: Sources) -> DataFrame:
    return C.null_sentinels(
        _tx(src).select("user_id", "transaction_date", "membership_expire_date")
    )


_ASOF_DAYS = f"""SELECT t.user_id, CAST(t.transaction_date AS BIGINT) AS transaction_date,
  CAST(c.cutoff AS BIGINT) AS cutoff, count(*) AS day_n,
  CAST(sum(t.actual_amount_paid) AS BIGINT) AS day_paid
FROM tx t JOIN {O.cutoffs_block(Q3)} c ON c.user_id = t.user_id
WHERE t.transaction_date <= c.cutoff GROUP BY ALL"""


def _asof_days(src: Sources) -> DataFrame:
    days = C.daily_transactions(_tx(src), upto=C.cutoff_window(Q3)[1])
    joined = days.join(cutoff_table(src, Q3).drop("is_churn"), "user_id", "inner")
    return C.asof_truncate(joined).select(
        "user_id", "transaction_date", "cutoff", "day_n", "day_paid"
    )


@register("asof_truncate", _ASOF_DAYS, "tx", O.cutoffs_block(Q3))
def asof_truncate(src: Sources) -> DataFrame:
    return _asof_days(src)


@register(
    "join_tx_cohort",
    f"""SELECT t.user_id, count(*) AS n_rows, CAST(sum(t.actual_amount_paid) AS BIGINT) AS paid
FROM tx t JOIN {O.cutoffs_block(Q3)} c ON c.user_id = t.user_id GROUP BY t.user_id""",
    "tx",
    O.cutoffs_block(Q3),
)
def join_tx_cohort(src: Sources) -> DataFrame:
    joined = C.daily_transactions(_tx(src)).join(cutoff_table(src, Q3), "user_id", "inner")
    return joined.groupBy("user_id").agg(
        F.sum("day_n").alias("n_rows"), F.sum("day_paid").alias("paid")
    )


_LOG_ROWS = O.log_rows_block(Q3)
_LOG_ROWS_SQL = f"SELECT user_id, {ints('date', 'cutoff', 'days_before', 'plays', 'millis')} FROM {_LOG_ROWS}"


def _log_rows(src: Sources) -> DataFrame:
    rows = logs.join_logs_cutoff(src.logs, cutoff_table(src, Q3))
    return rows.select("user_id", "date", "cutoff", "days_before", "plays", "millis")


@register("asof_truncate_logs", _LOG_ROWS_SQL, _LOG_ROWS)
def asof_truncate_logs(src: Sources) -> DataFrame:
    return _log_rows(src)


@register(
    "join_logs_cutoff",
    f"SELECT user_id, count(*) AS n_days, CAST(sum(plays) AS BIGINT) AS plays FROM {_LOG_ROWS} GROUP BY user_id",
    _LOG_ROWS,
)
def join_logs_cutoff(src: Sources) -> DataFrame:
    return _log_rows(src).groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n_days"), F.sum("plays").alias("plays")
    )


@register(
    "semi_join_users",
    f"""SELECT user_id, count(*) AS n_days FROM logs
WHERE user_id IN (SELECT user_id FROM {O.labels_block(Q3)}) GROUP BY user_id""",
    "logs",
    O.labels_block(Q3),
)
def semi_join_users(src: Sources) -> DataFrame:
    kept = logs.semi_join_users(src.logs, src.labels(Q3))
    return kept.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_days"))


# --- cohorts ---------------------------------------------------------------


@register(
    "cutoff_by_expiry",
    f"SELECT user_id, {ints('cutoff')} FROM {O.expiry_block(Q3)}",
    O.expiry_block(Q3),
)
def cutoff_by_expiry(src: Sources) -> DataFrame:
    return C.cutoff_by_expiry(_tx(src), Q3)


@register(
    "join_labels_cutoffs",
    f"SELECT user_id, {ints('is_churn', 'cutoff')} FROM {O.cutoffs_block(Q3)}",
    O.cutoffs_block(Q3),
)
def join_labels_cutoffs(src: Sources) -> DataFrame:
    return cutoff_table(src, Q3)


@register(
    "declared_expiry_asof",
    f"SELECT user_id, {ints('expire_date')} FROM {O.declared_block(Q3_FIXED)}",
    O.declared_block(Q3_FIXED),
)
def declared_expiry_asof(src: Sources) -> DataFrame:
    return C.declared_expiry_asof(_tx(src), Q3_FIXED.score_date)


@register(
    "join_expiry",
    f"""SELECT l.user_id, CAST(d.expire_date AS BIGINT) AS expire_date
FROM {O.labels_block(Q3)} l LEFT JOIN {O.declared_block(Q3_FIXED)} d ON d.user_id = l.user_id""",
    O.labels_block(Q3),
    O.declared_block(Q3_FIXED),
)
def join_expiry(src: Sources) -> DataFrame:
    expiry = C.declared_expiry_asof(_tx(src), Q3_FIXED.score_date)
    return src.labels(Q3).select("user_id").join(expiry, "user_id", "left")


@register(
    "keep_null_or_in_window",
    f"SELECT user_id, {ints('cutoff', 'expire_date')} FROM {O.cutoffs_block(Q3_FIXED)}",
    O.cutoffs_block(Q3_FIXED),
)
def keep_null_or_in_window(src: Sources) -> DataFrame:
    return C.cohort_fixed_score_date(src.labels(Q3_FIXED), _tx(src), Q3_FIXED)


for _name, _spec in (
    ("aggregate_asof", Q3),
    ("cohort_lead_time", Q3_T7),
    ("cohort_fixed_score_date", Q3_FIXED),
):

    def _aggregate(src: Sources, spec: C.CohortSpec) -> DataFrame:
        carry = ("expire_date",) if spec.fixed_score_date else ()
        return C.aggregate_asof(
            _tx(src), cutoff_table(src, spec), carry=carry, upto=C.cutoff_window(spec)[1]
        )

    register(
        _name,
        f"SELECT {_cohort_columns(_spec, members=False)} FROM {O.asof_block(_spec)}",
        O.asof_block(_spec),
    )(partial(_aggregate, spec=_spec))

for _name, _spec in (
    ("join_members", Q3),
    ("build_cohort", Q2),
    ("build_cohort_t7", Q2_T7),
    ("build_cohort_fixed", Q2_FIXED),
):
    register(
        _name,
        f"SELECT {_cohort_columns(_spec)} FROM {O.cohort_block(_spec)}",
        O.cohort_block(_spec),
    )(partial(cohort_table, spec=_spec))


@register(
    "last_unambiguous",
    """SELECT user_id,
  CASE WHEN count(DISTINCT is_cancel) = 1 THEN CAST(max(is_cancel) AS BIGINT) END AS is_cancel,
  CASE WHEN count(DISTINCT payment_method_id) = 1 THEN CAST(max(payment_method_id) AS BIGINT) END AS payment_method_id
FROM (SELECT *, max(transaction_date) OVER (PARTITION BY user_id) AS last_day FROM tx) t
WHERE transaction_date = last_day GROUP BY user_id""",
    "tx",
)
def last_unambiguous(src: Sources) -> DataFrame:
    return C.last_unambiguous(_tx(src), ["is_cancel", "payment_method_id"])


@register(
    "last_day_conflict_flag",
    f"""SELECT user_id, {ints('last_day_n_tx')},
  CAST(CAST(last_day_has_conflict AS INTEGER) AS BIGINT) AS last_day_has_conflict
FROM {O.asof_block(Q2)} WHERE last_day_n_tx > 1""",
    O.asof_block(Q2),
)
def last_day_conflict_flag(src: Sources) -> DataFrame:
    asof = C.aggregate_asof(_tx(src), cutoff_table(src, Q2), upto=C.cutoff_window(Q2)[1])
    return asof.filter("last_day_n_tx > 1").select(
        "user_id", "last_day_n_tx", "last_day_has_conflict"
    )


@register(
    "last_day_mask",
    f"""SELECT user_id, {ints('transaction_date', 'is_cancel', 'plan_list_price')} FROM
  (SELECT *, max(transaction_date) OVER (PARTITION BY user_id) AS last_day FROM tx) t
WHERE transaction_date = last_day""",
    "tx",
)
def last_day_mask(src: Sources) -> DataFrame:
    return C.last_day_mask(_tx(src)).select(
        "user_id", "transaction_date", "is_cancel", "plan_list_price"
    )


@register(
    "cohort_overlap",
    f"""SELECT n_shared, n_users, round(CAST(n_shared AS DOUBLE) / n_users, 6) + 0.0 AS shared_share
FROM (SELECT count(*) AS n_users, count(a.user_id) AS n_shared
  FROM {O.labels_block(Q3)} b LEFT JOIN {O.labels_block(Q2)} a ON a.user_id = b.user_id) x""",
    O.labels_block(Q3),
    O.labels_block(Q2),
)
def cohort_overlap(src: Sources) -> DataFrame:
    return C.cohort_overlap(src.labels(Q2), src.labels(Q3))


@register(
    "distinct_users",
    f"SELECT user_id FROM {O.labels_block(Q2)} INTERSECT SELECT user_id FROM {O.labels_block(Q3)}",
    O.labels_block(Q2),
    O.labels_block(Q3),
)
def distinct_users(src: Sources) -> DataFrame:
    return C.common_users(src.labels(Q2), src.labels(Q3))


@register(
    "match_logs_cohort",
    f"""SELECT a.user_id, CAST(a.cutoff AS BIGINT) AS cutoff, CAST(l.cutoff AS BIGINT) AS log_cutoff
FROM {O.asof_block(Q3)} a JOIN {O.log_block(Q3_T7)} l ON l.user_id = a.user_id
WHERE a.cutoff <> l.cutoff""",
    O.asof_block(Q3),
    O.log_block(Q3_T7),
)
def match_logs(src: Sources) -> DataFrame:
    """The T-7 log table against the T=0 cohort: every shared user must be reported."""
    asof = C.aggregate_asof(_tx(src), cutoff_table(src, Q3), upto=C.cutoff_window(Q3)[1])
    return match_logs_cohort(asof, log_table(src, Q3_T7))


@register(
    "dropped_users",
    f"""SELECT user_id, {ints('is_churn')} FROM {O.asof_block(Q3)}
WHERE user_id NOT IN (SELECT user_id FROM {O.asof_block(Q3_FIXED)})""",
    O.asof_block(Q3),
    O.asof_block(Q3_FIXED),
)
def dropped(src: Sources) -> DataFrame:
    base, lead = cohort_table(src, Q3), cohort_table(src, Q3_FIXED)
    return dropped_users(base, lead).select("user_id", "is_churn")


@register(
    "dropped_profile",
    f"""SELECT count(*) FILTER (WHERE gone) AS n_dropped,
  {r6('avg(CAST(gone AS INTEGER))', 'share')},
  {r6('avg(CASE WHEN gone THEN is_churn END)', 'dropped_rate')},
  {r6('avg(is_churn)', 'overall_rate')}
FROM (SELECT is_churn, user_id NOT IN (SELECT user_id FROM {O.asof_block(Q3_FIXED)}) AS gone
  FROM {O.asof_block(Q3)}) x""",
    O.asof_block(Q3),
    O.asof_block(Q3_FIXED),
)
def dropped_summary(src: Sources) -> DataFrame:
    return dropped_profile(cohort_table(src, Q3), cohort_table(src, Q3_FIXED))


# --- labeller --------------------------------------------------------------

_LABEL_SPEC = labels.LabelSpec("q2", 20000101, 20000331, 20000401, 20000630)
_SIG = "concat(CAST(plan_list_price AS VARCHAR), CAST(payment_plan_days AS VARCHAR), CAST(payment_method_id AS VARCHAR))"
_SIGNED = "CASE WHEN is_cancel = 1 THEN -membership_expire_date ELSE membership_expire_date END"
_ORDER = "transaction_date, sig DESC, is_cancel, signed_expire"
O.block("txs", f"SELECT *, {_SIG} AS sig, {_SIGNED} AS signed_expire FROM tx", "tx")
O.block(
    "last_expire",
    f"""SELECT user_id, membership_expire_date AS last_expire FROM
  (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY transaction_date DESC, sig ASC,
     is_cancel DESC, signed_expire DESC) AS rn FROM txs
   WHERE transaction_date BETWEEN {_LABEL_SPEC.history_start} AND {_LABEL_SPEC.history_end}) t
WHERE rn = 1""",
    "txs",
)
O.block(
    "candidates",
    f"SELECT * FROM last_expire WHERE last_expire BETWEEN {_LABEL_SPEC.expire_start} AND {_LABEL_SPEC.expire_end}",
    "last_expire",
)
O.block(
    "future",
    f"""SELECT t.*, row_number() OVER (PARTITION BY t.user_id ORDER BY {_ORDER}) - 1 AS idx
FROM txs t JOIN candidates c ON c.user_id = t.user_id
WHERE t.transaction_date > {_LABEL_SPEC.history_end}""",
    "txs",
    "candidates",
)
O.block(
    "first_renewal",
    """SELECT user_id, min(idx) AS idx, min(transaction_date) AS day FROM future
WHERE is_cancel = 0 GROUP BY user_id""",
    "future",
)
O.block(
    "early_cancel",
    """SELECT f.user_id, min(f.membership_expire_date) AS cancel_expire
FROM future f JOIN first_renewal r ON r.user_id = f.user_id
WHERE f.is_cancel = 1 AND f.idx < r.idx GROUP BY f.user_id""",
    "future",
    "first_renewal",
)
O.block(
    "gaps",
    f"""SELECT c.user_id, c.last_expire, CASE WHEN r.day IS NULL THEN 9999 ELSE
  date_diff('day', {day('least(c.last_expire, coalesce(e.cancel_expire, c.last_expire))')}, {day('r.day')})
  END AS gap
FROM candidates c LEFT JOIN first_renewal r ON r.user_id = c.user_id
LEFT JOIN early_cancel e ON e.user_id = c.user_id""",
    "candidates",
    "first_renewal",
    "early_cancel",
)


def _text(src: Sources) -> DataFrame:
    return scan_transactions_str(src)


@register(
    "row_index_per_user",
    """SELECT user_id, CAST(transaction_date AS BIGINT) AS transaction_date,
  CAST(is_cancel AS BIGINT) AS is_cancel, count(*) AS n_rows, CAST(min(idx) AS BIGINT) AS first_index
FROM (SELECT *, row_number() OVER (PARTITION BY user_id
    ORDER BY transaction_date, sig DESC, is_cancel, signed_expire) - 1 AS idx FROM txs) t
GROUP BY user_id, transaction_date, sig, is_cancel""",
    "txs",
)
def row_index(src: Sources) -> DataFrame:
    return labels.row_index_per_user(_text(src))


@register("last_expire", f"SELECT user_id, {ints('last_expire')} FROM last_expire", "last_expire")
def last_expire(src: Sources) -> DataFrame:
    return labels.last_expire(_text(src), _LABEL_SPEC)


@register(
    "renewal_candidates",
    "SELECT user_id, CAST(day AS BIGINT) AS renewal_date FROM first_renewal",
    "first_renewal",
)
def renewal_candidates(src: Sources) -> DataFrame:
    text = _text(src)
    keys = labels.official_keys(
        text.filter(F.col("transaction_date") > str(_LABEL_SPEC.history_end))
    )
    candidates = labels.label_candidates(text, _LABEL_SPEC)
    return (
        labels.first_renewal(keys)
        .join(candidates, "user_id", "left_semi")
        .select("user_id", F.col("renewal.day").alias("renewal_date"))
    )


@register(
    "earliest_cancel_before_renewal",
    f"SELECT user_id, {ints('cancel_expire')} FROM early_cancel",
    "early_cancel",
)
def earliest_cancel(src: Sources) -> DataFrame:
    text = _text(src)
    keys = labels.official_keys(
        text.filter(F.col("transaction_date") > str(_LABEL_SPEC.history_end))
    )
    candidates = labels.label_candidates(text, _LABEL_SPEC)
    found = labels.earliest_cancel_before_renewal(keys, labels.first_renewal(keys))
    return found.join(candidates, "user_id", "left_semi")


@register("renewal_gap", f"SELECT user_id, {ints('last_expire', 'gap')} FROM gaps", "gaps")
def renewal_gap(src: Sources) -> DataFrame:
    text = _text(src)
    return labels.renewal_gap(text, labels.label_candidates(text, _LABEL_SPEC), _LABEL_SPEC)


@register(
    "build_labels",
    f"""SELECT user_id, CAST(gap >= {demo.CHURN_GAP_DAYS} AS BIGINT) AS is_churn,
  {ints('gap', 'last_expire')} FROM gaps""",
    "gaps",
)
def build_labels(src: Sources) -> DataFrame:
    return labels.build_labels(_text(src), _LABEL_SPEC, churn_gap_days=demo.CHURN_GAP_DAYS)


# --- log features ----------------------------------------------------------

_LOGF = O.log_block(Q3)
_LOG_NAMES = O.log_feature_names()


def _log_query(name: str, columns: list[str]) -> None:
    def run(src: Sources) -> DataFrame:
        return log_table(src, Q3).select("user_id", *columns)

    register(name, f"SELECT user_id, {_feature_columns(columns)} FROM {_LOGF}", _LOGF)(run)


_log_query(
    "window_aggs",
    [c for c in _LOG_NAMES if c.endswith(("_active_days", "_secs", "_plays", "_completed", "_unq"))],
)
_log_query("log_span", ["log_min_days_before", "log_max_days_before"])
_log_query(
    "window_ratios",
    [c for c in _LOG_NAMES if c.endswith(("_completion", "_active_ratio", "_per_active_day"))],
)
_log_query("log_trends", [c for c in _LOG_NAMES if c.startswith("log_trend")])
_log_query("build_log_features", _LOG_NAMES)


# --- features --------------------------------------------------------------


def _feature_query(name: str, spec: C.CohortSpec, with_logs: bool = True) -> None:
    block = O.features_block(spec) if with_logs else O.tx_features_block(spec)
    columns = O.feature_columns(spec)
    if not with_logs:
        columns = [c for c in columns if not c.startswith("log")]

    def run(src: Sources) -> DataFrame:
        return feature_table(src, spec, with_logs=with_logs)

    register(
        name,
        f"SELECT user_id, {ints('is_churn')}, {_feature_columns(columns)} FROM {block}",
        block,
    )(run)


_feature_query("build_features", Q3)
_feature_query("build_features_t7", Q3_T7)
_feature_query("build_features_fixed", Q3_FIXED)
_feature_query("transaction_features", Q2, with_logs=False)


@register(
    "attach_logs",
    f"""SELECT user_id, {_feature_columns(['log_has_logs', 'log30_secs', 'log_trend_30_90'])}
FROM {O.features_block(Q2)}""",
    O.features_block(Q2),
)
def attach_logs(src: Sources) -> DataFrame:
    return feature_table(src, Q2).select("user_id", "log_has_logs", "log30_secs", "log_trend_30_90")


@register(
    "select_features",
    f"SELECT user_id, {ints('is_churn')}, {_feature_columns(['cancel_rate', 'city'])}"
    f" FROM {O.tx_features_block(Q3)}",
    O.tx_features_block(Q3),
)
def select_features(src: Sources) -> DataFrame:
    return features.select_features(
        feature_table(src, Q3, with_logs=False), ["cancel_rate", "city"]
    )


@register(
    "variant_columns",
    f"""SELECT user_id, {ints('is_churn')}, {_feature_columns([*O.TX_FEATURES, 'log_min_days_before', 'log_max_days_before'])}
FROM {O.features_block(Q3)}""",
    O.features_block(Q3),
)
def variant_columns(src: Sources) -> DataFrame:
    table = feature_table(src, Q3)
    sets = features.variant_columns([c for c in table.columns if c not in ("user_id", "is_churn")])
    return features.select_features(table, sets["txn_recency"])


@register(
    "mask_future_member",
    f"""SELECT user_id, {', '.join(f'CASE WHEN NOT hidden THEN {c} END AS {c}' if c == 'gender' else f'CASE WHEN NOT hidden THEN CAST({c} AS BIGINT) END AS {c}' for c in MEMBER_COLUMNS)},
  CAST(NOT hidden AND in_members AS BIGINT) AS in_members
FROM (SELECT *, coalesce(registration_init_time > cutoff, false) AS hidden FROM {O.cohort_block(Q2)}) h""",
    O.cohort_block(Q2),
)
def mask_future_member(src: Sources) -> DataFrame:
    return features.mask_future_member(cohort_table(src, Q2)).select(
        "user_id", *MEMBER_COLUMNS, "in_members"
    )


@register(
    "feature_table_store",
    f"SELECT user_id, {ints('is_churn')}, {_feature_columns(O.feature_columns(Q2))}"
    f" FROM {O.features_block(Q2)}",
    O.features_block(Q2),
)
def feature_table_store(src: Sources) -> DataFrame:
    """Build, guard, publish and read back the stored tables of one cohort."""
    spark = src.transactions.sparkSession
    import uuid

    store = FeatureTableStore(spark, f"{staging_root(spark)}/store-{uuid.uuid4().hex}")
    return stored_feature_table(store, src, Q2)


@register(
    "monthly_arpu",
    f"""SELECT round(CAST(sum(CAST(round(price_per_day * 1000000) AS BIGINT)) AS BIGINT)::DOUBLE
  / count(price_per_day) / 1000000.0::DOUBLE * 30.4::DOUBLE, 6) + 0.0 AS monthly_arpu
FROM {O.tx_features_block(Q3)}""",
    O.tx_features_block(Q3),
)
def arpu(src: Sources) -> DataFrame:
    return monthly_arpu(feature_table(src, Q3, with_logs=False))


def _fingerprint_sql(columns: list[str], source: str) -> str:
    cells = ", ".join(
        f"coalesce(length(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in sorted(columns)
    )

    def half(at: int) -> str:
        return f"CAST(sum(CAST(CAST(concat('0x', substr(h, {at}, 16)) AS UBIGINT) AS HUGEINT)) % 18446744073709551616::HUGEINT AS VARCHAR)"

    return f"SELECT count(*) AS n, {half(1)} AS sum_high, {half(17)} AS sum_low FROM (SELECT md5(concat({cells})) AS h FROM {source}) x"


_K3, _L3 = O.cohort_block(Q3), O.labels_block(Q3)
_PRINTED = [c for c in COHORT_COLUMNS if c != "mean_paid"]


@register("content_fingerprint", _fingerprint_sql(_PRINTED, _K3), _K3)
def content_fingerprint(src: Sources) -> DataFrame:
    """Order-free fingerprint of a cohort (without its one average, whose last digit engines differ in)."""
    return contracts.content_fingerprint(cohort_table(src, Q3), _PRINTED)


@register("members_fingerprint", _fingerprint_sql(["user_id"], _L3), _L3)
def members_fingerprint(src: Sources) -> DataFrame:
    return contracts.members_fingerprint(src.labels(Q3))


# --- descriptive reports ---------------------------------------------------

_CO = O.cohort_block(Q3)
_RATE = r6("avg(is_churn)", "churn_rate")


def _report(name: str, sql: str, fn, *needs: str) -> None:
    register(name, sql, *(needs or (_CO,)))(lambda src: fn(cohort_table(src, Q3)))


@register(
    "cohort_rates",
    f"""SELECT {r6('train_rate', 'train_rate')}, {r6('valid_rate', 'valid_rate')},
  {r6('valid_rate / train_rate - 1', 'relative_change')},
  {r6('-(valid_rate * ln(train_rate) + (1 - valid_rate) * ln(1 - train_rate))', 'constant_log_loss')}
FROM (SELECT (SELECT avg(is_churn) FROM {O.labels_block(Q2)}) AS train_rate,
  (SELECT avg(is_churn) FROM {O.labels_block(Q3)}) AS valid_rate) x""",
    O.labels_block(Q2),
    O.labels_block(Q3),
)
def cohort_rates(src: Sources) -> DataFrame:
    return eda.cohort_rates(src.labels(Q2), src.labels(Q3))


_report(
    "history_bins",
    f"""SELECT CASE WHEN n_tx <= 2 THEN '1-2' WHEN n_tx <= 6 THEN '3-6' WHEN n_tx <= 12 THEN '7-12'
  WHEN n_tx <= 24 THEN '13-24' ELSE '25+' END AS bin, count(*) AS n_users, {_RATE}
FROM {_CO} GROUP BY 1""",
    eda.history_bins,
)
_report(
    "cancel_x_autorenew",
    f"""SELECT CAST(last_is_cancel AS BIGINT) AS last_is_cancel,
  CAST(last_is_auto_renew AS BIGINT) AS last_is_auto_renew, 'both' AS level,
  count(*) AS n_users, {_RATE} FROM {_CO} GROUP BY 1, 2
UNION ALL SELECT CAST(last_is_cancel AS BIGINT), NULL, 'cancel', count(*), {_RATE} FROM {_CO} GROUP BY 1
UNION ALL SELECT NULL, CAST(last_is_auto_renew AS BIGINT), 'auto_renew', count(*), {_RATE} FROM {_CO} GROUP BY 2""",
    eda.cancel_x_autorenew,
)
_report(
    "rule_segments",
    f"""SELECT segment, n_users, n_churn, {r6('CAST(n_churn AS DOUBLE) / n_users', 'churn_rate')},
  {r6('CAST(n_users AS DOUBLE) / sum(n_users) OVER ()', 'user_share')},
  {r6('CAST(n_churn AS DOUBLE) / sum(n_churn) OVER ()', 'churn_share')}
FROM (SELECT CASE WHEN last_is_cancel = 1 THEN 'A_cancelled'
    WHEN last_is_auto_renew = 0 THEN 'B_auto_renew_off' ELSE 'C_rest' END AS segment,
    count(*) AS n_users, CAST(sum(is_churn) AS BIGINT) AS n_churn FROM {_CO} GROUP BY 1) x""",
    eda.rule_segments,
)
_report(
    "age_validity",
    f"""SELECT CASE WHEN bd IS NULL THEN 'null' WHEN bd BETWEEN 10 AND 100 THEN 'valid'
  ELSE 'outlier' END AS age_group, count(*) AS n_users, {_RATE},
  count(*) FILTER (WHERE bd = 0) AS n_zero, count(*) FILTER (WHERE bd < 0) AS n_negative,
  count(*) FILTER (WHERE bd > 100) AS n_over FROM {_CO} GROUP BY 1""",
    eda.age_validity,
)
_report(
    "gender_rates",
    f"SELECT coalesce(gender, '(missing)') AS gender, count(*) AS n_users, {_RATE} FROM {_CO} GROUP BY 1",
    eda.gender_rates,
)
_report(
    "member_coverage",
    f"SELECT CAST(in_members AS BIGINT) AS in_members, count(*) AS n_users, {_RATE} FROM {_CO} GROUP BY 1",
    eda.member_coverage,
)
_report(
    "payment_method_churn",
    f"""SELECT CAST(last_payment_method_id AS BIGINT) AS last_payment_method_id, count(*) AS n_users, {_RATE}
FROM {_CO} GROUP BY 1 HAVING count(*) >= 10""",
    lambda df: eda.payment_method_churn(df, min_users=10),
)
_report(
    "plan_days_churn",
    f"""SELECT CAST(last_payment_plan_days AS BIGINT) AS last_payment_plan_days, count(*) AS n_users,
  {_RATE}, {r6('CAST(count(*) AS DOUBLE) / sum(count(*)) OVER ()', 'user_share')} FROM {_CO} GROUP BY 1""",
    eda.plan_days_churn,
)


@register(
    "flag_profile",
    f"""SELECT count(*) FILTER (WHERE last_is_cancel = 1) AS n_set,
  {r6('avg(CASE WHEN last_is_cancel = 1 THEN 1 ELSE 0 END)', 'set_share')},
  count(*) FILTER (WHERE last_is_cancel IS NULL) AS n_missing FROM {O.tx_features_block(Q3_T7)}""",
    O.tx_features_block(Q3_T7),
)
def flag_profile(src: Sources) -> DataFrame:
    return eda.flag_profile(feature_table(src, Q3_T7, with_logs=False))


@register(
    "sentinel_census",
    """SELECT count(*) AS n_rows, count(*) FILTER (WHERE membership_expire_date = 19700101) AS expire_epoch,
  count(*) FILTER (WHERE membership_expire_date > 20010601) AS expire_far,
  count(*) FILTER (WHERE transaction_date > membership_expire_date) AS recorded_after_expire,
  count(*) FILTER (WHERE actual_amount_paid = 0) AS paid_zero,
  count(*) FILTER (WHERE actual_amount_paid < plan_list_price) AS paid_below_price FROM tx""",
    "tx",
)
def sentinel_census(src: Sources) -> DataFrame:
    return eda.sentinel_census(_tx(src), far=20010601)


def _contract_labels(name: str, block: str) -> str:
    checks = (
        ("rows", "count(*)"),
        ("duplicate_rows", "count(*) - count(DISTINCT l.user_id)"),
        ("bad_labels", "count(*) FILTER (WHERE is_churn IS NULL OR is_churn NOT IN (0, 1))"),
        ("churned", "count(*) FILTER (WHERE is_churn = 1)"),
        ("stayed", "count(*) FILTER (WHERE is_churn = 0)"),
        ("not_in_members", "count(*) FILTER (WHERE m.user_id IS NULL)"),
    )
    return " UNION ALL ".join(
        f"SELECT 'labels_{name}' AS \"table\", '{c}' AS \"check\", CAST({e} AS BIGINT) AS value"
        f" FROM {block} l LEFT JOIN members m ON m.user_id = l.user_id"
        for c, e in checks
    )


@register(
    "data_contract",
    " UNION ALL ".join(
        [
            _contract_labels("q2", O.labels_block(Q2)),
            _contract_labels("q3", O.labels_block(Q3)),
            "SELECT 'transactions', 'rows', count(*) FROM tx",
            "SELECT 'transactions', 'data_end', CAST(max(transaction_date) AS BIGINT) FROM tx",
            "SELECT 'members', 'rows', count(*) FROM members",
            "SELECT 'members', 'duplicate_rows', count(*) - count(DISTINCT user_id) FROM members",
        ]
    ),
    O.labels_block(Q2),
    O.labels_block(Q3),
    "members",
    "tx",
)
def data_contract(src: Sources) -> DataFrame:
    lists = {"q2": src.labels(Q2), "q3": src.labels(Q3)}
    return contracts.data_contract(lists, src.transactions, src.members)
