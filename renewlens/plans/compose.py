"""End-to-end compositions over a set of sources."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from renewlens.functions.scalars import platform_exp, sigmoid
from renewlens.operators.attribution import LinearScorer
from renewlens.operators.cohort import CohortSpec, build_cohort, cutoffs_for, join_labels_cutoffs
from renewlens.operators.decision import BusinessParams, offer_list, resolve_assumptions
from renewlens.operators.features import FeatureRoles, build_features, check_logs
from renewlens.operators.guards import GuardLog, check_cohort, check_unique_key, cohort_guards
from renewlens.operators.logs import build_log_features, window_bounds
from renewlens.operators.metrics import repeat_vs_new
from renewlens.operators.reasons import audit_frame, explain, wide_reasons, with_reasons
from renewlens.session import stage
from renewlens.sources import demo
from renewlens.sources.schemas import KEY, MAX_WINDOW
from renewlens.sources.store import FeatureTableStore, inputs_version


class Sources:
    """Domain tables, each opened on first use."""

    def __init__(
        self,
        transactions: Callable[[], DataFrame],
        members: Callable[[], DataFrame],
        logs: Callable[[], DataFrame],
        labels: Callable[[CohortSpec], DataFrame],
    ) -> None:
        self._open = {"transactions": transactions, "members": members, "logs": logs}
        self._labels = labels

    @cached_property
    def transactions(self) -> DataFrame:
        return self._open["transactions"]()

    @cached_property
    def members(self) -> DataFrame:
        return self._open["members"]()

    @cached_property
    def logs(self) -> DataFrame:
        return self._open["logs"]()

    def labels(self, spec: CohortSpec) -> DataFrame:
        return self._labels(spec)

    @classmethod
    def demo(cls, spark: SparkSession, sf_dir: str) -> Sources:
        return cls(
            lambda: demo.transactions(spark, sf_dir),
            lambda: demo.members(spark, sf_dir),
            lambda: demo.logs(spark, sf_dir),
            lambda spec: demo.labels(spark, sf_dir, spec),
        )


# A fixed linear scorer with one weight per kind of signal. It stands in for a
# fitted model where results must be comparable bit by bit across engines.
FIXED_SCORER = LinearScorer(
    base=0.1,
    weights={
        "cancel_rate": 0.8,
        "days_since_last_tx": 0.002,
        "n_tx": -0.1,
        "last_is_cancel": 0.6,
        "last_is_auto_renew": -0.4,
        "price_per_day": 0.01,
        "discount_amount": 0.005,
        "in_members": -0.1,
        "gender_code": 0.05,
        "log_has_logs": -0.2,
        "log_min_days_before": 0.006,
        "log30_plays": -0.05,
        "log90_active_days": -0.03,
        "log_trend_30_90": -0.04,
    },
    means={
        "cancel_rate": 0.1,
        "days_since_last_tx": 60.0,
        "n_tx": 8.0,
        "last_is_cancel": 0.1,
        "last_is_auto_renew": 0.75,
        "price_per_day": 8.0,
        "discount_amount": 1.0,
        "in_members": 0.85,
        "gender_code": 0.0,
        "log_has_logs": 0.85,
        "log_min_days_before": 20.0,
        "log30_plays": 2.0,
        "log90_active_days": 5.0,
        "log_trend_30_90": 1.0,
    },
    missing={"log_min_days_before": 0.3, "log_trend_30_90": 0.1, "log30_plays": 0.15},
)

COMPARED_DIGITS = 12

# Offers are cheap relative to the small amounts of the demo tables.
DEMO_PARAMS = BusinessParams(c_offer=50.0)


def cohort_table(src: Sources, spec: CohortSpec) -> DataFrame:
    return build_cohort(spec, src.transactions, src.labels(spec), src.members)


def cutoff_table(src: Sources, spec: CohortSpec) -> DataFrame:
    """Labelled users with their cutoff; all the log windows need."""
    labels = src.labels(spec)
    return join_labels_cutoffs(labels, cutoffs_for(spec, labels, src.transactions))


def log_table(src: Sources, spec: CohortSpec) -> DataFrame:
    """Trailing windows of one cohort; dates outside any window never leave the scan."""
    return build_log_features(src.logs, cutoff_table(src, spec), bounds=window_bounds([spec]))


def feature_table(src: Sources, spec: CohortSpec, *, with_logs: bool = True) -> DataFrame:
    return build_features(cohort_table(src, spec), log_table(src, spec) if with_logs else None)


def guarded_feature_table(src: Sources, spec: CohortSpec, log: GuardLog | None = None) -> DataFrame:
    """The stored feature table of a cohort with G1, G1b, G1c, G2 and G3 counted while it is written.

    Only G8 needs a pass of its own, over the stored keys. A violation is an error; with a ``log``
    the caller judges the findings.
    """
    seen = log or GuardLog()
    data_end = src.transactions.agg(F.max("transaction_date")).first()[0]
    rules = cohort_guards(spec, data_end, MAX_WINDOW)
    cohort = build_cohort(
        spec, src.transactions, src.labels(spec), src.members,
        watch=lambda df: seen.watch(df, rules, f"cohort {spec.name}"),
    )
    table = stage(build_features(cohort, log_table(src, spec), log=seen), f"guarded-{spec.name}")
    if log is None:
        seen.verify()
        check_unique_key(table, what=f"features {spec.name}")
    return table


def compared(p: Column) -> Column:
    """``p`` with COMPARED_DIGITS decimals, in double arithmetic as the other engine rounds; Spark's
    own ``round`` works on decimals and differs near halves."""
    unit = F.lit(float(10**COMPARED_DIGITS))
    return F.round(p * unit) / unit


def scored_table(
    src: Sources,
    spec: CohortSpec,
    previous: CohortSpec | None = None,
    scorer: LinearScorer = FIXED_SCORER,
) -> DataFrame:
    """Feature table with score ``p`` and, given the previous cohort, the repeat/new segment.

    The demo score has :data:`COMPARED_DIGITS` decimals: two engines that compute ``exp`` with
    different last bits then agree on which scores are equal, but for the few next to a half: the
    nearest available ``exp`` keeps these rare. Operators never round.
    """
    p = compared(sigmoid(scorer.log_odds(), platform_exp))
    scored = feature_table(src, spec).withColumn("p", p)
    return scored if previous is None else repeat_vs_new(scored, cutoff_table(src, previous))


def stored_feature_table(
    store: FeatureTableStore, src: Sources, spec: CohortSpec, *, force: bool = False
) -> DataFrame:
    """Build, guard and publish the cohort, log and feature tables of one spec.

    Guards run on the stored tables: building twice just to check would double
    the cost, and a stored table must be re-checked on every read anyway.
    """
    read = inputs_version(src.transactions, src.members, src.logs)
    params = {"spec": spec.__dict__, "windows": MAX_WINDOW, "inputs": read}
    data_end = src.transactions.agg(F.max("transaction_date")).first()[0]
    cohort = store.get_or_build(
        f"cohort_{spec.name}",
        params,
        lambda: cohort_table(src, spec),
        check=lambda df: check_cohort(df, spec, data_end, MAX_WINDOW),
        force=force,
    )
    logs = store.get_or_build(
        f"logs_{spec.name}",
        params,
        lambda: build_log_features(
            src.logs, cohort.select(KEY, "cutoff"), bounds=window_bounds([spec])
        ),
        check=lambda df: check_logs(cohort, df),
        force=force,
    )
    return store.get_or_build(
        f"features_{spec.name}", params, lambda: build_features(cohort, logs), force=force
    )


def offers_with_reasons(
    scored: DataFrame,
    assumptions: DataFrame,
    scorer: LinearScorer = FIXED_SCORER,
    *,
    k: int = 3,
) -> tuple[DataFrame, DataFrame]:
    """Offer list and audit table. Only listed users are explained.

    ``scored`` should be a stored table. Explanations are row-local, so neither
    result waits for the other.
    """
    listed = offer_list(scored, assumptions)
    wide = wide_reasons(with_reasons(listed, scorer, k=k), ["p", "expected_net"], k)
    return wide, audit_frame(explain(listed, scorer, k=k))


def demo_assumptions(src: Sources, spec: CohortSpec, previous: CohortSpec) -> DataFrame:
    """Assumptions row: revenue of the evaluated cohort, churn rate of the previous one."""
    return resolve_assumptions(
        feature_table(src, spec, with_logs=False), cutoff_table(src, previous), DEMO_PARAMS
    )


def roles(features: DataFrame) -> FeatureRoles:
    return FeatureRoles.of(features)
