"""Batch scoring: a table of requests in, a table of decisions out."""

from __future__ import annotations

from collections.abc import Sequence
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from renewlens.operators.attribution import LOCAL_ACCURACY_TOLERANCE, LinearScorer
from renewlens.operators.features import transaction_features
from renewlens.operators.guards import GuardViolation, require_columns
from renewlens.operators.logs import log_columns
from renewlens.operators.reasons import with_reasons
from renewlens.sources.schemas import KEY, LAST_COLUMNS, MEMBER_COLUMNS

if TYPE_CHECKING:
    from renewlens.operators.compiled import CompiledScorer

TOP_K = 3
TRANSACTION_FIELDS = (
    "cutoff",
    "n_tx",
    "first_tx",
    "last_tx",
    "n_cancel_hist",
    "mean_paid",
    *[f"last_{c}" for c in LAST_COLUMNS],
)
REQUEST_FIELDS = (*TRANSACTION_FIELDS, *MEMBER_COLUMNS)
DERIVED_FIELDS = ("is_churn", "in_members")


def check_request(df: DataFrame, log_fields: Sequence[str] = ()) -> None:
    """Missing, unknown and derived columns are refused by name."""
    derived = [c for c in DERIVED_FIELDS if c in df.columns]
    if derived:
        raise ValueError(f"requests must not supply derived columns: {derived}")
    allowed = {KEY, *REQUEST_FIELDS, *log_fields}
    unknown = sorted(set(df.columns) - allowed)
    if unknown:
        raise ValueError(f"requests have unknown columns: {unknown}")
    missing = sorted({KEY, *REQUEST_FIELDS} - set(df.columns))
    if missing:
        raise ValueError(f"requests lack columns: {missing}")


def rows_to_features(
    requests: DataFrame,
    feature_order: Sequence[str],
    *,
    with_logs: bool = True,
    allow_empty: bool = False,
    warnings: str | None = None,
) -> DataFrame:
    """Requests through the same feature builder as the offline table, row by row.

    Log fields are optional; what is not supplied is missing, never zero. A log
    field from after the cutoff and, unless allowed, an empty table are errors. With ``warnings`` the
    request's warnings ride along in a column of that name, so two requests of one user keep their own.
    """
    if not allow_empty and requests.isEmpty():
        raise ValueError("there are no requests to score")
    log_fields = log_columns() if with_logs else []
    check_request(requests, log_fields)
    given = [c for c in log_fields if c in requests.columns]
    shaped = requests.withColumn("is_churn", F.lit(None).cast("int")).withColumn(
        "in_members", F.col("city").isNotNull()
    )
    supplied = {c: F.col(c).cast("double") if c in given else F.lit(None).cast("double") for c in log_fields}
    if log_fields:
        latest = supplied["log_min_days_before"]
        supplied["log_min_days_before"] = F.when(
            latest < 0, F.raise_error(F.lit("a log field reaches past the cutoff")).cast("double")
        ).otherwise(latest)
        supplied["log_has_logs"] = F.coalesce(supplied["log_has_logs"], F.lit(0.0))
    carried = [warnings] if warnings else []
    if warnings:
        shaped = shaped.withColumn(warnings, request_notes(requests, with_logs=with_logs))
    features = transaction_features(shaped.withColumns(supplied) if supplied else shaped, [*log_fields, *carried])
    missing = sorted(set(feature_order) - set(features.columns))
    extra = sorted(set(features.columns) - set(feature_order) - {KEY, "is_churn", *carried})
    if missing or extra:
        raise ValueError(f"built features do not match the model: missing {missing}, extra {extra}")
    return features.select(KEY, *feature_order, *carried)


def check_features_match(df: DataFrame, feature_order: Sequence[str]) -> None:
    """G10: same features in the same order as the model was trained on."""
    given = [c for c in df.columns if c not in (KEY, "is_churn")]
    if given != list(feature_order):
        raise GuardViolation(
            "features_match: the table's features differ from the model's "
            f"(missing {sorted(set(feature_order) - set(given))}, "
            f"extra {sorted(set(given) - set(feature_order))}, or another order)"
        )


def request_notes(requests: DataFrame, *, with_logs: bool = True) -> Column:
    """What the caller should know about a request, as an array of sentences."""
    notes: list[Column] = []
    if with_logs:
        given = [c for c in log_columns() if c in requests.columns]
        if given:
            present = F.size(F.array_compact(F.array(*[F.col(c).cast("double") for c in given])))
        else:
            present = F.lit(0)
        notes.append(
            F.when(present == 0, "no activity supplied: the model sees a user without any")
            .when(present < len(log_columns()), "some activity columns were not supplied")
        )
    notes.append(
        F.when(
            F.col("registration_init_time") > F.col("cutoff"),
            "registered after the cutoff: member attributes were blanked",
        )
    )
    return F.array_compact(F.array(*notes))


def request_warnings(requests: DataFrame, *, with_logs: bool = True) -> DataFrame:
    """Per request: key and warnings."""
    return requests.select(KEY, request_notes(requests, with_logs=with_logs).alias("warnings"))


_REASON = "rank group reason group_shap feature value horizon expiry_dated relative_to_top suppression_reason".split()


def score_table(
    features: DataFrame,
    scorer: LinearScorer | CompiledScorer,
    assumptions: DataFrame,
    *,
    at_expiry: bool = True,
    top_k: int = TOP_K,
    warnings: str | None = None,
    reasons: bool = True,
    tolerance: float = LOCAL_ACCURACY_TOLERANCE,
) -> DataFrame:
    """Score, threshold decision, value, nested reasons and warnings per user.

    Everything is computed inside the row. ``warnings`` names an array column of ``features`` with
    what the caller should know about the request. With ``reasons=False`` only probabilities and
    decisions are computed; with reasons, a row whose contributions miss its probability by more than
    ``tolerance`` is an error.
    """
    require_columns(features, scorer.features, "features")
    a = assumptions.select(F.struct("r_save", "c_offer", "ltv_saved", "p_star").alias("a")).scalar()
    base = scorer.score(features, contributions=reasons).withColumn("a", a)
    own: list[Column] = []
    if reasons:
        gap = F.abs(scorer.probability(scorer.log_odds()) - F.col("p"))
        message = F.concat(F.lit("local_accuracy: contributions miss the probability by "), gap.cast("string"))
        base = base.withColumn("p", F.when(gap <= tolerance, F.col("p")).otherwise(F.raise_error(message).cast("double")))
        base = with_reasons(base, scorer, k=top_k)
        shown, hidden = F.filter("reasons", lambda r: r["displayed"]), F.filter("reasons", lambda r: ~r["displayed"])
        own = [
            F.when(F.size(shown) == 0, "no feature group raises the risk: there is no reason to name"),
            F.when(
                F.lit(at_expiry) & F.exists(shown, lambda r: r["expiry_dated"]),
                "a reason describes the expiry day itself and is unknown before it",
            ),
        ]

        def cell(r: Column) -> Column:
            rounded = {"group_shap", "relative_to_top"}
            return F.struct(*[(F.round(r[c], 4) if c in rounded else r[c]).alias(c) for c in _REASON])

        told = [F.transform(shown, cell).alias("reasons"), F.transform(hidden, cell).alias("suppressed")]
    else:
        told = []
    notes = F.array(*own) if own else F.array().cast("array<string>")
    if warnings is not None:
        notes = F.concat(F.coalesce(F.col(warnings), F.array().cast("array<string>")), notes)
    net = F.col("p") * F.col("a.r_save") * F.col("a.ltv_saved") - F.col("a.c_offer")
    return base.select(
        KEY,
        "p",
        F.col("a.p_star").alias("p_star"),
        (F.col("p") > F.col("a.p_star")).alias("above_threshold"),
        F.round(net, 1).alias("expected_net"),
        *told,
        F.array_compact(notes).alias("warnings"),
    )


def lookup_scored_user(scored: DataFrame, user_id) -> DataFrame:
    """One user's stored decision (the key filter reaches the scan)."""
    return scored.filter(F.col(KEY) == F.lit(user_id))


def fill_prior(requested: DataFrame, scored: DataFrame, prior: Column | float) -> DataFrame:
    """Every requested user with a score; those without history get the training rate."""
    base = prior if isinstance(prior, Column) else F.lit(float(prior))
    joined = requested.select(KEY).join(scored.select(KEY, "p"), KEY, "left")
    return joined.withColumn("prior", base).select(
        KEY, F.coalesce("p", "prior").alias("is_churn"), F.col("p").isNull().alias("is_prior")
    )


submission_join = fill_prior


def score_checks(requested: DataFrame, submission: DataFrame) -> DataFrame:
    """All hard checks of a submission in one aggregation over each side."""
    wanted = requested.agg(F.count(F.lit(1))).scalar()
    per_user = submission.groupBy(KEY).agg(
        F.count(F.lit(1)).alias("n"),
        F.count("is_churn").alias("known"),
        F.min("is_churn").alias("lo"),
        F.max("is_churn").alias("hi"),
    )
    return per_user.agg(
        F.sum("n").alias("n_rows"),
        (F.sum("n") - F.sum("known")).alias("n_null"),
        F.count_if(F.col("n") > 1).alias("n_repeated"),
        F.count_if((F.col("lo") <= 0) | (F.col("hi") >= 1)).alias("n_out_of_range"),
    ).withColumn("n_requested", wanted)


def assert_submission(requested: DataFrame, submission: DataFrame) -> None:
    row = score_checks(requested, submission).first()
    problems = []
    if row["n_rows"] != row["n_requested"]:
        problems.append(f"{row['n_rows']} rows for {row['n_requested']} requests")
    for name in ("n_null", "n_repeated", "n_out_of_range"):
        if row[name]:
            problems.append(f"{name} = {row[name]}")
    if problems:
        raise GuardViolation("score_checks: " + "; ".join(problems))
