"""Reason sentences for the listed users.

Every feature's wording is known beforehand; a row's sentences are expressions of that row, kept in
an array column, so scoring and listing need neither a join nor a grouping. Long tables of reasons
join the wording as a small table. Suppressed candidates are kept and marked.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from renewlens.operators.attribution import LinearScorer, strongest_groups, top_contributors
from renewlens.operators.guards import require_columns
from renewlens.operators.logs import TRENDS, feature_group_of, log_columns, window_measure
from renewlens.operators.quantiles import exact_quantiles, value_counts
from renewlens.session import stage
from renewlens.sources.schemas import (
    GENDER_CODES,
    KEY,
    MAX_WINDOW,
    MISSING_CATEGORY,
)

MIN_RELATIVE_SHARE = 0.05
SUPPRESSED = "below_relative_floor"
EXPIRY, SHIFTED, SNAPSHOT = "expiry", "shifted", "snapshot"

# The measures of the narrow window can be set against the rest of the wide one.
CONTEXT_NARROW, CONTEXT_WIDE = 30, 90


# Which columns a reason counts together. Log columns follow their behaviour group.
TOPICS = {
    "tenure": ("tenure_days", "days_since_last_tx", "days_since_registration", "n_tx", "days_to_expire"),
    "cancel": ("last_is_cancel", "n_cancel_hist", "cancel_rate"),
    "renewal": ("last_is_auto_renew", "last_payment_method_id"),
    "plan_price": (
        "last_paid", "last_price", "last_plan_days", "discount_amount", "price_per_day", "mean_paid",
        "is_free_plan", "zero_collected",
    ),
    "member": ("in_members", "bd_clean", "bd_valid", "city", "registered_via", "gender_code"),
}
# What a column or a log measure is called.
NOUNS = {
    "tenure_days": "Days since first transaction",
    "days_since_last_tx": "Days since last transaction",
    "days_since_registration": "Days since registration",
    "n_tx": "Transactions so far",
    "days_to_expire": "Days until expiry",
    "last_is_cancel": "Cancel flag of the last transaction",
    "n_cancel_hist": "Cancellations so far",
    "cancel_rate": "Share of cancellations",
    "last_is_auto_renew": "Auto-renewal setting",
    "last_payment_method_id": "Payment method",
    "last_paid": "Last amount paid",
    "last_price": "Last list price",
    "last_plan_days": "Last plan length",
    "discount_amount": "Last discount",
    "price_per_day": "Price per day",
    "mean_paid": "Average amount paid",
    "is_free_plan": "Free-plan flag",
    "zero_collected": "Zero-collection flag",
    "in_members": "Member record",
    "bd_clean": "Age",
    "bd_valid": "Age validity",
    "city": "City",
    "registered_via": "Registration channel",
    "gender_code": "Gender",
    "log_min_days_before": "Days since latest activity",
    "log_max_days_before": "Days since earliest activity",
    "log_has_logs": f"Activity in the last {MAX_WINDOW} days",
    "active_days": "active days",
    "active_ratio": "share of active days",
    "secs": "listening time",
    "plays": "plays",
    "completed": "completed plays",
    "unq": "different songs",
    "completion": "completion rate",
    "secs_per_active_day": "listening time per active day",
}
# Units, decimals and shares; what is not listed has no unit, no decimals, no percent.
UNITS = {
    "days": (
        "tenure_days", "days_since_last_tx", "days_since_registration", "days_to_expire", "last_plan_days",
        "log_min_days_before", "log_max_days_before", "active_days",
    ),
    "transactions": ("n_tx",),
    "times": ("n_cancel_hist",),
    "units": ("last_paid", "last_price", "discount_amount", "price_per_day", "mean_paid"),
    "years": ("bd_clean",),
    "seconds": ("secs", "secs_per_active_day"),
    "plays": ("plays", "completed"),
    "songs": ("unq",),
}
DECIMALS = {1: ("cancel_rate", "mean_paid", "active_ratio", "completion"), 2: ("price_per_day", *TRENDS)}
PERCENT = ("cancel_rate", "active_ratio", "completion")
CODES = ("last_payment_method_id", "city", "registered_via", "gender_code")
# Sentences of yes/no columns.
FLAGS = {
    "last_is_cancel": ("Last transaction is a cancellation", "Last transaction is not a cancellation"),
    "last_is_auto_renew": ("Auto-renewal is on", "Auto-renewal is off"),
    "is_free_plan": ("On a free plan", "Not on a free plan"),
    "zero_collected": ("Priced plan but nothing collected", "Payment collected normally"),
    "in_members": ("Member record found", "No member record"),
    "bd_valid": ("Age is plausible", "Age is not plausible"),
    "log_has_logs": (f"Active in the last {MAX_WINDOW} days", f"No activity in the last {MAX_WINDOW} days"),
}
# Columns known only on the expiry day; member columns come from a snapshot.
ON_EXPIRY_DAY = ("last_is_cancel",)
# Sums of days can be set against the rest of the wide window.
SPLITTABLE = ("active_days", "secs", "plays", "completed")


def _listed(table, name: str, default):
    """Key under which a table of lists holds a name."""
    return next((key for key, names in table.items() if name in names), default)


def wording(feature: str) -> dict:
    """One row of the wording table, from the column's name and the lists above."""
    measure = window_measure(feature) or feature
    window = feature[3 : feature.index("_")] if measure != feature else ""
    noun, template = NOUNS.get(measure, ""), None
    if window:
        noun = f"Last {window} days: {noun}"
    elif feature in TRENDS:
        of, short, long = TRENDS[feature]
        noun = f"Trend of {NOUNS[of]} over {short} against {long} days"
        template = f"Daily {NOUNS[of]} of the last {short} days is {{v}} times that of {long} days"
    behaviour = feature_group_of(feature) or ("recency" if feature == "log_has_logs" else None)
    topic = f"log_{behaviour}" if behaviour else _listed(TOPICS, feature, None)
    set_against_rest = measure in SPLITTABLE and window == str(CONTEXT_NARROW)
    flag_on, flag_off = FLAGS.get(feature, (None, None))
    return {
        "feature": feature,
        "meta_group": topic,
        "horizon": EXPIRY if feature in ON_EXPIRY_DAY else SNAPSHOT if topic == "member" else SHIFTED,
        "noun": noun,
        "unit": _listed(UNITS, measure, ""),
        "digits": _listed(DECIMALS, measure, 0),
        "percent": measure in PERCENT,
        "category": feature in CODES,
        "template": template,
        "flag_on": flag_on,
        "flag_off": flag_off,
        "context": f"log{CONTEXT_WIDE}_{measure}" if set_against_rest else None,
        "is_log": feature.startswith("log"),
    }


WORDED = (*[f for names in TOPICS.values() for f in names], *log_columns())
GROUPS: dict[str, str] = {f: wording(f)["meta_group"] for f in WORDED}
GENDER_NAMES = {code: name for name, code in GENDER_CODES.items()}


def missing_metadata(features: Iterable[str]) -> list[str]:
    return [f for f in features if f not in GROUPS]


def feature_metadata(spark: SparkSession) -> DataFrame:
    """The wording as a table: one row per known feature, fixed in size."""
    return spark.createDataFrame(
        [tuple(wording(f).values()) for f in WORDED],
        "feature string, meta_group string, horizon string, noun string, unit string, digits int,"
        " percent boolean, category boolean, template string, flag_on string, flag_off string,"
        " context string, is_log boolean",
    )


def context_columns(df: DataFrame) -> list[str]:
    """Columns the renderer needs besides the explained value."""
    wanted = sorted({f"log{CONTEXT_WIDE}_{m}" for m in SPLITTABLE})
    return [c for c in [*wanted, "log_has_logs"] if c in df.columns]


def context_struct(df: DataFrame) -> Column:
    """Context values of a row packed as a map, to be carried through the explosion."""
    pairs = []
    for c in context_columns(df):
        pairs += [F.lit(c), F.col(c).cast("double")]
    if not pairs:
        return F.lit(None).cast("map<string,double>").alias("context_values")
    return F.create_map(*pairs).alias("context_values")


def _shown(value: Column, percent: Column, digits: Column) -> Column:
    """A number in its feature's format."""
    scaled = F.concat(F.call_function("format_number", value * 100, digits), F.lit("%"))
    return F.when(percent, scaled).otherwise(F.call_function("format_number", value, digits))


def render_reason(
    meta: Callable[[str], Column] = F.col, value: Column | None = None, context: Callable[[Column | str], Column] | None = None
) -> Column:
    """Sentence for a feature and its value.

    ``meta`` gives the wording's fields (columns after a join, or literals where the feature is
    known), ``context`` the value of a named context column.
    """
    value = F.col("value") if value is None else value
    context = context or (lambda name: F.col("context_values")[name])
    noun, unit = meta("noun"), meta("unit")
    no_logs = F.coalesce(context("log_has_logs") == 0.0, F.lit(False))
    absent = F.when(
        no_logs & meta("is_log"), F.lit(f"No activity in the last {MAX_WINDOW} days")
    ).otherwise(F.concat(noun, F.lit(" is missing")))

    flag = F.when(value >= 0.5, meta("flag_on")).otherwise(meta("flag_off"))

    code = value.cast("int")
    named = F.concat(noun, F.lit(" "), code.cast("string"))
    for number, name in GENDER_NAMES.items():
        named = F.when(
            (meta("feature") == "gender_code") & (code == number),
            F.concat(noun, F.lit(f" is {name}")),
        ).otherwise(named)
    category = F.when(code == MISSING_CATEGORY, F.concat(noun, F.lit(" is unknown"))).otherwise(
        named
    )

    tail = F.when(unit == "", F.lit("")).otherwise(F.concat(F.lit(" "), unit))
    shown = _shown(value, meta("percent"), meta("digits"))
    plain = F.when(
        meta("template").isNotNull(), F.replace(meta("template"), F.lit("{v}"), shown)
    ).otherwise(F.concat(noun, F.lit(" "), shown, tail))
    span = CONTEXT_WIDE - CONTEXT_NARROW
    parts = span // CONTEXT_NARROW
    assert parts * CONTEXT_NARROW == span
    before = (context(meta("context")) - value) / F.lit(float(parts))
    earlier = F.concat(
        F.lit(f" (average per {CONTEXT_NARROW} days over the {span} days before: "),
        _shown(before, meta("percent"), meta("digits")),
        tail,
        F.lit(")"),
    )
    number = F.concat(plain, F.when(before >= 0, earlier).otherwise(F.lit("")))
    return (
        F.when(value.isNull(), absent)
        .when(meta("flag_on").isNotNull(), flag)
        .when(meta("category"), category)
        .otherwise(number)
    )


@cache
def _wording_map() -> str:
    """SQL of a constant map: feature -> its wording, fixed in size."""

    def sql(x: object) -> str:
        if x is None:
            return "cast(null as string)"
        return "'" + x.replace("'", "\\'") + "'" if isinstance(x, str) else str(x).lower()

    entries = []
    for f in WORDED:
        fields = ", ".join(f"'{k}', {sql(v)}" for k, v in wording(f).items())
        entries.append(f"'{f}', named_struct({fields})")
    return f"map({', '.join(entries)})"


def with_reasons(
    df: DataFrame, scorer: LinearScorer, *, k: int = 3, min_shap: float = 0.0, min_relative: float = MIN_RELATIVE_SHARE
) -> DataFrame:
    """``df`` with the array ``reasons``: a row's top groups with sentences and display marks.

    Strongest first. Wording is a constant, so nothing is joined, exploded or grouped again.
    """
    if min_relative < 0:
        raise ValueError(f"min_relative must not be negative: {min_relative}")
    unworded = [f for f in scorer.features if f not in GROUPS]
    if unworded:
        raise KeyError(f"no wording for features {unworded}")

    def told(x: Column, i: Column) -> Column:
        g, words = x["g"], x["words"]
        horizon = words["horizon"]
        relative = g["minus_total"] / F.col("strongest")[0]["minus_total"]
        displayed = relative >= min_relative
        return F.struct(
            (i + 1).alias("rank"),
            g["group"].alias("group"),
            (-g["minus_total"]).alias("group_shap"),
            g["rep"]["feature"].alias("feature"),
            g["rep"]["shap"].alias("feature_shap"),
            g["rep"]["value"].alias("value"),
            render_reason(lambda name: words[name], g["rep"]["value"]).alias("reason"),
            horizon.alias("horizon"),
            (horizon == EXPIRY).alias("expiry_dated"),
            relative.alias("relative_to_top"),
            displayed.alias("displayed"),
            F.when(~displayed, F.lit(f"{SUPPRESSED}({min_relative})")).alias("suppression_reason"),
        )

    wording_of = F.expr(_wording_map())
    worded = F.transform(
        "strongest", lambda g: F.struct(g.alias("g"), F.element_at(wording_of, g["rep"]["feature"]).alias("words"))
    )
    ranked = df.withColumns({"strongest": strongest_groups(scorer, GROUPS, k, min_shap), "context_values": context_struct(df)})
    return ranked.withColumn("reasons", F.transform(worded, told)).drop("strongest", "context_values")


def add_reasons(top: DataFrame) -> DataFrame:
    """Add ``reason``, ``horizon`` and ``expiry_dated`` to top contributors.

    ``top`` carries ``context_values``. Expiry-dated sentences are marked, not removed.
    """
    require_columns(top, [KEY, "feature", "value", "context_values"], "top contributors")
    joined = top.join(feature_metadata(top.sparkSession), "feature", "left")
    known = F.when(F.col("noun").isNotNull(), render_reason()).when(
        F.col("feature").isNotNull(),
        F.raise_error(F.concat(F.lit("no wording for feature "), F.col("feature"))).cast("string"),
    )
    return joined.select(
        *[c for c in top.columns if c != "context_values"],
        known.alias("reason"),
        "horizon",
        (F.col("horizon") == EXPIRY).alias("expiry_dated"),
    )


def mark_display(top: DataFrame, min_relative: float = MIN_RELATIVE_SHARE) -> DataFrame:
    """Mark sentences too weak next to the user's strongest one; delete none.

    The strongest total rides along from the row (``top_shap``), so no window
    or self-join is needed.
    """
    require_columns(top, ["rank", "group_shap", "top_shap"], "top contributors")
    if min_relative < 0:
        raise ValueError(f"min_relative must not be negative: {min_relative}")
    shown = F.col("relative_to_top") >= min_relative
    return (
        top.withColumn("relative_to_top", F.col("group_shap") / F.col("top_shap"))
        .withColumn("displayed", shown)
        .withColumn(
            "suppression_reason",
            F.when(~F.col("displayed"), F.lit(f"{SUPPRESSED}({min_relative})")),
        )
        .drop("top_shap")
    )


def explain(
    df: DataFrame,
    scorer: LinearScorer,
    *,
    k: int = 3,
    min_shap: float = 0.0,
    min_relative: float = MIN_RELATIVE_SHARE,
    carry: Sequence[str] = (),
    keep_empty: bool = False,
) -> DataFrame:
    """Top groups, sentences and display marks of every row, a line each, without a shuffle or a join."""
    rows = with_reasons(df, scorer, k=k, min_shap=min_shap, min_relative=min_relative)
    line = (F.explode_outer if keep_empty else F.explode)("reasons").alias("r")
    fields = "rank group group_shap feature feature_shap value reason horizon expiry_dated relative_to_top displayed suppression_reason"
    return rows.select(KEY, *carry, line).select(KEY, *carry, *[F.col(f"r.{c}").alias(c) for c in fields.split()])


def display_impact(marked: DataFrame) -> DataFrame:
    """What the display threshold costs."""
    hidden = ~F.col("displayed")
    per_user = marked.groupBy(KEY).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(hidden).alias("n_hidden")
    )
    people = per_user.agg(
        F.sum("n").alias("candidates"),
        (F.sum("n") - F.sum("n_hidden")).alias("displayed"),
        F.sum("n_hidden").alias("suppressed"),
        F.count_if(F.col("n_hidden") > 0).alias("affected_users"),
        (F.count_if(F.col("n_hidden") > 0) / F.count(F.lit(1))).alias("affected_share"),
    )
    counts = stage(value_counts(marked.filter(hidden), "relative_to_top"), "suppressed-shares")
    middle = stage(exact_quantiles(counts, [0.5]).select("quantile"), "suppressed-median")
    return people.withColumn("median_suppressed_share", middle.agg(F.max("quantile")).scalar())


def expiry_dated_share(marked: DataFrame) -> DataFrame:
    """How much of the explanation rests on signals of the expiry day itself."""
    flagged = F.col("expiry_dated")
    per_user = marked.groupBy(KEY).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(flagged).alias("n_dated"),
        F.sum("group_shap").alias("shap"),
        F.sum(F.when(flagged, F.col("group_shap")).otherwise(0.0)).alias("shap_dated"),
    )
    return per_user.agg(
        F.sum("n").alias("sentences"),
        F.sum("n_dated").alias("dated_sentences"),
        (F.sum("n_dated") / F.sum("n")).alias("sentence_share"),
        F.count(F.lit(1)).alias("users"),
        F.count_if(F.col("n_dated") > 0).alias("dated_users"),
        (F.count_if(F.col("n_dated") > 0) / F.count(F.lit(1))).alias("user_share"),
        (F.sum("shap_dated") / F.sum("shap")).alias("contribution_share"),
    )


def wide_reasons(rows: DataFrame, keep: Sequence[str], k: int = 3) -> DataFrame:
    """One row per listed user with the displayed sentences; short rows stay null.

    ``rows`` carry the array ``reasons`` of :func:`with_reasons`.
    """
    require_columns(rows, [KEY, "reasons", *keep], "rows with reasons")
    cells = []
    for n in range(1, k + 1):
        of = F.try_element_at("reasons", F.lit(n))
        of = F.when(of["displayed"], of)
        cells += [
            of["reason"].alias(f"reason_{n}"),
            of["group"].alias(f"group_{n}"),
            F.round(of["group_shap"], 4).alias(f"group_shap_{n}"),
            of["expiry_dated"].alias(f"expiry_dated_{n}"),
        ]
    return rows.select(KEY, *keep, *cells)


AUDIT_COLUMNS = (
    KEY,
    "rank",
    "group",
    "group_shap",
    "relative_to_top",
    "displayed",
    "suppression_reason",
    "feature",
    "feature_shap",
    "value",
    "reason",
    "horizon",
    "expiry_dated",
)


def audit_frame(marked: DataFrame) -> DataFrame:
    """Every candidate sentence, shown or not, in a fixed column order."""
    require_columns(marked, AUDIT_COLUMNS, "marked reasons")
    return marked.select(*AUDIT_COLUMNS)


def rank_distribution(marked: DataFrame, people: DataFrame) -> DataFrame:
    """How many users got 0, 1, ... sentences."""
    per_user = marked.groupBy(KEY).agg(F.count(F.lit(1)).alias("n"))
    total = people.agg(F.count(F.lit(1))).scalar()
    return (
        people.select(KEY)
        .join(per_user, KEY, "left")
        .groupBy(F.coalesce("n", F.lit(0)).alias("n_reasons"))
        .agg(F.count(F.lit(1)).alias("n_users"))
        .withColumn("share", F.col("n_users") / total)
    )


def top1_groups(marked: DataFrame) -> DataFrame:
    """What the list is mainly about: distribution of the strongest group."""
    first = marked.filter("rank = 1")
    total = first.agg(F.count(F.lit(1))).scalar()
    return (
        first.groupBy("group")
        .agg(F.count(F.lit(1)).alias("n_users"), F.avg("group_shap").alias("mean_shap"))
        .withColumn("share", F.col("n_users") / total)
    )


def grouped_vs_plain_top1(df: DataFrame, scorer: LinearScorer) -> DataFrame:
    """Does summing inside groups change which group wins?"""
    grouped = top_contributors(df, scorer, groups=GROUPS, k=1).groupBy("group").agg(
        F.count(F.lit(1)).alias("grouped_users")
    )
    meta = feature_metadata(df.sparkSession).select("feature", F.col("meta_group").alias("group"))
    plain = (
        top_contributors(df, scorer, k=1)
        .drop("group")
        .join(meta, "feature")
        .groupBy("group")
        .agg(F.count(F.lit(1)).alias("plain_users"))
    )
    return grouped.join(plain, "group", "outer").select(
        "group",
        F.coalesce("grouped_users", F.lit(0)).alias("grouped_users"),
        F.coalesce("plain_users", F.lit(0)).alias("plain_users"),
    )
