"""Merging cohorts, and splits and folds that depend on user keys only.

Every split is an exact share of a hash ordering inside each stratum: disjoint,
exhaustive, rate-preserving, the same on any partitioning, different per seed.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from renewlens.operators.guards import Finding, GuardViolation
from renewlens.operators.ranking import hash_rank
from renewlens.sources.schemas import KEY

SEGMENTS = ("train", "es", "sel", "cal")
HOLDOUTS = ("cal", "sel", "es")
FRACTION_TOLERANCE = 1e-9


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def merge_cohorts(
    parts: Mapping[str, DataFrame],
    *,
    categorical: Mapping[str, Sequence[str]] | None = None,
    label: str = "is_churn",
    check: bool = True,
) -> DataFrame:
    """Stack feature tables of several cohorts, with their origin in ``cohort``.

    Refuses: fewer than two parts, different columns or order, different types,
    different category declarations, null labels, duplicate users in a part.
    The last two look at data and run as one aggregation per part.
    """
    if len(parts) < 2:
        raise ValueError(f"merging needs at least two cohorts, got {len(parts)}")
    names = list(parts)
    first = parts[names[0]]
    for name in names[1:]:
        df = parts[name]
        if df.columns != first.columns:
            diff = sorted(set(df.columns) ^ set(first.columns)) or "same columns, other order"
            raise ValueError(f"{name} and {names[0]} differ in columns: {diff}")
        types = [
            f.name
            for f, g in zip(first.schema.fields, df.schema.fields, strict=True)
            if f.dataType != g.dataType
        ]
        if types:
            raise ValueError(f"{name} and {names[0]} differ in types of {types}")
        if categorical and tuple(categorical[name]) != tuple(categorical[names[0]]):
            raise ValueError(f"{name} and {names[0]} declare different categories")
    if check:
        for name, df in parts.items():
            stats = (
                df.groupBy(KEY)
                .agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col(label).isNull()).alias("nulls"))
                .agg(F.max("rows").alias("rows"), F.sum("nulls").alias("nulls"))
                .first()
            )
            if stats["nulls"]:
                raise ValueError(f"{name} has {stats['nulls']} null labels: it cannot train a model")
            if stats["rows"] and stats["rows"] > 1:
                raise ValueError(f"{name} holds a user more than once")
    return union_all([df.withColumn("cohort", F.lit(n)) for n, df in parts.items()])


def cohort_summary(merged: DataFrame) -> DataFrame:
    return merged.groupBy("cohort").agg(
        F.count(F.lit(1)).alias("n"), F.avg("is_churn").alias("churn_rate")
    )


def shared_users(merged: DataFrame) -> DataFrame:
    """Users that appear in more than one cohort, and in how many."""
    return (
        merged.select(KEY, "cohort")
        .distinct()
        .groupBy(KEY)
        .agg(F.count(F.lit(1)).alias("n_cohorts"))
        .filter("n_cohorts > 1")
    )


def group_strata(merged: DataFrame, label: str = "is_churn") -> DataFrame:
    """Per user: number of rows and of positives, as the stratum ``n-k``."""
    return (
        merged.groupBy(KEY)
        .agg(F.count(F.lit(1)).alias("n"), F.sum(label).alias("k"))
        .withColumn("stratum", F.concat_ws("-", "n", "k"))
    )


def _take(fraction: float, of: Column) -> Column:
    return F.rint(F.lit(fraction) * of)


def split_two(
    df: DataFrame, *, fraction: float = 0.2, seed: int = 42, label: str = "is_churn"
) -> DataFrame:
    """Stratified train / early-stopping split; adds ``segment``."""
    rows = hash_rank(df, seed=seed, strata=[label])
    held = F.col("hash_rank") <= _take(fraction, F.col("stratum_n"))
    return rows.withColumn("segment", F.when(held, "es").otherwise("train")).drop(
        "hash_rank", "stratum_n"
    )


def split_three(
    df: DataFrame,
    *,
    select_fraction: float = 0.15,
    early_stopping_fraction: float = 0.176,
    seed: int = 42,
    label: str = "is_churn",
) -> DataFrame:
    """Train / early stopping / selection. ``sel`` is cut first, ``es`` from the rest."""
    rows = hash_rank(df, seed=seed, strata=[label])
    n_sel = _take(select_fraction, F.col("stratum_n"))
    n_es = _take(early_stopping_fraction, F.col("stratum_n") - n_sel)
    segment = (
        F.when(F.col("hash_rank") <= n_sel, "sel")
        .when(F.col("hash_rank") <= n_sel + n_es, "es")
        .otherwise("train")
    )
    return rows.withColumn("segment", segment).drop("hash_rank", "stratum_n")


def segment_assign_join(df: DataFrame, assignment: DataFrame, *, check: bool = True) -> DataFrame:
    """Attach user-level segments to rows by key; unassigned or repeated users are errors."""
    if check:
        repeated = assignment.groupBy(KEY).count().filter("count > 1").limit(1).count()
        if repeated:
            raise GuardViolation("a user is assigned to a segment more than once")
    joined = df.join(assignment, KEY, "left")
    assigned = F.coalesce(
        F.col("segment"), F.raise_error(F.lit("a row was not assigned to any segment"))
    )
    return joined.withColumn("segment", assigned)


def split_group(
    merged: DataFrame, *, test_size: float, seed: int = 42, label: str = "is_churn"
) -> DataFrame:
    """Two segments of whole users (``rest`` / ``take``), stratified by ``n-k``."""
    users = hash_rank(group_strata(merged, label), seed=seed, strata=["stratum"])
    taken = F.col("hash_rank") <= _take(test_size, F.col("stratum_n"))
    assignment = users.select(KEY, F.when(taken, "take").otherwise("rest").alias("segment"))
    return segment_assign_join(merged, assignment, check=False)


def check_fractions(fractions: Mapping[str, float]) -> dict[str, float]:
    missing = [s for s in SEGMENTS if s not in fractions]
    if missing:
        raise KeyError(f"fractions lack the segments {missing}")
    extra = [k for k in fractions if k not in SEGMENTS]
    if extra:
        raise KeyError(f"fractions name unknown segments {extra}")
    total = sum(fractions.values())
    if abs(total - 1.0) > FRACTION_TOLERANCE:
        raise ValueError(f"the fractions add up to {total}, not 1")
    return {k: float(v) for k, v in fractions.items()}


# Published shares of the merged final split.
FOUR_WAY = {"train": 0.7, "es": 0.1, "sel": 0.1, "cal": 0.1}


def split_four_group(
    merged: DataFrame,
    *,
    fractions: Mapping[str, float] = FOUR_WAY,
    seed: int = 42,
    label: str = "is_churn",
    check: bool = True,
) -> DataFrame:
    """Train / es / sel / cal of whole users, cut in the order cal, sel, es."""
    shares = check_fractions(fractions)
    users = hash_rank(group_strata(merged, label), seed=seed, strata=["stratum"])
    bound: Column = F.lit(0.0)
    segment: Column | None = None
    for name in HOLDOUTS:
        bound = bound + _take(shares[name], F.col("stratum_n"))
        inside = F.col("hash_rank") <= bound
        segment = F.when(inside, name) if segment is None else segment.when(inside, name)
    assignment = users.select(KEY, segment.otherwise("train").alias("segment"))
    out = segment_assign_join(merged, assignment, check=False)
    if check:
        present = {r["segment"] for r in assignment.select("segment").distinct().collect()}
        empty = [s for s in SEGMENTS if s not in present]
        if empty:
            raise ValueError(f"these segments are empty: {empty} (fractions too small?)")
    return out


def split_summary(df: DataFrame) -> DataFrame:
    return df.groupBy("segment").agg(
        F.count(F.lit(1)).alias("n"),
        F.countDistinct(KEY).alias("n_users"),
        F.avg("is_churn").alias("churn_rate"),
    )


def _fold(k: int) -> Column:
    return ((F.col("hash_rank") - 1) % k).cast("int")


def folds_stratified(
    df: DataFrame, *, k: int = 5, seed: int = 42, label: str = "is_churn"
) -> DataFrame:
    """K folds balanced by label; adds ``fold`` (0-based)."""
    rows = hash_rank(df, seed=seed, strata=[label])
    return rows.withColumn("fold", _fold(k)).drop("hash_rank", "stratum_n")


def folds_grouped(
    merged: DataFrame, *, k: int = 4, seed: int = 42, label: str = "is_churn"
) -> DataFrame:
    """K folds of whole users with balanced strata: nobody crosses folds."""
    users = hash_rank(group_strata(merged, label), seed=seed, strata=["stratum"])
    return merged.join(users.select(KEY, _fold(k).alias("fold")), KEY, "inner")


def folds_random_control(
    merged: DataFrame, *, k: int = 4, seed: int = 42, label: str = "is_churn"
) -> DataFrame:
    """Deliberately ungrouped folds, only to measure what grouping prevents."""
    rows = hash_rank(merged, seed=seed, strata=[label], key=["cohort", KEY])
    return rows.withColumn("fold", _fold(k)).drop("hash_rank", "stratum_n")


def fold_report(folds: DataFrame, label: str = "is_churn") -> DataFrame:
    """Per fold: train and validation rows, positive rate, users on both sides.

    A user crosses a fold when it has rows in that fold and in another one, so
    the number of distinct folds per user answers it without a self-join.
    """
    total = folds.agg(F.count(F.lit(1))).scalar()
    per_fold = folds.groupBy("fold").agg(
        F.count(F.lit(1)).alias("valid_rows"), F.avg(label).alias("valid_rate")
    )
    spread = (
        folds.select(KEY, "fold")
        .distinct()
        .groupBy(KEY)
        .agg(F.collect_list("fold").alias("folds"))
        .select(F.explode("folds").alias("fold"), (F.size("folds") > 1).alias("crosses"))
        .groupBy("fold")
        .agg(
            F.count(F.lit(1)).alias("valid_users"),
            F.count_if(F.col("crosses")).alias("crossing_users"),
        )
    )
    return per_fold.join(spread, "fold").select(
        "fold",
        (total - F.col("valid_rows")).alias("train_rows"),
        "valid_rows",
        "valid_rate",
        "crossing_users",
        (F.col("crossing_users") / F.col("valid_users")).alias("crossing_share"),
    )


def crossing_users(df: DataFrame, column: str = "segment") -> DataFrame:
    """Users in more than one segment, with the sorted list of segments."""
    return (
        df.groupBy(KEY)
        .agg(F.array_sort(F.collect_set(column)).alias("segments"))
        .filter(F.size("segments") > 1)
    )


def find_shared_users(df: DataFrame, column: str = "segment") -> Finding:
    """G4 as a finding: users in several segments, and the most segments of one user."""
    stats = crossing_users(df, column).agg(
        F.count(F.lit(1)).alias("n"), F.max(F.size("segments")).cast("double").alias("most"), F.min(KEY).alias("example")
    ).first()
    return Finding("groups_disjoint", column, stats["n"], stats["most"], f"are users in several segments (for example {stats['example']})")


def check_groups_disjoint(df: DataFrame, column: str = "segment") -> None:
    """G4: nobody is in two segments."""
    find_shared_users(df, column).verify()


def subset_users(df: DataFrame, users: DataFrame) -> DataFrame:
    return df.join(users.select(KEY), KEY, "left_semi")


def dropped_users(base: DataFrame, lead: DataFrame) -> DataFrame:
    """Users of the base cohort who have no history yet when scored earlier."""
    return base.join(lead.select(KEY), KEY, "left_anti")


def dropped_profile(base: DataFrame, lead: DataFrame, label: str = "is_churn") -> DataFrame:
    """How many are lost and how their churn rate compares."""
    kept = lead.select(KEY).distinct().withColumn("kept", F.lit(True))
    flagged = base.join(kept, KEY, "left").withColumn("gone", F.col("kept").isNull())
    return flagged.agg(
        F.count_if("gone").alias("n_dropped"),
        (F.count_if("gone") / F.count(F.lit(1))).alias("share"),
        F.avg(F.when(F.col("gone"), F.col(label))).alias("dropped_rate"),
        F.avg(label).alias("overall_rate"),
    )


def common_subset(base: DataFrame, lead: DataFrame) -> DataFrame:
    """Users scored by both versions side by side; different labels are an error."""
    joined = base.select(KEY, "is_churn", "p").join(
        lead.select(KEY, F.col("is_churn").alias("y_lead"), F.col("p").alias("p_lead")),
        KEY,
        "inner",
    )
    same = F.when(F.col("is_churn") == F.col("y_lead"), F.col("is_churn")).otherwise(
        F.raise_error(F.lit("a user has different labels in the two versions")).cast("int")
    )
    return joined.withColumn("is_churn", same).drop("y_lead")
