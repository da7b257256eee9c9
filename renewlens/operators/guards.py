"""Leakage and integrity guards.

A guard is a predicate that marks bad rows plus an optional "how bad" measure.
All guards of a table are evaluated in one aggregation, so checking a stored
table costs one scan of the columns the predicates touch.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from renewlens.operators.cohort import CohortSpec, cutoff_window
from renewlens.sources.schemas import KEY


class GuardViolation(AssertionError):
    """A table breaks one of the rules it must satisfy before use."""


@dataclass(frozen=True)
class Guard:
    name: str
    bad: Column
    message: str
    needs: tuple[str, ...] = ()
    worst: Column | None = None


def require_columns(df: DataFrame, columns: Iterable[str], what: str = "table") -> None:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise KeyError(f"{what} lacks columns: {missing}")


@dataclass(frozen=True)
class Finding:
    """What one rule found in one table; no rows means that the rule holds."""

    rule: str
    table: str
    rows: int
    worst: float | None
    message: str = ""

    def verify(self) -> None:
        if self.rows:
            detail = "" if self.worst is None else f" (worst: {self.worst:g})"
            raise GuardViolation(f"{self.rule}: {self.rows} rows of {self.table} {self.message}{detail}")


def _counters(guards: Sequence[Guard]) -> list[Column]:
    out = []
    for i, g in enumerate(guards):
        out.append(F.count_if(F.coalesce(g.bad, F.lit(False))).alias(f"n{i}"))
        worst = g.worst if g.worst is not None else F.lit(None).cast("double")
        out.append(F.max(F.when(g.bad, worst.cast("double"))).alias(f"w{i}"))
    return out


def _findings(row, guards: Sequence[Guard], what: str) -> list[Finding]:
    return [Finding(g.name, what, row[f"n{i}"], row[f"w{i}"], g.message) for i, g in enumerate(guards)]


def find(df: DataFrame, guards: Sequence[Guard], what: str = "table") -> list[Finding]:
    """Evaluate every guard in one action."""
    for g in guards:
        require_columns(df, g.needs, f"{what} ({g.name})")
    return _findings(df.agg(*_counters(guards)).first(), guards, what)


def run_guards(df: DataFrame, guards: Sequence[Guard], what: str = "table") -> None:
    """Evaluate every guard in one action; raise on the first that is violated."""
    for found in find(df, guards, what):
        found.verify()


class GuardLog:
    """Counters of guards that ride on a build, so that checking costs no pass of its own.

    Watched tables count while they are written; :meth:`findings` and :meth:`verify` belong after
    that action (they wait for it).
    """

    def __init__(self) -> None:
        self._watched: list[tuple[Observation, list[Guard], str]] = []

    def watch(self, df: DataFrame, guards: Sequence[Guard], what: str) -> DataFrame:
        for g in guards:
            require_columns(df, g.needs, f"{what} ({g.name})")
        seen = Observation(f"{what}-{uuid.uuid4().hex}")
        self._watched.append((seen, list(guards), what))
        return df.observe(seen, *_counters(guards))

    def findings(self) -> list[Finding]:
        return [f for seen, guards, what in self._watched for f in _findings(seen.get, guards, what)]

    def verify(self) -> None:
        for found in self.findings():
            found.verify()


def asof_guard() -> Guard:
    """G1: nothing after the user's own cutoff reached the aggregates."""
    return Guard(
        "asof",
        F.col("last_tx") > F.col("cutoff"),
        "contain transactions after their cutoff",
        ("last_tx", "cutoff"),
        F.col("last_tx") - F.col("cutoff"),
    )


def cutoff_window_guard(spec: CohortSpec) -> Guard:
    """G1b: the table belongs to this cohort, judged by where its cutoffs lie."""
    lo, hi = cutoff_window(spec)
    return Guard(
        "cutoff_window",
        ~F.col("cutoff").between(lo, hi),
        f"have a cutoff outside {spec.name}'s window {lo}..{hi}",
        ("cutoff",),
        F.col("cutoff"),
    )


def data_end_guard(data_end: int, spec: CohortSpec, window_days: int = 0) -> Guard:
    """G1c: a cutoff past the last day of data turns truncation into a no-op."""
    return Guard(
        "data_end",
        F.col("cutoff") > data_end,
        f"of {spec.name} have a cutoff after the data ends on {data_end}; "
        f"features look {window_days} days back from a day nobody has observed",
        ("cutoff",),
        F.col("cutoff"),
    )


def logs_within_cutoff_guard() -> Guard:
    """G2: no activity after the cutoff."""
    return Guard(
        "logs_within_cutoff",
        F.col("log_min_days_before") < 0,
        "contain activity after the cutoff",
        ("log_min_days_before",),
        -F.col("log_min_days_before"),
    )


def find_repeated_keys(df: DataFrame, key: str = KEY, what: str = "table") -> Finding:
    """G8 as a finding: users with several rows, and the most rows of one user."""
    require_columns(df, [key], what)
    worst = df.groupBy(key).count().filter("count > 1").agg(
        F.count(F.lit(1)).alias("users"), F.max("count").cast("double").alias("rows")
    ).first()
    return Finding("unique_key", what, worst["users"], worst["rows"], "are users that appear more than once")


def check_unique_key(df: DataFrame, key: str = KEY, what: str = "table") -> None:
    """G8: one row per user. Keys are pre-aggregated before the shuffle."""
    find_repeated_keys(df, key, what).verify()


def same_cutoff_guard(log_cutoff: str) -> Guard:
    """G3 on a joined table: both sides were truncated at the same cutoffs."""
    return Guard(
        "logs_match_cohort",
        F.col("cutoff") != F.col(log_cutoff),
        "have log features of another cutoff",
        ("cutoff", log_cutoff),
        F.abs(F.col("cutoff") - F.col(log_cutoff)),
    )


def match_logs_cohort(cohort: DataFrame, logs: DataFrame) -> DataFrame:
    """Users whose cutoff differs between the two sides (must be empty)."""
    require_columns(logs, [KEY, "cutoff"], "log features")
    return (
        cohort.select(KEY, F.col("cutoff"))
        .join(logs.select(KEY, F.col("cutoff").alias("log_cutoff")), KEY, "inner")
        .filter(F.col("cutoff") != F.col("log_cutoff"))
    )


def check_logs_match_cohort(cohort: DataFrame, logs: DataFrame) -> None:
    """G3: both sides were truncated at the same cutoffs."""
    bad = match_logs_cohort(cohort, logs).agg(
        F.count(F.lit(1)).alias("n"), F.min(KEY).alias("example")
    ).first()
    if bad["n"]:
        raise GuardViolation(
            f"logs_match_cohort: {bad['n']} users have different cutoffs on the two sides "
            f"(for example {bad['example']}): these log features belong to another cohort"
        )


def check_labels_are_real(*specs: CohortSpec) -> None:
    """G7: placeholder labels never train or evaluate anything."""
    fake = [s.name for s in specs if not s.labels_are_real]
    if fake:
        raise GuardViolation(f"labels_are_real: {fake} only have placeholder labels")


def cohort_guards(spec: CohortSpec, data_end: int, window_days: int = 0) -> list[Guard]:
    return [asof_guard(), cutoff_window_guard(spec), data_end_guard(data_end, spec, window_days)]


def check_cohort(df: DataFrame, spec: CohortSpec, data_end: int, window_days: int = 0) -> DataFrame:
    """G1, G1b, G1c and G8 on a (stored) cohort table; returns it unchanged."""
    run_guards(df, cohort_guards(spec, data_end, window_days), f"cohort {spec.name}")
    check_unique_key(df, what=f"cohort {spec.name}")
    return df
