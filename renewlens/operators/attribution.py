"""Additive explanations of a linear scorer, computed inside each row.

A row's contributions sit in columns of that row, so group totals, the top
groups and their representatives are array expressions: explaining a list of
any length needs no shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from renewlens.functions.scalars import sigmoid
from renewlens.operators.guards import GuardViolation
from renewlens.sources.schemas import KEY

LOCAL_ACCURACY_TOLERANCE = 1e-6


@dataclass(frozen=True)
class LinearScorer:
    """Log-odds = base + sum of weight * (x - mean); a missing x adds its own weight."""

    base: float
    weights: Mapping[str, float]
    means: Mapping[str, float] = field(default_factory=dict)
    missing: Mapping[str, float] = field(default_factory=dict)

    @property
    def features(self) -> tuple[str, ...]:
        return tuple(self.weights)

    def contribution(self, feature: str) -> Column:
        x = F.col(feature).cast("double")
        known = (x - F.lit(float(self.means.get(feature, 0.0)))) * F.lit(
            float(self.weights[feature])
        )
        return F.when(x.isNull(), F.lit(float(self.missing.get(feature, 0.0)))).otherwise(known)

    def log_odds(self) -> Column:
        return reduce(
            lambda acc, f: acc + self.contribution(f), self.features, F.lit(float(self.base))
        )

    def probability(self, z: Column) -> Column:
        return sigmoid(z)

    def score(self, df: DataFrame, out: str = "p", *, contributions: bool = True) -> DataFrame:
        """Contributions are expressions of the features: there are no columns to add."""
        return df.withColumn(out, self.probability(self.log_odds()))


def attribute(df: DataFrame, scorer: LinearScorer, carry: Sequence[str] = ()) -> DataFrame:
    """Long table (user, feature, shap, value) plus the base of every row."""
    parts = F.array(
        *[
            F.struct(
                F.lit(f).alias("feature"),
                scorer.contribution(f).alias("shap"),
                F.col(f).cast("double").alias("value"),
            )
            for f in scorer.features
        ]
    )
    return df.select(
        KEY, *carry, F.lit(float(scorer.base)).alias("base"), F.explode(parts).alias("a")
    ).select(KEY, *carry, "base", "a.feature", "a.shap", "a.value")


def local_accuracy(df: DataFrame, scorer: LinearScorer, p: str = "p") -> DataFrame:
    """Largest difference between the explained and the reported probability."""
    gap = F.abs(scorer.probability(scorer.log_odds()) - F.col(p))
    return df.agg(F.count(F.lit(1)).alias("n"), F.max(gap).alias("max_gap"))


def assert_local_accuracy(
    df: DataFrame, scorer: LinearScorer, p: str = "p", tolerance: float = LOCAL_ACCURACY_TOLERANCE
) -> float:
    """Raise when explanations do not add up to the reported probability."""
    row = local_accuracy(df, scorer, p).first()
    if row["n"] and (row["max_gap"] is None or row["max_gap"] > tolerance):
        raise GuardViolation(
            f"local_accuracy: explanations miss the score by up to {row['max_gap']} "
            f"(tolerance {tolerance})"
        )
    return float(row["max_gap"] or 0.0)


def _group_order(features: Sequence[str], groups: Mapping[str, str] | None) -> dict[str, list[str]]:
    """Group -> member features, in order of first appearance."""
    if groups is None:
        return {f: [f] for f in features}
    unmapped = [f for f in features if f not in groups]
    if unmapped:
        raise KeyError(f"features without a group: {unmapped}")
    out: dict[str, list[str]] = {}
    for f in features:
        out.setdefault(groups[f], []).append(f)
    return out


def group_contributions(
    df: DataFrame, scorer: LinearScorer, groups: Mapping[str, str] | None
) -> DataFrame:
    """Exact sum per semantic group, long form."""
    parts = [
        F.struct(
            F.lit(g).alias("group"),
            reduce(lambda a, b: a + b, [scorer.contribution(f) for f in members]).alias(
                "group_shap"
            ),
        )
        for g, members in _group_order(scorer.features, groups).items()
    ]
    return df.select(KEY, F.explode(F.array(*parts)).alias("g")).select(KEY, "g.*")


def representative_in_group(scorer: LinearScorer, members: Sequence[str]) -> Column:
    """The member with the largest contribution; the earlier feature on ties."""
    return F.array_max(
        F.array(
            *[
                F.struct(
                    scorer.contribution(f).alias("shap"),
                    F.lit(-i).alias("order"),
                    F.lit(f).alias("feature"),
                    F.col(f).cast("double").alias("value"),
                )
                for i, f in enumerate(members)
            ]
        )
    )


def strongest_groups(
    scorer: LinearScorer, groups: Mapping[str, str] | None, k: int = 3, min_shap: float = 0.0
) -> Column:
    """Up to ``k`` groups of a row whose totals exceed ``min_shap``, strongest first, as an array."""
    if k < 1:
        raise ValueError(f"k must be positive: {k}")
    candidates = []
    for no, (group, members) in enumerate(_group_order(scorer.features, groups).items()):
        total = reduce(lambda a, b: a + b, [scorer.contribution(f) for f in members])
        candidates.append(
            F.struct(
                (-total).alias("minus_total"),
                F.lit(no).alias("group_no"),
                F.lit(group).alias("group"),
                representative_in_group(scorer, members).alias("rep"),
            )
        )
    return F.slice(
        F.array_sort(
            F.filter(F.array(*candidates), lambda g: -g["minus_total"] > F.lit(float(min_shap)))
        ),
        1,
        k,
    )


def top_contributors(
    df: DataFrame,
    scorer: LinearScorer,
    *,
    groups: Mapping[str, str] | None = None,
    k: int = 3,
    min_shap: float = 0.0,
    carry: Sequence[str] = (),
    keep_empty: bool = False,
) -> DataFrame:
    """Up to ``k`` groups per user that push the risk up, strongest first.

    Only totals above ``min_shap`` qualify; a user with fewer gets fewer. With
    ``keep_empty`` a user without any keeps one row of nulls.
    """
    strongest = strongest_groups(scorer, groups, k, min_shap)
    rows = df.select(KEY, *carry, strongest.alias("strongest"))
    return rows.select(
        KEY,
        *carry,
        (-F.try_element_at("strongest", F.lit(1))["minus_total"]).alias("top_shap"),
        (F.posexplode_outer if keep_empty else F.posexplode)("strongest").alias("pos", "g"),
    ).select(
        KEY,
        *carry,
        "top_shap",
        (F.col("pos") + 1).alias("rank"),
        F.col("g.group").alias("group"),
        (-F.col("g.minus_total")).alias("group_shap"),
        F.col("g.rep.feature").alias("feature"),
        F.col("g.rep.shap").alias("feature_shap"),
        F.col("g.rep.value").alias("value"),
    )


def mean_abs_attribution(df: DataFrame, scorer: LinearScorer) -> DataFrame:
    """Global mean absolute contribution per feature: one aggregate row, then unpivoted."""
    means = df.agg(*[F.avg(F.abs(scorer.contribution(f))).alias(f) for f in scorer.features])
    return means.unpivot([], list(scorer.features), "feature", "mean_abs_shap")
