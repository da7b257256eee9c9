"""Population stability of features and scores.

Features are compared in passes over one stored wide table that carries a 0/1 flag per comparison
(reference or not; one half or the other, once per round). Every pass aggregates inside the task:
a sketch per feature, counts of the few values near a wanted quantile, counts per bin. What is
shuffled grows with features, bins and tasks, not with rows; what reaches the driver is a sketch
and the edges of each feature.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from renewlens.functions.scalars import seeded_hash
from renewlens.session import stage
from renewlens.sources.schemas import CATEGORICAL, KEY

DEFAULT_BINS = 10
EPSILON = 1e-6
MISSING = "__missing__"
UNSEEN = "__unseen__"
GRID = 500  # quantiles read off a sketch
SKETCH_ACCURACY = 5000
FEW = 64  # estimated distinct values up to which a feature's values are counted


def psi_band(value: Column) -> Column:
    """Conventional reading of a PSI value (a convention, not a test)."""
    return (
        F.when(value < 0.10, "stable").when(value < 0.25, "moderate").otherwise("significant")
    )


def psi_term(p: Column, q: Column, epsilon: float = EPSILON) -> Column:
    """One bin's contribution, both shares floored at epsilon."""
    a, b = F.greatest(p, F.lit(epsilon)), F.greatest(q, F.lit(epsilon))
    return (a - b) * F.ln(a / b)


@dataclass(frozen=True)
class Scheme:
    """Bins of one feature as fitted on the reference side of one round."""

    round: int
    feature: str
    kind: str
    edges: tuple[float, ...]


def paired(reference: DataFrame, current: DataFrame, features: Sequence[str]) -> DataFrame:
    """Both periods' features as one table with the flag ``side0`` of the reference rows."""
    for name, df in (("reference", reference), ("current", current)):
        missing = [c for c in features if c not in df.columns]
        if missing:
            raise ValueError(f"{name} period lacks the columns {missing}")
    return reference.select(*features, F.lit(1).alias("side0")).unionByName(
        current.select(*features, F.lit(0).alias("side0"))
    )


def halves(df: DataFrame, features: Sequence[str], rounds: int, seed: int, key: str = KEY) -> DataFrame:
    """Features with one flag per round: the user's half, a bit of one hash per user."""
    bits = F.conv(F.substring(seeded_hash(seed, key), 1, 15), 16, 10).cast("bigint")
    if not 1 <= rounds <= 60:
        raise ValueError(f"one hash gives 1 to 60 rounds: {rounds}")
    flagged = df.select(*features, bits.alias("bits"))
    return flagged.select(
        *features, *[F.expr(f"cast(shiftright(bits, {r}) & 1 as int)").alias(f"side{r}") for r in range(rounds)]
    )


def _sides(split: DataFrame) -> list[str]:
    return sorted((c for c in split.columns if re.fullmatch(r"side\d+", c)), key=lambda c: int(c[4:]))


def _long(split: DataFrame, features: Sequence[str]) -> DataFrame:
    """A row per row and feature, inside the task only: every use aggregates at once."""
    sides = _sides(split)
    wide = split.select(*sides, *[F.col(c).cast("double").alias(c) for c in features])
    return wide.unpivot(sides, list(features), "feature", "value")


def _counts(sides: Sequence[str]) -> list[Column]:
    return [F.count(F.lit(1)).alias("n"), *[F.sum(s).cast("bigint").alias(s) for s in sides]]


def _edges_below(df: DataFrame, value: str, edges: str, most: int, out: str) -> DataFrame:
    """Adds how many entries of a sorted array of at most ``most`` edges are <= value, by halving.

    A step per halving keeps the generated code short: one term per edge made a method that the JVM
    refuses to compile from some twenty edges on.
    """
    df = df.withColumn(out, F.lit(0))
    for step in reversed([1 << i for i in range(most.bit_length())]):
        low = F.get(F.col(edges), F.col(out) + (step - 1))
        df = df.withColumn(out, F.col(out) + F.when(low <= F.col(value), step).otherwise(0))
    return df


def _constant_map(values: dict[str, str], kind: str) -> Column:
    """A literal map from feature to an array, given as SQL: unlike a joined table it cannot move rows."""
    entries = ", ".join(f"'{f}', {v}" for f, v in values.items())
    return F.expr(f"map({entries})") if entries else F.create_map().cast(f"map<string,{kind}>")


def _with_edges(long: DataFrame, edges: dict[str, list[float]]) -> DataFrame:
    """Rows of the features that have edges, with their bucket number (-1 for null)."""
    table = {f: f"array({', '.join(f'{float(e)!r}D' for e in es)})" if es else "cast(array() as array<double>)" for f, es in edges.items()}
    most = max((len(e) for e in edges.values()), default=0)
    known = long.withColumn("edges", F.try_element_at(_constant_map(table, "array<double>"), F.col("feature")))
    below = _edges_below(known.filter(F.col("edges").isNotNull()), "value", "edges", most, "bucket")
    return below.withColumn("bucket", F.when(F.col("value").isNull(), -1).otherwise(F.col("bucket"))).drop("edges")


def _brackets(sketch: Sequence[float], bins: int, n: int, rounds: int) -> list[float]:
    """Half-open intervals [low, high) around the wanted quantiles, as a flat sorted list.

    Their width covers the sketch's error and, where halves are fitted, five deviations of a half's
    quantile. It decides how many values are looked at, never the result: a quantile outside its
    interval is found in a further pass.
    """
    slack = 3 / GRID + (5 * 0.5 / math.sqrt(max(n, 1)) if rounds > 1 else 0)
    out: list[tuple[float, float]] = []
    for i in range(1, bins):
        lo = sketch[max(0, math.floor((i / bins - slack) * GRID))]
        hi = math.nextafter(sketch[min(GRID, math.ceil((i / bins + slack) * GRID))], math.inf)
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return [e for pair in out for e in pair]


def _wanted(n: int, bins: int) -> dict[int, None]:
    """Ranks next to the inner quantiles of n values."""
    return {k: None for i in range(1, bins) for p in [i / bins * (n - 1)] for k in (math.floor(p), math.ceil(p))}


def _order_statistics(
    long: DataFrame, sides: Sequence[str], brackets: dict[str, list[float]], totals: dict[tuple[str, str], int], bins: int
) -> dict[tuple[str, str], dict[int, float]]:
    """Values at the wanted ranks per (feature, side).

    One pass counts rows per bucket and, inside brackets (odd buckets), per value. Ranks that fall
    between brackets open their bucket for another pass.
    """
    found: dict[tuple[str, str], dict[int, float]] = {k: {} for k in totals}
    todo = {f: e for f, e in brackets.items()}
    inside = {f: set(range(1, len(e), 2)) for f, e in brackets.items()}
    first = True
    while todo:
        # Nulls leave before the edges come: a filter on the bucket would be pushed below and repeat
        # the search for the feature's edges once per edge.
        tagged = _with_edges(long.filter("value is not null"), todo)
        if first:
            opened = F.col("bucket") % 2 == 1
        else:
            table = {f: f"array({', '.join(map(str, sorted(inside[f])))})" for f in todo}
            opened = F.array_contains(F.try_element_at(_constant_map(table, "array<int>"), F.col("feature")), F.col("bucket"))
        value = F.when(opened, F.col("value"))
        counts = stage(tagged.groupBy("feature", "bucket", value.alias("value")).agg(*_counts(sides)), "brackets")
        per = {}
        for r in counts.groupBy("feature", "bucket").agg(*[F.sum(s).alias(s) for s in sides]).collect():
            per[r.feature, r.bucket] = [r[s] for s in sides]
        wanted, again = [], {}
        for f, edges in todo.items():
            for j, side in enumerate(sides):
                before, ranks = 0, [k for k in _wanted(totals[f, side], bins) if k not in found[f, side]] if totals[f, side] else []
                for b in range(len(edges) + 1):
                    size = per.get((f, b), [0] * len(sides))[j]
                    here = [k for k in ranks if before <= k < before + size]
                    if here and b in inside[f]:
                        wanted.append((f, b, j, [k - before for k in here], before))
                    elif here:
                        again.setdefault(f, set()).add(b)
                    before += size
        if wanted:
            asked = long.sparkSession.createDataFrame(wanted, "feature string, bucket int, side int, ranks array<bigint>, before bigint")
            order = Window.partitionBy("feature", "bucket").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
            upto = F.array(*[F.sum(s).over(order) for s in sides])
            running = counts.filter("value is not null").join(asked.select("feature", "bucket").distinct(), ["feature", "bucket"], "left_semi")
            running = running.select("feature", "bucket", "value", upto.alias("upto"), F.array(*sides).alias("own"))
            hit = running.join(asked, ["feature", "bucket"]).select(
                "feature", "side", "before", "value", F.explode("ranks").alias("rank"),
                F.get("upto", F.col("side")).alias("hi"), (F.get("upto", F.col("side")) - F.get("own", F.col("side"))).alias("lo"),
            ).filter("lo <= rank and rank < hi")
            for r in hit.collect():  # two values per inner edge, side and feature at most
                found[r.feature, sides[r.side]][r["rank"] + r.before] = r.value
        todo, inside, first = {f: todo[f] for f in again}, again, False
    return found


def fit_bins(
    split: DataFrame, features: Sequence[str], *, categorical: Sequence[str] = CATEGORICAL, bins: int = DEFAULT_BINS
) -> list[Scheme]:
    """Binning scheme per side and feature; each sees its reference rows only.

    ``split`` (from :func:`paired` or :func:`halves`) should be a stored table: it is read three
    times, column by column, and no row of it is shuffled. Categories and features with at most
    ``bins`` distinct reference values get a bin per value; the rest get deduplicated quantiles,
    exact and interpolated. A feature without a reference value is an error.
    """
    sides = _sides(split)
    long = _long(split, features)
    grid = [i / GRID for i in range(GRID + 1)]
    # With one side the sketch sees its rows alone; halves of one table share a sketch of the whole.
    seen = F.when(F.col(sides[0]) == 1, F.col("value")) if len(sides) == 1 else F.col("value")
    of = {s: F.when(F.col(s) == 1, F.col("value")) for s in sides}
    facts = long.groupBy("feature").agg(
        F.percentile_approx(seen, grid, SKETCH_ACCURACY).alias("sketch"),
        *[F.count(v).alias(f"n_{s}") for s, v in of.items()],
        *[F.approx_count_distinct(v).alias(f"d_{s}") for s, v in of.items()],
    )
    facts = {r.feature: r for r in facts.collect()}
    for f in features:
        if f not in facts or any(not facts[f][f"n_{s}"] for s in sides):
            raise ValueError(f"{f} is null everywhere in the reference")
    # d distinct values can touch d registers at most, so a set of ``bins`` is never estimated over FEW
    few = [f for f in features if f not in categorical and any(facts[f][f"d_{s}"] <= FEW for s in sides)]
    exact: dict[str, list[int]] = {}
    if few:
        values = _long(split, few).filter("value is not null").groupBy("feature", "value").agg(*_counts(sides))
        shown = values.groupBy("feature").agg(*[F.count_if(F.col(s) > 0).alias(s) for s in sides])
        exact = {r.feature: [r[s] for s in sides] for r in shown.collect()}
    kind = {
        (f, s): "category" if f in categorical else "discrete" if f in exact and exact[f][j] <= bins else "quantile"
        for f in features
        for j, s in enumerate(sides)
    }
    cut = [f for f in features if any(kind[f, s] == "quantile" for s in sides)]
    edges: dict[tuple[str, str], tuple[float, ...]] = {}
    if cut:
        totals = {(f, s): facts[f][f"n_{s}"] if kind[f, s] == "quantile" else 0 for f in cut for s in sides}
        brackets = {f: _brackets(facts[f].sketch, bins, max(totals[f, s] for s in sides), len(sides)) for f in cut}
        at = _order_statistics(_long(split, cut), sides, brackets, totals, bins)
        for (f, s), n in totals.items():
            if n:
                got = []
                for i in range(1, bins):
                    p = i / bins * (n - 1)
                    a, b = at[f, s][math.floor(p)], at[f, s][math.ceil(p)]
                    got.append(a + (b - a) * (p - math.floor(p)))
                edges[f, s] = tuple(sorted(set(got)))
    return [Scheme(j, f, kind[f, s], edges.get((f, s), ())) for f in features for j, s in enumerate(sides)]


def scheme_table(spark: SparkSession, schemes: Sequence[Scheme]) -> DataFrame:
    rows = [(x.round, x.feature, x.kind, list(x.edges)) for x in schemes]
    return spark.createDataFrame(rows, "round int, feature string, kind string, edges array<double>")


def _value_label(value: Column) -> Column:
    """The value itself: whole numbers without a fraction, others in their shortest exact form."""
    whole = (F.floor(value).cast("double") == value) & (F.abs(value) < 1e15)
    return F.concat(F.lit("="), F.when(whole, F.expr("try_cast(value as bigint)").cast("string")).otherwise(value.cast("string")))


def _range_label(no: int) -> str:
    """Left-closed range number; zero-padded so that labels sort in bin order."""
    return f"range_{no:02d}"


def apply_bins(split: DataFrame, schemes: Sequence[Scheme]) -> DataFrame:
    """Counts per bin on both sides of every round: round, feature, kind, bin, ref_n, cur_n.

    One pass counts all rounds: quantile features by the finest cut that all their rounds need, the
    others by value, each with one count per round. Structural bins (missing, unseen) and empty
    reference ranges are present with zero counts.
    """
    spark, sides = split.sparkSession, _sides(split)
    cut: dict[str, list[float]] = {}
    for x in schemes:
        if x.kind == "quantile":
            cut[x.feature] = sorted({*cut.get(x.feature, []), *x.edges})
    by_value = sorted({x.feature for x in schemes if x.kind != "quantile"})
    named = spark.createDataFrame(
        [(x.round, x.feature, x.kind) for x in schemes if x.kind != "quantile"], "round int, feature string, kind string"
    )
    per_side = F.array(*[F.struct(F.lit(j).alias("round"), F.col(s).alias("ref_n"), (F.col("n") - F.col(s)).alias("cur_n")) for j, s in enumerate(sides)])
    parts = []
    if cut:
        fine = _with_edges(_long(split, list(cut)), cut).groupBy("feature", "bucket").agg(*_counts(sides))
        target = []
        for x in schemes:
            if x.kind == "quantile":
                target.append((x.round, x.feature, -1, MISSING))
                for b, low in enumerate([-math.inf, *cut[x.feature]]):
                    target.append((x.round, x.feature, b, _range_label(sum(e <= low for e in x.edges))))
        mapped = spark.createDataFrame(target, "round int, feature string, bucket int, bin string")
        fine = fine.select("feature", "bucket", F.inline(per_side))
        # every bucket of every round is listed, so an empty range keeps its row
        parts.append(
            mapped.join(fine, ["round", "feature", "bucket"], "left").select("round", "feature", F.lit("quantile").alias("kind"), "bin", "ref_n", "cur_n")
        )
    if by_value:
        values = _long(split, by_value).groupBy("feature", "value").agg(*_counts(sides))
        values = values.select("feature", "value", F.inline(per_side)).join(named, ["round", "feature"])
        label = (
            F.when(F.col("value").isNull(), MISSING).when(F.col("ref_n") > 0, _value_label(F.col("value"))).otherwise(UNSEEN)
        )
        parts.append(values.select("round", "feature", "kind", label.alias("bin"), "ref_n", "cur_n"))
        zero = named.select("round", "feature", "kind", F.explode(F.array(F.lit(UNSEEN), F.lit(MISSING))).alias("bin"))
        parts.append(zero.select("*", F.lit(0).cast("bigint").alias("ref_n"), F.lit(0).cast("bigint").alias("cur_n")))
    both = reduce(DataFrame.unionByName, parts)
    return both.groupBy("round", "feature", "kind", "bin").agg(
        F.coalesce(F.sum("ref_n"), F.lit(0)).alias("ref_n"), F.coalesce(F.sum("cur_n"), F.lit(0)).alias("cur_n")
    )


def psi_detail(binned: DataFrame, *, epsilon: float = EPSILON) -> DataFrame:
    """Per bin of :func:`apply_bins`: reference and current share and the contribution to the PSI."""
    whole = Window.partitionBy("round", "feature")  # a feature's bins
    shares = binned.select(
        "round",
        "feature",
        "kind",
        "bin",
        (F.col("ref_n") / F.sum("ref_n").over(whole)).alias("reference"),
        (F.col("cur_n") / F.nullif(F.sum("cur_n").over(whole), F.lit(0))).alias("current"),
    )
    checked = shares.withColumn(
        "current",
        F.coalesce(
            F.col("current"),
            F.raise_error(F.lit("the current period has no rows")).cast("double"),
        ),
    )
    return checked.withColumn(
        "contribution", psi_term(F.col("reference"), F.col("current"), epsilon)
    )


def psi(detail: DataFrame) -> DataFrame:
    """Sum over the bins that are filled on at least one side.

    ``epsilon_floored`` says that one side of some bin is empty: the value is
    then set by epsilon rather than by the amount of drift.
    """
    used = (F.col("reference") > 0) | (F.col("current") > 0)
    one_sided = (F.col("reference") > 0) != (F.col("current") > 0)
    missing = F.col("bin") == MISSING
    return detail.groupBy("round", "feature", "kind").agg(
        F.sum(F.when(used, F.col("contribution")).otherwise(0.0)).alias("psi"),
        (F.max(one_sided.cast("int")) == 1).alias("epsilon_floored"),
        F.count(F.lit(1)).alias("n_bins"),
        F.max(F.when(missing, F.col("reference"))).alias("reference_missing"),
        F.max(F.when(missing, F.col("current"))).alias("current_missing"),
        F.min_by("bin", F.struct(-F.round("contribution", 9), F.col("bin"))).alias("top_bin"),
    )


def psi_table(
    reference: DataFrame,
    current: DataFrame,
    features: Sequence[str],
    *,
    categorical: Sequence[str] = CATEGORICAL,
    bins: int = DEFAULT_BINS,
    epsilon: float = EPSILON,
) -> DataFrame:
    """One row per feature: PSI, band, missing rates and the bin that moved most."""
    split = stage(paired(reference, current, features), "periods")
    binned = apply_bins(split, fit_bins(split, features, categorical=categorical, bins=bins))
    return psi(psi_detail(binned, epsilon=epsilon)).select(
        "feature",
        "kind",
        "psi",
        psi_band(F.col("psi")).alias("band"),
        "epsilon_floored",
        "n_bins",
        "reference_missing",
        "current_missing",
        (F.col("current_missing") - F.col("reference_missing")).alias("missing_delta"),
        "top_bin",
    )


def score_psi(
    reference: DataFrame, current: DataFrame, p: str = "p", *, bins: int = DEFAULT_BINS
) -> DataFrame:
    """Drift of the model output. The reference scores must be held out from training."""
    return psi_table(
        reference.select(F.col(p).alias("score")),
        current.select(F.col(p).alias("score")),
        ["score"],
        categorical=(),
        bins=bins,
    )


def noise_floor(
    df: DataFrame,
    features: Sequence[str],
    *,
    rounds: int = 5,
    seed: int = 42,
    categorical: Sequence[str] = CATEGORICAL,
    bins: int = DEFAULT_BINS,
    key: str = KEY,
) -> DataFrame:
    """PSI of a cohort against itself: random halves, several rounds.

    Each round's half is a bit of one hash of (seed, user). No row is repeated per round: bins of
    all rounds are fitted and counted in the passes of a single one.
    """
    if rounds < 2:
        raise ValueError(f"rounds must be at least 2: {rounds}")
    split = stage(halves(df, features, rounds, seed, key), "halves")
    binned = apply_bins(split, fit_bins(split, features, categorical=categorical, bins=bins))
    values = stage(psi(psi_detail(binned)), "noise-psi")
    # One value per round and feature: a few hundred numbers.
    p95 = values.agg(F.percentile("psi", F.lit(0.95))).scalar()
    return values.groupBy("feature").agg(
        F.avg("psi").alias("psi_mean"),
        F.max("psi").alias("psi_max"),
        F.count(F.lit(1)).alias("rounds"),
    ).withColumn("p95_all", p95)


def label_drift(reference: DataFrame, current: DataFrame) -> DataFrame:
    """Churn rates of both periods and their relative change."""
    ref = reference.agg(F.avg("is_churn")).scalar()
    return current.agg(F.avg("is_churn").alias("current_rate")).select(
        ref.alias("reference_rate"),
        "current_rate",
        (F.col("current_rate") / ref - 1).alias("relative_change"),
    )


def list_share(scored: DataFrame, p_star: Column, p: str = "p") -> DataFrame:
    """Share of users above the threshold."""
    return scored.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col(p) > p_star).alias("n_targeted"),
    ).withColumn("share", F.col("n_targeted") / F.col("n"))


def drift_report(
    reference: DataFrame,
    current: DataFrame,
    features: Sequence[str],
    p_star: Column,
    *,
    p: str = "p",
    categorical: Sequence[str] = CATEGORICAL,
    rounds: int = 5,
) -> DataFrame:
    """Features, score, list share and label drift side by side, one row per measure."""
    table = psi_table(reference, current, features, categorical=categorical)
    noise = noise_floor(reference, features, categorical=categorical, rounds=rounds)
    feature_rows = table.join(noise, "feature").select(
        F.lit("feature").alias("measure"),
        F.col("feature").alias("name"),
        F.col("psi").alias("value"),
        F.col("band").alias("reading"),
        (F.col("psi") / F.nullif(F.col("p95_all"), F.lit(0.0))).alias("times_noise"),
    )
    score_rows = score_psi(reference, current, p).select(
        F.lit("score").alias("measure"),
        F.lit(p).alias("name"),
        F.col("psi").alias("value"),
        F.col("band").alias("reading"),
        F.lit(None).cast("double").alias("times_noise"),
    )

    def plain(df: DataFrame, measure: str, name: str, value: str) -> DataFrame:
        return df.select(
            F.lit(measure).alias("measure"),
            F.lit(name).alias("name"),
            F.col(value).cast("double").alias("value"),
            F.lit(None).cast("string").alias("reading"),
            F.lit(None).cast("double").alias("times_noise"),
        )

    shares = plain(list_share(reference, p_star, p), "list_share", "reference", "share").unionByName(
        plain(list_share(current, p_star, p), "list_share", "current", "share")
    )
    labels = plain(label_drift(reference, current), "label", "relative_change", "relative_change")
    return feature_rows.unionByName(score_rows).unionByName(shares).unionByName(labels)
