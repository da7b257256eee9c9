"""Mixing sources to target weights by entropy balancing.

Each document gets a distribution over 0, 1, 2 copies: binomial (2, 1/2), the plain pass, tilted
exponentially by copies x tokens so that every source's expected tokens equal its target and the
relative entropy to the plain pass is least. With one token constraint per source the convex dual
has one multiplier per source; the rate is 2 * sigmoid(multiplier * size / mean size). All sources
take their Newton steps at once, each iteration one grouped pass over the (source, size) histogram,
guarded by a bracket. Rates are then fixed-point numbers, and all sums are integers, so reruns agree.

Rounding is systematic: in the order of size, hash and id a document takes the whole numbers that
the running sum of rates passes. The error of a source's tokens is then at most about twice its
largest document; of ``PHASES`` shifts of the grid the one nearest the target is kept. Running sums
are taken over classes of equal size, and inside a class over hash buckets, so a source or a size
that holds most rows is never in one task.

Defined results: null text has size 0; a null source is a source of its own, ordered last; a source
without words has target 0 and its documents one copy (no words); repeated rows are documents of
their own; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from renewlens.llm.common import by_row, row_key, table
from renewlens.session import stage

SHARE = 1.5  # tokens of the mix, as a multiple of all tokens
MOST = 2  # copies of a document, and of a source's tokens
WEIGHTS = (5, 2, 1)
ONE = 1 << 20  # fixed-point unit of a rate
PHASES = 32
BUCKETS = 256
ROUNDS = 60
CLOSE = 1e-9


def sized(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """``docs`` with ``size``: runs of characters other than space and \\t..\\r."""
    words = F.regexp_count(F.coalesce(F.col(text).cast("string"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))
    return docs.withColumn("size", words.cast("bigint"))


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE) -> DataFrame:
    """source, source_size, target: ``share`` of all tokens by weight, none above twice its source.

    Resharing the excess by weight until none is above fills every source to the same level per
    weight, or to its own limit; in the order of limit / weight the level follows from running
    sums. One row per source passes through these windows.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    ranked = by_source.withColumn("weight", weight).withColumn("limit", F.col("source_size") * float(MOST))
    every = Window.partitionBy()
    upto = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").isNull(), "source")
    filled = (
        ranked.withColumn("want", F.sum("source_size").over(every) * F.lit(share))
        .withColumn("before", F.sum("limit").over(upto) - F.col("limit"))
        .withColumn("rest", F.sum("weight").over(every) - F.sum("weight").over(upto) + F.col("weight"))
        # the level if all sources before this one are at their limit and this one is not
        .withColumn("level", (F.col("want") - F.col("before")) / F.col("rest"))
        .withColumn("full", F.col("level") * F.col("weight") >= F.col("limit"))
    )
    # past the first source below its limit the levels only fall
    level = F.max(F.when(~F.col("full"), F.col("level"))).over(every)
    target = F.when(F.col("full"), F.col("limit")).otherwise(F.least(level * F.col("weight"), "limit"))
    return filled.select("source", "source_size", target.cast("double").alias("target"))


def multipliers(classes: DataFrame, targets: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """source -> multiplier, by guarded Newton steps on the dual of every source at once.

    ``classes`` holds source, size and n, the number of documents of that source and size.
    """
    mean = targets.join(
        classes.groupBy("source").agg(F.sum("n").alias("docs")).withColumnRenamed("source", "s"),
        F.col("source").eqNullSafe(F.col("s")),
    ).select(
        "source",
        "target",
        (F.col("source_size") / F.col("docs")).alias("mean"),
        # the two ends have no finite multiplier: all copies, or none
        ((F.col("target") > 0) & (F.col("target") < F.col("source_size") * float(MOST))).alias("open"),
    )
    state = stage(
        mean.select(
            "*",
            F.lit(0.0).alias("x"),
            F.lit(None).cast("double").alias("low"),
            F.lit(None).cast("double").alias("high"),
            F.lit(1.0).alias("miss"),
        ),
        "multipliers",
    )
    for _ in range(rounds):
        ratio = F.col("size") / F.col("mean")
        sigma = 1 / (1 + F.exp(-F.col("x") * ratio))
        # integer sums: the same whatever order the tasks finish in
        whole = lambda c: F.sum(F.round(c * 1e6).cast("decimal(38,0)")).cast("double") / 1e6
        sums = (
            classes.join(
                state.where("open").select(F.col("source").alias("s"), "x", "mean"),
                F.col("source").eqNullSafe(F.col("s")),
            )
            .groupBy("s")
            .agg(
                whole(F.col("n") * F.col("size") * MOST * sigma).alias("taken"),
                whole(F.col("n") * F.col("size") * ratio * MOST * sigma * (1 - sigma)).alias("slope"),
            )
        )
        gap = F.col("taken") - F.col("target")
        low = F.when(gap < 0, F.greatest("low", "x")).otherwise(F.col("low"))
        high = F.when(gap > 0, F.least("high", "x")).otherwise(F.col("high"))
        step = F.col("x") - gap / F.col("slope")
        out_of_bracket = (F.col("slope") <= 0) | (step <= F.col("low2")) | (step >= F.col("high2"))
        inside = (
            F.when(F.col("low2").isNotNull() & F.col("high2").isNotNull(), (F.col("low2") + F.col("high2")) / 2)
            .when(gap < 0, F.col("x") * 2 + 1)
            .otherwise(F.col("x") * 2 - 1)
        )
        state = stage(
            state.join(sums, F.col("source").eqNullSafe(F.col("s")), "left")
            .withColumn("low2", low)
            .withColumn("high2", high)
            .withColumn("next", F.when(F.coalesce(out_of_bracket, F.lit(False)), inside).otherwise(step))
            .select(
                "source",
                "target",
                "mean",
                "open",
                F.when(F.abs(gap) <= F.col("target") * CLOSE, F.col("x"))
                .otherwise(F.coalesce(F.greatest(F.least("next", F.col("x") + 8), F.col("x") - 8), F.col("x")))
                .alias("x"),
                F.col("low2").alias("low"),
                F.col("high2").alias("high"),
                F.coalesce(F.abs(gap) / F.col("target"), F.lit(0.0)).alias("miss"),
            ),
            "multipliers",
        )
        if (state.agg(F.max("miss")).first()[0] or 0.0) <= CLOSE:
            break
    return state.select("source", "target", "mean", "open", "x")


def _passed(total, rate, shift):
    """Whole copies that a running sum (fixed point) passes when it grows by ``rate``."""
    return F.shiftright(total + rate + shift, 20) - F.shiftright(total + shift, 20)


def mix(docs: DataFrame, *, row: Column | None = None, weights: tuple = WEIGHTS, share: float = SHARE) -> DataFrame:
    """``docs`` (with source and size) -> row_key, doc_id, source, size, source_size, target, rate, copies.

    ``row`` is a key of the row; the hash of all columns unless given.
    """
    rows = stage(
        docs.select((row_key(docs) if row is None else row).alias("row_key"), "doc_id", F.col("source").cast("string").alias("source"), "size"),
        "sizes",
    )
    classes = stage(rows.groupBy("source", "size").agg(F.count("*").alias("n")), "size-classes")
    targets = stage(
        source_targets(classes.select("source", (F.col("size") * F.col("n")).alias("size")), weights, share), "targets"
    )
    tilt = multipliers(classes, targets)
    sigma = 1 / (1 + F.exp(-F.col("x") * F.col("size") / F.col("mean")))
    rate = (
        F.when(F.col("open"), F.round(MOST * sigma * ONE))
        .when(F.col("size") == 0, F.lit(ONE))
        .when(F.col("target") > 0, F.lit(MOST * ONE))
        .otherwise(0)
        .cast("bigint")
    )
    rated = classes.join(tilt.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).select(
        "source", "size", "n", "target", rate.alias("rate")
    )
    by_size = Window.partitionBy("source").orderBy("size")
    mass = F.col("n") * F.col("rate")
    rated = stage(rated.withColumn("before", F.sum(mass).over(by_size) - mass), "rates")

    shifts = [ONE * p // PHASES for p in range(PHASES)]
    taken = [
        F.sum(F.col("size") * _passed(F.col("before"), mass, F.lit(s).cast("bigint"))).alias(f"t{p}")
        for p, s in enumerate(shifts)
    ]
    totals = rated.groupBy("source").agg(F.first("target").alias("target"), *taken)
    nearest = F.array_min(
        F.array(
            *[
                F.struct(F.abs(F.col(f"t{p}") - F.col("target")).alias("gap"), F.lit(s).cast("bigint").alias("shift"))
                for p, s in enumerate(shifts)
            ]
        )
    )
    phase = totals.select(F.col("source").alias("s"), nearest["shift"].alias("shift"))
    rated = rated.join(phase, F.col("source").eqNullSafe(F.col("s"))).drop("s", "n")
    rated = rated.join(
        targets.select(F.col("source").alias("s"), "source_size"), F.col("source").eqNullSafe(F.col("s"))
    ).drop("s")

    # the place of a document in its class: bucket offsets plus the place in the bucket
    hashed = rows.withColumn("h", F.xxhash64("row_key", F.lit(7))).withColumn("bucket", F.pmod("h", F.lit(BUCKETS)))
    buckets = hashed.groupBy("source", "size", "bucket").agg(F.count("*").alias("n"))
    offset = F.sum("n").over(Window.partitionBy("source", "size").orderBy("bucket")) - F.col("n")
    placed = (
        buckets.withColumn("offset", offset)
        .join(
            rated.withColumnsRenamed({"source": "s", "size": "z"}),
            F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")),
        )
        .select(
            F.col("s"),
            F.col("z"),
            F.col("bucket").alias("b"),
            (F.col("before") + F.col("offset") * F.col("rate") + F.col("shift")).alias("start"),
            "rate",
            "target",
            "source_size",
        )
    )
    inside = F.row_number().over(Window.partitionBy("source", "size", "bucket").orderBy("h", "doc_id")) - 1
    return (
        hashed.withColumn("inside", inside)
        .join(
            placed,
            F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")) & (F.col("bucket") == F.col("b")),
        )
        .select(
            "row_key",
            "doc_id",
            "source",
            "size",
            "source_size",
            "target",
            (F.col("rate") / ONE).alias("rate"),
            _passed(F.col("start") + F.col("inside") * F.col("rate"), F.col("rate"), F.lit(0)).alias("copies"),
        )
    )


def mixed(docs: DataFrame) -> DataFrame:
    """Every row of ``docs`` as often as the mix takes it, all columns kept."""
    rows = sized(docs.select(row_key(docs).alias("key"), "doc_id", "source", "text"))
    return by_row(docs, mix(rows, row=F.col("key")).select("row_key", "copies"))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mix(sized(table(spark, sf_dir, "documents").select("doc_id", "source", "text")))
    return found.select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (F.col("copies") * F.col("size")).cast("bigint").alias("taken"),
        "source",
        "rate",
        "copies",
    )
