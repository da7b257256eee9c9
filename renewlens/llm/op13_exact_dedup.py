"""Exact deduplication in batches: immutable snapshots screened by binary-fuse filters.

A batch becomes a snapshot once: one row per distinct normalised text, with the smallest id and the
number of rows, in exact buckets by digest, and beside it static binary-fuse filters over its
digests. A later batch first groups its own equal texts (partial sums on the map side, so a text
that a third of all rows hold is one row per task before the shuffle), then asks each earlier
snapshot's filters, and only texts that a filter lets through meet that snapshot's exact buckets,
where their bytes are compared. Snapshots are never changed; a text that is in several belongs to
the oldest.

The buckets are Spark bucketed tables: batch and snapshot join on the digest without moving texts.
Grouping by digest carries the least and the greatest text; if they differ the digest has collided
and its rows are grouped again by their texts, each a variant of its own.

Defined results: null text is empty; white space runs (x20, x09-x0D) are one space, not trimmed; a
null id is after all others, ``keep_id`` is null only if all ids of the text are; of rows alike in id
and text one stays; empty tables give no rows; other columns have no effect.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from renewlens.llm.common import by_row, row_key, table, workers_find_package
from renewlens.llm.fuse_filter import FuseFilter
from renewlens.session import stage, staging_root

SHARD_KEYS = 1 << 20  # keys of one filter
BATCHES = 2  # the query's documents: this many ranges of ids, each screened against those before

_FILTERS = "shard bigint, filter binary"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def sha256(norm: Column) -> Column:
    return F.unhex(F.sha2(norm, 256))


@dataclass(frozen=True)
class Snapshot:
    """Distinct texts of one batch: ``texts`` (digest, variant, norm, keep_id, n) in buckets by
    digest, ``filters`` (shard, filter), and the number of filter shards."""

    texts: DataFrame
    filters: DataFrame
    shards: int


def _bucketed(rows: DataFrame) -> DataFrame:
    """``rows`` written in as many buckets by digest as a shuffle has partitions."""
    spark, name = rows.sparkSession, f"renewlens_{uuid.uuid4().hex}"
    path = f"{staging_root(spark)}/renewlens/{name}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows.write.format("parquet").bucketBy(buckets, "digest").option("path", path).saveAsTable(name)
    written = spark.table(name)
    written.schema  # resolved before the name goes; the files stay
    spark.sql(f"DROP TABLE {name}")
    return written


def _grouped(batch: DataFrame) -> DataFrame:
    """(digest, norm, id) -> one row per distinct text: digest, variant, norm, keep_id, n."""
    size = [F.min("id").alias("keep_id"), F.count("*").alias("n")]
    groups = batch.groupBy("digest").agg(F.min("norm").alias("norm"), F.max("norm").alias("other"), *size)
    return groups.select("digest", F.lit(0).alias("variant"), "norm", "keep_id", "n", (F.col("norm") != F.col("other")).alias("mixed"))


def _key(digest: str = "digest") -> Column:
    return F.xxhash64(digest)


def _keys_of(texts: DataFrame, shards: int) -> DataFrame:
    return texts.select(F.pmod(_key(), F.lit(shards)).alias("shard"), _key().alias("k"), "digest")


def _build(t: pa.Table) -> pa.Table:
    keys = np.asarray(t["k"]).view(np.uint64)
    return pa.table({"shard": t["shard"][:1], "filter": pa.array([FuseFilter.build(keys).to_bytes()], pa.binary())})


def _probe(keys: pa.Table, filters: pa.Table) -> pa.Table:
    if not (keys.num_rows and filters.num_rows):
        return keys.select(["digest"]).slice(0, 0)
    held = FuseFilter.from_bytes(filters["filter"][0].as_py()).may_hold(np.asarray(keys["k"]).view(np.uint64))
    return keys.select(["digest"]).filter(pa.array(held))


def take_snapshot(batch: DataFrame) -> Snapshot:
    """Snapshot of a batch with columns digest, norm, id."""
    workers_find_package(batch.sparkSession)
    texts = _bucketed(_grouped(batch))
    mixed = texts.where("mixed").select("digest")
    if not mixed.isEmpty():  # collided digests: by their texts
        mixed = stage(mixed, "collided")
        again = batch.join(mixed, "digest", "left_semi").groupBy("digest", "norm")
        again = again.agg(F.min("id").alias("keep_id"), F.count("*").alias("n"))
        again = again.withColumn("variant", F.row_number().over(Window.partitionBy("digest").orderBy("norm")))
        texts = _bucketed(texts.where("not mixed").drop("mixed").unionByName(again))
    else:
        texts = texts.drop("mixed")
    shards = max(1, -(-texts.count() // SHARD_KEYS))
    filters = _keys_of(texts, shards).select("shard", "k").distinct().groupBy("shard").applyInArrow(_build, _FILTERS)
    return Snapshot(texts, stage(filters, "filters"), shards)


def screen(new: Snapshot, old: Snapshot) -> DataFrame:
    """Digests of ``new`` that a filter of ``old`` lets through."""
    keys = _keys_of(new.texts, old.shards).distinct().groupBy("shard")
    return keys.cogroup(old.filters.groupBy("shard")).applyInArrow(_probe, "digest binary")


def matches(new: Snapshot, old: Snapshot) -> DataFrame:
    """Texts of ``new`` whose bytes are in ``old``: digest, variant, old_variant."""
    through = stage(screen(new, old), "screened").distinct()
    theirs = old.texts.select("digest", F.col("variant").alias("old_variant"), F.col("norm").alias("old_norm"))
    both = through.join(new.texts, "digest").join(theirs, "digest")
    # as an equality it would become a key of the join, and the texts would be shuffled by it
    return both.where("norm >= old_norm and norm <= old_norm").select("digest", "variant", "old_variant")


def classes(snapshots: list[Snapshot]) -> DataFrame:
    """Distinct texts over all snapshots, oldest first: digest, root (snapshot and variant that hold
    the text first), keep_id, group_size; one row per snapshot's text, with its own variant."""
    rows = None
    for b, new in enumerate(snapshots):
        own = new.texts.select("digest", "variant", "keep_id", "n")
        links = None
        for s, old in enumerate(snapshots[:b]):
            found = matches(new, old).select("digest", "variant", F.struct(F.lit(s).alias("at"), "old_variant").alias("first"))
            links = found if links is None else links.unionByName(found)
        here = F.struct(F.lit(b).alias("at"), F.col("variant").alias("old_variant"))
        if links is None:
            own = own.withColumn("root", here)
        else:
            first = links.groupBy("digest", "variant").agg(F.min("first").alias("first"))
            own = own.join(first, ["digest", "variant"], "left").withColumn("root", F.coalesce("first", here)).drop("first")
        own = own.withColumn("batch", F.lit(b))
        rows = own if rows is None else rows.unionByName(own)
    return stage(rows, "classes")


def exact_dedup(
    docs: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    batches: int = BATCHES,
    digest: Callable[[Column], Column] = sha256,
) -> DataFrame:
    """One row per row of ``docs``: id, digest, row_key, keep_id, group_size, kept.

    ``docs`` are taken as ``batches`` ranges of ids, in ascending order.
    """
    row = docs.select(F.col(key).cast("bigint").alias("id"), normalised(F.col(text)).alias("norm"), row_key(docs).alias("row_key"))
    row = row.withColumn("digest", digest(F.col("norm")))
    parts = [k / batches for k in range(1, batches)]
    cuts = docs.agg(F.percentile_approx(F.col(key).cast("bigint"), F.array(*map(F.lit, parts)), 10_000)).first()[0] if parts else []
    place = F.lit(0)
    for cut in sorted(set(cuts or [])):
        place = place + F.coalesce(F.col("id") > cut, F.lit(True)).cast("int")
    count = len(set(cuts or [])) + 1
    taken = [take_snapshot(row.where(place == b).select("digest", "norm", "id")) for b in range(count)]
    of_text = classes(taken)
    total = of_text.groupBy("digest", "root").agg(F.min("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))
    total = stage(total, "totals")

    # rows of one id and text are numbered per reading task, so that a hot one is never one group
    rows = row.withColumn("batch", place).withColumn("part", F.spark_partition_id())
    own = ["digest", "id", "batch", "row_key", "part"]
    several = total.groupBy("digest").agg(F.count("*").alias("c")).where("c > 1").select("digest")
    if several.isEmpty():
        rows = stage(rows.groupBy(*own).agg(F.count("*").alias("m")), "rows")
        named = rows.join(total.drop("root"), "digest")
        same = ["digest", "id"]
    else:  # a collided digest says too little: its rows find their class by their texts
        several = stage(several, "collided")
        plain = rows.join(several, "digest", "left_anti").groupBy(*own).agg(F.count("*").alias("m"))
        plain = plain.join(total, "digest")
        texts = None
        for b, snap in enumerate(taken):
            t = snap.texts.join(several, "digest", "left_semi").select("digest", "norm", "variant", F.lit(b).alias("batch"))
            texts = t if texts is None else texts.unionByName(t)
        texts = texts.join(of_text.select("digest", "variant", "batch", "root"), ["digest", "variant", "batch"])
        mixed = rows.join(several, "digest", "left_semi").groupBy("norm", *own).agg(F.count("*").alias("m"))
        mixed = mixed.join(texts, ["digest", "norm", "batch"]).drop("norm", "variant").join(total, ["digest", "root"])
        named = stage(plain.unionByName(mixed.select(plain.columns)), "rows")
        same = ["digest", "root", "id"]
    nth = F.row_number().over(Window.partitionBy(*same).orderBy("row_key", "part"))
    stays = named.where(F.col("id").eqNullSafe(F.col("keep_id")))
    stays = stays.withColumn("nth", nth)
    rest = named.where(~F.col("id").eqNullSafe(F.col("keep_id"))).withColumn("nth", F.lit(0))
    each = stays.unionByName(rest).withColumn("i", F.explode(F.sequence(F.lit(1), F.col("m").cast("int"))))
    kept = (F.col("nth") == 1) & (F.col("i") == 1)
    return each.select("id", "digest", "row_key", "keep_id", F.col("group_size").cast("bigint"), kept.alias("kept"))


def keep_first(docs: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    rows = exact_dedup(docs, **settings).select("row_key", F.col("kept").cast("int").alias("copies"))
    return by_row(docs, stage(rows, "kept"))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = exact_dedup(table(spark, sf_dir, "documents"))
    return got.select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


ORACLE = r"""
WITH d AS (
    SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
    FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
    doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
