"""Quality selection by importance resampling.

Words and pairs of words are hashed to ``BUCKETS`` buckets. Two bag-of-n-grams models, one of the
target text and one of all raw text, give each document the log ratio of its likelihoods; adding
Gumbel noise from a hash of its id and keeping the k largest draws k documents without replacement
in proportion to that ratio.

The raw model counts every document whole. The target model takes the documents labelled good, at
most ``SAMPLE`` of them (first in hash order). The k-th largest key is found by counting in ever
finer bins of all keys, so nothing is sorted in one task.

Defined results: null or empty text has weight 0; documents tied with the k-th key are kept with it;
without target documents all weights are 0 and the draw is uniform; rows with equal ids share their
noise; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from renewlens.llm.common import byte_texts, table, word_hashes
from renewlens.session import stage

BUCKETS = 10_000
SAMPLE = 20_000  # labelled documents of the target model
FRACTION = 0.75  # of the documents that is kept
SMOOTHING = 1.0
SEED = 2024
BINS = 1024
LAST = 10_000  # keys sorted at the end of the search for the k-th


def _features(words: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket numbers of all words and all pairs of successive words."""
    mixed = (words[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ (words[1:] >> np.uint64(7))
    pairs = mixed * np.uint64(0xD1342543DE82EF95)
    n = np.uint64(buckets)
    return np.concatenate([(words >> np.uint64(11)) % n, (pairs >> np.uint64(11)) % n]).astype(np.int64)


def bucket_counts(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``docs`` (text, is_target) -> bucket, raw, target: n-grams of all and of target documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, buckets), np.int64)
        for b in batches:
            for h, good in zip(word_hashes(byte_texts(b.column(0))), b.column(1).to_pylist()):
                if len(h):
                    c = np.bincount(_features(h, buckets), minlength=buckets)
                    sums[0] += c
                    if good:
                        sums[1] += c
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(buckets)), pa.array(sums[0]), pa.array(sums[1])], names=["bucket", "raw", "target"]
        )

    # one row per bucket and task
    return (
        docs.mapInArrow(count, "bucket bigint, raw bigint, target bigint")
        .groupBy("bucket")
        .agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    )


def log_ratios(counts: DataFrame, buckets: int = BUCKETS, smoothing: float = SMOOTHING) -> np.ndarray:
    """Log ratio of target to raw probability per bucket; ``buckets`` numbers."""
    raw, target = np.zeros(buckets), np.zeros(buckets)
    for r in counts.collect():
        raw[r.bucket], target[r.bucket] = r.raw, r.target
    if not target.sum():
        return np.zeros(buckets)
    return np.log((target + smoothing) / (target.sum() + smoothing * buckets)) - np.log(
        (raw + smoothing) / (raw.sum() + smoothing * buckets)
    )


def weigh(docs: DataFrame, ratios: np.ndarray, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and log_weight of every document."""
    sent = docs.sparkSession.sparkContext.broadcast(ratios)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_ = sent.value
        for b in batches:
            out = [
                float(table_[_features(h, len(table_))].sum()) if len(h) else 0.0
                for h in word_hashes(byte_texts(b.column(1)))
            ]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.float64())], names=["doc_id", "log_weight"])

    rows = docs.select(F.col(key).cast("bigint").alias("k"), F.col(text).cast("string").alias("t"))
    return rows.mapInArrow(run, "doc_id bigint, log_weight double")


def kth_largest(keys: DataFrame, k: int, column: str = "key") -> float | None:
    """The k-th largest of a column; None if there are no more than k rows."""
    if keys.count() <= k:
        return None
    c = F.col(column)
    low, high = keys.agg(F.min(c), F.max(c)).first()
    above = 0  # rows over ``high``
    while True:
        inside = keys.where((c >= low) & (c <= high))
        if high <= low:
            return low
        width = (high - low) / BINS
        number = F.least(F.floor((c - low) / width), F.lit(BINS - 1)).cast("int")
        bins = sorted(
            inside.groupBy(number.alias("b")).agg(F.count("*").alias("n"), F.min(c).alias("lo"), F.max(c).alias("hi")).collect(),
            reverse=True,
        )
        for b in bins:
            if above + b.n >= k:
                break
            above += b.n
        low, high = b.lo, b.hi
        if b.n <= LAST:
            last = keys.where((c >= low) & (c <= high)).select(c.alias("x")).orderBy(F.desc("x")).collect()
            return last[k - above - 1].x


def resample(docs: DataFrame, labels: DataFrame, *, fraction: float = FRACTION, seed: int = SEED) -> DataFrame:
    """doc_id, log_weight, key, kept of every document."""
    good = (
        labels.where("quality = 1 and doc_id is not null")
        .select("doc_id")
        .distinct()
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(SAMPLE)
        .select(F.col("doc_id").alias("good_id"))
    )
    # at most SAMPLE ids
    marked = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(
        F.broadcast(good), F.col("doc_id") == F.col("good_id"), "left"
    )
    ratios = log_ratios(bucket_counts(marked.select("text", F.col("good_id").isNotNull().alias("is_target"))))
    uniform = (F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)
    keyed = stage(
        weigh(docs, ratios).withColumn("key", F.col("log_weight") - F.log(-F.log(uniform))), "importance"
    )
    k = int(np.ceil(keyed.count() * fraction))
    least = kth_largest(keyed, k) if k else float("inf")
    return keyed.withColumn("kept", F.lit(True) if least is None else F.col("key") >= F.lit(least))


def op2_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
