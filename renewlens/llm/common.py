"""Helpers shared by the operators: reading tables, text buffers, word hashing, row keys."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from renewlens.session import stage

CHUNK = 1 << 20  # bytes hashed at once


def workers_find_package(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it.

    Workers that have it installed (or got it by --py-files) are not affected.
    """
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (env.get("PYTHONPATH"), root) if x)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    workers_find_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_key(df: DataFrame) -> Column:
    """64-bit key of a whole row; rows that agree in every column (maps apart) share it."""
    return F.xxhash64(*[F.col(f"`{c}`") for c, kind in df.dtypes if "map<" not in kind])


def by_row(docs: DataFrame, copies: DataFrame) -> DataFrame:
    """Each row of ``docs`` as often as ``copies`` (row_key, copies) says in sum for its key.

    Rows that share a key are alike; they are made one before they are repeated, in a branch of
    their own, so that a table without repeated rows is not grouped by its texts.
    """
    key, times = "__row_key", "__copies"
    total = copies.groupBy("row_key").agg(F.sum("copies").cast("int").alias(times), F.count("*").alias("n"))
    total = total.where(F.col(times) > 0)
    keyed = docs.withColumn(key, row_key(docs))
    joined = lambda rows, t: rows.join(t.withColumnRenamed("row_key", key), key)
    single = joined(keyed, total.where("n = 1").drop("n"))
    several = total.where("n > 1").drop("n")
    if not several.isEmpty():
        single = single.unionByName(joined(keyed, several).dropDuplicates([key]))
    return single.withColumn(times, F.explode(F.sequence(F.lit(1), F.col(times)))).drop(key, times)


def byte_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of every text of an Arrow column; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def str_texts(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


# --- 64-bit hashes of all words of a buffer in a few vector passes ----------------------
#
# A word is a run of ASCII letters, digits and non-ASCII bytes; A-Z count as a-z. The hash is
# the polynomial sum of per-byte weights, taken from one running sum over the buffer and
# shifted to the word's start by the inverse power, then mixed.

_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def _weights() -> np.ndarray:
    out = []
    for b in range(256):
        b = b + 32 if 65 <= b <= 90 else b
        z = (b + 1) * 0xD1342543DE82EF95 & _MASK
        z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 & _MASK
        z = (z ^ z >> 27) * 0x94D049BB133111EB & _MASK
        out.append(z ^ z >> 31)
    return np.array(out, np.uint64)


_WEIGHT = _weights()
_IN_WORD = np.array([48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)])
_powers: dict[str, np.ndarray] = {}


def _power(kind: str, base: int, n: int) -> np.ndarray:
    got = _powers.get(kind)
    if got is None or len(got) < n:
        got = np.full(max(n, CHUNK + 64), base, np.uint64)
        got[0] = 1
        got = np.multiply.accumulate(got)
        if n <= CHUNK + 64:
            _powers[kind] = got
    return got[:n]


def _hash_piece(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes and word starts of one buffer that cuts no word."""
    n = len(buf)
    inside = np.zeros(n + 2, np.int8)
    inside[1:-1] = _IN_WORD[buf]
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[0::2], edge[1::2]
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_WEIGHT[buf] * _power("pow", _BASE, n), out=total[1:])
    h = (total[end] - total[start]) * _power("inv", pow(_BASE, -1, 1 << 64), n + 1)[start]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h, start


def _long_text(data: bytes) -> np.ndarray:
    """Hashes of one text over CHUNK bytes, cut at bytes outside words."""
    buf, at, out = np.frombuffer(data, np.uint8), 0, []
    while at < len(buf):
        end = min(at + CHUNK, len(buf))
        step = CHUNK
        while end < len(buf):
            gaps = np.flatnonzero(~_IN_WORD[buf[max(at, end - 4096) : end]])
            if len(gaps):
                end = max(at, end - 4096) + int(gaps[-1]) + 1
                break
            step *= 2  # a word longer than the window: take a larger piece
            end = min(at + step, len(buf))
        out.append(_hash_piece(buf[at:end])[0])
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def word_hashes(texts: list[bytes]) -> Iterator[np.ndarray]:
    """One array of word hashes per text, in order."""
    group: list[bytes] = []
    size = 0

    def flush():
        joined = b" ".join(group)
        h, start = _hash_piece(np.frombuffer(joined, np.uint8))
        ends = np.cumsum([len(t) + 1 for t in group])
        return np.split(h, np.searchsorted(start, ends[:-1]))

    for t in texts:
        if size + len(t) > CHUNK and group:
            yield from flush()
            group, size = [], 0
        if len(t) > CHUNK:
            yield _long_text(t)
            continue
        group.append(t)
        size += len(t) + 1
    if group:
        yield from flush()


# --- places in an order, without a window over a whole group ---------------------------------


def positions(rows: DataFrame, group: str, order: list[str], name: str = "placed") -> DataFrame:
    """``rows``, staged, with ``pos``: their place from 0 within ``group`` by ``order``, nulls first.

    Rows are cut into ranges of (group, order, row number), so that neither a hot group nor rows
    that agree in all of it meet in one task; a place is the row's number in its range plus what
    earlier ranges hold of the group. ``group`` is not null. Rows that agree come in any order.
    """
    tie = "__tie"
    numbered = stage(rows.withColumn(tie, F.monotonically_increasing_id()), name)
    keys = [group, *order, tie]
    ranged = numbered.repartitionByRange(*keys).sortWithinPartitions(*keys)
    number = F.monotonically_increasing_id()
    ranged = stage(
        ranged.select(*rows.columns, F.shiftright(number, 33).alias("__range"), number.alias("__number")), name
    )
    counts = ranged.groupBy(group, "__range").agg(F.count("*").alias("n"), F.min("__number").alias("first"))
    earlier = Window.partitionBy(group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    counts = counts.select(group, "__range", (F.col("before") - F.col("first")).alias("__shift"))
    placed = ranged.join(counts, [group, "__range"]).withColumn("pos", F.col("__number") + F.col("__shift"))
    return placed.select(*rows.columns, "pos")


def group_name(column: Column) -> Column:
    """A string for a group's key that keeps its order (bytewise, null first) and is never null."""
    return F.coalesce(F.concat(F.lit("="), column.cast("string")), F.lit(""))
