"""SimHash near-duplicates with pigeonring filtering.

The 64-bit fingerprints are cut into four 16-bit segments on a ring. Two fingerprints within three
bits have a start segment from which every chain of 1, 2, 3, 4 consecutive segments differs by no
more than its share 0.75, 1.5, 2.25, 3 of the budget, so by 0, 1, 2, 3 bits. Hence the start
segment is equal and so is one half of the next: these 24 bits (eight keys per fingerprint) index
the distinct fingerprints. Inside a key the chain is checked segment by segment before the full
distance.

Keys shared by more than ``GROUP`` fingerprints are refined: the bits not yet fixed are cut into
four parts, one of which two fingerprints within three bits share, and each part with the old key
is a key of its own. Groups that stay large after two such steps (dense balls of fingerprints) are
compared in pairs of blocks, each pair a task's work. Nothing is dropped. From each group only a
spanning forest leaves, so the links written grow with the fingerprints and not with pairs, and
components come from rounds over that forest.

Defined results: null or empty text has fingerprint zero and links like any other; equal ids and
repeated rows each keep a row; a null id is skipped when the smallest id is taken; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from renewlens.llm.common import by_row, byte_texts, row_key, table
from renewlens.llm.components import components
from renewlens.session import stage

SHINGLE = 3
SEED = 42
RADIUS = 3
SEGMENTS = 4
GROUP = 4096
REFINED = 2  # times that the keys of a large group are refined
DIRECT = 8  # groups up to this size are compared pair by pair


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Signed 64-bit SimHash of the word shingles of one text."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    begins = np.r_[0, ends[:-1] + 1]
    if len(words) > shingle:
        begins, ends = begins[: 1 - shingle], ends[shingle - 1 :]
    else:
        begins, ends = begins[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    n, ones = len(begins), np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        some = [
            digest(joined[b:e], SEED)
            for b, e in zip(begins[at : at + (1 << 16)].tolist(), ends[at : at + (1 << 16)].tolist())
        ]
        ones += np.unpackbits(np.array(some, ">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, *, text: str = "text", row: Column | None = None, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, row_key, fp) of every document; ``row`` is a key of the row, null if not given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = [fingerprint(t, shingle) for t in byte_texts(b.column(2))]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(values, pa.int64())], names=["doc_id", "row_key", "fp"]
            )

    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("k"),
        (F.lit(None) if row is None else row).cast("bigint").alias("r"),
        F.col(text).cast("string").alias("t"),
    )
    return rows.mapInArrow(run, "doc_id bigint, row_key bigint, fp bigint")


# --- candidate keys ---------------------------------------------------------------------

_KEY_SCHEMA = "key bigint, seg int, mask bigint, fp bigint"


def _mix(*parts: np.ndarray) -> np.ndarray:
    h = np.zeros(len(parts[0]), np.uint64)
    for p in parts:
        h = (h ^ p.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    return h


def _key_batch(key, seg, mask, fp) -> pa.RecordBatch:
    arrays = [
        pa.array(key.view(np.int64)),
        pa.array(seg.astype(np.int32)),
        pa.array(mask.view(np.int64)),
        pa.array(fp.view(np.int64)),
    ]
    return pa.RecordBatch.from_arrays(arrays, names=["key", "seg", "mask", "fp"])


def _first_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp = np.asarray(b.column(0)).astype(np.int64).view(np.uint64)
        for seg in range(SEGMENTS):
            after = (seg + 1) % SEGMENTS
            for half in range(2):
                bits = 0xFFFF << (48 - 16 * seg) | 0xFF << (56 - 16 * after - 8 * half)
                mask = np.full(len(fp), bits, np.uint64)
                number = np.full(len(fp), seg * 2 + half, np.uint64)
                yield _key_batch(_mix(number, fp & mask), np.full(len(fp), seg), mask, fp)


def _finer_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        key, mask, fp = (np.asarray(b.column(c)).astype(np.int64).view(np.uint64) for c in (0, 2, 3))
        seg = np.asarray(b.column(1))
        for m in np.unique(mask):
            at = mask == m
            free = [i for i in range(64) if not int(m) >> i & 1]
            for part in np.array_split(free, RADIUS + 1):
                bits = np.uint64(sum(1 << int(i) for i in part))
                n = int(at.sum())
                new = _mix(key[at], np.full(n, bits), fp[at] & bits)
                yield _key_batch(new, seg[at], np.full(n, m | bits), fp[at])


def _ring_links(turned: np.ndarray, one: np.ndarray, other: np.ndarray, radius: int) -> np.ndarray:
    """Which of the pairs pass every chain from the start segment, and so the full distance."""
    differ = turned[one] ^ turned[other]
    left = np.arange(len(differ))
    for length in range(2, SEGMENTS + 1):
        chain = differ[left] >> np.uint64(64 - 16 * length)
        left = left[np.bitwise_count(chain) <= radius * length // SEGMENTS]
    return left


def _forest(turned: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """(root, member) of the links inside one group, each member once."""
    open_, out = np.arange(len(turned)), []
    while len(open_):
        root, queue, open_ = int(open_[0]), [int(open_[0])], open_[1:]
        while queue and len(open_):
            node = queue.pop()
            near = _ring_links(turned, np.full(len(open_), node), open_, radius)
            if len(near):
                queue += open_[near].tolist()
                out += [(root, int(x)) for x in open_[near]]
                open_ = np.delete(open_, near)
    return out


def _group_links(key, seg, fp, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links inside groups of equal key; the arrays are sorted by key and hold whole groups."""
    begins = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[begins, len(key)])
    shift = (seg * 16).astype(np.uint64)
    turned = np.where(shift == 0, fp, fp << shift | fp >> (np.uint64(64) - np.maximum(shift, np.uint64(1))))
    a, b = [], []
    small = np.repeat(sizes <= DIRECT, sizes)
    for step in range(1, DIRECT):
        one = np.flatnonzero(small[:-step] & (key[:-step] == key[step:]))
        near = one[_ring_links(turned, one, one + step, radius)]
        a.append(fp[near])
        b.append(fp[near + step])
    for at, n in zip(begins[sizes > DIRECT].tolist(), sizes[sizes > DIRECT].tolist()):
        links = _forest(turned[at : at + n], radius)
        if links:
            one, other = np.array(links).T
            a.append(fp[at + one])
            b.append(fp[at + other])
    return np.concatenate(a), np.concatenate(b)


def _links_of_keys(keys: DataFrame, radius: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            got = [np.asarray(b.column(c)) for c in (0, 1, 3)]
            got = got if held is None else [np.concatenate(x) for x in zip(held, got)]
            cut = int(np.searchsorted(got[0], got[0][-1])) if len(got[0]) else 0
            held = [x[cut:] for x in got]
            if cut:
                yield out(*(x[:cut] for x in got))
        if held is not None and len(held[0]):
            yield out(*held)

    def out(key, seg, fp):
        a, b = _group_links(key, seg, fp.astype(np.int64).view(np.uint64), radius)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    ordered = keys.repartition("key").sortWithinPartitions("key", "fp")
    return ordered.mapInArrow(run, "a bigint, b bigint")


def _block_pairs(keys: DataFrame, counts: DataFrame, group: int) -> DataFrame:
    """Rows of large groups dealt to pairs of blocks of about half a group, each pair a key of its own."""
    blocks = F.ceil(F.col("count") * 2 / group).cast("int")
    own = F.pmod(F.xxhash64("fp", F.lit(1)), F.col("blocks").cast("bigint")).cast("int")
    return (
        keys.join(counts.select("key", blocks.alias("blocks")), "key")
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key"), "seg", "mask", "fp"
        )
    )


def links(distinct: DataFrame, *, radius: int = RADIUS, group: int = GROUP) -> DataFrame:
    """Links (a, b) that connect the distinct fingerprints (column fp) as all pairs within ``radius`` do."""
    if radius > RADIUS:
        raise ValueError(f"the key layout is made for at most {RADIUS} bits")
    keys = distinct.select("fp").mapInArrow(_first_keys, _KEY_SCHEMA)
    out = None
    for level in range(REFINED + 1):
        hot = stage(keys.groupBy("key").count().where(F.col("count") > group), "hot-keys")
        some_hot = not hot.isEmpty()
        cold = keys.join(hot, "key", "left_anti") if some_hot else keys
        found = stage(_links_of_keys(cold, radius), "links")
        out = found if out is None else out.unionByName(found)
        if not some_hot:
            break
        large = keys.join(hot, "key", "left_semi").select("key", "seg", "mask", "fp")
        if level < REFINED:
            keys = stage(large.mapInArrow(_finer_keys, _KEY_SCHEMA), "finer-keys")
        else:
            out = out.unionByName(stage(_links_of_keys(_block_pairs(large, hot, group), radius), "links"))
    return out.distinct()


def near_duplicates(prints: DataFrame, *, radius: int = RADIUS, group: int = GROUP) -> DataFrame:
    """(doc_id, fp, ...) -> the same rows with root, a fingerprint that names the component, and
    component_id, the smallest doc_id that links reach."""
    prints = stage(prints, "fingerprints")
    distinct = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct-fingerprints")
    roots = components(links(distinct, radius=radius, group=group))
    member = roots.select(F.col("node").alias("fp"), "root").unionByName(
        roots.select(F.col("root").alias("fp"), "root").distinct()
    )
    low = member.join(distinct, "fp").groupBy("root").agg(F.min("low").alias("component"))
    labels = distinct.join(member.join(low, "root"), "fp", "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), F.coalesce("component", "low").alias("component_id")
    )
    # written first, so that both sides of the join are plain shuffles and a hot fingerprint is split
    return prints.join(stage(labels, "labels"), "fp")


def keep_one(docs: DataFrame) -> DataFrame:
    """Of each component the row with the smallest doc_id (null last, ties by row key), all columns kept."""
    found = near_duplicates(fingerprints(docs, row=row_key(docs)))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key"))
    kept = found.groupBy("root").agg(first.alias("first")).select(F.col("first.row_key").alias("row_key"))
    # one per component: of rows alike in all columns, one stays
    counts = found.groupBy("row_key").agg(F.count("*").alias("n"))
    one = kept.join(counts, "row_key").select("row_key", F.explode(F.sequence(F.lit(1), F.least("n", F.lit(2)))).alias("i"))
    return by_row(docs, one.select("row_key", (F.col("i") == 1).cast("int").alias("copies")))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(fingerprints(table(spark, sf_dir, "documents")))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
