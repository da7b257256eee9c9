"""Benchmark decontamination by a positional inverted index.

``build_index`` cuts the documents into segments of about two million words and stores, for each
segment, its sorted terms and, per term, the ascending list of word positions (delta-coded).
``search`` takes phrases in blocks of bounded size to every segment: for each phrase it starts
from the list of the term that is rarest in the segment, shifts it by the term's offset, and
intersects it with the shifted lists of the other terms, rarest first. With ``slop`` 0 the match
is the exact phrase; a larger slop accepts each other term within that many words of its place
(proximity). A segment never leaves its task, and only hits leave the search.

Terms are 64-bit hashes of lower-cased words; two of the words met in a search share one with a
probability of about (phrase words x corpus words) / 2^64, and a false hit needs that for every
word of a phrase.

Defined results: null or empty text has no words and no hits; an item without words gives no
phrase; repeated rows and equal ids are kept as rows of their own; items with a null id mark hits
but are not listed; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from renewlens.llm.common import byte_texts, row_key, table, word_hashes
from renewlens.session import stage

SEGMENT_WORDS = 1 << 21
BLOCK_WORDS = 1 << 20  # words of phrases sent to the executors at once
WINDOW = 10
CANDIDATES = 1 << 19  # positions intersected at once

INDEX_SCHEMA = (
    "part int, seq int, keys array<bigint>, n_words array<int>, terms binary, counts binary, postings binary"
)


def _segment(part: int, seq: int, keys: list, words: list[np.ndarray]) -> tuple:
    flat = np.concatenate(words) if words else np.zeros(0, np.uint64)
    order = np.argsort(flat, kind="stable").astype(np.int64)
    sorted_terms = flat[order]
    first = np.flatnonzero(np.r_[True, sorted_terms[1:] != sorted_terms[:-1]]) if len(flat) else np.zeros(0, np.int64)
    counts = np.diff(np.r_[first, len(flat)])
    gaps = np.diff(order, prepend=0)
    gaps[first] = order[first]
    return (
        part,
        seq,
        keys,
        [len(w) for w in words],
        sorted_terms[first].tobytes(),
        counts.astype(np.uint32).tobytes(),
        gaps.astype(np.uint32).tobytes(),
    )


_INDEX_ARROW = pa.schema(
    [
        ("part", pa.int32()),
        ("seq", pa.int32()),
        ("keys", pa.list_(pa.int64())),
        ("n_words", pa.list_(pa.int32())),
        ("terms", pa.binary()),
        ("counts", pa.binary()),
        ("postings", pa.binary()),
    ]
)


def build_index(docs: DataFrame, *, key: str = "doc_id", text: str = "text", segment_words: int = SEGMENT_WORDS):
    """Positional index of ``docs``, one row per segment, stored in the shared folder."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, keys, words, held = TaskContext.get().partitionId(), 0, [], [], 0

        def row():
            got = _segment(part, seq, keys, words)
            return pa.RecordBatch.from_arrays(
                [pa.array([v], f.type) for v, f in zip(got, _INDEX_ARROW)], schema=_INDEX_ARROW
            )

        for batch in batches:
            for k, h in zip(batch.column(0).to_pylist(), word_hashes(byte_texts(batch.column(1)))):
                keys.append(k)
                words.append(h)
                held += len(h)
                if held >= segment_words or len(keys) >= 1 << 18:
                    yield row()
                    seq, keys, words, held = seq + 1, [], [], 0
        if keys:
            yield row()

    rows = docs.select(F.col(key).cast("bigint").alias("k"), F.col(text).cast("string").alias("t"))
    return stage(rows.mapInArrow(build, INDEX_SCHEMA), "postings")


class Segment:
    """One segment read back: sorted terms with the position lists laid end to end."""

    def __init__(self, n_words, terms: bytes, counts: bytes, postings: bytes):
        self.terms = np.frombuffer(terms, np.uint64)
        self.counts = np.frombuffer(counts, np.uint32).astype(np.int64)
        self.ends = np.cumsum(self.counts)
        gaps = np.cumsum(np.frombuffer(postings, np.uint32).astype(np.int64))
        begins = self.ends - self.counts
        before = np.where(begins > 0, gaps[begins - 1], 0) if len(begins) else begins
        self.positions = gaps - np.repeat(before, self.counts)
        # term number and position as one ascending key: membership is a binary search
        self.keyed = np.repeat(np.arange(len(self.terms), dtype=np.int64) << 32, self.counts) | self.positions
        self.doc_first = np.r_[0, np.cumsum(np.asarray(n_words, np.int64))]


def match(seg: Segment, terms: np.ndarray, length: np.ndarray, slop: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(phrase number, start position) of every occurrence; ``terms`` is phrases x words, padded."""
    width = terms.shape[1]
    used = np.arange(width)[None, :] < length[:, None]
    if not len(seg.terms) or not len(terms):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    number = np.minimum(np.searchsorted(seg.terms, terms), len(seg.terms) - 1)
    known = seg.terms[number] == terms
    alive = np.flatnonzero((known | ~used).all(1))
    number, used_alive = number[alive], used[alive]
    frequency = np.where(used_alive, seg.counts[number], np.iinfo(np.int64).max)
    rarest = np.argsort(frequency, axis=1, kind="stable")
    lists = np.take_along_axis(frequency, rarest[:, :1], 1)[:, 0] if len(alive) else np.zeros(0, np.int64)
    found_phrase, found_start = [], []
    upto = np.cumsum(lists)
    at = 0
    while at < len(alive):
        base = upto[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(upto, base + CANDIDATES, "right")))
        rows = np.arange(at, stop)
        n = lists[rows]
        phrase = np.repeat(rows, n)
        anchor = np.take_along_axis(number[rows], rarest[rows][:, :1], 1)[:, 0]
        inside = np.arange(len(phrase)) - np.repeat(np.cumsum(n) - n, n)
        where = seg.positions[np.repeat(seg.ends[anchor] - seg.counts[anchor], n) + inside]
        start = where - rarest[phrase, 0]
        for k in range(1, width):
            if not len(phrase):
                break
            offset = rarest[phrase, k]
            live = offset < length[alive[phrase]]
            term = number[phrase, offset] << 32
            low = np.searchsorted(seg.keyed, term | np.maximum(start + offset - slop, 0))
            got = seg.keyed[np.minimum(low, len(seg.keyed) - 1)]
            ok = (low < len(seg.keyed)) & (got >= term) & (got <= (term | np.maximum(start + offset + slop, 0)))
            keep = ok | ~live
            phrase, start = phrase[keep], start[keep]
        ends = start + length[alive[phrase]]
        doc = np.searchsorted(seg.doc_first, np.maximum(start, 0), "right") - 1
        ok = (start >= 0) & (ends <= seg.doc_first[np.minimum(doc + 1, len(seg.doc_first) - 1)])
        found_phrase.append(alive[phrase[ok]])
        found_start.append(start[ok])
        at = stop
    if not found_phrase:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found_phrase), np.concatenate(found_start)


def phrase_blocks(items: DataFrame, *, key: str, text: str, window: int, block_words: int) -> Iterator[tuple]:
    """Blocks of (phrase terms, phrase lengths, phrase item ids), each of bounded size."""

    def hashes(batches):
        for b in batches:
            words = [h.tobytes() for h in word_hashes(byte_texts(b.column(1)))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words, pa.binary())], names=["k", "w"])

    rows = items.select(F.col(key).cast("bigint").alias("k"), F.col(text).cast("string").alias("t"))
    terms, lengths, ids, held = [], [], [], 0
    for r in rows.mapInArrow(hashes, "k bigint, w binary").toLocalIterator():
        h = np.frombuffer(r.w, np.uint64)
        if not len(h):
            continue
        if len(h) < window:
            w = np.zeros((1, window), np.uint64)
            w[0, : len(h)] = h
        else:
            w = np.lib.stride_tricks.sliding_window_view(h, window).copy()
        terms.append(w)
        lengths.append(np.full(len(w), min(window, len(h)), np.int64))
        ids += [r.k] * len(w)
        held += w.size
        if held >= block_words:
            yield np.concatenate(terms), np.concatenate(lengths), ids
            terms, lengths, ids, held = [], [], [], 0
    if terms:
        yield np.concatenate(terms), np.concatenate(lengths), ids


HITS_SCHEMA = "part int, seq int, ord int, doc_id bigint, n_words bigint, hits array<int>, items array<bigint>"


def search(
    index: DataFrame,
    items: DataFrame,
    *,
    key: str = "item_id",
    text: str = "text",
    window: int = WINDOW,
    slop: int = 0,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """Hit word positions and matching items of every indexed document.

    ``hits`` lists the words inside any occurrence of a window of an item (for a proximity search,
    the words from the occurrence's first to its last expected place).
    """
    spark = index.sparkSession
    out: DataFrame | None = None
    n_blocks = 0
    empty = (np.zeros((0, window), np.uint64), np.zeros(0, np.int64), [])
    for block in phrase_blocks(items, key=key, text=text, window=window, block_words=block_words) or ():
        one = _search_block(spark, index, block, slop)
        out, n_blocks = (one if out is None else out.unionByName(one)), n_blocks + 1
    if out is None:
        out = _search_block(spark, index, empty, slop)
    if n_blocks > 1:
        out = out.groupBy("part", "seq", "ord").agg(
            F.max("doc_id").alias("doc_id"),
            F.max("n_words").alias("n_words"),
            F.array_distinct(F.flatten(F.collect_list("hits"))).alias("hits"),
            F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"),
        )
    return out.drop("part", "seq", "ord")


def _search_block(spark: SparkSession, index: DataFrame, block: tuple, slop: int) -> DataFrame:
    sent = spark.sparkContext.broadcast(block)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, length, ids = sent.value
        for batch in batches:
            for r in batch.to_pylist():
                seg = Segment(r["n_words"], r["terms"], r["counts"], r["postings"])
                phrase, start = match(seg, terms, length, slop)
                n_docs = len(r["keys"])
                change = np.zeros(int(seg.doc_first[-1]) + 1, np.int64)
                np.add.at(change, start, 1)
                np.add.at(change, start + length[phrase], -1)
                covered = np.flatnonzero(np.cumsum(change)[:-1] > 0)
                doc_of = np.searchsorted(seg.doc_first, covered, "right") - 1
                hits: dict[int, list] = {}
                for d in np.unique(doc_of):
                    lo, hi = np.searchsorted(doc_of, [d, d + 1])
                    hits[int(d)] = (covered[lo:hi] - seg.doc_first[d]).tolist()
                items: dict[int, set] = {}
                for d, p in zip((np.searchsorted(seg.doc_first, start, "right") - 1).tolist(), phrase.tolist()):
                    if ids[p] is not None:
                        items.setdefault(d, set()).add(ids[p])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([r["part"]] * n_docs, pa.int32()),
                        pa.array([r["seq"]] * n_docs, pa.int32()),
                        pa.array(range(n_docs), pa.int32()),
                        pa.array(r["keys"], pa.int64()),
                        pa.array(r["n_words"], pa.int64()),
                        pa.array([hits.get(d, []) for d in range(n_docs)], pa.list_(pa.int32())),
                        pa.array([sorted(items.get(d, ())) for d in range(n_docs)], pa.list_(pa.int64())),
                    ],
                    names=["part", "seq", "ord", "doc_id", "n_words", "hits", "items"],
                )

    return index.mapInArrow(find, HITS_SCHEMA)


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", window: int = WINDOW) -> DataFrame:
    """Per document: key (as doc_id), n_words, hit positions, ids of matching items."""
    return search(build_index(docs, key=key), benchmark, window=window)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` without a window of an item, all columns kept."""
    key = "__row_key"
    keyed = docs.withColumn(key, row_key(docs))
    found = decontaminate(keyed, benchmark, key=key).where(F.size("hits") > 0)
    return keyed.join(found.select(F.col("doc_id").alias(key)).distinct(), key, "left_anti").drop(key)


def digest(found: DataFrame) -> DataFrame:
    ids = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select(
        "doc_id",
        "n_words",
        F.size("hits").cast("bigint").alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(ids.cast("binary"), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))
