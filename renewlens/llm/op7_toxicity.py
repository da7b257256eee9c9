"""Toxicity by multiple-instance learning.

A document is a bag of sentences and is toxic if any sentence is: the sentence scores
sigma(BIAS + sum of the weights of its words) are combined by noisy-or with a leak,
p = 1 - (1 - leak) * prod(1 - score). Only documents are labelled; the fit maximises the
likelihood of those labels, and the fitted sentence scores locate the offending sentences.

Fitting uses at most ``SAMPLE`` labelled documents (those first in hash order, none of the held-out
fifth). Copies of a text count once: documents with the same words in the same order form one bag, clean if
any of them is; of documents of one label with a Jaccard index of ``ALIKE`` or more over runs of three words,
found by min-hashes and then compared, the first is the bag. A word becomes a feature if its share of toxic bags is higher than the
base rate beyond chance, by a Chernoff bound multiplied by the number of words tried. Every
document is scored whole.

Defined results: null or empty text scores the leak alone; documents with equal ids are scored one
by one; a label that is null is ignored and, of several labels of one id, the highest counts; with
no label to learn from, all scores are 0.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from renewlens.llm.common import str_texts, table
from renewlens.session import stage

SAMPLE = 10_000  # labelled documents used to fit
FEATURES = 4096  # most words kept
SURE = 3.0  # nats beyond the bound for all words tried
BIAS = -14.0  # a sentence without features adds under one in a million
FOLDS = 5
BANDS, ROWS = 16, 4  # groups of min-hashes, and min-hashes in each
ALIKE = 0.8  # Jaccard index of near copies

_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[^.!?\n]+")


@dataclass(frozen=True)
class Toxicity:
    weights: dict[str, float] = field(default_factory=dict)
    leak: float = 0.0

    def sentences(self, text: str) -> list[tuple[int, int, float]]:
        """(start, end, score) of the sentences that hold a feature word."""
        out = []
        for m in _SENTENCE.finditer(text):
            known = [self.weights[w] for w in set(_WORD.findall(m[0].lower())) if w in self.weights]
            if known:
                out.append((m.start(), m.end(), _sigma(BIAS + sum(known))))
        return out

    def score(self, text: str) -> tuple[float, list[tuple[int, int, float]]]:
        some = self.weights.keys() & set(_WORD.findall(text.lower())) if self.weights else ()
        found = self.sentences(text) if some else []
        clean = 1.0 - self.leak
        for _, _, s in found:
            clean *= 1.0 - s
        return min(1.0, max(0.0, 1.0 - clean)), found


def _sigma(x: float) -> float:
    return 1 / (1 + math.exp(-x)) if x > -700 else 0.0


def held_out(key: str = "doc_id"):
    """Whether a document is in the held-out fifth; a null id is not."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def _runs(words: list[str]) -> np.ndarray:
    """Distinct hashes of three successive words."""
    runs = zip(words, words[1:], words[2:]) if len(words) > 2 else [words]
    return np.unique(np.array([xxhash.xxh64_intdigest(" ".join(r)) for r in runs], np.uint64))


_MIX = np.random.default_rng(7).integers(0, 1 << 63, (2, BANDS * ROWS), np.uint64)


def _bands(runs: np.ndarray) -> list[int]:
    """Keys of groups of min-hashes; texts that are much alike share one almost surely."""
    low = np.array([(runs * (2 * a + np.uint64(1)) + b).min() for a, b in _MIX.T], np.uint64).reshape(BANDS, ROWS)
    return [xxhash.xxh64_intdigest(x.tobytes(), seed=i) >> 1 for i, x in enumerate(low)]


def _alike(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= ALIKE * (len(a) + len(b) - both)


def _train_rows(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """(toxic, text) of the labelled documents that the fit may see, at most ``sample``."""
    known = labels.where("doc_id is not null and toxic is not null").where(~held_out())
    chosen = (
        known.groupBy("doc_id")
        .agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample)
    )
    # at most ``sample`` rows of two numbers
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("toxic", "text")


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keys = [xxhash.xxh128_hexdigest(" ".join(_WORD.findall(t.lower()))) for t in str_texts(b.column(1))]
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(keys, pa.string())], names=["toxic", "text", "copy"])


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        bands = [_bands(_runs(_WORD.findall(t.lower()))) for t in str_texts(b.column(1))]
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(2), pa.array(bands, pa.list_(pa.int64()))], names=["toxic", "copy", "bands"]
        )


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last, runs = None, None
    for b in batches:
        same = []
        for t, first in zip(str_texts(b.column(2)), str_texts(b.column(3))):
            if first != last:
                last, runs = first, _runs(_WORD.findall(first.lower()))
            same.append(_alike(_runs(_WORD.findall(t.lower())), runs))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["copy", "first"]).filter(pa.array(same, pa.bool_()))


def distinct_texts(rows: DataFrame) -> DataFrame:
    """(toxic, text, copy) of ``rows`` (toxic, text), every text once."""
    texts = stage(
        rows.mapInArrow(_keyed, "toxic int, text string, copy string")
        .groupBy("copy")
        .agg(F.min("toxic").alias("toxic"), F.min("text").alias("text"))
        .select("toxic", "text", "copy"),
        "distinct-texts",
    )
    bands = texts.mapInArrow(_banded, "toxic int, copy string, bands array<bigint>")
    bands = stage(bands.select("toxic", "copy", F.explode("bands").alias("band")), "bands")
    groups = bands.groupBy("toxic", "band").agg(F.min("copy").alias("first"), F.count("*").alias("n"))
    # at most BANDS rows for each of ``sample`` documents; a text is compared with the first of its groups only
    pairs = bands.join(F.broadcast(groups.where("n > 1").drop("n")), ["toxic", "band"]).where("copy != first")
    pairs = pairs.select("copy", "first").distinct()
    pairs = pairs.join(texts.select("copy", F.col("text").alias("t")), "copy")
    pairs = pairs.join(texts.select(F.col("copy").alias("first"), F.col("text").alias("f")), "first")
    links = stage(pairs.select("copy", "first", "t", "f").mapInArrow(_confirmed, "copy string, first string"), "copies")
    # a text goes only if one that stays is like it: chains of copies do not carry on
    again = links.join(links.select(F.col("copy").alias("first")).distinct(), "first", "left_anti")
    return texts.join(again.select("copy").distinct(), "copy", "left_anti").select("toxic", "text", "copy")


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [sorted(set(_WORD.findall(t.lower()))) for t in str_texts(b.column(1))]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(pa.string()))], names=["toxic", "words"])


def _features(bags: DataFrame, limit: int) -> list[str]:
    total = bags.agg(F.count("*").alias("n"), F.sum("toxic").alias("k")).first()
    if not total.n or not total.k or total.k == total.n:
        return []
    base = total.k / total.n
    counts = stage(
        bags.select("toxic", F.explode("words").alias("word"))
        .groupBy("word")
        .agg(F.count("*").alias("n"), F.sum("toxic").alias("k")),
        "word-counts",
    )
    tried = counts.count()
    share = F.col("k") / F.col("n")
    other = F.when(F.col("k") < F.col("n"), (1 - share) * F.log((1 - share) / (1 - base))).otherwise(0.0)
    surprise = F.col("n") * (share * F.log(share / base) + other)
    best = counts.where((F.col("k") > 0) & (share > base)).select("word", surprise.alias("s"))
    best = best.where(F.col("s") > math.log(tried) + SURE).orderBy(F.desc("s"), "word").limit(limit)
    return [r.word for r in best.collect()]  # at most FEATURES words


def _hits(batches: Iterator[pa.RecordBatch], words: list[str]) -> Iterator[pa.RecordBatch]:
    number = {w: i for i, w in enumerate(words)}
    for b in batches:
        found = []
        for text in str_texts(b.column(1)):
            low, rows = text.lower(), []
            if number.keys() & set(_WORD.findall(low)):
                for s in _SENTENCE.findall(low):
                    ids = sorted({number[w] for w in _WORD.findall(s) if w in number})
                    if ids and ids not in rows:
                        rows.append(ids)
            found.append(rows)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.list_(pa.int32())))], names=["toxic", "hits"])


def fit(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE, features: int = FEATURES) -> Toxicity:
    """Fit on at most ``sample`` labelled documents outside the held-out fifth."""
    rows = stage(distinct_texts(_train_rows(docs, labels, sample)), "labelled")
    bags = stage(rows.mapInArrow(_bags, "toxic int, words array<string>"), "bags")
    words = _features(bags, features)
    total = bags.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("k")).first()
    if not total.n:
        return Toxicity()
    if not words:
        return Toxicity({}, min(total.k / total.n, 0.49))
    hits = rows.mapInArrow(lambda it: _hits(it, words), "toxic int, hits array<array<int>>")
    # at most ``sample`` documents, of each only its distinct sets of feature words per sentence
    found = hits.where(F.size("hits") > 0).select("toxic", "hits").collect()
    return _maximise(words, [(r.toxic, r.hits) for r in found], total.n, total.k)


def _maximise(words, found, n, k, rounds: int = 400, rate: float = 0.4, ridge: float = 1e-3) -> Toxicity:
    """Adam on the noisy-or likelihood; documents without features only inform the leak."""
    y = np.array([t for t, _ in found], float)
    doc = np.array([d for d, (_, h) in enumerate(found) for _ in h])
    sent = np.array([i for i, s in enumerate([s for _, h in found for s in h]) for _ in s])
    word = np.array([w for _, h in found for s in h for w in s])
    n_sent = len(doc)
    leak = (max(k - y.sum(), 0) + 0.5) / (n - len(y) + 1)
    leak = min(leak, 0.49)
    w = np.full(len(words), -BIAS)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, rounds + 1):
        z = BIAS + np.bincount(sent, w[word], n_sent)
        s = 1 / (1 + np.exp(-np.clip(z, -60, 30)))
        log_clean = np.bincount(doc, np.log1p(-np.minimum(s, 1 - 1e-12)), len(y)) + math.log1p(-leak)
        p = -np.expm1(log_clean)
        # d logL / d z_i = s_i * (y/p - 1): a sentence answers for what its bag leaves unexplained
        grad_z = s * (y / np.maximum(p, 1e-9) - 1)[doc]
        grad = np.bincount(word, grad_z[sent], len(w)) - ridge * (w + BIAS)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w = w + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Toxicity({x: float(c) for x, c in zip(words, w) if c > 0}, float(leak))


SCORE_SCHEMA = "doc_id bigint, score double, sentences array<struct<start:int,end:int,score:double>>"


def score(docs: DataFrame, model: Toxicity, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score and the offending sentences (code-point offsets and score), worst first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
        for b in batches:
            got = [model.score(t) for t in str_texts(b.column(1))]
            worst = [
                [{"start": a, "end": e, "score": s} for a, e, s in sorted(f, key=lambda x: (-x[2], x[0])) if s >= 0.5]
                for _, f in got
            ]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([g[0] for g in got], pa.float64()), pa.array(worst, kind)],
                names=["doc_id", "score", "sentences"],
            )

    rows = docs.select(F.col(key).cast("bigint").alias("k"), F.col(text).cast("string").alias("t"))
    return rows.mapInArrow(run, SCORE_SCHEMA)


def drop_toxic(docs: DataFrame, model: Toxicity, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score under the threshold, all columns kept."""

    @F.pandas_udf("double")
    def toxic(texts):
        return texts.fillna("").map(lambda t: model.score(t)[0])

    return docs.where(toxic(F.col("text").cast("string")) < threshold)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return found.select(
        "doc_id",
        held_out().alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        F.transform("sentences", lambda s: F.concat_ws(":", s["start"], s["end"])).alias("sentences"),
    )
