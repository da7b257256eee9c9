"""Every stage of the pipeline against a plain version of its rule, on the rows the stage before kept."""

import collections
import re
import zlib

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from renewlens.llm import op7_toxicity
from renewlens.session import stage


def lower(s):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s or "")


def space_words(s):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(s))


def fingerprint(text):
    w = space_words(text)
    runs = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] * bool(w)
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.fixture(scope="module")
def kept(spark, small):
    """Rows after each stage, the documents first; the last is the result."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    out = [docs.collect()]
    for name, step in corpus_pipeline.STAGES:
        docs = stage(step(spark, docs, small), name)
        out.append(docs.collect())
    return out


def ids(rows):
    return collections.Counter(r.doc_id for r in rows)


def test_toxicity_drops_what_scores_as_toxic(spark, small, kept):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    model = op7_toxicity.fit(docs, spark.read.parquet(f"{small}/labels.parquet"))
    want = [r.doc_id for r in kept[0] if model.score(r.text or "")[0] < 0.5]
    assert ids(kept[1]) == collections.Counter(want)
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    clean = [r.doc_id for r in kept[0] if labels.get(r.doc_id) == 0]
    assert sum(i in ids(kept[1]) for i in clean) >= 0.98 * len(clean)


def test_one_document_of_each_group_stays(kept):
    prints = {r.doc_id: fingerprint(r.text) for r in kept[1]}
    order = sorted(prints)
    x, root = np.array([prints[i] for i in order], np.uint64), list(range(len(order)))

    def find(i):
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    for i in range(len(x)):
        for j in np.flatnonzero(np.bitwise_count(x[i] ^ x) <= 3):
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    want = {order[find(i)] for i in range(len(order))}
    assert ids(kept[2]) == collections.Counter(want) and len(want) < len(order)


def test_documents_with_benchmark_windows_go(spark, small, kept):
    words = lambda s: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(s))
    windows = set()
    for item in spark.read.parquet(f"{small}/benchmark.parquet").collect():
        w = words(item.text)
        n = min(10, len(w))
        windows |= {tuple(w[k : k + n]) for k in range(len(w) - n + 1 if n else 0)}
    sizes = {len(x) for x in windows}

    def hit(text):
        w = words(text)
        return any(tuple(w[k : k + n]) in windows for n in sizes for k in range(len(w) - n + 1))

    want = [r.doc_id for r in kept[2] if not hit(r.text)]
    assert ids(kept[3]) == collections.Counter(want)


def test_mix_comes_near_its_targets_and_repeats(spark, small, kept):
    size = {r.doc_id: len(space_words(r.text)) for r in kept[3]}
    source = {r.doc_id: r.source for r in kept[3]}
    own = collections.Counter()
    for i, n in size.items():
        own[source[i]] += n
    names = sorted(own, key=lambda s: (s is None, [ord(c) for c in s or ""]))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, open_, left = {}, set(names), 1.5 * sum(own.values())
    while open_:
        share = {s: left * weight[s] / sum(weight[t] for t in open_) for s in open_}
        full = {s for s in open_ if share[s] > 2 * own[s]}
        if not full:
            target |= share
            break
        for s in full:
            target[s] = 2.0 * own[s]
            left -= target[s]
        open_ -= full
    taken = collections.Counter()
    for r in kept[4]:
        taken[r.source] += size[r.doc_id]
    largest = collections.Counter()
    for i, n in size.items():
        largest[source[i]] = max(largest[source[i]], n)
    assert set(ids(kept[4])) <= set(size) and max(ids(kept[4]).values()) <= 2
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in names)
    docs = spark.createDataFrame(kept[3])
    again = corpus_pipeline.mix_sources(spark, docs, small)
    assert collections.Counter(r.doc_id for r in again.collect()) == ids(kept[4])


def test_tokens_are_the_mix_in_order(kept):
    from tokenizers import Tokenizer

    from renewlens.llm.op5_token_shards import vocabulary_path

    t = Tokenizer.from_file(vocabulary_path())
    rows = sorted(kept[5], key=lambda r: r.start)
    text = {r.doc_id: r.text for r in kept[4]}
    assert [r.doc_id for r in rows] == sorted(ids(kept[4]).elements())
    at = 0
    for r in rows:
        tokens = t.encode(text[r.doc_id] or "", add_special_tokens=False).ids + [2]
        crc = zlib.crc32(np.array(tokens, "<u4").tobytes())
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(tokens), crc)
        at += len(tokens)


def test_stages_keep_the_columns_of_documents(kept):
    for rows in kept[1:5]:
        assert rows[0].asDict().keys() == kept[0][0].asDict().keys()
