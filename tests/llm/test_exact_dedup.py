"""Exact duplicates against a dictionary of whole texts; filters against sets."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from renewlens.llm import op13_exact_dedup as D
from renewlens.llm.fuse_filter import FuseFilter

SCHEMA = "doc_id long, text string, norm string, digest string"


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def plain(rows):
    """Sorted (doc_id, keep_id, group_size, kept) of rows (doc_id, text)."""
    groups = {}
    for k, t in rows:
        groups.setdefault(norm(t), []).append(k)
    out = []
    for ids in groups.values():
        keep = min((k for k in ids if k is not None), default=None)
        first = True
        for k in ids:
            out.append((k, keep, len(ids), k == keep and first))
            first = first and k != keep
    return sorted(out, key=repr)


def found(frame):
    return sorted(((r.id, r.keep_id, r.group_size, r.kept) for r in frame.collect()), key=repr)


def random_rows(seed, n=300):
    rng = np.random.default_rng(seed)
    texts = ["a  b", "a\tb", "a b ", "", None, " ", "é", "long " * 5000, *[f"t{k}" for k in range(60)]]
    rows = [(int(rng.integers(0, 150)), texts[rng.integers(0, len(texts))]) for _ in range(n)]
    return rows + [(None, None)] * 30 + [(None, "only here")] * 2 + [(77, "hot  text")] * 150


def test_query_on_the_small_table(spark, small, documents):
    got = D.op13_exact_dedup(spark, small).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got), key=repr) == plain([(d.doc_id, d.text) for d in documents])
    text = {d.doc_id: hashlib.sha256(norm(d.text).encode()).hexdigest() for d in documents}
    assert all(r.text_sha256 == text[r.doc_id] for r in got)
    assert any(not r.kept for r in got)


@pytest.mark.parametrize("batches", [1, 2, 4])
def test_batches_give_the_same_classes(spark, batches):
    rows = random_rows(batches)
    docs = spark.createDataFrame([(k, t, "x", "y") for k, t in rows], SCHEMA).repartition(5)
    assert found(D.exact_dedup(docs, batches=batches)) == plain(rows)


def test_collided_digests_are_told_apart_by_their_bytes(spark):
    rows = random_rows(9)
    docs = spark.createDataFrame([(k, t, "x", "y") for k, t in rows], SCHEMA)
    for weak in (lambda n: F.lit(b"same"), lambda n: F.unhex(F.substring(F.sha2(n, 256), 1, 2))):
        assert found(D.exact_dedup(docs, batches=3, digest=weak)) == plain(rows)


def test_kept_rows_have_all_columns(spark):
    rows = random_rows(3)
    docs = spark.createDataFrame([(k, t, str(i % 3), None) for i, (k, t) in enumerate(rows)], SCHEMA)
    stay = D.keep_first(docs)
    assert stay.columns == docs.columns
    assert sorted(norm(r.text) for r in stay.collect()) == sorted({norm(t) for _, t in rows})


def test_only_new_texts_pass_an_older_snapshot(spark):
    def snapshot(a, b):
        batch = spark.range(a, b).withColumn("norm", F.col("id").cast("string"))
        return D.take_snapshot(batch.withColumn("digest", D.sha256(F.col("norm"))))

    old, new = snapshot(0, 3000), snapshot(2500, 6000)
    through = {r.digest for r in D.screen(new, old).collect()}
    known = {hashlib.sha256(str(k).encode()).digest() for k in range(2500, 3000)}
    assert known <= through and len(through - known) < 3000 / 256 * 3
    assert D.matches(new, old).count() == 500


def test_texts_of_buckets_are_not_shuffled(spark):
    ids = spark.range(0, 500).withColumn("norm", F.col("id").cast("string"))
    batch = ids.withColumn("digest", D.sha256(F.col("norm")))
    old, new = D.take_snapshot(batch), D.take_snapshot(batch.where("id % 2 = 0"))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = D.matches(new, old)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert plan.count("SortMergeJoin") == 2
    assert not re.search(r"Exchange hashpartitioning\(digest[^\n]*\n[^\n]*\n[^\n]*norm", plan)
    assert plan.count("Exchange") <= 2


@pytest.mark.parametrize("n", [0, 1, 2, 7, 100, 5000, 200_000])
def test_filter_holds_its_keys_and_few_others(n):
    rng = np.random.default_rng(n)
    keys = rng.integers(0, 1 << 63, n, dtype=np.uint64)
    filter_ = FuseFilter.from_bytes(FuseFilter.build(np.repeat(keys, 2)).to_bytes())
    assert filter_.may_hold(keys).all()
    others = rng.integers(1 << 63, (1 << 64) - 1, 50_000, dtype=np.uint64)
    assert filter_.may_hold(others).mean() < 2 / 256
    assert len(filter_.slots) <= max(16, 5 * n if n < 100 else 2 * n if n < 5000 else 1.3 * n)
