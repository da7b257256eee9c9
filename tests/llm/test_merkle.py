"""Merkle proofs against whole trees held in memory."""

import hashlib
import zlib

import pytest

from renewlens.llm import op11_merkle as M

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string"


def digest(s):
    return hashlib.sha256(s.encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def climb(nodes, i, fanout):
    """Root and the siblings (left, right) of node i on every level."""
    out = []
    while len(nodes) > 1:
        a = i // fanout * fanout
        run = nodes[a : a + fanout]
        out.append(("".join(run[: i - a]), "".join(run[i - a + 1 :])))
        nodes, i = [digest("".join(nodes[k : k + fanout])) for k in range(0, len(nodes), fanout)], i // fanout
    return nodes[0], out


def plain(rows, fanout=16):
    leaf = lambda r, text: digest("".join(map(field, (r["doc_id"], r["source"], r["lang"], r["n_chars"], text))))
    by = {}
    for r in rows:
        by.setdefault(r["source"], []).append(r)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in names:
        by[s].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"])))
    leaves = {s: [leaf(r, r["text"]) for r in by[s]] for s in names}
    subs = [climb(leaves[s], 0, fanout)[0] for s in names]
    out = []
    for k, s in enumerate(names):
        root, upper = climb(subs, k, fanout)
        for i, r in enumerate(by[s]):
            path = climb(leaves[s], i, fanout)[1] + upper
            text, node = r["text"], leaves[s][i]
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 and text is not None:
                node = leaf(r, "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
            for left, right in path:
                node = digest(left + node + right)
            proof = digest("".join(a + b for a, b in path))
            out.append((r["doc_id"], leaves[s][i], subs[k], root, proof, node, node == root))
    return sorted(out, key=repr)


def rows_of(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


def test_query_on_the_small_table(spark, small):
    docs = [r.asDict() for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    got = rows_of(M.op11_merkle(spark, small))
    assert got == plain(docs)
    assert 0 < sum(r[-1] for r in got) < len(got)


@pytest.mark.parametrize("every", [1, 2, 3])
def test_heights_checkpoints_hot_source_and_repeated_rows(spark, every):
    rows = [(k, f"Text {k % 7}", None, "hot", k, "clash") for k in range(140)]
    rows += [(None, None, None, None, None, None)] * 9 + [(5, "x", "en", None, 1, "")]
    for n in range(1, 30):  # sources of all small sizes, 31 of them
        rows += [(1000 * n + k, "Ab " * k, "en", f"s{n}é", k, None) for k in range(n)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = rows_of(M.proofs(*M.manifest(docs, fanout=3, every=every)))
    want = plain([dict(zip(("doc_id", "text", "lang", "source", "n_chars"), r)) for r in rows], 3)
    assert got == want


def test_one_row_is_its_own_root(spark):
    docs = spark.createDataFrame([(2, "A", None, "s", 1, None)], SCHEMA)
    (r,) = M.proofs(*M.manifest(docs)).collect()
    assert r.leaf == r.subroot == r.root and r.proof_sha256 == digest("")


def test_only_every_second_level_is_stored(spark):
    rows = [(k, str(k), None, "s", 1, None) for k in range(100)]
    sources, _ = M.manifest(spark.createDataFrame(rows, SCHEMA), fanout=3, every=2)
    assert [level.count() for level in sources.levels] == [100, 12, 2]
