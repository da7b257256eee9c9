"""Every query and the pipeline on odd and on empty tables."""

import pytest

import corpus_pipeline
from renewlens.llm import queries

ALL = {**queries.QUERIES, "pipeline": corpus_pipeline.run}
EXPECTED = {
    "op1_mixing": 7,
    "op2_importance": 7,
    "op3_transcripts": 4,
    "op4_pii": 7,
    "op5_token_shards": 7,
    "op6_simhash": 7,
    "op7_toxicity": 7,
    "op8_html": 3,
    "op9_ann": 6,
    "op10_decontaminate": 7,
    "op11_merkle": 7,
    "op12_conversation_repair": 2,
    "op13_exact_dedup": 7,
}


@pytest.mark.parametrize("name", sorted(ALL))
def test_odd_tables(spark, odd, name):
    rows = ALL[name](spark, odd).collect()
    assert len(rows) == EXPECTED.get(name, len(rows))


@pytest.mark.parametrize("name", sorted(ALL))
def test_empty_tables(spark, empty, name):
    assert ALL[name](spark, empty).collect() == []


def test_defined_results(spark, odd):
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in queries.QUERIES["op9_ann"](spark, odd).collect()}
    assert got == {(0, 1): (60, 2.0), (0, 2): (3, 1.0), (0, 3): (4, 0.5), (60, 1): (0, 2.0), (60, 2): (3, 2.0), (60, 3): (4, 1.5)}
    hits = {r.doc_id: (r.n_words, r.n_hit, r.n_items) for r in queries.QUERIES["op10_decontaminate"](spark, odd).collect()}
    assert hits[2] == (11, 10, 1) and hits[1] == (6, 3, 0) and hits[None] == (0, 0, 0)
    same = {r.doc_id: r.component_id for r in queries.QUERIES["op6_simhash"](spark, odd).collect()}
    assert same[2] == same[3] == 2 and same[None] is None
    assert [r.text for r in queries.QUERIES["op8_html"](spark, odd).collect() if r.page_id == 3] == ["hi & x"]
