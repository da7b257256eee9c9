"""Queries of the operators and the SQL of those that SQL can express."""

from __future__ import annotations

from renewlens.llm.op10_decontaminate import op10_decontaminate
from renewlens.llm import op11_merkle, op12_conversation_repair, op13_exact_dedup
from renewlens.llm.op5_token_shards import op5_token_shards
from renewlens.llm.op6_simhash import op6_simhash
from renewlens.llm.op7_toxicity import op7_toxicity
from renewlens.llm.op4_pii import op4_pii
from renewlens.llm.op1_mixing import op1_mixing
from renewlens.llm.op8_html import op8_html
from renewlens.llm.op9_ann import op9_ann
from renewlens.llm.op2_importance import op2_importance
from renewlens.llm.op3_transcripts import op3_transcripts

QUERIES = {
    "op3_transcripts": op3_transcripts,
    "op2_importance": op2_importance,
    "op9_ann": op9_ann,
    "op8_html": op8_html,
    "op1_mixing": op1_mixing,
    "op4_pii": op4_pii,
    "op7_toxicity": op7_toxicity,
    "op6_simhash": op6_simhash,
    "op5_token_shards": op5_token_shards,
    "op10_decontaminate": op10_decontaminate,
    "op11_merkle": op11_merkle.op11_merkle,
    "op12_conversation_repair": op12_conversation_repair.op12_conversation_repair,
    "op13_exact_dedup": op13_exact_dedup.op13_exact_dedup,
}

ORACLES: dict[str, str] = {"op11_merkle": op11_merkle.ORACLE, "op13_exact_dedup": op13_exact_dedup.ORACLE}
