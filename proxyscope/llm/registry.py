"""Queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

import corpus_pipeline
from proxyscope.llm import (
    byte_bpe, chat, collocations, embedding_dedup, fingerprint, jaccard, langid, lines, lm_score, mixing, packing, toxicity, whitening,
)

QUERIES = {
    "op1_jaccard_join": jaccard.op1_jaccard_join,
    "op2_ctw_score": lm_score.op2_ctw_score,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_chat_format": chat.op4_chat_format,
    "op5_fingerprints": fingerprint.op5_fingerprints,
    "op6_pack": packing.op6_pack,
    "op7_embedding_dedup": embedding_dedup.op7_embedding_dedup,
    "op8_substring_dedup": lines.op8_substring_dedup,
    "op9_language_id": langid.op9_language_id,
    "op10_mix_sources": mixing.op10_mix_sources,
    "op11_collocations": collocations.op11_collocations,
    "op12_whitening": whitening.op12_whitening,
    "op13_byte_bpe": byte_bpe.op13_byte_bpe,
    "pipeline": corpus_pipeline.run,
}

ORACLE_SQL = {
    "op4_chat_format": chat.OP4_SQL,
    "op5_fingerprints": fingerprint.OP5_SQL,
    "op7_embedding_dedup": embedding_dedup.OP7_SQL,
    "op10_mix_sources": mixing.OP10_SQL,
    "op11_collocations": collocations.OP11_SQL,
}
if corpus_pipeline.ORACLE_SQL is not None:
    ORACLE_SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
