"""Queries of the numbered operators, and their SQL where SQL can express them."""

from __future__ import annotations

from clauseworks.llm import byte_bpe, decontaminate, impact, interpolation, jaccard_join, lattice, line_templates, maglev, merkle, quality, resample, token_counts, warc

QUERIES = {
    "op1_token_counts": token_counts.op1_token_counts,
    "op2_ngram_jaccard_join": jaccard_join.op2_ngram_jaccard_join,
    "op3_embedding_near_dedup": lattice.op3_embedding_near_dedup,
    "op4_quality_classifier": quality.op4_quality_classifier,
    "op5_benchmark_decontamination": decontaminate.op5_benchmark_decontamination,
    "op6_warc": warc.op6_warc,
    "op7_lm_scoring": interpolation.op7_lm_scoring,
    "op8_byte_bpe": byte_bpe.op8_byte_bpe,
    "op9_sharding": maglev.op9_sharding,
    "op10_line_dedup": line_templates.op10_line_dedup,
    "op11_merkle_manifest": merkle.op11_merkle_manifest,
    "op12_exact_topk": impact.op12_exact_topk,
    "op13_importance_resampling": resample.op13_importance_resampling,
}

ORACLE = {
    "op6_warc": warc.OP6_SQL,
    "op9_sharding": maglev.OP9_SQL,
    "op11_merkle_manifest": merkle.OP11_SQL,
    "op12_exact_topk": impact.OP12_SQL,
    "op13_importance_resampling": resample.OP13_SQL,
}
