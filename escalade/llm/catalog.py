"""Queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from escalade.llm import (
    chat, decontam, line_dedup, lm_score, near_dup, packing, periodic, pii, quality, search, toxicity, url_filter, whitening,
)

QUERIES = {
    "op1_pii": pii.op1_pii,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_url_filter": url_filter.op3_url_filter,
    "op4_minhash_near_dedup": near_dup.op4_minhash_near_dedup,
    "op5_best_fit_packing": packing.op5_best_fit_packing,
    "op6_line_dedup": line_dedup.op6_line_dedup,
    "op7_topk_search": search.op7_topk_search,
    "op8_lm_scoring": lm_score.op8_lm_scoring,
    "op9_chat_formatting": chat.op9_chat_formatting,
    "op10_benchmark_decontamination": decontam.op10_benchmark_decontamination,
    "op11_embedding_whitening": whitening.op11_embedding_whitening,
    "op12_quality_classifier": quality.op12_quality_classifier,
    "op13_periodic_runs": periodic.op13_periodic_runs,
}
ORACLES: dict[str, str] = {
    "op6_line_dedup": line_dedup.OP6_SQL,
    "op7_topk_search": search.OP7_SQL,
    "op9_chat_formatting": chat.OP9_SQL,
    "op10_benchmark_decontamination": decontam.OP10_SQL,
}
