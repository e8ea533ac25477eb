"""Queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from flowgauge.llm import (
    bpe,
    hard_negatives,
    html_text,
    lexical_search,
    near_duplicates,
    packing,
    personal_data,
    quality_rules,
    sharding,
    token_counts,
    token_files,
    top_k,
    toxicity,
)
from flowgauge.llm.workers import with_workers

MODULES = {
    "op1_main_text": html_text,
    "op2_quality_rules": quality_rules,
    "op3_top_k": top_k,
    "op4_token_counts": token_counts,
    "op5_personal_data": personal_data,
    "op6_sharding": sharding,
    "op7_toxicity": toxicity,
    "op8_ngram_jaccard_join": near_duplicates,
    "op9_packing": packing,
    "op10_bpe": bpe,
    "op11_lexical_search": lexical_search,
    "op12_hard_negatives": hard_negatives,
    "op13_token_files": token_files,
}


def queries() -> dict:
    return {name: with_workers(module.query) for name, module in MODULES.items()}


def oracle_sql() -> dict:
    return {name: module.SQL for name, module in MODULES.items() if hasattr(module, "SQL")}
