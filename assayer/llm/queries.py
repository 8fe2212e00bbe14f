"""The operators' queries and their SQL."""

from __future__ import annotations

import importlib

#: Module and query of each operator.
_QUERIES = {
    "op1_token_counts": "token_counts",
    "op2_quality": "quality",
    "op3_byte_bpe": "byte_bpe",
    "op4_secrets": "secrets",
    "op5_ngram_jaccard": "ngram_jaccard",
    "op6_substring_dedup": "substring_dedup",
    "op7_packing": "packing",
    "op8_embedding_dedup": "embedding_dedup",
    "op9_exact_dedup": "exact_dedup",
    "op10_language_id": "language_id",
    "op11_vector_codes": "vector_codes",
    "op12_line_dedup": "line_dedup",
    "op13_divergence": "source_divergence",
}


def queries() -> dict:
    found = {}
    for name, module in _QUERIES.items():
        m = importlib.import_module(f"{__package__}.{module}")
        found[name] = getattr(m, name)
        found |= getattr(m, "MORE_QUERIES", {})
    return found


def oracle_sql() -> dict[str, str]:
    found = {}
    for module in _QUERIES.values():
        found |= getattr(importlib.import_module(f"{__package__}.{module}"), "SQL", {})
    return found
