"""The queries and SQL of the training-data operators."""

from __future__ import annotations

from lexloom.llm import (
    bpe_codec,
    importance_resampling,
    language_id,
    line_dedup,
    mixing,
    ngram_join,
    quality_classifier,
    quality_rules,
    secrets,
    substring_dedup,
    token_counts,
    tokenizer_alignment,
    topk_search,
)

MODULES = (token_counts, quality_rules, ngram_join, secrets, topk_search, mixing, quality_classifier, substring_dedup, bpe_codec, language_id, line_dedup, importance_resampling, tokenizer_alignment)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
