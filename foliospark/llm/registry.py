"""Queries of this subpackage for __spark_entry__.py."""

from __future__ import annotations

from foliospark.llm import decontamination, divergence, embedding_dedup, html_wrappers, jaccard, language_id, packing, suffix_array, token_counts, toxicity, url_rules, warc, whitening

MODULES = [embedding_dedup, url_rules, html_wrappers, language_id, jaccard, decontamination, packing, warc, suffix_array, token_counts, whitening, toxicity, divergence]


def queries() -> dict:
    import corpus_pipeline

    return {k: f for m in MODULES for k, f in m.QUERIES.items()} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict:
    return {k: s for m in MODULES for k, s in m.ORACLES.items()}
