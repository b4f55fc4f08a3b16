"""Queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from ledgerloom.llm import bpe, centroids, decontaminate, exact_dedup, hmm, merkle, near_dedup, pii, repeats, secrets, sentencepiece_bpe, toxicity, url_filter

MODULES = [bpe, url_filter, near_dedup, exact_dedup, pii, secrets, hmm, repeats, toxicity, decontaminate, sentencepiece_bpe, centroids, merkle]


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.SQL.items()}
