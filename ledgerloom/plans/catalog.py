"""Registered queries of the library's own operators."""

from __future__ import annotations

from ledgerloom.functions import normalize, planning, rules
from ledgerloom.operators import cases, chunking, evaluate, evidence, facts, hybrid, levels, lexicon, observability, packing, postings, quantiles, ranking, records, retrieval, vector_index, versions
from ledgerloom.sources import loader, readers, rows
from ledgerloom.streaming import jobs, progress, state

MODULES = [retrieval, vector_index, postings, levels, lexicon, quantiles, hybrid, cases, facts, normalize, planning, chunking, evidence, rules, observability, records, versions, evaluate, ranking, packing, state, jobs, progress, readers, loader, rows]


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.SQL.items()}
