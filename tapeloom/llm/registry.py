"""Queries and SQL of every operator in this subpackage."""

from __future__ import annotations

from tapeloom.llm import embedding_dedup, exact_dedup, line_dedup, near_dedup, packing, pii, quality, secrets, segmentation, spelling, toxicity, warc, whitening

MODULES = (pii, toxicity, segmentation, near_dedup, line_dedup, warc, quality, exact_dedup, packing, secrets, embedding_dedup, spelling, whitening)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items()}
