"""Queries and their SQL, by operator."""

from __future__ import annotations

from . import decontamination, exact_dedup, html_extraction, language_id, mixing, ngram_join, pii, quality, substring_dedup, token_counts

MODULES = (mixing, exact_dedup, language_id, token_counts, quality, decontamination, html_extraction, pii, substring_dedup, ngram_join)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: s for m in MODULES for k, s in m.ORACLES.items()}
