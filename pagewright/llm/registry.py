"""Queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from pagewright.llm import ann_search, embedding_dedup, html_extraction, importance, language_id, license_scan, mixing, packing, periodic_runs, secret_scan, simhash, source_audit, url_filter

_MODULES = (license_scan, url_filter, mixing, packing, secret_scan, simhash, embedding_dedup, language_id, ann_search, importance, source_audit, html_extraction, periodic_runs)


def queries() -> dict:
    return {name: query for module in _MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
