"""Operators of a training-data pipeline: one module each, with their queries and SQL."""

from __future__ import annotations

import importlib

MODULES = ("license_scan", "source_mix", "pii", "bit_sliced", "kmeans_tree", "simhash", "bpe", "toxicity", "url_filter", "suffix_dedup", "hard_negatives", "quality", "whitening")


def _modules():
    return [importlib.import_module(f"{__name__}.{m}") for m in MODULES]


def queries() -> dict:
    return {k: f for m in _modules() for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for m in _modules() for k, q in m.ORACLE_SQL.items()}
