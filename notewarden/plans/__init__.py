"""Queries over the given tables, one module per family."""

from __future__ import annotations

from importlib import import_module

from .registry import REGISTRY, Query

FAMILIES = ["text_queries", "redaction_queries", "variance_queries", "table_queries", "extraction_queries", "clinical_queries", "stream_queries", "run_queries", "evidence_queries"]


def load_all() -> dict[str, Query]:
    for family in FAMILIES:
        import_module(f"{__name__}.{family}")
    return REGISTRY
