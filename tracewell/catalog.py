"""Every registered query of the library and its SQL twin."""

from __future__ import annotations

from tracewell import registry
from tracewell.plans import (  # noqa: F401  (each registers its queries)
    audit_queries,
    delivery_queries,
    draft_queries,
    evidence_queries,
    intake_queries,
    ledger_queries,
    repair_queries,
    screening_queries,
    sequence_queries,
    stream_queries,
    text_queries,
    tree_queries,
    version_queries,
    visual_queries,
    web_queries,
)


def queries() -> dict:
    return dict(registry.QUERIES)


def oracle_sql() -> dict:
    return dict(registry.ORACLES)
