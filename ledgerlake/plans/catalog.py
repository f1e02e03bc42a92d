"""All registered queries: importing the family modules registers them."""

from __future__ import annotations

from ledgerlake.plans import registry, registry_ingest, registry_more, registry_questions, registry_sources, registry_statement  # noqa: F401
from ledgerlake.plans.registry import ORACLE, QUERIES

__all__ = ["QUERIES", "ORACLE"]
