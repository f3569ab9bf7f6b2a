"""All registered queries."""

from __future__ import annotations

from weir.plans import addresses, archives, boxes, feeds, guards, reads, records, sounds, streams, texts  # noqa: F401
from weir.plans.registry import QUERIES, oracle_sql

__all__ = ["QUERIES", "oracle_sql"]
