"""All registered queries."""

from __future__ import annotations

from oppflow.plans import (  # noqa: F401
    q_aggregates, q_joins, q_lookups, q_queues, q_rules, q_sources, q_streams,
)
from oppflow.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
