"""All registered queries."""
from __future__ import annotations

from alertloom.plans import (q_collector, q_grouping, q_intake, q_manual, q_prompts, q_queue, q_records, q_reports,   # noqa: F401
                             q_scalar, q_sources, q_streams)
from alertloom.plans import registry


def queries():
    return registry.callables()


def oracle_sql() -> dict[str, str]:
    return dict(registry.ORACLES)
