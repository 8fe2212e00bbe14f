"""Every registered query of the evaluation engine."""

from __future__ import annotations

from . import file_queries, gate_queries, listing_queries, metric_queries, prompt_queries, report_queries, text_queries, workflow_queries  # noqa: F401
from .registry import ORACLES, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
