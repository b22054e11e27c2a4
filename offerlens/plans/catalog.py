"""All named queries."""

from __future__ import annotations

import importlib

from offerlens.plans.base import QUERIES, Query

MODULES = ("q_urls", "q_extract", "q_quota", "q_periods", "q_linkage", "q_coverage", "q_report", "q_state", "q_publish", "q_sinks", "q_stream", "q_run")


def load_queries() -> dict[str, Query]:
    for name in MODULES:
        importlib.import_module(f"offerlens.plans.{name}")
    return dict(QUERIES)
