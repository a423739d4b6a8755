"""Named queries over the given tables, each with its SQL twin where SQL can say it."""

from __future__ import annotations

import importlib

MODULES = (
    "scalar_queries",
    "split_queries",
    "sample_queries",
    "join_queries",
    "expansion_queries",
    "score_queries",
    "gate_queries",
    "study_queries",
    "source_queries",
    "stream_queries",
    "site_queries",
    "plan_queries",
)


def load() -> tuple[dict, dict]:
    """Register every query; returns (queries, SQL texts)."""
    for name in MODULES:
        importlib.import_module(f"{__name__}.{name}")
    from agentcorpus.catalogue.base import ORACLES, QUERIES

    return QUERIES, ORACLES
