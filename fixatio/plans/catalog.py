"""All registered queries."""

from __future__ import annotations

from fixatio.plans import (  # noqa: F401
    check_queries,
    feature_queries,
    learn_queries,
    report_queries,
    scene_queries,
    source_queries,
    stat_queries,
)
from fixatio.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
