"""Registered queries of the funding operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans import caches, floors, gaps, levels, models, panels, reports, runs, scans, selections

FLAGSHIP = "floor_share_by_phase"
PARTS = (floors, panels, runs, gaps, models, reports, scans, selections, caches, levels)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q for part in PARTS for name, (q, _) in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in PARTS for name, (_, sql) in part.QUERIES.items() if sql}
