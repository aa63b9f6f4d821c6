"""All registered market-data queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = ("bars_flow", "profile_structure", "outcome_queries", "events_derivatives", "location_triggers", "study_book", "study_relations", "study_statistics", "trade_queries", "trigger_records", "stream_queries", "source_queries", "archive_queries", "anchor_queries", "state_queries", "resampling_queries", "liquidity_queries", "auction_queries")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for name in MODULES:
        found |= import_module(f"tapeloom.plans.{name}").QUERIES
    return found


def oracle_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for name in MODULES:
        found |= import_module(f"tapeloom.plans.{name}").SQL
    return found
