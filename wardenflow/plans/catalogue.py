"""All queries over the driver's tables, and the flagship."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wardenflow.plans import code_queries, event_queries, finding_queries, graph_queries, operator_queries, output_queries, text_queries  # noqa: F401
from wardenflow.plans.registry import ORACLES, QUERIES  # noqa: F401


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events to windowed counts, first triggers, scored findings, in canonical order."""
    return QUERIES["brute_force_windows"](spark, sf_dir)
