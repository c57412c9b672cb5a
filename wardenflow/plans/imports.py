"""Findings of another analysis taken into a run (L9): merged, enriched, with earlier rulings kept."""

from __future__ import annotations

from pyspark.sql import DataFrame

from wardenflow.operators import findings as N
from wardenflow.operators import fold as D


def import_findings(before: DataFrame, imported: DataFrame, epss: DataFrame, kev: DataFrame, exposure: str | None = None, criticality: str | None = None) -> DataFrame:  # L9
    """The run's findings after an import: equal ones of both merged, risk from the feeds, and what was ruled before kept.

    ``before`` and ``imported`` have the columns of a finding. A finding that the merge takes into another does not
    stay beside it; an empty ``before`` starts a run.
    """
    merged = N.enrich(N.correlate(N.union_all(before, imported)), epss, kev, exposure, criticality)
    return D.merge_runs(before.join(merged.select("id"), "id", "left_semi").select(*before.columns), merged)
