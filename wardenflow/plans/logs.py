"""Log analysis from lines to findings."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame

from wardenflow.operators import log_analysis as L
from wardenflow.operators.findings import one_of_each, union_all
from wardenflow.operators.windows import numbered
from wardenflow.sources import logs as S
from wardenflow.storage import cut


@dataclass
class LogReport:
    events: DataFrame
    find: Callable[[], DataFrame]
    family_overflow: DataFrame
    leak_overflow: DataFrame
    statistics: dict[str, DataFrame]
    formats: DataFrame

    @cached_property
    def findings(self) -> DataFrame:
        """Found when first asked for: the behaviour of addresses is folded over tables of its own, which statistics do not need."""
        return self.find()


def analyze_logs(lines: DataFrame, window_s: int = L.WINDOW_S, redacted: bool = True) -> LogReport:
    """Findings and statistics of all of ``file, line, text``; files in order of path. For a run of ``BUDGETS`` give what ``line_budget`` leaves."""
    formats = cut(S.detect_formats(lines), "formats")
    run = numbered(lines, ["file", "line"], "idx")
    events = cut(S.parse(run.select("file", "line", "text", "idx"), formats), "events")
    signatures, family_overflow = L.signature_hits(events, redacted)
    leaked, leak_overflow = L.leaks(events, redacted)
    find = lambda: one_of_each(union_all(signatures, L.scanner_agents(events, redacted), leaked, L.behaviour(events, window_s)))
    return LogReport(events, find, family_overflow, leak_overflow, L.statistics(events), formats)
