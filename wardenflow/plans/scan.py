"""The scan: a source tree to ranked findings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardenflow.functions import scalar as X
from wardenflow.operators import code_detect as C
from wardenflow.operators import findings as N
from wardenflow.operators import workflows as W
from wardenflow.operators.findings import union_all
from wardenflow.sources import ignore as I
from wardenflow.sources import repo as S
from wardenflow.sources.feeds import codeowners
from wardenflow.storage import cut

#: Depth of paths and most taint findings, by budget. Fixed values.
BUDGETS = {"quick": (3, 200), "standard": (6, 1000), "thorough": (8, 5000)}


@dataclass
class ScanReport:
    findings: DataFrame
    scan: DataFrame
    sinks: DataFrame
    truncated: int


def scan_tree(files: DataFrame, tools: DataFrame | None = None, epss: DataFrame | None = None, kev: DataFrame | None = None, lock: DataFrame | None = None, budget: str = "standard", orphans: bool = False, log_hygiene: bool = False, include_tests: bool = False, gitignore: bool = False, strict_scope: bool = False, context: str | None = None, owners: str | None = None) -> ScanReport:
    """Findings of ``file, content`` and of scanners (``tools``), correlated, de-noised, enriched and in canonical order.

    Findings of scanners in folders that the scan never reads are left out, and with ``gitignore`` what the tree's own
    ignore files leave out is neither read nor taken from scanners. ``context``: text of the project's context document,
    whose exposure and criticality weigh in the risk. ``owners``: text of a CODEOWNERS file, which names each finding's owners.
    """
    depth, most = BUDGETS[budget]
    if gitignore:
        rules = cut(I.ignore_rules(files), "ignore")
        files = I.not_ignored(files, rules)
    files = cut(files, "files")
    if tools is not None:
        tools = N.prune_paths(tools, F.col("file").rlike(S.IGNORED))[0]
        if gitignore:
            tools = tools.join(I.ignored(tools.select("file").filter("file is not null"), rules), "file", "left_anti").select(*tools.columns)
    scan = cut(S.scan_files(files), "scan")
    lines = cut(S.source_lines(files), "lines")
    taint, sinks, truncated = C.taint_candidates(scan, lines, depth, most, files=files, strict_scope=strict_scope)
    taint = cut(taint, "taint")
    parts = [taint, C.audit_web(lines), C.audit_auth(lines), C.audit_cloud(lines), W.audit_workflows(lines), C.credential_uris(lines)]
    if orphans:
        parts.append(C.orphan_sinks(sinks, taint))
    if log_hygiene:
        found, left = C.sensitive_logs(scan, lines)
        parts.append(found)
        truncated += left
    pool = N.one_of_each(union_all(*parts, *([tools] if tools is not None else [])))
    merged = cut(N.correlate(pool), "merged")
    clean = N.demote(merged, lines, files, include_tests)
    if lock is not None:
        clean = N.mark_toolchain(clean, lock)
    spark = files.sparkSession
    if owners is not None:
        clean = I.owned(clean.drop("owners"), codeowners(spark, owners))
    epss = epss if epss is not None else spark.createDataFrame([], "cve string, epss double")
    kev = kev if kev is not None else spark.createDataFrame([], "cve string")
    facts = spark.range(1).select(X.deployment_facts(F.lit(context)).alias("f")).first().f if context else None
    return ScanReport(N.ranked(N.enrich(clean, epss, kev, *(facts or (None, None)))), scan, sinks, truncated)
