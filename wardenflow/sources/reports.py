"""A folder of scanner reports as findings, with a row of status for each report.

Reports are rows of report, tool, content, read by Spark's own readers, so that a folder may be in any store and a report
is read where its partition is. A report's tool is the name of its folder, or else its file's name up to the first dot.
What is broken, empty or of no known tool is told in its row of status and gives no findings; other reports go on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardenflow.operators.findings import conform, one_of_each, union_all
from wardenflow.sources.tools import ADAPTERS, agent_export, sarif
from wardenflow.storage import cut

#: All formats by name: the scanners' own, and the two that any tool may write.
FORMATS = ADAPTERS | {"sarif": sarif, "agent-export": agent_export}
#: Formats that are no single JSON document.
LINES = ("yarn-audit", "package-checker", "cppcheck", "trufflehog", "govulncheck")


def tool_of(path: Column) -> Column:
    name = F.substring_index(path, "/", -1)
    folder = F.regexp_extract(path, "([^/]+)/[^/]*$", 1)
    return F.when(folder.isin(*FORMATS), folder).otherwise(F.substring_index(name, ".", 1))


def read_reports(spark: SparkSession, folder: str) -> DataFrame:
    """report (path), tool, content of all files below ``folder``; Spark passes over files of no bytes."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return with_tool(rows.select(F.col("path").alias("report"), F.decode("content", "UTF-8").alias("content")))


def with_tool(rows: DataFrame) -> DataFrame:
    return rows.select("report", tool_of(F.col("report")).alias("tool"), "content")


def status(reports: DataFrame) -> DataFrame:
    """report, tool and status: 'unknown' tool, 'empty', 'broken' JSON, or 'read'."""
    text = F.regexp_replace(F.coalesce("content", F.lit("")), r"\s+", "")
    broken = ~F.col("tool").isin(*LINES) & F.try_parse_json("content").isNull()
    state = F.when(~F.coalesce(F.col("tool").isin(*FORMATS), F.lit(False)), "unknown").when(text == "", "empty").when(broken, "broken").otherwise("read")
    return reports.select("report", "tool", state.alias("status"), "content")


def report_findings(reports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Findings of all reports, one row for each id, and the reports' status (report, tool, status)."""
    told = cut(status(reports), "status")  # each format reads it
    good = told.filter("status = 'read'")
    tools = sorted(r.tool for r in good.select("tool").distinct().collect())  # no more than there are formats
    parts = [FORMATS[t](good.filter(F.col("tool") == t).select("content")) for t in tools]
    none = conform(reports.sparkSession.createDataFrame([], "title string, tool string, file string, line int, version string"))
    return one_of_each(union_all(*parts)) if parts else none, told.drop("content")
