"""Reports and rule packs (K3-K9, K11, A3, A14, A21, T6-T9): ordered tables rendered on the driver.

Reports and worklists hold all findings. Their ordered lines are a table: ``write_...`` writes it from Spark as ordered
files, of any size; the functions that give a string read it part by part and are for what fits into one. Only the
summary has a limit, and says how many more there are.
"""

from __future__ import annotations

import html
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardenflow.functions import scalar as X
from wardenflow.functions import vocabulary as V
from wardenflow.functions.standards import standard_rows
from wardenflow.operators import findings as N
from wardenflow.operators import log_analysis as L
from wardenflow.operators import positional as P
from wardenflow.operators.fold import verify_worklist
from wardenflow.operators.windows import round_robin


def summary(findings: DataFrame, rows: int = 25) -> str:  # K5, T9
    counts = N.severity_counts(findings).first()
    head = "# Summary\n\n" + ", ".join(f"{counts[s]} {s}" for s in V.SEVERITIES) + "\n\n"
    lines = [f"- [{r.severity}] {r.title} ({r.file}:{r.line}) {r.status}" for r in N.ranked(findings, rows).collect()]
    more = sum(r["count"] for r in findings.groupBy("status").count().collect()) - len(lines)
    return head + "\n".join(lines + ([f"... and {more} more"] if more else [])) + "\n"


def _text(name: str):
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def _order() -> list:
    return [X.rank_score(F.col("risk"), F.col("severity")).alias("score"), X.severity_rank(F.col("severity")).alias("level"), "id"]


def _head(spark, rows: list[tuple]) -> DataFrame:
    """Lines beside those of findings: tier, part (0 before a tier's findings, 2 after), text."""
    return spark.createDataFrame(rows, "tier int, part int, text string").select("tier", "part", F.lit(None).cast("double").alias("score"), F.lit(None).cast("int").alias("level"), F.lit(None).cast("string").alias("id"), "text")


def _lines(entries: DataFrame, heads: DataFrame) -> DataFrame:
    return entries.unionByName(heads).orderBy("tier", "part", F.col("score").desc(), "level", "id").select("text")


def report_lines(findings: DataFrame) -> DataFrame:  # K5
    """``text``: findings by status in order; families of three or more as one line with their count. Headings count lines."""
    shown = N.families(findings).filter("lead is null or lead = id").filter(F.col("status").isin(*V.STATUSES))
    counts = {r.status: r["count"] for r in shown.groupBy("status").count().collect()}  # a row for each status
    times = F.when(F.col("members").isNotNull(), F.concat(F.lit(" ×"), F.col("members").cast("string"))).otherwise("")
    line = F.concat(F.lit("- **"), _text("severity"), F.lit("** "), _text("title"), F.lit(": "), _text("message"), times)
    entries = shown.select(X.status_rank(F.col("status")).cast("int").alias("tier"), F.lit(1).alias("part"), *_order(), line.alias("text"))
    heads = [(-1, 0, "# Report")] + [(V.STATUS_RANK[s], 0, f"\n## {s} ({counts.get(s, 0)})\n") for s in V.STATUSES]
    return _lines(entries, _head(findings.sparkSession, heads))


def report(findings: DataFrame) -> str:  # K5
    return "\n".join(r.text for r in report_lines(findings).toLocalIterator()) + "\n"


def write_report(findings: DataFrame, path: str) -> None:  # K5
    report_lines(findings).write.text(path)


def persist_findings(findings: DataFrame, folder: str) -> DataFrame:  # K2
    """Write findings and their counts into ``folder``; the counts are those of what was written, one row."""
    spark = findings.sparkSession
    findings.write.mode("overwrite").parquet(f"{folder}/findings")
    kept = spark.read.schema(findings.schema).parquet(f"{folder}/findings")
    counts = kept.agg(*[F.count_if(F.col("severity") == x).alias(x) for x in V.SEVERITIES], F.count(F.lit(1)).alias("findings"))
    counts.write.mode("overwrite").json(f"{folder}/counts")
    return spark.read.schema(counts.schema).json(f"{folder}/counts")


def html_lines(findings: DataFrame) -> DataFrame:  # K6
    def cell(value):
        for sign in "&<>\"'":
            value = F.replace(value, F.lit(sign), F.lit(html.escape(sign)))
        return F.concat(F.lit("<td>"), value, F.lit("</td>"))

    place = F.concat(_text("file"), F.lit(":"), _text("line"))
    row = F.concat(F.lit("<tr>"), *[cell(x) for x in (_text("severity"), _text("title"), place, _text("message"))], F.lit("</tr>"))
    entries = findings.select(F.coalesce(X.status_rank(F.col("status")).cast("int"), F.lit(99)).alias("tier"), F.lit(1).alias("part"), *_order(), row.alias("text"))
    first = "<!doctype html><meta charset=utf-8><title>Findings</title><table><tr><th>severity<th>title<th>place<th>message</tr>"
    return _lines(entries, _head(findings.sparkSession, [(-1, 0, first), (1 << 20, 2, "</table>")]))


def html_report(findings: DataFrame) -> str:  # K6
    return "".join(r.text for r in html_lines(findings).toLocalIterator())


def write_html(findings: DataFrame, path: str) -> None:  # K6
    html_lines(findings).write.text(path)


def path_diagram(hops: list[tuple[str, int]]) -> str:  # K6
    names = [f'  n{i}["{f}:{n}"]' for i, (f, n) in enumerate(hops)]
    return "\n".join(["flowchart LR", *names, *[f"  n{i} --> n{i + 1}" for i in range(len(hops) - 1)]])


WORK_KEYS = ("id", "severity", "title", "file", "line", "message")


def worklist(findings: DataFrame) -> str:  # K3
    rows = N.ranked(verify_worklist(findings)).select(*WORK_KEYS).toLocalIterator()
    return json.dumps([{k: r[k] for k in WORK_KEYS if r[k] is not None} for r in rows], indent=1)


def write_worklist(findings: DataFrame, path: str) -> None:  # K3
    """All items in order, as files of JSON lines."""
    N.ranked(verify_worklist(findings)).select(*WORK_KEYS).write.json(path)


def evidence(findings: DataFrame, lines: DataFrame, prefix: str) -> DataFrame:  # K11
    """The cited line of a finding, by its id or the beginning of it, with three lines around."""
    one = findings.filter(F.col("id").startswith(prefix)).select("id", "file", "line")
    return P.lines_around(one, lines, 3, 3).orderBy("id", "near_line")


def coverage_table(findings: DataFrame, standard: str, passes: list[str]) -> DataFrame:  # A14
    spark = findings.sparkSession
    return N.coverage(findings, spark.createDataFrame(standard_rows(standard), "code string, name string, kinds array<string>"), spark.createDataFrame([(p,) for p in passes], "kind string"))


def coverage_report(findings: DataFrame, standard: str, passes: list[str]) -> str:  # K7
    rows = coverage_table(findings, standard, passes).orderBy("code").collect()
    return "\n".join(["| part | name | findings | state |", "|-|-|-|-|", *[f"| {r.code} | {r.name} | {r.hits} | {r.state} |" for r in rows]])


def surface(sinks: DataFrame, entries: DataFrame, folders: DataFrame) -> DataFrame:  # A3, J15, T7
    """Score, entries and sinks of regions and files. sinks: file, kind, severity; entries: file, source."""
    hits = sinks.select("file", F.lit("sink").alias("role"), "kind", "severity").unionByName(entries.select("file", F.lit("entry").alias("role"), F.col("source").alias("kind"), F.lit(None).cast("string").alias("severity")))
    placed = P.longest_prefix(hits, "file", folders, "folder")
    return N.attack_surface(placed).orderBy("level", F.col("score").desc(), F.col("sinks").desc(), "region", "file")


def context_entries(entries: DataFrame, scores: DataFrame, most: int = 80) -> DataFrame:  # A21, T6, W6
    """One entry for each file and kind, production before tests, heavy kinds first, breadth first over files."""
    first = entries.groupBy("file", "source").agg(F.min("line").alias("line")).join(scores.select("file", "score"), "file", "left")
    ranked = first.withColumns({"test": X.is_test_path(F.col("file")).cast("int"), "weight": F.coalesce(X.lookup(V.ENTRY_WEIGHT, F.col("source")), F.lit(1))})
    turned = round_robin(ranked, "file", [F.col("weight").desc(), "line"])
    return turned.orderBy("turn", "test", F.col("weight").desc(), F.col("score").desc_nulls_last(), "file").limit(most).orderBy("file", "line")


def detection_pack() -> str:  # K8, X22
    """A rule in Sigma's format for each signature, for scanners and for failed logins, with ids that stay."""
    import hashlib

    def rule_id(seed: str) -> str:
        h = hashlib.sha1(seed.encode()).hexdigest()
        return f"{h[:8]}-{h[8:12]}-5{h[13:16]}-{'89ab'[int(h[16], 16) % 4]}{h[17:20]}-{h[20:32]}"

    def rule(seed: str, title: str, level: str, field: str, pattern: str) -> str:
        quoted = pattern.replace("'", "''")
        return f"title: '{title}'\nid: {rule_id(seed)}\nstatus: experimental\nlogsource:\n  category: webserver\ndetection:\n  selection:\n    {field}|re: '{quoted}'\n  condition: selection\nlevel: {level}\n"

    rules = [rule(sig, title, level, "cs-uri", pattern) for sig, _, level, pattern, title in L.SIGNATURES]
    rules.append(rule("scanner-ua", "Scanner user agent", "low", "cs-user-agent", "(?i)" + "|".join(L.SCANNERS)))
    rules.append(rule("auth-fail", "Failed logins", "medium", "message", "|".join(p for k, p in L.AUTH if k == "auth-fail")))
    return "---\n".join(rules)


def regression_rules(findings: DataFrame) -> str:  # K9
    """A pattern rule for each class and kind of confirmed findings."""
    rows = N.root_causes(findings).orderBy("category", "cwe").collect()
    return "rules:\n" + "".join(f"- id: regression-{r.category}-{(r.cwe or 'none').lower()}\n  message: seen in {r.members} confirmed findings\n" for r in rows)
