"""Scanner outputs as findings (S12-S18): a table of ``content`` goes in, rows of FINDING come out.

A report is parsed once by ``from_json`` with the part of its schema that is read; parts that are absent are NULL and
give no rows. Reports with several documents in a row (JSON lines) have one row each.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardenflow.functions import scalar as X
from wardenflow.operators.findings import conform, union_all

Adapter = Callable[[DataFrame], DataFrame]
ADAPTERS: dict[str, Adapter] = {}


def adapter(*names: str):
    def register(f: Adapter) -> Adapter:
        for n in names:
            ADAPTERS[n] = f
        return f

    return register


def contents(spark: SparkSession, *texts: str) -> DataFrame:
    return spark.createDataFrame([(t,) for t in texts], "content string")


def read_report(spark: SparkSession, path: str, by_line: bool = False) -> DataFrame:
    return spark.read.text(path, wholetext=not by_line).withColumnRenamed("value", "content")


def parse(df: DataFrame, schema: str) -> DataFrame:
    return df.select(F.from_json("content", schema).alias("j")).select("j.*")


def each(df: DataFrame, column: str, name: str, *keep: str) -> DataFrame:
    return df.select(*keep, F.explode(column).alias(name))


def found(df: DataFrame, tool: str, category: str, **parts: Column | str) -> DataFrame:
    """Findings of one tool; ``parts`` are columns of FINDING, and ident. Rows without ident are left out."""
    out = {k: v if isinstance(v, Column) else F.lit(v) for k, v in parts.items()}
    ident = out.get("ident", out.get("title"))
    out |= {"tool": F.lit(tool), "category": F.lit(category), "title": F.coalesce(out.get("title", ident), ident), "ident": ident}
    out.setdefault("message", out["title"])
    if "aliases" in out:
        out["aliases"] = F.array_distinct(F.array_compact(F.concat(F.array(ident), F.coalesce(out["aliases"], F.array().cast("array<string>")))))
        out["cve"] = X.pick_cve(out["aliases"])
    if "file" in out:
        out["line"] = F.when(out["file"].isNotNull(), F.coalesce(out.get("line", F.lit(None)).cast("int"), F.lit(1)))
    rows = df.select(*[v.alias(k) for k, v in out.items()])
    return conform(rows.filter("coalesce(ident, '') <> ''"))  # an object where an array is due parses as one empty row


def _cwe(number: Column) -> Column:
    return F.when(number.isNotNull() & (number.cast("string") != ""), F.concat(F.lit("CWE-"), F.regexp_extract(number.cast("string"), r"(\d+)", 1)))


@adapter("trivy")
def trivy(df: DataFrame) -> DataFrame:
    r = each(parse(df, "Results array<struct<Target string, Vulnerabilities array<struct<VulnerabilityID string, PkgName string, InstalledVersion string, Severity string, Title string, CweIDs array<string>, References array<string>>>, Secrets array<struct<RuleID string, Title string, Severity string, StartLine int>>, Misconfigurations array<struct<ID string, Title string, Severity string, CauseMetadata struct<StartLine int>>>>>"), "Results", "r").select("r.*")
    v, s, m = each(r, "Vulnerabilities", "v", "Target"), each(r, "Secrets", "v", "Target"), each(r, "Misconfigurations", "v", "Target")
    c = F.col
    return union_all(
        found(v, "trivy", "dep", ident=c("v.VulnerabilityID"), title=c("v.Title"), severity=X.normalize_severity(c("v.Severity")), aliases=F.array().cast("array<string>"), pkg=c("v.PkgName"), version=c("v.InstalledVersion"), file=c("Target"), cwe=F.get("v.CweIDs", F.lit(0)), references=c("v.References")),
        found(s, "trivy", "secret", ident=c("v.RuleID"), title=c("v.Title"), severity=X.normalize_severity(c("v.Severity")), file=c("Target"), line=c("v.StartLine")),
        found(m, "trivy", "config", ident=c("v.ID"), title=c("v.Title"), severity=X.normalize_severity(c("v.Severity")), file=c("Target"), line=c("v.CauseMetadata.StartLine")),
    )


@adapter("osv-scanner")
def osv(df: DataFrame) -> DataFrame:
    r = each(parse(df, "results array<struct<source struct<path string>, packages array<struct<package struct<name string, version string>, vulnerabilities array<struct<id string, aliases array<string>, summary string, database_specific struct<severity string>>>, groups array<struct<ids array<string>, max_severity string>>>>>>"), "results", "r").select(F.col("r.source.path").alias("path"), F.explode("r.packages").alias("p"))
    v = r.select("path", "p.package", "p.groups", F.explode("p.vulnerabilities").alias("v"))
    own = F.get(F.filter("groups", lambda g: F.array_contains(g["ids"], F.col("v.id"))), F.lit(0))["max_severity"]
    severity = F.when(own.isNotNull() & (own != ""), X.derive_severity(own)).otherwise(X.normalize_severity(F.col("v.database_specific.severity")))
    return found(v, "osv-scanner", "dep", ident=F.col("v.id"), title=F.col("v.summary"), severity=severity, aliases=F.col("v.aliases"), pkg=F.col("package.name"), version=F.col("package.version"), file=F.col("path"))


@adapter("grype")
def grype(df: DataFrame) -> DataFrame:
    m = each(parse(df, "matches array<struct<vulnerability struct<id string, severity string, description string, urls array<string>, cvss array<struct<metrics struct<baseScore double>>>>, relatedVulnerabilities array<struct<id string>>, artifact struct<name string, version string, locations array<struct<path string>>>>>"), "matches", "m").select("m.*")
    score = F.array_max(F.transform("vulnerability.cvss", lambda x: x["metrics"]["baseScore"]))
    label = F.col("vulnerability.severity")
    severity = F.when(label.isNull() | (F.lower(label) == "unknown"), X.score_to_severity(score)).otherwise(X.normalize_severity(label))
    return found(m, "grype", "dep", ident=F.col("vulnerability.id"), message=F.coalesce("vulnerability.description", "vulnerability.id"), severity=severity, aliases=F.col("relatedVulnerabilities.id"), pkg=F.col("artifact.name"), version=F.col("artifact.version"), file=F.get("artifact.locations", F.lit(0))["path"], references=F.col("vulnerability.urls"))


ADVISORY = "struct<module_name string, severity string, title string, cves array<string>, cwe string, url string, github_advisory_id string, findings array<struct<version string>>>"


def _advisories(a: DataFrame, tool: str) -> DataFrame:
    ident = F.coalesce("a.github_advisory_id", X.ghsa_from_url(F.col("a.url")), F.get("a.cves", F.lit(0)), "a.title")
    return found(a, tool, "dep", ident=ident, title=F.col("a.title"), severity=X.normalize_severity(F.col("a.severity")), aliases=F.col("a.cves"), pkg=F.col("a.module_name"), version=F.get("a.findings", F.lit(0))["version"], cwe=X.first_cwe(F.col("a.cwe")), references=F.array_compact(F.array("a.url")))


@adapter("npm-audit")
def npm(df: DataFrame) -> DataFrame:
    """Version 6 and 7 reports; string entries of 'via' name other packages and are skipped."""
    j = parse(df, f"advisories map<string, {ADVISORY}>, vulnerabilities map<string, struct<name string, severity string, via array<string>, range string>>")
    old = _advisories(j.select(F.explode(F.map_values("advisories")).alias("a")), "npm-audit")
    v = j.select(F.explode(F.map_values("vulnerabilities")).alias("v")).select("v.name", F.explode("v.via").alias("x")).filter(F.ltrim("x").startswith("{"))
    v = v.select("name", F.from_json("x", "source long, name string, title string, url string, severity string, cwe array<string>, range string").alias("x"))
    ident = F.coalesce(X.ghsa_from_url(F.col("x.url")), F.col("x.source").cast("string"))
    new = found(v, "npm-audit", "dep", ident=ident, title=F.col("x.title"), severity=X.normalize_severity(F.col("x.severity")), aliases=F.array().cast("array<string>"), pkg=F.coalesce("x.name", "name"), version=F.col("x.range"), cwe=F.get("x.cwe", F.lit(0)), references=F.array_compact(F.array("x.url")))
    return union_all(old, new).dropDuplicates(["id"])


@adapter("pnpm-audit")
def pnpm(df: DataFrame) -> DataFrame:
    return _advisories(parse(df, f"advisories map<string, {ADVISORY}>").select(F.explode(F.map_values("advisories")).alias("a")), "pnpm-audit")


@adapter("yarn-audit")
def yarn(df: DataFrame) -> DataFrame:
    """Lines of the classic and the later report."""
    lines = df.select(F.explode(F.split("content", r"\r?\n")).alias("content")).filter(F.ltrim("content").startswith("{"))
    old = parse(lines, f"type string, data struct<advisory {ADVISORY}>").filter("type = 'auditAdvisory'").select(F.col("data.advisory").alias("a"))
    new = parse(lines, "value string, children struct<ID string, Issue string, URL string, Severity string, `Vulnerable Versions` string>").filter("children is not null").select("value", "children.*")
    later = found(new, "yarn-audit", "dep", ident=F.coalesce(X.ghsa_from_url(F.col("URL")), "ID"), title=F.col("Issue"), severity=X.normalize_severity(F.col("Severity")), aliases=F.array().cast("array<string>"), pkg=F.col("value"), version=F.col("Vulnerable Versions"), references=F.array_compact(F.array("URL")))
    return union_all(_advisories(old, "yarn-audit"), later).dropDuplicates(["id"])


@adapter("pip-audit")
def pip_audit(df: DataFrame) -> DataFrame:
    d = each(parse(df, "dependencies array<struct<name string, version string, vulns array<struct<id string, aliases array<string>, description string>>>>"), "dependencies", "d").select("d.name", "d.version", F.explode("d.vulns").alias("v"))
    return found(d, "pip-audit", "dep", ident=F.col("v.id"), message=F.coalesce("v.description", "v.id"), severity="medium", aliases=F.col("v.aliases"), pkg=F.col("name"), version=F.col("version"))


@adapter("cargo-audit")
def cargo(df: DataFrame) -> DataFrame:
    item = "struct<kind string, advisory struct<id string, title string, cvss string, aliases array<string>>, package struct<name string, version string>>"
    j = parse(df, f"vulnerabilities struct<list array<{item}>>, warnings map<string, array<{item}>>")
    hard = j.select(F.explode("vulnerabilities.list").alias("v"), F.lit(False).alias("warn"))
    soft = j.select(F.explode(F.flatten(F.map_values("warnings"))).alias("v"), F.lit(True).alias("warn"))
    v = hard.unionByName(soft).filter("v.advisory is not null")
    severity = F.when(F.col("warn"), "low").otherwise(X.derive_severity(F.col("v.advisory.cvss")))
    return found(v, "cargo-audit", "dep", ident=F.col("v.advisory.id"), title=F.col("v.advisory.title"), severity=severity, aliases=F.col("v.advisory.aliases"), pkg=F.col("v.package.name"), version=F.col("v.package.version"))


def json_stream(df: DataFrame) -> DataFrame:  # S15
    """A row for each JSON document of texts that hold several in a row; what is not JSON is skipped to the next brace."""

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        decode = json.JSONDecoder().raw_decode
        for batch in batches:
            out = []
            for text in batch["content"]:
                at = (text or "").find("{")
                while at >= 0:
                    try:
                        _, end = decode(text, at)
                        out.append(text[at:end])
                    except ValueError:
                        end = at + 1
                    at = text.find("{", end)
            yield pd.DataFrame({"content": out}, dtype=object)

    return df.select("content").mapInPandas(split, "content string")


@adapter("govulncheck")
def govulncheck(df: DataFrame) -> DataFrame:  # J20
    j = parse(json_stream(df), "osv struct<id string, aliases array<string>, summary string>, finding struct<osv string, trace array<struct<module string, version string, function string, position struct<filename string, line int>>>>")
    facts = j.filter("osv is not null").select("osv.*").dropDuplicates(["id"])
    hits = j.filter("finding is not null").select(F.col("finding.osv").alias("osv_id"), F.get("finding.trace", F.lit(0)).alias("t"), F.element_at("finding.trace", -1).alias("site")).join(facts, F.col("osv_id") == F.col("id"), "left")
    reached = F.col("t.function").isNotNull()
    rows = found(hits, "govulncheck", "dep", ident=F.col("osv_id"), title=F.col("summary"), severity=F.when(reached, "high").otherwise("medium"), confidence=F.when(reached, "high").otherwise("medium"), aliases=F.col("aliases"), pkg=F.col("t.module"), version=F.col("t.version"), file=F.col("site.position.filename"), line=F.col("site.position.line"))
    return rows.dropDuplicates(["id"])


@adapter("package-checker")
def package_checker(df: DataFrame) -> DataFrame:
    """A line for each affected package@version."""
    p = df.select(F.explode(F.split("content", r"\r?\n")).alias("x")).filter(F.trim("x").rlike(r"^\S+@\S+$")).select(X.split_pkg_version(F.trim("x")).alias("p"))
    return found(p, "package-checker", "dep", ident=F.concat_ws("@", "p.pkg", "p.version"), title=F.concat(F.lit("Known malicious package: "), "p.pkg"), severity="critical", confidence="high", pkg=F.col("p.pkg"), version=F.col("p.version"), cwe="CWE-506")


@adapter("guarddog")
def guarddog(df: DataFrame) -> DataFrame:
    j = parse(df, "package string, results map<string, string>").select("package", F.explode("results").alias("rule", "detail")).filter("detail is not null and detail not in ('', '{}', '[]', 'null')")
    return found(j, "guarddog", "dep", ident=F.concat_ws(":", "package", "rule"), title=F.col("rule"), message=F.col("detail"), severity="high", confidence="low", pkg=F.col("package"), cwe="CWE-506")


@adapter("semgrep", "opengrep")
def semgrep(df: DataFrame) -> DataFrame:
    r = each(parse(df, "results array<struct<check_id string, path string, start struct<line int>, extra struct<severity string, message string, sca_info string, metadata struct<cwe string>>>>"), "results", "r").select("r.*").filter("extra.sca_info is null")
    return found(r, "semgrep", "sast", ident=F.col("check_id"), message=F.col("extra.message"), severity=X.normalize_severity(F.col("extra.severity")), file=F.col("path"), line=F.col("start.line"), cwe=X.first_cwe(F.col("extra.metadata.cwe")))


@adapter("bandit")
def bandit(df: DataFrame) -> DataFrame:
    r = each(parse(df, "results array<struct<test_id string, test_name string, issue_severity string, issue_confidence string, issue_text string, filename string, line_number int, issue_cwe struct<id int>>>"), "results", "r").select("r.*")
    return found(r, "bandit", "sast", ident=F.col("test_id"), title=F.col("test_name"), message=F.col("issue_text"), severity=X.normalize_severity(F.col("issue_severity")), confidence=F.lower("issue_confidence"), file=F.col("filename"), line=F.col("line_number"), cwe=_cwe(F.col("issue_cwe.id")))


@adapter("gosec")
def gosec(df: DataFrame) -> DataFrame:
    r = each(parse(df, "Issues array<struct<severity string, confidence string, cwe struct<id string>, rule_id string, details string, file string, line string>>"), "Issues", "r").select("r.*")
    return found(r, "gosec", "sast", ident=F.col("rule_id"), title=F.col("details"), severity=X.normalize_severity(F.col("severity")), confidence=F.lower("confidence"), file=F.col("file"), line=F.split_part(F.col("line"), F.lit("-"), F.lit(1)).cast("int"), cwe=_cwe(F.col("cwe.id")))


# Classes of some checks.
CPPCHECK_CWE = {"bufferAccessOutOfBounds": "CWE-788", "arrayIndexOutOfBounds": "CWE-788", "nullPointer": "CWE-476", "uninitvar": "CWE-457", "memleak": "CWE-401", "doubleFree": "CWE-415", "useAfterFree": "CWE-416", "resourceLeak": "CWE-772", "zerodiv": "CWE-369", "integerOverflow": "CWE-190"}


@adapter("cppcheck")
def cppcheck(df: DataFrame) -> DataFrame:
    p = df.select(F.explode(F.split("content", r"\r?\n")).alias("x")).select(F.split("x", "\t").alias("p")).filter(F.size("p") >= 5)
    return found(p, "cppcheck", "sast", ident=F.col("p")[3], message=F.col("p")[4], severity=X.normalize_severity(F.col("p")[2]), file=F.col("p")[0], line=F.col("p")[1].try_cast("int"), cwe=X.lookup(CPPCHECK_CWE, F.col("p")[3]))


@adapter("checkov")
def checkov(df: DataFrame) -> DataFrame:
    """One result object or an array of them."""
    item = "struct<results struct<failed_checks array<struct<check_id string, check_name string, file_path string, file_line_range array<int>, severity string>>>>"
    wrapped = df.select(F.when(F.ltrim("content").startswith("["), F.col("content")).otherwise(F.concat(F.lit("["), "content", F.lit("]"))).alias("content"))
    c = wrapped.select(F.explode(F.from_json("content", f"array<{item}>")).alias("r")).select(F.explode("r.results.failed_checks").alias("c")).select("c.*")
    return found(c, "checkov", "config", ident=F.col("check_id"), title=F.col("check_name"), severity=X.normalize_severity(F.col("severity")), file=F.ltrim(F.col("file_path"), F.lit("/")), line=F.get("file_line_range", F.lit(0)))


@adapter("hadolint")
def hadolint(df: DataFrame) -> DataFrame:
    r = df.select(F.explode(F.from_json("content", "array<struct<file string, line int, level string, code string, message string>>")).alias("r")).select("r.*")
    level = X.lookup({"error": "high", "warning": "medium", "info": "low", "style": "info"}, F.lower("level"))
    return found(r, "hadolint", "config", ident=F.col("code"), message=F.col("message"), severity=F.coalesce(level, F.lit("medium")), file=F.col("file"), line=F.col("line"))


@adapter("gitleaks")
def gitleaks(df: DataFrame) -> DataFrame:
    r = df.select(F.explode(F.from_json("content", "array<struct<RuleID string, Description string, File string, StartLine int, Commit string>>")).alias("r")).select("r.*")
    return found(r, "gitleaks", "secret", ident=F.concat_ws(":", "RuleID", F.nullif("Commit", F.lit(""))), title=F.col("Description"), severity="high", file=F.col("File"), line=F.col("StartLine"))


@adapter("trufflehog")
def trufflehog(df: DataFrame) -> DataFrame:
    """JSON lines; line numbers count from 0 there. A verified secret is critical."""
    place = "struct<file string, line int>"
    lines = df.select(F.explode(F.split("content", r"\r?\n")).alias("content")).filter(F.ltrim("content").startswith("{"))
    r = parse(lines, f"DetectorName string, Verified boolean, SourceMetadata struct<Data struct<Filesystem {place}, Git {place}>>").filter("DetectorName is not null")
    at = F.coalesce("SourceMetadata.Data.Filesystem", "SourceMetadata.Data.Git")
    return found(r, "trufflehog", "secret", ident=F.col("DetectorName"), title=F.concat("DetectorName", F.lit(" credential")), severity=F.when(F.col("Verified"), "critical").otherwise("high"), verified=F.col("Verified"), file=at["file"], line=at["line"] + 1)


SARIF = "runs array<struct<tool struct<driver struct<rules array<struct<id string, shortDescription struct<text string>, defaultConfiguration struct<level string>, properties struct<`security-severity` string, tags array<string>>>>>>, results array<struct<ruleId string, ruleIndex int, level string, message struct<text string>, locations array<struct<physicalLocation struct<artifactLocation struct<uri string>, region struct<startLine int>>>>>>>>"


def sarif(df: DataFrame, tool: str = "sarif", category: str = "sast") -> DataFrame:  # S16, J20
    """SARIF 2.1.0: the rule by id, else by index; severity from its score, else the result's level, else the rule's."""
    runs = parse(df, SARIF).select(F.explode("runs").alias("r")).select(F.col("r.tool.driver.rules").alias("rules"), F.explode("r.results").alias("x"))
    by_id = F.get(F.filter("rules", lambda r: r["id"] == F.col("x.ruleId")), F.lit(0))
    r = runs.withColumn("rule", F.coalesce(by_id, F.when(F.col("x.ruleIndex") >= 0, F.get("rules", F.col("x.ruleIndex")))))
    score = F.col("rule.properties")["security-severity"].try_cast("double")
    severity = F.when(score.isNotNull(), X.score_to_severity(score)).otherwise(X.normalize_severity(F.coalesce("x.level", "rule.defaultConfiguration.level")))
    at = F.get("x.locations", F.lit(0))["physicalLocation"]
    return found(r, tool, category, ident=F.coalesce("x.ruleId", "rule.id"), title=F.coalesce("rule.shortDescription.text", "x.ruleId"), message=F.col("x.message.text"), severity=severity, file=at["artifactLocation"]["uri"], line=at["region"]["startLine"], cwe=X.first_cwe(F.array_join("rule.properties.tags", " ")))


ADAPTERS["kingfisher"] = lambda df: sarif(df, "kingfisher", "secret")


def upstream_export(df: DataFrame, category: Callable[[Column], Column] = X.normalize_category) -> DataFrame:  # S18
    """Findings of an agent's export; rows without a location are left out, slugs become categories by ``category``."""
    r = df.select(F.explode(F.from_json("content", "array<struct<slug string, title string, severity string, confidence string, file string, line int, reasoning string>>")).alias("r")).select("r.*").filter("file is not null")
    out = found(r, "import", "other", ident=F.col("slug"), title=F.col("title"), severity=X.normalize_severity(F.col("severity")), confidence=F.lower("confidence"), message=F.coalesce("reasoning", "title"), file=F.col("file"), line=F.col("line"))
    slugs = r.select(X.finding_id(F.lit("import"), F.col("slug"), F.col("file"), F.coalesce("line", F.lit(1))).alias("s_id"), category(F.col("slug")).alias("s_category")).distinct()
    return out.join(slugs, F.col("id") == F.col("s_id"), "left").withColumn("category", F.coalesce("s_category", "category")).drop("s_id", "s_category")


# Words of a slug and the category that they stand for, in order.
SLUG_CATEGORIES = (
    ("sast", r"ssrf"),
    ("authz", r"auth|idor|access[-_]?control|privilege|authz"),
    ("crypto", r"crypto|hash|cipher|weak[-_]?(?:rng|random)|tls|ssl"),
    ("secret", r"secret|hardcoded|credential|api[-_]?key|token|password"),
    ("config", r"dockerfile|terraform|gh[-_]?actions|github[-_]?actions|iac|misconfig|config"),
    ("dep", r"dependency|outdated|vuln[-_]?dep|cve|\bsca\b"),
)


def slug_category(slug: Column) -> Column:
    """Category of an export's slug; never taint, which is for paths that the scan itself has found."""
    out = F.lit("sast")
    for category, words in reversed(SLUG_CATEGORIES):
        out = F.when(F.lower(slug).rlike(words), category).otherwise(out)
    return out


def agent_export(df: DataFrame) -> DataFrame:  # S18
    """:func:`upstream_export` with the categories that slugs stand for; only the scan's own paths are taint."""
    return upstream_export(df, slug_category)


def findings_of(tool: str, df: DataFrame) -> DataFrame:  # S17
    return ADAPTERS[tool](df)
