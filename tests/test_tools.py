import json

from wardenflow.sources import feeds
from wardenflow.sources import tools as T


def run(spark, tool, report):
    text = report if isinstance(report, str) else json.dumps(report)
    return sorted((r.category, r.title, r.severity, r.file, r.line, r.cwe, r.cve, r.pkg, r.version) for r in T.findings_of(tool, T.contents(spark, text)).collect())


def one(spark, tool, report):
    rows = T.findings_of(tool, T.contents(spark, report if isinstance(report, str) else json.dumps(report))).collect()
    assert len(rows) == 1, rows
    return rows[0]


def test_trivy(spark):
    got = run(spark, "trivy", {"Results": [{"Target": "a.lock", "Vulnerabilities": [{"VulnerabilityID": "CVE-2024-0001", "PkgName": "p", "InstalledVersion": "1", "Severity": "HIGH", "Title": "t", "CweIDs": ["CWE-79"]}], "Secrets": [{"RuleID": "aws", "Title": "key", "Severity": "CRITICAL", "StartLine": 3}]}, {"Target": "D", "Misconfigurations": [{"ID": "DS1", "Title": "root", "Severity": "LOW"}]}]})
    assert got == [("config", "root", "low", "D", 1, None, None, None, None), ("dep", "t", "high", "a.lock", 1, "CWE-79", "CVE-2024-0001", "p", "1"), ("secret", "key", "critical", "a.lock", 3, None, None, None, None)]


def test_dependency_tools(spark):
    r = one(spark, "osv-scanner", {"results": [{"source": {"path": "l"}, "packages": [{"package": {"name": "p", "version": "1"}, "vulnerabilities": [{"id": "GHSA-1", "aliases": ["CVE-2024-1111"], "summary": "s"}], "groups": [{"ids": ["GHSA-1"], "max_severity": "9.8"}]}]}]})
    assert (r.severity, r.cve, r.file) == ("critical", "CVE-2024-1111", "l")
    r = one(spark, "grype", {"matches": [{"vulnerability": {"id": "GHSA-2", "severity": "Unknown", "cvss": [{"metrics": {"baseScore": 7.2}}]}, "relatedVulnerabilities": [{"id": "CVE-2024-2222"}], "artifact": {"name": "q", "version": "2", "locations": [{"path": "x"}]}}]})
    assert (r.severity, r.cve, r.file) == ("high", "CVE-2024-2222", "x")
    adv = {"module_name": "m", "severity": "moderate", "title": "t", "cves": ["CVE-2024-3333"], "cwe": "CWE-20", "url": "https://x/GHSA-aaaa-bbbb-cccc", "findings": [{"version": "3"}]}
    for tool, report in (("npm-audit", {"advisories": {"1": adv}}), ("pnpm-audit", {"advisories": {"1": adv}}), ("yarn-audit", json.dumps({"type": "auditAdvisory", "data": {"advisory": adv}}) + "\n" + json.dumps({"type": "auditSummary"}))):
        r = one(spark, tool, report)
        assert (r.severity, r.cve, r.pkg, r.version, r.cwe) == ("medium", "CVE-2024-3333", "m", "3", "CWE-20")
    r = one(spark, "npm-audit", {"vulnerabilities": {"a": {"name": "a", "severity": "high", "via": ["b", {"source": 1, "name": "a", "title": "t", "url": "u/GHSA-aaaa-bbbb-dddd", "severity": "high", "cwe": ["CWE-1"]}]}}})
    assert (r.title, r.pkg, r.cwe) == ("t", "a", "CWE-1")
    r = one(spark, "yarn-audit", json.dumps({"value": "lodash", "children": {"ID": 7, "Issue": "i", "Severity": "high", "URL": "u", "Vulnerable Versions": "<1"}}))
    assert (r.pkg, r.version, r.severity) == ("lodash", "<1", "high")
    assert one(spark, "pip-audit", {"dependencies": [{"name": "p", "version": "1", "vulns": [{"id": "PYSEC-1", "aliases": ["CVE-2024-4444"]}]}, {"name": "q", "version": "1", "vulns": []}]}).severity == "medium"
    r = T.findings_of("cargo-audit", T.contents(spark, json.dumps({"vulnerabilities": {"list": [{"advisory": {"id": "RUSTSEC-1", "title": "t", "cvss": "CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H"}, "package": {"name": "c", "version": "1"}}]}, "warnings": {"unmaintained": [{"kind": "unmaintained", "advisory": {"id": "RUSTSEC-2", "title": "u"}, "package": {"name": "d", "version": "1"}}]}}))).collect()
    assert {(x.title, x.severity) for x in r} == {("t", "critical"), ("u", "low")}
    stream = '{"config":{}}\n{"osv":{"id":"GO-1","aliases":["CVE-2024-5555"],"summary":"s"}}{"finding":{"osv":"GO-1","trace":[{"module":"m","version":"v1","function":"F"},{"module":"app","position":{"filename":"a.go","line":4}}]}}\n{"finding":{"osv":"GO-1","trace":[{"module":"m","version":"v1","function":"F"},{"module":"app","position":{"filename":"a.go","line":4}}]}}'
    r = one(spark, "govulncheck", stream)
    assert (r.severity, r.confidence, r.file, r.line, r.cve) == ("high", "high", "a.go", 4, "CVE-2024-5555")
    r = one(spark, "package-checker", "@scope/p@1.2.3\nnothing\n")
    assert (r.pkg, r.version) == ("@scope/p", "1.2.3")
    assert one(spark, "guarddog", {"package": "p", "results": {"exec": "found", "ok": {}}}).cwe == "CWE-506"


def test_code_tools(spark):
    r = T.findings_of("semgrep", T.contents(spark, json.dumps({"results": [{"check_id": "c", "path": "a", "start": {"line": 2}, "extra": {"severity": "ERROR", "message": "m", "metadata": {"cwe": ["CWE-89: x"]}}}, {"check_id": "d", "path": "a", "start": {"line": 2}, "extra": {"severity": "INFO", "message": "m", "sca_info": {"x": 1}}}]}))).collect()
    assert [(x.severity, x.cwe, x.line) for x in r] == [("high", "CWE-89", 2)]
    assert one(spark, "bandit", {"results": [{"test_id": "B1", "test_name": "n", "issue_severity": "LOW", "issue_text": "t", "filename": "f", "line_number": 9, "issue_cwe": {"id": 78}}]}).cwe == "CWE-78"
    assert one(spark, "gosec", {"Issues": [{"severity": "HIGH", "confidence": "LOW", "cwe": {"id": "22"}, "rule_id": "G1", "details": "d", "file": "f", "line": "10-12"}]}).line == 10
    assert one(spark, "cppcheck", "a.c\t3\terror\tnullPointer\tm\n").cwe == "CWE-476"
    check = {"results": {"failed_checks": [{"check_id": "CKV", "check_name": "n", "file_path": "/m.tf", "file_line_range": [5, 9]}]}}
    assert one(spark, "checkov", check).file == "m.tf" and one(spark, "checkov", [check]).line == 5
    assert one(spark, "hadolint", [{"file": "D", "line": 1, "level": "warning", "code": "DL1", "message": "m"}]).severity == "medium"
    assert one(spark, "gitleaks", [{"RuleID": "r", "Description": "d", "File": "f", "StartLine": 2, "Commit": "c"}]).category == "secret"
    r = one(spark, "trufflehog", json.dumps({"DetectorName": "AWS", "Verified": True, "SourceMetadata": {"Data": {"Filesystem": {"file": "f", "line": 4}}}}))
    assert (r.severity, r.line, r.verified) == ("critical", 5, True)
    sarif = {"runs": [{"tool": {"driver": {"rules": [{"id": "x"}, {"id": "r", "shortDescription": {"text": "S"}, "properties": {"security-severity": "8.1", "tags": ["external/cwe/cwe-79"]}}]}}, "results": [{"ruleId": "r", "level": "note", "message": {"text": "m"}, "locations": [{"physicalLocation": {"artifactLocation": {"uri": "f"}, "region": {"startLine": 3}}}]}, {"ruleIndex": 0, "level": "warning", "message": {"text": "m"}}]}]}
    r = T.findings_of("kingfisher", T.contents(spark, json.dumps(sarif))).collect()
    assert {(x.title, x.severity, x.cwe, x.line) for x in r} == {("S", "high", "CWE-79", 3), ("x", "medium", None, None)}
    r = T.upstream_export(T.contents(spark, json.dumps([{"slug": "Path Traversal", "title": "t", "severity": "high", "file": "f", "line": 1}, {"slug": "x", "title": "t"}]))).collect()
    assert [(x.category, x.file) for x in r] == [("taint", "f")]


def test_malformed_reports_have_no_rows(spark):
    for tool in T.ADAPTERS:
        assert T.findings_of(tool, T.contents(spark, "not json", "{}")).count() == 0, tool


def test_feeds(spark, tmp_path):
    (tmp_path / "e.csv").write_text("#model\ncve,epss,percentile\ncve-2024-1,0.5,0.9\n")
    (tmp_path / "k.json").write_text('{"vulnerabilities":[{"cveID":"cve-2024-1","dateAdded":"2024-01-01"}]}')
    (tmp_path / "bad.json").write_text("nope")
    assert [tuple(r) for r in feeds.epss_csv(spark, str(tmp_path / "e.csv")).collect()] == [("CVE-2024-1", 0.5, 0.9)]
    assert [r.cve for r in feeds.kev_json(spark, str(tmp_path / "k.json")).collect()] == ["CVE-2024-1"]
    assert feeds.kev_json(spark, str(tmp_path / "bad.json")).count() == 0
    lock = {"packages": {"": {}, "node_modules/a": {"dev": True}, "node_modules/b/node_modules/c": {}, "node_modules/d": {"dev": True, "devOptional": True}}}
    assert {tuple(r) for r in feeds.npm_lock(T.contents(spark, json.dumps(lock))).collect()} == {("a", True), ("c", False), ("d", False)}
