import pytest

from wardenflow.operators import log_analysis as L
from wardenflow.plans.logs import analyze_logs
from wardenflow.sources import logs as S


def access(ip, second, path="/", status=200, ua="Mozilla/5.0", minute=0):
    return f'{ip} - - [10/Oct/2024:13:{minute + second // 60:02d}:{second % 60:02d} +0000] "GET {path} HTTP/1.1" {status} 12 "-" "{ua}"'


def run(spark, texts, **options):
    return analyze_logs(S.from_texts(spark, texts), **options)


def kinds(report):
    return sorted((r.kind, r.file, r.line) for r in report.findings.collect())


def test_formats_and_parsers(spark):
    texts = {
        "a.log": "\n".join(access("10.0.0.1", i) for i in range(3)),
        "b.jsonl": '{"time":"2024-01-01T00:00:00Z","ip":"1.2.3.4","path":"/x","status":"404","msg":"hi","ua":5}\n{"status_code":200}',
        "c.log": "Jan  2 03:04:05 host sshd[12]: Failed password for root from 9.8.7.6 port 22\n<34>1 2024-01-01T00:00:00Z rest from 1.1.1.1 x",
        "d.log": "2024-01-01T00:00:00Z started\nplain\n[2024-01-02 x] two\n",
        "e.log": "one\ntwo\n2024-01-01T00:00:00Z three",
        "f.log": "\n\n",
    }
    lines = S.from_texts(spark, texts)
    formats = {r.file: r.format for r in S.detect_formats(lines).collect()}
    assert formats == {"a.log": "nginx-combined", "b.jsonl": "json-lines", "c.log": "syslog", "d.log": "generic", "e.log": "raw", "f.log": "raw"}
    rows = {(r.file, r.line): r for r in S.parse(lines, S.detect_formats(lines)).collect()}
    a = rows["a.log", 1]
    assert (a.ip, a.method, a.path, a.status, a.ua) == ("10.0.0.1", "GET", "/", 200, "Mozilla/5.0")
    b = rows["b.jsonl", 1]
    assert (b.ts, b.ip, b.path, b.status, b.message, b.ua) == ("2024-01-01T00:00:00Z", "1.2.3.4", "/x", 404, "hi", None)
    assert rows["b.jsonl", 2].status == 200
    c = rows["c.log", 1]
    assert (c.ts, c.ip, c.message) == ("Jan  2 03:04:05", "9.8.7.6", "host sshd[12]: Failed password for root from 9.8.7.6 port 22")
    assert rows["c.log", 2].ip == "1.1.1.1" and rows["d.log", 3].ts == "2024-01-02 x"


def test_lines_of_split_files(spark, tmp_path):
    (tmp_path / "x.log").write_text("".join(f"line {i}\n" for i in range(1, 20_001)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        rows = S.read_lines(spark, [str(tmp_path / "x.log")], base=str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(rows) == 20_000 and all(r.text == f"line {r.line}" and r.file == "x.log" for r in rows)


@pytest.mark.parametrize(("n", "fires"), [(300, False), (301, True)])
def test_burst_is_more_than_300(spark, n, fires):
    report = run(spark, {"a.log": "\n".join(access("10.0.0.1", i % 50) for i in range(n))})
    assert any(k == "request-burst" for k, *_ in kinds(report)) == fires


@pytest.mark.parametrize(("window", "fires"), [(60, False), (120, True)])
def test_brute_force_window(spark, window, fires):
    line = lambda i: f"2024-01-01T00:{i * 5 // 60:02d}:{i * 5 % 60:02d}Z Failed password from 1.2.3.4"
    text = "\n".join('{"time":"%s","ip":"1.2.3.4","msg":"Failed password"}' % line(i).split()[0] for i in range(20))
    report = run(spark, {"a.jsonl": text}, window_s=window)
    assert any(k == "brute-force" for k, *_ in kinds(report)) == fires


def test_line_proxy_and_compromise(spark):
    fail = "Jan  2 03:04:05 host sshd[1]: Failed password for root from 9.8.7.6 port 22"
    text = "\n".join([fail] * 20 + ["Jan  2 03:05:05 host sshd[1]: Accepted password for root from 9.8.7.6 port 22"])
    found = kinds(run(spark, {"auth.log": text}))
    assert ("brute-force", "auth.log", 1) in found and ("credential-compromise", "auth.log", 1) in found


def test_scan_then_hit(spark):
    text = "\n".join([access("10.0.0.9", i, "/a", 404) for i in range(15)] + [access("10.0.0.9", 20, "/.env", 200)])
    found = kinds(run(spark, {"a.log": text}))
    assert ("scan-behavior", "a.log", 1) in found and ("recon-hit", "a.log", 16) in found


def test_family_cap_and_overflow(spark):
    report = run(spark, {"a.log": "\n".join(access("10.0.0.1", i % 60, f"/x?q=1%20union%20select%20{i}", minute=i % 50) for i in range(80))})
    assert sum(k == "sqli" for k, *_ in kinds(report)) == 50
    assert [(r.kept, r.left_out) for r in report.family_overflow.filter("family = 'sqli'").collect()] == [(50, 30)]


def test_benign_twins_and_escalation(spark):
    paths = ["/list?q=selection", "/wp-login-guide", "/actuator-tips"]
    assert kinds(run(spark, {"a.log": "\n".join(access("1.1.1.1", i, p) for i, p in enumerate(paths))})) == []
    report = run(spark, {"a.log": access("1.1.1.1", 0, "/.env", 200) + "\n" + access("1.1.1.1", 1, "/.env", 404)})
    assert {r.line: r.severity for r in report.findings.collect()} == {1: "medium", 2: "low"}


@pytest.mark.parametrize(("n", "fires"), [(4, False), (6, True)])
def test_email_gate(spark, n, fires):
    report = run(spark, {"a.log": "\n".join(f"2024-01-01T00:00:00Z mail to user{i}@example.com" for i in range(n))})
    assert (len(kinds(report)) > 0) == fires
    if fires:
        assert {line for _, _, line in kinds(report)} == {5, 6}


def test_redaction_and_scanner(spark):
    key = "AKIA" + "ABCDEFGH12345678"
    report = run(spark, {"a.log": f"2024-01-01T00:00:00Z key {key}\n" + access("1.1.1.1", 0, ua="sqlmap/1.0")})
    rows = report.findings.collect()
    assert any(r.kind == "log-secret-aws-access-key" and r.severity == "high" for r in rows)
    assert not any(key in r.message for r in rows)
    assert any(r.kind == "scanner-ua" for r in run(spark, {"b.log": access("1.1.1.1", 0, ua="sqlmap/1.0")}).findings.collect())


def test_statistics(spark):
    report = run(spark, {"a.log": "\n".join(access(f"10.0.0.{i % 3}", i, "/p") for i in range(9))})
    assert report.statistics["total"].first()["addresses"] == 3
    assert report.statistics["top_ip"].first()["n"] == 3
    assert L.FAMILY_CAP == 50


def test_a_run_has_all_lines(spark, monkeypatch):
    from wardenflow.plans.catalogue import QUERIES

    monkeypatch.setattr(S, "BUDGETS", dict.fromkeys(S.BUDGETS, 3))
    report = run(spark, {"a.log": "\n".join(access("10.0.0.1", i, "/.env" if i == 8 else "/p") for i in range(9))})
    assert report.statistics["total"].first()["lines"] == 9 and ("probe-path", "a.log", 9) in kinds(report)
    sf = "/root/testdata/sf0.001"
    told = {r.statistic: r.row for r in QUERIES["log_run_statistics"](spark, sf).collect()}
    assert f'"lines":{spark.read.parquet(f"{sf}/events.parquet").count()},' in told["total"]
