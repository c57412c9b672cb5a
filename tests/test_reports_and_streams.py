import subprocess

import pytest
from pyspark.sql import functions as F

from tests.test_operators import make
from wardenflow.functions.standards import STANDARDS
from wardenflow.operators import posture as O
from wardenflow.plans import reports as R
from wardenflow.sources import git
from wardenflow.streaming.log_stream import alerts


def test_stream_alerts(spark, tmp_path):
    rows = [("a", i * 1000, i, True, False, False, False) for i in range(25)] + [("a", 30_000, 30, False, True, False, False), ("b", 0, 31, True, False, False, False), (None, 0, 32, True, False, False, False)]
    rows += [("c", i * 1000, 40 + i, False, False, True, False) for i in range(15)] + [("c", 20_000, 60, False, False, False, True)]
    schema = "ip string, ms long, idx long, failed boolean, success boolean, error boolean, hit boolean"
    for n, part in enumerate((rows[:10], rows[10:])):  # state goes from one micro-batch to the next
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        run = alerts(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        run.awaitTermination()
        assert n in (0, 1)
    got = {(r.ip, r.kind, r.ms, r.oldest) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {("a", "brute-force", 19_000, 0), ("a", "credential-compromise", 30_000, 30_000), ("c", "scan-behavior", 14_000, 0), ("c", "recon-hit", 20_000, 20_000)}


def test_coverage(spark):
    rows = make(spark, [{"tool": "t", "category": "sast", "title": "x", "severity": "low", "cwe": "cwe-89"}, {"tool": "t", "category": "dep", "title": "y", "severity": "low"}])
    got = {r.code: (r.hits, r.state) for r in R.coverage_table(rows, "owasp-top10", ["ssrf"]).collect()}
    assert got["A03"] == (1, "examined") and got["A06"] == (1, "examined") and got["A10"] == (0, "engine") and got["A04"] == (0, "unexamined")
    empty = R.coverage_table(rows.limit(0), "cwe-top25", []).collect()
    assert len(empty) == 25 and {r.state for r in empty} == {"unexamined"}
    assert {k: len(v) for k, v in STANDARDS.items()} == {"asvs": 13, "owasp-top10": 10, "owasp-api-top10": 10, "masvs": 8, "cwe-top25": 25}
    assert "| A03 | Injection | 1 | examined |" in R.coverage_report(rows, "owasp-top10", [])


def test_reports(spark):
    rows = make(spark, [{"tool": "t", "category": "sast", "title": "<x>", "severity": "high", "file": f"a/b/{i}.js", "line": 5, "message": "m"} for i in range(4)])
    assert "×4" in R.report(rows) and "4 high" in R.summary(rows) and "&lt;x&gt;" in R.html_report(rows)
    assert R.worklist(rows).count('"id"') == 4
    pack = R.detection_pack()
    assert pack.count("title:") == 11 and pack == R.detection_pack()
    lines = spark.createDataFrame([("a/b/0.js", n, str(n)) for n in range(1, 20)], "file string, line int, text string")
    one = rows.filter("file = 'a/b/0.js'").first().id
    assert [r.near_line for r in R.evidence(rows, lines, one[:8]).collect()] == [2, 3, 4, 5, 6, 7, 8]
    assert "n0 --> n1" in R.path_diagram([("a", 1), ("b", 2)])


def test_posture_and_targets(spark):
    seen = spark.createDataFrame([("https://x.org/", "https", 200, {"server": "nginx/1.2", "x-content-type-options": "nosniff"}, ["a=1; Secure"], "TLSv1.3", None, ""), ("http://10.0.0.1/", "http", 200, {}, [], None, None, "")], O.OBSERVATION)
    got = {(r.url, r.check) for r in O.posture(seen).collect()}
    assert ("https://x.org/", "missing-csp") in got and ("https://x.org/", "cookie-not-httponly") in got and ("https://x.org/", "server-banner") in got
    assert ("https://x.org/", "cookie-not-secure") not in got and not any("10.0.0.1" in u for u, _ in got)
    targets = {"https://github.com/a/b": "repository", "https://x.org": "web", "a.log": "logs", "x.sarif": "sarif", "yarn.lock": "lockfile", "m.tf": "infrastructure", "a.py": "source", "src": "folder"}
    df = spark.createDataFrame([*targets], "string").select(F.col("value"), O.target_kind(F.col("value")).alias("k"))
    assert {r.value: r.k for r in df.collect()} == targets


@pytest.fixture
def repo(tmp_path):
    def do(*args):
        subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=n", "-c", "user.email=e@x", *args], check=True, capture_output=True)

    do("init", "-q")
    (tmp_path / "a.py").write_text("one\ntwo\n")
    do("add", "."), do("commit", "-qm", "first")
    do("mv", "a.py", "b.py"), do("commit", "-qm", "second")
    (tmp_path / "new.py").write_text("x")
    return tmp_path


def test_git(spark, repo):
    assert git.changed_files(str(repo), "HEAD~1") == ["b.py", "new.py"] and git.changed_files(str(repo), "nope") is None
    row = git.blame(spark, str(repo), [("b.py", 2)]).first()
    assert row.author == "n" and len(row.date) == 10
    head = git.run(str(repo), "rev-parse", "HEAD").strip()
    assert [r.text for r in git.blob_lines(spark, str(repo), [(head, "b.py"), ("zz", "b.py")]).collect()] == ["one", "two", ""]
    assert git.renamed_to(str(repo), "a.py", "HEAD~1") == "b.py" and git.renamed_to(str(repo), "b.py", "HEAD~1") is None
    assert git.last_change(str(repo), "b.py", 1) is not None
    edges = spark.createDataFrame([("app.py", "b.py"), ("main.py", "app.py"), ("x.py", "main.py")], "from string, to string")
    assert {r.node: r.depth for r in git.diff_scope(spark, edges, ["b.py"]).collect()} == {"b.py": 0, "app.py": 1, "main.py": 2}
