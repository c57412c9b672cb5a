"""Work over many small files: dealt to tasks, in batches, and each step once."""

from wardenflow.operators import code_detect as C
from wardenflow.operators import dataflow as D
from wardenflow.operators import log_analysis as L
from wardenflow.operators import workflows as K
from wardenflow.plans.code_queries import LOGGED, written
from wardenflow.plans.logs import analyze_logs
from wardenflow.sources import reports as R

LINES = "file string, line int, text string"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_files_of_one_partition_of_keys_are_dealt_to_tasks(spark):
    files = written(spark.range(0, 10_000, 1, 1), "id", LOGGED, 3)
    assert files.rdd.getNumPartitions() == 3 and files.select("file").distinct().count() == 10_000


def test_workflows_and_questions_come_in_batches(spark):
    lines = [(f".github/workflows/{f}.yml", n + 1, t) for f in "ab" for n, t in enumerate(("jobs:", "  - run: x", "", "    y: 1", "  - z"))]
    told = K.shape(spark.createDataFrame(lines[::-1], LINES))
    assert "FlatMapGroups" not in plan(told)
    assert sorted((r.file[-5], r.line, r.last, r.step) for r in told.collect()) == [(f, *x) for f in "ab" for x in ((1, 5, 0), (2, 4, 2), (3, 3, 2), (4, 4, 2), (5, 5, 5))]
    files = spark.createDataFrame([(f, "javascript", "const a = q.b;\nrun(a);") for f in ("a.js", "b.js")], "file string, lang string, content string")
    asked = spark.createDataFrame([("a.js", 1, "q.b", 2, None, None), ("gone.js", 1, "q.b", 2, None, None)], D.QUESTION)
    out = D.answers(files, asked)
    assert "CoGroup" not in plan(out)
    assert [(r.file, r.source_line, r.dataflow, r.tainted) for r in out.collect()] == [("a.js", 1, "linked", ["a"])]


def test_egress_blocks_are_looked_up_without_a_window_over_all_lines(spark):
    text = {1: "ingress {", 2: 'cidr_blocks = ["0.0.0.0/0"]', 3: "egress {", 4: 'cidr_blocks = ["0.0.0.0/0"]', 28: 'cidr_blocks = ["0.0.0.0/0"]', 29: 'cidr_blocks = ["0.0.0.0/0"]'}
    found = C.audit_cloud(spark.createDataFrame([("n.tf", n, text.get(n, "x = 1")) for n in range(1, 31)], LINES))
    assert "Window" not in plan(found)
    assert sorted((r.line, r.kind) for r in found.collect()) == [(2, "open-ingress"), (29, "open-ingress")]


def test_audits_broadcast_no_side_of_unknown_size(spark):
    text = {"a.js": ("res.setHeader('Access-Control-Allow-Origin', '*'); credentials: true", "res.cookie('a', f(b), {", "sameSite: 'lax' });", *["x"] * 18, "res.cookie('b', c,", *["y"] * 19, "{ sameSite: 1 });", "res.cookie('d', e,", *["z"] * 20, "{ sameSite: 1 });"), "k.yaml": ("apiVersion: v1", "kind: Pod", "privileged: true"), "n.tf": ("egress {", 'cidr_blocks = ["0.0.0.0/0"]')}
    lines = spark.createDataFrame([(f, n + 1, t) for f, all_ in text.items() for n, t in enumerate(all_)], LINES)
    web, cloud = C.audit_web(lines), C.audit_cloud(lines)
    assert sorted((r.file, r.line, r.kind) for r in web.collect()) == [("a.js", 1, "cors-wildcard-credentials"), ("a.js", 43, "cookie-samesite")]
    assert [(r.file, r.line, r.kind) for r in cloud.collect()] == [("k.yaml", 3, "k8s-privileged")]
    for found in (web, cloud):
        assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_statistics_do_not_wait_for_findings(spark, monkeypatch):
    calls, own = [], L.behaviour
    monkeypatch.setattr(L, "behaviour", lambda *a: calls.append(1) or own(*a))
    report = analyze_logs(spark.createDataFrame([("a.log", 1, '1.1.1.1 - - [01/Jan/2024:00:00:00 +0000] "GET /a HTTP/1.1" 200 1 "-" "x"')], LINES))
    assert report.statistics["total"].first().lines == 1 and not calls
    assert report.findings.count() == 0 and calls == [1]


def test_status_of_reports_is_told_once(spark):
    found, told = R.report_findings(R.with_tool(spark.createDataFrame([("r/bandit/a.json", '{"results":[]}'), ("r/trivy/b.json", "{")], "report string, content string")))
    assert "parse_json" not in plan(found) and found.count() == 0
    assert sorted((r.tool, r.status) for r in told.collect()) == [("bandit", "read"), ("trivy", "broken")]


def test_log_calls_are_found_once(spark, monkeypatch):
    made = []
    monkeypatch.setattr(C, "cut", lambda df, label="cut": made.append(label) or df)
    C.sensitive_logs(spark.createDataFrame([], "file string, lang string, symbols array<struct<name: string, kind: string, line: int, end: int, exported: boolean>>, imports array<string>, calls array<struct<callee: string, receiver: string, line: int>>"), spark.createDataFrame([], LINES))
    assert made == ["sensitive"]
