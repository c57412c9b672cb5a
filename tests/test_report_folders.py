from wardenflow.sources import reports as R


def test_a_folder_of_reports(spark, tmp_path):
    texts = {"bandit/one.json": '{"results":[{"test_id":"B1","issue_severity":"LOW","filename":"a.py","line_number":3}]}', "gitleaks.json": "[{]", "trivy/x.json": " \n", "what.txt": "?", "semgrep.a.json": '{"results":[]}'}
    for name, text in texts.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    found, status = R.report_findings(R.read_reports(spark, str(tmp_path)))
    assert {(r.tool, r.status) for r in status.collect()} == {("bandit", "read"), ("gitleaks", "broken"), ("trivy", "empty"), ("what", "unknown"), ("semgrep", "read")}
    assert [(r.tool, r.file, r.line) for r in found.collect()] == [("bandit", "a.py", 3)]


def test_no_report_is_read(spark):
    rows = spark.createDataFrame([("x/own.json", "{}"), ("trivy.json", None)], "report string, content string")
    found, status = R.report_findings(R.with_tool(rows))
    assert found.count() == 0 and sorted(r.status for r in status.collect()) == ["empty", "unknown"]
