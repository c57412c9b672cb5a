from pyspark.sql import functions as F

from wardenflow.operators import findings as N
from wardenflow.plans import run_outputs as O
from wardenflow.plans.logs import analyze_logs
from wardenflow.sources import logs as S


def make(spark, rows):
    keys = sorted({k for r in rows for k in r})
    kinds = {"line": "int", "risk": "int", "epss": "double", "kev": "boolean", "sources": "array<string>", "owners": "array<string>", "verified": "boolean"}
    return N.conform(spark.createDataFrame([tuple(r.get(k) for k in keys) for r in rows], ", ".join(f"{k} {kinds.get(k, 'string')}" for k in keys)))


def test_index(spark):
    rows = [{"id": f"i{n}", "title": "t", "tool": "engine", "category": "taint", "severity": "high", "message": "m", "file": f"src/a{n}.js", "line": n, "status": "open"} for n in range(3)]
    rows.append({"id": "z", "title": "dep", "tool": "trivy", "category": "dep", "severity": "low", "message": "x", "status": "confirmed", "risk": 90, "epss": 0.5, "kev": True, "sources": ["osv", "trivy"], "cwe": "CWE-1", "owners": ["@a"]})
    text = "\n".join(r.text for r in O.index_lines(make(spark, rows), "/r", ["go"], ["trivy"], (4, 9), True, ["src"]).collect())
    assert "- findings: **4**" in text and "Coverage capped: **4** of **9**" in text and "Partial walk" in text and "`src`" in text
    assert "- t in src: 3 alike, first i0" in text
    assert text.index("### z — low dep") < text.index("### i0 — high t") < text.index("### i1")
    assert "- category: dep · CWE-1 · confidence medium · status confirmed · agreed by osv, trivy\n- risk 90 · EPSS 50.0% · known to be exploited\n- owner @a\n- x" in text
    assert "- at: `src/a2.js:2`" in text and "via" not in text
    nothing = "\n".join(r.text for r in O.index_lines(make(spark, rows).limit(0), "/r").collect())
    assert "_No candidate findings._" in nothing and "Candidates\n" not in nothing and "none (graph + taint only)" in nothing


def test_packets(spark):
    paths = spark.createDataFrame([("abc", [("db.js", 3), ("r.js", 9)], "r.js", 2)], "id string, hops array<struct<file: string, line: int>>, source_file string, source_line int")
    lines = spark.createDataFrame([(f, n, f"{f} {n}") for f in ("db.js", "r.js") for n in range(1, 12)], "file string, line int, text string")
    edges = spark.createDataFrame([("r.js", "db.js"), ("x.js", "r.js")], "from string, to string")
    rows = O.packets(paths, lines, edges, 1)
    assert sorted((r.step, r.role, r.line, r.cited) for r in rows.collect()) == [(0, "source", 1, False), (0, "source", 2, True), (0, "source", 3, False), (1, "hop", 8, False), (1, "hop", 9, True), (1, "hop", 10, False), (2, "sink", 2, False), (2, "sink", 3, True), (2, "sink", 4, False)]
    assert O.packet(rows, "ab").startswith("## source r.js (beside db.js, x.js)\n      1 | r.js 1\n>     2 | r.js 2\n")
    assert O.packet(rows, "zz") == "\n"


def test_log_run(spark, tmp_path):
    texts = {"a.log": "".join(f'10.0.0.{n % 3} - - [01/Jan/2024:00:00:{n:02d} +0000] "GET /?q=<script>alert({n})</script> HTTP/1.1" 200 1\n' for n in range(30))}
    report = analyze_logs(S.lines_of(spark, texts) if hasattr(S, "lines_of") else S.from_texts(spark, texts))
    ids = [r.id for r in O.log_findings(report).collect()]
    assert ids and ids == sorted(ids)
    O.write_log_run(report, str(tmp_path / "run"))
    names = {r.statistic for r in spark.read.text(str(tmp_path / "run/statistics")).select("statistic").distinct().collect()}
    assert {"formats", "family_overflow"} <= names
    assert spark.read.json(str(tmp_path / "run/findings")).count() == len(ids)


def test_folded_categories(spark):
    rows = spark.createDataFrame([("SAST",), (" sast ",), ("sast",), ("Credentials",), ("credentials",), ("credentials",), ("no such thing at all",)], "category string")
    got = {r.raw: (r.category, r.n) for r in O.folded_categories(rows).collect()}
    assert "sast" not in got and "SAST" not in got and got["credentials"] == ("secret", 2) and got["Credentials"] == ("secret", 1)


def test_manifests(spark):
    before = spark.createDataFrame([(["go"], ["trivy", "osv"], [("osv", "ran"), ("trivy", "failed")], None, 5, 20, True)], O.MANIFEST)
    scoped = spark.createDataFrame([(["js"], ["trivy"], [("trivy", "ran")], ["src/b", "src/a"], 2, 30, None)], O.MANIFEST)
    one = O.merge_manifests(before, scoped).first()
    assert one.languages == ["go", "js"] and one.scopes == ["src/a", "src/b"] and (one.omitted, one.total, one.partial_walk) == (5, 30, True)
    assert [(s.name, s.status) for s in one.tool_status] == [("osv", "ran"), ("trivy", "ran")]
    whole = O.merge_manifests(O.merge_manifests(before, scoped), scoped.withColumn("scopes", F.lit(None).cast("array<string>")).withColumns({"omitted": F.lit(None).cast("long"), "total": F.lit(None).cast("long")})).first()
    assert (whole.omitted, whole.total, whole.partial_walk) == (None, None, False)


def test_cover_of_scopes(spark):
    scopes = spark.createDataFrame([("src",), ("src/a",), ("src/a/b/",), ("srcs",), ("lib/x",), ("lib/x/y/z",), ("lib",), ("lib/x",)], "scope string")
    assert sorted(r.scope for r in O.cover(scopes).collect()) == ["lib", "src", "srcs"]


def test_rules_of_hunts_once(spark):
    from wardenflow.operators import fold as D

    rows = [(1, "a", None, "rule one"), (2, "b", None, " rule one "), (3, "c", None, ""), (4, "d", None, "rule two"), (5, "e", None, None)]
    assert [tuple(r) for r in D.regression_pack(spark.createDataFrame(rows, D.HUNT)).collect()] == [("a", "rule one"), ("d", "rule two")]
