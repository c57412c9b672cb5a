from tests.test_operators import make
from wardenflow.plans import worklists as K


def test_regions_units_and_guards(spark):
    surface = spark.createDataFrame([("a", f"a/{i}.js", i) for i in range(10)] + [("b", "b/x.js", 1)], "region string, file string, score int")
    edges = spark.createDataFrame([("a/1.js", "b/x.js"), ("a/1.js", "a/2.js")], "from string, to string")
    leads = spark.createDataFrame([("b/x.js:3", "looks odd"), ("c/", "nothing")], "at string, claim string")
    got = {r.region: r for r in K.region_worklist(surface, edges, leads).collect()}
    assert got["a"].files == [f"a/{i}.js" for i in range(9, 1, -1)] and got["a"].neighbours == ["b/x.js"] and got["b"].leads == ["looks odd"]
    symbols = spark.createDataFrame([("f", "one", 1, 10), ("f", "two", 11, 20), ("f", "open", 21, None)], "file string, name string, line int, end int")
    hits = spark.createDataFrame([("f", 2, "entry"), ("f", 3, "sink"), ("f", 12, "sink"), ("f", 30, "sink")], "file string, line int, role string")
    assert [(r.name, r.inputs, r.sinks) for r in K.assumption_units(symbols, hits).collect()] == [("one", 1, 1), ("two", 0, 1)]
    matrix = spark.createDataFrame([("f", 1, "h", False), ("f", 2, "g", True)], "file string, line int, handler string, guarded boolean")
    assert [(r.line, r.cwe, r.severity) for r in K.guard_findings(matrix).collect()] == [(1, "CWE-306", "high")]


def test_narratives_and_remediation(spark):
    rows = make(spark, [{"tool": "t", "category": "sast", "title": str(i), "severity": s, "cwe": "CWE-1", "file": f"f{i}", "line": 1, "status": "confirmed"} for i, s in enumerate(["low", "high"])])
    ids = [r.id for r in rows.collect()]
    entries = spark.createDataFrame([("all", ids), ("one gone", [ids[0], "x"]), ("none", [])], "entry string, ids array<string>")
    assert [r.entry for r in K.narrative(entries, rows).collect()] == ["all"]
    assert [(r.severity, r.members, r.files) for r in K.remediation(rows).collect()] == [("high", 2, ["f0", "f1"])]


def test_files_that_begin_alike_meet_a_lead_once(spark):
    surface = spark.range(300).selectExpr("'a' as region", "concat('a/f', id) as file", "1 as score")
    leads = spark.range(50).selectExpr("concat('a/f:', id) as at", "concat('c', id) as claim")
    out = K.region_worklist(surface, spark.createDataFrame([], "from string, to string"), leads)
    (got,) = out.collect()
    assert sorted(got.leads) == sorted(f"c{n}" for n in range(50))
    below = out._jdf.queryExecution().optimizedPlan().toString().split("Join Inner, (p#")[1]
    assert "- Aggregate [" in below[: below.index("regexp_replace")]  # the files' beginnings are made distinct before the join
