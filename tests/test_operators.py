import json
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from wardenflow.functions import scalar as X
from wardenflow.operators import findings as N
from wardenflow.operators import fold as D
from wardenflow.operators import graph as G
from wardenflow.operators import positional as P
from wardenflow.operators import windows as W


def make(spark, rows):
    keys = ("tool", "category", "title", "severity", "file", "line", "cwe", "cve", "aliases", "pkg", "version", "status", "message")
    kinds = "tool string, category string, title string, severity string, file string, line int, cwe string, cve string, aliases array<string>, pkg string, version string, status string, message string"
    return N.conform(spark.createDataFrame([tuple(r.get(k) for k in keys) for r in rows], kinds))


def test_dealt_windows_equal_plain_ones(spark):
    draw = random.Random(1)
    rows = [(draw.choice("ab"), draw.randint(0, 500)) for _ in range(400)] + [("a", None)]
    df = spark.createDataFrame(rows, "actor string, at long")
    plain = sorted(map(repr, W.sliding_count(df, "actor", "at", 20).collect()))
    for width in (20, 33, 200):
        dealt = W.sliding_count_dealt(df.filter("at is not null"), "actor", "at", 20, width=width)
        assert sorted(map(repr, dealt.unionByName(W.sliding_count(df.filter("at is null"), "actor", "at", 20)).select(df.columns + ["n_in_window", "n_in_window_from"]).collect())) == plain


def test_numbers_shards_and_batches(spark):
    df = spark.createDataFrame([(i,) for i in random.Random(2).sample(range(1000), 300)], "id long")
    want = {x: i for i, x in enumerate(sorted(r.id for r in df.collect()), 1)}
    assert {r.id: r.position for r in W.numbered(df, ["id"], buckets=7).collect()} == want
    assert {r.id: r.shard for r in W.shard(df, ["id"], 4).collect()} == {x: (i - 1) % 4 for x, i in want.items()}
    assert max(r.batch for r in W.batches(df, ["id"], 8).collect()) == (len(want) - 1) // 8


def test_as_of_takes_the_latest_at_or_before(spark):
    left = spark.createDataFrame([(1, "f", 5), (2, "f", 1), (3, "g", 5)], "id int, k string, t int")
    right = spark.createDataFrame([("f", 2, "two"), ("f", 5, "five-a"), ("f", 5, "five-b"), ("f", 9, "nine")], "k string, t int, v string").withColumn("tie", F.monotonically_increasing_id())
    assert {r.id: r.v for r in P.as_of(left, right, "k", "t", ["v"], tie="tie").collect()} == {1: "five-b", 2: None, 3: None}


def test_innermost_prefers_late_starts_then_tight_ends(spark):
    spans = spark.createDataFrame([("f", 1, 100, "outer"), ("f", 10, 20, "inner"), ("f", 10, None, "open"), ("f", 50, None, "tail")], "f string, a int, z int, name string")
    points = spark.createDataFrame([("f", 15), ("f", 5), ("f", 60), ("g", 1)], "f string, p int")
    assert {(r.f, r.p): r.enclosing for r in P.innermost(points, spans, "f", "p", "a", "z", "name").collect()} == {("f", 15): "inner", ("f", 5): "outer", ("f", 60): "tail", ("g", 1): None}


def test_rules_and_prefixes(spark):
    rows = spark.createDataFrame([("src/a/b.js",), ("src/x.js",), ("top.js",)], "path string")
    folders = spark.createDataFrame([("src",), ("src/a",)], "folder string")
    assert {r.path: r.region for r in P.longest_prefix(rows, "path", folders, "folder").collect()} == {"src/a/b.js": "src/a", "src/x.js": "src", "top.js": "."}


def test_taint_paths_visit_once(spark):
    sinks = spark.createDataFrame([("s", "db", "find", 9)], "sink_id string, file string, symbol string, line int")
    callers = spark.createDataFrame([("find", "a", "list", 5), ("find", "a", "list", 7), ("list", "b", "main", 3), ("main", "b", "main", 4)], "callee string, file string, symbol string, line int")
    sources = spark.createDataFrame([("a", 2, "http"), ("a", 6, "env"), ("b", 1, "cli")], "file string, line int, source string")
    got = {(r.source, r.source_file, r.source_line, r.depth) for r in G.taint_paths(sinks, callers, sources, 6).collect()}
    assert got == {("http", "a", 2, 1), ("cli", "b", 1, 2)}


def test_correlate(spark):
    base = {"category": "sast", "title": "t", "severity": "low", "file": "f", "line": 3, "cwe": "CWE-89"}
    rows = make(spark, [
        base | {"tool": "x"}, base | {"tool": "y", "severity": "high", "cwe": "cwe-89 "}, base | {"tool": "z", "line": 4},
        {"tool": "a", "category": "dep", "title": "d1", "severity": "low", "pkg": "P", "aliases": ["GHSA-1", "CVE-2024-1111"]},
        {"tool": "b", "category": "dep", "title": "d2", "severity": "medium", "pkg": "p", "aliases": ["CVE-2024-1111", "OSV-2"]},
        {"tool": "c", "category": "dep", "title": "d3", "severity": "low", "pkg": "p", "aliases": ["OSV-2"]},
        {"tool": "c", "category": "dep", "title": "d4", "severity": "low", "pkg": "q", "aliases": ["OSV-2"]},
        {"tool": "engine", "category": "taint", "title": "sql", "severity": "high", "file": "f", "line": 4, "cwe": "CWE-89"},
    ])
    once = N.correlate(rows)
    got = sorted((r.category, r.severity, r.confidence, tuple(r.sources)) for r in once.collect())
    assert got == [("dep", "low", "medium", ("c",)), ("dep", "medium", "high", ("a", "b", "c")), ("sast", "high", "high", ("x", "y")), ("taint", "high", "high", ("engine", "z"))]
    again = sorted((r.category, r.severity, r.confidence, tuple(r.sources)) for r in N.correlate(once).collect())
    assert again == got


def test_ranking_and_families(spark):
    rows = [{"tool": "t", "category": "sast", "title": "x", "severity": s, "file": f"a/b/{i}.js", "line": 1, "status": st} for i, (s, st) in enumerate([("low", "open"), ("critical", "confirmed"), ("odd", "open"), ("high", "dismissed"), ("high", "open")])]
    order = [(r.status, r.severity) for r in N.ranked(make(spark, rows)).collect()]
    assert order == [("confirmed", "critical"), ("open", "high"), ("open", "low"), ("open", "odd"), ("dismissed", "high")]
    assert {r.members for r in N.families(make(spark, rows)).collect()} == {5}


def test_noise_demotes_and_never_drops(spark):
    rows = make(spark, [{"tool": "t", "category": "sast", "title": "a", "severity": "high", "file": "tests/a.js", "line": 1}, {"tool": "t", "category": "secret", "title": "b", "severity": "high", "file": "src/k.js", "line": 1}, {"tool": "t", "category": "dep", "title": "c", "severity": "high", "file": "vendor/x.js", "line": 1}, {"tool": "t", "category": "sast", "title": "d", "severity": "high", "file": "vendor/x.js", "line": 1}])
    lines = spark.createDataFrame([("src/k.js", 1, "const SHEET_ID = 'abc'")], "file string, line int, text string")
    assert {r.title: (r.noise, r.severity) for r in N.demote(rows, lines).collect()} == {"a": ("test-only-path", "low"), "b": ("resource-identifier", "low"), "c": (None, "high"), "d": ("vendored-artifact", "info")}


VERDICTS = "id string, verdict string, note string, exploit_path string, brocard string, pos long"


def test_verdicts_fold_and_fold_again(spark):
    rows = make(spark, [{"tool": "t", "category": "sast", "title": str(i), "severity": s, "message": "m"} for i, s in enumerate(["high", "low", "high", "low"])])
    ids = {r.title: r.id for r in rows.collect()}
    v = spark.createDataFrame([(ids["0"], "unsupported", "n", None, None, 1), (ids["1"], "supported", None, None, None, 1), (ids["1"], "refuted", "why", None, "outside-usage", 2), (ids["2"], "supported", "yes", "p", None, 1), ("gone", "partial", None, None, None, 1)], VERDICTS)
    once = D.apply_verdicts(rows, v)
    got = {r.title: (r.status, r.verdict, r.brocard) for r in once.collect()}
    assert got == {"0": ("needs-human", "unsupported", None), "1": ("dismissed", "refuted", "outside-usage"), "2": ("confirmed", "supported", None), "3": ("open", None, None)}
    assert sorted(map(repr, D.apply_verdicts(once, v).collect())) == sorted(map(repr, once.collect()))
    assert [r.id for r in D.unknown_ids(v, rows).collect()] == ["gone"]
    assert D.worklist_counts(once).first() == (1, 0, 1)
    good, bad = D.valid_rows(spark.createDataFrame([("a", "supported"), (None, "odd"), ("b", None)], "id string, verdict string"))
    assert good.count() == 1 and sorted(len(r.errors) for r in bad.collect()) == [1, 2]


def test_merge_keeps_rulings(spark):
    rows = make(spark, [{"tool": "t", "category": "sast", "title": str(i), "severity": "low", "message": "m"} for i in range(3)])
    ids = {r.title: r.id for r in rows.collect()}
    ruled = D.apply_verdicts(rows, spark.createDataFrame([(ids["0"], "refuted", "n", None, None, 1)], VERDICTS))
    merged = {r.title: r.status for r in D.merge_runs(ruled.filter("title <> '2'"), rows.filter("title <> '1'")).collect()}
    assert merged == {"0": "dismissed", "1": "open", "2": "open"}


def test_ingest_and_check(spark):
    rows = make(spark, [{"tool": "engine", "category": "sast", "title": "t", "severity": "low", "file": "f", "line": 2, "cwe": "CWE-1"}])
    new = make(spark, [{"tool": "agent", "category": "sast", "title": "u", "severity": "low", "file": "f", "line": n, "cwe": c} for n, c in ((2, "cwe-1"), (3, "CWE-2"), (99, "CWE-3"))] + [{"tool": "other", "category": "sast", "title": "u", "severity": "low", "file": "f", "line": 3, "cwe": "CWE-2"}]).withColumn("pos", F.monotonically_increasing_id())
    files = spark.createDataFrame([("f", 10)], "file string, n_lines int")
    out, rejected = D.ingest(rows, new, files)
    assert sorted((r.line, tuple(r.sources)) for r in out.collect()) == [(2, ("agent", "engine")), (3, ("agent", "other"))]
    assert [r.line for r in rejected.collect()] == [99]
    assert D.gate(out, files)["exit"] == 0 and D.gate(out, files, strict=True)["unadjudicated"] == 2
    assert [r.problem for r in D.check_citations(out.withColumn("line", F.lit(11)), files).collect()] == ["no such line"] * 2


@pytest.mark.parametrize(("severity", "epss", "kev", "extra", "want"), [("high", 0.0, False, {}, 48), ("info", None, True, {}, 95), ("critical", 1.0, False, {}, 100), ("high", 0.0, False, {"reachability": "unproven"}, 34), ("low", 0.0, True, {"reachability": "toolchain"}, 52), ("high", 0.5, False, {"exposure": "internal"}, 66)])
def test_risk(spark, severity, epss, kev, extra, want):
    columns = {k: F.lit(v) for k, v in extra.items()}
    assert spark.range(1).select(X.risk_score(F.lit(severity), F.lit(epss).cast("double"), F.lit(kev), **columns).alias("r")).first().r == want


def test_scalars(spark):
    def value(column):
        return spark.range(1).select(column.alias("x")).first().x

    assert value(X.cvss_base_score(F.lit("CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:C/C:H/I:H/A:H"))) == 10.0
    assert value(X.cvss_base_score(F.lit("CVSS:3.1/AV:N"))) is None
    assert value(X.epoch_ms(F.lit("10/Oct/2024:13:55:36 +0200"))) == value(X.epoch_ms(F.lit("2024-10-10T11:55:36Z")))
    assert value(X.epoch_ms(F.lit("Jan  2 03:04:05"))) is None
    assert value(X.decode_once(F.lit("a+b%20c"))) == "a+b c" and value(X.decode_once(F.lit("%zz"))) is None
    note = X.with_stage_note(F.lit("m\n\nVerdict (partial): a\n\nRevalidation (fixed): b"), "Verdict", F.lit("refuted"), F.lit("c"))
    assert value(note) == "m\n\nRevalidation (fixed): b\n\nVerdict (refuted): c"
    assert value(X.stage_notes(note)) == "Revalidation (fixed): b · Verdict (refuted): c"
    assert value(X.redact(F.lit("mail a@b.io card 4111 1111 1111 1111 not 4111 1111 1111 1112"))) == "mail ‹REDACTED:email› card ‹REDACTED:card› not 4111 1111 1111 1112"
    assert value(X.normalize_category(F.lit(" Path_Traversal "))) == "taint" and value(X.normalize_category(F.lit("nope"))) is None
    assert [value(X.is_private_host(F.lit(x))) for x in ("10.0.0.1", "172.32.0.1", "::1", "8.8.8.8")] == [True, False, True, False]
    assert value(X.split_pkg_version(F.lit("@a/b@1"))).asDict() == {"pkg": "@a/b", "version": "1"}


def test_every_query_has_the_columns_of_its_sql(spark):
    import duckdb

    import __spark_entry__ as entry
    from wardenflow.plans.catalogue import ORACLES, QUERIES

    names, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(names) and json.dumps(sorted(sql))

    folder = Path("/root/testdata/sf0.001")
    if not folder.exists():
        pytest.skip("no tables")
    assert entry.entry(spark).count() >= 0
    db = duckdb.connect()
    for file in folder.glob("*.parquet"):
        db.execute(f"create view {file.stem} as select * from read_parquet('{file}')")
    assert set(ORACLES) <= set(QUERIES)
    planned = [name for name in ORACLES if name != "stateful_log_stream"]  # that one runs when it is asked for
    for name in planned:
        assert sorted(QUERIES[name](spark, str(folder)).columns) == sorted(x[0] for x in db.execute(f"describe {ORACLES[name]}").fetchall()), name
