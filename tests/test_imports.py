from pyspark.sql import functions as F

from tests.test_operators import make
from wardenflow.functions import scalar as X
from wardenflow.operators import findings as N
from wardenflow.plans.imports import import_findings


def test_context_scalars(spark):
    rows = spark.createDataFrame([(None, "f(x"), ("Exposure: INTERNAL", "no call"), ("* Criticality: `peripheral`", "g((1)(2))(3)"), ("## Auth\r\nby key", "()")], "doc string, call string")
    got = rows.select(X.deployment_facts(F.col("doc")).alias("f"), X.ruling_sections(F.col("doc")).alias("s"), X.balanced_arguments(F.col("call")).alias("b")).collect()
    assert [(r.f.exposure, r.f.criticality) for r in got] == [(None, None), (None, None), (None, "peripheral"), (None, None)]
    assert [r.s for r in got] == [None, None, None, "## Auth\nby key"]
    assert [r.b for r in got] == [None, None, "(1)(2)", ""]


def test_prune_keeps_what_has_no_place(spark):
    rows = make(spark, [{"tool": "a", "category": "dep", "title": "t", "severity": "low"}, {"tool": "a", "category": "sast", "title": "t", "severity": "low", "file": "out/x", "line": 1}])
    kept, dropped = N.prune_paths(rows, F.col("file").startswith("out/"))
    assert [r.file for r in kept.collect()] == [None] and dropped.first().dropped == 1


def test_import_into_an_empty_run(spark):
    found = make(spark, [{"tool": "deep", "category": "sast", "title": "t", "severity": "high", "file": "a", "line": 1, "cwe": "CWE-1"}])
    none = spark.createDataFrame([], "cve string, epss double")
    got = import_findings(found.limit(0), found, none, none.select("cve")).collect()
    assert [(r.sources, r.status, r.risk) for r in got] == [(["deep"], "open", 48)]
