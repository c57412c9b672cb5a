import random
import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from wardenflow.operators import positional as P
from wardenflow.operators import scans
from wardenflow.operators import windows as W


@pytest.fixture(scope="module")
def hot(spark):
    """Nine rows in ten belong to one key; some orders are shared."""
    rng = random.Random(4)
    rows = [(n, "hot" if n % 10 else rng.choice(["a", "b", None]), rng.randrange(1500), rng.choice(["x", "y", "z", None]) if n % 7 else f"v{n}") for n in range(2000)]
    return spark.createDataFrame(rows, "id int, k string, t int, v string").repartition(5).cache()


def same(a, b):
    columns = sorted(b.columns)
    return sorted(map(repr, a.select(columns).collect())) == sorted(map(repr, b.select(columns).collect()))


def test_a_hot_group_spreads(hot):
    placed = scans.segments(hot, ["k"], ["t"], 8)
    sizes = [r["count"] for r in placed.filter("k = 'hot'").groupBy("part__").count().collect()]
    assert len(sizes) >= 7 and max(sizes) < 600


def test_running_sum_and_last_known_over_segments(hot):
    w = Window.partitionBy("k").orderBy("t", "id").rowsBetween(Window.unboundedPreceding, 0)
    placed = scans.segments(hot, ["k"], ["t", "id"], 8)
    got = scans.running_sum(placed, ["k"], ["t", "id"], F.col("id"), "s").drop("part__", "tie__n__")
    assert same(got, hot.withColumn("s", F.sum("id").over(w)))
    sparse = placed.withColumn("v", F.when(F.col("id") % 301 == 0, F.col("v")))
    got = scans.last_known(sparse, ["k"], ["t", "id"], "v", "last").drop("part__", "tie__n__")
    assert same(got, hot.withColumn("v", F.when(F.col("id") % 301 == 0, F.col("v"))).withColumn("last", F.last("v", ignorenulls=True).over(w)))


@pytest.mark.parametrize("parts", [1, 8])
def test_windows_against_plain_ones(hot, parts, monkeypatch):
    monkeypatch.setattr(scans, "parts_for", lambda rows: parts)
    plain = Window.partitionBy("k").orderBy("t", "id")
    rows = hot.withColumn("o", F.col("t") * 10_000 + F.col("id"))
    by = Window.partitionBy("k").orderBy("o")
    assert same(W.round_robin(hot, "k", [F.col("t").desc(), "id"]), hot.withColumn("turn", F.row_number().over(Window.partitionBy("k").orderBy(F.col("t").desc(), "id"))))
    marker = F.when(F.col("id") % 13 == 0, F.col("id"))
    assert same(W.look_back(rows, "k", "o", marker, 9, "near"), rows.withColumn("near", F.last(marker, ignorenulls=True).over(by.rowsBetween(-9, 0))))
    assert same(W.rows_before(rows, "k", "o", "v", 3, "before"), rows.withColumn("before", F.collect_list("v").over(by.rowsBetween(-3, -1))))
    assert same(W.next_bound(rows, "k", "o", "next"), rows.withColumn("next", F.lead("o").over(by)))
    fresh = F.col("v").isNotNull() & (F.row_number().over(Window.partitionBy("k", "v").orderBy("t", "id")) == 1)
    want = hot.withColumn("f", fresh.cast("long")).withColumn("seen", F.sum("f").over(plain.rowsBetween(Window.unboundedPreceding, 0))).drop("f")
    assert same(W.running_distinct(hot, "k", "v", ["t", "id"], "seen"), want)


def test_blocks_borrow_what_windows_need(hot):
    rows, by = scans.dealt(hot, ["k"], ["t", "id"], back=3, ahead=2, width=10, parts=4)
    assert rows.groupBy(*by).count().agg(F.max("count")).first()[0] <= 15
    w = Window.partitionBy(*by).orderBy("n__")
    got = rows.withColumns({"a": F.lag("id", 3).over(w), "b": F.lead("id", 2).over(w)}).filter("not lent__").drop("n__", "block__", "lent__")
    plain = Window.partitionBy("k").orderBy("t", "id")
    assert got.count() == 2000
    assert same(got, hot.withColumns({"a": F.lag("id", 3).over(plain), "b": F.lead("id", 2).over(plain)}))


def test_as_of_over_segments(spark, hot, monkeypatch):
    monkeypatch.setattr(scans, "parts_for", lambda rows: 9)
    right = hot.filter("id % 40 < 3").select("k", "t", "id", F.col("v").alias("w"))
    got = {r.id: (r.at, r.w) for r in P.as_of(hot.select("id", "k", "t"), right.withColumn("at", F.col("id")), "k", "t", ["at", "w"], tie="id").collect()}
    known = right.collect()
    want = {}
    for r in hot.filter("k is not null").collect():
        before = [x for x in known if x.k == r.k and x.t <= r.t]
        last = max(before, key=lambda x: (x.t, x.id), default=None)
        want[r.id] = (last.id, last.w) if last else (None, None)
    assert got == want


def brute_innermost(points, spans):
    out = {}
    for k, p, n in points:
        held = [(a, -(z if z is not None else P.OPEN), name) for key, a, z, name in spans if key == k and p is not None and a <= p and (z is None or p <= z)]
        out[n] = max(held)[2] if held else None
    return out


@pytest.mark.parametrize("parts", [1, 3, 12])
@pytest.mark.parametrize("kind", ["nested", "any"])
def test_innermost_against_brute_force(spark, monkeypatch, parts, kind):
    monkeypatch.setattr(P, "parts_for", lambda rows: parts)
    rng = random.Random(parts)
    spans = [("hot", 0, 2000, "all"), ("hot", 0, None, "open"), ("cold", 5, 9, "c"), ("cold", 5, 9, "d"), (None, 1, 2, "n")]
    for n in range(300):
        a = rng.randrange(1000)
        spans.append(("hot", a, a + rng.choice([0, 3, 30, 400] if kind == "any" else [0, 1]), f"s{n:03d}"))
    if kind == "nested":
        spans += [("hot", 10 * d, 1990 - 10 * d, f"deep{d}") for d in range(90)]
    points = [("hot" if n % 12 else "cold", rng.randrange(1100) if n % 50 else None, n) for n in range(600)]
    p = spark.createDataFrame(points, "k string, p int, n int")
    s = spark.createDataFrame(spans, "k string, a int, z int, name string")
    got = {r.n: r.enclosing for r in P.innermost(p, s, "k", "p", "a", "z", "name").collect()}
    assert got == brute_innermost(points, spans)


def test_innermost_of_nothing(spark):
    p = spark.createDataFrame([("k", 1)], "k string, p int")
    s = spark.createDataFrame([], "k string, a int, z int, name string")
    assert [r.enclosing for r in P.innermost(p, s, "k", "p", "a", "z", "name").collect()] == [None]
    assert P.innermost(p.limit(0), s, "k", "p", "a", "z", "name").collect() == []


def test_rules_by_literal_prefix(spark):
    from wardenflow.sources.repo import glob_pattern

    globs = ["*", "*.md", "/src/", "src/api/*.js", "docs/**", "/src/api/v?/", "lib/{a,b}.js", "src/api/x.js", "/top.js"]
    assert [P.literal_prefix(g) for g in globs] == ["", "", "src/", "src/api/", "docs/", "src/api/", "lib/", "src/api/x.js", "top.js"]
    rules = spark.createDataFrame([(n, g, glob_pattern(g), P.literal_prefix(g)) for n, g in enumerate(globs)], "ord int, owner string, pattern string, prefix string")
    paths = ["src/a.js", "src/api/a.js", "src/api/x.js", "src/api/v1/b.js", "docs/a/b.md", "lib/a.js", "lib/c.js", "top.js", "x.md", "a/src/api/q.js"]
    rows = spark.createDataFrame([(p,) for p in paths], "file string")
    matches = F.expr("file rlike pattern")
    plain = {r.file: r.owner for r in P.last_rule(rows, rules, "file", "ord", "owner", matches).collect()}
    assert {r.file: r.owner for r in P.last_rule(rows, rules, "file", "ord", "owner", matches, "prefix").collect()} == plain
    assert plain["src/api/x.js"] == "src/api/x.js" and plain["lib/c.js"] == "*"


def test_dense_windows_are_counted_over_frames_that_only_grow(spark):
    rows = [("a", i // 7) for i in range(3000)] + [("b", 50), ("b", 50), ("b", 71)]
    counted = W.sliding_count_dealt(spark.createDataFrame(rows, "ip string, at long"), "ip", "at", 20)
    frames = re.findall(r"specifiedwindowframe\(RangeFrame, ([^,]+),", counted._jdf.queryExecution().optimizedPlan().toString())
    assert frames and set(frames) == {"unboundedpreceding$()"}  # Spark goes over a frame with two moving ends once for each row
    for r in counted.collect():
        own = [t for ip, t in rows if ip == r.ip and r.at - 20 <= t <= r.at]
        assert (r.n_in_window, r.n_in_window_from) == (len(own), min(own))
