import pytest
from pyspark.sql import functions as F

from wardenflow.streaming import behaviour as B
from wardenflow.streaming.log_stream import first_of_each, late_rows

SCHEMA = "ip string, at timestamp, idx long, failed boolean, success boolean, error boolean, hit boolean"


@pytest.fixture
def store(spark):
    for k, v in B.STORE.items():
        spark.conf.set(k, v)
    yield
    for k in B.STORE:
        spark.conf.unset(k)


def test_watch_holds_fewer_marks_than_its_thresholds():
    w = B.Watch(60_000, 3, 4, 5)
    out = []
    for n in range(1000):
        out += w.see(n * 7_000, failed=n % 2 == 0, success=False, error=n % 3 == 0, hit=n % 50 == 49)
    assert [a[0] for a in out] == ["brute-force", "request-burst", "scan-behavior", "recon-hit"][:2] + [a[0] for a in out[2:]]
    assert sum(map(len, w.marks.values())) < 3 + 4 + 6


def stream_of(spark, tmp_path, batches):
    """A file for each micro-batch, in order."""
    for n, rows in enumerate(batches):
        df = spark.createDataFrame([(ip, None, i, *flags, s) for ip, s, i, *flags in rows], SCHEMA + ", s long").withColumn("at", F.timestamp_seconds("s")).drop("s")
        df.coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")


F_, S_ = (True, False, False, False), (False, True, False, False)


def test_rows_are_taken_in_time_order_over_micro_batches(spark, tmp_path, store):
    first = [("a", 1000, 1, *F_), ("a", 1030, 3, *F_), ("b", 1000, 1, *F_)]
    second = [("a", 1010, 2, *F_), ("a", 1040, 4, *S_), ("b", 2000, 2, *F_)]  # 1010 is late but within the delay
    third = [("a", 900, 5, *F_), ("c", 9000, 1, *F_)]  # 900 comes after the watermark
    rows = stream_of(spark, tmp_path, [first, second, third])
    run = B.run_to_end(B.alerts_in_time(rows, delay="100 seconds", failures=3, bucket_s=10), folder=f"{tmp_path}/run")
    got = {tuple(r) for r in spark.read.schema(B.ALERT).parquet(f"{run.folder}/out").collect()}
    assert got == {("a", "brute-force", 1_030_000, 1_000_000, 3), ("a", "credential-compromise", 1_040_000, 1_040_000, 1)}
    assert run.late == 1


def test_silent_addresses_are_forgotten(spark, tmp_path, store):
    rows = [[(f"ip{n}", 1000 + n, n, *F_) for n in range(20)], [("x", 50_000, 1, *F_)], [("x", 90_000, 1, *F_)]]
    stream = stream_of(spark, tmp_path, rows)
    kept = B.run_to_end(B.alerts_in_time(stream, delay="1 second", bucket_s=10), folder=f"{tmp_path}/kept")
    gone = B.run_to_end(B.alerts_in_time(stream, delay="1 second", bucket_s=10, idle_s=600), folder=f"{tmp_path}/gone")
    assert gone.state_rows < 8 <= 20 <= kept.state_rows


def test_caps_hold_over_micro_batches(spark, tmp_path):
    batches = [[("a", s, s, *F_) for s in range(4)] + [("b", 1, 1, *F_)], [("a", s, s, *F_) for s in range(10, 14)], [("b", s, s, *F_) for s in range(20, 24)]]
    rows = stream_of(spark, tmp_path, batches).select("ip", "idx")
    B.run_to_end(rows, B.capped_writer(f"{tmp_path}/capped", "ip", ["idx"], 3), f"{tmp_path}/run")
    kept = spark.read.option("basePath", f"{tmp_path}/capped/kept").parquet(f"{tmp_path}/capped/kept")
    assert sorted((r.ip, r.idx) for r in kept.collect()) == [("a", 0), ("a", 1), ("a", 2), ("b", 1), ("b", 20), ("b", 21)]
    left = spark.read.option("basePath", f"{tmp_path}/capped/left_out").parquet(f"{tmp_path}/capped/left_out").groupBy("ip").sum("left_out")
    assert {tuple(r) for r in left.collect()} == {("a", 5), ("b", 2)}


def test_a_batch_that_is_run_again_writes_the_same(spark, tmp_path):
    write = B.capped_writer(f"{tmp_path}/again", "ip", ["idx"], 2)
    batch = spark.createDataFrame([("a", n) for n in range(4)], "ip string, idx long")
    for n in (0, 1, 1, 0):
        write(batch, n)
    assert spark.read.parquet(f"{tmp_path}/again/kept/batch=0").count() == 2
    assert spark.read.parquet(f"{tmp_path}/again/kept/batch=1").count() == 0


def test_duplicates_and_counts_by_minute(spark, tmp_path, store):
    batches = [[("a", 10, 1, *F_), ("a", 20, 1, *F_), ("a", 70, 2, *F_)], [("a", 30, 1, *F_), ("a", 500, 3, *F_)], [("a", 600, 5, *F_)], [("a", 40, 9, *F_), ("a", 900, 4, *F_)]]  # 40 is late by the watermark before last
    stream = stream_of(spark, tmp_path, batches)
    once = B.run_to_end(first_of_each(stream.select("ip", "idx", "at"), ["ip", "idx"], "at", "1 minute"), folder=f"{tmp_path}/once")
    assert sorted(r.idx for r in spark.read.parquet(f"{once.folder}/out").collect()) == [1, 2, 3, 4, 5]
    minutes = B.run_to_end(late_rows(stream, "at", "1 minute"), folder=f"{tmp_path}/minutes")
    got = {r["window"].start.minute: r.n for r in spark.read.parquet(f"{minutes.folder}/out").collect()}
    assert got[0] == 3 and got[1] == 1 and minutes.late == 1


def test_an_address_is_read_and_written_once_however_many_buckets_wait():
    import pandas as pd

    class State:
        exists, get, timeout, updates, now = False, None, None, 0, 0
        getCurrentWatermarkMs = lambda self: self.now

        def update(self, new):
            self.exists, self.get, self.timeout, self.updates = True, new, None, self.updates + 1

        def setTimeoutTimestamp(self, ms):
            assert ms > self.now
            self.timeout = ms

        def remove(self):
            self.exists, self.get = False, None

    step = B.behaviour({"window_ms": 60_000, "failures": 3, "errors": 99, "requests": 999}, 10_000, 600_000)
    frame = lambda *ms: pd.DataFrame([(x, x, 1) for x in ms], columns=["ms", "idx", "flags"])
    state = State()
    assert not list(step(("a",), iter([frame(*range(500_000, 700_000, 10_000)), frame(105_000, 109_000)]), state))
    assert (state.updates, state.timeout) == (1, 110_000)
    state.now = 120_000
    (got,) = step(("a",), iter([frame(119_000, 121_000)]), state)
    assert got.values.tolist() == [["a", "brute-force", 119_000, 105_000, 3]]
    assert (state.updates, state.timeout) == (2, 130_000)
    state.now = 130_001
    assert not list(step(("a",), iter([]), state)) and state.timeout == 510_000
    state.now = 700_000
    assert not list(step(("a",), iter([]), state)) and state.timeout == 1_290_000
    state.now = 1_290_001
    assert not list(step(("a",), iter([]), state)) and not state.exists
