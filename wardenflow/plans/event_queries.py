"""Windows, sequences and aggregates over ``events``: users as actors, errors as failures, purchases as successes."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardenflow.functions import scalar as X
from wardenflow.operators import positional as P
from wardenflow.operators import windows as W
from wardenflow.plans.registry import Tables, query

DAY_US, HOUR_US = 86_400_000_000, 3_600_000_000


def timed(t: Tables):
    return t.events.withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))


@query(
    "brute_force_windows",
    """
    with c as (
        select user_id, event_id, epoch_us(ts) as moment, count(*) over w as n_in_window, epoch_us(min(ts) over w) as started
        from events where event_type = 'error' window w as (partition by user_id order by ts range between interval 24 hours preceding and current row)
    ), f as (
        select *, row_number() over (partition by user_id order by moment, event_id) as k from c where n_in_window >= 3
    )
    select substr(sha256('engine:brute-force:' || user_id || ':events:' || event_id), 1, 12) as id, user_id, event_id, n_in_window, started, 'medium' as severity,
        cast(least(greatest(floor(cast(100 as double) * (cast(0.6 as double) * cast(0.5 as double) + cast(0.4 as double) * least(n_in_window / cast(20 as double), cast(1 as double))) + cast(0.5 as double)), 0), 100) as int) as risk
    from f where k = 1
    """,
)
def brute_force_windows(t: Tables):  # W1, W3, W4, X1, X6, T4
    failures = timed(t).filter("event_type = 'error'").select("user_id", "event_id", "at")
    counted = W.sliding_count_dealt(failures, "user_id", "at", DAY_US).withColumnRenamed("n_in_window_from", "started")
    first = W.first_trigger(counted, "user_id", ["at", "event_id"], F.col("n_in_window") >= 3)
    out = first.withColumn("severity", F.lit("medium"))
    out = out.withColumn("id", X.finding_id(F.lit("engine"), F.concat(F.lit("brute-force:"), F.col("user_id").cast("string")), F.lit("events"), F.col("event_id")))
    out = out.withColumn("risk", X.risk_score(F.col("severity"), F.least(F.col("n_in_window") / F.lit(20.0), F.lit(1.0)), F.lit(False)))
    return out.select("id", "user_id", "event_id", "n_in_window", "started", "severity", "risk").orderBy(F.col("risk").desc(), "id")


@query(
    "line_proxy_windows",
    """
    with c as (select user_id, event_id, count(*) over (partition by user_id order by event_id range between 500 preceding and current row) as n_in_window from events where event_type = 'error')
    select user_id, event_id, n_in_window from c where n_in_window >= 2
    """,
)
def line_proxy_windows(t: Tables):  # W2
    failures = t.events.filter("event_type = 'error'").select("user_id", "event_id")
    return W.sliding_count_dealt(failures, "user_id", "event_id", 500).filter("n_in_window >= 2").select("user_id", "event_id", "n_in_window")


@query(
    "request_burst",
    """
    with c as (select user_id, event_id, ts, count(*) over (partition by user_id order by ts range between interval 6 hours preceding and current row) as n_in_window from events),
    f as (select *, row_number() over (partition by user_id order by ts, event_id) as k from c where n_in_window > 2)
    select user_id, event_id, n_in_window from f where k = 1
    """,
)
def request_burst(t: Tables):  # W1, W3: more than, not at least
    counted = W.sliding_count_dealt(timed(t).select("user_id", "event_id", "at"), "user_id", "at", 6 * HOUR_US)
    return W.first_trigger(counted, "user_id", ["at", "event_id"], F.col("n_in_window") > 2).select("user_id", "event_id", "n_in_window")


SPIKE = """
    with c as (select user_id, event_id, ts, count(*) over (partition by user_id order by ts range between interval 24 hours preceding and current row) as n from events where event_type = 'error'),
    f as (select user_id, ts, row_number() over (partition by user_id order by ts, event_id) as k from c where n >= 3)
"""


@query("recon_hit", SPIKE + "select f.user_id, epoch_us(f.ts) as \"at\", min(epoch_us(e.ts)) as followed_at from f join events e on e.user_id = f.user_id and e.ts >= f.ts and e.event_type = 'view' where k = 1 group by all")
def recon_hit(t: Tables):  # W8
    e = timed(t)
    counted = W.sliding_count_dealt(e.filter("event_type = 'error'").select("user_id", "event_id", "at"), "user_id", "at", DAY_US)
    triggers = W.first_trigger(counted, "user_id", ["at", "event_id"], F.col("n_in_window") >= 3).select("user_id", "at")
    return W.followed_by(triggers, e.select("user_id", "at", "event_type"), "user_id", "at", F.col("event_type") == "view", inclusive=True)


@query("credential_compromise", SPIKE + "select f.user_id, epoch_us(f.ts) as \"at\", min(epoch_us(e.ts)) as followed_at from f join events e on e.user_id = f.user_id and e.ts > f.ts and e.event_type = 'purchase' where k = 1 group by all")
def credential_compromise(t: Tables):  # W8
    e = timed(t)
    counted = W.sliding_count_dealt(e.filter("event_type = 'error'").select("user_id", "event_id", "at"), "user_id", "at", DAY_US)
    triggers = W.first_trigger(counted, "user_id", ["at", "event_id"], F.col("n_in_window") >= 3).select("user_id", "at")
    return W.followed_by(triggers, e.select("user_id", "at", "event_type"), "user_id", "at", F.col("event_type") == "purchase")


@query("success_after_failure", "select e.user_id, count(*) as n from events e join (select user_id, min(ts) as first_fail from events where event_type = 'error' group by 1) f on e.user_id = f.user_id and e.ts > f.first_fail where e.event_type = 'purchase' group by 1")
def success_after_failure(t: Tables):  # A6
    first = t.events.filter("event_type = 'error'").groupBy("user_id").agg(F.min("ts").alias("first_fail"))
    return t.events.filter("event_type = 'purchase'").join(first, "user_id").filter("ts > first_fail").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query("top_actors", "select user_id, count(*) as n, min(event_id) as first_seen from events group by 1 order by n desc, first_seen limit 10")
def top_actors(t: Tables):  # A4, T10
    return t.events.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_seen")).orderBy(F.col("n").desc(), "first_seen").limit(10)


@query("type_histogram", "select event_type, count(*) as n, count(distinct user_id) as actors from events group by 1")
def type_histogram(t: Tables):  # A5, A7
    return t.events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("actors"))


@query("first_last_seen", "select user_id, arg_min(epoch_us(ts), event_id) as first_at, arg_max(epoch_us(ts), event_id) as last_at, count(*) as n from events group by 1")
def first_last_seen(t: Tables):  # A5: in arrival order, not time order
    return timed(t).groupBy("user_id").agg(F.min_by("at", "event_id").alias("first_at"), F.max_by("at", "event_id").alias("last_at"), F.count(F.lit(1)).alias("n"))


@query("family_cap_kept", "select event_type, event_id from (select *, row_number() over (partition by event_type order by event_id) as k from events) where k <= 50")
def family_cap_kept(t: Tables):  # W7
    return W.capped(t.events.select("event_type", "event_id"), ["event_type"], ["event_id"], 50)


@query("family_cap_overflow", "select event_type, least(count(*), 50) as kept, greatest(count(*) - 50, 0) as left_out from events group by 1")
def family_cap_overflow(t: Tables):  # W7
    return W.overflow(t.events, ["event_type"], 50)


@query("running_distinct_types", "with f as (select user_id, event_id, row_number() over (partition by user_id, event_type order by event_id) = 1 as fresh from events) select user_id, event_id, cast(sum(fresh::int) over (partition by user_id order by event_id rows unbounded preceding) as bigint) as seen from f")
def running_distinct_types(t: Tables):  # W5
    return W.running_distinct(t.events, "user_id", "event_type", ["event_id"], "seen").select("user_id", "event_id", "seen")


@query("look_back_error", "select user_id, event_id, last_value(case when event_type = 'error' then event_id end ignore nulls) over (partition by user_id order by event_id rows between 25 preceding and current row) as near_error from events")
def look_back_error(t: Tables):  # W11
    marker = F.when(F.col("event_type") == "error", F.col("event_id"))
    return W.look_back(t.events, "user_id", "event_id", marker, 25, "near_error").select("user_id", "event_id", "near_error")


@query("next_bound_events", "select user_id, event_id, lead(event_id) over (partition by user_id order by event_id) as until from events")
def next_bound_events(t: Tables):  # W13
    return W.next_bound(t.events, "user_id", "event_id", "until").select("user_id", "event_id", "until")


@query("context_before", "select user_id, event_id, coalesce(string_agg(event_type, ',' order by event_id) over (partition by user_id order by event_id rows between 3 preceding and 1 preceding), '') as before from events")
def context_before(t: Tables):  # W12
    return W.rows_before(t.events, "user_id", "event_id", "event_type", 3, "b").select("user_id", "event_id", F.array_join("b", ",").alias("before"))


@query("last_write", "select user_id, max(event_id) as event_id, arg_max(event_type, event_id) as event_type from events group by 1")
def last_write(t: Tables):  # W14
    return W.last_write_wins(t.events.select("user_id", "event_id", "event_type"), "user_id", "event_id")


@query("shard_rows", "select doc_id, cast((row_number() over (order by doc_id) - 1) % 7 as int) as shard from documents")
def shard_rows(t: Tables):  # W9
    return W.shard(t.documents.select("doc_id"), ["doc_id"], 7)


@query("batch_ids", "select doc_id, cast(floor((row_number() over (order by doc_id) - 1) / 8) as int) as batch from documents")
def batch_ids(t: Tables):  # W10
    return W.batches(t.documents.select("doc_id"), ["doc_id"], 8)


@query("breadth_first_pick", "select source, doc_id, cast(row_number() over (partition by source order by n_chars desc, doc_id) as int) as turn from documents")
def breadth_first_pick(t: Tables):  # W6
    return W.round_robin(t.documents.select("source", "doc_id", "n_chars"), "source", [F.col("n_chars").desc(), "doc_id"]).select("source", "doc_id", "turn")


@query(
    "nearest_source_asof",
    """
    select p.event_id, p.user_id, arg_max(v.event_id, (v.ts, v.event_id)) as view_id
    from (select * from events where event_type = 'purchase') p
    left join (select * from events where event_type = 'view') v on v.user_id = p.user_id and v.ts <= p.ts group by 1, 2
    """,
)
def nearest_source_asof(t: Tables):  # J6
    e = timed(t)
    buys = e.filter("event_type = 'purchase'").select("event_id", "user_id", "at")
    views = e.filter("event_type = 'view'").select("user_id", "at", F.col("event_id").alias("view_id"))
    return P.as_of(buys, views, "user_id", "at", ["view_id"], tie="view_id").select("event_id", "user_id", "view_id")


@query(
    "innermost_interval",
    """
    with s as (select o_custkey as k, o_orderdate as a, o_orderdate + interval 400 day as z, o_orderkey from orders)
    select e.event_id, e.user_id, epoch_us(e.ts) as "at", arg_max(s.o_orderkey, (s.a, s.o_orderkey)) as enclosing
    from events e left join s on s.k = e.user_id and s.a <= e.ts and e.ts <= s.z group by 1, 2, 3
    """,
)
def innermost_interval(t: Tables):  # J4
    points = timed(t).select("event_id", "user_id", "at")
    start = F.unix_micros(F.col("o_orderdate").cast("timestamp"))
    spans = t.orders.select(F.col("o_custkey").alias("user_id"), start.alias("a"), (start + F.lit(400 * DAY_US)).alias("z"), "o_orderkey")
    return P.innermost(points, spans, "user_id", "at", "a", "z", "o_orderkey")


HOT = "case when event_id % 10 = 0 then cast(user_id as varchar) else 'hot' end"


@query(
    "hot_key_asof",
    f"""
    with e as (select *, {HOT} as k from events), b as (select * from e where event_type = 'purchase'), v as (select * from e where event_type = 'view')
    select b.event_id, v.event_id as view_id from b asof left join v on v.k = b.k and v.event_id <= b.event_id
    """,
)
def hot_key_asof(t: Tables):  # J6: nine rows in ten belong to one key
    e = t.events.withColumn("k", F.expr(HOT.replace("varchar", "string")))
    buys, views = e.filter("event_type = 'purchase'").select("event_id", "k"), e.filter("event_type = 'view'")
    return P.as_of(buys, views.select("k", "event_id", F.col("event_id").alias("view_id")), "k", "event_id", ["view_id"]).select("event_id", "view_id")


@query(
    "hot_key_innermost",
    f"""
    with e as (select event_id, {HOT} as k, event_type from events), s as (select k, event_id as a, event_id + case when event_id % 100 = 1 then 2000 else event_id % 30 end as z, event_id as n from e where event_type = 'click')
    select e.event_id, max(s.n) as enclosing from e left join s on s.k = e.k and e.event_id between s.a and s.z group by e.event_id
    """,
)
def hot_key_innermost(t: Tables):  # J4: points and overlapping spans of one key by the ten thousand
    e = t.events.withColumn("k", F.expr(HOT.replace("varchar", "string")))
    spans = e.filter("event_type = 'click'").select("k", F.col("event_id").alias("a"), F.expr("event_id + if(event_id % 100 = 1, 2000, event_id % 30)").alias("z"), F.col("event_id").alias("n"))
    return P.innermost(e.select("event_id", "k"), spans, "k", "event_id", "a", "z", "n").select("event_id", "enclosing")


@query(
    "range_join",
    """
    select o.o_orderkey, l.l_orderkey, l.l_linenumber from (select o_orderkey, o_custkey, o_orderkey as lo, o_orderkey + 20 as hi from orders) o
    join (select distinct l_orderkey, l_linenumber, l_suppkey from lineitem) l on l.l_suppkey = o.o_custkey and l.l_orderkey between lo and hi
    """,
)
def range_join(t: Tables):  # J7
    spans = t.orders.select("o_orderkey", F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("lo"), (F.col("o_orderkey") + 20).alias("hi"))
    at = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("k")).distinct()
    return P.in_range(spans, at, "k", "lo", "hi", "l_orderkey").select("o_orderkey", "l_orderkey", "l_linenumber")


@query("json_props", "select event_id, cast(json_extract(props, '$.k') as bigint) as k from events")
def json_props(t: Tables):  # S9
    return t.events.select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k"))


@query(
    "stateful_log_stream",
    """
    with e as (select cast(user_id as varchar) as ip, epoch_us(ts) // 1000 as ms, event_id as idx, event_type from events),
    m as (select *, 'request-burst' as kind, 7 as least from e union all select *, 'scan-behavior', 3 from e where event_type = 'click' union all select *, 'brute-force', 3 from e where event_type = 'error'),
    c as (select *, row_number() over (partition by ip, kind order by ms, idx) - count(*) over (partition by ip, kind order by ms range between unbounded preceding and 86400001 preceding) as n, min(ms) over (partition by ip, kind order by ms range between 86400000 preceding and current row) as oldest from m),
    f as (select ip, kind, ms, idx, oldest, least, row_number() over (partition by ip, kind order by ms, idx) as k from c where n >= least), t as (select * from f where k = 1),
    a as (select t.ip, 'recon-hit' as kind, min(e.ms) as ms from t join e on e.ip = t.ip and (e.ms, e.idx) > (t.ms, t.idx) where t.kind = 'scan-behavior' and e.event_type = 'view' group by 1
          union all select t.ip, 'credential-compromise', min(e.ms) from t join e on e.ip = t.ip and (e.ms, e.idx) > (t.ms, t.idx) where t.kind = 'brute-force' and e.event_type = 'purchase' group by 1)
    select ip, kind, ms, oldest, cast(least as bigint) as n from t union all select ip, kind, ms, ms, 1 from a
    """,
)
def stateful_log_stream(t: Tables):
    """The events table as a stream that ends when it has been read; alerts are written to the shared folder."""
    import uuid

    from wardenflow.storage import shared_dir
    from wardenflow.streaming.log_stream import ALERT, alerts

    folder = f"{shared_dir(t.spark)}/stream-{uuid.uuid4().hex}"
    rows = t.spark.readStream.schema(t.events.schema).option("pathGlobFilter", "events.parquet").parquet(t.sf_dir)
    kind = F.col("event_type")
    rows = rows.select(F.col("user_id").cast("string").alias("ip"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), F.col("event_id").alias("idx"), (kind == "error").alias("failed"), (kind == "purchase").alias("success"), (kind == "click").alias("error"), (kind == "view").alias("hit"))
    run = alerts(rows, window_s=86_400, failures=3, errors=3, requests=6).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    return t.spark.read.schema(ALERT).parquet(f"{folder}/out")


DELIVERED_SQL = """
    with x as (select event_id, user_id, event_type, epoch_us(ts) as us from events), n as (select count(*) as n, min(event_id) as first from x),
    b as (select x.*, (event_id - first) * 6 // n as turn from x, n),
    d as (select event_id, user_id, event_type, case when turn >= 4 and event_id % 50 = 0 then 5 when event_id % 40 = 7 and turn > 0 then turn + 1 else turn end as batch, case when turn >= 4 and event_id % 50 = 0 then us - 20 * 86400000000 else us end as us from b),
    m as (select batch, max(us) // 1000 * 1000 - 86400000000 as mark from d group by batch),
    l as (select d.*, us // 1000 as ms, exists (select 1 from m where m.batch < d.batch - 1 and d.us <= m.mark) as late from d)
"""


@query(
    "stream_in_time_order",
    DELIVERED_SQL
    + """,
    k as (select * from l where not late and ms // 3600000 < (select max(ms) - 86400000 from l) // 3600000),
    e as (select cast(user_id as varchar) as ip, ms, event_id as idx, event_type from k),
    r as (select *, 'request-burst' as kind, 7 as least from e union all select *, 'scan-behavior', 3 from e where event_type = 'click' union all select *, 'brute-force', 3 from e where event_type = 'error'),
    c as (select *, row_number() over (partition by ip, kind order by ms, idx) - count(*) over (partition by ip, kind order by ms range between unbounded preceding and 86400001 preceding) as n, min(ms) over (partition by ip, kind order by ms range between 86400000 preceding and current row) as oldest from r),
    f as (select ip, kind, ms, idx, oldest, least, row_number() over (partition by ip, kind order by ms, idx) as k from c where n >= least), t as (select * from f where k = 1),
    a as (select t.ip, 'recon-hit' as kind, min(e.ms) as ms from t join e on e.ip = t.ip and (e.ms, e.idx) > (t.ms, t.idx) where t.kind = 'scan-behavior' and e.event_type = 'view' group by 1
          union all select t.ip, 'credential-compromise', min(e.ms) from t join e on e.ip = t.ip and (e.ms, e.idx) > (t.ms, t.idx) where t.kind = 'brute-force' and e.event_type = 'purchase' group by 1),
    o as (select ip, kind, ms, oldest, cast(least as bigint) as n from t union all select ip, kind, ms, ms, 1 from a)
    select o.*, (select count(*) from l where late) as late from o
    """,
)
def stream_in_time_order(t: Tables):  # 2.11: six micro-batches, some rows a batch late, some weeks late
    import uuid

    from wardenflow.storage import shared_dir
    from wardenflow.streaming import behaviour as B

    n, first = t.events.agg(F.count(F.lit(1)), F.min("event_id")).first()
    turn = F.floor((F.col("event_id") - first) * 6 / F.lit(max(n, 1))).cast("int")
    stray = (turn >= 4) & (F.col("event_id") % 50 == 0)
    turn_ = F.when(stray, 5).when((F.col("event_id") % 40 == 7) & (turn > 0), turn + 1).otherwise(turn)
    at = F.when(stray, F.col("ts").cast("timestamp") - F.expr("interval 20 days")).otherwise(F.col("ts").cast("timestamp"))
    kind = F.col("event_type")
    rows = t.events.select(F.col("user_id").cast("string").alias("ip"), at.alias("at"), F.col("event_id").alias("idx"), (kind == "error").alias("failed"), (kind == "purchase").alias("success"), (kind == "click").alias("error"), (kind == "view").alias("hit"), turn_.alias("turn"))
    folder = f"{shared_dir(t.spark)}/delivered-{uuid.uuid4().hex}"
    for k in range(7):  # a file for each micro-batch, in the order of their writing; read and picked out by many tasks, written by one
        rows.filter(F.col("turn") == k).drop("turn").repartition(1).write.parquet(f"{folder}/{k}")
    kept = {k: t.spark.conf.get(k, None) for k in B.STORE}
    for k, v in B.STORE.items():
        t.spark.conf.set(k, v)
    try:
        stream = t.spark.readStream.schema(rows.drop("turn").schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)
        run = B.run_to_end(B.alerts_in_time(stream, delay="1 day", window_s=86_400, failures=3, errors=3, requests=6, bucket_s=3600))
    finally:
        for k, v in kept.items():
            t.spark.conf.unset(k) if v is None else t.spark.conf.set(k, v)
    return t.spark.read.schema(B.ALERT).parquet(f"{run.folder}/out").withColumn("late", F.lit(run.late).cast("long"))


@query("time_parsing", "select event_id, epoch_us(ts) // 1000 as ms, epoch_us(date_trunc('second', ts)) // 1000 as access_ms from events")
def time_parsing(t: Tables):  # X9: ISO times and those of access logs
    at = F.col("ts").cast("timestamp")
    iso, access = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), F.concat(F.date_format(at, "dd/MMM/yyyy:HH:mm:ss"), F.lit(" +0000"))
    return t.events.select("event_id", X.epoch_ms(iso).alias("ms"), X.epoch_ms(access).alias("access_ms"))


@query("lines_around", "select distinct s.l_orderkey as file, s.l_linenumber as line, l.l_linenumber as near_line from lineitem s join lineitem l on l.l_orderkey = s.l_orderkey and l.l_linenumber between s.l_linenumber - 2 and s.l_linenumber where s.l_returnflag = 'R'")
def lines_around(t: Tables):  # J23
    lines = t.lineitem.select(F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("line"), "l_returnflag")
    steps = lines.filter("l_returnflag = 'R'").select("file", "line").distinct()
    return P.lines_around(steps, lines.select("file", "line"), 2).select("file", "line", "near_line").distinct()
