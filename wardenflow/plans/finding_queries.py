"""The algebra of findings over orders, lineitem, documents and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardenflow.functions import scalar as X
from wardenflow.operators import findings as N
from wardenflow.operators import fold as D
from wardenflow.plans.registry import Tables, query

SEVERITY_SQL = "case o_orderpriority when '1-URGENT' then 'critical' when '2-HIGH' then 'high' when '3-MEDIUM' then 'medium' when '4-NOT SPECIFIED' then 'low' else 'info' end"
WEIGHT_SQL = "case severity when 'critical' then cast(1.0 as double) when 'high' then cast(0.8 as double) when 'medium' then cast(0.5 as double) when 'low' then cast(0.25 as double) else cast(0.1 as double) end"
D_ = "cast({} as double)"


def severity():
    p = F.col("o_orderpriority")
    return F.when(p == "1-URGENT", "critical").when(p == "2-HIGH", "high").when(p == "3-MEDIUM", "medium").when(p == "4-NOT SPECIFIED", "low").otherwise("info")


SCORED_SQL = f"""
    s as (
        select o_orderkey, {SEVERITY_SQL} as severity, e.epss, coalesce(e.kev, false) as kev, o_orderstatus
        from orders left join (select l_orderkey, max(l_discount) * 10 as epss, bool_or(l_returnflag = 'R' and l_quantity >= 49) as kev from lineitem group by 1) e on e.l_orderkey = o_orderkey
    ), r as (
        select *, least(greatest(coalesce(epss, cast(0 as double)), cast(0 as double)), cast(1 as double)) as e, {WEIGHT_SQL} as w from s
    ), q as (
        select *, cast(least(greatest(case when kev then greatest(floor(cast(100 as double) * (cast(0.6 as double) * w + cast(0.4 as double) * e) + cast(0.5 as double)), 95) else floor(cast(100 as double) * (cast(0.6 as double) * w + cast(0.4 as double) * e) + cast(0.5 as double)) end, 0), 100) as int) as risk from r
    )
"""


def scored(t: Tables):
    facts = t.lineitem.groupBy("l_orderkey").agg((F.max("l_discount") * 10).alias("epss"), F.bool_or((F.col("l_returnflag") == "R") & (F.col("l_quantity") >= 49)).alias("kev"))
    o = t.orders.withColumn("severity", severity()).join(facts, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return o.select("o_orderkey", "severity", "epss", F.coalesce("kev", F.lit(False)).alias("kev"), "o_orderstatus").withColumn("risk", X.risk_score(F.col("severity"), F.col("epss"), F.col("kev")))


@query("risk_score", f"with {SCORED_SQL} select o_orderkey, severity, kev, risk from q")
def risk_score(t: Tables):  # X6, J10
    return scored(t).select("o_orderkey", "severity", "kev", "risk")


@query(
    "risk_score_deployment",
    f"""
    with s as (select c_custkey, case when c_acctbal < 0 then 'critical' when c_acctbal < 5000 then 'medium' else 'low' end as severity, case c_mktsegment when 'BUILDING' then cast(1.0 as double) when 'MACHINERY' then cast(0.6 as double) when 'FURNITURE' then cast(0.3 as double) end as x from customer),
    w as (select *, {WEIGHT_SQL} as w from s),
    b as (select *, floor(cast(100 as double) * case when x is null then cast(0.6 as double) * w + cast(0.4 as double) * cast(0 as double) else cast(0.4 as double) * w + cast(0.25 as double) * cast(0 as double) + cast(0.2 as double) * x + cast(0.15 as double) * cast(0.6 as double) end + cast(0.5 as double)) as score from w)
    select c_custkey, cast(least(greatest(floor(score * cast(0.7 as double) + cast(0.5 as double)), 0), 100) as int) as risk from b
    """,
)
def risk_score_deployment(t: Tables):  # X6 with exposure and reachability
    s = F.when(F.col("c_acctbal") < 0, "critical").when(F.col("c_acctbal") < 5000, "medium").otherwise("low")
    exposure = F.when(F.col("c_mktsegment") == "BUILDING", "internet-facing").when(F.col("c_mktsegment") == "MACHINERY", "internal").when(F.col("c_mktsegment") == "FURNITURE", "build-time")
    return t.customer.select("c_custkey", X.risk_score(s, F.lit(0.0), F.lit(False), exposure, None, F.lit("unproven")).alias("risk"))


@query(
    "cvss_base",
    """
    with m as (
        select p_partkey, ['N','A','L','P'][p_size % 4 + 1] as av, ['L','H'][p_size % 2 + 1] as ac, ['N','L','H'][p_partkey % 3 + 1] as pr, ['N','R'][p_partkey % 2 + 1] as ui,
            ['U','C'][(p_size + p_partkey) % 2 + 1] as s, ['H','L','N'][p_size % 3 + 1] as c, ['H','L','N'][(p_partkey + 1) % 3 + 1] as i, ['H','L','N'][(p_size + p_partkey) % 3 + 1] as a from part
    ), v as (
        select p_partkey, s,
            case av when 'N' then cast(0.85 as double) when 'A' then cast(0.62 as double) when 'L' then cast(0.55 as double) else cast(0.2 as double) end as av,
            case ac when 'L' then cast(0.77 as double) else cast(0.44 as double) end as ac, case ui when 'N' then cast(0.85 as double) else cast(0.62 as double) end as ui,
            case when s = 'C' then case pr when 'N' then cast(0.85 as double) when 'L' then cast(0.68 as double) else cast(0.5 as double) end else case pr when 'N' then cast(0.85 as double) when 'L' then cast(0.62 as double) else cast(0.27 as double) end end as pr,
            case c when 'H' then cast(0.56 as double) when 'L' then cast(0.22 as double) else cast(0 as double) end as c,
            case i when 'H' then cast(0.56 as double) when 'L' then cast(0.22 as double) else cast(0 as double) end as i,
            case a when 'H' then cast(0.56 as double) when 'L' then cast(0.22 as double) else cast(0 as double) end as a from m
    ), w as (select *, 1 - (1 - c) * (1 - i) * (1 - a) as iss, cast(8.22 as double) * av * ac * pr * ui as exploit from v),
    x as (select *, case when s = 'C' then cast(7.52 as double) * (iss - cast(0.029 as double)) - cast(3.25 as double) * pow(iss - cast(0.02 as double), 15) else cast(6.42 as double) * iss end as impact from w)
    select p_partkey, case when impact <= 0 then 0 else ceil(least(case when s = 'C' then cast(1.08 as double) * (impact + exploit) else impact + exploit end, 10) * 10) / cast(10 as double) end as score from x
    """,
)
def cvss_base(t: Tables):  # X8
    size, key = F.col("p_size"), F.col("p_partkey")
    pick = lambda letters, n: F.get(F.array(*[F.lit(c) for c in letters]), n.cast("int"))
    parts = {"AV": pick("NALP", size % 4), "AC": pick("LH", size % 2), "PR": pick("NLH", key % 3), "UI": pick("NR", key % 2), "S": pick("UC", (size + key) % 2), "C": pick("HLN", size % 3), "I": pick("HLN", (key + 1) % 3), "A": pick("HLN", (size + key) % 3)}
    vector = F.concat(F.lit("CVSS:3.1"), *[F.concat(F.lit(f"/{k}:"), v) for k, v in parts.items()])
    return t.part.select("p_partkey", X.cvss_base_score(vector).alias("score"))


@query(
    "canonical_rank_topk",
    f"with {SCORED_SQL} select o_orderkey, o_orderstatus, severity, risk from q order by case o_orderstatus when 'F' then 0 when 'P' then 1 when 'O' then 2 else 3 end, risk desc, case severity when 'critical' then 0 when 'high' then 1 when 'medium' then 2 when 'low' then 3 else 4 end, cast(o_orderkey as varchar) limit 100",
)
def canonical_rank_topk(t: Tables):  # T1, T4
    s = F.col("o_orderstatus")
    status = F.when(s == "F", "confirmed").when(s == "P", "needs-human").when(s == "O", "open").otherwise("dismissed")
    rows = scored(t).withColumns({"status": status, "id": F.col("o_orderkey").cast("string")})
    return N.ranked(rows, 100).select("o_orderkey", "o_orderstatus", "severity", "risk")


@query(
    "correlate_merge",
    """
    with f as (
        select l_partkey, l_linestatus, l_shipmode_ as tool, severity, id from (
            select l_partkey, l_linestatus, 'tool-' || (l_suppkey % 3) as l_shipmode_, case when l_quantity >= 45 then 'high' when l_quantity >= 20 then 'medium' else 'low' end as severity,
                lpad(cast(l_orderkey as varchar), 12, '0') || '-' || l_linenumber || '-' || l_suppkey as id from lineitem)
    )
    select l_partkey, l_linestatus, count(*) as members, arg_min(id, (case severity when 'high' then 1 when 'medium' then 2 else 3 end, id)) as id,
        case min(case severity when 'high' then 1 when 'medium' then 2 else 3 end) when 1 then 'high' when 2 then 'medium' else 'low' end as severity,
        array_to_string(list_sort(list_distinct(list(tool))), ',') as sources, case when count(distinct tool) >= 2 then 'high' else 'medium' end as confidence
    from f group by 1, 2
    """,
)
def correlate_merge(t: Tables):  # A1
    q = F.col("l_quantity")
    rows = t.lineitem.select(
        F.concat_ws("-", F.lpad(F.col("l_orderkey").cast("string"), 12, "0"), "l_linenumber", "l_suppkey").alias("id"),
        F.lit("sast").alias("category"),
        F.col("l_linestatus").alias("title"),
        F.when(q >= 45, "high").when(q >= 20, "medium").otherwise("low").alias("severity"),
        F.concat(F.lit("tool-"), F.col("l_suppkey") % 3).alias("tool"),
        F.col("l_partkey").cast("string").alias("file"),
        F.lit(1).alias("line"),
    )
    merged = N.merge_clusters(N.conform(rows).withColumn("cluster", N.corroboration_key()), "cluster")
    return merged.select(F.col("file").cast("long").alias("l_partkey"), F.col("title").alias("l_linestatus"), "members", "id", "severity", F.array_join("sources", ",").alias("sources"), "confidence")


@query("feed_enrich_left", "select o_orderkey, c_name, n_name from orders left join customer on c_custkey = o_custkey and c_acctbal > 0 left join nation on n_nationkey = c_nationkey")
def feed_enrich_left(t: Tables):  # J10
    rich = t.customer.filter("c_acctbal > 0")
    return t.orders.join(rich, F.col("o_custkey") == F.col("c_custkey"), "left").join(t.nation, F.col("n_nationkey") == F.col("c_nationkey"), "left").select("o_orderkey", "c_name", "n_name")


FOLD_FINDINGS_SQL = "select cast(doc_id as varchar) as id, case when n_chars > 3000 then 'high' when n_chars > 1000 then 'medium' else 'low' end as severity, 'open' as status from documents"
FOLD_VERDICTS_SQL = "select cast(doc_id as varchar) as id, case when quality = 1 and toxic = 0 then 'supported' when quality = 1 then 'partial' when toxic = 1 then 'refuted' else 'unsupported' end as verdict from labels"


def fold_findings(t: Tables):
    n = F.col("n_chars")
    return N.conform(t.documents.select(F.col("doc_id").cast("string").alias("id"), F.lit("sast").alias("category"), F.lit("document").alias("title"), F.when(n > 3000, "high").when(n > 1000, "medium").otherwise("low").alias("severity"), F.lit("m").alias("message"), F.lit("engine").alias("tool")))


def fold_verdicts(t: Tables):
    q, x = F.col("quality"), F.col("toxic")
    v = F.when((q == 1) & (x == 0), "supported").when(q == 1, "partial").when(x == 1, "refuted").otherwise("unsupported")
    return t.labels.select(F.col("doc_id").cast("string").alias("id"), v.alias("verdict"), F.col("doc_id").alias("pos"), F.lit("seen").alias("note"), F.lit(None).cast("string").alias("exploit_path"), F.lit(None).cast("string").alias("brocard"))


FOLDED_SQL = f"""
    f as ({FOLD_FINDINGS_SQL}), v as ({FOLD_VERDICTS_SQL}), folded as (
        select f.id, f.severity, v.verdict, case when v.id is null then f.status when v.verdict = 'supported' then 'confirmed' when v.verdict = 'refuted' then 'dismissed'
            when v.verdict = 'unsupported' then case when f.severity = 'high' then 'needs-human' else 'dismissed' end else 'needs-human' end as status,
            case when v.verdict = 'supported' then 'high' else 'medium' end as confidence,
            'm' || case when v.id is not null then chr(10) || chr(10) || 'Verdict (' || v.verdict || '): seen' else '' end as message
        from f left join v on v.id = f.id
    )
"""


@query("verdict_fold", f"with {FOLDED_SQL} select * from folded")
def verdict_fold(t: Tables):  # J13, L2, X13, X14
    return D.apply_verdicts(fold_findings(t), fold_verdicts(t)).select("id", "severity", "verdict", "status", "confidence", "message")


@query("triage_fold", f"with f as ({FOLD_FINDINGS_SQL}), l as (select cast(doc_id as varchar) as id, toxic from labels) select f.id, case when l.toxic = 0 and severity <> 'high' then 'dismissed' else status end as status from f left join l on l.id = f.id")
def triage_fold(t: Tables):  # L1
    rows = t.labels.select(F.col("doc_id").cast("string").alias("id"), F.when(F.col("toxic") == 0, "noise").otherwise("keep").alias("verdict"), F.col("doc_id").alias("pos"))
    return D.apply_triage(fold_findings(t), rows).select("id", "status")


@query(
    "merge_runs",
    f"""
    with {FOLDED_SQL}, b as (select *, cast(id as bigint) as n from folded where cast(id as bigint) < (select max(doc_id) / 2 from documents)), a as (select *, cast(id as bigint) as n from f where cast(id as bigint) >= (select max(doc_id) / 4 from documents))
    select coalesce(a.id, b.id) as id, case when a.id is null or (b.id is not null and b.status <> 'open') then b.status else a.status end as status,
        case when a.id is null or (b.id is not null and b.status <> 'open') then b.verdict end as verdict from a full join b on a.id = b.id
    """,
)
def merge_runs(t: Tables):  # J22
    most = t.documents.agg(F.max("doc_id")).first()[0]
    first = D.apply_verdicts(fold_findings(t), fold_verdicts(t))
    n = F.col("id").cast("long")
    return D.merge_runs(first.filter(n < most / 2), fold_findings(t).filter(n >= most / 4)).select("id", "status", "verdict")


@query("stale_ids", "select distinct cast(event_id as varchar) as id from events where event_id not in (select doc_id from documents)")
def stale_ids(t: Tables):  # U6
    return D.unknown_ids(t.events.select(F.col("event_id").cast("string").alias("id")), fold_findings(t))


@query("worklist_counts", f"with {FOLDED_SQL} select count(*) filter (where status = 'open' or (status = 'needs-human' and verdict is null)) as fresh, 0 as re_opened, count(*) filter (where status = 'needs-human' and verdict is not null) as withheld from folded")
def worklist_counts(t: Tables):  # A15
    return D.worklist_counts(D.apply_verdicts(fold_findings(t), fold_verdicts(t)))


@query("check_citations", "select cast(d.doc_id as varchar) as id, d.source as file, cast(d.n_chars as int) as line, case when f.source is null then 'no such file' when d.n_chars > f.n_lines then 'no such line' end as problem from documents d left join (select source, count(*) * 40 as n_lines from documents where source <> 'src3' group by 1) f on f.source = d.source where f.source is null or d.n_chars > f.n_lines")
def check_citations(t: Tables):  # F25
    files = t.documents.filter("source <> 'src3'").groupBy(F.col("source").alias("file")).agg((F.count(F.lit(1)) * 40).alias("n_lines"))
    rows = t.documents.select(F.col("doc_id").cast("string").alias("id"), F.lit("open").alias("status"), F.col("source").alias("file"), F.col("n_chars").cast("int").alias("line"))
    return D.check_citations(rows, files)


@query("severity_counts", f"with {FOLDED_SQL} select count(*) filter (where severity = 'critical') as critical, count(*) filter (where severity = 'high') as high, count(*) filter (where severity = 'medium') as medium, count(*) filter (where severity = 'low') as low, count(*) filter (where severity = 'info') as info from folded")
def severity_counts(t: Tables):  # A2
    return N.severity_counts(fold_findings(t))


@query(
    "family_group",
    """
    with p as (select page_id, regexp_replace(url, '^[a-z]+://', '') as file from pages), k as (
        select page_id, 'page :: ' || case when len(string_split(file, '/')) <= 1 then '.' else array_to_string(string_split(file, '/')[1:least(2, len(string_split(file, '/')) - 1)], '/') end || ' :: ' as family from p
    ), g as (select family, count(*) as members, arg_min(page_id, cast(page_id as varchar)) as lead from k group by 1 having count(*) >= 3)
    select page_id, g.family, members, lead from k left join g on g.family = k.family
    """,
)
def family_group(t: Tables):  # A9, X12
    rows = t.pages.select(F.col("page_id").cast("string").alias("id"), F.lit("page").alias("title"), F.lit("low").alias("severity"), F.lit("m").alias("message"), F.regexp_replace("url", "^[a-z]+://", "").alias("file"), F.lit(None).cast("int").alias("risk"))
    return N.families(rows).select(F.col("id").cast("long").alias("page_id"), "family", "members", F.col("lead").cast("long").alias("lead"))


@query(
    "coverage_matrix",
    """
    with s(code, kinds) as (values ('A1', ['click', 'view']), ('A2', ['error']), ('A3', ['login']), ('A4', ['logout', 'upload'])), k as (select code, unnest(kinds) as k from s),
    h as (select code, count(distinct event_id) as hits from k join events on event_type = k group by 1), l as (select distinct code from k where k in ('login'))
    select s.code, coalesce(hits, 0) as hits, case when coalesce(hits, 0) > 0 then 'examined' when l.code is not null then 'engine' else 'unexamined' end as state from s left join h on h.code = s.code left join l on l.code = s.code
    """,
)
def coverage_matrix(t: Tables):  # A14, J17
    standard = t.spark.createDataFrame([("A1", ["click", "view"]), ("A2", ["error"]), ("A3", ["login"]), ("A4", ["logout", "upload"])], "code string, kinds array<string>")
    found = t.events.select(F.col("event_id").alias("id"), F.col("event_type").alias("category"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("cwe"))
    return N.coverage(found, standard, t.spark.createDataFrame([("login",)], "kind string"))


@query(
    "variant_self_join",
    """
    with f as (select p_partkey, cast(p_partkey as varchar) as id, p_brand, p_size, p_type from part), s as (select * from f where p_size = 1),
    m as (select s.id as seed_id, f.id, f.p_partkey, case when s.p_brand = f.p_brand and s.p_size = f.p_size then 0 when s.p_type = f.p_type then 2 end as o from s join f on s.id <> f.id),
    r as (select *, row_number() over (partition by seed_id order by o, p_partkey) as k from m where o is not null)
    select seed_id, id, case o when 0 then 'same-callee' else 'same-cwe' end as axis from r where k <= 25
    """,
)
def variant_self_join(t: Tables):  # J16
    rows = t.part.select(F.col("p_partkey").cast("string").alias("id"), F.col("p_brand").alias("title"), F.col("p_size").cast("string").alias("kind"), F.lpad(F.col("p_partkey").cast("string"), 12, "0").alias("file"), F.lit(1).alias("line"), F.col("p_type").alias("cwe"), F.when(F.col("p_size") == 1, "confirmed").otherwise("open").alias("status"))
    return N.variants(rows).select("seed_id", "id", "axis")


@query("spearman_calibration", "with r as (select avg(a) over (partition by l_extendedprice) as ra, avg(b) over (partition by l_quantity) as rb from (select l_extendedprice, l_quantity, row_number() over (order by l_extendedprice) as a, row_number() over (order by l_quantity) as b from lineitem)) select round(corr(ra, rb), 6) as rho, count(*) as n from r")
def spearman_calibration(t: Tables):  # A23
    return N.spearman(t.lineitem, "l_extendedprice", "l_quantity").select(F.round("rho", 6).alias("rho"), "n")


@query(
    "scorecard",
    """
    with c as (select 'CWE-' || (l.doc_id % 3) as cwe, l.toxic = 1 as vulnerable, d.n_chars > 1500 as flagged from labels l join documents d on d.doc_id = l.doc_id),
    n as (select cwe, count(*) filter (where vulnerable and flagged) as tp, count(*) filter (where vulnerable and not flagged) as fn, count(*) filter (where not vulnerable and flagged) as fp, count(*) filter (where not vulnerable and not flagged) as tn from c group by 1)
    select cwe, tp, fn, fp, tn, round(tp / (tp + fn), 6) as tpr, round(fp / (fp + tn), 6) as fpr, round(2 * tp / (2 * tp + fp + fn), 6) as f1 from n
    """,
)
def scorecard(t: Tables):  # A22
    cases = t.labels.join(t.documents, "doc_id").select(F.concat(F.lit("CWE-"), F.col("doc_id") % 3).alias("cwe"), (F.col("toxic") == 1).alias("vulnerable"), (F.col("n_chars") > 1500).alias("flagged"))
    return N.scorecard(cases).select("cwe", "tp", "fn", "fp", "tn", *[F.round(c, 6).alias(c) for c in ("tpr", "fpr", "f1")])


@query("root_causes", "select p_brand as category, p_type as cwe, count(*) as members, array_to_string(list_sort(list(cast(p_partkey as varchar))), ',') as ids from part where p_size <= 10 group by 1, 2")
def root_causes(t: Tables):  # A17
    rows = t.part.select(F.col("p_partkey").cast("string").alias("id"), F.col("p_brand").alias("category"), F.col("p_type").alias("cwe"), F.when(F.col("p_size") <= 10, "confirmed").otherwise("open").alias("status"))
    return N.root_causes(rows).withColumn("ids", F.array_join("ids", ","))


@query("guard_totals", "select count(*) as handlers, count(*) filter (where lang <> 'en') as unguarded, count(*) filter (where n_chars < 100) as file_scoped, count(*) >= 3 and bool_and(lang <> 'en') as no_auth_anywhere from documents")
def guard_totals(t: Tables):  # A13
    return N.guard_totals(t.documents.select((F.col("lang") == "en").alias("guarded"), (F.col("n_chars") < 100).alias("file_scoped")))


@query("grounded_entries", "select p_brand || '/' || p_type as entry from part group by p_brand, p_type having bool_and(p_size <= 45)")
def grounded_entries(t: Tables):  # J18
    entry = F.concat_ws("/", "p_brand", "p_type")
    entries = t.part.groupBy(entry.alias("entry")).agg(F.collect_list(F.col("p_partkey").cast("string")).alias("ids"))
    known = t.part.select(F.col("p_partkey").cast("string").alias("id"), F.when(F.col("p_size") <= 45, "confirmed").otherwise("open").alias("status"))
    return D.grounded(entries, known).select("entry")


@query(
    "reconcile_reviews",
    f"with f as ({FOLD_FINDINGS_SQL}), l as (select cast(doc_id as varchar) as id, case when toxic = 1 then 'dismissed' else 'open' end as status from labels) select f.id, case when f.severity = 'high' and l.status is not null and l.status <> f.status then 'needs-human' else f.status end as status from f left join l on l.id = f.id",
)
def reconcile_reviews(t: Tables):  # J21
    second = t.labels.select(F.col("doc_id").cast("string").alias("id"), F.when(F.col("toxic") == 1, "dismissed").otherwise("open").alias("status"))
    return D.reconcile(fold_findings(t), second).select("id", "status")


@query("tool_status", "select cast(s_suppkey as varchar) as tool, case when s_nationkey < 5 then 'skipped' when s_acctbal < 0 then 'failed' when s_nationkey % 3 = 0 then 'empty' else 'ran' end as status from supplier")
def tool_status(t: Tables):  # A16
    runs = t.supplier.select(F.col("s_suppkey").cast("string").alias("tool"), (F.col("s_nationkey") >= 5).alias("applicable"), (F.col("s_acctbal") >= 0).alias("exit_ok"), (F.col("s_nationkey") % 3).alias("findings"))
    return N.tool_status(runs)
