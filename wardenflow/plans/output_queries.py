"""What runs leave behind, over findings, paths and scopes that the driver's tables spell out."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from wardenflow.operators import findings as N
from wardenflow.operators import fold as D
from wardenflow.operators import graph as G
from wardenflow.plans import run_outputs as O
from wardenflow.plans.registry import Tables, query
from wardenflow.sources import history as H
from wardenflow.storage import cut


@query(
    "index_of_findings",
    """
    with f as (select p_partkey as k, 'f' || lpad(cast(p_partkey as varchar), 8, '0') as id, ['critical', 'high', 'medium', 'low', 'info'][p_size % 5 + 1] as severity, case when p_partkey % 3 = 0 then 'trivy' else 'engine' end as tool,
        case p_partkey % 4 when 0 then 'confirmed' when 1 then 'open' when 2 then 'dismissed' else 'needs-human' end as status, case when p_partkey % 5 = 0 then p_size end as risk from part)
    select id, '### ' || id || ' — ' || severity || ' title ' || k || chr(10) || chr(10) || '- category: sast · CWE-' || (k % 90) || ' · confidence medium · status ' || status || case tool when 'trivy' then ' · via trivy' else '' end || coalesce(chr(10) || '- risk ' || risk, '') || chr(10) || '- at: `d' || (k % 50) || '/f.js:' || k || '`' || chr(10) || '- message ' || k || chr(10) as text from f
    """,
)
def index_of_findings(t: Tables):  # K4: an entry for each finding
    k = F.col("p_partkey")
    n = k.cast("string")
    rows = t.part.select(
        F.concat(F.lit("f"), F.lpad(n, 8, "0")).alias("id"), F.get(F.array(*[F.lit(s) for s in ("critical", "high", "medium", "low", "info")]), F.col("p_size") % 5).alias("severity"), F.when(k % 3 == 0, "trivy").otherwise("engine").alias("tool"),
        F.when(k % 4 == 0, "confirmed").when(k % 4 == 1, "open").when(k % 4 == 2, "dismissed").otherwise("needs-human").alias("status"), F.when(k % 5 == 0, F.col("p_size")).alias("risk"), F.lit("sast").alias("category"), F.concat(F.lit("CWE-"), k % 90).alias("cwe"),
        F.concat(F.lit("title "), n).alias("title"), F.concat(F.lit("message "), n).alias("message"), F.concat(F.lit("d"), k % 50, F.lit("/f.js")).alias("file"), k.cast("int").alias("line"),
    )
    lines = O.index_lines(N.conform(rows), "/repo")
    return lines.filter(F.col("text").startswith("### ")).select(F.regexp_extract("text", r"^### (\S+)", 1).alias("id"), "text")


@query(
    "evidence_packets",
    """
    with l as (select 'f' || (p_partkey % 40) as file, p_partkey // 40 as line, p_name as text from part), p as (select s_suppkey as k, 'f' || (s_suppkey % 40) as file, s_suppkey % 45 as line, 'f' || ((s_suppkey + 7) % 40) as source_file, s_suppkey % 31 as source_line from supplier),
    s as (select k, 0 as step, 'source' as role, source_file as file, source_line as line from p union all select k, 1, 'sink', file, line from p),
    e as (select 'f' || (n_nationkey % 40) as a, 'f' || ((n_nationkey * 3 + 1) % 40) as b from nation), n as (select file, string_agg(n, ',' order by n) as neighbours from (select a as file, b as n from e union select b, a from e) group by 1)
    select cast(k as varchar) as id, step, role, s.file, cast(l.line as int) as line, text, l.line = s.line as cited, coalesce(neighbours, '') as neighbours from s join l on l.file = s.file and l.line between s.line - 3 and s.line + 3 left join n on n.file = s.file
    """,
)
def evidence_packets(t: Tables):  # K11, J23
    name = lambda c: F.concat(F.lit("f"), c)
    k, n = F.col("s_suppkey"), F.col("n_nationkey")
    lines = t.part.select(name(F.col("p_partkey") % 40).alias("file"), F.floor(F.col("p_partkey") / 40).cast("int").alias("line"), F.col("p_name").alias("text"))
    hops = F.array(F.struct(name(k % 40).alias("file"), (k % 45).cast("int").alias("line")))
    paths = t.supplier.select(k.cast("string").alias("id"), hops.alias("hops"), name((k + 7) % 40).alias("source_file"), (k % 31).cast("int").alias("source_line"))
    edges = t.nation.select(name(n % 40).alias("from"), name((n * 3 + 1) % 40).alias("to"))
    return O.packets(paths, lines, edges).withColumn("neighbours", F.array_join("neighbours", ","))


@query("folded_category_names", "with p as (select ['SQL Injection', 'sast', 'idor', ' Secret ', 'weak_crypto', 'unheard of', 'dep'][p_partkey % 7 + 1] as raw from part) select raw, case raw when 'SQL Injection' then 'taint' when 'idor' then 'authz' else 'crypto' end as category, count(*) as n from p where raw in ('SQL Injection', 'idor', 'weak_crypto') group by 1")
def folded_category_names(t: Tables):  # X5
    names = F.array(*[F.lit(x) for x in ("SQL Injection", "sast", "idor", " Secret ", "weak_crypto", "unheard of", "dep")])
    return O.folded_categories(t.part.select(F.get(names, (F.col("p_partkey") % 7).cast("int")).alias("category")))


@query(
    "cover_of_scopes",
    """
    with s as (select distinct 'r' || (o_custkey % 97) || case when o_orderkey % 5 = 0 then '' when o_orderkey % 5 < 3 then '/d' || (o_orderkey % 11) else '/d' || (o_orderkey % 11) || '/e' || (o_orderkey % 7) end as scope from orders where o_custkey % 97 <> 5 or o_orderkey % 5 <> 0)
    select scope from s where not exists (select 1 from s x where starts_with(s.scope, x.scope || '/'))
    """,
)
def cover_of_scopes(t: Tables):  # L10
    k = F.col("o_orderkey")
    below = F.when(k % 5 == 0, F.lit("/")).when(k % 5 < 3, F.concat(F.lit("/d"), k % 11)).otherwise(F.concat(F.lit("/d"), k % 11, F.lit("/e"), k % 7))
    rows = t.orders.filter((F.col("o_custkey") % 97 != 5) | (k % 5 != 0)).select(F.concat(F.lit("r"), F.col("o_custkey") % 97, below).alias("scope"))
    return O.cover(rows)


@query(
    "followed_places",
    """
    with h as (select l_orderkey as k, l_linenumber as s, cast(sum(l_quantity) as int) as d from lineitem group by 1, 2), g as (select k, count(*) as commits, sum(d) as d, bool_or(s = 3) as has3 from h group by 1)
    select 'f' || o_orderkey as file, cast(o_custkey % 50 + 1 as int) as line, cast(o_custkey % 50 + 1 + coalesce(d, 0) as int) as now_line, cast(coalesce(commits, 0) as int) as commits, 0 as touched, case when o_orderkey % 3 = 0 and has3 then 'g' else 'f' end || o_orderkey as now
    from orders left join g on g.k = o_orderkey
    """,
)
def followed_places(t: Tables):  # S20-S22, X27: lines put in at the top of each file by each commit, some files renamed by the third
    k, s = F.col("l_orderkey"), F.col("l_linenumber")
    name = lambda letter: F.concat(F.lit(letter), k)
    hunks = t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.sum("l_quantity").cast("int").alias("new_n"))
    moved, third = k % 3 == 0, F.max((s == 3).cast("int")).over(Window.partitionBy("l_orderkey")) == 1
    hunks = hunks.withColumns({"old": F.when(moved & third & (s > 3), name("g")).otherwise(name("f")), "new": F.when(moved & third & (s >= 3), name("g")).otherwise(name("f"))})
    history = hunks.select(s.cast("int").alias("seq"), s.cast("string").alias("commit"), s.cast("long").alias("at"), F.lit("a").alias("author"), "old", "new", F.lit(0).alias("old_start"), F.lit(0).alias("old_n"), F.lit(1).alias("new_start"), "new_n")
    places = t.orders.select(F.concat(F.lit("f"), "o_orderkey").alias("file"), (F.col("o_custkey") % 50 + 1).cast("int").alias("line"))
    return H.follow(cut(history, "history"), places).select("file", "line", "now_line", "commits", "touched", "now")


@query(
    "assumption_leads",
    "with u as (select o_orderkey as pos, 'src/f' || o_custkey || '.js:' || (o_orderkey % 70) as \"at\", ['nothing-found', ' Nothing-Found ', 'src/x.js:4', null] as marks from orders where o_orderkey % 6 <> 0), e as (select pos, \"at\", unnest(range(1, 5)) as n, marks from u) select pos, cast(n - 1 as int) as turn, \"at\", 'claim ' || (pos % 10 + n) as claim from e where lower(trim(marks[(pos + n) % 4 + 1])) = 'nothing-found'",
)
def assumption_leads(t: Tables):  # L7
    k = F.col("o_orderkey")
    marks = F.array(F.lit("nothing-found"), F.lit(" Nothing-Found "), F.lit("src/x.js:4"), F.lit(None).cast("string"))
    claims = F.transform(F.sequence(F.lit(1), F.lit(4)), lambda n: F.struct(F.concat(F.lit("claim "), k % 10 + n).alias("claim"), F.get(marks, ((k + n) % 4).cast("int")).alias("enforced_at")))
    at = F.when(k % 6 != 0, F.concat(F.lit("src/f"), "o_custkey", F.lit(".js:"), k % 70)).otherwise(F.when(k % 12 == 0, F.lit("")))
    return D.unenforced(t.orders.select(k.alias("pos"), at.alias("at"), claims.alias("assumptions"))).select("pos", "turn", "at", "claim")


@query(
    "variants_folded",
    """
    with p as (select p_partkey as k, 'f' || (p_partkey % 50) || '.js' as file from part),
    d as (select k, case when k % 11 = 0 then 'no seed' when k % 7 = 0 then 'no title' when k % 5 = 0 then 'no line' end as reason, file from p)
    select k, case when reason is not null then reason when k % 50 >= 40 then 'rejected' when k % 50 < 10 then 'folded' else 'added' end as outcome from d
    """,
)
def variants_folded(t: Tables):  # L6, J14: each variant is dropped, rejected for its citation, folded into a known finding or added
    k = F.col("p_partkey")
    file = F.concat(F.lit("f"), k % 50, F.lit(".js"))
    v = F.struct(F.when(k % 7 != 0, F.concat(F.lit("t"), k)).alias("title"), F.lit("high").alias("severity"), F.lit("sast").alias("category"), file.alias("file"), F.when(k % 5 != 0, k.cast("int")).alias("line"), F.lit("CWE-1").alias("cwe"), F.lit("m").alias("message"))
    hunts = t.part.select(k.cast("long").alias("pos"), F.when(k % 11 != 0, F.concat(F.lit("seed"), k % 3)).alias("seed_id"), F.array(v).alias("variants"), F.lit(None).cast("string").alias("regression_rule"))
    known = N.conform(t.part.filter(k % 50 < 10).select(F.concat(F.lit("old"), k).alias("id"), F.lit("scanner").alias("tool"), F.lit("sast").alias("category"), F.lit("x").alias("title"), F.lit("low").alias("severity"), F.lit("m").alias("message"), file.alias("file"), k.cast("int").alias("line"), F.lit("CWE-1").alias("cwe")))
    files = t.part.filter(k % 50 < 40).select(file.alias("file")).distinct().withColumn("n_lines", F.lit(1 << 30))
    out, rejected, dropped = D.apply_variants(known, cut(hunts, "hunts"), files)
    told = out.filter(F.array_contains("sources", "variants")).select(F.col("line").cast("long").alias("k"), F.when(F.col("id").startswith("old"), "folded").otherwise("added").alias("outcome"))
    return told.unionByName(rejected.select(F.col("line").cast("long").alias("k"), F.lit("rejected").alias("outcome"))).unionByName(dropped.select(F.col("pos").alias("k"), F.col("reason").alias("outcome")))


@query(
    "checked_discoveries",
    """
    with p as (select p_partkey as k, p_partkey % 3 = 0 as a, p_partkey % 5 = 0 as b, p_partkey % 7 = 0 as c, p_partkey % 4 as d from part)
    select k as pos, case when a then 'title: not a text;' else '' end || case when b then 'line: not a whole number from 0;' else '' end || case when c then 'category: not known;' else '' end || case when d = 0 then 'severity: not known;' else '' end as errors,
        case when not c and d = 1 then 'SQL Injection' end as folded, case when c then 'no such' when d = 1 then 'taint' else 'sast' end as category, case when k % 2 = 0 then 1 end as steps from p
    """,
)
def checked_discoveries(t: Tables):  # L11, X5
    k = F.col("p_partkey")
    step = lambda file, line: F.struct(file.cast("string").alias("file"), line.cast("int").alias("line"), F.lit("").alias("why"))
    path = F.when(k % 2 == 0, F.array(step(F.lit("a.js"), F.lit(3)), step(F.lit(None), F.lit(1)), step(F.lit("b.js"), F.lit(0)))).otherwise(F.array(step(F.lit("b.js"), F.lit(0))))
    rows = t.part.select(
        k.alias("pos"), F.when(k % 3 != 0, "t").alias("title"), F.lit("m").alias("message"), F.lit("f.js").alias("file"), F.when(k % 5 != 0, 0).alias("line"), F.when(k % 7 == 0, "no such").when(k % 4 == 1, "SQL Injection").otherwise("sast").alias("category"),
        F.when(k % 4 == 0, "HIGH").otherwise("high").alias("severity"), F.lit(None).cast("string").alias("cwe"), path.alias("path"),
    )
    out = D.checked_discoveries(rows)
    return out.select("pos", F.concat_ws("", F.transform("errors", lambda e: F.concat(e, F.lit(";")))).alias("errors"), "folded", "category", F.nullif(F.size("path"), F.lit(-1)).alias("steps"))


@query("verdicts_given_again", "select 'i' || k as id, case when k % 5 = 0 then null when k % 3 = 1 then 'confirmed' else 'dismissed' end as was, v as verdict from (select o_orderkey as k, case when o_orderkey % 2 = 0 then 'supported' else 'refuted' end as v from orders) where k % 5 = 0 or (k % 3 = 1 and v = 'refuted') or (k % 3 = 2 and v = 'supported')")
def verdicts_given_again(t: Tables):  # L2, U6: rulings that would change, and ids that nothing has
    k = F.col("o_orderkey")
    ident = F.concat(F.lit("i"), k).alias("id")
    status = F.when(k % 3 == 0, "open").when(k % 3 == 1, "confirmed").otherwise("dismissed")
    known = t.orders.filter(k % 5 != 0).select(ident, status.alias("status"), F.lit("low").alias("severity"), F.lit(None).cast("string").alias("verdict"))
    early = t.orders.select(ident, F.lit(0).alias("pos"), F.lit("partial").alias("verdict"))
    late = t.orders.select(ident, F.lit(1).alias("pos"), F.when(k % 2 == 0, "supported").otherwise("refuted").alias("verdict"))
    return D.reverdicts(known, early.unionByName(late))


@query(
    "merged_graphs",
    """
    with a as (select 'a' || l_suppkey as f, 'b' || l_partkey as g, count(*) as w from lineitem where l_returnflag = 'A' group by all), r as (select 'a' || l_suppkey as f, 'b' || l_partkey as g, count(*) as w from lineitem where l_returnflag = 'R' group by all), u as (select * from a union all select * from r)
    select 'edge' as part, f || '>' || g as what, max(w) as weight from u group by all union all select distinct 'file', f, 0 from u union all select distinct 'def', g || '@' || g, 0 from u union all select distinct 'call', g || '<' || f, 0 from u
    """,
)
def merged_graphs(t: Tables):  # G5
    def part(flag: str):
        e = t.lineitem.filter(F.col("l_returnflag") == flag).select(F.concat(F.lit("a"), "l_suppkey").alias("from"), F.concat(F.lit("b"), "l_partkey").alias("to"))
        edges = e.groupBy("from", "to").agg(F.count(F.lit(1)).alias("weight")).withColumns({"kind": F.lit("call"), "to_symbol": F.col("to")})
        return {"files": e.select(F.col("from").alias("file")), "edges": edges, "defs": e.select(F.col("to").alias("name"), F.col("to").alias("file")), "callers": e.select(F.col("to").alias("callee"), F.col("from").alias("file"), F.lit(1).alias("line"), F.lit(None).cast("string").alias("symbol"))}

    g = G.merge_graphs(part("A"), part("R"))
    row = lambda df, name, what, weight=0: df.select(F.lit(name).alias("part"), what.alias("what"), F.lit(weight).cast("long").alias("weight") if weight == 0 else F.col("weight"))
    return N.union_all(row(g["edges"], "edge", F.concat("from", F.lit(">"), "to"), 1), row(g["files"], "file", F.col("file")), row(g["defs"], "def", F.concat("name", F.lit("@"), "file")), row(g["callers"], "call", F.concat("callee", F.lit("<"), "file")))
