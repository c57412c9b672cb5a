"""Graphs over the driver's tables: trade between nations, a small directed graph of nations, chains of orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardenflow.operators import graph as G
from wardenflow.operators import positional as P
from wardenflow.plans.registry import Tables, query

TRADE = """
    select s.s_nationkey as src, c.c_nationkey as dst, count(*) as weight
    from lineitem l join supplier s on s.s_suppkey = l.l_suppkey join orders o on o.o_orderkey = l.l_orderkey join customer c on c.c_custkey = o.o_custkey
    where s.s_nationkey <> c.c_nationkey group by 1, 2
"""


def trade(t: Tables, flag: str | None = None):
    lines = t.lineitem.filter(F.col("l_returnflag") == flag) if flag else t.lineitem
    sold = lines.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return sold.filter("s_nationkey <> c_nationkey").groupBy(F.col("s_nationkey").alias("src"), F.col("c_nationkey").alias("dst")).agg(F.count(F.lit(1)).alias("weight"))


@query("link_edges", TRADE)
def link_edges(t: Tables):  # J2
    return trade(t)


@query(
    "edge_merge",
    f"with e as ({TRADE.replace('where', 'where l_returnflag = $$A$$ and')} union all {TRADE.replace('where', 'where l_returnflag = $$R$$ and')}) select src, dst, max(weight) as weight from e group by 1, 2",
)
def edge_merge(t: Tables):  # G5
    return G.merge_edges(trade(t, "A"), trade(t, "R"), ["src", "dst"])


RING = "select n_nationkey as src, (n_nationkey * 3 + 1) % 25 as dst from nation union select n_nationkey, (n_nationkey + 10) % 25 from nation"


def ring(t: Tables):
    n = t.nation
    return n.select(F.col("n_nationkey").alias("src"), ((F.col("n_nationkey") * 3 + 1) % 25).alias("dst")).unionByName(n.select(F.col("n_nationkey").alias("src"), ((F.col("n_nationkey") + 10) % 25).alias("dst"))).distinct()


@query(
    "reverse_dependents",
    f"""
    with recursive e as ({RING}), w(node, depth) as (
        select n_nationkey, 0 from nation where n_regionkey = 0 union
        select e.src, w.depth + 1 from w join e on e.dst = w.node where w.depth < 3
    ) select node, min(depth) as depth from w group by 1
    """,
)
def reverse_dependents(t: Tables):  # G2, L12
    seeds = t.nation.filter("n_regionkey = 0").select(F.col("n_nationkey").alias("node"))
    return G.reverse_dependents(ring(t), seeds, 3)


@query(
    "neighbours_bfs",
    f"""
    with recursive e as ({RING}), b as (select src as p, dst as node, 0 as o from e union all select dst, src, 1 from e), w(node, depth) as (
        select 0, 0 union select b.node, w.depth + 1 from w join b on b.p = w.node where w.depth < 3
    ), d as (select node, min(depth) as depth from w group by 1),
    v as (select d.node, d.depth, min((b.p, b.o)) as x from d join b on b.node = d.node join d q on q.node = b.p and q.depth = d.depth - 1 group by 1, 2)
    select 0 as node, 0 as depth, null::int as via, null::varchar as direction
    union all select node, depth, x[1], case when x[2] = 0 then 'out' else 'in' end from v
    """,
)
def neighbours_bfs(t: Tables):  # G3
    return G.neighbours(ring(t), 0, 3)


@query("advisory_components", "select o_orderkey as node, min(o_orderkey) over (partition by o_custkey) as component from (select *, count(*) over (partition by o_custkey) as n from orders) where n > 1")
def advisory_components(t: Tables):  # G4: orders of a customer form a chain, which the components put together again
    from pyspark.sql import Window

    before = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return G.components(t.orders.select(F.col("o_orderkey").alias("a"), before.alias("b")).filter("b is not null"))


@query("owner_last_match", "select page_id, case when url like '%9%' then 'team-nine' when url like '%/a%' then 'team-a' when url like 'http%' then 'web' end as owner from pages")
def owner_last_match(t: Tables):  # J12: the last rule that matches wins
    rules = t.spark.createDataFrame([(1, "^http", "web"), (2, "/a", "team-a"), (3, "9", "team-nine")], "ord int, pattern string, owner string")
    return P.last_rule(t.pages.select("page_id", "url"), rules, "url", "ord", "owner", F.expr("url rlike pattern")).select("page_id", "owner")


@query(
    "region_longest_prefix",
    """
    with p as (select page_id, regexp_replace(url, '^[a-z]+://', '') as path from pages),
    f as (select distinct regexp_extract(path, '^([^/]+/[^/]+)/', 1) as folder from p where regexp_matches(path, '^[^/]+/[^/]+/'))
    select page_id, coalesce(case when folder is not null then folder end, case when path like '%/%' then split_part(path, '/', 1) else '.' end) as region
    from p left join f on f.folder = regexp_extract(path, '^([^/]+/[^/]+)/', 1) and starts_with(path, f.folder || '/')
    """,
)
def region_longest_prefix(t: Tables):  # J15
    p = t.pages.select("page_id", F.regexp_replace("url", "^[a-z]+://", "").alias("path"))
    folders = p.filter(F.col("path").rlike("^[^/]+/[^/]+/")).select(F.regexp_extract("path", "^([^/]+/[^/]+)/", 1).alias("folder")).distinct()
    return P.longest_prefix(p, "path", folders, "folder").select("page_id", "region")


@query("orphan_anti", "select c_custkey, c_name from customer where c_custkey not in (select o_custkey from orders where o_custkey is not null)")
def orphan_anti(t: Tables):  # J8
    return t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@query("corroborate_semi", "select p_partkey, p_brand from part where p_partkey in (select l_partkey from lineitem where l_quantity = 50)")
def corroborate_semi(t: Tables):  # J9
    return t.part.join(t.lineitem.filter("l_quantity = 50"), F.col("p_partkey") == F.col("l_partkey"), "left_semi").select("p_partkey", "p_brand")


@query("dev_only_except", "select p_partkey from (select l_partkey as p_partkey, bool_and(l_returnflag = 'N') as only_new from lineitem group by 1) where only_new")
def dev_only_except(t: Tables):  # A10, U4
    return t.lineitem.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.bool_and(F.col("l_returnflag") == "N").alias("only_new")).filter("only_new").select("p_partkey")


@query("attack_surface", "select r_name as region, n_name as nation, cast(sum(case when c_acctbal < 0 then 4 when c_acctbal < 3000 then 2 else 1 end) as bigint) as score, count(*) as members, grouping_id(r_name, n_name) as level from customer join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey group by rollup(r_name, n_name)")
def attack_surface(t: Tables):  # A3
    w = F.when(F.col("c_acctbal") < 0, 4).when(F.col("c_acctbal") < 3000, 2).otherwise(1)
    j = t.customer.join(t.nation, F.col("n_nationkey") == F.col("c_nationkey")).join(t.region, F.col("r_regionkey") == F.col("n_regionkey"))
    return j.rollup(F.col("r_name").alias("region"), F.col("n_name").alias("nation")).agg(F.sum(w).alias("score"), F.count(F.lit(1)).alias("members"), F.grouping_id().alias("level"))
