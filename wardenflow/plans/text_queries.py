"""Line and text operators over documents and pages; patterns here are in the part of syntax that RE2 and Java share."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardenflow.functions import scalar as X
from wardenflow.operators import positional as P
from wardenflow.operators import windows as W
from wardenflow.plans.registry import Tables, query

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
IPV4 = r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"


@query("content_ids", "select doc_id, substr(sha256(coalesce(text, '')), 1, 12) as id from documents")
def content_ids(t: Tables):  # X1
    return t.documents.select("doc_id", X.short_hash(F.coalesce("text", F.lit(""))).alias("id"))


@query(
    "log_format_vote",
    """
    with r as (select source, lang, row_number() over (partition by source order by doc_id) as k from documents where trim(text) <> ''), v as (select source, lang, count(*) as votes, sum(count(*)) over (partition by source) as total from r where k <= 50 group by 1, 2),
    b as (select *, row_number() over (partition by source order by votes desc, lang) as k from v)
    select source, case when votes * 2 >= total then lang else 'raw' end as format, votes from b where k = 1
    """,
)
def log_format_vote(t: Tables):  # S7
    sample = W.capped(t.documents.filter(F.trim("text") != "").select("source", "lang", "doc_id"), ["source"], ["doc_id"], 50)
    votes = sample.groupBy("source", "lang").agg(F.count(F.lit(1)).alias("votes"))
    best = votes.groupBy("source").agg(F.min_by(F.struct("lang", "votes"), F.struct((-F.col("votes")).alias("v"), "lang")).alias("x"), F.sum("votes").alias("total"))
    return best.select("source", F.when(F.col("x.votes") * 2 >= F.col("total"), F.col("x.lang")).otherwise("raw").alias("format"), F.col("x.votes").alias("votes"))


@query(
    "url_parse",
    "select page_id, regexp_extract(url, '^([a-z]+)://', 1) as scheme, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) as host, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) as path, regexp_extract(url, '[?]([^#]*)', 1) as query from pages",
)
def url_parse(t: Tables):  # S8
    part = lambda p: F.regexp_extract("url", p, 1)
    return t.pages.select("page_id", part("^([a-z]+)://").alias("scheme"), part("^[a-z]+://([^/?#]+)").alias("host"), part("^[a-z]+://[^/?#]+([^?#]*)").alias("path"), part("[?]([^#]*)").alias("query"))


SIGNATURES = [("script", "xss", "medium", "(?i)<script"), ("handler", "xss", "medium", "(?i)onerror *=|javascript:"), ("comment", "probe-path", "low", "<!--"), ("entity", "sqli", "high", "&(amp|lt|gt|quot);"), ("traversal", "traversal", "medium", r"(\.\./){2,}")]


@query(
    "signature_scan",
    "with l as (select page_id, unnest(string_split(html, chr(10))) as line, generate_subscripts(string_split(html, chr(10)), 1) as line_no from pages), s(sig, family, severity, re) as (values "
    + ", ".join(f"('{a}', '{b}', '{c}', '{d}')" for a, b, c, d in SIGNATURES)
    + ") select distinct page_id, cast(line_no as int) as line_no, sig, family, severity from l join s on regexp_matches(line, re)",
)
def signature_scan(t: Tables):  # F14, J24, U2
    lines = t.pages.select("page_id", F.posexplode(F.split("html", "\n")).alias("pos", "line"))
    hits = F.array_compact(F.array(*[F.when(F.col("line").rlike(re), F.struct(F.lit(sig).alias("sig"), F.lit(family).alias("family"), F.lit(sev).alias("severity"))) for sig, family, sev, re in SIGNATURES]))
    return lines.select("page_id", (F.col("pos") + 1).alias("line_no"), F.explode(hits).alias("h")).select("page_id", "line_no", "h.*")


@query("first_match_rule", "select doc_id, case when regexp_matches(text, 'AKIA[A-Z0-9]+') then 'access-key' when regexp_matches(text, 'password=') then 'password' when regexp_matches(text, '@[a-z0-9]+[.]') then 'email' when regexp_matches(text, 'license') then 'license' end as rule from documents")
def first_match_rule(t: Tables):  # F1, F17
    rules = [("access-key", F.col("text").rlike("AKIA[A-Z0-9]+")), ("password", F.col("text").rlike("password=")), ("email", F.col("text").rlike("@[a-z0-9]+[.]")), ("license", F.col("text").rlike("license"))]
    return P.first_rule(t.documents, rules, "rule").select("doc_id", "rule")


@query("redact_text", f"select doc_id, sha256(regexp_replace(regexp_replace(coalesce(text, ''), '{EMAIL}', '<email>', 'g'), '{IPV4}', '<ip>', 'g')) as redacted_sha256 from documents")
def redact_text(t: Tables):  # X16
    clean = F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), EMAIL, "<email>"), IPV4, "<ip>")
    return t.documents.select("doc_id", F.sha2(clean, 256).alias("redacted_sha256"))


@query(
    "pii_leaks",
    f"with e as (select source, doc_id, lower(unnest(regexp_extract_all(coalesce(text, ''), '{EMAIL}'))) as email from documents), f as (select *, row_number() over (partition by source, email order by doc_id) = 1 as fresh from e), d as (select source, doc_id, sum(fresh::int) as fresh from f group by 1, 2), r as (select source, doc_id, sum(fresh) over (partition by source order by doc_id) as seen from d) select source, doc_id, cast(seen as bigint) as seen from r where seen >= 5",
)
def pii_leaks(t: Tables):  # F18, W5: a source's e-mails count once it has shown five, not before
    each = t.documents.select("source", "doc_id", F.explode(F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(f"({EMAIL})"), F.lit(1)), F.lower))).alias("email"))
    seen = W.running_distinct(each, "source", "email", ["doc_id", "email"], "seen")
    return seen.groupBy("source", "doc_id").agg(F.max("seen").alias("seen")).filter("seen >= 5")


@query("line_counts", "select doc_id, len(string_split(coalesce(text, ''), chr(10))) as n_lines from documents")
def line_counts(t: Tables):  # X24
    return t.documents.select("doc_id", X.line_count(F.coalesce("text", F.lit(""))).alias("n_lines"))


@query("path_functions", "with p as (select page_id, regexp_replace(url, '^[a-z]+://', '') as f from pages) select page_id, case when f like '%/%' then split_part(f, '/', 1) else '.' end as top, case when len(string_split(f, '/')) <= 1 then '.' else array_to_string(string_split(f, '/')[1:least(2, len(string_split(f, '/')) - 1)], '/') end as root from p")
def path_functions(t: Tables):  # X12
    f = F.regexp_replace("url", "^[a-z]+://", "")
    return t.pages.select("page_id", X.top_dir(f).alias("top"), X.path_root(f).alias("root"))


@query("uuid_shapes", "with h as (select page_id, sha1(url) as h from pages) select page_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || ['8','9','a','b'][(instr('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1] || substr(h, 18, 3) || '-' || substr(h, 21, 12) as id from h")
def uuid_shapes(t: Tables):  # X22
    return t.pages.select("page_id", X.uuid5_shaped(F.col("url")).alias("id"))


@query("severity_aliases", "select o_orderkey, case lower(trim(x)) when 'error' then 'high' when 'moderate' then 'medium' when 'note' then 'low' when 'none' then 'info' else 'medium' end as severity from (select o_orderkey, case o_orderpriority when '1-URGENT' then ' ERROR ' when '2-HIGH' then 'Moderate' when '3-MEDIUM' then 'NOTE' when '5-LOW' then 'none' else 'odd' end as x from orders)")
def severity_aliases(t: Tables):  # X3
    p = F.col("o_orderpriority")
    raw = F.when(p == "1-URGENT", " ERROR ").when(p == "2-HIGH", "Moderate").when(p == "3-MEDIUM", "NOTE").when(p == "5-LOW", "none").otherwise("odd")
    return t.orders.select("o_orderkey", X.normalize_severity(raw).alias("severity"))


@query("luhn_cards", "with c as (select doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[0-9]{16}')) as d from documents), x as (select doc_id, d, list_sum([case when (length(d) - i) % 2 = 1 then case when cast(d[i] as int) * 2 > 9 then cast(d[i] as int) * 2 - 9 else cast(d[i] as int) * 2 end else cast(d[i] as int) end for i in range(1, length(d) + 1)]) as s from c) select doc_id, count(*) as digits16, count(*) filter (where s % 10 = 0) as cards from x group by 1")
def luhn_cards(t: Tables):  # X16
    each = t.documents.select("doc_id", F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("([0-9]{16})"), F.lit(1))).alias("d"))
    return each.groupBy("doc_id").agg(F.count(F.lit(1)).alias("digits16"), F.count_if(F.call_function("luhn_check", F.col("d"))).alias("cards"))
