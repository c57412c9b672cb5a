"""What a run leaves besides its report (K4, K10, K11, T5, L10, X5): the index of findings, evidence packets, log statistics, merged manifests.

Outputs are tables of ordered lines or rows, written from Spark as files of any size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardenflow.functions import scalar as X
from wardenflow.functions import vocabulary as V
from wardenflow.operators import findings as N
from wardenflow.operators import positional as P
from wardenflow.plans.logs import LogReport
from wardenflow.plans.reports import _head, _lines, _order, _text

NOTICE = "> Candidates are deterministic and recall-oriented: every one needs adjudication before it is trusted."


def _bits(*parts: Column, sep: str) -> Column:
    """The parts that are not null, put together."""
    return F.concat_ws(sep, *parts)


def index_entry() -> Column:
    """The lines of one finding in the index; what is not known has no line."""
    head = F.concat(F.lit("### "), _text("id"), F.lit(" — "), _text("severity"), F.lit(" "), _text("title"), F.lit("\n"))
    agreed = F.when(F.size("sources") > 1, F.concat(F.lit(" · agreed by "), F.array_join("sources", ", "))).when(F.col("tool") != "engine", F.concat(F.lit(" · via "), "tool")).otherwise(F.lit(""))
    kind = F.concat(F.lit("- category: "), _text("category"), F.coalesce(F.concat(F.lit(" · "), "cwe"), F.lit("")), F.lit(" · confidence "), _text("confidence"), F.lit(" · status "), _text("status"), agreed)
    epss = F.concat(F.lit("EPSS "), F.format_number(F.col("epss") * 100, 1), F.lit("%"))
    risk = _bits(F.concat(F.lit("risk "), F.col("risk").cast("string")), epss, F.when(F.col("kev"), F.lit("known to be exploited")), F.when(F.col("verified"), F.lit("verified secret")), sep=" · ")
    risk_line = F.when(risk != "", F.concat(F.lit("- "), risk))
    place = F.when(F.col("file").isNotNull(), F.concat(F.lit("- at: `"), "file", F.lit(":"), _text("line"), F.lit("`")))
    owners = F.when(F.size("owners") > 0, F.concat(F.lit("- owner "), F.array_join("owners", ", ")))
    return _bits(head, kind, risk_line, place, owners, F.concat(F.lit("- "), "message"), F.lit(""), sep="\n")


def index_lines(findings: DataFrame, repo: str, languages: list[str] = (), tools: list[str] = (), omitted: tuple[int, int] | None = None, partial_walk: bool = False, scopes: list[str] = ()) -> DataFrame:  # K4
    """``text`` of a run's index: what ran, counts, what was capped, families of alike findings, then each finding by rank.

    ``omitted``: findings that a cap left out, and how many there were.
    """
    counts = N.severity_counts(findings).first()
    total = sum(counts)
    top = ["# Audit index\n", f"- repo: `{repo}`", f"- languages: {', '.join(languages) or '—'}", f"- external tools run: {', '.join(tools) or 'none (graph + taint only)'}", f"- findings: **{total}** — " + "  ".join(f"{s} {counts[s]}" for s in V.SEVERITIES), "\n" + NOTICE + "\n"]
    if omitted and omitted[0]:
        top.append(f"> Coverage capped: **{omitted[0]}** of **{omitted[1]}** candidate(s) were not enumerated.\n")
    if partial_walk:
        top.append("> Partial walk: the file walk hit its limit, so some files were not scanned.\n")
    if scopes:
        top.append(f"> Scoped run: only these paths were analysed: {', '.join(f'`{s}`' for s in scopes)}.\n")
    if not total:
        top.append("_No candidate findings._")
    families = N.families(findings).filter("lead = id")
    alike = F.concat(F.lit("- "), _text("title"), F.lit(" in "), X.path_root(F.col("file")), F.lit(": "), F.col("members").cast("string"), F.lit(" alike, first "), "id")
    grouped = families.select(F.lit(0).alias("tier"), F.lit(1).alias("part"), *_order(), alike.alias("text"))
    entries = findings.select((F.lit(10) + X.status_rank(F.col("status"))).cast("int").alias("tier"), F.lit(1).alias("part"), *_order(), index_entry().alias("text"))
    heads = [(-1, 0, "\n".join(top))] + ([(9, 0, "\n## Candidates\n")] if total else [])
    return _lines(entries.unionByName(grouped), _head(findings.sparkSession, heads))


def write_index(findings: DataFrame, path: str, repo: str, **about) -> None:  # K4
    index_lines(findings, repo, **about).write.text(path)


def packets(paths: DataFrame, lines: DataFrame, edges: DataFrame, around: int = 3) -> DataFrame:  # K11
    """Evidence of each taint path: id, step, role, file, line, text, cited, and neighbours of the step's file.

    paths: rows of ``taint_evidence``; steps go from the input (0) to the sink. A step brings ``around`` lines on both
    sides, of which ``cited`` marks its own. edges: from, to; a file's neighbours are the files one edge away.
    """
    hops = F.reverse(F.transform("hops", lambda h: F.struct(h["file"].alias("file"), h["line"].cast("int").alias("line"))))
    steps = F.concat(F.array(F.struct(F.col("source_file").alias("file"), F.col("source_line").cast("int").alias("line"))), hops)
    each = paths.select("id", F.size("hops").alias("n"), F.posexplode(steps).alias("step", "at")).select("id", "step", "n", F.col("at.file").alias("file"), F.col("at.line").alias("line"))
    role = F.when(F.col("step") == 0, "source").when(F.col("step") == F.col("n"), "sink").otherwise("hop")
    near = P.lines_around(each.withColumn("role", role), lines.select("file", "line", "text"), around, around)
    both = edges.select(F.col("from").alias("file"), F.col("to").alias("n")).unionByName(edges.select(F.col("to").alias("file"), F.col("from").alias("n")))
    beside = both.groupBy("file").agg(F.array_sort(F.collect_set("n")).alias("neighbours"))
    out = near.join(beside, "file", "left")
    return out.select("id", "step", "role", "file", F.col("near_line").alias("line"), "text", (F.col("near_line") == F.col("line")).alias("cited"), F.coalesce("neighbours", F.array().cast("array<string>")).alias("neighbours"))


def packet(packets_: DataFrame, prefix: str) -> str:  # K11
    """The packet of one finding, by its id or the beginning of it, as text."""
    out, last = [], None
    for r in packets_.filter(F.col("id").startswith(prefix)).orderBy("id", "step", "line").toLocalIterator():
        if (r.id, r.step) != last:
            out.append(f"\n## {r.role} {r.file}" + (f" (beside {', '.join(r.neighbours)})" if r.neighbours else ""))
            last = (r.id, r.step)
        out.append(f"{'>' if r.cited else ' '} {r.line:5d} | {r.text}")
    return "\n".join(out).lstrip("\n") + "\n"


def log_findings(report: LogReport) -> DataFrame:  # T5
    """Findings of a log run in the order of their ids."""
    return report.findings.orderBy("id")


def log_statistics(report: LogReport) -> DataFrame:  # K10
    """statistic, row (JSON) of every table of a log run, and of what its caps left out."""
    tables = report.statistics | {"family_overflow": report.family_overflow, "leak_overflow": report.leak_overflow, "formats": report.formats}
    return N.union_all(*[df.select(F.lit(name).alias("statistic"), F.to_json(F.struct(*df.columns)).alias("row")) for name, df in tables.items()])


def write_log_run(report: LogReport, folder: str) -> None:  # K1, K10, T5
    log_findings(report).write.mode("overwrite").option("ignoreNullFields", "true").json(f"{folder}/findings")
    log_statistics(report).write.mode("overwrite").partitionBy("statistic").text(f"{folder}/statistics")


def folded_categories(rows: DataFrame, raw: str = "category") -> DataFrame:  # X5
    """raw, category, n of values that are not a category's own name and were read as one."""
    plain = F.lower(F.trim(F.col(raw)))
    known = rows.groupBy(F.col(raw).alias("raw")).agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("raw", raw).withColumn("read_as", X.normalize_category(F.col(raw)))
    return known.filter((F.col("read_as") != plain) & F.col("read_as").isNotNull()).select(F.col(raw).alias("raw"), F.col("read_as").alias("category"), "n")


MANIFEST = "languages array<string>, tools array<string>, tool_status array<struct<name: string, status: string>>, scopes array<string>, omitted long, total long, partial_walk boolean"


def merge_manifests(before: DataFrame, after: DataFrame) -> DataFrame:  # L10, A16
    """The manifest of merged runs, one row each: MANIFEST.

    Names are united, of a tool's status the later one counts. A scoped run covered a part only, so what an earlier run
    left out still is; a run without scopes speaks for all, and its own caps replace the earlier ones.
    """
    b, a = (df.select(*[F.col(c.split()[0]).alias(f"{side}_{c.split()[0]}") for c in MANIFEST.replace("array<struct<name: string, status: string>>", "x").split(", ")]) for side, df in (("b", before), ("a", after)))
    both = b.crossJoin(a)  # one row each
    none = F.array().cast("array<string>")
    union = lambda c: F.array_sort(F.array_union(F.coalesce(f"b_{c}", none), F.coalesce(f"a_{c}", none)))
    scoped = F.coalesce(F.size("a_scopes") > 0, F.lit(False))
    later = F.coalesce("a_tool_status", F.array().cast("array<struct<name: string, status: string>>"))
    earlier = F.filter(F.coalesce("b_tool_status", later), lambda s: ~F.exists(later, lambda t: t["name"] == s["name"]))
    most = lambda c: F.when(scoped, F.greatest(f"b_{c}", f"a_{c}")).otherwise(F.col(f"a_{c}"))
    walk = F.when(scoped, F.coalesce("b_partial_walk", F.lit(False)) | F.coalesce("a_partial_walk", F.lit(False))).otherwise(F.coalesce("a_partial_walk", F.lit(False)))
    return both.select(union("languages").alias("languages"), union("tools").alias("tools"), F.array_sort(F.concat(earlier, later)).alias("tool_status"), union("scopes").alias("scopes"), most("omitted").alias("omitted"), most("total").alias("total"), walk.alias("partial_walk"))


def cover(scopes: DataFrame, scope: str = "scope") -> DataFrame:  # L10
    """The scopes that lie in no other: a scope is dropped if one of its own folders is a scope too."""
    clean = scopes.select(F.regexp_replace(F.col(scope), "/+$", "").alias(scope)).filter(F.col(scope) != "").distinct()
    parts = F.split(F.col(scope), "/")
    above = F.filter(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")), lambda x: x != F.col(scope))
    inside = clean.withColumn("above__", F.explode(above)).join(clean.withColumnRenamed(scope, "above__"), "above__", "left_semi").select(scope)
    return clean.join(inside.distinct(), scope, "left_anti")
