"""The algebra of findings: merge, corroborate, enrich, demote, rank, group, count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardenflow.functions import scalar as X
from wardenflow.functions import vocabulary as V
from wardenflow.operators.graph import components
from wardenflow.operators.positional import small
from wardenflow.operators.windows import capped, running_total

#: A finding as a relation; absent values are NULL.
FINDING = (
    "id string, category string, title string, severity string, confidence string, message string, tool string, sources array<string>, status string, "
    "file string, line int, kind string, cwe string, cve string, aliases array<string>, references array<string>, pkg string, version string, verified boolean, "
    "risk int, epss double, kev boolean, reachability string, noise string, verdict string, brocard string, exploit_path string, owners array<string>"
)


def conform(df: DataFrame, engine: bool = False) -> DataFrame:
    """``df`` with all columns of FINDING, in order; missing ones are NULL, id and sources are derived."""
    have = {c.lower() for c in df.columns}
    out = []
    for part in FINDING.split(", "):
        name, kind = part.split(" ", 1)
        out.append(F.col(name).cast(kind).alias(name) if name in have else F.lit(None).cast(kind).alias(name))
    df = df.select(*out, *([F.col("ident")] if "ident" in have else []))
    ident = F.col("ident") if "ident" in have else F.col("title")
    df = df.withColumns(
        {
            "id": F.coalesce("id", X.finding_id(F.col("tool"), ident, F.col("file"), F.col("line"), F.col("version"))),
            "sources": F.coalesce("sources", F.array("tool")),
            "status": F.coalesce("status", F.lit("open")),
            "confidence": F.coalesce("confidence", F.lit("medium")),
        }
    )
    return df.drop("ident")


def union_all(*parts: DataFrame) -> DataFrame:  # U1
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def one_of_each(findings: DataFrame) -> DataFrame:
    """One row for each id: the most severe, then the first by place, tool and message, so that runs agree."""
    order = F.struct(X.severity_rank(F.col("severity")), "file", "line", "tool", "message")
    best = findings.groupBy("id").agg(F.min_by(F.struct(*findings.columns), order).alias("r"))
    return best.select("r.*")


def _sorted_union(column: str) -> Column:
    """The different values of an array column, in order; arrays that are alike are gathered once."""
    return F.array_sort(F.array_distinct(F.flatten(F.collect_set(column))))


def merge_clusters(df: DataFrame, cluster: str) -> DataFrame:  # A1
    """One row for each cluster: the first by severity, risk and id, with the union of what its members know."""
    order = F.struct(X.severity_rank(F.col("severity")), -F.coalesce("risk", F.lit(0)), F.col("id"))
    columns = [c for c in df.columns if c != cluster]
    merged = df.groupBy(cluster).agg(
        F.min_by(F.struct(*columns), order).alias("rep"),
        F.count(F.lit(1)).alias("members"),
        X.severity_of_rank(F.min(X.severity_rank(F.col("severity")))).alias("severity"),
        _sorted_union("sources").alias("sources"),
        _sorted_union("aliases").alias("aliases"),
        _sorted_union("references").alias("references"),
        F.min_by("cve", F.when(F.col("cve").isNotNull(), F.col("id"))).alias("cve"),
        F.min_by("cwe", F.when(F.col("cwe").isNotNull(), F.col("id"))).alias("cwe"),
        F.bool_or(F.coalesce("verified", F.lit(False))).alias("any_verified"),
    )
    taken = {"severity", "sources", "aliases", "references", "cve", "cwe"}
    keep = [F.col(c) if c in taken else F.col(f"rep.{c}").alias(c) for c in columns]
    out = merged.select(*keep, "members", "any_verified")
    out = out.withColumn("confidence", F.when(F.size("sources") >= 2, "high").otherwise(F.col("confidence")))
    out = out.withColumn("verified", F.when(F.col("any_verified"), F.lit(True)).otherwise(F.col("verified")))
    return out.withColumns({c: F.when(F.size(c) > 0, F.col(c)) for c in ("aliases", "references")}).drop("any_verified")


def corroboration_key() -> Column:  # A1
    return F.concat_ws("::", "category", F.lower(F.trim(F.coalesce("cwe", "title"))), F.when(F.col("file").isNotNull(), F.concat_ws(":", "file", "line")).otherwise(F.lit("")))


def advisory_clusters(deps: DataFrame) -> DataFrame:  # G4
    """``deps`` with ``cluster``: findings of one package that share any advisory id, directly or through others."""
    ids = F.concat(F.coalesce(F.transform("aliases", F.upper), F.array().cast("array<string>")), F.when(F.col("cve").isNotNull(), F.array(F.upper("cve"))).otherwise(F.array().cast("array<string>")))
    ids = F.when(F.size(ids) > 0, F.array_distinct(ids)).otherwise(F.array(F.upper("title")))
    keys = deps.select("id", F.explode(ids).alias("x")).join(deps.select("id", F.lower(F.coalesce("pkg", F.lit(""))).alias("p")), "id").select(F.concat(F.lit("f:"), "id").alias("a"), F.concat_ws("|", F.lit("k:"), "p", "x").alias("b"))
    parts = components(keys).select(F.col("node"), F.col("component").alias("cluster"))
    return deps.join(parts, F.concat(F.lit("f:"), deps["id"]) == F.col("node"), "left").drop("node")


def correlate(findings: DataFrame, engine: str = "engine") -> DataFrame:  # A1, G4, J9
    """Findings of several tools merged: equal places and classes, advisories of one package, and corroborated taint."""
    taint, tools = findings.filter(F.col("tool") == engine), findings.filter(F.col("tool") != engine)
    code = merge_clusters(tools.filter("category <> 'dep'").withColumn("cluster", corroboration_key()), "cluster")
    deps = merge_clusters(advisory_clusters(tools.filter("category = 'dep'")), "cluster")
    merged = code.unionByName(deps).drop("members")
    same = lambda a, b: F.upper(F.trim(F.col(a))) == F.upper(F.trim(F.col(b)))
    t, m = taint.alias("t"), merged.alias("m")
    hits = t.join(m, (F.col("t.file") == F.col("m.file")) & (F.col("t.line") == F.col("m.line")) & same("t.cwe", "m.cwe")).select(F.col("t.id").alias("taint_id"), F.col("m.id").alias("tool_id"), F.col("m.sources").alias("more"))
    rest = merged.join(hits.select(F.col("tool_id").alias("id")).distinct(), "id", "left_anti")
    extra = hits.groupBy(F.col("taint_id").alias("x_id")).agg(F.array_distinct(F.flatten(F.collect_list("more"))).alias("more"))
    backed = taint.join(extra, taint["id"] == extra["x_id"], "left").withColumn("sources", F.when(F.col("more").isNotNull(), F.array_sort(F.array_union("sources", "more"))).otherwise(F.col("sources")))
    backed = backed.withColumn("confidence", F.when(F.col("more").isNotNull() & (F.size("sources") >= 2), "high").otherwise(F.col("confidence"))).drop("more", "x_id")
    return backed.unionByName(rest)


def enrich(findings: DataFrame, epss: DataFrame, kev: DataFrame, exposure: str | None = None, criticality: str | None = None) -> DataFrame:  # J10, X6
    """Findings with exploit likelihood, known exploitation and risk. Feeds: epss(cve, epss), kev(cve)."""
    e = epss.groupBy(F.upper("cve").alias("e_cve")).agg(F.max("epss").alias("e_epss"))
    k = kev.select(F.upper("cve").alias("k_cve")).distinct().withColumn("k_kev", F.lit(True))
    out = findings.drop("epss", "kev", "risk").join(e, F.upper("cve") == F.col("e_cve"), "left").join(k, F.upper("cve") == F.col("k_cve"), "left")
    out = out.withColumns({"epss": F.col("e_epss"), "kev": F.coalesce("k_kev", F.lit(False))}).drop("e_cve", "e_epss", "k_cve", "k_kev")
    deployment = [F.lit(x).cast("string") if x else None for x in (exposure, criticality)]
    return out.withColumn("risk", X.risk_score(F.col("severity"), F.col("epss"), F.col("kev"), *deployment, F.col("reachability")))


def mark_toolchain(findings: DataFrame, packages: DataFrame) -> DataFrame:  # J11, A10
    """Dependency findings whose package no runtime entry needs get reachability 'toolchain'.

    packages: name, is_dev (a row for each lockfile entry); one runtime entry makes a package a runtime one.
    """
    dev = packages.groupBy("name").agg(F.bool_and("is_dev").alias("only_dev")).filter("only_dev").select(F.col("name").alias("dev_name"))
    hit = (F.col("category") == "dep") & F.col("reachability").isNull() & (F.col("pkg") == F.col("dev_name"))
    return findings.join(small(dev), hit, "left").withColumn("reachability", F.when(F.col("dev_name").isNotNull(), "toolchain").otherwise(F.col("reachability"))).drop("dev_name")


# Shapes of noise.
VENDORED = r"(?i)(^|/)(\.yarn/(releases|plugins)|vendor|vendored|third_party|third-party|node_modules|\.pnpm|bower_components|site-packages|\.venv|venv|__pycache__|\.tox|dist|build|out|target|coverage|\.next|\.nuxt|\.svelte-kit|\.turbo|\.gradle)/"
MINIFIED = r"(?i)\.min\.(js|mjs|cjs|css)$"
RESOURCE_NAME = r"(?i)\b(?:SPREADSHEET|SHEET|WORKSHEET|DOC|DOCUMENT|FOLDER|DRIVE|DATASET|CALENDAR|PROJECT|BUCKET|WORKSPACE|CHANNEL|TENANT|ORG|GROUP)[_-]?(?:KEY|ID|GID|UUID|SLUG)\b"
CREDENTIAL_SHAPE = r"-----BEGIN|\beyJ[A-Za-z0-9_-]{10,}|\bAKIA[0-9A-Z]{12,}|\b(?:sk|rk)-[A-Za-z0-9]{16,}|\bgh[pousr]_[A-Za-z0-9]{20,}|\bxox[baprs]-|\bAIza[0-9A-Za-z_-]{30,}"
PATTERN_METADATA = r"^\s*(?:re|regex|regexp|pattern|patterns|rule|rules|note|title|description|detail|remediation|example|examples|hint|advice|summary|docs?)\s*:\s*(?:/|[\"'`])"
WHOLE_LINE_COMMENT = r"^\s*(?://|#|\*|<!--)"
BARE_REGEX_LINE = r"^\s*/(?:[^/\\\n]|\\.)+/[gimsuy]*\s*,?\s*$"
ENCRYPTED_PATH = r"(?i)(\.enc\.(ya?ml|json)$|\.(sops|age|gpg|pgp|asc)$|sealed-?secret)"
ENCRYPTED_TEXT = r"kind:\s*SealedSecret|^sops:|\$ANSIBLE_VAULT;|-----BEGIN AGE ENCRYPTED FILE-----|-----BEGIN PGP MESSAGE-----|GITCRYPT|\bENC\("
NOISE_FLOOR = {"encrypted-at-rest": "info", "test-only-path": "low", "resource-identifier": "low", "pattern-declaration": "info", "vendored-artifact": "info"}


def noise_class(text: Column, content: Column, include_tests: bool = False) -> Column:  # F22
    """Class of a finding with ``file``, ``category`` and the cited line's text; the first that holds."""
    category, file = F.col("category"), F.col("file")
    out = F.when((category == "secret") & file.isNotNull() & (file.rlike(ENCRYPTED_PATH) & F.coalesce(content.rlike(f"(?m){ENCRYPTED_TEXT}"), F.lit(False))), "encrypted-at-rest")
    if not include_tests:
        out = out.when(category.isin("taint", "sast") & file.isNotNull() & X.is_test_path(file), "test-only-path")
    out = out.when((category == "secret") & text.rlike(RESOURCE_NAME) & ~text.rlike(CREDENTIAL_SHAPE), "resource-identifier")
    out = out.when((category != "dep") & (text.rlike(PATTERN_METADATA) | text.rlike(BARE_REGEX_LINE) | text.rlike(WHOLE_LINE_COMMENT)), "pattern-declaration")
    out = out.when((category != "dep") & (file.rlike(VENDORED) | file.rlike(MINIFIED)), "vendored-artifact")
    return F.when(~F.coalesce(F.col("verified"), F.lit(False)), out)


def demote(findings: DataFrame, lines: DataFrame, contents: DataFrame | None = None, include_tests: bool = False) -> DataFrame:  # F22
    """Noise gets a class, a lower severity and low confidence; nothing is dropped. lines: file, line, text."""
    cited = findings.drop("noise").join(lines.select("file", "line", F.col("text").alias("line_text")), ["file", "line"], "left")
    if contents is not None:
        cited = cited.join(contents.select("file", F.col("content").alias("file_text")), "file", "left")
    else:
        cited = cited.withColumn("file_text", F.lit(None).cast("string"))
    out = cited.withColumn("noise", noise_class(F.col("line_text"), F.col("file_text"), include_tests)).drop("line_text", "file_text")
    lowered = None
    for name, floor in NOISE_FLOOR.items():
        value = X.severity_floor(F.col("severity"), floor)
        lowered = F.when(F.col("noise") == name, value) if lowered is None else lowered.when(F.col("noise") == name, value)
    return out.withColumn("severity", F.coalesce(lowered, F.col("severity"))).withColumn("confidence", F.when(F.col("noise").isNotNull(), "low").otherwise(F.col("confidence")))


def noise_counts(findings: DataFrame) -> DataFrame:  # A11
    order = F.array_position(F.array(*[F.lit(c) for c in V.NOISE_CLASSES]), F.col("noise"))
    return findings.filter("noise is not null").groupBy("noise").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("id")).alias("ids")).orderBy(order)


def canonical_order() -> list[Column]:  # T4
    return [X.status_rank(F.col("status")), X.rank_score(F.col("risk"), F.col("severity")).desc(), X.severity_rank(F.col("severity")), F.col("id")]


def ranked(findings: DataFrame, most: int | None = None) -> DataFrame:  # T1-T4
    out = findings.orderBy(*canonical_order())
    return out.limit(most) if most is not None else out


def severity_counts(findings: DataFrame) -> DataFrame:  # A2
    return findings.agg(*[F.count_if(F.col("severity") == s).alias(s) for s in V.SEVERITIES])


def families(findings: DataFrame, least: int = 3) -> DataFrame:  # A9
    """Findings with ``family`` (title, root and stage notes) where ``least`` or more share one, and ``lead`` of it."""
    key = F.concat_ws(" :: ", "title", X.path_root(F.col("file")), X.stage_notes(F.col("message")))
    keyed = findings.withColumn("family", F.when(F.col("file").isNotNull(), key))
    rank = F.struct(-X.rank_score(F.col("risk"), F.col("severity")), X.severity_rank(F.col("severity")), F.col("id"))
    groups = keyed.filter("family is not null").groupBy("family").agg(F.count(F.lit(1)).alias("members"), F.min_by("id", rank).alias("lead")).filter(F.col("members") >= least)
    return keyed.join(groups, "family", "left").withColumn("family", F.when(F.col("members").isNotNull(), F.col("family")))


def at_least(findings: DataFrame, severity: str) -> DataFrame:  # F24
    return findings.filter(X.severity_rank(F.col("severity")) <= V.SEVERITIES.index(severity))


def prune_paths(findings: DataFrame, pruned: Column) -> tuple[DataFrame, DataFrame]:  # F21
    """Findings whose place is not pruned, and the number of the others; what cites no file always stays."""
    gone = F.coalesce(F.col("file").isNotNull() & pruned, F.lit(False))
    return findings.filter(~gone), findings.agg(F.count_if(gone).alias("dropped"))


def paths(findings: DataFrame, kind: str | None = None, severity: str | None = None) -> DataFrame:  # F23
    out = findings.filter("category = 'taint'")
    out = out.filter(F.col("kind") == kind) if kind else out
    return at_least(out, severity) if severity else out


def tool_status(runs: DataFrame) -> DataFrame:  # A16; runs: tool, applicable, exit_ok, findings
    status = F.when(~F.col("applicable"), "skipped").when(~F.col("exit_ok"), "failed").when(F.col("findings") == 0, "empty").otherwise("ran")
    return runs.select("tool", status.alias("status"))


def root_causes(findings: DataFrame) -> DataFrame:  # A17
    return findings.filter("status = 'confirmed'").groupBy("category", F.coalesce("cwe", F.lit("")).alias("cwe")).agg(F.count(F.lit(1)).alias("members"), F.array_sort(F.collect_list("id")).alias("ids"))


def variants(findings: DataFrame, most: int = 25) -> DataFrame:  # J16
    """For each confirmed finding the others alike: by title and kind, by file, or by class; at most ``most`` each.

    Before they are joined, the findings of each value of an axis are cut to ``most`` at each place and then to twice as
    many in all: a seed leaves out its own place, which holds no more than ``most`` of those. Both bounds are literal, so
    that Spark trims each partition before it shuffles.
    """
    seeds = findings.filter("status = 'confirmed'").select(*[F.col(c).alias(f"seed_{c}") for c in ("id", "title", "kind", "file", "line", "cwe")])
    parts = []
    for n, (axis, on) in enumerate({"same-callee": ["title", "kind"], "same-file": ["file"], "same-cwe": ["cwe"]}.items()):
        condition = None
        for c in on:
            term = F.col(f"seed_{c}") == F.col(c)
            condition = term if condition is None else condition & term
        here = findings.select("id", "file", "line", *[c for c in on if c != "file"]).filter(" and ".join(f"{c} is not null" for c in on))
        first = capped(here, [*on, *[c for c in ("file", "line") if c not in on]], ["id"], most)
        first = capped(first, on, ["file", "line", "id"], 2 * most)
        parts.append(seeds.join(first, condition).withColumns({"axis": F.lit(axis), "axis_order": F.lit(n)}))
    pairs = union_all(*parts).filter("id <> seed_id and not (file <=> seed_file and line <=> seed_line)")
    first = pairs.groupBy("seed_id", "id", "file", "line").agg(F.min_by("axis", "axis_order").alias("axis"), F.min("axis_order").alias("axis_order"))
    w = Window.partitionBy("seed_id").orderBy("axis_order", "file", "line", "id")
    return first.withColumn("turn", F.row_number().over(w)).filter(F.col("turn") <= most).drop("axis_order")


def coverage(findings: DataFrame, standard: DataFrame, passes: DataFrame) -> DataFrame:  # A14, J17
    """Rows of a standard with hits and state. standard: code, name, kinds array; passes: kind (what was looked for)."""
    kinds = standard.select("code", F.explode("kinds").alias("k"))
    mine = findings.select("id", F.explode(F.array_distinct(F.array_compact(F.array(F.col("category"), F.col("kind"), F.upper("cwe"))))).alias("k"))
    hits = kinds.join(mine, "k").groupBy("code").agg(F.count_distinct("id").alias("hits"))
    looked = kinds.join(passes.select(F.col("kind").alias("k")).distinct(), "k", "left_semi").select("code").distinct().withColumn("looked", F.lit(True))
    out = standard.drop("kinds").join(hits, "code", "left").join(looked, "code", "left")
    return out.select(*[c for c in standard.columns if c != "kinds"], F.coalesce("hits", F.lit(0)).alias("hits"), F.when(F.col("hits") > 0, "examined").when(F.col("looked"), "engine").otherwise("unexamined").alias("state"))


def attack_surface(hits: DataFrame) -> DataFrame:  # A3
    """Score, entries and sinks of each region and file. hits: region, file, role (entry or sink), kind, severity."""
    weight = F.when(F.col("role") == "sink", X.lookup(V.SURFACE_SEVERITY_WEIGHT, F.col("severity"))).otherwise(F.coalesce(X.lookup(V.ENTRY_WEIGHT, F.col("kind")), F.lit(1)))
    out = hits.withColumn("w", F.coalesce(weight, F.lit(0))).rollup("region", "file").agg(F.sum("w").alias("score"), F.count_if(F.col("role") == "entry").alias("entries"), F.count_if(F.col("role") == "sink").alias("sinks"), F.grouping_id().alias("level"))
    return out


def scorecard(cases: DataFrame) -> DataFrame:  # A22; cases: cwe, vulnerable, flagged
    n = lambda a, b: F.count_if((F.col("vulnerable") == a) & (F.col("flagged") == b))
    out = cases.groupBy("cwe").agg(n(True, True).alias("tp"), n(True, False).alias("fn"), n(False, True).alias("fp"), n(False, False).alias("tn"))
    tpr, fpr = F.try_divide("tp", F.col("tp") + F.col("fn")), F.try_divide("fp", F.col("fp") + F.col("tn"))
    return out.withColumns({"tpr": tpr, "fpr": fpr, "youden": tpr - fpr, "f1": F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))})


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:  # A23
    """Rank correlation with mean ranks for ties, from value counts rather than a sort of all rows."""

    def ranks(c):
        counts = running_total(df.groupBy(c).count(), c, "count", "upto__")
        return counts.select(F.col(c).alias(f"{c}__v"), (F.col("upto__") - F.col("count") + (F.col("count") + 1) / 2).alias(f"{c}__r"))

    both = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).join(ranks(a), F.col(a) == F.col(f"{a}__v")).join(ranks(b), F.col(b) == F.col(f"{b}__v"))
    return both.agg(F.corr(f"{a}__r", f"{b}__r").alias("rho"), F.count(F.lit(1)).alias("n"))


def guard_totals(rows: DataFrame) -> DataFrame:  # A13; rows: guarded, file_scoped
    return rows.agg(F.count(F.lit(1)).alias("handlers"), F.count_if(~F.col("guarded")).alias("unguarded"), F.count_if("file_scoped").alias("file_scoped"), ((F.count(F.lit(1)) >= 3) & F.coalesce(F.bool_and(~F.col("guarded")), F.lit(False))).alias("no_auth_anywhere"))
