"""Adjudication: worklists, verdicts folded back, runs merged, citations checked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardenflow.functions import scalar as X
from wardenflow.functions import vocabulary as V
from wardenflow.operators.findings import canonical_order, conform, corroboration_key
from wardenflow.operators.windows import last_write_wins


def verify_worklist(findings: DataFrame, every: bool = False) -> DataFrame:  # L2
    """Open rows, and needs-human ones without a verdict; with ``every`` also those that have one."""
    out = findings.filter("status in ('open', 'needs-human')")
    return out if every else out.filter("not (status = 'needs-human' and verdict is not null)")


def worklist_counts(findings: DataFrame, every: bool = False) -> DataFrame:  # A15
    again = (F.col("status") == "needs-human") & F.col("verdict").isNotNull()
    pending = findings.filter("status in ('open', 'needs-human')")
    return pending.agg(F.count_if(~again).alias("fresh"), (F.count_if(again) if every else F.lit(0)).alias("re_opened"), (F.lit(0) if every else F.count_if(again)).alias("withheld"))


def valid_rows(rows: DataFrame, verdicts: tuple[str, ...] = V.VERDICTS) -> tuple[DataFrame, DataFrame]:  # L11
    """Usable rows, and the others with all that is wrong with each."""
    wrong = F.array_compact(
        F.array(
            F.when(F.col("id").isNull() | (F.trim("id") == ""), F.lit("id is missing")),
            F.when(F.col("verdict").isNull(), F.lit("verdict is missing")).when(~F.col("verdict").isin(*verdicts), F.concat(F.lit("unknown verdict: "), "verdict")),
        )
    )
    marked = rows.withColumn("errors", wrong)
    return marked.filter(F.size("errors") == 0).drop("errors"), marked.filter(F.size("errors") > 0)


def apply_verdicts(findings: DataFrame, verdicts: DataFrame, order: str = "pos") -> DataFrame:  # J13, L2
    """Findings with the last verdict on each folded in. verdicts: id, verdict, note, exploit_path, brocard, pos."""
    v = last_write_wins(verdicts.select("id", order, "verdict", "note", "exploit_path", "brocard"), "id", order).select(F.col("id").alias("v_id"), F.col("verdict").alias("v_verdict"), F.col("note").alias("v_note"), F.col("exploit_path").alias("v_path"), F.col("brocard").alias("v_brocard"))
    j = findings.join(v, findings["id"] == v["v_id"], "left")
    hit = F.col("v_id").isNotNull()
    new: dict[str, Column] = {
        "message": F.when(hit & F.col("v_note").isNotNull() & (F.col("v_note") != ""), X.with_stage_note(F.col("message"), "Verdict", F.col("v_verdict"), F.col("v_note"))).otherwise(F.col("message")),
        "confidence": F.when(hit & (F.col("v_verdict") == "supported"), "high").when(hit & (F.col("v_verdict") == "partial"), "medium").otherwise(F.col("confidence")),
        "status": F.when(hit, X.next_status(F.col("v_verdict"), F.col("severity"))).otherwise(F.col("status")),
        "verdict": F.when(hit, F.col("v_verdict")).otherwise(F.col("verdict")),
        "exploit_path": F.coalesce("v_path", "exploit_path"),
        "brocard": F.when(hit & (F.col("v_verdict") == "refuted") & F.col("v_brocard").isin(*V.BROCARDS), F.col("v_brocard")).otherwise(F.col("brocard")),
    }
    return j.withColumns(new).select(*findings.columns)


def unknown_ids(rows: DataFrame, findings: DataFrame) -> DataFrame:  # U6
    return rows.select("id").distinct().join(findings.select("id"), "id", "left_anti")


def apply_triage(findings: DataFrame, rows: DataFrame, order: str = "pos") -> DataFrame:  # L1
    """'noise' dismisses open rows of medium severity or less; others and higher ones stay as they are."""
    t = last_write_wins(rows.select("id", order, "verdict"), "id", order).select(F.col("id").alias("t_id"), F.col("verdict").alias("t_verdict"))
    drop = (F.col("status") == "open") & (F.col("t_verdict") == "noise") & ~X.is_high(F.col("severity"))
    return findings.join(t, findings["id"] == t["t_id"], "left").withColumn("status", F.when(drop, "dismissed").otherwise(F.col("status"))).select(*findings.columns)


def apply_revalidations(findings: DataFrame, rows: DataFrame, order: str = "pos") -> DataFrame:  # L3
    """Confirmed and needs-human rows against the code as it is now: fixed and false-positive dismiss, uncertain asks."""
    r = last_write_wins(rows.select("id", order, "verdict", "note"), "id", order).select(F.col("id").alias("r_id"), F.col("verdict").alias("r_verdict"), F.col("note").alias("r_note"))
    j = findings.join(r, findings["id"] == r["r_id"], "left")
    live = F.col("r_id").isNotNull() & F.col("status").isin("confirmed", "needs-human")
    status = F.when(live & F.col("r_verdict").isin("fixed", "false-positive"), "dismissed").when(live & (F.col("r_verdict") == "still-valid"), "confirmed").when(live, "needs-human").otherwise(F.col("status"))
    message = F.when(live, X.with_stage_note(F.col("message"), "Revalidation", F.col("r_verdict"), F.col("r_note"))).otherwise(F.col("message"))
    return j.withColumns({"message": message, "status": status}).select(*findings.columns)


def ingest(findings: DataFrame, discoveries: DataFrame, files: DataFrame, order: str = "pos") -> tuple[DataFrame, DataFrame]:  # J14, L5
    """Findings with discoveries added or folded into their equals, and the rejected ones (bad citations).

    files: file, n_lines. Of discoveries with one key the first is added and the others fold into it.
    """
    sized = files.select(F.col("file").alias("f_file"), "n_lines")
    cited = discoveries.join(sized, discoveries["file"] == sized["f_file"], "left")
    good = F.col("n_lines").isNotNull() & F.col("line").between(0, F.col("n_lines"))
    rejected = cited.filter(~F.coalesce(good, F.lit(False))).drop("f_file", "n_lines")
    rows = cited.filter(good).drop("f_file", "n_lines").withColumn("key", corroboration_key())
    known = findings.withColumn("key", corroboration_key())
    folded = rows.groupBy("key").agg(F.array_distinct(F.flatten(F.collect_list("sources"))).alias("more"))
    touched = known.join(folded, "key", "left").withColumn("sources", F.when(F.col("more").isNotNull(), F.array_sort(F.array_union("sources", "more"))).otherwise(F.col("sources"))).select(*findings.columns)
    columns = [c for c in findings.columns if c != "sources"]
    fresh = rows.join(known.select("key"), "key", "left_anti").groupBy("key").agg(F.min_by(F.struct(*columns), order).alias("x"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("sources")))).alias("sources"))
    added = fresh.select(*[F.col("sources") if c == "sources" else F.col(f"x.{c}").alias(c) for c in findings.columns])
    return touched.unionByName(added), rejected


def merge_runs(before: DataFrame, after: DataFrame) -> DataFrame:  # J22, U3, L10
    """The later run's rows, with what was adjudicated in the earlier one kept; rows of the earlier run alone stay."""
    kept = ("status", "verdict", "exploit_path", "confidence", "message", "brocard")
    b = before.select(F.struct(*before.columns).alias("b"), F.col("id").alias("b_id"))
    a = after.select(F.struct(*after.columns).alias("a"), F.col("id").alias("a_id"))
    j = a.join(b, F.col("a_id") == F.col("b_id"), "full")
    ruled = F.col("b_id").isNotNull() & (F.col("b.status") != "open")
    out = []
    for c in after.columns:
        old = F.coalesce(f"b.{c}", f"a.{c}") if c == "brocard" else F.col(f"b.{c}")
        out.append((F.when(F.col("a_id").isNull() | ruled, old).otherwise(F.col(f"a.{c}")) if c in kept else F.when(F.col("a_id").isNull(), F.col(f"b.{c}")).otherwise(F.col(f"a.{c}"))).alias(c))
    return j.select(*out)


def reconcile(primary: DataFrame, second: DataFrame) -> DataFrame:  # J21
    """High rows on whose status two reviews differ go to a human."""
    s = second.select(F.col("id").alias("s_id"), F.col("status").alias("s_status"))
    differ = X.is_high(F.col("severity")) & F.col("s_status").isNotNull() & (F.col("s_status") != F.col("status"))
    return primary.join(s, primary["id"] == s["s_id"], "left").withColumn("status", F.when(differ, "needs-human").otherwise(F.col("status"))).select(*primary.columns)


def grounded(entries: DataFrame, findings: DataFrame) -> DataFrame:  # J18
    """Entries all of whose ids are confirmed findings; entries without ids go. entries: entry, ids."""
    ok = findings.filter("status = 'confirmed'").select(F.col("id").alias("ok_id"))
    each = entries.select("entry", F.explode("ids").alias("x")).join(ok, F.col("x") == F.col("ok_id"), "left")
    good = each.groupBy("entry").agg(F.bool_and(F.col("ok_id").isNotNull()).alias("all_ok")).filter("all_ok").select("entry")
    return entries.join(good, "entry", "left_semi")


def check_citations(findings: DataFrame, files: DataFrame) -> DataFrame:  # F25
    """Citations of findings that are not dismissed and do not resolve; line 0 is the whole file. files: file, n_lines."""
    sized = files.select(F.col("file").alias("f_file"), "n_lines")
    cited = findings.filter("status <> 'dismissed' and file is not null and not startswith(file, '/') and not startswith(file, '../')").join(sized, F.col("file") == F.col("f_file"), "left")
    problem = F.when(F.col("n_lines").isNull(), "no such file").when((F.col("line") < 0) | (F.col("line") > F.col("n_lines")), "no such line")
    return cited.withColumn("problem", problem).filter("problem is not null").select("id", "file", "line", "problem")


def gate(findings: DataFrame, files: DataFrame, min_severity: str = "low", strict: bool = False) -> dict:  # A20, L13
    """Counts and exit code of the check: 1 for broken citations or, if ``strict``, rows not adjudicated; else 0."""
    broken = check_citations(findings, files).count()
    row = findings.agg(F.count_if(F.col("status") == "confirmed").alias("confirmed"), F.count_if(~F.coalesce(F.col("status").isin("confirmed", "dismissed", "needs-human"), F.lit(False)) & (X.severity_rank(F.col("severity")) <= V.SEVERITIES.index(min_severity))).alias("unadjudicated")).first()
    code = 1 if broken or (strict and row["unadjudicated"]) else 0
    return {"broken": broken, "confirmed": row["confirmed"], "unadjudicated": row["unadjudicated"], "exit": code}


def queue(findings: DataFrame, size: int = 8) -> DataFrame:  # W10, K3
    """The worklist in canonical order."""
    return verify_worklist(findings).orderBy(*canonical_order())


HUNT = "pos long, seed_id string, variants array<struct<title: string, severity: string, category: string, file: string, line: int, cwe: string, message: string>>, regression_rule string"


def variant_rows(results: DataFrame) -> tuple[DataFrame, DataFrame]:  # L6
    """Variants that hunts found, as findings with ``seed_id`` and ``pos``, and what is dropped: pos, at, reason.

    results: the columns of HUNT. A result needs the finding that it is a hunt for, a variant its title, file and a line.
    """
    no_seed = results.filter("coalesce(seed_id, '') = ''").select("pos", F.lit(None).cast("int").alias("at"), F.lit("no seed").alias("reason"))
    each = results.filter("coalesce(seed_id, '') <> ''").select("pos", "seed_id", F.posexplode("variants").alias("at", "v")).select("pos", "seed_id", "at", "v.*")
    reason = F.when(F.coalesce(F.trim("title"), F.lit("")) == "", "no title").when(F.coalesce("file", F.lit("")) == "", "no file").when(F.col("line").isNull() | (F.col("line") < 0), "no line")
    told = each.withColumn("reason", reason)
    dropped = no_seed.unionByName(told.filter("reason is not null").select("pos", "at", "reason"))
    good = told.filter("reason is null").withColumns({"tool": F.lit("variants"), "category": F.coalesce(X.normalize_category(F.col("category")), F.lit("other")), "severity": X.normalize_severity(F.col("severity")), "message": F.coalesce("message", "title"), "place": F.col("pos") * 100_000 + F.col("at")})
    found = conform(good.select("tool", "category", "severity", "message", "title", "file", "line", "cwe", F.col("title").alias("ident")))
    keys = good.select(X.finding_id(F.col("tool"), F.col("title"), F.col("file"), F.col("line")).alias("k_id"), "seed_id", F.col("place").alias("pos"))
    keys = keys.groupBy("k_id").agg(F.min_by("seed_id", "pos").alias("seed_id"), F.min("pos").alias("pos"))
    return found.dropDuplicates(["id"]).join(keys, F.col("id") == F.col("k_id")).drop("k_id"), dropped


def apply_variants(findings: DataFrame, results: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:  # L6, J14
    """Findings with the variants added or folded into their equals, variants with bad citations, and dropped rows."""
    rows, dropped = variant_rows(results)
    out, rejected = ingest(findings, rows.drop("seed_id"), files)
    return out.select(*findings.columns), rejected, dropped


def regression_pack(results: DataFrame) -> DataFrame:  # K9
    """seed_id and rule of each hunt that wrote one, a rule once, in the order of the hunts."""
    rules = results.filter("coalesce(trim(regression_rule), '') <> ''").select("pos", "seed_id", F.trim("regression_rule").alias("rule"))
    return rules.groupBy("rule").agg(F.min("pos").alias("pos"), F.min_by("seed_id", "pos").alias("seed_id")).orderBy("pos").select("seed_id", "rule")


UNIT = "pos long, at string, assumptions array<struct<claim: string, enforced_at: string>>"
NOTHING_FOUND = "nothing-found"


def unenforced(units: DataFrame) -> DataFrame:  # L7
    """at, claim, turn of assumptions that nothing enforces, in the order of the units; units without a place are left out."""
    each = units.filter("coalesce(at, '') <> ''").select("pos", "at", F.posexplode("assumptions").alias("turn", "a"))
    return each.filter(F.lower(F.trim("a.enforced_at")) == NOTHING_FOUND).select("pos", "turn", "at", "a.claim").orderBy("pos", "turn")


#: A reported discovery before it is checked; nothing is taken for granted.
DISCOVERY = "pos long, title string, message string, file string, line int, category string, severity string, cwe string, path array<struct<file: string, line: int, why: string>>"


def checked_discoveries(rows: DataFrame) -> DataFrame:  # L11
    """``rows`` (DISCOVERY) with ``errors``, all of a row's at once, ``folded`` where an alias was read as a category, and only the path's usable steps.

    Line 0 cites a whole file. A row without errors is usable; a category's name is that of the category it stands for.
    """
    text = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) == "", F.concat(F.lit(c), F.lit(": not a text")))
    category = X.normalize_category(F.col("category"))
    known = F.col("severity").isin(*V.SEVERITIES)
    errors = F.array_compact(F.array(
        text("title"), text("message"), text("file"), F.when(F.col("line").isNull() | (F.col("line") < 0), "line: not a whole number from 0"),
        F.when(category.isNull(), "category: not known"), F.when(~F.coalesce(known, F.lit(False)), "severity: not known"),
    ))
    steps = F.filter("path", lambda s: s["file"].isNotNull() & (s["line"] >= 1))
    folded = F.when(category != F.lower(F.trim("category")), F.col("category"))
    return rows.withColumns({"errors": errors, "folded": folded, "path": F.when(F.size(steps) > 0, steps)}).withColumn("category", F.coalesce(category, "category"))


def reverdicts(findings: DataFrame, verdicts: DataFrame, order: str = "pos") -> DataFrame:  # L2
    """id, was, verdict: verdicts that would change a finding that has been adjudicated before, and those of unknown ids (``was`` NULL)."""
    v = last_write_wins(verdicts.select("id", order, "verdict"), "id", order)
    known = findings.select("id", "status", "severity", F.col("verdict").alias("old"))
    j = v.join(known, "id", "left")
    changed = (F.col("status") != "open") & (X.next_status(F.col("verdict"), F.col("severity")) != F.col("status"))
    return j.filter(F.col("status").isNull() | changed).select("id", F.col("status").alias("was"), "verdict")
