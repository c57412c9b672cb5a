"""Attacks and leaks in logs (F14-F18, W1-W8, A4-A8): signatures, scanners, leaks and behaviour of addresses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardenflow.functions import scalar as X
from wardenflow.operators import windows as W
from wardenflow.operators.findings import conform, union_all
from wardenflow.storage import cut

# Signatures (id, family, severity, pattern, title).
PROBE = r"(?i)(^|/)(\.env|\.git/config|wp-login\.php|xmlrpc\.php|phpmyadmin|\.aws/credentials|actuator/[\w-]*|server-status|\.ssh/|vendor/phpunit|id_rsa)([/?\"]|$)"
SIGNATURES = (
    ("sqli-union-select", "sqli", "high", r"(?i)\bunion\b[\s\S]{0,40}\bselect\b", "SQL injection: UNION SELECT"),
    ("sqli-boolean-tautology", "sqli", "high", r"(?i)'\s*(or|and)\s*'?\d+'?\s*=\s*'?\d+", "SQL injection: boolean tautology"),
    ("sqli-time-based", "sqli", "high", r"(?i)\b(sleep|benchmark|pg_sleep|waitfor\s+delay)\s*\(", "SQL injection: time-based probe"),
    ("sqli-schema-probe", "sqli", "medium", r"(?i)\b(information_schema|@@version|xp_cmdshell)\b", "SQL injection: schema probe"),
    ("xss-script-probe", "xss", "medium", r"(?i)<script\b|onerror\s*=|javascript:", "Cross-site scripting probe"),
    ("traversal-dotdot", "traversal", "medium", r"(\.\./|\.\.\\){2,}", "Path traversal: parent segments"),
    ("traversal-sensitive-file", "traversal", "high", r"(?i)/etc/passwd|/proc/self/environ|boot\.ini|win\.ini", "Path traversal: sensitive file"),
    ("cmdinj-shell-chain", "cmdinj", "high", r"(?i)(;|\||\$\(|`|&&)\s*(wget|curl|nc|bash|sh|python|powershell)\b", "Command injection probe"),
    ("probe-sensitive-path", "probe-path", "low", PROBE, "Sensitive-path probe"),
)
SCANNERS = ("sqlmap", "nikto", "nuclei", "masscan", "zgrab", "acunetix", "nmap", "dirbuster", "gobuster", "wpscan", "feroxbuster", "wfuzz", "hydra")
FAMILY_CWE = {"sqli": "CWE-89", "xss": "CWE-79", "traversal": "CWE-22", "cmdinj": "CWE-78"}
ESCALATED = ("probe-path", "traversal")
AUTH = (
    ("auth-fail", r"(?i)\b(Failed password|authentication failure|Invalid user)\b"),
    ("auth-success", r"(?i)\bAccepted (password|publickey)\b"),
    ("auth-fail", r"(?i)\b(login failed|authentication failed)\b"),
    ("auth-success", r"(?i)\blogin succeeded\b"),
)
# Thresholds.
FAMILY_CAP, LEAK_CAP, BULK_EMAILS = 50, 25, 5
FAILURES, BURST, ERRORS, ERROR_STATUSES = 20, 300, 15, (401, 403, 404)
WINDOW_S, LINE_WINDOW = 60, 500


def auth_event(text: Column) -> Column:  # F17
    out = None
    for kind, pattern in AUTH:
        out = F.when(text.rlike(pattern), kind) if out is None else out.when(text.rlike(pattern), kind)
    return out


def success(status: Column) -> Column:
    return F.coalesce(status.between(200, 299), F.lit(False))


def _targets() -> list[Column]:
    return [F.col("path"), X.decode_once(F.col("path")), F.col("ua"), F.col("text")]


def evidence(redacted: bool, column: str = "text") -> Column:
    return X.truncate_evidence(X.redact(F.col(column)) if redacted else F.col(column))


def signature_hits(events: DataFrame, redacted: bool = True, cap: int = FAMILY_CAP) -> tuple[DataFrame, DataFrame]:  # F14, F16, W7
    """Findings of signatures, ``cap`` of each family in order of the run, and what the cap left out by family."""
    cells = []
    for sig, family, severity, pattern, title in SIGNATURES:
        hit = F.lit(False)
        for t in _targets():
            hit = hit | F.coalesce(t.rlike(pattern), F.lit(False))
        cells.append(F.when(hit, F.struct(F.lit(sig).alias("sig"), F.lit(family).alias("family"), F.lit(severity).alias("severity"), F.lit(title).alias("title"))))
    hits = events.withColumn("h", F.explode(F.array_compact(F.array(*cells)))).select("file", "line", "idx", "text", "status", "h.*")
    kept = W.capped(hits, ["family"], ["idx", "sig"], cap)
    up = F.col("family").isin(*ESCALATED) & success(F.col("status"))
    found = kept.select(
        F.concat_ws(":", "sig", "file", "line").alias("ident"), "title", F.lit("logs").alias("category"), F.lit("engine").alias("tool"), F.lit("low").alias("confidence"), "file", "line",
        F.when(up, X.escalate_once(F.col("severity"))).otherwise(F.col("severity")).alias("severity"), X.lookup(FAMILY_CWE, F.col("family")).alias("cwe"), F.col("family").alias("kind"),
        F.concat(F.col("title"), F.lit(": "), evidence(redacted), F.when(up, F.lit(" (succeeded)")).otherwise(F.lit(""))).alias("message"),
    )
    return conform(found), W.overflow(hits, ["family"], cap)


def scanner_agents(events: DataFrame, redacted: bool = True) -> DataFrame:  # F15
    name = None
    for s in SCANNERS:
        name = F.when(F.lower("ua").contains(s), s) if name is None else name.when(F.lower("ua").contains(s), s)
    seen = events.withColumn("scanner", name).filter("scanner is not null").groupBy("file", "scanner").agg(F.min_by(F.struct("line", "ua"), "line").alias("x"))
    seen = seen.select("file", "scanner", "x.line", "x.ua")
    return conform(seen.select(F.concat_ws(":", F.lit("scanner-ua"), "scanner", "file").alias("ident"), F.concat(F.lit("Scanner user agent: "), "scanner").alias("title"), F.lit("logs").alias("category"), F.lit("engine").alias("tool"), F.lit("low").alias("severity"), F.lit("low").alias("confidence"), "file", "line", F.lit("scanner-ua").alias("kind"), evidence(redacted, "ua").alias("message")))


def leaks(events: DataFrame, redacted: bool = True, cap: int = LEAK_CAP, bulk: int = BULK_EMAILS) -> tuple[DataFrame, DataFrame]:  # F18, W5, A8
    """Secrets and personal data in lines; e-mails count from the line on where their file has shown ``bulk`` of them."""
    kinds = events.select("file", "line", "text", F.explode(X.leak_kinds(F.col("text"))).alias("leak"))
    pattern = next(p for k, p, _ in X.REDACTIONS if k == "email")
    mail = kinds.filter("leak = 'email'").select("file", "line", F.explode(F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(f"({pattern})"), F.lit(1)), F.lower))).alias("mail"))
    # a file has shown ``bulk`` addresses from the line on where the one of that number first stands
    first = W.capped(mail.groupBy("file", "mail").agg(F.min("line").alias("line")), ["file"], ["line", "mail"], bulk)
    since = first.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.max("line").alias("since")).filter(F.col("n") >= bulk).select("file", "since")
    many = kinds.filter("leak = 'email'").join(since, "file").filter("line >= since").drop("since")
    hits = kinds.filter("leak <> 'email'").unionByName(many)
    kept = W.capped(hits, ["file"], ["line", "leak"], cap)
    secret = F.col("leak").isin(*[k for k, _, s in X.REDACTIONS if s])
    found = kept.select(
        F.concat(F.lit("log-secret-"), F.concat_ws(":", "leak", "file", "line")).alias("ident"), F.concat(F.lit("Leak in log: "), "leak").alias("title"), F.lit("logs").alias("category"), F.lit("engine").alias("tool"),
        F.when(secret, "high").otherwise("medium").alias("severity"), F.lit("low").alias("confidence"), "file", "line", F.lit("CWE-532").alias("cwe"), F.concat(F.lit("log-secret-"), "leak").alias("kind"), evidence(redacted).alias("message"),
    )
    return conform(found), W.overflow(hits, ["file"], cap)


def windowed(marks: DataFrame, window_s: int) -> DataFrame:  # W1, W2
    """Counts of marks in the window of their address: by time where the address's first mark has one, else by line."""
    first = marks.groupBy("ip").agg(F.min_by(F.col("ms").isNotNull(), "idx").alias("timed"))
    marks = marks.join(first, "ip")
    names = {"n_in_window": "n", "n_in_window_from": "since"}
    timed = W.sliding_count_dealt(marks.filter("timed and ms is not null"), "ip", "ms", window_s * 1000).withColumnsRenamed(names)
    plain = W.sliding_count_dealt(marks.filter("not timed"), "ip", "idx", LINE_WINDOW).withColumnsRenamed(names)
    return timed.unionByName(plain)


def _cited(trigger: DataFrame, marks: DataFrame) -> DataFrame:
    """The trigger with file and line of the oldest mark of its window."""
    m = marks.select("ip", F.col("idx").alias("m_idx"), F.col("ms").alias("m_ms"), F.struct("file", "line").alias("at"))
    oldest = trigger.join(m, "ip").filter(F.when(F.col("timed"), F.col("m_ms") == F.col("since")).otherwise(F.col("m_idx") == F.col("since")))
    best = oldest.groupBy("ip").agg(F.min_by("at", "m_idx").alias("at"))
    return trigger.drop("file", "line").join(best, "ip").select("*", "at.file", "at.line").drop("at")


def _behaviour(df: DataFrame, kind: str, severity: str, title: str) -> DataFrame:
    return conform(df.select(F.concat_ws(":", F.lit(kind), "ip", "file").alias("ident"), F.lit(title).alias("title"), F.lit("logs").alias("category"), F.lit("engine").alias("tool"), F.lit(severity).alias("severity"), F.lit("low").alias("confidence"), "file", "line", F.lit(kind).alias("kind"), F.concat(F.lit(title), F.lit(" from "), "ip").alias("message")))


def behaviour(events: DataFrame, window_s: int = WINDOW_S) -> DataFrame:  # W1-W4, W8
    """Bursts, scans, what scans found, brute force and what it may have won, once for each address and kind."""
    rows = cut(events.filter("ip is not null").select("ip", "idx", X.epoch_ms(F.col("ts")).alias("ms"), "file", "line", "path", "status", auth_event(F.col("text")).alias("auth")), "behaviour")
    marks = lambda condition: rows.filter(condition).select("ip", "idx", "ms", "file", "line")

    def trigger(condition, least):
        own = marks(condition)
        return _cited(W.first_trigger(windowed(own, window_s), "ip", ["idx"], F.col("n") >= least), own)

    burst = trigger(F.lit(True), BURST + 1)
    spike = cut(trigger(F.col("status").isin(*ERROR_STATUSES), ERRORS), "spike")
    force = cut(trigger(F.col("auth") == "auth-fail", FAILURES), "force")

    def after(trig, condition):
        t = trig.select("ip", F.col("idx").alias("t_idx"))
        hit = rows.filter(condition).join(t, "ip").filter("idx > t_idx")
        return hit.groupBy("ip").agg(F.min_by(F.struct("file", "line"), "idx").alias("x")).select("ip", "x.file", "x.line")

    on_probe = F.coalesce(F.col("path").rlike(PROBE), F.lit(False)) | F.coalesce(X.decode_once(F.col("path")).rlike(PROBE), F.lit(False))
    recon = after(spike, success(F.col("status")) & on_probe)
    won = after(force, F.col("auth") == "auth-success").select("ip").join(force, "ip")
    return union_all(
        _behaviour(burst, "request-burst", "low", "Request burst"),
        _behaviour(spike, "scan-behavior", "low", "Scanning"),
        _behaviour(recon, "recon-hit", "medium", "Recon followed by a hit"),
        _behaviour(force, "brute-force", "medium", "Brute-force attempts"),
        _behaviour(won, "credential-compromise", "high", "Possible credential compromise"),
    )


def statistics(events: DataFrame) -> dict[str, DataFrame]:  # A4-A7
    seen = lambda c: events.filter(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("n"), F.min("idx").alias("i")).orderBy(F.col("n").desc(), "i").limit(10).drop("i")
    auth = events.withColumn("auth", auth_event(F.col("text"))).filter("ip is not null and auth is not null")
    failed = auth.filter("auth = 'auth-fail'").groupBy("ip").agg(F.min("idx").alias("f"))
    return {
        "total": events.agg(F.count(F.lit(1)).alias("lines"), F.min_by("ts", F.when(F.col("ts").isNotNull(), F.col("idx"))).alias("first_ts"), F.max_by("ts", F.when(F.col("ts").isNotNull(), F.col("idx"))).alias("last_ts"), F.count_distinct("ip").alias("addresses")),
        "status": events.filter("status is not null").groupBy("status").count(),
        "top_ip": seen("ip"),
        "top_path": seen("path"),
        "auth": auth.agg(F.count_if(F.col("auth") == "auth-fail").alias("failures")),
        "auth_after_failure": auth.filter("auth = 'auth-success'").join(failed, "ip").filter("idx > f").agg(F.count(F.lit(1)).alias("n")),
    }
