"""Scalar functions (X1-X29) as column expressions; nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardenflow.functions import vocabulary as V


def lookup(table: dict, key: Column) -> Column:
    """Value of a small fixed table, NULL where the key is not in it."""
    return F.try_element_at(F.create_map(*[F.lit(x) for item in table.items() for x in item]), key)


def js_round(x: Column) -> Column:
    """Half up, as floor(x + 0.5)."""
    return F.floor(x + F.lit(0.5))


def short_hash(x: Column, length: int = 12) -> Column:  # X1
    return F.substring(F.sha2(x, 256), 1, length)


def finding_id(tool: Column, ident: Column, file: Column, line: Column, version: Column | None = None) -> Column:
    """Content hash of what identifies a finding."""
    tail = F.when(version.isNotNull(), F.concat(F.lit(":"), version)).otherwise(F.lit("")) if version is not None else F.lit("")
    return short_hash(F.concat(F.concat_ws(":", tool, ident, F.coalesce(file, F.lit("")), F.coalesce(line.cast("string"), F.lit(""))), tail))


def normalize_severity(raw: Column, fallback: str = "medium") -> Column:  # X3
    return F.coalesce(lookup(V.SEVERITY_ALIASES, F.lower(F.trim(raw))), F.lit(fallback))


def normalize_category(raw: Column) -> Column:  # X5
    """The category of a name or alias; NULL for others."""
    key = F.regexp_replace(F.lower(F.trim(raw)), r"[\s_]+", "-")
    out = F.when(key.isin(*V.CATEGORIES), key)
    for category, names in V.CATEGORY_ALIASES.items():
        out = out.when(key.isin(*names.split()), F.lit(category))
    return out


def cves_in(text: Column) -> Column:  # X4
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"((?i)CVE-\d{4}-\d{4,})"), F.lit(1)), F.upper))


def pick_cve(ids: Column) -> Column:  # X4
    """The first id that is a CVE, in upper case."""
    return F.get(F.filter(F.transform(ids, lambda x: F.upper(F.trim(x))), lambda x: x.rlike(r"^CVE-\d{4}-\d{4,}$")), F.lit(0))


def first_cwe(text: Column) -> Column:  # X4
    return F.upper(F.nullif(F.regexp_extract(text, r"((?i)CWE-\d+)", 1), F.lit("")))


def severity_rank(severity: Column) -> Column:  # X15
    return F.coalesce(lookup({s: i for i, s in enumerate(V.SEVERITIES)}, severity), F.lit(len(V.SEVERITIES)))


def severity_of_rank(rank: Column) -> Column:
    return F.get(F.array(*[F.lit(s) for s in V.SEVERITIES]), rank)


def status_rank(status: Column) -> Column:
    return F.coalesce(lookup(V.STATUS_RANK, status), F.lit(V.STATUS_RANK["open"]))


def rank_score(risk: Column, severity: Column) -> Column:
    return F.coalesce(risk.cast("int"), lookup(V.SEVERITY_ONLY_RISK, severity), F.lit(0))


def severity_floor(current: Column, floor: str) -> Column:  # X10: the lower of the two
    return F.when(severity_rank(current) >= V.SEVERITIES.index(floor), current).otherwise(F.lit(floor))


def severity_ceiling(current: Column, ceiling: str) -> Column:
    return F.when(severity_rank(current) < V.SEVERITIES.index(ceiling), F.lit(ceiling)).otherwise(current)


def escalate_once(severity: Column) -> Column:
    return F.when(severity == "low", "medium").when(severity == "medium", "high").otherwise(severity)


def risk_score(severity: Column, epss: Column, kev: Column, exposure: Column | None = None, criticality: Column | None = None, reachability: Column | None = None) -> Column:  # X6
    """0 to 100 from severity and exploit likelihood, re-weighted where deployment facts are known."""
    null = F.lit(None).cast("string")
    exposure, criticality, reachability = (x if x is not None else null for x in (exposure, criticality, reachability))
    e = F.least(F.greatest(F.coalesce(epss, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    weight = F.coalesce(lookup(V.SEVERITY_WEIGHT, severity), F.lit(V.SEVERITY_WEIGHT["info"]))
    x = F.coalesce(lookup(V.EXPOSURE_WEIGHT, exposure), F.lit(0.6))
    c = F.coalesce(lookup(V.CRITICALITY_WEIGHT, criticality), F.lit(0.6))
    plain = F.lit(0.6) * weight + F.lit(0.4) * e
    deployed = F.lit(0.4) * weight + F.lit(0.25) * e + F.lit(0.2) * x + F.lit(0.15) * c
    score = js_round(F.lit(100.0) * F.when(exposure.isNull() & criticality.isNull(), plain).otherwise(deployed))
    score = F.when(F.coalesce(kev, F.lit(False)), F.greatest(score, F.lit(95).cast("long"))).otherwise(score)
    damp = lookup(V.REACHABILITY_DAMP, reachability)
    score = F.when(damp.isNotNull(), js_round(score * damp)).otherwise(score)
    return F.least(F.greatest(score, F.lit(0).cast("long")), F.lit(100).cast("long")).cast("int")


def deployment_facts(context: Column) -> Column:  # X7
    """``exposure`` and ``criticality`` that a context document states on lines of their own; NULL where it names no known value."""

    def fact(name: str, known: dict) -> Column:
        stated = F.regexp_extract(context, rf"(?im)^\s*(?:[-*]\s*)?(?:\*\*)?{name}(?:\*\*)?\s*:\s*`?([a-z-]+)", 1)
        return F.when(stated.isin(*known), stated)

    return F.struct(fact("Exposure", V.EXPOSURE_WEIGHT).alias("exposure"), fact("Criticality", V.CRITICALITY_WEIGHT).alias("criticality"))


# Fixed value: the sections of a context document that bear on a ruling.
RULING_SECTIONS = r"(?i)^##\s*(hunt list|exposure|criticality|trust model|trust boundaries|auth)"


def ruling_sections(context: Column) -> Column:  # X25
    """Of a context document the second-level sections that bear on a ruling; NULL if there are none."""
    parts = F.split(F.regexp_replace(context, "\r\n", "\n"), r"(?m)^(?=##\s)")
    kept = F.array_join(F.filter(parts, lambda p: p.rlike(r"^##\s") & p.rlike(RULING_SECTIONS)), "")
    return F.nullif(F.regexp_replace(kept, r"^\s+|\s+$", ""), F.lit(""))


def balanced_arguments(text: Column) -> Column:  # X18
    """What stands between the first opening parenthesis and the one that closes it; NULL if none does."""
    start = F.instr(text, "(")
    signs = F.split(F.substring(text, start, F.char_length(text)), "")

    def step(s: Column, c: Column) -> Column:
        closes = (s["end"] == 0) & (c == ")") & (s["depth"] == 1)
        depth = s["depth"] + F.when(c == "(", 1).when(c == ")", -1).otherwise(0)
        return F.struct(depth.alias("depth"), (s["at"] + 1).alias("at"), F.when(closes, s["at"] + 1).otherwise(s["end"]).alias("end"))

    end = F.aggregate(signs, F.struct(F.lit(0).alias("depth"), F.lit(0).alias("at"), F.lit(0).alias("end")), step, lambda s: s["end"])
    return F.when((start > 0) & (end > 0), F.substring(text, start + 1, end - 2))


def cvss_base_score(vector: Column) -> Column:  # X8
    """Base score of a CVSS 3 vector, NULL if a metric is missing."""
    metric = lambda name: F.nullif(F.regexp_extract(vector, rf"(?:^|/){name}:([A-Z])(?:/|$)", 1), F.lit(""))
    changed = metric("S") == "C"
    av, ac, ui = (lookup(V.CVSS[n], metric(n)) for n in ("AV", "AC", "UI"))
    pr = F.when(changed, lookup(V.CVSS["PR_C"], metric("PR"))).otherwise(lookup(V.CVSS["PR_U"], metric("PR")))
    c, i, a = (lookup(V.CVSS["CIA"], metric(n)) for n in ("C", "I", "A"))
    iss = F.lit(1.0) - (F.lit(1.0) - c) * (F.lit(1.0) - i) * (F.lit(1.0) - a)
    impact = F.when(changed, F.lit(7.52) * (iss - F.lit(0.029)) - F.lit(3.25) * F.pow(iss - F.lit(0.02), F.lit(15))).otherwise(F.lit(6.42) * iss)
    exploit = F.lit(8.22) * av * ac * pr * ui
    raw = F.least(F.when(changed, F.lit(1.08) * (impact + exploit)).otherwise(impact + exploit), F.lit(10.0))
    known = vector.rlike("(?i)CVSS:3") & av.isNotNull() & ac.isNotNull() & ui.isNotNull() & pr.isNotNull() & c.isNotNull() & i.isNotNull() & a.isNotNull()
    return F.when(known, F.when(impact <= 0, F.lit(0.0)).otherwise(F.ceil(raw * F.lit(10.0)) / F.lit(10.0)))


def score_to_severity(score: Column) -> Column:
    return F.when(score.isNull(), "medium").when(score >= 9.0, "critical").when(score >= 7.0, "high").when(score >= 4.0, "medium").when(score >= 0.1, "low").otherwise("info")


def derive_severity(text: Column, fallback: str = "medium") -> Column:
    """From a number, a vector or a label, in this order."""
    s = F.trim(text)
    number = s.try_cast("double")
    return F.when(text.isNull() | (s == ""), F.lit(fallback)).when(number.isNotNull(), score_to_severity(number)).when(s.rlike("(?i)CVSS:3"), score_to_severity(cvss_base_score(s))).otherwise(normalize_severity(s, fallback))


def epoch_ms(ts: Column) -> Column:  # X9
    """Milliseconds of an access-log or ISO time that states year and offset; NULL for others."""
    access = F.when(ts.rlike(r"^\d{1,2}/[A-Z][a-z]{2}/\d{4}:\d{2}:\d{2}:\d{2}\s+[+-]\d{4}$"), F.try_to_timestamp(F.regexp_replace(ts, r"\s+", " "), F.lit("d/MMM/yyyy:HH:mm:ss Z")))
    iso = F.when(ts.rlike(r"(?i)^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})$"), F.regexp_replace(F.upper(ts), r"([+-]\d{2})(\d{2})$", "$1:$2").try_cast("timestamp"))
    return F.unix_millis(F.coalesce(access, iso))


def decode_once(path: Column) -> Column:  # X11: a plus sign stays, malformed text gives NULL
    return F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def path_root(file: Column, depth: int = 2) -> Column:  # X12
    """The first ``depth`` folders of a path; '.' for a file at the top."""
    parts = F.split(file, "/")
    return F.when(F.size(parts) <= 1, F.lit(".")).otherwise(F.array_join(F.slice(parts, F.lit(1), F.least(F.lit(depth), F.size(parts) - 1)), "/"))


def top_dir(file: Column) -> Column:
    return F.when(F.instr(file, "/") > 0, F.substring_index(file, "/", 1)).otherwise(F.lit("."))


def is_high(severity: Column) -> Column:
    return severity.isin("critical", "high")


def next_status(verdict: Column, severity: Column) -> Column:  # X13
    return F.when(verdict == "supported", "confirmed").when(verdict == "refuted", "dismissed").when(verdict == "unsupported", F.when(is_high(severity), "needs-human").otherwise("dismissed")).otherwise("needs-human")


STAGE_BLOCK = r"\n\n(?=(?:Verdict|Revalidation) \()"


def with_stage_note(message: Column, stage: str, label: Column, note: Column) -> Column:  # X14
    """The message with ``stage``'s block replaced or added; other stages' blocks stay."""
    parts = F.split(message, STAGE_BLOCK)
    kept = F.concat(F.slice(parts, 1, 1), F.filter(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: ~p.startswith(f"{stage} (")))
    block = F.concat(F.lit(f"\n\n{stage} ("), label, F.lit(")"), F.when(note.isNotNull() & (note != ""), F.concat(F.lit(": "), note)).otherwise(F.lit("")))
    return F.concat(F.array_join(kept, "\n\n"), block)


def stage_notes(message: Column) -> Column:
    parts = F.split(F.coalesce(message, F.lit("")), STAGE_BLOCK)
    return F.trim(F.array_join(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), " · "))


#: Redaction: kind, Java pattern (group 1 kept where present), secret or PII. Order matters: longer shapes first.
REDACTIONS = (
    ("private-key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", True),
    ("jwt", r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]*", True),
    ("aws-access-key", r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b", True),
    ("slack-token", r"\bxox[baprs]-[A-Za-z0-9-]{10,}", True),
    ("google-api-key", r"\bAIza[0-9A-Za-z_-]{35}", True),
    ("auth-header", r"(?i)\bauthorization:\s*(?:bearer|basic)\s+[A-Za-z0-9._~+/=-]{8,}", True),
    ("query-secret", r"(?i)[?&](?:token|access_token|api_key|apikey|password|passwd|secret)=[^&\s\"']{4,}", True),
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", False),
)
CARD = r"\b[0-9](?:[ -]?[0-9]){12,18}\b"


def leak_kinds(text: Column) -> Column:
    """Kinds of secret and personal data in a line, without repeats."""
    cards = F.transform(F.regexp_extract_all(text, F.lit(f"({CARD})"), F.lit(1)), lambda x: F.regexp_replace(x, "[ -]", ""))
    found = [F.when(text.rlike(p), F.lit(k)) for k, p, _ in REDACTIONS] + [F.when(F.exists(cards, lambda x: F.call_function("luhn_check", x)), F.lit("card"))]
    return F.array_compact(F.array(*found))


def redact(text: Column) -> Column:  # X16
    """The text with each leak replaced by its kind; digits that pass Luhn count as a card."""
    for kind, pattern, _ in REDACTIONS:
        text = F.regexp_replace(text, pattern, f"‹REDACTED:{kind}›")
    digits = lambda x: F.regexp_replace(x, "[ -]", "")
    cards = F.array_distinct(F.filter(F.regexp_extract_all(text, F.lit(f"({CARD})"), F.lit(1)), lambda x: F.call_function("luhn_check", digits(x))))
    return F.aggregate(cards, text, lambda t, card: F.replace(t, card, F.lit("‹REDACTED:card›")))


def truncate_evidence(text: Column, most: int = 200) -> Column:
    return F.when(F.char_length(text) > most, F.concat(F.substring(text, 1, most - 1), F.lit("…"))).otherwise(text)


def split_pkg_version(raw: Column) -> Column:  # X20: at the last @ that is not the first letter
    pkg, version = F.regexp_extract(raw, r"^(.+)@([^@]*)$", 1), F.regexp_extract(raw, r"^(.+)@([^@]*)$", 2)
    return F.struct(F.when(pkg == "", raw).otherwise(pkg).alias("pkg"), F.nullif(version, F.lit("")).alias("version"))


def ghsa_from_url(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, r"(GHSA-[0-9a-z]{4}-[0-9a-z]{4}-[0-9a-z]{4})", 1), F.lit(""))


def package_of_lock_key(key: Column) -> Column:
    """npm lockfile key to package name: what follows the last node_modules/."""
    return F.when(F.instr(key, "node_modules/") > 0, F.substring_index(key, "node_modules/", -1)).otherwise(key)


def rel_loc(file: Column, base: str) -> Column:  # X21
    prefix = base.rstrip("/") + "/"
    return F.when(file.startswith(prefix), F.substring(file, F.lit(len(prefix) + 1), F.char_length(file))).otherwise(file)


def uuid5_shaped(seed: Column) -> Column:  # X22: SHA-1 in the shape of a version 5 UUID
    h = F.sha1(seed)
    variant = F.get(F.array(*[F.lit(c) for c in "89ab"]), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def is_private_host(ip: Column) -> Column:  # X23
    p = F.transform(F.split(ip, r"\."), lambda x: x.try_cast("int"))
    a, b = F.get(p, F.lit(0)), F.get(p, F.lit(1))
    v4 = ip.rlike(r"^\d{1,3}(\.\d{1,3}){3}$")
    inside = (a == 10) | (a == 127) | (a == 0) | ((a == 192) & (b == 168)) | ((a == 172) & b.between(16, 31)) | ((a == 169) & (b == 254)) | ((a == 100) & b.between(64, 127))
    v6 = F.lower(ip).rlike(r"^(::1?|f[cd][0-9a-f]{2}:.*|fe[89ab][0-9a-f]:.*)$")
    return F.when(v4, inside).otherwise(v6 | (F.lower(ip) == "localhost"))


def line_count(content: Column) -> Column:  # X24
    return F.size(F.split(content, "\n"))


def is_test_path(path: Column) -> Column:  # X29
    return path.rlike(r"(^|/)(__tests__|__mocks__|tests?|specs?|e2e|fixtures|testdata)/") | path.rlike(r"\.(test|spec|e2e)\.[A-Za-z]+$") | path.rlike(r"(^|/)test_[^/]*\.py$") | path.rlike(r"_test\.(go|py|rb)$")


def is_constant_assignment(rhs: Column) -> Column:  # X19
    """A right-hand side that is one literal: a quoted string without interpolation, a number or a keyword."""
    return F.trim(rhs).rlike(r"^(\"[^\"$]*\"|'[^']*'|`[^`$]*`|-?\d+(\.\d+)?|true|false|null|undefined)\s*;?$")


def is_literal_secret(value: Column) -> Column:  # X19
    """A quoted value of some length that is no placeholder, reference or template."""
    v = F.trim(value)
    return v.rlike(r"^[\"'][^\"']{6,}[\"']$") & ~v.rlike(r"(?i)\$\{|\{\{|^[\"'](?:var|data|local|module)\.|changeme|example|placeholder|<[^>]*>|xxxx|^[\"']\*+[\"']$")
