"""Checks of live posture over recorded observations, and routing of targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardenflow.functions import scalar as X

#: What an observation holds; a prober outside Spark records them.
OBSERVATION = "url string, scheme string, status int, headers map<string, string>, cookies array<string>, tls_version string, redirects_to string, body string"


def checks() -> list[tuple[str, str, Column]]:
    """id, severity and condition of each check."""
    h = lambda name: F.try_element_at("headers", F.lit(name))
    secure = F.col("scheme") == "https"
    bad_cookie = lambda pattern: F.exists("cookies", lambda c: ~F.lower(c).rlike(pattern))
    return [
        ("missing-csp", "medium", h("content-security-policy").isNull()),
        ("weak-csp", "low", h("content-security-policy").rlike("unsafe-(inline|eval)")),
        ("missing-hsts", "medium", secure & h("strict-transport-security").isNull()),
        ("missing-nosniff", "low", F.coalesce(F.lower(h("x-content-type-options")) != "nosniff", F.lit(True))),
        ("missing-frame-options", "low", h("x-frame-options").isNull() & ~F.coalesce(h("content-security-policy").contains("frame-ancestors"), F.lit(False))),
        ("missing-referrer-policy", "info", h("referrer-policy").isNull()),
        ("server-banner", "info", h("server").rlike(r"\d")),
        ("cookie-not-secure", "medium", secure & bad_cookie(r";\s*secure\b")),
        ("cookie-not-httponly", "medium", bad_cookie(r";\s*httponly\b")),
        ("cookie-no-samesite", "low", bad_cookie(r";\s*samesite=")),
        ("old-tls", "high", F.col("tls_version").isin("SSLv3", "TLSv1", "TLSv1.1")),
        ("no-https-redirect", "medium", (F.col("scheme") == "http") & ~F.coalesce(F.col("redirects_to").startswith("https://"), F.lit(False))),
        ("cors-any-with-credentials", "high", h("access-control-allow-origin").isNotNull() & (F.lower(h("access-control-allow-credentials")) == "true") & (h("access-control-allow-origin") != F.concat("scheme", F.lit("://"), F.regexp_extract("url", "://([^/]+)", 1)))),
        ("no-security-txt", "info", F.col("url").endswith("/.well-known/security.txt") & (F.col("status") == 404)),
        ("graphql-introspection", "medium", F.col("url").rlike("(?i)/graphql") & F.col("body").contains("__schema")),
        ("exposed-path", "high", F.col("url").rlike(r"(\.env|\.git/config|\.aws/credentials|id_rsa|server-status)$") & (F.col("status") == 200)),
    ]


def posture(observations: DataFrame) -> DataFrame:
    """url, check, severity of what each observation fails; private hosts are left out."""
    cells = [F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(i).alias("check"), F.lit(s).alias("severity"))) for i, s, c in checks()]
    host = F.regexp_extract("url", r"://([^/:]+)", 1)
    public = observations.filter(~F.coalesce(X.is_private_host(host), F.lit(False)))
    return public.withColumn("r", F.explode(F.array_compact(F.array(*cells)))).select("url", "r.*")


#: Kinds of targets by what they look like, in order. Fixed values.
TARGETS = (
    ("repository", r"^(?:git@|https?://(?:github|gitlab|bitbucket)\.[a-z]+/[^/]+/[^/]+/?$|.*\.git$)"),
    ("web", r"^https?://"),
    ("image", r"^[a-z0-9.-]+(?::\d+)?/[\w./-]+(?::[\w.-]+|@sha256:[0-9a-f]+)$"),
    ("logs", r"(?i)\.(log|jsonl)(\.gz)?$"),
    ("sarif", r"(?i)\.sarif(\.json)?$"),
    ("lockfile", r"(?i)(package-lock\.json|yarn\.lock|pnpm-lock\.yaml|Cargo\.lock|poetry\.lock|go\.sum|Gemfile\.lock|composer\.lock)$"),
    ("infrastructure", r"(?i)(\.tf|\.tfvars|Dockerfile|docker-compose\.ya?ml|\.ya?ml)$"),
    ("source", r"(?i)\.(js|jsx|ts|tsx|py|go|java|rb|php|rs|c|cpp|cs|kt|swift|scala|sh)$"),
)


def target_kind(target: Column) -> Column:  # F27
    out = None
    for kind, pattern in TARGETS:
        out = F.when(target.rlike(pattern), kind) if out is None else out.when(target.rlike(pattern), kind)
    return out.otherwise("folder")
