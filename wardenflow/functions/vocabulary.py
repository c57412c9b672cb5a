"""Closed vocabularies, weights and alias tables. Fixed values throughout."""

SEVERITIES = ("critical", "high", "medium", "low", "info")
CONFIDENCES = ("high", "medium", "low")
STATUSES = ("open", "confirmed", "needs-human", "dismissed")
VERDICTS = ("supported", "partial", "unsupported", "refuted")
CATEGORIES = ("taint", "dep", "secret", "config", "sast", "authz", "crypto", "logs", "privacy", "other")
NOISE_CLASSES = ("encrypted-at-rest", "test-only-path", "vendored-artifact", "pattern-declaration", "resource-identifier")
BROCARDS = ("no-threat-model", "exploit-from-the-heavens", "outside-usage", "standard-behavior", "documented-behavior", "cure-worse-than-disease", "report-not-dispositive")

SEVERITY_WEIGHT = {"critical": 1.0, "high": 0.8, "medium": 0.5, "low": 0.25, "info": 0.1}
EXPOSURE_WEIGHT = {"internet-facing": 1.0, "internal": 0.6, "build-time": 0.3}
CRITICALITY_WEIGHT = {"crown-jewel": 1.0, "standard": 0.6, "peripheral": 0.3}
REACHABILITY_DAMP = {"runtime": 1.0, "unproven": 0.7, "toolchain": 0.55}
SEVERITY_ONLY_RISK = {"critical": 60, "high": 48, "medium": 30, "low": 15, "info": 6}
STATUS_RANK = {"confirmed": 0, "needs-human": 1, "open": 2, "dismissed": 3}
SURFACE_SEVERITY_WEIGHT = {"critical": 4, "high": 3, "medium": 2, "low": 1, "info": 0}
ENTRY_WEIGHT = {"http": 3, "ws": 3, "dom": 2, "postmessage": 2, "llm": 2, "stdin": 1, "cli": 1, "env": 1}

SEVERITY_ALIASES = {
    "critical": "critical", "high": "high", "error": "high", "moderate": "medium", "medium": "medium", "warning": "medium",
    "low": "low", "minor": "low", "note": "low", "negligible": "low", "high_bug": "high", "bug": "low",
    "info": "info", "informational": "info", "unknown": "info", "none": "info",
}

#: Aliases of categories, by category.
CATEGORY_ALIASES = {
    "taint": "xss dom-xss stored-xss reflected-xss ssrf sqli sql-injection nosql-injection injection command-injection code-injection rce path-traversal directory-traversal lfi rfi ssti xxe prototype-pollution open-redirect header-injection crlf-injection response-splitting input-validation validation deserialization insecure-deserialization mass-assignment ldap-injection xpath-injection csv-injection prompt-injection redos",
    "authz": "idor access-control broken-access-control authorization authentication authn privilege-escalation csrf",
    "crypto": "weak-crypto cryptography tls",
    "secret": "credentials hardcoded-secret credential-leak",
    "config": "misconfiguration hardening security-headers cors csp iac",
    "dep": "dependency vulnerable-dependency cve advisory supply-chain",
    "logs": "logging log-injection",
    "privacy": "gdpr rgpd pii data-protection tracking consent",
    "other": "dos denial-of-service resource-exhaustion disclosure information-disclosure info-leak error-handling robustness abuse rate-limit rate-limiting business-logic race race-condition",
}

CVSS = {
    "AV": {"N": 0.85, "A": 0.62, "L": 0.55, "P": 0.2},
    "AC": {"L": 0.77, "H": 0.44},
    "UI": {"N": 0.85, "R": 0.62},
    "CIA": {"H": 0.56, "L": 0.22, "N": 0.0},
    "PR_U": {"N": 0.85, "L": 0.62, "H": 0.27},
    "PR_C": {"N": 0.85, "L": 0.68, "H": 0.5},
}
