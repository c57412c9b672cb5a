"""Standards and the finding kinds, categories and classes that speak to each of their parts (A14). Fixed values."""

STANDARDS = {
    "owasp-top10": (
        ("A01", "Broken access control", "authz path redirect massassign CWE-22 CWE-284 CWE-352 CWE-601 CWE-862 CWE-863 CWE-918"),
        ("A02", "Cryptographic failures", "crypto random CWE-295 CWE-311 CWE-319 CWE-327 CWE-328 CWE-330 CWE-916"),
        ("A03", "Injection", "sql command code nosql ldap xpath ssti xss domxss crlf csv CWE-77 CWE-78 CWE-79 CWE-89 CWE-90 CWE-94"),
        ("A04", "Insecure design", "trustboundary llm CWE-501 CWE-1427"),
        ("A05", "Security misconfiguration", "config xxe CWE-16 CWE-489 CWE-611 CWE-693 CWE-942 CWE-1004 CWE-614"),
        ("A06", "Vulnerable components", "dep CWE-1104"),
        ("A07", "Authentication failures", "brute-force credential-compromise CWE-287 CWE-306 CWE-347 CWE-521 CWE-613 CWE-798"),
        ("A08", "Integrity failures", "deserialize CWE-502 CWE-506 CWE-829"),
        ("A09", "Logging failures", "logs log CWE-117 CWE-532"),
        ("A10", "Server-side request forgery", "ssrf CWE-918"),
    ),
    "owasp-api-top10": (
        ("API1", "Object level authorization", "authz CWE-639"),
        ("API2", "Authentication", "CWE-287 CWE-306 CWE-347 CWE-798 brute-force"),
        ("API3", "Property level authorization", "massassign CWE-915 CWE-213"),
        ("API4", "Resource consumption", "redos request-burst CWE-770 CWE-1333"),
        ("API5", "Function level authorization", "CWE-285 CWE-862 CWE-863"),
        ("API6", "Sensitive business flows", "CWE-799 CWE-837"),
        ("API7", "Server-side request forgery", "ssrf CWE-918"),
        ("API8", "Misconfiguration", "config CWE-942 CWE-16"),
        ("API9", "Inventory", "probe-path CWE-1059"),
        ("API10", "Unsafe consumption of APIs", "deserialize xxe CWE-20 CWE-502"),
    ),
    "masvs": (
        ("STORAGE", "Storage", "secret CWE-312 CWE-532"),
        ("CRYPTO", "Cryptography", "crypto random CWE-327 CWE-330"),
        ("AUTH", "Authentication", "authz CWE-287 CWE-613"),
        ("NETWORK", "Network", "CWE-295 CWE-319"),
        ("PLATFORM", "Platform", "domxss CWE-749 CWE-926"),
        ("CODE", "Code", "dep buffer CWE-120 CWE-1104"),
        ("RESILIENCE", "Resilience", "CWE-489 CWE-693"),
        ("PRIVACY", "Privacy", "privacy CWE-359"),
    ),
    "asvs": (
        ("V1", "Architecture", "trustboundary CWE-501"),
        ("V2", "Authentication", "CWE-287 CWE-521 CWE-916 brute-force"),
        ("V3", "Session management", "cookie CWE-384 CWE-613 CWE-614 CWE-1004"),
        ("V4", "Access control", "authz CWE-284 CWE-306 CWE-862"),
        ("V5", "Validation and encoding", "sql command code xss domxss nosql ldap xpath ssti deserialize xxe proto CWE-20"),
        ("V6", "Stored cryptography", "crypto random secret CWE-327 CWE-798"),
        ("V7", "Errors and logging", "logs log CWE-117 CWE-532"),
        ("V8", "Data protection", "privacy CWE-200 CWE-311"),
        ("V9", "Communications", "CWE-295 CWE-319"),
        ("V10", "Malicious code", "CWE-506 agent-ci-A agent-ci-B"),
        ("V12", "Files and resources", "path ssrf CWE-22 CWE-434"),
        ("V13", "API", "massassign CWE-352 CWE-915"),
        ("V14", "Configuration", "config dep CWE-16 CWE-489 CWE-942"),
    ),
    #: The list of 2024, in its order.
    "cwe-top25": tuple((f"CWE-{n}", f"CWE-{n}", f"CWE-{n}") for n in (79, 787, 89, 352, 22, 125, 78, 416, 862, 434, 94, 20, 77, 287, 269, 502, 200, 863, 918, 119, 476, 798, 190, 400, 306)),
}


def standard_rows(name: str) -> list[tuple[str, str, list[str]]]:
    """code, name, kinds of each part of a standard."""
    return [(code, title, kinds.split()) for code, title, kinds in STANDARDS[name]]
