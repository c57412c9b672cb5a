"""Line shapes of configuration audits: web, authentication, cloud, CI. Fixed values throughout.

Each is id, class, severity, path pattern, line pattern.
"""

CODE = r"\.(js|jsx|ts|tsx|mjs|cjs|py|rb|php|java|kt|go|cs)$"
CONF = r"\.(ya?ml|json|toml|ini|conf|cfg|env|properties|tf|xml)$|(^|/)(nginx|httpd|Dockerfile|\.htaccess)[^/]*$"
ANY = r"."
YAML = r"\.ya?ml$"
TERRAFORM = r"\.(tf|json|ya?ml)$"

WEB = (
    ("cors-reflect", "CWE-942", "high", CODE, r"(?i)Access-Control-Allow-Origin['\"]?\s*[,:\]]\s*=?\s*(?:req|request|ctx)\b|\borigin\s*:\s*true\b"),
    ("cors-wildcard", "CWE-942", "medium", ANY, r"(?i)Access-Control-Allow-Origin['\"]?\s*[,:=]?\s*['\"]?\s*\*|\borigin\s*:\s*['\"]\*['\"]|CORS_(?:ORIGIN_)?ALLOW_ALL(?:_ORIGINS)?\s*=\s*True"),
    ("cookie-httponly", "CWE-1004", "medium", CODE, r"(?i)\bhttp_?only\s*[:=]\s*(?:false|False)\b"),
    ("cookie-secure", "CWE-614", "medium", CODE, r"(?i)(?:\bsecure\s*:\s*false\b|SESSION_COOKIE_SECURE\s*=\s*False|CSRF_COOKIE_SECURE\s*=\s*False)"),
    ("cookie-samesite-none-insecure", "CWE-1275", "medium", CODE, r"(?i)same_?site\s*[:=]\s*['\"]none['\"](?!.*secure\s*[:=]\s*true)"),
    ("tls-verify", "CWE-295", "high", CODE, r"rejectUnauthorized\s*:\s*false|verify\s*=\s*False|NODE_TLS_REJECT_UNAUTHORIZED['\"]?\]?\s*=\s*['\"]?0|InsecureSkipVerify\s*:\s*true|CURLOPT_SSL_VERIFYPEER\s*,\s*(?:false|0)|check_hostname\s*=\s*False"),
    ("debug", "CWE-489", "medium", ANY, r"^\s*DEBUG\s*=\s*True\b|\bapp\.run\([^)]*debug\s*=\s*True|\bdisplay_errors\s*=\s*On\b|ASPNETCORE_ENVIRONMENT=Development"),
    ("header-csp", "CWE-693", "low", ANY, r"(?i)contentSecurityPolicy\s*:\s*false|Content-Security-Policy[^\n]*unsafe-(?:inline|eval)"),
    ("header-xfo", "CWE-1021", "low", ANY, r"(?i)X-Frame-Options['\"]?\s*[,:]?\s*['\"]?ALLOWALL|frameguard\s*:\s*false|X_FRAME_OPTIONS\s*=\s*['\"]ALLOWALL"),
    ("header-hsts", "CWE-319", "low", ANY, r"(?i)\bhsts\s*:\s*false|Strict-Transport-Security[^\n]*max-age=0|SECURE_HSTS_SECONDS\s*=\s*0\b"),
    ("header-referrer", "CWE-200", "low", ANY, r"(?i)Referrer-Policy['\"]?\s*[,:]?\s*['\"]?unsafe-url"),
    ("dir-listing", "CWE-548", "low", ANY, r"(?i)\bautoindex\s+on\b|Options\s+[^\n]*\+?Indexes\b|\bserveIndex\s*\("),
    ("csrf-disabled", "CWE-352", "high", CODE, r"@csrf_exempt|csrf\(\)\.disable\(\)|protect_from_forgery\s+except|WTF_CSRF_ENABLED\s*=\s*False|skip_before_action\s+:verify_authenticity_token"),
    ("graphql-introspection", "CWE-200", "low", CODE, r"\bintrospection\s*:\s*true\b|graphiql\s*[:=]\s*(?:true|True)"),
)

AUTH = (
    ("jwt-alg-none", "CWE-347", "critical", CODE, r"(?i)\balg(?:orithms?)?['\"]?\s*[:=]\s*\[?\s*['\"]none['\"]"),
    ("jwt-no-verify-alg", "CWE-347", "medium", CODE, r"\bjwt\.verify\s*\(\s*[^,()]+,\s*[^,()]+\)\s*;?"),
    ("jwt-decode", "CWE-347", "high", CODE, r"verify_signature['\"]?\s*:\s*False|\bjwt\.decode\s*\([^)]*verify\s*=\s*False|\bjwt_decode\s*\("),
    ("jwt-expiry", "CWE-613", "medium", CODE, r"ignoreExpiration\s*:\s*true|verify_exp['\"]?\s*:\s*False"),
    ("jwt-secret-hardcoded", "CWE-798", "high", CODE, r"\bjwt\.(?:sign|verify|encode|decode)\s*\(\s*[^,]+,\s*['\"][^'\"]{4,}['\"]"),
    ("jwt-weak-secret", "CWE-521", "high", CODE, r"(?i)\bjwt\w*\s*\([^)]*['\"](?:secret|password|changeme|test|key|123456)['\"]"),
    ("oauth-implicit", "CWE-757", "medium", CODE, r"response_type['\"]?\s*[:=]\s*['\"]?token\b"),
    ("oauth-redirect-uri", "CWE-1385", "high", CODE, r"redirect_uri['\"]?\s*[:=]\s*(?:req|request|ctx|params)\b|redirect_uris?['\"]?\s*[:=]\s*\[?['\"][^'\"]*\*"),
    ("saml-signature", "CWE-347", "critical", CODE, r"(?i)want(?:Assertions|Response|AuthnResponse)Signed['\"]?\s*[:=]\s*(?:false|False)|wantMessagesSigned['\"]?\s*[:=]\s*(?:false|False)"),
    ("password-hash", "CWE-916", "high", CODE, r"(?i)(?:md5|sha1|sha256)\s*\([^)]*passw|createHash\(['\"](?:md5|sha1|sha256)['\"]\)[^\n]*passw|bcrypt\.(?:hash|genSalt|hashSync|genSaltSync)\s*\((?:[^,)]*,\s*)?[1-9]\s*[,)]"),
    ("committed-password-hash", "CWE-798", "medium", ANY, r"\$2[aby]\$\d{2}\$[./A-Za-z0-9]{53}|\$argon2(?:id|i|d)\$v=\d+\$"),
)

CLOUD = (
    ("k8s-privileged", "CWE-250", "high", YAML, r"^\s*-?\s*privileged\s*:\s*true\b"),
    ("k8s-host-namespace", "CWE-250", "high", YAML, r"^\s*-?\s*host(?:Network|PID|IPC)\s*:\s*true\b"),
    ("k8s-privesc", "CWE-269", "medium", YAML, r"^\s*-?\s*allowPrivilegeEscalation\s*:\s*true\b|^\s*-?\s*runAsUser\s*:\s*0\b"),
    ("iam-public-principal", "CWE-732", "high", TERRAFORM, r"[\"']?(?:Principal|AWS)[\"']?\s*[:=]\s*[\"']\*[\"']|\ballUsers\b|\ballAuthenticatedUsers\b"),
    ("open-ingress", "CWE-284", "high", TERRAFORM, r"(?i)(?:cidr_blocks|CidrIp|source_ranges|source_address_prefix)[\"']?\s*[:=]\s*\[?\s*[\"'](?:0\.0\.0\.0/0|\*)[\"']"),
    ("public-storage", "CWE-732", "high", TERRAFORM, r"(?i)\bacl[\"']?\s*[:=]\s*[\"']public-read(?:-write)?[\"']|block_public_(?:acls|policy)\s*=\s*false|PublicAccess[\"']?\s*[:=]\s*[\"'](?:blob|container)"),
    ("iac-unencrypted", "CWE-311", "medium", TERRAFORM, r"(?i)\b(?:storage_encrypted|encrypted|enable_disk_encryption|encryption_at_rest_enabled)[\"']?\s*[:=]\s*false\b"),
    ("iac-public-instance", "CWE-284", "medium", TERRAFORM, r"(?i)\b(?:publicly_accessible|associate_public_ip_address|PubliclyAccessible)[\"']?\s*[:=]\s*true\b"),
    ("iac-hardcoded-secret", "CWE-798", "high", r"\.tf$", r"(?i)\b\w*(?:password|secret|token|access_key)\w*\s*=\s*\"(?!\$\{|var\.|data\.|local\.)[^\"\s]{6,}\""),
    ("cloud-metadata", "CWE-918", "medium", ANY, r"169\.254\.169\.254|metadata\.google\.internal"),
)

#: Vectors of agents in CI, for workflow files that run one.
AGENT_STEP = r"(?i)uses\s*:\s*\S*(?:claude|codex|copilot|gemini|aider|openai|llm|ai-)[^\n]*|\b(?:claude|codex|aider|gemini)\s+(?:-p|--prompt|exec)\b"
CI = (
    ("A", "CWE-1427", "critical", r"(?i)prompt[^\n]*\$\{\{\s*github\.event\.(?:issue|comment|pull_request|review|head_commit)[^}]*\}\}"),
    ("B", "CWE-1427", "critical", r"(?i)^\s*\w+\s*:\s*\$\{\{\s*github\.event\.(?:issue|comment|pull_request|review)\.(?:title|body)[^}]*\}\}"),
    ("C", "CWE-1427", "high", r"(?i)\bgh\s+(?:issue|pr)\s+view\b|github\.event\.\w+\.(?:number|html_url)"),
    ("D", "CWE-1427", "critical", r"^\s*(?:-\s*)?pull_request_target\s*:?|on\s*:\s*\[?[^\n]*pull_request_target"),
    ("G", "CWE-1427", "critical", r"(?i)(?:eval|bash\s+-c|sh\s+-c|run\s*:)[^\n]*\$\{\{\s*steps\.[\w-]+\.outputs"),
    ("H", "CWE-1427", "high", r"(?i)--dangerously-skip-permissions|--yolo|danger-full-access|allowed_?tools\s*:\s*['\"]?\*|Bash\(\*\)"),
    ("I", "CWE-1427", "high", r"(?i)allow(?:ed)?_?(?:users|bots|non_write_users)\s*:\s*['\"]?\*"),
)
