"""Rules over source code: dangerous calls and assignments, inputs, routes, sanitizers, languages. Fixed values throughout."""

LANGUAGES = {
    "javascript": "js jsx mjs cjs ts tsx mts cts", "python": "py pyi", "go": "go", "java": "java", "ruby": "rb", "php": "php", "rust": "rs",
    "c_cpp": "c h cc cpp cxx hpp hh hxx", "csharp": "cs", "kotlin": "kt kts", "swift": "swift", "scala": "scala sc", "shell": "sh bash zsh", "lua": "lua", "elixir": "ex exs",
}

#: kind, class, severity, languages, callees, receivers, modules, flags (A: ambiguous, R: receiver required); in order, the first that matches counts.
CALL_SINKS = (
    ("sql", "CWE-89", "high", "javascript python go java php ruby rust csharp kotlin scala", "query execute executeQuery executemany raw queryRaw unsafe exec_query prepareStatement prepareCall executeUpdate executeLargeUpdate addBatch nativeSQL createQuery createNativeQuery", "", "", ""),
    ("command", "CWE-78", "critical", "*", "execSync spawnSync shell_exec passthru proc_open popen Popen check_output check_call ProcessBuilder getRuntime", "child_process childProcess cp subprocess os Runtime shell shelljs getRuntime runtime", "", ""),
    ("command", "CWE-78", "critical", "javascript", "exec spawn", "child_process childProcess cp shell shelljs execa sh zx", "child_process execa shelljs cross-spawn node-pty zx sudo-prompt shell-exec", "A"),
    ("command", "CWE-78", "critical", "python", "run call system", "subprocess os commands sp", "subprocess os pexpect invoke plumbum", "A"),
    ("command", "CWE-78", "critical", "php", "exec system", "", "", ""),
    ("command", "CWE-78", "critical", "ruby c_cpp lua", "system", "", "", ""),
    ("command", "CWE-78", "critical", "ruby go rust java kotlin scala csharp c_cpp elixir swift", "exec spawn run Command output Start", "Runtime runtime exec Kernel Open3 Process Command os shell System", "os/exec std::process java.lang.Runtime open3 System.Diagnostics", "A"),
    ("redos", "CWE-1333", "medium", "javascript go java csharp", "RegExp MustCompile", "", "", ""),
    ("redos", "CWE-1333", "medium", "python java php ruby javascript", "compile Pattern", "re regexp regex Pattern preg regex2", "", "R"),
    ("code", "CWE-94", "high", "*", "eval Function runInThisContext runInContext compile execfile", "", "", ""),
    ("redirect", "CWE-601", "medium", "javascript", "open", "window globalThis self top parent", "", "R"),
    ("path", "CWE-22", "high", "*", "readFile readFileSync writeFile writeFileSync createReadStream createWriteStream sendFile unlink open readdir appendFile extractall extract unzip extractAll File FileInputStream FileOutputStream FileReader FileWriter RandomAccessFile newInputStream newOutputStream newBufferedReader", "", "", ""),
    ("ssrf", "CWE-918", "high", "*", "fetch request urlopen urlretrieve got axios openConnection", "", "", ""),
    ("ssrf", "CWE-918", "high", "*", "get post put patch head delete request Get Post Head PostForm", "axios http https got superagent fetch session client httpClient requests httpx urllib urllib2 unirest Unirest", "", "R"),
    ("xss", "CWE-79", "medium", "javascript python php ruby", "send write end html render_template_string writeHead", "res response resp w", "", ""),
    ("xss", "CWE-79", "medium", "java kotlin scala", "println print write append printf", "", "javax.servlet jakarta.servlet springframework.web javax.ws.rs jakarta.ws.rs", ""),
    ("crypto", "CWE-327", "medium", "java kotlin scala csharp", "getInstance", "Cipher KeyGenerator SecretKeyFactory KeyPairGenerator Signature", "", "R"),
    ("crypto", "CWE-328", "medium", "java kotlin scala csharp", "getInstance", "MessageDigest Mac", "", "R"),
    ("trustboundary", "CWE-501", "medium", "java kotlin scala", "setAttribute putValue", "", "", ""),
    ("cookie", "CWE-614", "medium", "java kotlin scala", "addCookie", "", "", ""),
    ("deserialize", "CWE-502", "high", "*", "loads load unserialize deserialize readObject load_yaml full_load", "pickle yaml marshal cPickle ObjectInputStream", "", ""),
    ("crypto", "CWE-327", "medium", "*", "md5 sha1 createCipher DES RC4", "", "", ""),
    ("redirect", "CWE-601", "medium", "javascript python php ruby", "redirect", "res response resp", "", ""),
    ("nosql", "CWE-943", "high", "javascript python", "find findOne findOneAndUpdate findOneAndDelete updateOne deleteOne aggregate mapReduce distinct", "db collection coll Model model User users mongo mongoose repo repository", "", ""),
    ("ssti", "CWE-1336", "high", "*", "from_string renderString compileString Template createTemplate renderTemplate", "", "", ""),
    ("xxe", "CWE-611", "high", "*", "parseString parseXml parseFromString fromstring SAXParser DocumentBuilder XMLReader createDocument", "", "", ""),
    ("ldap", "CWE-90", "high", "*", "search bind searchSync", "ldap ldapClient ldapjs client conn connection ld idc ctx dirContext dctx ic", "ldap activedirectory unboundid novell.ldap javax.naming jakarta.naming", "R"),
    ("ldap", "CWE-90", "high", "java kotlin scala", "search bind", "idc dirContext dctx ldapContext initialDirContext dirCtx", "", "R"),
    ("random", "CWE-330", "low", "*", "Random nextInt nextFloat nextDouble nextLong mt_rand randint randrange shuffle", "", "", ""),
    ("random", "CWE-330", "low", "*", "random", "Math random rng np", "", "R"),
    ("crlf", "CWE-93", "medium", "javascript python java go php ruby", "setHeader header addHeader setRequestHeader putHeader", "res response resp w headers", "", ""),
    ("proto", "CWE-1321", "high", "javascript", "merge mergeWith extend defaultsDeep setWith set", "_ lodash $ jQuery angular Object util", "", ""),
    ("buffer", "CWE-120", "high", "c_cpp", "strcpy strcat sprintf gets memcpy stpcpy vsprintf", "", "", ""),
    ("argv", "CWE-88", "high", "*", "execFile execFileSync execv execve execvp posix_spawn CreateProcess", "", "", ""),
    ("reflect", "CWE-470", "medium", "*", "getattr setattr forName import_module __import__ newInstance getMethod getDeclaredMethod CreateInstance", "", "", ""),
    ("xpath", "CWE-643", "high", "*", "selectNodes selectSingleNode xpath xpath_eval compile_xpath XPathSelect evaluate", "xpath XPath xp xPath xpathObj doc document tree root xml node", "", "R"),
    ("massassign", "CWE-915", "medium", "javascript python ruby php java", "setAttributes bulkCreate fill update_attributes populate assign_attributes", "", "", ""),
    ("csv", "CWE-1236", "medium", "*", "writerow writerows to_csv fputcsv writeRecords csvStringify", "", "", ""),
    ("llm", "CWE-1427", "high", "*", "create invoke run predict complete generate generate_content chat send_message stream", "completions messages chat llm model client openai anthropic agent chain genai", "openai anthropic langchain llamaindex generativeai genai bedrock ollama mistralai cohere @ai-sdk", "R"),
)

#: Opt-in: calls that write logs.
LOG_SINKS = (
    ("log", "CWE-117", "low", "javascript", "info warn error debug log trace", "console logger log winston pino bunyan", "", "R"),
    ("log", "CWE-117", "low", "python", "info warning error debug critical exception log", "logging logger log", "", "R"),
    ("log", "CWE-117", "low", "go", "Print Printf Println Fatal Fatalf Info Error Warn Debug", "log logger slog zap logrus", "", "R"),
    ("log", "CWE-117", "low", "ruby", "info warn error debug fatal", "logger Rails.logger log", "", "R"),
    ("log", "CWE-117", "low", "php", "error_log", "", "", ""),
    ("log", "CWE-117", "low", "php", "info warning error debug notice", "Log logger $logger", "", "R"),
)

#: kind, class, severity, languages, pattern, whether the assigned value must not be constant.
TEXT_SINKS = (
    ("domxss", "CWE-79", "high", "javascript", r"\.\s*(?:innerHTML|outerHTML)\s*(?:\+)?=(?!=)", True),
    ("domxss", "CWE-79", "high", "javascript", r"dangerouslySetInnerHTML\s*=|\bv-html\s*=|\[innerHTML\]\s*=", False),
    ("domxss", "CWE-79", "medium", "javascript", r"\.\s*(?:src|href|action|formaction|srcdoc)\s*=(?!=)", True),
)

#: kind, languages, pattern.
SOURCES = (
    ("http", "javascript", r"(?<![\w.])req(?:uest)?\s*\.\s*(?:query|body|rawBody|params|headers|cookies|method|url|originalUrl|hostname|ip|files|file)\b"),
    ("ws", "javascript", r"\.on\s*\(\s*['\"](?:message|data)['\"]"),
    ("http", "javascript", r"\bctx\s*\.\s*(?:request|query|params|body)\b"),
    ("http", "javascript", r"\(\s*(?:req|request)\w*\s*(?::[^,)]+)?\s*,\s*_?(?:res|response|reply)\w*\s*(?::[^,)]+)?\s*[,)]"),
    ("http", "javascript python ruby", r"\(\s*event\s*(?::[^,)]+)?\s*,\s*_?(?:context|ctx|callback)\s*(?::[^,)]+)?\s*[,)]"),
    ("http", "go", r"\(\s*\w+\s+http\.ResponseWriter\s*,\s*\w+\s+\*http\.Request\s*\)"),
    ("http", "java kotlin scala csharp", r"\b(?:HttpServletRequest|HttpRequest|HttpRequestMessage|ServerRequest)\s+\w+"),
    ("http", "python", r"\bdef\s+\w+\s*\(\s*(?:self\s*,\s*|cls\s*,\s*)?request\b"),
    ("http", "python", r"(?<![\w.])request\s*\.\s*(?:args|form|values|json|data|files|cookies|headers|GET|POST)\b"),
    ("http", "php", r"\$_(?:GET|POST|REQUEST|COOKIE|SERVER|FILES)\b"),
    ("http", "java kotlin scala", r"\.get(?:Parameter(?:Values|Map|Names)?|Headers?|HeaderNames|QueryString|Cookies|InputStream|Reader|RequestURI|RequestURL|PathInfo|PathTranslated|RemoteUser|RemoteAddr|RemoteHost|RequestedSessionId|Parts?)\s*\("),
    ("http", "java kotlin scala", r"\b\w*[Cc]ookie\w*\s*\.\s*getValue\s*\("),
    ("http", "ruby", r"(?<![\w.])params\s*\["),
    ("http", "go", r"\br\s*\.\s*(?:URL|FormValue|PostFormValue|Header)\b"),
    ("cli", "javascript", r"\bprocess\.argv\b"),
    ("cli", "python", r"\bsys\.argv\b"),
    ("cli", "go", r"\bos\.Args\b"),
    ("env", "javascript", r"\bprocess\.env\b"),
    ("env", "python", r"\bos\.(?:environ|getenv)\b"),
    ("env", "*", r"\bgetenv\s*\("),
    ("stdin", "python", r"\binput\s*\("),
    ("dom", "javascript", r"\blocation\s*\.\s*(?:hash|search|href|pathname|host|hostname)\b|\bdocument\s*\.\s*(?:URL|documentURI|referrer|baseURI)\b|\bwindow\s*\.\s*name\b"),
    ("dom", "javascript", r"\bnew\s+URLSearchParams\s*\(|\bdocument\s*\.\s*cookie\b"),
    ("dom", "javascript", r"\b(?:localStorage|sessionStorage)\s*\.\s*getItem\s*\(|\bhistory\s*\.\s*state\b"),
    ("postmessage", "javascript", r"\b(?:event|e|msg|ev)\s*\.\s*data\b"),
    ("http", "java kotlin scala", r"@(?:RequestParam|PathVariable|RequestBody|RequestHeader|CookieValue|ModelAttribute|MatrixVariable)\b"),
    ("http", "java kotlin", r"\bcall\s*\.\s*(?:receive|parameters|request)\b"),
    ("http", "csharp", r"\bRequest\s*\.\s*(?:Query|Form|Headers|Cookies|Body|QueryString|Params|RouteValues)\b|\[From(?:Body|Query|Route|Form|Header)\]"),
    ("http", "rust", r"\b(?:Query|Path|Json|Form)\s*<|\bweb\s*::\s*(?:Query|Path|Json|Form)\b"),
    ("http", "elixir", r"\bconn\s*\.\s*(?:params|body_params|query_params|path_params|req_headers)\b"),
    ("http", "go", r"\bc\s*\.\s*(?:Param|Query|PostForm|DefaultQuery|GetHeader|ShouldBind|ShouldBindJSON|BindJSON|FormValue)\s*\("),
    ("http", "go", r"\bmux\s*\.\s*Vars\s*\(|\bchi\s*\.\s*URLParam\s*\("),
    ("http", "php", r"\$request\s*->\s*(?:input|query|get|post|all|json|header|cookie|file)\s*\("),
    ("http", "python", r"\b(?:Query|Body|Form|Path|Header|Cookie|File|UploadFile)\s*\(\s*(?:\.\.\.|None|default)"),
    ("http", "python", r"\brequest\s*\.\s*(?:query_params|path_params|body|stream|form\b)"),
    ("http", "javascript", r"@(?:Body|Query|Param|Headers|UploadedFile)\s*\("),
    ("http", "javascript", r"\b(?:searchParams|nextUrl)\s*\.\s*get\s*\(|\bawait\s+(?:req|request)\s*\.\s*(?:json|formData|text)\s*\("),
    ("http", "swift", r"\bURLComponents\b[\s\S]{0,40}\bqueryItems\b|\breq\s*\.\s*(?:parameters|query|content)\b"),
    ("cli", "shell", r"\$\{?(?:[1-9]|@|\*)\b|\bread\s+(?:-[rp]\s+)*[A-Za-z_]"),
    ("cli", "java kotlin scala csharp", r"\b(?:static\s+(?:void|int)\s+[Mm]ain|fun\s+main|def\s+main)\s*\("),
    ("cli", "rust", r"\benv\s*::\s*args\s*\("),
    ("llm", "*", r"\bchoices\s*\[\s*0\s*\]\s*\.\s*message\b|\.\s*(?:completion|generated_text|output_text)\b|\bmessage\s*\.\s*content\b|\bresponse\s*\.\s*(?:text|content|output)\b"),
    ("llm", "*", r"\b(?:llm|chain|agent|model)\s*\.\s*(?:invoke|run|predict|generate|complete)\s*\("),
)

#: Files that are entry points by their place: path pattern, pattern of the declaring line (None: the first line).
VERBS = r"^\s*export\s+(?:async\s+)?(?:function\s+)?(?:const\s+)?(GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS|ALL|default)\b"
ROUTES = (
    (r"(^|/)pages/api/.*\.(js|jsx|ts|tsx|mjs|cjs)$", None),
    (r"(^|/)app/(.*/)?route\.(js|ts|jsx|tsx)$", VERBS),
    (r"(^|/)server/(api|routes)/.*\.(js|ts)$", None),
    (r"(^|/)routes/(.*/)?\+server\.(js|ts)$", VERBS),
    (r"(^|/)routes/(.*/)?(\+page\.server|[^/]*\.server)\.(js|ts)$", None),
    (r"^api/.*\.(js|ts|py|go|rb)$|(^|/)netlify/functions/.*\.(js|ts)$|(^|/)functions/.*\.(js|ts)$", None),
    (r"(^|/)handler\.(js|ts|py|rb)$|(^|/)lambda_function\.py$|(^|/)[^/]*_handler\.py$", None),
    (r"(^|/)app/controllers/.*\.rb$|(^|/)controllers/.*\.(js|ts|php|py|rb)$", None),
    (r"Controller\.(java|kt|cs|php|ts)$|_controller\.rb$", None),
    (r"(^|/)(views|urls|routes)\.py$", None),
    (r"(^|/)(public|web|htdocs|www|public_html)/.*\.php$", r"^\s*<\?php"),
)

#: What makes a value safe: kind of sink ('*' for any), pattern, note, whether it says something of a sink's own line only.
SANITIZERS = (
    ("sql", r"\?|\$\d+|:\w+|%s|@\w+", "looks parameterized (placeholder present)", True),
    ("command", r"\bexecFile\b|\bexecvp?\b|shlex\.quote|escapeshellarg", "argv-array / quoting present", False),
    ("path", r"\bbasename\b|\brealpath\b|secure_filename|path\.resolve|startsWith\(", "path-confinement helper present", False),
    ("xss", r"\bescape[A-Z]?\w*\b|sanitize|DOMPurify|bleach|markupsafe|\bxss[A-Za-z]*\b", "escaping/sanitizer present", False),
    ("deserialize", r"safe_load|safeLoad|JSON\.parse", "safe loader present", False),
    ("nosql", r"mongo-?[sS]anitize|sanitizeFilter|\$eq\b", "operator-stripping sanitizer present", False),
    ("xxe", r"resolve_entities\s*=\s*False|feature_external_ges|FEATURE_SECURE_PROCESSING|noent\s*=\s*False|XMLConstants", "external-entity resolution disabled", False),
    ("ldap", r"ldap\.escape|escapeDN|escapeFilter|escape_filter_chars", "LDAP escaping present", False),
    ("crlf", r"encodeURIComponent|stripCRLF|replace\(\s*/[^/]*[\\]r", "CR/LF stripping present", False),
    ("proto", r"__proto__|Object\.freeze|Object\.create\(\s*null|hasOwnProperty|structuredClone", "prototype-pollution guard present", False),
    ("ssti", r"autoescape|markupsafe|\|\s*e\b|escape\(", "template autoescaping present", False),
    ("domxss", r"DOMPurify|\bsanitizeHtml\b|createPolicy|textContent\s*=|\bescapeHtml\b", "HTML sanitizer / Trusted Types policy present", False),
    ("argv", r"startsWith\(\s*['\"]-|\breplace\(\s*/\^-|\ballowlist\b|\ballowList\b|--\s*['\"]?\s*,", "option-injection guard present (leading '-' rejected or `--` terminator)", False),
    ("redos", r"\bRE2\b|re2|\bescapeRegExp\b|\bescape_string\b|timeout", "linear-time engine or pattern escaping present", False),
    ("reflect", r"\bALLOWED\b|allowlist|allowList|\bin\s+\{|\bMap\s*\(|hasOwnProperty|\bdict\s*\[", "allow-list lookup present", False),
    ("xpath", r"setXPathVariable|XPathVariableResolver|\bbindVariable\b|\$\w+", "XPath variable binding present", True),
    ("massassign", r"\bpick\b|\bfillable\b|\bpermit\b|\bonly\s*\(|\bwhitelist\b|\bz\.object|Joi\.object", "explicit field allow-list present", False),
    ("csv", r"startsWith\(\s*['\"][=+\-@]|\bescapeFormula\b|\bsanitizeCell\b|['\"]'\s*\+", "formula-prefix neutralization present", False),
    ("llm", r"\ballowed_tools\b|\btool_choice\b|\ballowlist\b|\bschema\b|\bz\.object|\bJSON\.parse\b|\bvalidate\b", "output constrained (schema / tool allow-list) — the only control that holds for this class", False),
    ("*", r"\bparseInt\b|\bNumber\(|\bInteger\.parse|validator\.|\bz\.|Joi\.|\bisInt\b|\bUUID\b", "type-coercion/validation present", False),
)

#: Checks of a handler's caller.
AUTH_MARKERS = r"(?i)\b(requireAuth|isAuthenticated|authenticate|authorize|login_required|permission_required|PreAuthorize|Authorize|verifyToken|ensureLoggedIn|current_user|getServerSession|jwt_required|before_action)\b"

#: Names of values that must not be logged.
SENSITIVE_NAMES = r"(?i)\b\w*(password|passwd|secret|token|api_?key|credential|private_?key|ssn|card_?number|cvv|session_?id|authorization)\w*\b"
