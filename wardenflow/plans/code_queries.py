"""The code scan over sources that the driver's tables spell out: small files are written from columns, and SQL says from the columns what the scan must find."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardenflow.operators import code_detect as C
from wardenflow.operators import windows as W
from wardenflow.operators import workflows as K
from wardenflow.operators.findings import union_all
from wardenflow.operators.scans import spread
from wardenflow.plans.registry import Tables, query
from wardenflow.plans.worklists import region_worklist
from wardenflow.sources import ignore as I
from wardenflow.sources import repo as S
from wardenflow.sources import reports as P
from wardenflow.sources.frameworks import frameworks
from wardenflow.storage import cut


def written(rows: DataFrame, key: str, variants: dict[int, dict[str, str]], of: int) -> DataFrame:
    """file, content: each row's key modulo ``of`` picks the files of a variant; # in names and texts stands for the key."""
    texts = [(v, name, text) for v, files in variants.items() for name, text in files.items()]
    book = rows.sparkSession.createDataFrame(texts, "v int, name string, body string")
    keyed = rows.select(F.col(key).cast("string").alias("key"), (F.col(key) % of).cast("int").alias("v"))
    return spread(keyed).join(F.broadcast(book), "v").select(F.replace("name", F.lit("#"), F.col("key")).alias("file"), F.replace("body", F.lit("#"), F.col("key")).alias("content"))


FLOWS = {
    0: {"src/h#.js": "const pool = require('pg');\napp.get('/a', (req, res) => {\n  const id = req.query.id;\n  const q = 'select ' + id;\n  pool.query(q);\n});\n"},
    1: {"src/h#.js": "const pool = require('pg');\napp.get('/a', (req, res) => {\n  const id = req.query.id;\n  const other = fresh();\n  pool.query(other);\n});\n"},
    2: {"src/h#.js": "const pool = require('pg');\napp.get('/a', (req, res) => {\n  const id = req.query.id;\n});\nfunction run() {\n  const id = fresh();\n  pool.query(id);\n}\n"},
    3: {"src/h#.js": "const pool = require('pg');\nconst id = process.env.TARGET;\nfunction run() {\n  pool.query(id);\n}\n"},
    4: {
        "lib/l#.js": "const pool = require('pg');\nexport function find#(id) {\n  return pool.query(id);\n}\n",
        "src/h#.js": "import { find# } from '../lib/l#.js';\nfind#(0);\nconst id = process.argv[2];\nfind#(id);\n",
    },
    5: {"src/h#.js": "const pool = require('pg');\napp.get('/a', (req, res) => {\n  const id = parseInt(req.query.id);\n  pool.query(id);\n});\n"},
    6: {"src/p#.js": "const h = location.hash;\nel.innerHTML = h;\n"},
    7: {"src/h#.js": "const pool = require('pg');\npool.query(x);\nconst id = process.argv[2];\n"},
}


@query(
    "ranked_taint_paths",
    """
    with v as (select c_custkey as k, c_custkey % 8 as v from customer where c_custkey % 8 <> 7),
    p as (select k, v, case v when 4 then 'lib/l' when 6 then 'src/p' else 'src/h' end || k || '.js' as file, [5, 5, 7, 4, 3, 4, 2][v + 1] as line, case v when 6 then 'domxss' else 'sql' end as kind,
        case v when 6 then 'src/p' else 'src/h' end || k || '.js' as source_file, [3, 3, 3, 2, 3, 3, 1][v + 1] as source_line, ['http', 'http', 'http', 'env', 'cli', 'http', 'dom'][v + 1] as source,
        case when v in (0, 1, 5) then 'symbol' when v = 2 then 'file' else 'module' end as scope, case v when 1 then 'unlinked' else 'linked' end as dataflow, case v when 0 then 'id,q' when 6 then 'h' else 'id' end as tainted,
        case v when 5 then '3 type-coercion/validation present' else '' end as sanitizers, case v when 4 then 3 else 2 end as steps, v = 4 as cross_file from v),
    i as (select *, substr(sha256(source_file || ':' || source_line || ':' || file || ':' || line || ':' || kind), 1, 12) as id from p)
    select id, file, line, kind, source, source_file, source_line, scope, dataflow, tainted, sanitizers, steps, cross_file,
        row_number() over (order by case scope when 'symbol' then 1 when 'module' then 2 else 3 end, dataflow = 'unlinked', steps, cross_file desc, id) as position from i
    """,
)
def ranked_taint_paths(t: Tables):  # G1, G6-G9, X17, T1, J2-J4, J6, F1-F3, F5, F28, S2
    files = cut(written(t.customer, "c_custkey", FLOWS, 8), "written")
    rows, _ = C.taint_evidence(cut(S.scan_files(files), "scan"), S.source_lines(files), files)
    sorts = {f"o{n}": c for n, c in enumerate(C.taint_order())}
    rows = rows.withColumns({n: c for n, c in sorts.items() if n != "o4"}).withColumn("o4", ~F.col("cross_file"))
    noted = F.array_join(F.transform(F.coalesce("sanitizers", F.array().cast("array<struct<file:string,line:int,note:string>>")), lambda x: F.concat_ws(" ", x["line"], x["note"])), ";")
    rows = W.numbered(rows.withColumns({"sanitizers": noted, "tainted": F.array_join("tainted", ",")}), [f"o{n}" for n in range(6)])
    return rows.select("id", "file", "line", "kind", "source", "source_file", "source_line", "scope", "dataflow", "tainted", "sanitizers", "steps", "cross_file", "position")


# --- detectors, one file for each row ----------------------------------------------------------------------------------


def _files(t: Tables, variants: dict[int, dict[str, str]]) -> DataFrame:
    return written(t.part, "p_partkey", variants, len(variants))


def _cases(*rows: tuple[int, str]) -> str:
    """SQL: for parts whose key falls on a variant, the columns that the variant gives."""
    of, parts = rows[0][0], rows[1:]
    return " union all ".join(f"select {columns} from (select cast(p_partkey as varchar) as k, p_partkey % {of} as v from part) where v = {v}" for v, columns in parts)


SYMBOLS = {
    0: {"m#.py": "import os\n\ndef outer(a):\n    def inner(b):\n        return b\n    return inner(a)\n\nclass Box:\n    pass\n"},
    1: {"m#.js": "import x from './x';\nexport function go(a) {\n  if (a) {\n    run(a);\n  }\n}\nconst hidden = (b) => {\n  return b;\n};\n"},
    2: {"m#.go": "package m\n\nfunc Open(a int) int {\n\treturn close(a)\n}\n\nfunc close(a int) int {\n\treturn a\n}\n"},
    3: {"m#.txt": "def nothing():\n    pass\n"},
}


@query(
    "scanned_symbols",
    _cases(
        (4,), (0, "'m' || k || '.py' as file, 'python' as lang, 'outer' as name, 'function' as kind, 3 as line, 6 as \"end\", true as exported"), (0, "'m' || k || '.py', 'python', 'inner', 'function', 4, 5, true"), (0, "'m' || k || '.py', 'python', 'Box', 'class', 8, 9, true"),
        (1, "'m' || k || '.js', 'javascript', 'go', 'function', 2, 6, true"), (1, "'m' || k || '.js', 'javascript', 'hidden', 'function', 7, 9, false"), (2, "'m' || k || '.go', 'go', 'Open', 'function', 3, 5, true"), (2, "'m' || k || '.go', 'go', 'close', 'function', 7, 9, false"),
    ),
)
def scanned_symbols(t: Tables):  # S2, F6
    return S.exploded(S.scan_files(_files(t, SYMBOLS)))["symbols"].select("file", "lang", "name", "kind", "line", "end", "exported")


@query(
    "scanned_calls",
    _cases((4,), (0, "'m' || k || '.py' as file, 'inner' as callee, 6 as line, 'os' as imports, true as from_cache"), (1, "'m' || k || '.js', 'run', 4, './x', false"), (2, "'m' || k || '.go', 'close', 4, '', false")),
)
def scanned_calls(t: Tables):  # S2, S3: the Python files are taken from a cache of an earlier scan
    files = _files(t, SYMBOLS)
    old = cut(S.scan_files(files.filter("file like '%.py'")).withColumn("imports", F.transform("imports", lambda x: F.concat(x))), "cache")
    marked = old.withColumn("imports", F.array_append("imports", F.lit("cached")))  # what a second extraction would not say
    scan = S.scan_files(files, marked)
    calls = scan.select("file", F.array_join(F.array_remove("imports", "cached"), ",").alias("imports"), F.array_contains("imports", "cached").alias("from_cache"), F.explode("calls").alias("c"))
    return calls.select("file", "c.callee", "c.line", "imports", "from_cache")


SINKS = {
    0: {"s#.py": "import subprocess\nsubprocess.run(cmd)\n"},
    1: {"s#.py": "def run(x):\n    return x\nrun(1)\n"},
    2: {"s#.py": "import json\nrun(1)\n"},
    3: {"s#.py": "run(1)\n"},
    4: {"s#.js": "const cp = require('child_process');\ncp.exec(x);\nwindow.open(u);\n"},
    5: {"s#.c": "strcpy(a, b);\n"},
    6: {"S#.java": "import javax.servlet.http;\nres.addCookie(c);\nKeyGenerator.getInstance(a);\n"},
    7: {"s#.js": "el.innerHTML = h;\nel.innerHTML = 'fixed';\na.href = b;\n<div v-html=\"x\">\n"},
}


@query(
    "call_sinks_found",
    _cases(
        (8,), (0, "'s' || k || '.py' as file, 2 as line, 'run' as callee, 'subprocess' as receiver, 'command' as kind, 'CWE-78' as cwe, 'critical' as severity"), (3, "'s' || k || '.py', 1, 'run', null, 'command', 'CWE-78', 'medium'"),
        (4, "'s' || k || '.js', 2, 'exec', 'cp', 'command', 'CWE-78', 'critical'"), (4, "'s' || k || '.js', 3, 'open', 'window', 'redirect', 'CWE-601', 'medium'"), (5, "'s' || k || '.c', 1, 'strcpy', null, 'buffer', 'CWE-120', 'high'"),
        (6, "'S' || k || '.java', 2, 'addCookie', 'res', 'cookie', 'CWE-614', 'medium'"), (6, "'S' || k || '.java', 3, 'getInstance', 'KeyGenerator', 'crypto', 'CWE-327', 'medium'"),
    ),
)
def call_sinks_found(t: Tables):  # receivers, modules, shadowed and ambiguous names
    return C.call_sinks(S.scan_files(_files(t, SINKS)))


@query("text_sinks_found", _cases((8,), (7, "'s' || k || '.js' as file, 1 as line, 'domxss' as kind, 'high' as severity, 'h;' as assigned"), (7, "'s' || k || '.js', 3, 'domxss', 'medium', 'b;'"), (7, "'s' || k || '.js', 4, 'domxss', 'high', '\"x\">'")))
def text_sinks_found(t: Tables):  # F2, X16
    files = _files(t, SINKS).withColumn("lang", S.language(F.col("file")))
    lines = S.source_lines(files).join(files.select("file", "lang"), "file")
    return C.text_sinks(lines).select("file", "line", "kind", "severity", "assigned")


INPUTS = {
    0: {"i#.js": "const a = req.query.x, b = process.env.Y;\nwindow.name;\n"},
    1: {"tests/i#.js": "const a = req.query.x;\n"},
    2: {"i#.py": "x = request.args\ny = input()\n"},
    3: {"pages/api/i#.js": "module.exports = 1;\nconst a = req.body;\n", "pages/api/j#.js": "const a = req.body;\n"},
    4: {"I#.java": "String s = req.getParameter(a);\n"},
    5: {"i#.sh": "echo $1\nread -r name\necho $HOME\n"},
}


@query(
    "inputs_found",
    _cases(
        (6,), (0, "'i' || k || '.js' as file, 1 as line, 'http' as source"), (0, "'i' || k || '.js', 1, 'env'"), (0, "'i' || k || '.js', 2, 'dom'"), (2, "'i' || k || '.py', 1, 'http'"), (2, "'i' || k || '.py', 2, 'stdin'"),
        (3, "'pages/api/i' || k || '.js', 1, 'http'"), (3, "'pages/api/i' || k || '.js', 2, 'http'"), (3, "'pages/api/j' || k || '.js', 1, 'http'"), (4, "'I' || k || '.java', 1, 'http'"), (5, "'i' || k || '.sh', 1, 'cli'"), (5, "'i' || k || '.sh', 2, 'cli'"),
    ),
)
def inputs_found(t: Tables):  # by rule, by place; tests are none
    files = _files(t, INPUTS).withColumn("lang", S.language(F.col("file")))
    lines = S.source_lines(files).join(files.select("file", "lang"), "file")
    seen = C.sources(lines)
    return seen.unionByName(C.route_entries(lines, seen).select("file", "line", "source"))


AUDITED = {
    0: {"w#.js": "res.setHeader('Access-Control-Allow-Origin', '*');\nres.setHeader('Access-Control-Allow-Credentials', 'true');\n"},
    1: {"w#.js": "res.cookie('a', f(b), {\n  maxAge: g(1),\n  httpOnly: true, secure: true,\n  path: '/' });\n"},
    2: {"w#.js": "res.cookie('a', f(b), {\n  maxAge: g(1),\n  httpOnly: true, secure: true,\n  sameSite: 'lax' });\n"},
    3: {"a#.js": "jwt.verify(t, key, { algorithms: ['none'] });\nconst u = 'response_type=code';\n"},
    4: {"k#.yaml": "apiVersion: v1\nkind: Pod\nspec:\n  hostNetwork: true\n      privileged: true\n"},
    5: {"k#.yaml": "privileged: true\n"},
    6: {"n#.tf": 'ingress {\n  cidr_blocks = ["0.0.0.0/0"]\n}\negress {\n  cidr_blocks = ["0.0.0.0/0"]\n}\n'},
    7: {"b#.toml": 'url = "amqp://user:s3cr3tvalue@host:5672"\nother = "amqp://user:${PASSWORD}@host"\n'},
}


@query(
    "audits_found",
    _cases(
        (8,), (0, "'w' || k || '.js' as file, 1 as line, 'cors-wildcard-credentials' as kind, 'high' as severity, 'CWE-942' as cwe"), (1, "'w' || k || '.js', 1, 'cookie-samesite', 'low', 'CWE-1275'"),
        (3, "'a' || k || '.js', 1, 'jwt-alg-none', 'critical', 'CWE-347'"), (3, "'a' || k || '.js', 2, 'oauth-state-pkce', 'medium', 'CWE-352'"), (4, "'k' || k || '.yaml', 4, 'k8s-host-namespace', 'high', 'CWE-250'"), (4, "'k' || k || '.yaml', 5, 'k8s-privileged', 'high', 'CWE-250'"),
        (6, "'n' || k || '.tf', 2, 'open-ingress', 'high', 'CWE-284'"), (7, "'b' || k || '.toml', 1, 'credential-uri', 'high', 'CWE-798'"),
    ),
)
def audits_found(t: Tables):  # F8-F10, F12, W11, X18: cookie arguments over lines, manifests, egress blocks, placeholders
    lines = cut(S.source_lines(_files(t, AUDITED)), "lines")
    return union_all(C.audit_web(lines), C.audit_auth(lines), C.audit_cloud(lines), C.credential_uris(lines)).select("file", "line", "kind", "severity", "cwe")


FLOW_HEAD = "jobs:\n  a:\n    env:\n      TITLE: ${{ github.event.issue.title }}\n    steps:\n      - id: ai\n        uses: openai/codex-action@v1\n        with:\n"
WORKFLOWS = {
    0: {".github/workflows/f#.yml": FLOW_HEAD + "          prompt: |\n            read this\n\n            $TITLE\n          allowed_bots: '*'\n"},
    1: {".github/workflows/f#.yml": FLOW_HEAD + "          prompt: fix ${{ github.event.issue.body }}\n      - run: eval ${{ steps.ai.outputs.x }}\n      - run: eval ${{ steps.no.outputs.x }}\n"},
    2: {".github/workflows/f#.yml": FLOW_HEAD + "          prompt: >-\n            gh pr view 3\n          mode: --yolo\n"},
    3: {".github/workflows/f#.yml": "on:\n  pull_request_target:\njobs:\n  a:\n    steps:\n      - uses: actions/checkout@v4\n        with:\n          ref: ${{ github.head_ref }}\n          prompt: ${{ github.head_ref }}\n"},
    4: {"docs/f#.yml": FLOW_HEAD + "          prompt: $TITLE\n"},
}


@query("workflow_vectors", _cases((5,), *[(v, f"'.github/workflows/f' || k || '.yml' as file, {n} as line, '{x}' as vector") for v, n, x in ((0, 9, "A"), (0, 13, "I"), (1, 9, "B"), (1, 10, "G"), (2, 9, "C"), (2, 11, "H"), (3, 8, "D"))]))
def workflow_vectors(t: Tables):  # F11
    return K.vectors(S.source_lines(_files(t, WORKFLOWS))).select("file", "line", "vector")


LOGGED = {
    0: {"l#.js": "logger.info(password);\nlogger.info(count);\nlog(password);\n"},
    1: {"l#.py": "import logging\nlogging.error(api_key)\nlogging.debug('ok')\n"},
    2: {"l#.go": 'log.Printf("%s", token)\nfmt.Println(token)\n'},
}


@query("sensitive_log_calls", "with p as (" + _cases((3,), (0, "'l' || k || '.js' as file, 1 as line"), (1, "'l' || k || '.py', 2"), (2, "'l' || k || '.go', 1")) + "), n as (select *, row_number() over (order by substr(sha256('engine:sensitive-log:' || file || ':' || line), 1, 12)) as r, count(*) over () - 25 as left_out from p) select file, line, left_out from n where r <= 25")
def sensitive_log_calls(t: Tables):  # F13, T3: the first of all by rank, and how many were left out
    files = cut(_files(t, LOGGED), "logged")
    found, left = C.sensitive_logs(cut(S.scan_files(files), "scan"), S.source_lines(files), 25)
    return found.select("file", "line", F.lit(left).cast("long").alias("left_out"))


HANDLERS = {
    0: {"h#.js": "function open(req, res) {\n  res.end(1);\n}\nfunction closed(req, res) {\n  requireAuth(req);\n  res.end(2);\n}\n"},
    1: {"h#.js": "requireAuth(app);\nrun(1);\n"},
    2: {"h#.py": "def outer(request):\n    def inner(request):\n        return 1\n    login_required(inner)\n    return inner\n"},
}


@query(
    "guarded_handlers",
    _cases((3,), (0, "'h' || k || '.js' as file, 1 as line, 'open' as handler, false as guarded, false as file_scoped"), (0, "'h' || k || '.js', 4, 'closed', true, false"), (1, "'h' || k || '.js', 2, null, true, true"), (2, "'h' || k || '.py', 1, 'outer', true, false"), (2, "'h' || k || '.py', 2, 'inner', false, false")),
)
def guarded_handlers(t: Tables):  # J4, J5, J7, A18, A13
    files = cut(_files(t, HANDLERS), "handlers")
    places = F.when(F.col("file").endswith(".py"), F.array(F.lit(1), F.lit(2))).when(F.col("content").startswith("requireAuth"), F.array(F.lit(2))).otherwise(F.array(F.lit(1), F.lit(4)))
    return C.guard_matrix(cut(S.scan_files(files), "scan"), cut(S.source_lines(files), "lines"), files.select("file", F.explode(places).alias("line")))


@query(
    "nested_ignore",
    """
    with f as (select p_partkey as k, 'pkg' || (p_size % 10) as pkg, p_size, ['a.log', 'keep.log', 'src/b.js', 'out/c.js', 'src/out/d.log', 'only.txt'] as names from part), e as (select k, pkg, p_size, unnest(names) as name from f)
    select distinct pkg || '/p' || k || '/' || name as file from e
    where case when name in ('out/c.js', 'src/out/d.log') then true when name = 'only.txt' then pkg = 'pkg3' when name = 'keep.log' then pkg in ('pkg4', 'pkg5') when name like '%.log' then pkg <> 'pkg2' else false end
    """,
)
def nested_ignore(t: Tables):  # rules of a folder take back or add to those above; nothing comes back under a folder that is out
    spark = t.spark
    names = F.array(*[F.lit(x) for x in ("a.log", "keep.log", "src/b.js", "out/c.js", "src/out/d.log", "only.txt")])
    paths = t.part.select("p_partkey", "p_size", F.explode(names).alias("name")).select(F.concat(F.lit("pkg"), F.col("p_size") % 10, F.lit("/p"), "p_partkey", F.lit("/"), "name").alias("file"))
    files = [(".gitignore", "*.log\n!keep.log\nout/\n"), ("pkg2/.gitignore", "# take all back\n!*.log\n!out/c.js\n"), ("pkg3/.gitignore", "/*/only.txt\n"), ("pkg4/.gitignore", "*.log"), ("pkg5/.gitignore", "!a.log\n*.log\n")]
    return I.ignored(paths, I.ignore_rules(spark.createDataFrame(files, "file string, content string")))


@query(
    "owners_by_rule",
    """
    with r as (select o_orderkey as ord, 'src/c' || o_custkey as folder, o_orderkey % 3 as kind, '@t' || o_orderkey as team from orders)
    select l_orderkey, l_suppkey, coalesce(max(case when kind = 0 then ord end), -1) as by_folder, max(ord) as by_any from (select distinct l_orderkey, l_suppkey from lineitem where l_linenumber = 1) l
    left join r on r.folder = 'src/c' || l.l_suppkey and (kind = 0 or (kind = 1 and l_orderkey % 2 = 0)) group by all
    """,
)
def owners_by_rule(t: Tables):  # S23, J12: a rule for each order, looked up by a path's own folders
    kind, folder = F.col("o_orderkey") % 3, F.concat(F.lit("/src/c"), "o_custkey")
    text = F.when(kind == 0, F.concat(folder, F.lit("/ @t"), "o_orderkey")).when(kind == 1, F.concat(folder, F.lit("/*.js @t"), "o_orderkey")).otherwise(F.concat(folder, F.lit("/nothing @t"), "o_orderkey"))
    rules = cut(I.owner_rules(t.orders.select(F.col("o_orderkey").alias("ord"), text.alias("text"))), "rules")
    paths = t.lineitem.filter("l_linenumber = 1").select("l_orderkey", "l_suppkey").distinct()
    paths = paths.withColumn("file", F.concat(F.lit("src/c"), "l_suppkey", F.when(F.col("l_orderkey") % 2 == 0, "/f.js").otherwise("/f.py")))
    number = lambda c: F.substring(F.get(c, F.lit(0)), 3, 20).cast("long")
    every = I.owned(paths, rules).withColumn("by_any", number("owners")).drop("owners")
    out = I.owned(every, rules.filter("pattern not like '%js%'")).withColumn("by_folder", F.coalesce(number("owners"), F.lit(-1)))
    return out.select("l_orderkey", "l_suppkey", "by_folder", "by_any")


@query(
    "manifest_dirs",
    "with d as (select distinct 'a' || (p_size % 7) || case when p_partkey % 4 = 0 then '/b/c/d' when p_partkey % 4 = 1 then '/b' else '' end as folder from part where p_partkey % 2 = 0 or p_partkey % 4 = 1) select folder, len(string_split(folder, '/')) as depth from d where len(string_split(folder, '/')) <= 3",
)
def manifest_dirs(t: Tables):  # S4
    k = F.col("p_partkey") % 4
    folder = F.concat(F.lit("a"), F.col("p_size") % 7, F.when(k == 0, "/b/c/d").when(k == 1, "/b").otherwise(""))
    name = F.when((F.col("p_partkey") % 2 == 0) | (k == 1), "package.json").otherwise("readme.md")
    return S.manifest_folders(t.part.select(F.concat(folder, F.lit("/"), name).alias("file")), ["package.json", "go.mod"]).select("folder", "depth")


@query(
    "region_worklists",
    """
    with s as (select 'r' || (p_size % 5) as region, 'r' || (p_size % 5) || '/f' || p_partkey as file, p_size as score from part),
    f as (select region, string_agg(file, ',' order by score desc, file) as files from (select *, row_number() over (partition by region order by score desc, file) as k from s) where k <= 8 group by 1),
    l as (select distinct region, 'c' || c_custkey as claim from (select c_custkey, 'r' || (c_custkey % 9) || '/f' || (c_custkey % 100) as at from customer where c_custkey % 10 = 0) c join s on starts_with(s.file, c.at))
    select f.region, f.files, coalesce((select string_agg(claim, ',' order by claim) from l where l.region = f.region), '') as leads from f
    """,
)
def region_worklists(t: Tables):  # L5, W7, J19: leads by the beginnings of paths
    region = F.concat(F.lit("r"), F.col("p_size") % 5)
    surface = t.part.select(region.alias("region"), F.concat(region, F.lit("/f"), "p_partkey").alias("file"), F.col("p_size").alias("score"))
    c = F.col("c_custkey")
    leads = t.customer.filter(c % 10 == 0).select(F.concat(F.lit("r"), c % 9, F.lit("/f"), c % 100, F.lit(":7")).alias("at"), F.concat(F.lit("c"), c).alias("claim"))
    none = t.spark.createDataFrame([], "from string, to string")
    return region_worklist(surface, none, leads).select("region", F.array_join("files", ",").alias("files"), F.coalesce(F.array_join("leads", ","), F.lit("")).alias("leads"))


# --- scanner reports, one for each row -----------------------------------------------------------------------------------

REPORTS = {
    0: {"r/trivy/#.json": '{"Results":[{"Target":"a#.lock","Vulnerabilities":[{"VulnerabilityID":"CVE-2024-#","PkgName":"p#","InstalledVersion":"1","Severity":"HIGH","Title":"t","CweIDs":["CWE-79"]}],"Secrets":[{"RuleID":"key","Title":"k","Severity":"CRITICAL","StartLine":4}]}]}'},
    1: {"r/osv-scanner/#.json": '{"results":[{"source":{"path":"o#.lock"},"packages":[{"package":{"name":"p#","version":"2"},"vulnerabilities":[{"id":"GHSA-#","aliases":["CVE-2024-#"],"summary":"s"}],"groups":[{"ids":["GHSA-#"],"max_severity":"9.8"}]}]}]}'},
    2: {"r/grype/#.json": '{"matches":[{"vulnerability":{"id":"CVE-2024-#","severity":"Unknown","description":"d","cvss":[{"metrics":{"baseScore":5.0}}]},"relatedVulnerabilities":[{"id":"GHSA-x"}],"artifact":{"name":"p#","version":"3","locations":[{"path":"g#.jar"}]}}]}'},
    3: {"r/npm-audit/#.json": '{"vulnerabilities":{"p#":{"name":"p#","severity":"high","via":[{"source":#,"name":"p#","title":"t","url":"https://github.com/advisories/GHSA-#","severity":"critical","cwe":["CWE-20"],"range":"<2"},"other"]}}}'},
    4: {"r/pip-audit/#.json": '{"dependencies":[{"name":"p#","version":"4","vulns":[{"id":"PYSEC-#","aliases":["CVE-2024-#"],"description":"d"}]},{"name":"q","version":"1","vulns":[]}]}'},
    5: {"r/cargo-audit/#.json": '{"vulnerabilities":{"list":[{"advisory":{"id":"RUSTSEC-#","title":"t","cvss":"CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H","aliases":[]},"package":{"name":"p#","version":"5"}}]},"warnings":{"unmaintained":[{"kind":"unmaintained","advisory":{"id":"RUSTSEC-W#","title":"w"},"package":{"name":"w#","version":"1"}}]}}'},
    6: {"r/govulncheck/#.json": '{"osv":{"id":"GO-#","summary":"s","aliases":["CVE-2024-#"]}}\n{"finding":{"osv":"GO-#","trace":[{"module":"m#","version":"v1","function":"F"},{"position":{"filename":"m#.go","line":7}}]}}'},
    7: {"r/package-checker/#.txt": "p#@1.0\n@s/p#@2.0\nnot a package\n"},
    8: {"r/semgrep/#.json": '{"results":[{"check_id":"c","path":"s#.py","start":{"line":3},"extra":{"severity":"ERROR","message":"m","metadata":{"cwe":["CWE-78: os"]}}}]}'},
    9: {"r/bandit/#.json": '{"results":[{"test_id":"B1","test_name":"n","issue_severity":"LOW","issue_confidence":"HIGH","issue_text":"x","filename":"b#.py","line_number":9,"issue_cwe":{"id":78}}]}'},
    10: {"r/gosec/#.json": '{"Issues":[{"severity":"MEDIUM","confidence":"LOW","cwe":{"id":"327"},"rule_id":"G4","details":"d","file":"g#.go","line":"12-14"}]}'},
    11: {"r/cppcheck/#.txt": "c#.c\t5\terror\tnullPointer\tNull\nnoise\n"},
    12: {"r/checkov/#.json": '[{"results":{"failed_checks":[{"check_id":"CKV_1","check_name":"n","file_path":"/k#.tf","file_line_range":[2,4],"severity":"HIGH"}]}}]'},
    13: {"r/hadolint/#.json": '[{"file":"d#/Dockerfile","line":1,"level":"style","code":"DL1","message":"m"}]'},
    14: {"r/gitleaks/#.json": '[{"RuleID":"aws","Description":"d","File":"l#.env","StartLine":2,"Commit":""}]'},
    15: {"r/trufflehog/#.jsonl": '{"DetectorName":"AWS","Verified":true,"SourceMetadata":{"Data":{"Filesystem":{"file":"t#.env","line":2}}}}\n{"level":"info"}\n'},
    16: {"r/sarif/#.sarif": '{"runs":[{"tool":{"driver":{"rules":[{"id":"r1","shortDescription":{"text":"t"},"properties":{"security-severity":"8.1","tags":["external/cwe/cwe-089"]}}]}},"results":[{"ruleId":"r1","level":"note","message":{"text":"m"},"locations":[{"physicalLocation":{"artifactLocation":{"uri":"f#.js"},"region":{"startLine":8}}}]}]}]}'},
    17: {"r/agent-export/#.json": '[{"slug":"sql-injection","title":"t","severity":"High","confidence":"Medium","file":"e#.js","line":6,"reasoning":"why"},{"slug":"x","title":"no place"}]'},
    18: {"r/trivy/b#.json": '{"Results": [{"Target": '},
    19: {"r/bandit/e#.json": "  \n"},
    20: {"r/own-tool.#.json": "{}"},
    21: {"guarddog.#.json": '{"package":"p#","results":{"exec-base64":"found","empty":"{}"}}'},
}
N = len(REPORTS)


@query(
    "report_findings",
    _cases(
        (N,), (0, "'trivy' as tool, 'dep' as category, 'high' as severity, 'a' || k || '.lock' as file, 1 as line, 'p' || k as pkg, '1' as version, 'CWE-79' as cwe, case when length(k) >= 4 then 'CVE-2024-' || k end as cve"), (0, "'trivy', 'secret', 'critical', 'a' || k || '.lock', 4, null, null, null, null"),
        (1, "'osv-scanner', 'dep', 'critical', 'o' || k || '.lock', 1, 'p' || k, '2', null, case when length(k) >= 4 then 'CVE-2024-' || k end"), (2, "'grype', 'dep', 'medium', 'g' || k || '.jar', 1, 'p' || k, '3', null, case when length(k) >= 4 then 'CVE-2024-' || k end"),
        (3, "'npm-audit', 'dep', 'critical', null, null, 'p' || k, '<2', 'CWE-20', null"), (4, "'pip-audit', 'dep', 'medium', null, null, 'p' || k, '4', null, case when length(k) >= 4 then 'CVE-2024-' || k end"),
        (5, "'cargo-audit', 'dep', 'critical', null, null, 'p' || k, '5', null, null"), (5, "'cargo-audit', 'dep', 'low', null, null, 'w' || k, '1', null, null"), (6, "'govulncheck', 'dep', 'high', 'm' || k || '.go', 7, 'm' || k, 'v1', null, case when length(k) >= 4 then 'CVE-2024-' || k end"),
        (7, "'package-checker', 'dep', 'critical', null, null, 'p' || k, '1.0', 'CWE-506', null"), (7, "'package-checker', 'dep', 'critical', null, null, '@s/p' || k, '2.0', 'CWE-506', null"), (8, "'semgrep', 'sast', 'high', 's' || k || '.py', 3, null, null, 'CWE-78', null"),
        (9, "'bandit', 'sast', 'low', 'b' || k || '.py', 9, null, null, 'CWE-78', null"), (10, "'gosec', 'sast', 'medium', 'g' || k || '.go', 12, null, null, 'CWE-327', null"), (11, "'cppcheck', 'sast', 'high', 'c' || k || '.c', 5, null, null, 'CWE-476', null"),
        (12, "'checkov', 'config', 'high', 'k' || k || '.tf', 2, null, null, null, null"), (13, "'hadolint', 'config', 'info', 'd' || k || '/Dockerfile', 1, null, null, null, null"), (14, "'gitleaks', 'secret', 'high', 'l' || k || '.env', 2, null, null, null, null"),
        (15, "'trufflehog', 'secret', 'critical', 't' || k || '.env', 3, null, null, null, null"), (16, "'sarif', 'sast', 'high', 'f' || k || '.js', 8, null, null, 'CWE-089', null"), (17, "'import', 'sast', 'high', 'e' || k || '.js', 6, null, null, null, null"),
        (21, "'guarddog', 'dep', 'high', null, null, 'p' || k, null, 'CWE-506', null"),
    ),
)
def report_findings(t: Tables):  # S14-S18, J20: reports of all kinds, some broken, some empty
    found, _ = P.report_findings(_reports(t))
    return found.select("tool", "category", "severity", "file", "line", "pkg", "version", "cwe", "cve")


def _reports(t: Tables) -> DataFrame:
    return cut(P.with_tool(_files(t, REPORTS).withColumnRenamed("file", "report")), "reports")


@query("report_status", f"select case p_partkey % {N} when 18 then 'broken' when 19 then 'empty' when 20 then 'unknown' else 'read' end as status, count(*) as n, count(distinct case when p_partkey % {N} in (0, 18) then 'trivy' when p_partkey % {N} in (9, 19) then 'bandit' else cast(p_partkey % {N} as varchar) end) as tools from part group by 1")
def report_status(t: Tables):  # S14, A16
    return P.status(_reports(t)).groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("tool").alias("tools"))


MANIFESTS = {
    0: {"a/#/package.json": '{"dependencies":{"express":"4","left-pad":"1"},"devDependencies":{"jsonwebtoken":"9"},"peerDependencies":{"react":"*","express":"5"}}'},
    1: {"a/#/package.json": '{"dependencies": '},
    2: {"a/#/requirements.txt": "Flask==2\nmyflask\nsqlalchemy-utils\n", "a/#/notes.txt": "django"},
    3: {"a/#/Cargo.toml": "[dependencies]\n  axum = 1\n# rocket = 2\nnotwarp = 1\n"},
    4: {"a/#/go.mod": "require github.com/gorilla/mux v1\nrequire gorm.io/gorm v2\n", "a/#/pom.xml": "<groupId>org.SpringFramework</groupId>"},
    5: {"a/b/c/#/Gemfile": "gem 'rails'\n"},
}


@query(
    "frameworks_found",
    _cases((6,), *[(v, f"'a/' || k || '/{f}' as file, '{x}' as framework") for v, f, x in ((0, "package.json", "express"), (0, "package.json", "jwt"), (0, "package.json", "react"), (2, "requirements.txt", "flask"), (2, "requirements.txt", "sqlalchemy"), (3, "Cargo.toml", "axum"), (4, "go.mod", "gorilla/mux"), (4, "go.mod", "gorm"), (4, "pom.xml", "spring"))]),
)
def frameworks_found(t: Tables):  # S27: by keys and by texts; folders too deep and broken files name none
    return frameworks(_files(t, MANIFESTS))


@query("first_files_of_tree", "with f as (select 'd' || (p_partkey % 13) || '/f' || p_partkey as file from part) select file, true as truncated from (select *, row_number() over (order by file) as k from f) where k <= 120")
def first_files_of_tree(t: Tables):  # S1: the walk's limit, in order of paths, and that it was reached
    kept, more = I.first_files(t.part.select(F.concat(F.lit("d"), F.col("p_partkey") % 13, F.lit("/f"), "p_partkey").alias("file")), 120)
    return kept.withColumn("truncated", F.lit(more))


SAFE = {
    0: {"c#.js": "const a = shlex.quote(x);\nconst b = path.resolve(y);\n"},
    1: {"c#.js": "const q = 'a = ?';\nconst c = DOMPurify.sanitize(h);\n"},
    2: {"c#.js": "const n = parseInt(s);\nconst t = plain(s);\n"},
}


@query("sanitizers_in_use", _cases((3,), (0, "'c' || k || '.js' as file, 1 as line, 'command' as kind"), (0, "'c' || k || '.js', 2, 'path'"), (1, "'c' || k || '.js', 2, 'xss'"), (1, "'c' || k || '.js', 2, 'domxss'"), (2, "'c' || k || '.js', 1, '*'")))
def sanitizers_in_use(t: Tables):  # rules that only mean something on a sink's line say nothing here
    return C.sanitizers_in_use(S.source_lines(_files(t, SAFE))).select("file", "line", "kind")


@query(
    "guard_groups",
    _cases((3,), (0, "'h' || k || '.js' as file, 1 as line, 'open' as handler, 'http' as kinds, 1 as reads, false as guarded"), (0, "'h' || k || '.js', 4, 'closed', 'http', 1, true"), (2, "'h' || k || '.py', 1, 'outer', 'http', 1, true"), (2, "'h' || k || '.py', 2, 'inner', 'http', 1, false")),
)
def guard_groups(t: Tables):  # A18
    files = cut(_files(t, HANDLERS).withColumn("lang", S.language(F.col("file"))), "handlers")
    lines = cut(S.source_lines(files).join(files.select("file", "lang"), "file"), "lines")
    reads = cut(C.sources(lines), "reads")
    matrix = C.guard_matrix(cut(S.scan_files(files.drop("lang")), "scan"), lines, reads.select("file", "line").distinct())
    return C.guard_groups(matrix, reads).withColumn("kinds", F.array_join("kinds", ","))
