import pytest

from wardenflow.operators import code_detect as C
from wardenflow.plans.scan import scan_tree
from wardenflow.sources import repo as S

TREE = {
    "src/routes.js": "const db = require('./db');\nfunction list(req, res) {\n  const id = req.query.id;\n  db.findUser(id);\n}\nmodule.exports = { list };\nexports.list = list;\n",
    "src/db.js": "const pool = require('pg');\nexports.findUser = findUser;\nfunction findUser(id) {\n  return pool.query('select * from t where id = ' + id);\n}\n",
    "src/page.js": "const h = location.hash;\nel.innerHTML = h;\nel.innerHTML = 'fixed';\n",
    "src/safe.js": "function total(a) {\n  return a + 1;\n}\n",
    "src/shell.py": "import os\n\ndef handler(event, context):\n    name = event['name']\n    os.system('ls ' + name)\n",
    "src/local.py": "def run(x):\n    return x\n\nrun(1)\n",
    "node_modules/x/index.js": "eval(location.hash)\n",
}


def files(spark, tree):
    return spark.createDataFrame([*tree.items()], "file string, content string")


def test_read_tree(spark, tmp_path):
    for name, text in TREE.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    (tmp_path / "src/blob.js").write_bytes(b"a\0b")
    (tmp_path / "src/skip").mkdir()
    (tmp_path / "src/skip/a.js").write_text("x")
    got = {r.file for r in S.read_tree(spark, str(tmp_path), ["src/skip/**"]).collect()}
    assert got == {n for n in TREE if not n.startswith("node_modules")}


@pytest.mark.parametrize(("glob", "path", "match"), [("*.log", "a/b.log", True), ("/a/*.js", "a/b.js", True), ("a/*.js", "a/b/c.js", False), ("a/**/c.{js,ts}", "a/x/y/c.ts", True), ("doc?", "x/docs/a", True)])
def test_globs(spark, glob, path, match):
    import re

    assert bool(re.search(S.glob_pattern(glob), path)) == match


def test_last_ignore_rule_wins(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("a.log",), ("keep.log",), ("b.txt",)], "file string")
    got = {r.file: r.x for r in df.select("file", S.ignored_by(F.col("file"), ["# c", "*.log", "!keep.log"]).alias("x")).collect()}
    assert got == {"a.log": True, "keep.log": False, "b.txt": False}


def test_scan_finds_a_path_over_files(spark):
    tree = {k: v for k, v in TREE.items() if not k.startswith("node_modules")}
    report = scan_tree(files(spark, tree))
    rows = report.findings.collect()
    by = {(r.kind, r.file) for r in rows if r.category == "taint"}
    assert ("sql", "src/db.js") in by and ("domxss", "src/page.js") in by and ("command", "src/shell.py") in by
    assert not any(f == "src/safe.js" for _, f in by)
    assert [r.line for r in rows if r.kind == "domxss"] == [2]
    sql = next(r for r in rows if r.kind == "sql")
    assert "src/routes.js" in sql.message and sql.risk == 48


def test_ambiguous_and_shadowed_calls(spark):
    tree = {"a.py": "def run(x):\n    return x\nrun(1)\n", "b.py": "import subprocess\nsubprocess.run(cmd)\n", "c.py": "import json\nrun(1)\n", "d.py": "run(1)\n"}
    got = {(r.file, r.severity) for r in C.call_sinks(S.scan_files(files(spark, tree))).collect() if r.kind == "command"}
    assert got == {("b.py", "critical"), ("d.py", "medium")}


def test_cache_skips_known_files(spark):
    tree = {"a.py": "x = eval(y)\n", "b.py": "import os\n"}
    first = S.scan_files(files(spark, tree))
    again = S.scan_files(files(spark, tree | {"b.py": "import sys\n"}), cache=first)
    assert {r.file: r.imports for r in again.collect()} == {"a.py": [], "b.py": ["sys"]}


AUDITS = {
    "web.js": "res.setHeader('Access-Control-Allow-Origin', '*');\nres.setHeader('Access-Control-Allow-Credentials', 'true');\nres.cookie('a', b, { httpOnly: false, secure: false });\nconst o = { rejectUnauthorized: false };\n",
    "safe.js": "res.cookie('a', b, { httpOnly: true, secure: true, sameSite: 'lax' });\n",
    "auth.js": "jwt.verify(t, key, { algorithms: ['none'] });\nconst u = 'response_type=code';\nbcrypt.hash(p, 4);\n",
    "pod.yaml": "apiVersion: v1\nkind: Pod\nspec:\n  hostNetwork: true\n  containers:\n  - securityContext:\n      privileged: true\n",
    "values.yaml": "privileged: true\n",
    "net.tf": 'ingress {\n  cidr_blocks = ["0.0.0.0/0"]\n}\negress {\n  cidr_blocks = ["0.0.0.0/0"]\n}\n',
    "iam.json": '{"Action": "*", "Resource": "*"}\n',
    ".github/workflows/ai.yml": "on: [pull_request_target]\njobs:\n  a:\n    steps:\n    - uses: some/claude-action@v1\n      with:\n        prompt: fix ${{ github.event.issue.body }}\n",
    ".github/workflows/ci.yml": "on: [pull_request_target]\n",
    "broker.toml": 'url = "amqp://user:s3cr3tvalue@host:5672"\n',
    "setup.md": "postgres://user:${PASSWORD}@host/db and redis://u:<pass>@h\n",
}


def test_audits(spark):
    lines = S.source_lines(files(spark, AUDITS))
    found = lambda df: {(r.file, r.kind) for r in df.collect()}
    web = found(C.audit_web(lines))
    assert {("web.js", k) for k in ("cors-wildcard-credentials", "cookie-httponly", "cookie-secure", "cookie-samesite", "tls-verify")} <= web
    assert ("web.js", "cors-wildcard") not in web and not any(f == "safe.js" for f, _ in web)
    assert {("auth.js", "jwt-alg-none"), ("auth.js", "oauth-state-pkce"), ("auth.js", "password-hash")} <= found(C.audit_auth(lines))
    cloud = C.audit_cloud(lines).collect()
    assert {(r.file, r.kind) for r in cloud} == {("pod.yaml", "k8s-privileged"), ("pod.yaml", "k8s-host-namespace"), ("net.tf", "open-ingress"), ("iam.json", "iam-wildcard")}
    assert [r.line for r in cloud if r.kind == "open-ingress"] == [2]
    assert found(C.audit_ci(lines)) == {(".github/workflows/ai.yml", "agent-ci-A"), (".github/workflows/ai.yml", "agent-ci-D")}
    assert found(C.credential_uris(lines)) == {("broker.toml", "credential-uri")}


def test_units_and_def_use(spark):
    code = "function a(req) {\n  const x = req.query.q;\n  const y = x + 1;\n  db.query(y);\n  db.query(z);\n}\n"
    rows = spark.createDataFrame([("1", code, 2, 4), ("2", code, 2, 5), ("3", "read(q);\nuse(q)", 1, 2)], "id string, content string, source_line int, sink_line int")
    assert {r.id: r.verdict for r in C.def_use(rows).collect()} == {"1": "linked", "2": "unlinked", "3": None}
    f = spark.createDataFrame([("a.js", "javascript", code), ("b.js", "javascript", "{")], "file string, lang string, content string")
    assert {(r.file, r.unit) for r in C.unit_map(f).collect()} == {("a.js", 1), ("b.js", None)}


def test_guards_and_log_hygiene(spark):
    tree = {"h.js": "app.get('/a', function open1(req, res) {\n  res.send(1);\n});\nfunction closed(req, res) {\n  requireAuth(req);\n}\n", "log.js": "logger.info(password);\nlogger.info(count);\nlog(password);\n"}
    fs = files(spark, tree)
    lines, scan = S.source_lines(fs), S.scan_files(fs)
    handlers = spark.createDataFrame([("h.js", 4)], "file string, line int")
    assert [r.guarded for r in C.guard_matrix(scan, lines, handlers).collect()] == [True]
    found, left = C.sensitive_logs(scan, lines)
    assert [(r.file, r.line) for r in found.collect()] == [("log.js", 1)] and left == 0
