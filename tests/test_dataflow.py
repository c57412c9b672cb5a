import pytest

from wardenflow.operators import code_detect as C
from wardenflow.operators import dataflow as D
from wardenflow.operators import graph as G
from wardenflow.sources import repo as S

EXPRESS = """const app = express();
const key = process.env.KEY;
app.get('/a', (req, res) => {
  if (req.query.a) {
    const a = req.query.a;
    exec(a);
  }
});
app.post('/b', async (req, res) => {
  exec(key);
});
"""
JAVA = """class A {
  public void doPost(HttpServletRequest request,
          HttpServletResponse response)
          throws ServletException, IOException {
    String s = "}{";  // }
    /* { */ run(s);
  }
  int other() { return 1; }
}
"""


def test_brace_units():
    assert D.units(EXPRESS.splitlines(), "javascript") == [0, 0, 3, 3, 3, 3, 3, 3, 9, 9, 9]
    assert D.units(JAVA.splitlines(), "java") == [0, 0, 0, 4, 4, 4, 4, 0, 0]  # a method on one line is not told apart
    assert D.units(["#helper() {", "}"], "javascript") == [1, 1]
    assert D.units(["# {", "#[A] function f() {", "}"], "php") == [0, 2, 2]
    assert D.units(["{"], "go") is None and D.units(["}"], "go") is None and D.units(["x"], "ruby") is None
    assert D.units(["a = 'unfinished {", "b = `{ ${x} }`;", "f('it\\'s {');"], "javascript") == [0, 0, 0]


def test_indent_units():
    code = "import os\ndef a():\n    x = 1\n\n    def b():\n        y = 2\n    # c\n    z = 3\nw = 4\nasync def c():\n    pass"
    assert D.units(code.split("\n"), "python") == [0, 2, 2, 2, 5, 5, 5, 2, 0, 10, 10]


@pytest.mark.parametrize(
    ("lines", "source", "match", "entry", "want"),
    [
        (["const id = req.query.id;", "run(id)"], 1, "req.query", 2, ("linked", ["id"])),
        (["const { a, b } = req.body;", "run(b)"], 1, "req.body", 2, ("linked", ["a", "b"])),
        (["String uid = req.getParameter(x);", "String q = f(uid);", "uid == q;", "run(q)"], 1, "req", 4, ("linked", ["q", "uid"])),
        (["const id = req.query.id;", "run(idea, my.id2)"], 1, "req.query", 2, ("unlinked", ["id"])),
        (["run(req.query.id)", "x"], 1, "req.query", 2, (None, [])),
        (["if (a == req.query.id) {", "x"], 1, "req.query", 2, (None, [])),
        (["a += req.query.id", "x(a)"], 1, "req.query", 2, (None, [])),
        (["f(req.query.id)"], 1, "req.query", 1, ("linked", [])),
        (["a = 1", "b = a"], 2, "a", 1, (None, [])),
        (["this.userId = req.body.x;", "", "go(this.userId)"], 1, "req.body", 3, ("linked", ["userId"])),
        (["x = req.body", "y"], 1, "req.body", 9, ("unlinked", ["x"])),
        (["const = req.body", "y"], 1, "req.body", 2, (None, [])),
    ],
)
def test_traces(lines, source, match, entry, want):
    assert D.trace_all(lines, [(source, match, entry)]) == [want]


def test_traces_of_a_file_do_not_mix():
    lines = ["a = req.a", "b = req.b", "c = a", "run(b)", "run(c)", "run(a)"]
    questions = [(1, "req", 4), (1, "req", 5), (2, "req", 4), (2, "req", 6), (1, "req", 6), (3, "a", 5)]
    alone = [D.trace_all(lines, [q])[0] for q in questions]
    assert D.trace_all(lines, questions) == alone
    assert [v for v, _ in alone] == ["unlinked", "linked", "linked", "unlinked", "linked", "linked"]


def test_answers(spark):
    files = spark.createDataFrame([("a.js", "javascript", EXPRESS), ("b.rb", "ruby", "x = params[1]\nrun(x)"), ("c.js", "javascript", None)], "file string, lang string, content string")
    rows = [("a.js", 5, "req.query", 6, None, None), ("a.js", 5, "req.query", 10, None, None), ("a.js", 2, "process.env", 10, None, None)]
    rows += [("b.rb", 1, "params[", 2, "f", "f"), ("b.rb", 1, "params[", 2, "f", "g"), ("b.rb", 1, "params[", 2, None, "g"), ("c.js", 1, "", 1, None, None), ("none.js", 1, "x", 2, None, None)]
    got = {(r.file, r.source_line, r.entry_line, r.source_symbol, r.entry_symbol): (r.scope, r.dataflow, r.tainted) for r in D.answers(files, spark.createDataFrame(rows + rows[:2], D.QUESTION)).collect()}
    assert got == {
        ("a.js", 5, 6, None, None): ("symbol", "linked", ["a"]),
        ("a.js", 5, 10, None, None): ("file", "unlinked", ["a"]),
        ("a.js", 2, 10, None, None): ("module", "linked", ["key"]),
        ("b.rb", 1, 2, "f", "f"): ("symbol", "linked", ["x"]),
        ("b.rb", 1, 2, "f", "g"): ("file", "linked", ["x"]),
        ("b.rb", 1, 2, None, "g"): ("module", "linked", ["x"]),
        ("c.js", 1, 1, None, None): ("module", "linked", []),
    }
    assert D.answers(files, spark.createDataFrame([], D.QUESTION)).collect() == []


def test_module_level_calls_are_frames_of_their_own(spark):
    sinks = spark.createDataFrame([("s", "A", "A#f", 9)], "sink_id string, file string, symbol string, line int")
    callers = spark.createDataFrame([("A#f", "B", None, 2), ("A#f", "B", None, 5)], "callee string, file string, symbol string, line int")
    sources = spark.createDataFrame([("B", 3, "http", "late", 4), ("B", 3, "cli", "first", 1)], "file string, line int, source string, match string, ord int")
    got = [(r.source, r.source_line, r.match, r.depth, [(h.file, h.line, h.symbol) for h in r.hops]) for r in G.taint_paths(sinks, callers, sources).collect()]
    assert got == [("cli", 3, "first", 1, [("A", 9, "A#f"), ("B", 5, None)])]


def evidence(spark, tree, **options):
    files = spark.createDataFrame([*tree.items()], "file string, content string")
    rows, _ = C.taint_evidence(S.scan_files(files), S.source_lines(files), files, **options)
    return rows


def test_scope_and_links_rank(spark):
    code = "const pool = require('pg');\napp.get('/a', (req, res) => {\n  const id = req.query.id;\n  const q = f(id);\n  pool.query(q);\n  pool.query(z);\n});\nfunction other() {\n  pool.query(id);\n}\n"
    rows = evidence(spark, {"r.js": code}).orderBy(*C.taint_order()).collect()
    assert [(r.line, r.scope, r.dataflow) for r in rows] == [(5, "symbol", "linked"), (6, "symbol", "unlinked"), (9, "file", "linked")]
    assert "not mentioned" in rows[1].message and "another function" in rows[2].message
    assert [r.line for r in evidence(spark, {"r.js": code}, strict_scope=True).orderBy("line").collect()] == [5, 6]


def test_sanitizers_of_steps_and_above_the_sink(spark):
    code = "const pool = require('pg');\nconst id = process.argv[2];\nconst n = parseInt(id);\nlog(n);\n\npool.query(n);\nNumber(1);\n"
    rows = evidence(spark, {"r.js": code}).collect()
    assert [[(s.line, s.note) for s in r.sanitizers] for r in rows] == [[(3, "type-coercion/validation present")]]
    used = C.sanitizers_in_use(S.source_lines(spark.createDataFrame([("a.js", "x?: y;\nDOMPurify(z);\n")], "file string, content string")))
    assert sorted((r.line, r.kind) for r in used.collect()) == [(2, "domxss"), (2, "xss")]


def test_ambiguous_names_need_a_link_by_import_or_call(spark):
    lib = "const pool = require('pg');\nexport function handle(id) {\n  pool.query(id);\n}\nexport function only{0}(x) {\n  return x;\n}\n"
    caller = "import x from 'somewhere';\nonlyA(1);\nconst id = process.argv[2];\nhandle(id);\n"
    tree = {"a.js": lib.replace("{0}", "A"), "b.js": lib.replace("{0}", "B"), "c.js": caller, "d.js": caller.replace("onlyA(1);", "none;")}
    assert [(r.file, r.source_file) for r in evidence(spark, tree).collect()] == [("a.js", "c.js")]
