import re
import shutil
import subprocess

import pytest
from pyspark.sql import functions as F

from wardenflow.operators import workflows as W
from wardenflow.sources import ignore as I
from wardenflow.sources import repo as S

IGNORES = {
    ".gitignore": "*.log\n!keep.log\n/top/\nbuild/\ndocs/*.md\n# c\n\\#odd\na/**/z.txt\nq?.c\n[xy].h\n  \n",
    "pkg/.gitignore": "!special.log\nlocal.txt\n/only.js\nsub/\n",
    "pkg/sub2/.gitignore": "!local.txt\n*\n!good.js\n",
}
PATHS = """a.log keep.log x/keep.log x/b.log top/a.js x/top/a.js build/a.js x/build/keep.log x/build docs/a.md docs/b/c.md #odd a/z.txt a/b/c/z.txt b/z.txt q1.c q12.c x.h z.h
pkg/special.log special.log pkg/local.txt pkg/x/local.txt pkg/only.js pkg/x/only.js pkg/sub/a.js pkg/sub2/local.txt pkg/sub2/good.js pkg/sub2/bad.js pkg/sub2/deep/good.js x.js""".split()


def files(spark, tree):
    return spark.createDataFrame([*tree.items()], "file string, content string")


@pytest.mark.skipif(not shutil.which("git"), reason="git is the judge")
def test_nested_ignore_files_as_git_has_them(spark, tmp_path):
    for name, text in (IGNORES | dict.fromkeys([p for p in PATHS if p != "x/build"], "")).items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    subprocess.run(["git", "-C", str(tmp_path), "init", "-q"], check=True)
    kept = subprocess.run(["git", "-C", str(tmp_path), "ls-files", "-o", "--exclude-standard", "-z"], check=True, capture_output=True, text=True).stdout.split("\0")
    tree = files(spark, IGNORES | dict.fromkeys([p for p in PATHS if p != "x/build"], ""))
    assert {r.file for r in I.not_ignored(tree).collect()} == {p for p in kept if p}


def test_a_nested_rule_takes_back(spark):
    rules = I.ignore_rules(files(spark, {".gitignore": "*.log", "a/.gitignore": "!*.log"}))
    paths = spark.createDataFrame([("x.log",), ("a/x.log",), ("b/x.log",)], "file string")
    assert {r.file for r in I.ignored(paths, rules).collect()} == {"x.log", "b/x.log"}


def test_first_files(spark):
    tree = files(spark, dict.fromkeys("cab", ""))
    kept, more = I.first_files(tree, 2)
    assert [r.file for r in kept.collect()] == ["a", "b"] and more
    assert not I.first_files(tree, 3)[1]


def test_owners_by_the_last_rule(spark):
    text = "* @all\n*.md @docs # c\n/src/ @src\nsrc/api/*.js @api @x\nlib/**/t?.py @t\n/src/one.js\n/src/one.js @one\n"
    lines = spark.createDataFrame([*enumerate(text.split("\n"))], "ord int, text string")
    paths = {"a.md": ["@docs"], "x/src/a.js": ["@all"], "src/a.md": ["@src"], "src/api/a.js": ["@api", "@x"], "src/api/b/a.js": ["@src"], "lib/a/b/t1.py": ["@t"], "src/one.js": ["@one"], "lib/t12.py": ["@all"]}
    rows = spark.createDataFrame([(p,) for p in paths], "file string")
    assert {r.file: r.owners for r in I.owned(rows, I.owner_rules(lines)).collect()} == paths


def brute_ends(indents):
    out = []
    for n, k in enumerate(indents):
        later = [m for m in range(n + 1, len(indents)) if indents[m] is not None and k is not None and indents[m] <= k]
        out.append(n + 1 if k is None else later[0] if later else len(indents))
    return out


@pytest.mark.parametrize("indents", [[], [0], [0, 2, 4, 2, 0], [4, None, 6, None, None, 4, 2], [2, 2, 2], [0, None]])
def test_block_ends(indents):
    assert W.block_ends(indents) == brute_ends(indents)


FLOW = """on:
  pull_request_target:
jobs:
  a:
    env:
      TITLE: ${{ github.event.issue.title }}
      SAFE: ${{ github.sha }}
    steps:
      - uses: actions/checkout@v4
        with:
          ref: ${{ github.event.pull_request.head.sha }}
      - name: agent
        id: ai
        uses: anthropics/claude-code-action@v1
        with:
          prompt: |
            Look at it.

            Then $TITLE
          allowed_bots: '*'
          claude_args: --dangerously-skip-permissions
      - id: other
        run: echo
      - run: eval "${{ steps.ai.outputs.result }}"
      - run: eval "${{ steps.other.outputs.result }}"
      - uses: openai/codex-action@v1
        with:
          prompt: fix ${{ github.event.issue.body }}
          instructions: >-
            gh issue view 1
          query: ${{ env.TITLE }} and $SAFE
          message: nothing
"""


def test_vectors_by_block(spark):
    lines = S.source_lines(files(spark, {".github/workflows/a.yml": FLOW, "docs/a.yml": FLOW, ".github/workflows/plain.yml": "on: push\nsteps:\n  - run: gh pr view\n    prompt: ${{ github.head_ref }}\n"}))
    got = sorted((r.line, r.vector) for r in W.vectors(lines).collect())
    assert got == [(11, "D"), (16, "A"), (20, "I"), (21, "H"), (24, "G"), (28, "B"), (29, "C"), (31, "A")]
    found = W.audit_workflows(lines).filter("line = 16").first()
    assert found.severity == "critical" and "TITLE bound at line 6" in found.message and found.cwe == "CWE-1427"


def test_workflows_without_lines(spark):
    assert W.vectors(spark.createDataFrame([], "file string, line int, text string")).collect() == []


def test_the_scan_takes_ignore_files_owners_and_context(spark):
    from wardenflow.plans.scan import scan_tree

    bad = "const pool = require('pg');\nconst id = process.argv[2];\npool.query(id);\n"
    tree = files(spark, {".gitignore": "gen/\n", "gen/a.js": bad, "src/a.js": bad})
    report = scan_tree(tree, gitignore=True, owners="* @all\n/src/ @src\n", context="Exposure: internet\n")
    plain = scan_tree(tree)
    assert [(r.file, r.owners) for r in report.findings.collect()] == [("src/a.js", ["@src"])]
    assert {r.file for r in plain.findings.collect()} == {"src/a.js", "gen/a.js"}


def test_many_paths_are_never_broadcast(spark):
    rules = I.ignore_rules(spark.createDataFrame([(".gitignore", "*.log\n")], "file string, content string"))
    paths = spark.range(3).select(F.explode(F.array(F.lit("a/b.log"), F.lit("a/c.js"))).alias("file"))
    for book in (rules, rules.crossJoin(spark.range(10_001)).drop("id")):
        out = I.ignored(paths, book)
        sides = re.findall(r"BroadcastHashJoin.*Build(\w+)", out._jdf.queryExecution().executedPlan().toString())
        assert sides == (["Right"] if book is rules else [])
        assert [r.file for r in out.collect()] == ["a/b.log"]
