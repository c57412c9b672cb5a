import random
import shutil
import subprocess

import pytest

from wardenflow.sources import history as H

pytestmark = pytest.mark.skipif(not shutil.which("git"), reason="needs git")


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    """A repository whose files are edited, moved and deleted by commits; each line's text is its own."""
    root = tmp_path_factory.mktemp("history")
    git = lambda *a: subprocess.run(["git", "-C", str(root), "-c", "user.name=n\tm", "-c", "user.email=e@x", *a], check=True, capture_output=True, text=True).stdout
    git("init", "-q")
    rng, serial = random.Random(2), iter(range(10**6))
    texts = {f"f{n}.txt": [f"@@ -{next(serial)} diff --git" if k % 9 == 0 else f"line {next(serial)}" for k in range(30)] for n in range(6)}

    def commit():
        for name, lines in texts.items():
            (root / name).parent.mkdir(parents=True, exist_ok=True)
            (root / name).write_text("".join(x + "\n" for x in lines))
        git("add", "-A"), git("commit", "-qm", "c")

    commit()
    first, start = git("rev-parse", "HEAD").strip(), {k: list(v) for k, v in texts.items()}
    moves = {2: ("f1.txt", "dir/moved one.txt"), 4: ("dir/moved one.txt", "again.txt"), 5: ("f2.txt", None), 6: ("f3.txt", "f1.txt")}
    for n in range(10):
        for name in texts:
            lines = texts[name]
            for _ in range(rng.randrange(3)):
                at = rng.randrange(len(lines))
                kind = rng.choice("idr")
                if kind == "i":
                    lines[at:at] = [f"new {next(serial)}" for _ in range(rng.randrange(1, 4))]
                elif kind == "d":
                    del lines[at : at + 2]
                else:
                    lines[at] = f"changed {next(serial)}"
        commit()
        if n in moves:
            old, new = moves[n]
            kept = texts.pop(old)
            if new:
                texts[new] = kept
                (root / new).parent.mkdir(exist_ok=True)
                git("mv", old, new)
            else:
                git("rm", "-q", old)
            git("commit", "-qm", "move")
    return root, first, start, texts


def test_lines_are_followed_over_edits_and_moves(spark, tree):
    root, first, start, texts = tree
    history = H.read_history(spark, str(root), first, chunk=20)
    places = [(f, n) for f, lines in start.items() for n in range(1, len(lines) + 1)]
    rows = H.follow(history, spark.createDataFrame(places, H.PLACE)).collect()
    assert len(rows) == len(places)
    assert {r.file: r.now for r in rows} == {"f0.txt": "f0.txt", "f1.txt": "again.txt", "f2.txt": None, "f3.txt": "f1.txt", "f4.txt": "f4.txt", "f5.txt": "f5.txt"}
    where = {(f, x): n for f, lines in texts.items() for n, x in enumerate(lines, 1)}
    for r in rows:
        text = start[r.file][r.line - 1]
        still = where.get((r.now, text))
        if still:
            assert r.now_line == still and not r.touched, r
        else:
            assert r.touched or r.now is None, r
        assert (r.last_commit is None) == (r.touched == 0)
    assert any(r.touched for r in rows) and any(r.now_line is None for r in rows if r.now)


def test_facts_and_citations_at_a_commit(spark, tree):
    root, first, start, _ = tree
    history = H.read_history(spark, str(root), first)
    findings = spark.createDataFrame([("a", "f1.txt", 1, "open"), ("b", "f2.txt", 3, "open"), ("c", None, None, "open")], "id string, file string, line int, status string")
    got = {r.id: (r.exists, r.now, r.renamed) for r in H.revalidation(findings, history).collect()}
    assert got == {"a": (True, "again.txt", True), "b": (False, None, False), "c": (None, None, None)}
    cited = spark.createDataFrame([("a", "f1.txt", 30, first, "open"), ("b", "f1.txt", 31, first, "open"), ("c", "none.txt", 1, first, "open"), ("d", "f1.txt", 1, "not a commit", "open"), ("e", "none.txt", 1, first, "dismissed"), ("f", "f1.txt", 1, None, "open")], "id string, file string, line int, at_commit string, status string")
    blobs = H.blob_sizes(spark, str(root), [(r.at_commit, r.file) for r in cited.collect()])
    assert {r.id: r.problem.split(" at ")[0] for r in H.citations_at(cited, blobs).collect()} == {"b": "no such line", "c": "no such file", "d": "no such file"}


def test_no_commit_since(spark, tree):
    root, *_ = tree
    history = H.read_history(spark, str(root), "HEAD")
    assert [tuple(r) for r in H.follow(history, spark.createDataFrame([("f0.txt", 2)], H.PLACE)).select("now", "now_line", "commits").collect()] == [("f0.txt", 2, 0)]
    with pytest.raises(ValueError, match="failed"):
        H.read_history(spark, str(root), "no-such-ref")


def test_places_of_many_files_are_folded_without_a_call_for_each(spark):
    rng, rows, want = random.Random(8), [], {}
    for f in range(40):
        name, lines = f"f{f}", {n: n for n in range(1, 41)}  # line of the older commit -> line now
        touched = dict.fromkeys(lines, 0)
        for seq in range(rng.randint(0, 5)):
            at, shift, moved = 1, 0, dict(lines)
            if rng.random() < 0.2:
                rows.append((seq, "c", 1, "x", name, name, None, None, None, None))
            while (at := at + rng.randint(0, 15)) < 60:
                b, d = rng.choice([(0, 2), (1, 0), (3, 1), (2, 4), (1, 1)])
                rows.append((seq, "c", 1, "x", name, name, at, b, at + shift + (1 if b == 0 else 0) - (1 if d == 0 else 0), d))
                for n, now in lines.items():
                    if now and b and at <= now < at + b:
                        moved[n], touched[n] = (at + shift + min(now - at, d - 1) if d else None), touched[n] + 1
                    elif now and now > (at if b == 0 else at + b - 1):
                        moved[n] += d - b
                at, shift = at + max(b, 1), shift + d - b
            lines = moved
        want |= {(name, n): (lines[n], touched[n]) for n in lines}
    rng.shuffle(rows)
    out = H.follow(spark.createDataFrame(rows, H.HUNK), spark.createDataFrame([*want, ("none", None)], H.PLACE))
    assert "CoGroup" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {(r.file, r.line): (r.now_line, r.touched) for r in out.collect()}
    assert got.pop(("none", None)) == (None, 0) and got == want
