"""A repository's history as relations (S20-S22, X27, L3, F25): one log and one batch of blobs are read, places are followed by joins.

``read_history`` runs git once and gives a row for each hunk of each file of each commit, oldest first. Where a path of an
older commit stands now follows from chains of renames, and where a line stands from the hunks of its file in order:
the places of a file and its hunks meet by a join and are folded by column expressions, so that a file costs no call of Python.
"""

from __future__ import annotations

import re
import subprocess
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardenflow.storage import cut

HUNK = "seq int, commit string, at long, author string, old string, new string, old_start int, old_n int, new_start int, new_n int"
COMMIT = r"^[0-9a-f]{7,40}$"


def parse_log(lines: Iterator[str]) -> Iterator[tuple]:
    """Rows of HUNK from ``git log -p -U0`` with a header of NUL, hash, time and author; a file without hunks has one row."""
    seq, commit, old, new, told, hunks = -1, (None, None, None), None, None, False, 0

    def whole() -> Iterator[tuple]:
        if told and not hunks:
            yield (seq, *commit, old, new, None, None, None, None)

    left = 0  # lines of a hunk that are still to come; they may look like headers
    for line in lines:
        if left:
            left -= not line.startswith("\\")
            continue
        if line.startswith("\0"):
            yield from whole()
            h, at, author = line[1:].rstrip("\n").split("\t", 2)
            seq, commit, told = seq + 1, (h, int(at), author), False
        elif line.startswith("diff --git "):
            yield from whole()
            m = re.match(r"diff --git a/(.*) b/(.*)$", line.rstrip("\n"))
            old, new, told, hunks = m[1], m[2], True, 0
        elif line.startswith("new file mode"):
            old = None
        elif line.startswith("deleted file mode"):
            new = None
        elif line.startswith("rename from "):
            old = line[12:].rstrip("\n")
        elif line.startswith("rename to "):
            new = line[10:].rstrip("\n")
        elif m := re.match(r"@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@", line):
            a, b, c, d = int(m[1]), int(m[2] or 1), int(m[3]), int(m[4] or 1)
            hunks, left = hunks + 1, b + d
            yield (seq, *commit, old, new, a, b, c, d)
    yield from whole()


def read_history(spark: SparkSession, repo: str, since: str, chunk: int = 200_000) -> DataFrame:  # S22
    """HUNK rows of the commits after ``since`` on the way to HEAD, from one run of git; parts of ``chunk`` rows are written as they come."""
    command = ["git", "-C", repo, "-c", "core.quotePath=false", "log", "--reverse", "--first-parent", "-m", "-M", "-p", "-U0", "--no-color", "--no-ext-diff", "--format=%x00%H%x09%at%x09%an", f"{since}..HEAD"]
    parts, rows = [], []
    with subprocess.Popen(command, stdout=subprocess.PIPE, text=True, errors="replace") as git:
        for row in parse_log(git.stdout):
            rows.append(row)
            if len(rows) == chunk:
                parts.append(cut(spark.createDataFrame(rows, HUNK), "history"))
                rows = []
    if git.returncode:
        raise ValueError(f"git log {since}..HEAD failed in {repo}")
    out = spark.createDataFrame(rows, HUNK)
    for p in parts:
        out = out.unionByName(p)
    return cut(out, "history")


def chains(history: DataFrame, files: DataFrame, file: str = "file") -> DataFrame:  # X27
    """file, path, from_seq, to_seq: under which path each file is to be found after ``from_seq`` and up to ``to_seq``.

    A path is NULL once its file is deleted. Each round follows one rename of every chain at once.
    """
    moves = history.select("seq", "old", "new").distinct().filter("old is not null and not (old <=> new)")
    now = files.select(F.col(file).alias("file")).distinct().withColumns({"path": F.col("file"), "from_seq": F.lit(-1)})
    done = None
    while True:
        m = moves.select(F.col("seq").alias("m_seq"), "old", F.col("new").alias("next"))
        met = now.join(m, (F.col("path") == F.col("old")) & (F.col("m_seq") > F.col("from_seq")), "left")
        step = cut(met.groupBy("file", "path", "from_seq").agg(F.min("m_seq").alias("to_seq"), F.min_by("next", "m_seq").alias("next")), "chains")
        part = step.select("file", "path", "from_seq", "to_seq")
        done = part if done is None else done.unionByName(part)
        moved = step.filter("to_seq is not null")
        gone = moved.filter("next is null").select("file", F.lit(None).cast("string").alias("path"), F.col("to_seq").alias("from_seq"), F.lit(None).cast("int").alias("to_seq"))
        done = done.unionByName(gone)
        now = moved.filter("next is not null").select("file", F.col("next").alias("path"), F.col("to_seq").alias("from_seq"))
        if now.isEmpty():
            return done


def current_paths(links: DataFrame) -> DataFrame:  # S22
    """file, now: the path at HEAD, NULL for deleted files."""
    return links.filter("to_seq is null").select("file", F.col("path").alias("now"))


PLACE = "file string, line int"


def _moved(line: Column, hunks: Column) -> Column:
    """line, touched, last: where a line stands after ``hunks`` in order of commit and place, commits that changed it, and the last of them.

    Folded hunk by hunk; ``line`` is in terms of the file before the hunk's commit, and ``shift`` what the commit has moved it by so far.
    """
    about = "struct<commit: string, at: bigint, author: string>"
    start = F.struct(F.lit(None).cast("int").alias("seq"), line.alias("line"), F.lit(0).alias("shift"), F.lit(False).alias("settled"), F.lit(0).alias("touched"), F.lit(None).cast(about).alias("last"))

    def step(s: Column, h: Column) -> Column:
        same = s["seq"].eqNullSafe(h["seq"])
        at = F.when(same, s["line"]).otherwise(s["line"] + s["shift"])  # NULL once the line is gone
        shift, settled = F.when(same, s["shift"]).otherwise(0), same & s["settled"]
        open_ = at.isNotNull() & ~settled & h["old_start"].isNotNull()
        above = F.when(h["old_n"] == 0, at <= h["old_start"]).otherwise(at < h["old_start"])
        hit = open_ & (h["old_n"] > 0) & at.between(h["old_start"], h["old_start"] + h["old_n"] - 1)
        rewritten = F.when(h["new_n"] > 0, h["new_start"] + F.least(at - h["old_start"], h["new_n"] - 1))
        return F.struct(
            h["seq"].alias("seq"), F.when(hit, rewritten).otherwise(at).alias("line"), F.when(hit, 0).when(open_ & ~above, shift + h["new_n"] - h["old_n"]).otherwise(shift).alias("shift"),
            F.coalesce(settled | (open_ & (above | hit)), F.lit(False)).alias("settled"), F.when(hit, s["touched"] + 1).otherwise(s["touched"]).alias("touched"),
            F.when(hit, F.struct(h["commit"], h["at"], h["author"]).cast(about)).otherwise(s["last"]).alias("last"),
        )

    return F.aggregate(hunks, start, step, lambda s: F.struct((s["line"] + s["shift"]).alias("line"), s["touched"].alias("touched"), s["last"].alias("last")))


def follow(history: DataFrame, places: DataFrame, links: DataFrame | None = None) -> DataFrame:  # S20-S22, L3
    """``places`` (file, line of the older commit) with their place at HEAD and what happened on the way:
    file, line, now_line, commits, touched, last_commit, last_at, last_author, now.

    ``commits``: commits that changed the file; ``touched``: those that changed the line itself; last_...: the last of
    these. ``now_line`` is NULL if the line is gone; a line that was rewritten counts as the line that stands there now.
    """
    links = chains(history, places) if links is None else links
    mine = links.filter("path is not null").select("file", "path", "from_seq", "to_seq")
    met = history.join(mine, (F.col("old") == F.col("path")) & (F.col("seq") > F.col("from_seq")) & (F.col("to_seq").isNull() | (F.col("seq") <= F.col("to_seq"))))
    hunk = F.struct("seq", "old_start", "old_n", "new_start", "new_n", "commit", "at", "author")
    hunks = met.groupBy("file").agg(F.array_sort(F.collect_list(hunk)).alias("hunks"))
    asked = places.select("file", F.col("line").cast("int")).distinct()
    together = asked.groupBy("file").agg(F.collect_list(F.struct("line")).alias("lines")).join(hunks, "file", "left").withColumn("hunks", F.coalesce("hunks", F.array().cast(hunks.schema["hunks"].dataType)))
    moved = F.transform("lines", lambda x: F.struct(x["line"].alias("line"), _moved(x["line"], F.col("hunks")).alias("m")))
    commits = F.size(F.array_distinct(F.transform("hunks", lambda h: h["seq"])))
    mapped = together.select("file", commits.alias("commits"), F.explode(moved).alias("p"))
    mapped = mapped.select("file", "p.line", F.col("p.m.line").alias("now_line"), "commits", "p.m.touched", F.col("p.m.last.commit").alias("last_commit"), F.col("p.m.last.at").alias("last_at"), F.col("p.m.last.author").alias("last_author"))
    out = mapped.join(current_paths(links), "file", "left")
    return out.withColumn("now_line", F.when(F.col("now").isNotNull(), F.col("now_line")))


def revalidation(findings: DataFrame, history: DataFrame) -> DataFrame:  # L3
    """Findings with what the history says of their place: exists, now, now_line, renamed, commits, touched and the last change."""
    placed = findings.filter("file is not null and line is not null")
    facts = follow(history, placed.select("file", "line"))
    facts = facts.withColumns({"exists": F.col("now").isNotNull(), "renamed": F.coalesce(F.col("now") != F.col("file"), F.lit(False))})
    return findings.join(facts, ["file", "line"], "left")


def blob_sizes(spark: SparkSession, repo: str, blobs: list[tuple[str, str]]) -> DataFrame:  # S21, F25
    """commit, file, n_lines of files at commits, from one run of git; NULL where there is no such file or the commit does not look like one."""
    asked = [(c, f) for c, f in blobs if re.match(COMMIT, c or "") and f and "\n" not in f]
    rows = []
    with subprocess.Popen(["git", "-C", repo, "cat-file", "--batch"], stdin=subprocess.PIPE, stdout=subprocess.PIPE) as git:
        for c, f in asked:
            git.stdin.write(f"{c}:{f}\n".encode())
            git.stdin.flush()
            head = git.stdout.readline().split()
            lines = None
            if len(head) == 3 and head[1] == b"blob":
                text = git.stdout.read(int(head[2]) + 1)[:-1]
                lines = text.count(b"\n") + (not text.endswith(b"\n")) if text else 0
            elif len(head) == 3 and head[1] != b"missing":
                git.stdout.read(int(head[2]) + 1)
            rows.append((c, f, lines))
        git.stdin.close()
    return spark.createDataFrame(rows, "commit string, file string, n_lines int")


def citations_at(findings: DataFrame, blobs: DataFrame) -> DataFrame:  # F25
    """Citations of a commit that do not resolve there: id, file, line, at_commit, problem. findings: with at_commit; blobs: commit, file, n_lines."""
    sized = blobs.select(F.col("commit").alias("at_commit"), "file", "n_lines").distinct()
    cited = findings.filter("at_commit is not null and file is not null and not (status <=> 'dismissed')").join(sized, ["at_commit", "file"], "left")
    problem = F.when(F.col("n_lines").isNull(), F.concat(F.lit("no such file at "), F.substring("at_commit", 1, 8))).when((F.col("line") < 0) | (F.col("line") > F.col("n_lines")), F.concat(F.lit("no such line at "), F.substring("at_commit", 1, 8), F.lit(": it had "), F.col("n_lines")))
    return cited.withColumn("problem", problem).filter("problem is not null").select("id", "file", "line", "at_commit", "problem")
