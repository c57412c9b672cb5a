"""Facts from git (S19-S22): run on the driver for one repository, kept as small tables and joined like any other."""

from __future__ import annotations

import re
import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardenflow.operators import graph as G


def run(repo: str, *args: str) -> str | None:
    """Output of a git command; None if it fails."""
    done = subprocess.run(["git", "-C", repo, *args], capture_output=True, text=True, errors="replace")
    return done.stdout if done.returncode == 0 else None


def changed_files(repo: str, ref: str) -> list[str] | None:  # S19, U5
    """Files changed since ``ref``, in the work tree or untracked, without deletions; None if ``ref`` is unknown."""
    parts = [run(repo, "diff", "--name-only", "--diff-filter=d", f"{ref}...HEAD"), run(repo, "diff", "--name-only", "--diff-filter=d", "HEAD"), run(repo, "ls-files", "--others", "--exclude-standard")]
    if parts[0] is None:
        return None
    return sorted({x for p in parts if p for x in p.splitlines() if x})


def parse_blame(raw: str) -> dict:  # S20
    """author, date and commit of a porcelain blame of one line."""
    import datetime

    fields = dict(line.split(" ", 1) for line in raw.splitlines()[1:] if " " in line and not line.startswith("\t"))
    when = fields.get("author-time")
    day = datetime.datetime.fromtimestamp(int(when), datetime.UTC).date().isoformat() if when else None
    return {"commit": raw.split(" ", 1)[0][:12], "author": fields.get("author"), "date": day}


def blame(spark: SparkSession, repo: str, places: list[tuple[str, int]]) -> DataFrame:  # S20
    rows = []
    for file, line in places:
        raw = run(repo, "blame", "--porcelain", "-L", f"{line},{line}", "--", file)
        if raw:
            rows.append((file, line, *parse_blame(raw).values()))
    return spark.createDataFrame(rows, "file string, line int, commit string, author string, date string")


def blob_lines(spark: SparkSession, repo: str, blobs: list[tuple[str, str]]) -> DataFrame:  # S21
    """commit, file, line, text of files at commits; a commit must look like one."""
    rows = [(c, f, text) for c, f in blobs if re.fullmatch(r"[0-9a-f]{7,40}", c) and (text := run(repo, "show", f"{c}:{f}")) is not None]
    df = spark.createDataFrame(rows, "commit string, file string, content string")
    return df.select("commit", "file", F.posexplode(F.split("content", r"\r?\n")).alias("pos", "text")).select("commit", "file", (F.col("pos") + 1).alias("line"), "text")


def renamed_to(repo: str, file: str, since: str) -> str | None:  # S22, X27
    """The path that ``file`` was renamed to after ``since``."""
    raw = run(repo, "log", f"{since}..HEAD", "--diff-filter=R", "--name-status", "--format=") or ""
    now = file
    for line in reversed(raw.splitlines()):
        parts = line.split("\t")
        if len(parts) == 3 and parts[0].startswith("R") and parts[1] == now:
            now = parts[2]
    return now if now != file else None


def last_change(repo: str, file: str, line: int) -> tuple[str, str] | None:  # S22
    """Commit and date of the last change of a line."""
    raw = run(repo, "log", "-1", "--format=%h\t%as", f"-L{line},{line}:{file}", "--no-patch")
    return tuple(raw.strip().split("\t")[:2]) if raw and "\t" in raw else None


def diff_scope(spark: SparkSession, edges: DataFrame, changed: list[str], depth: int = 2) -> DataFrame:  # L12, G2
    """Changed files and what depends on them, with the distance. edges: from, to."""
    seeds = spark.createDataFrame([(f,) for f in changed], "node string")
    return G.reverse_dependents(edges.select(F.col("from").alias("src"), F.col("to").alias("dst")), seeds, depth)
