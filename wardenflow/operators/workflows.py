"""Agents in CI workflows (F11): prompts, steps and environment told by block, not by line.

A workflow's lines are folded once by file with a stack of indentations, which gives each line the end of its block
(the line before the next one that is indented no deeper) and the step it belongs to. The rest is joins: a prompt's
text is its block's lines, names in it meet the environment's tainted names, outputs meet the ids of steps that run an agent.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardenflow.functions import scalar as X
from wardenflow.operators import positional as P
from wardenflow.operators.findings import conform, union_all
from wardenflow.storage import cut

# Actions that run an agent, and shapes of lines.
AI_ACTIONS = ("anthropics/claude-code-action", "anthropics/claude-code-base-action", "google-github-actions/run-gemini-cli", "google-gemini/gemini-cli-action", "openai/codex-action", "actions/ai-inference", "github/ai-inference")
WORKFLOW = r"^\.github/workflows/[^/]+\.ya?ml$"
PROMPT_KEY = r"(?i)^\s*(?:-\s+)?(?:direct_)?(?:prompt|prompt_file|instructions|user_prompt|query|input|system_prompt|message)\s*:"
UNTRUSTED = r"(?i)\$\{\{\s*(?:github\.event\.[a-z_.]*(?:title|body|name|label|ref|login|message|comment)|github\.head_ref|github\.event\.issue|github\.event\.comment|github\.event\.pull_request|inputs\.)"
DANGEROUS = r"(?i)danger-full-access|--yolo|--dangerously-skip-permissions|dangerously_skip|permission[_-]mode\s*:\s*['\"]?(?:bypassPermissions|acceptEdits)|Bash\(\s*\*\s*\)|allowed_tools\s*:\s*['\"]?\s*\*"
EVERYONE = r"(?i)(?:allowed_non_write_users|allow[_-]users|allowed_bots)\s*:\s*['\"]?\*"
PR_TARGET = r"^\s*(?:-\s+)?pull_request_target\s*:?"
HEAD_REF = r"^\s*ref\s*:.*(?:github\.event\.pull_request\.head|github\.head_ref)"
SHELL = r"\b(?:eval|exec)\b|\$\("
FETCH = r"\bgh\s+(?:issue|pr|api)\b"
VECTORS = {
    "A": ("Untrusted event data reaches the prompt through an `env:` block", "critical"),
    "B": ("Untrusted event data interpolated directly into the prompt", "critical"),
    "C": ("The prompt tells the agent to fetch the event data itself", "high"),
    "D": ("`pull_request_target` combined with a checkout of the PR head", "critical"),
    "G": ("Model output is executed", "critical"),
    "H": ("Agent sandbox disabled", "high"),
    "I": ("Wildcard user allow-list", "high"),
}

SHAPE = "file string, line int, text string, last int, step int"


def block_ends(indents: list[int | None]) -> list[int]:
    """For each line the last line of its block, by a stack of open lines; blank lines (None) belong to the block around them."""
    out, open_ = [len(indents)] * len(indents), []
    for n, indent in enumerate(indents, 1):
        if indent is None:
            out[n - 1] = n
            continue
        while open_ and indents[open_[-1] - 1] >= indent:
            out[open_.pop() - 1] = n - 1
        open_.append(n)
    return out


def steps(dashes: list[int | None]) -> list[int]:
    """For each line the first line of its list item, 0 before any; a dash ends the item if it is indented no deeper than the item's own."""
    out, start, own = [], 0, -1
    for n, indent in enumerate(dashes, 1):
        if indent is not None and (not start or indent <= own):
            start, own = n, indent
        out.append(start)
    return out


def shape(lines: DataFrame) -> DataFrame:
    """``lines`` (file, line, text) of workflow files with the end of each line's block and its step."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for file, rows in zip(batch["file"].to_pylist(), batch["lines"].to_pylist(), strict=True):
                texts = [r["text"] or "" for r in rows]
                out[0] += [file] * len(rows)
                out[1] += [r["line"] for r in rows]
                out[2] += texts
                out[3] += block_ends([len(t) - len(t.lstrip()) if t.strip() else None for t in texts])
                out[4] += steps([len(m[1]) if (m := re.match(r"(\s*)-\s", t)) else None for t in texts])
            kinds = (pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names=["file", "line", "text", "last", "step"])

    # files come to Python in batches, not by a call for each
    by_file = lines.filter(F.col("file").rlike(WORKFLOW)).groupBy("file").agg(F.array_sort(F.collect_list(F.struct(F.col("line").cast("int").alias("line"), "text"))).alias("lines"))
    return by_file.mapInArrow(fold, SHAPE)


def _hits(rows: DataFrame, vector: str, evidence: Column) -> DataFrame:
    return rows.select("file", "line", F.lit(vector).alias("vector"), evidence.alias("evidence"))


def vectors(lines: DataFrame) -> DataFrame:  # F11
    """file, line, vector, evidence. Vectors D and I count in any workflow, the others where an agent's action is named."""
    told = cut(shape(lines), "workflows")
    agent = F.lit(False)
    for action in AI_ACTIONS:
        agent = agent | F.contains("text", F.lit(action))
    with_agent = told.filter(agent).select("file").distinct()
    mine = told.join(with_agent, "file", "left_semi")
    target = told.filter(F.col("text").rlike(PR_TARGET)).select("file").distinct()
    head = told.filter(F.col("text").rlike(HEAD_REF)).groupBy("file").agg(F.min("line").alias("line"), F.min_by("text", "line").alias("text"))
    out = [_hits(head.join(target, "file", "left_semi"), "D", F.col("text")), _hits(told.filter(F.col("text").rlike(EVERYONE)), "I", F.col("text")), _hits(mine.filter(F.col("text").rlike(DANGEROUS)), "H", F.col("text"))]

    uses = mine.filter(F.col("text").rlike(r"^\s*-?\s*uses\s*:") & agent & (F.col("step") > 0)).select("file", "step").distinct()
    ids = mine.join(uses, ["file", "step"], "left_semi").select("file", F.regexp_extract("text", r"^\s*(?:-\s+)?id\s*:\s*['\"]?([\w-]+)", 1).alias("id")).filter("id <> ''").distinct()
    run = mine.filter(F.col("text").rlike(SHELL)).withColumn("id", F.regexp_extract("text", r"steps\.([\w-]+)\.outputs", 1)).filter("id <> ''")
    out.append(_hits(run.join(ids, ["file", "id"], "left_semi"), "G", F.col("text")))

    block = F.col("text").rlike(r"[|>][-+]?\s*$")
    prompts = mine.filter(F.col("text").rlike(PROMPT_KEY)).select("file", "line", "text", F.when(block, F.col("last")).otherwise(F.col("line")).alias("until"))
    inside = P.in_range(prompts, mine.select("file", F.col("line").alias("at"), F.col("text").alias("part")), "file", "line", "until", "at")
    whole = inside.groupBy("file", "line", "text").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "part"))), lambda x: x["part"]), "\n").alias("block"))
    direct = F.col("block").rlike(UNTRUSTED)
    fetched = ~direct & F.col("block").rlike(FETCH)
    out += [_hits(whole.filter(direct), "B", F.col("text")), _hits(whole.filter(fetched), "C", F.col("text"))]
    bound = r"^\s*([A-Za-z_][A-Za-z0-9_]*)\s*:\s*(.+)$"
    env = mine.filter(F.regexp_extract("text", bound, 2).rlike(UNTRUSTED)).groupBy("file", F.regexp_extract("text", bound, 1).alias("name")).agg(F.min("line").alias("first"), F.max("line").alias("bound_at"))
    named = F.array_distinct(F.concat(F.regexp_extract_all("block", F.lit(r"\$\{?([A-Za-z_][A-Za-z0-9_]*)"), F.lit(1)), F.regexp_extract_all("block", F.lit(r"env\.([A-Za-z_][A-Za-z0-9_]*)"), F.lit(1))))
    through = whole.filter(~direct & ~fetched).withColumn("name", F.explode(named)).join(env, ["file", "name"]).groupBy("file", "line", "text").agg(F.min_by(F.struct("name", "bound_at"), "first").alias("env"))
    out.append(_hits(through, "A", F.concat("text", F.lit("   ("), F.col("env.name"), F.lit(" bound at line "), F.col("env.bound_at"), F.lit(")"))))
    return union_all(*out)


def audit_workflows(lines: DataFrame) -> DataFrame:  # F11
    """:func:`vectors` as findings."""
    of = {k: F.create_map(*[F.lit(x) for v, pair in VECTORS.items() for x in (v, pair[k])]) for k in (0, 1)}
    rows = vectors(lines).withColumns({"what": F.element_at(of[0], F.col("vector")), "severity": F.element_at(of[1], F.col("vector"))})
    kind = F.concat(F.lit("agent-ci-"), "vector")
    message = X.truncate_evidence(X.redact(F.concat("what", F.lit(": "), F.trim("evidence"))))
    return conform(rows.select(kind.alias("ident"), F.concat(F.lit("Agentic CI, vector "), "vector", F.lit(": "), "what").alias("title"), F.lit("config").alias("category"), F.lit("engine").alias("tool"), "severity", F.lit("medium").alias("confidence"), "file", "line", kind.alias("kind"), F.lit("CWE-1427").alias("cwe"), message.alias("message")))
