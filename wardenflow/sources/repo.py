"""Source trees (S1-S4): files, lines, and what a regex extractor sees in them."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardenflow.functions import code_rules as R

# Folders that are never read, and the largest file.
IGNORED = r"(^|/)(\.git|\.hg|\.svn|node_modules|bower_components|vendor|dist|build|out|target|coverage|\.next|\.nuxt|\.venv|venv|__pycache__|\.tox|\.idea|\.vscode|\.cache)/"
MAX_BYTES = 1_500_000
EXTRACTED = "file string, lang string, symbols array<struct<name: string, kind: string, line: int, end: int, exported: boolean>>, imports array<string>, calls array<struct<callee: string, receiver: string, line: int>>"
_SYMBOL = pa.struct([("name", pa.string()), ("kind", pa.string()), ("line", pa.int32()), ("end", pa.int32()), ("exported", pa.bool_())])
_CALL = pa.struct([("callee", pa.string()), ("receiver", pa.string()), ("line", pa.int32())])
EXTRACTED_ARROW = pa.schema([("file", pa.string()), ("lang", pa.string()), ("symbols", pa.list_(_SYMBOL)), ("imports", pa.list_(pa.string())), ("calls", pa.list_(_CALL)), ("hash", pa.string())])


def language(file: Column) -> Column:  # F6
    ext = F.lower(F.regexp_extract(file, r"\.([A-Za-z0-9]+)$", 1))
    table = {e: lang for lang, ends in R.LANGUAGES.items() for e in ends.split()}
    return F.try_element_at(F.create_map(*[F.lit(x) for item in table.items() for x in item]), ext)


def read_tree(spark: SparkSession, root: str, excludes: list[str] | None = None, max_bytes: int = MAX_BYTES) -> DataFrame:  # S1, F19
    """file (relative), content of text files under ``root``; large, ignored and binary files are left out."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).filter(F.col("length") <= max_bytes)
    base = "/" + root.split("://")[-1].strip("/") + "/"
    file = F.regexp_replace(F.regexp_replace("path", r"^\w+:/*", "/"), "^" + re.escape(base), "")
    out = raw.select(file.alias("file"), "content").filter(~F.col("file").rlike(IGNORED))
    for pattern in excludes or []:
        out = out.filter(~F.col("file").rlike(glob_pattern(pattern)))
    return out.filter(F.position(F.lit(b"\0"), F.col("content")) == 0).select("file", F.decode("content", "UTF-8").alias("content"))


def glob_pattern(glob: str) -> str:  # F20
    """A glob with **, *, ?, and {a,b} as a regular expression over a relative path; without a slash it matches a name."""
    anchored = "/" in glob.rstrip("/")
    body, depth = "", 0
    for token in re.findall(r"\*\*/|\*\*|\*|\?|\{|\}|,|.", glob.strip("/")):
        depth += (token == "{") - (token == "}")
        body += {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]", "{": "(?:", "}": ")"}.get(token) or ("|" if token == "," and depth else re.escape(token))
    return f"^{'' if anchored else '(?:.*/)?'}{body}(?:/.*)?$"


def ignored_by(file: Column, rules: list[str]) -> Column:  # F20
    """Whether gitignore ``rules`` leave a path out; the last that matches decides, and ! takes back."""
    out = F.lit(False)
    for r in (x.strip() for x in rules):
        if r and not r.startswith("#"):
            keep = r.startswith("!")
            out = F.when(file.rlike(glob_pattern(r.lstrip("!").rstrip("/"))), F.lit(not keep)).otherwise(out)
    return out


def source_lines(files: DataFrame) -> DataFrame:
    return files.select("file", F.posexplode(F.split("content", r"\r?\n")).alias("pos", "text")).select("file", (F.col("pos") + 1).alias("line"), "text")


# --- the extractor ------------------------------------------------------------------------------------------------

DEFINITIONS = {
    "python": [(re.compile(r"^(\s*)(?:async\s+)?def\s+(\w+)"), "function"), (re.compile(r"^(\s*)class\s+(\w+)"), "class")],
    "javascript": [(re.compile(r"^(\s*)(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(\w+)"), "function"), (re.compile(r"^(\s*)(?:export\s+)?(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*=>"), "function"), (re.compile(r"^(\s*)(?:export\s+)?(?:default\s+)?class\s+(\w+)"), "class"), (re.compile(r"^(\s+)(?:async\s+)?(\w+)\s*\([^)]*\)\s*\{\s*$"), "method")],
    "go": [(re.compile(r"^()func\s+(?:\([^)]*\)\s*)?(\w+)"), "function")],
    "ruby": [(re.compile(r"^(\s*)def\s+(?:self\.)?(\w+)"), "function")],
    "php": [(re.compile(r"^(\s*)(?:(?:public|private|protected|static)\s+)*function\s+(\w+)"), "function")],
    "rust": [(re.compile(r"^(\s*)(?:pub\s+)?(?:async\s+)?fn\s+(\w+)"), "function")],
}
DEFINITIONS |= dict.fromkeys(("java", "csharp", "kotlin", "scala", "swift", "c_cpp"), [(re.compile(r"^(\s*)(?:(?:public|private|protected|static|final|override|suspend|func|fun|def|virtual|async|inline|[\w<>\[\],.*&]+)\s+)+(\w+)\s*\([^;]*$"), "method")])
IMPORTS = [re.compile(p) for p in (r"^\s*import\s+.*?from\s+['\"]([^'\"]+)['\"]", r"^\s*import\s+['\"]([^'\"]+)['\"]", r"\brequire(?:_relative)?\s*\(?\s*['\"]([^'\"]+)['\"]", r"^\s*from\s+([\w.]+)\s+import\b", r"^\s*import\s+([\w.]+)", r"^\s*use\s+([\w:\\]+)", r"^\s*#include\s+[<\"]([^>\"]+)", r"^\s*using\s+([\w.]+)\s*;", r"^\s*\w*\s*\"([\w./-]+)\"\s*$")]
CALL = re.compile(r"(?:([A-Za-z_$][\w$]*)\s*(?:\.|->|::)\s*)?([A-Za-z_$][\w$]*)\s*\(")
HIDDEN = re.compile(r"//.*|'(?:\\.|[^'\\])*'|\"(?:\\.|[^\"\\])*\"")
KEYWORDS = frozenset("if for while switch catch return function def class new elif else try with match fn func and or not in await async typeof sizeof".split())


def extract(file: str, lang: str | None, content: str) -> dict:
    """Symbols with their extents (by braces or indentation), imports and calls, by line patterns."""
    lines, symbols, imports, calls = content.splitlines(), [], [], []
    for n, text in enumerate(lines, 1):
        for pattern, kind in DEFINITIONS.get(lang, ()):
            if (m := pattern.match(text)) and m[2] not in KEYWORDS:
                exported = "export" in text or "pub " in text or (lang in ("python", "ruby", "php", "java", "kotlin", "csharp", "scala", "c_cpp", "swift") and not m[2].startswith("_") and "private" not in text) or (lang == "go" and m[2][0].isupper())
                exported = exported or (lang == "javascript" and "exports" in content and re.search(rf"\bexports\b[^\n]*\b{re.escape(m[2])}\b", content) is not None)
                symbols.append({"name": m[2], "kind": kind, "line": n, "end": len(m[1]), "exported": bool(exported)})
                break
        # the first three forms are JavaScript's own; the others would read its import of a name as one of a module
        imports += [m[1] for p in (IMPORTS[:3] if lang == "javascript" else IMPORTS) for m in p.finditer(text)]
        defined = {s["name"] for s in symbols if s["line"] == n}
        calls += [{"callee": m[2], "receiver": m[1], "line": n} for m in CALL.finditer(text) if m[2] not in KEYWORDS and not (m[2] in defined and not m[1])]
    ends = _indented_ends if lang in ("python", "ruby") else _braced_ends
    for s, end in zip(symbols, ends(lines, [(s["line"], s["end"]) for s in symbols], lang), strict=True):
        s["end"] = end
    return {"file": file, "lang": lang, "symbols": symbols, "imports": sorted(set(imports)), "calls": calls}


def _indented_ends(lines: list[str], starts: list[tuple[int, int]], lang: str | None) -> list[int]:
    """Last line of each definition, given by its line and indentation: the last that is indented deeper. One pass, with the open ones at hand."""
    out, open_ = [n for n, _ in starts], []
    at = {n: k for k, (n, _) in enumerate(starts)}
    for n, text in enumerate(lines, 1):
        if text.strip():
            indent, closes = len(text) - len(text.lstrip()), lang == "ruby" and text.strip() == "end"
            open_ = [k for k in open_ if indent > starts[k][1] or closes]
            for k in open_:
                out[k] = n
        if n in at:
            open_.append(at[n])
    return out


def _braced_ends(lines: list[str], starts: list[tuple[int, int]], lang: str | None) -> list[int | None]:
    """Last line of each definition: where the braces opened since its first line are closed; None where they never are. One pass, with the open ones at hand."""
    out: list[int | None] = [None] * len(starts)
    at = {n: k for k, (n, _) in enumerate(starts)}
    open_: list[list] = []  # number, depth before, whether a brace was seen
    depth = 0
    for n, text in enumerate(lines, 1):
        if n in at:
            open_.append([at[n], depth, False])
        bare = HIDDEN.sub("", text)
        depth += bare.count("{") - bare.count("}")
        if "{" in bare or "}" in bare:
            still = []
            for o in open_:
                o[2] = o[2] or "{" in bare
                if o[2] and depth <= o[1]:
                    out[o[0]] = n
                else:
                    still.append(o)
            open_ = still
    return out


def scan_files(files: DataFrame, cache: DataFrame | None = None) -> DataFrame:  # S2, S3
    """EXTRACTED and the content's hash; files whose hash the cache has are not extracted again."""
    named = files.withColumns({"lang": language(F.col("file")), "hash": F.sha2("content", 256)}).filter("lang is not null")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [extract(r["file"], r["lang"], r["content"] or "") | {"hash": r["hash"]} for r in b.to_pylist()]
            yield pa.RecordBatch.from_pylist(rows, schema=EXTRACTED_ARROW)

    schema = f"{EXTRACTED}, hash string"
    if cache is None:
        return named.select("file", "lang", "content", "hash").mapInArrow(work, schema)
    known = cache.join(named.select("file", "hash"), ["file", "hash"], "left_semi")
    new = named.join(cache.select("file", "hash"), ["file", "hash"], "left_anti")
    return known.select("file", "lang", "symbols", "imports", "calls", "hash").unionByName(new.select("file", "lang", "content", "hash").mapInArrow(work, schema))


def manifest_folders(files: DataFrame, names: list[str], depth: int = 3) -> DataFrame:  # S4
    """Folders of manifests, nearest first."""
    folder = F.when(F.instr("file", "/") > 0, F.regexp_replace("file", "/[^/]*$", "")).otherwise(F.lit("."))
    found = files.filter(F.substring_index("file", "/", -1).isin(*names)).select(folder.alias("folder")).distinct()
    return found.withColumn("depth", F.when(F.col("folder") == ".", 0).otherwise(F.size(F.split("folder", "/")))).filter(F.col("depth") <= depth).orderBy("depth", "folder")


def exploded(scan: DataFrame) -> dict[str, DataFrame]:
    """The four relations of a scan: files, symbols, imports, calls."""
    return {
        "files": scan.select("file", "lang"),
        "symbols": scan.select("file", "lang", F.explode("symbols").alias("s")).select("file", "lang", "s.*"),
        "imports": scan.select("file", F.explode("imports").alias("spec")),
        "calls": scan.select("file", "lang", F.explode("calls").alias("c")).select("file", "lang", "c.*"),
    }
