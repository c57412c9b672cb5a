"""What a value does inside one file (G6-G9, X17): function units, scopes of inputs, names that carry a value.

Each file is folded once, line by line, with all questions about it at hand: the two sides meet by a join on the file, so a
file's text is sent once and not once for each path. Files come to Python in batches, not by a call for each. A row holds
one file, whose size the source reader bounds, and the different questions about it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Languages by how blocks are marked, and shapes of lines that open one.
BRACES = frozenset("javascript java go rust c_cpp csharp kotlin swift scala php".split())
CONTROL = re.compile(r"^\s*(?:\}\s*)?(?:else\s+)?(?:if|for|while|switch|case|catch|try|do|finally|with|using|lock|unsafe|synchronized|match|loop|unless|begin)\b")
ARROW = re.compile(r"=>")
KEYWORD = re.compile(r"\b(?:function|func|fn|def|sub|proc)\b")
WRAPPED = re.compile(r"^\s*(?:\)\s*)?(?:throws\s+[\w.,\s]+|->\s*[^{]*|:\s*[^{]*)?\{\s*$")
HEADER = re.compile(r"\)\s*(?:->\s*[^{]+|:\s*[^{]+|const\s*|noexcept\s*|throws\s[^{]+)?\{\s*$")
PY_DEF = re.compile(r"\s*(?:async\s+)?def\s")
# Words before a bound name that are none.
NO_NAMES = frozenset("const let var final val public private protected static readonly new await return my our dim set".split())

NAME = re.compile(r"[A-Za-z_$][A-Za-z0-9_$]*")
RUN = re.compile(r"[A-Za-z0-9_$]+")
#: An assignment's sign: no part of a comparison, an arrow or a compound assignment.
ASSIGN = re.compile(r"(?<![=!<>+\-*/])=(?![=>])")
#: What hides braces on a line: a string, a comment to the end of the line, or the start of a block comment.
HIDDEN = re.compile(r"/\*|//|\"(?:\\.|[^\"\\])*(?:\"|\\?$)|'(?:\\.|[^'\\])*(?:'|\\?$)|`(?:\\.|[^`\\])*(?:`|\\?$)", re.S)
HIDDEN_HASH = re.compile(HIDDEN.pattern + r"|#(?!\[)", re.S)


def opens_function(text: str) -> bool:
    if CONTROL.search(text):
        return False
    wrapped = WRAPPED.search(text) and re.search(r"[)\w]", text)
    return bool(ARROW.search(text) or KEYWORD.search(text) or wrapped or HEADER.search(text))


def visible(text: str, inside: bool, hidden: re.Pattern) -> tuple[str, bool]:
    """``text`` without strings and comments, and whether a block comment is open after it."""
    kept, at = [], 0
    while at < len(text):
        if inside:
            end = text.find("*/", at)
            if end < 0:
                return "".join(kept), True
            at, inside = end + 2, False
            continue
        m = hidden.search(text, at)
        if not m:
            kept.append(text[at:])
            break
        kept.append(text[at : m.start()])
        if m[0] in ("//", "#"):
            break
        inside, at = m[0] == "/*", m.end()
    return "".join(kept), inside


def brace_units(lines: list[str], hidden: re.Pattern) -> list[int] | None:
    """The line on which the innermost function around each line opens, 0 for none; None if braces do not balance."""
    out, open_, functions, inside = [], [], [0], False
    for n, text in enumerate(lines, 1):
        bare, inside = visible(text, inside, hidden)
        before, here = functions[-1], opens_function(text) if "{" in bare else False
        for brace in re.findall(r"[{}]", bare):
            if brace == "{":
                open_.append(here)
                if here:
                    functions.append(n)
            elif not open_:
                return None
            elif open_.pop():
                functions.pop()
        out.append(max(before, functions[-1]))
    return None if open_ else out


def indent_units(lines: list[str]) -> list[int]:
    """The line of the definition around each line, by indentation; 0 for none."""
    out, open_ = [], []  # indentation and line
    for n, text in enumerate(lines, 1):
        bare = text.lstrip()
        if bare and not bare.startswith("#"):
            indent = len(text) - len(bare)
            while open_ and indent <= open_[-1][0]:
                open_.pop()
            if PY_DEF.match(text):
                open_.append((indent, n))
        out.append(open_[-1][1] if open_ else 0)
    return out


def units(lines: list[str], lang: str | None) -> list[int] | None:
    if lang == "python":
        return indent_units(lines)
    return brace_units(lines, HIDDEN_HASH if lang == "php" else HIDDEN) if lang in BRACES else None


def bound(left: str) -> set[str]:
    """Names that an assignment's left side binds: all of a pattern in braces or brackets, else the last."""
    names = NAME.findall(left)
    if not re.search(r"[{\[]", left):
        names = names[-1:]
    return {x for x in names if x not in NO_NAMES}


def last_assignment(text: str, before: int | None = None) -> int:
    """Where the last assignment of ``text`` (before a position) stands, -1 for none."""
    at = -1
    for m in ASSIGN.finditer(text):
        if before is not None and m.start() >= before:
            break
        at = m.start()
    return at


def trace_all(lines: list[str], questions: list[tuple[int, str, int]]) -> list[tuple[str | None, list[str]]]:
    """Verdict and names for each question: input's line, its text, the line where the value should arrive.

    One pass over the lines: a question is open from its input to its end, and its names grow by the assignments that
    mention one. 'linked' if the end mentions a name or is the input's line, 'unlinked' if not, None if no name was bound.
    """
    out: list[tuple[str | None, list[str]]] = [(None, [])] * len(questions)
    starts: dict[int, list[int]] = {}
    for q, (first, _, last) in enumerate(questions):
        if first == last:
            out[q] = ("linked", [])
        elif first < last:
            starts.setdefault(first, []).append(q)
    names: dict[int, set[str]] = {}
    for n in range(min(starts, default=1), max((questions[q][2] for group in starts.values() for q in group), default=0) + 1):
        text = lines[n - 1] if 1 <= n <= len(lines) else ""
        mentioned = set(RUN.findall(text)) if names else set()
        added: set[str] | None = None
        for q in [*names]:
            if questions[q][2] == n:
                held = names.pop(q)
                out[q] = ("linked" if held & mentioned else "unlinked", sorted(held))
            elif names[q] & mentioned:
                if added is None:
                    at = last_assignment(text)
                    added = bound(text[:at]) if at >= 0 else set()
                names[q] |= added
        for q in starts.get(n, ()):
            place = text.find(questions[q][1]) if questions[q][1] else -1
            at = last_assignment(text, place if place >= 0 else None)
            if at >= 0 and (own := bound(text[:at])):
                names[q] = own
    return out


def split_lines(content: str | None) -> list[str]:
    return re.split(r"\r?\n", content or "")


QUESTION = "file string, source_line int, match string, entry_line int, source_symbol string, entry_symbol string"
ANSWER = QUESTION + ", scope string, dataflow string, tainted array<string>"


def answers(files: DataFrame, questions: DataFrame) -> DataFrame:  # G6-G8, X17
    """``questions`` with scope, dataflow and tainted names. files: file, lang, content; questions: the columns of QUESTION.

    scope: 'symbol' if input and entry stand in one function, 'module' if the input stands in none, 'file' if in another.
    Functions are told by their blocks; where a language has none or braces do not balance, by the enclosing symbols.
    Questions about a file that is not there have no answer. Null texts are empty.
    """
    columns = [c.split()[0] for c in QUESTION.split(", ")]
    kinds = {"int": pa.int32(), "string": pa.string(), "array<string>": pa.list_(pa.string())}
    schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in ANSWER.split(", ")])

    def told(content: str | None, lang: str | None, asked: list[dict]) -> list[dict]:
        lines = split_lines(content)
        unit = units(lines, lang)
        at = lambda n: unit[n - 1] if 1 <= n <= len(unit) else 0
        traced = trace_all(lines, [(q["source_line"], q["match"] or "", q["entry_line"]) for q in asked])
        for q, (verdict, names) in zip(asked, traced, strict=True):
            own, entry = (at(q["source_line"]), at(q["entry_line"])) if unit is not None else (q["source_symbol"], q["entry_symbol"])
            q |= {"scope": "module" if not own else "symbol" if own == entry else "file", "dataflow": verdict, "tainted": names}
        return asked

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [q for r in batch.to_pylist() for q in told(r["content"], r["lang"], r["asked"])]
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    distinct = questions.select(columns).distinct()
    by_file = distinct.groupBy("file").agg(F.collect_list(F.struct(*columns)).alias("asked"))
    texts = files.select("file", "lang", "content").join(by_file, "file").dropDuplicates(["file"])
    return texts.select("lang", "content", "asked").mapInArrow(fold, ANSWER)


def unit_map(files: DataFrame) -> DataFrame:  # G6
    """file, line, unit: the line on which the function around each line opens, 0 for none, NULL where that cannot be told."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for file, lang, content in zip(b["file"], b["lang"], b["content"], strict=True):
                lines = (content or "").splitlines()
                found = units(lines, lang)
                rows += [(file, n + 1, None if found is None else found[n]) for n in range(len(lines))]
            out = pd.DataFrame(rows, columns=["file", "line", "unit"])
            yield out.assign(unit=out["unit"].astype("Int64"))

    return files.select("file", "lang", "content").mapInPandas(work, "file string, line int, unit int")
