"""Secrets by patterns, and by dictionary-primed zstandard novelty.

Base secrets come from three fixed patterns. Beyond them, whole runs of 16 or more letters, digits and signs that stand
within reach of a sensitive word, on either side, are candidates. A candidate's novelty is what it adds to the compressed
size of its surroundings: zstandard is primed with a dictionary of common code and identifiers and with the text around
the candidate, and its compressed bytes less those of nothing are measured against what random strings of the same
alphabet and length add. Identifiers, paths and words that recur in the surroundings compress well; random strings do
not, however long or narrow in alphabet, and are reported as ``novel``. A run with full stops is also novel if one of its
parts is, as in a signed token, whose header is common and whose signature is random.

Spans are written kind:start:end, start and end in code points, by start, then kind in the order assign, access, hex,
novel. Each text is read alone and whole, so nothing is gathered from the corpus.

Defined results
    null or empty text   no spans; sha256 of the empty string
    null id, repeated rows, other columns   each row gives its own result; other columns are not read
    empty table          empty result
"""

from __future__ import annotations

import hashlib
import random
import re
import string
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The base patterns of the contract. ASCII: letters in either case are A-Z and a-z alone.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "novel")

SENSITIVE = re.compile(r"password|passwd|passphrase|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credential|authorization|bearer|client[_-]?secret|auth[_-]?key", re.IGNORECASE | re.ASCII)
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=.-]{16,}")
HINTS = ("passw", "passp", "secret", "token", "api", "access", "private", "credential", "authoriz", "bearer", "auth")

#: What code around secrets commonly says; the dictionary that every measurement is primed with.
IDENTIFIERS = (
    "import from const let var function return export default class public private static final string "
    "self config settings environment process.env os.environ getenv options headers request response session user "
    "username password passwd passphrase secret client_secret token access_token refresh_token id_token api_key apikey "
    "access_key secret_key private_key public_key credential credentials authorization bearer basic auth oauth "
    "https:// http:// localhost example.com application/json content-type example placeholder changeme your_token_here "
    "your-api-key-here xxxxxxxxxxxxxxxx 0000000000000000 1234567890123456 abcdefghijklmnopqrstuvwxyz "
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 true false null None undefined "
)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """start, end, kind number of base secrets. Runs are matched whole, so a minimum length is the same as a later test."""
    low = text.lower()
    out = []
    if any(x in low for x in ("passw", "secret", "token", "api")):
        out += [(*m.span(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(*m.span(), 1) for m in ACCESS.finditer(text)]
    out += [(*m.span(), 2) for m in HEX.finditer(text)]
    return out


def added(data: str, context: str, level: int = 3) -> int:
    """Compressed bytes that ``data`` adds after the dictionary and ``context``."""
    primer = zstandard.ZstdCompressionDict((IDENTIFIERS + context).encode("utf-8", "replace"), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    squeeze = zstandard.ZstdCompressor(level=level, dict_data=primer, write_content_size=False, write_checksum=False, write_dict_id=False)
    return len(squeeze.compress(data.encode("utf-8", "replace"))) - len(squeeze.compress(b""))


def alphabet(candidate: str) -> str:
    """Hexadecimal digits of one case if they suffice, else each of digits, letters of a case and signs that occurs."""
    seen = set(candidate)
    for digits in ("0123456789abcdef", "0123456789ABCDEF"):
        if seen <= set(digits):
            return digits
    classes = ("0123456789", string.ascii_lowercase, string.ascii_uppercase)
    return "".join(c for c in classes if seen & set(c)) + "".join(sorted(seen.difference(*classes)))


@lru_cache(maxsize=4096)
def added_at_random(letters: str, length: int, level: int = 3, draws: int = 3) -> float:
    """What random strings of these letters and this length add, on average; always the same ones."""
    draw = random.Random(f"{letters}:{length}")
    return sum(added("".join(draw.choices(letters, k=length)), "", level) for _ in range(draws)) / draws


def novelty(candidate: str, context: str, level: int = 3) -> float:
    """What ``candidate`` adds, as a share of what random strings of its alphabet and length add."""
    return added(candidate, context, level) / added_at_random(alphabet(candidate), len(candidate), level)


def novel(candidate: str, context: str, min_novelty: float) -> bool:
    """Whether the candidate or a part of it between full stops has letters and digits and does not compress."""
    parts = [candidate] + [p for p in candidate.split(".") if 16 <= len(p) < len(candidate)]
    return any(any(c.isalpha() for c in p) and any(c.isdigit() for c in p) and novelty(p, context) >= min_novelty for p in parts)


def novel_spans(text: str, base: list[tuple[int, int, int]], reach: int = 48, around: int = 256, min_novelty: float = 0.95) -> list[tuple[int, int, int]]:
    """Novel candidates near a sensitive word, before or after it, of which base spans cover less than half."""
    low = text.lower()
    if not any(x in low for x in HINTS):
        return []
    words = [m.span() for m in SENSITIVE.finditer(text)]
    if not words:
        return []
    out = []
    bounds = [(None, 0), *words, (len(text), None)]
    for (before, left), (right, after) in pairwise(bounds):  # the text between two words
        for m in CANDIDATE.finditer(text, left, right):
            s, e = m.span()
            if (before is None or s > left + reach) and (after is None or e < right - reach):
                continue
            if 2 * sum(max(0, min(e, b) - max(s, a)) for a, b, _ in base) >= e - s:
                continue
            if novel(m[0], text[max(0, s - around) : s] + text[e : e + around], min_novelty):
                out.append((s, e, 3))
    return out


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in sorted(spans, key=lambda x: (x[0], x[2])))


FOUND = "doc_id {id}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = 48, around: int = 256, min_novelty: float = 0.95) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex and base_sha256 of base spans, and ``spans``, all of them."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch["text"]:
                base = base_spans(text or "")
                spans = base + novel_spans(text or "", base, reach, around, min_novelty)
                rows.append((*[sum(k == n for _, _, k in base) for n in range(3)], hashlib.sha256(written(base).encode()).hexdigest(), written(spans)))
            out = pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans"])
            out.insert(0, "doc_id", batch["doc_id"].to_numpy())
            yield out

    chosen = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInPandas(each, FOUND.format(id=chosen.schema["doc_id"].dataType.simpleString()))
