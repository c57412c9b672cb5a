"""Personal data by patterns, and by bootstrapped contexts.

Base entities come from four fixed patterns. They are the seeds of a bootstrap: each identifier in the corpus, a base
entity or another string with a digit or an at sign, is an instance, and the words around it are its lexical patterns
(one or two words to the left, one to the right; the keys and values of JSON, CSV and key=value texts are words). Spark
scores the graph of patterns and instances in rounds, until no instance is labelled any more. A pattern's confidence for
a kind is the lower Wilson bound of the kind's share of its labelled instances, each by its confidence; instances of
other kinds count against it, unlabelled ones with a small weight. A labelled instance's confidence is that of its best
trusted pattern. Trusted patterns, with enough seeds and confidence, give their kind to instances that no base pattern
finds; those are the spans added. Statistics are over all documents, and the graph never leaves Spark.

Spans are written kind:start:end, start and end in code points, by kind in the order email, ip, card, phone, then start.

Defined results
    null or empty text   no spans; sha256 of the empty string
    null id              scored like any other row
    repeated rows        each row has its own spans; instances count by their string, not by rows
    empty table          empty result
    other columns        are not read
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardenflow.llm.common import join_hot, settle

# The base patterns of the contract.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
KINDS = ("email", "ip", "card", "phone")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DIGIT = re.compile("[0-9]")
WORD = re.compile(r"\S+")
IDENTIFIER = re.compile(r"[A-Za-z0-9][A-Za-z0-9@._%+()/\[\]-]{4,}")
PLAIN_WORD = re.compile(r"[^\s\",;:=<>{}\[\]()|&]+")
EDGE = ".,;:!?\"'()[]{}<>|&*#$%=-_/\\"


def at_most_255(part: str) -> bool:
    digits = part.lstrip("0")
    return len(digits) <= 3 and int(digits or 0) <= 255


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Matches of EMAIL. Only runs before an at sign can start one, so others are skipped."""
    out, at, end = [], text.find("@"), 0
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        m = EMAIL.match(text, start) if start < at else None
        if m:
            out.append(m.span())
            end = m.end()
        at = text.find("@", max(at + 1, end))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Base entities by kind, then start."""
    out = [("email", *x) for x in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        out += [("ip", *m.span()) for m in IP.finditer(text) if all(at_most_255(x) for x in m[0].split("."))]
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return out


def written(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def _around(text: str, start: int, end: int) -> list[str]:
    """Lexical patterns of a span: words next to it in lower case, without punctuation at their edges."""
    words = lambda part: [w for x in PLAIN_WORD.findall(part) if (w := x.strip(EDGE).lower())]
    left, right = words(text[max(0, start - 120) : start])[-2:], words(text[end : end + 60])[:1]
    out = [f"l {left[-1]}"] if left else []
    if len(left) == 2:
        out.append(f"ll {left[0]} {left[1]}")
    if right:
        out.append(f"r {right[0]}")
    return out


def instances(text: str, base: list[tuple[str, int, int]]) -> list[dict]:
    """Base entities and other identifiers: kind or None, start, end, string, patterns."""
    found = [(k, s, e) for k, s, e in base]
    if DIGIT.search(text) or "@" in text:
        taken = sorted((s, e) for _, s, e in base)
        for m in WORD.finditer(text):
            if "@" not in m[0] and not DIGIT.search(m[0]):
                continue
            for x in IDENTIFIER.finditer(m[0]):
                s, e = m.start() + x.start(), m.start() + x.end()
                if ("@" in x[0] or DIGIT.search(x[0])) and not any(s < b and a < e for a, b in taken):
                    found.append((None, s, e))
    return [{"kind": k, "start": s, "end": e, "string": text[s:e].lower(), "patterns": _around(text, s, e)} for k, s, e in found]


SCANNED = "doc_id {id}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base string, found array<struct<kind: string, start: int, end: int, string: string, patterns: array<string>>>"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A settled table: base spans and instances of each row, with a row handle."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                base = base_spans(text or "")
                spans = written(base)
                rows.append((doc_id, *[sum(k == kind for k, _, _ in base) for kind in KINDS], hashlib.sha256(spans.encode()).hexdigest(), spans, instances(text or "", base)))
            out = pd.DataFrame(rows, columns=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "base", "found"])
            yield out.assign(doc_id=batch["doc_id"].to_numpy())

    chosen = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = SCANNED.format(id=chosen.schema["doc_id"].dataType.simpleString())
    return settle(chosen.mapInPandas(each, schema).withColumn("row", F.monotonically_increasing_id()), "scanned")


def wilson(mean, n, z: float = 1.64):
    """Lower bound of a share seen in n cases."""
    return (mean + z * z / (2 * n) - z * F.sqrt((mean * (1 - mean) + z * z / (4 * n)) / n)) / (1 + z * z / n)


def discovered(scanned: DataFrame, rounds: int | None = None, min_seeds: int = 5, min_confidence: float = 0.8, unseen: float = 0.05) -> DataFrame:
    """``string, kind`` of instances that trusted patterns label and no base pattern finds.

    ``unseen`` is the weight of an unlabelled instance. Labels stay once given, so rounds end; ``rounds`` may bound them.
    """
    each = scanned.select(F.explode("found").alias("x")).select("x.*")
    edges = settle(each.select("string", "kind", F.explode("patterns").alias("pattern")).distinct(), "edges")
    known = edges.filter("kind is not null").select("string", "kind").distinct().withColumn("confidence", F.lit(1.0))
    known = settle(known, "known")
    links = edges.select("string", "pattern").distinct()
    sizes = settle(links.groupBy("pattern").agg(F.count(F.lit(1)).alias("size")), "pattern_sizes")
    done = 0
    while rounds is None or done < rounds:
        done += 1
        labelled = links.join(known, "string")
        sums = labelled.groupBy("pattern", "kind").agg(F.sum("confidence").alias("mass"), F.count_if(F.col("confidence") == 1.0).alias("seeds"))
        totals = sums.groupBy("pattern").agg(F.sum("mass").alias("all_mass"))
        n = F.col("all_mass") + F.lit(unseen) * F.greatest(F.col("size") - F.col("all_mass"), F.lit(0.0))
        scored = sums.join(totals, "pattern").join(sizes, "pattern").withColumn("n", n).withColumn("score", wilson(F.col("mass") / F.col("n"), F.col("n")))
        trusted = scored.filter((F.col("seeds") >= min_seeds) & (F.col("score") >= min_confidence)).select("pattern", "kind", "score")
        unlabelled = links.join(known.select("string").distinct(), "string", "left_anti")
        # a pattern may hold most strings, and has a row for each kind that trusts it: one struct for each pattern
        by_pattern = trusted.groupBy("pattern").agg(F.collect_list(F.struct("kind", "score")).alias("says"))
        best = join_hot(unlabelled, by_pattern, "pattern").select("string", F.inline("says")).groupBy("string", "kind").agg(F.max("score").alias("confidence"))
        found = best.groupBy("string").agg(F.max_by("kind", F.struct("confidence", "kind")).alias("kind"), F.max("confidence").alias("confidence"))
        found = settle(found.select("string", "kind", "confidence"), "found")
        if found.isEmpty():
            break
        known = settle(known.unionByName(found), "known")
    return known.filter("confidence < 1").select("string", "kind")


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone and base_sha256 of base spans, and ``spans``, all of them."""
    scanned = scan(docs, id_col, text_col)
    extra = discovered(scanned, **options)
    others = scanned.select("row", F.explode("found").alias("x")).filter("x.kind is null").select("row", "x.start", "x.end", "x.string")
    order = F.element_at(F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)]), F.col("kind"))
    added = others.join(extra, "string").groupBy("row").agg(F.collect_list(F.struct(order.alias("o"), F.col("start").alias("s"), F.col("end").alias("e"))).alias("added"))
    base = F.transform(
        F.filter(F.split("base", ","), lambda x: x != ""),
        lambda x: F.struct((F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.split_part(x, F.lit(":"), F.lit(1))) - 1).cast("int").alias("o"), F.split_part(x, F.lit(":"), F.lit(2)).cast("int").alias("s"), F.split_part(x, F.lit(":"), F.lit(3)).cast("int").alias("e")),
    )
    every = F.array_sort(F.concat(base, F.col("added")))
    text = F.array_join(F.transform(every, lambda x: F.concat_ws(":", F.get(F.array(*[F.lit(k) for k in KINDS]), x["o"]), x["s"].cast("string"), x["e"].cast("string"))), ",")
    out = scanned.drop("found").join(added, "row", "left").withColumn("spans", F.when(F.col("added").isNull(), F.col("base")).otherwise(text))
    return out.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")
