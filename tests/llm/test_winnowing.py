import hashlib
import re

import xxhash

from tests.llm import cases
from wardenflow.llm.winnowing import edited_fingerprints, fingerprints

FULL = (1 << 64) - 1


def plain(text, gram=5, window=16):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    h = [xxhash.xxh64_intdigest(w.encode(), 42) for w in words]
    rot = lambda x, r: (x << r | x >> (64 - r)) & FULL if r else x
    g = []
    for i in range(len(h) - gram + 1):
        x = 0
        for j in range(gram):
            x ^= rot(h[i + j], gram - 1 - j)
        g.append(x & 0xFFFFFFFF)
    out = []
    for i in range(max(1, len(g) - window + 1) if g else 0):
        part = g[i : i + window]
        p = i + max(j for j, x in enumerate(part) if x == min(part))
        if (g[p], p) not in out:
            out.append((g[p], p))
    return out, len(words)


def test_fingerprints_against_brute_force(spark):
    docs = cases.clashing(spark)
    texts = {str(r.doc_id): r.text for r in docs.collect()}
    for r in fingerprints(docs).collect():
        want, n = plain(texts[str(r.doc_id)])
        got = [(x.hash, x.position) for x in r.fingerprint]
        assert got == want if n >= 5 or not n else len(got) == 1


def test_shared_passages_are_met(spark):
    passage = " ".join(f"p{i}" for i in range(20))
    rows = [(1, f"a b c d {passage} e f", "en", "s", 1), (2, f"{passage} " + " ".join(f"q{i}" for i in range(50)), "en", "s", 1)]
    a, b = ({x.hash for x in r.fingerprint} for r in fingerprints(cases.table(spark, rows)).collect())
    assert a & b


def test_edited_texts(spark):
    docs = cases.documents(spark)
    for per_bucket in (2, 1000):
        got = edited_fingerprints(docs, per_bucket=per_bucket).collect()
        rows = sorted((r for r in docs.collect() if r.doc_id is not None), key=lambda r: (r.doc_id, r.text or ""))
        nexts = [rows[(i + 1) % len(rows)].text or "" for i in range(len(rows))]
        want = []
        for r, n in [*zip(rows, nexts, strict=True), *[(r, "") for r in docs.collect() if r.doc_id is None]]:
            t = r.text or ""
            half = len(t) // 2
            edited = t[: len(t) - half] + n[:half]
            a, b = ({h for h, _ in plain(x)[0]} for x in (t, edited))
            near = 1.0 if not t.strip() and not edited.strip() else None
            if plain(t)[1] >= 5 and plain(edited)[1] >= 5:
                near = len(a & b) / len(a | b)
            want.append((str(r.doc_id), len(t), hashlib.sha256(edited.encode()).hexdigest(), near))
        assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256) for r in got) == sorted(w[:3] for w in want)
        likeness = {w[0]: w[3] for w in want if w[3] is not None}
        assert all(abs(r.near_edited - likeness[str(r.doc_id)]) < 1e-12 for r in got if str(r.doc_id) in likeness)
        assert all(0 <= r.near_next <= 1 for r in got)


def test_alone_and_empty(spark):
    one = edited_fingerprints(cases.table(spark, [(1, "ab cd", "en", "s", 1)])).first()
    assert one.edited_sha256 == hashlib.sha256(b"ab ab").hexdigest() and one.near_next == 1.0
    assert edited_fingerprints(cases.empty(spark)).count() == 0
