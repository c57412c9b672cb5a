import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm import cases
from wardenflow.llm.importance import draw, features, importance

LOW = {c: c + 32 for c in range(65, 91)}


def runs(text, buckets=10_000):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))
    return len(words), [zlib.crc32(x.encode()) % buckets for x in words + [f"{a} {b}" for a, b in zip(words, words[1:])]]


def brute(rows, target, percent=25, least=20, buckets=10_000):
    own, s, t = [runs(r.text, buckets) for r in rows], Counter(), Counter()
    for _, f in own:
        s.update(f)
    for r in target:
        t.update(runs(r.text, buckets)[1])
    S, T = sum(s.values()), sum(t.values())
    out = []
    for n, (r, (words, f)) in enumerate(zip(rows, own, strict=True)):
        gain = [math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in f]
        weight = sum(gain) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if r.doc_id is None else r.doc_id}".encode()).hexdigest()[:8], 16)
        out.append([r.doc_id, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, words, n])
    long = sorted((x for x in out if x[5] >= least), key=lambda x: (-x[3], x[0] is None, x[0] or 0, x[6]))
    for k, x in enumerate(long[: percent * len(long) // 100]):
        x[4] = k + 1
    return sorted(repr(tuple(x[:5])) for x in out)


def result(df):
    return sorted(repr(tuple(r)[:5]) for r in df.collect())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from("aB9 .éß字😀-_Z"), max_size=40), max_size=6), st.integers(1, 30))
def test_features_against_brute_force(texts, most):
    words, found = features(pa.array(texts, pa.string()), 997, most)
    at = 0
    for text, n in zip(texts, words.tolist(), strict=True):
        want_n, want = runs(text, 997)
        assert n == want_n and sorted(found[at : at + len(want)].tolist()) == sorted(want)
        at += len(want)
    assert at == len(found)


def test_features_of_long_words_and_slices():
    texts = ["x" * 63 + " " + "Y" * 64 + " " + "z" * 65 + " q " + "w" * 300_000, "a" * 70, "b c"]
    array = pa.array(["skipped words", *texts], pa.string()).slice(1)
    for most in (50, 1 << 20):
        words, found = features(array, 10_000, most)
        assert words.tolist() == [5, 1, 2]
        assert sorted(found.tolist()) == sorted(b for t in texts for b in runs(t)[1])


def test_against_brute_force(spark):
    docs, target = cases.clashing(spark), cases.table(spark, [(1, cases.EN, "en", "a", 1), (2, None, None, None, 0)])
    assert result(importance(docs, target, percent=60, least_words=3)) == brute(docs.collect(), target.collect(), 60, 3)


def test_whole_table(spark):
    docs, target = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "benchmark"))
    got = importance(docs, target)
    assert result(got) == brute(docs.collect(), target.collect())


def test_copies_and_ties(spark):
    rows = [(5 if i % 3 else i, "same words here " * 9 if i % 2 else f"other text {i} " * 9, "en", "a", 1) for i in range(300)]
    docs = cases.table(spark, rows).repartition(5)
    target = cases.table(spark, rows[:3])
    assert result(importance(docs, target)) == brute(docs.collect(), target.collect())


def test_drawn_rows(spark):
    docs, target = cases.clashing(spark), cases.table(spark, [(1, cases.EN, "en", "a", 1)])
    got = draw(docs, target, percent=50, least_words=3)
    assert got.columns == docs.columns
    ranks = importance(docs, target, percent=50, least_words=3).filter("rank is not null")
    assert {r.doc_id for r in got.collect()} == {r.doc_id for r in ranks.collect()}


def test_target_is_preferred(spark):
    rows = [(i, (cases.EN if i % 2 else cases.DE) + f" {i}", "", "a", 1) for i in range(400)]
    target = cases.table(spark, [(1, cases.DE, "de", "b", 1)])
    drawn = [r.doc_id % 2 for r in importance(cases.table(spark, rows), target, least_words=5).filter("rank is not null").collect()]
    assert len(drawn) == 100 and np.mean(drawn) < 0.45


@pytest.mark.parametrize("empty_side", ["docs", "target"])
def test_empty(spark, empty_side):
    docs = cases.empty(spark) if empty_side == "docs" else cases.documents(spark)
    target = cases.empty(spark)
    assert result(importance(docs, target)) == brute(docs.collect(), [])
