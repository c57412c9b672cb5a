import hashlib
import re

from tests.llm import cases
from wardenflow.llm.exact_dedup import drop_exact_copies, exact_dedup


def brute(rows):
    groups = {}
    for n, r in enumerate(rows):
        sha = hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "").encode()).hexdigest()
        groups.setdefault(sha, []).append((r.doc_id is None, r.doc_id, n))
    out = []
    for sha, members in groups.items():
        first = min(members, key=lambda x: (x[0], x[1] or 0, x[2]))
        out += [(i, first[1], len(members), (a, i, n) == first, sha) for a, i, n in members]
    return sorted(map(repr, out))


def test_against_brute_force(spark):
    docs = cases.documents(spark)
    assert sorted(repr(tuple(r)) for r in exact_dedup(docs).collect()) == brute(docs.collect())


def test_heavy_digests_go_map_side(spark):
    rows = [(i, "copy" if i % 2 else f"text {i % 300}", "en", "a", 1) for i in range(2000)]
    docs = cases.table(spark, rows).repartition(7)
    got = sorted(repr(tuple(r)) for r in exact_dedup(docs).collect())
    assert got == brute(docs.collect())


def test_rows_that_stay(spark):
    kept = drop_exact_copies(cases.clashing(spark))
    assert kept.columns == cases.clashing(spark).columns
    # " \n " becomes one space, so it is no copy of the empty text
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "10", "11", "3", "4", "6", "7", "9"]


def test_repeated_rows_leave_one(spark):
    docs = cases.table(spark, [(1, "a b", "en", "a", 1)] * 3 + [(None, "c", "en", "a", 1)] * 2)
    assert sorted(str(r.doc_id) for r in drop_exact_copies(docs).collect()) == ["1", "None"]


def test_empty(spark):
    assert exact_dedup(cases.empty(spark)).count() == 0
    assert drop_exact_copies(cases.empty(spark)).count() == 0
