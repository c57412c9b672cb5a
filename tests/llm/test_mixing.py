import random
import re

import pytest

from tests.llm import cases
from wardenflow.llm.mixing import mix, mixed_documents, pareto_sample, targets


def resharing(sizes, weights=(5, 2, 1), most=3):
    """The contract's loop: share by weight, cap, reshare the excess."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    target, left, open_ = dict.fromkeys(names, 0.0), float(sum(sizes.values())), set(names)
    while open_ and left > 1e-9:
        total = sum(weight[s] for s in open_)
        share = {s: left * weight[s] / total for s in open_}
        left = 0.0
        for s in [*open_]:
            target[s] += share[s]
            if target[s] >= most * sizes[s]:
                left += target[s] - most * sizes[s]
                target[s] = most * sizes[s]
                open_.discard(s)
    return target


def test_targets_follow_the_resharing(spark):
    draw = random.Random(2)
    for _ in range(4):
        sizes = {f"s{i}": draw.randint(1, 10 ** draw.randint(1, 5)) for i in range(draw.randint(1, 9))} | {None: draw.randint(0, 50)}
        rows = spark.createDataFrame([*sizes.items()], "source string, size long")
        got = {r.source: r.target for r in targets(rows).collect()}
        want = resharing(sizes)
        assert all(got[s] == pytest.approx(want[s], rel=1e-9) for s in sizes)


def test_taken_comes_near_the_targets(spark):
    draw = random.Random(3)
    rows = [(i, "w " * draw.randint(0, 60), "en", draw.choice("aaab"), 1) for i in range(1500)]
    docs = cases.table(spark, rows)
    got = mix(docs, buckets=16).toPandas()
    again = mix(docs.repartition(5), buckets=16).toPandas()
    assert sorted(zip(got.doc_id, got.taken)) == sorted(zip(again.doc_id, again.taken))
    assert (got.taken <= 3 * got["size"]).all()
    for (_, target), part in got.groupby(["source_size", "target"]):
        assert abs(part.taken.sum() - target) <= 60
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for i, t, *_ in rows}
    assert all(size[i] == n for i, n in zip(got.doc_id, got["size"]))


def test_copies_become_rows(spark):
    docs = cases.clashing(spark)
    out = mixed_documents(docs)
    assert out.columns == docs.columns
    taken = mix(docs).filter("size > 0").agg({"taken": "sum"}).first()[0]
    words = sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in out.collect())
    assert abs(words - taken) <= 2 * 17  # the repeated row is taken alike


def test_empty_and_zero(spark):
    assert mix(cases.empty(spark)).count() == 0
    only = mix(cases.table(spark, [(1, None, None, None, None), (2, " ", "en", "a", 1)])).collect()
    assert [(r.size, r.target, r.taken) for r in only] == [(0, 0.0, 0), (0, 0.0, 0)]


def test_a_long_document_does_not_end_the_sample(spark):
    # half of 4000 words wanted; a document of 1000 comes in order when 1400 are taken, 600 short ones fit behind it
    rows = [(i, i, "a", 1, (i + 0.5) / 3000, 0.5, 2000.0) for i in range(3000)] + [(3000, 3000, "a", 1000, 1400.2 / 3000, 0.5, 2000.0)]
    rows += [(4000 + i, i, None, 40 + i % 90, ((i * 7919) % 500 + 0.5) / 500, 0.4, 15_000.0) for i in range(500)] + [(5000, 5000, None, 9_000, 0.2, 0.4, 15_000.0)]
    docs = spark.createDataFrame(rows, "row long, doc_id long, source string, size long, u double, probability double, wanted double")
    got = pareto_sample(docs, buckets=16).toPandas()
    assert len(got) == len(rows) and got.row.is_unique
    part = got[got.source == "a"]
    assert part[part.chosen]["size"].sum() == 2000 and not part[part["size"] == 1000].chosen.any()
    part = got[got.source.isna()]
    gap = 15_000 - part[part.chosen]["size"].sum()
    assert 0 <= gap < part[~part.chosen]["size"].min()
