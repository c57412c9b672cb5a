import random
import zlib

import numpy as np

from tests.llm import cases
from wardenflow.llm.language_id import fit, identify, keep_identified

WORDS = {"en": "the of and to in is that it for was with as on be this by", "de": "der die und das ist nicht ein mit von auf für sich dem werden", "fr": "le la les des est que dans pour une pas sur avec plus nous"}


def texts(n, seed=1):
    draw = random.Random(seed)
    return [(i, " ".join(draw.choices(WORDS[lang].split(), k=draw.randint(5, 60))), lang, "s", 1) for i in range(n) for lang in [draw.choice(sorted(WORDS))]]


def test_held_out_accuracy(spark):
    rows = texts(600)
    got = identify(cases.table(spark, rows), landmarks=30).toPandas().set_index("doc_id")
    assert all(got.held_out[i] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, *_ in rows)
    right = [got.lang_pred[i] == lang for i, _, lang, *_ in rows if got.held_out[i]]
    assert np.mean(right) > 0.97 and got.score.between(0, 1).all()


def test_kernel_is_shared_presence_over_norms():
    model = fit(["abab", "cdcd ab"], ["x", "y"], landmarks=2, orders=2)
    grams = lambda t, n: {t[i : i + n] for i in range(len(t) - n + 1)}

    def kernel(a, b):
        return np.mean([len(grams(a, n) & grams(b, n)) / np.sqrt(len(grams(a, n)) * len(grams(b, n))) for n in (1, 2)])

    got = model.grams.matrix(["abab", "ab"]) @ model.landmarks
    want = [[kernel(t, m) for m in ("abab", "cdcd ab")] for t in ("abab", "ab")]
    assert np.allclose(got, want, atol=1e-6)


def test_awkward_rows(spark):
    docs = cases.clashing(spark)
    got = {str(r.doc_id): r for r in identify(docs).collect()}
    assert {i for i, r in got.items() if r.lang_pred == "und"} == {"4", "5", "6", "7"} and got["7"].score == 0
    kept = keep_identified(docs)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(["1", "2", "3", "8", "8", "None", "9", "10", "11"])
    assert identify(cases.empty(spark)).count() == 0
    unlabelled = cases.table(spark, [(1, "some words", None, "s", 1)])
    assert [(r.lang_pred, r.score) for r in identify(unlabelled).collect()] == [("und", 0.0)]
