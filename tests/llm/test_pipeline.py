import re
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import cases
from tests.llm.test_simhash_dedup import components, plain_simhash
from wardenflow.llm.mixing import mix


def test_stages_against_brute_force(spark, tmp_path):
    rows = [(i, f"{cases.EN} number {i % 9} of {'many ' * (i % 5)}", "en", "abc"[i % 3], 1) for i in range(40)]
    docs = cases.table(spark, rows).unionByName(cases.documents(spark).filter("doc_id is null or doc_id > 3").withColumn("doc_id", F.col("doc_id") + 100))
    folder = str(tmp_path / "in")
    docs.write.parquet(f"{folder}/documents.parquet")
    steps, now = {}, spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        steps[name] = now
        now = stage(spark, now, folder)
        if name != "best_fit_packing":
            assert now.columns == docs.columns
            now.write.parquet(f"{tmp_path}/{name}")
            now = spark.read.parquet(f"{tmp_path}/{name}")
    # language: what has no letter goes
    assert {r.doc_id for r in steps["exact_dedup"].collect()} == {r.doc_id for r in docs.collect() if r.text and re.search(r"[^\W\d_]", r.text)}
    # exact: the smallest id of equal texts
    first = {}
    for r in sorted(steps["exact_dedup"].collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0)):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r.text), r.doc_id)
    assert sorted(map(str, first.values())) == sorted(str(r.doc_id) for r in steps["simhash_near_dedup"].collect())
    # near: the smallest id of linked fingerprints
    fps = {r.doc_id: plain_simhash(r.text) for r in steps["simhash_near_dedup"].collect()}
    label, least = components(set(fps.values())), {}
    for i, x in fps.items():
        if i is not None:
            least[label[x]] = min(least.get(label[x], i), i)
    want = sorted(map(str, [*least.values(), *[None for i in fps if i is None]]))
    assert sorted(str(r.doc_id) for r in steps["source_mixing"].collect()) == want
    # mixing: as many copies as the mix says
    copies = {r.doc_id: r.copies for r in mix(steps["source_mixing"]).collect()}
    assert Counter(r.doc_id for r in steps["best_fit_packing"].collect()) == Counter({i: n for i, n in copies.items() if n})
    # packing: every row whole, no sequence too long
    pieces = now.toPandas()
    assert (pieces.groupby("sequence_id").length.sum() <= 1024).all()
    assert (pieces[pieces.start == 0].shape[0]) == steps["best_fit_packing"].count()


def test_run_on_empty(spark, tmp_path):
    cases.empty(spark).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
