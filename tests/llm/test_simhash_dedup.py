import random
import re

import numpy as np
import xxhash

from tests.llm import cases
from wardenflow.llm.components import connected_components
from wardenflow.llm.simhash_dedup import chained, drop_near_copies, finer, fingerprint_links, near_groups, ring_masks


def plain_simhash(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", text)
    if not words:
        return 0
    parts = [" ".join(words)] if len(words) < 3 else [" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(fps):
    """Smallest fingerprint that each one reaches."""
    label, fps = {x: x for x in fps}, sorted(fps)
    changed = True
    while changed:
        changed = False
        for a in fps:
            for b in fps:
                if (a ^ b).bit_count() <= 3 and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return label


def test_fingerprints_and_groups(spark):
    docs = cases.clashing(spark)
    got = near_groups(docs).collect()
    assert sorted((str(r.doc_id), r.fingerprint) for r in got) == sorted((str(r.doc_id), f"{plain_simhash(r.text):016x}") for r in docs.collect())
    label = components({plain_simhash(r.text) for r in docs.collect()})
    least = {}
    for r in docs.collect():
        if r.doc_id is not None:
            root = label[plain_simhash(r.text)]
            least[root] = min(least.get(root, r.doc_id), r.doc_id)
    assert all(r.component_id == least[label[int(r.fingerprint, 16)]] for r in got)


def test_ring_misses_no_close_pair():
    draw = random.Random(3)
    masks = ring_masks()
    assert len(masks) == 20 and all(m.bit_count() == 32 for m in masks)
    for _ in range(20_000):
        x = draw.getrandbits(64)
        y = x
        for b in draw.sample(range(64), draw.randint(0, 3)):
            y ^= 1 << b
        shared = [m for m in masks if x & m == y & m]
        assert shared
        assert any(x & f == y & f for m in shared for f in finer(m))
        assert chained(np.uint64(x), np.array([y], np.uint64))[0]


def test_chain_condition_keeps_far_pairs_out():
    draw = random.Random(4)
    x = np.array([draw.getrandbits(64) for _ in range(3000)], np.uint64)
    y = x.copy()
    for i in range(len(y)):
        for b in draw.sample(range(64), draw.randint(0, 8)):
            y[i] ^= np.uint64(1 << b)
    assert (chained(x, y) == (np.bitwise_count(x ^ y) <= 3)).all()


def test_crowded_keys_are_split_without_loss(spark):
    draw = random.Random(5)
    centre, fps = draw.getrandbits(64), set()
    for _ in range(600):  # a dense ball and loose points
        x = centre
        for b in draw.sample(range(64), draw.randint(0, 6)):
            x ^= 1 << b
        fps |= {x, draw.getrandbits(64)}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    links = fingerprint_links(spark.createDataFrame([(signed(x),) for x in fps], "fp long"), crowd=20)
    got = {r.node: r.component for r in connected_components(links).collect()}
    want = components(fps)
    groups, seen = {}, {}
    for x in fps:
        groups.setdefault(want[x], set()).add(x)
        seen.setdefault(got.get(signed(x), signed(x)), set()).add(x)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, seen.values()))


def test_components_of_a_path_and_no_edges(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(500, 500), (None, 3), (200, 201)], "a long, b long")
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert got == {i: 0 for i in range(101)} | {200: 200, 201: 200}
    assert connected_components(edges.limit(0)).count() == 0


def test_rows_that_stay(spark):
    kept = drop_near_copies(cases.documents(spark))
    assert kept.columns == cases.documents(spark).columns
    ids = sorted(str(r.doc_id) for r in kept.collect())
    assert ids.count("8") <= 1 and "1" in ids and "2" not in ids and "None" in ids
    assert near_groups(cases.empty(spark)).count() == 0
