import heapq
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tests.llm import cases
from wardenflow.llm.lm_score import DEPTH, Codes, Mixer, Vocabulary, huffman_lengths, key_of, score, stretches


def test_huffman_is_optimal():
    draw = random.Random(1)
    for n in (2, 3, 10, 300):
        w = [draw.randint(1, 1000) for _ in range(n)]
        heap, cost = w[:], 0
        heapq.heapify(heap)
        while len(heap) > 1:
            x = heapq.heappop(heap) + heapq.heappop(heap)
            cost += x
            heapq.heappush(heap, x)
        lengths = huffman_lengths(np.array(w))
        assert (lengths * np.array(w)).sum() == cost and (2.0 ** -lengths).sum() == pytest.approx(1)


def test_codes_cut_at_depth_keep_the_probability():
    w = np.array([2**i for i in range(20)] + [1])
    codes = Codes.of(w)
    assert codes.length.max() == DEPTH
    deep = np.flatnonzero(huffman_lengths(w) > DEPTH)
    tops = Counter(codes.top[deep].tolist())
    for top in tops:
        assert (10.0 ** codes.tail[deep[codes.top[deep] == top]]).sum() == pytest.approx(1, rel=1e-4)


def test_probabilities_of_all_words_sum_to_one():
    keys = np.array(sorted(key_of(w) for w in (b"a", b"b", b"c", b"")), np.uint64)
    v = Vocabulary(keys, np.array([5, 3, 2, 4]), rare=3)
    mixer = Mixer.of(np.zeros(2 * sum(1 << b for b in (21, 22)), np.uint32))
    total = 0.0
    for word in ("a", "b", "c", ""):
        part, piece = next(stretches([word], v))
        out = np.zeros(1)
        mixer.add_scores(v.words, piece.streams[0].at(slice(0, 1)), 1, 0, out)
        total += math.exp(out[0])
    escape = 3 / 17
    assert total == pytest.approx(1 - escape, abs=0.03)


def base_scores(rows):
    words = lambda t: re.findall("[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")) + [None]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    seen = Counter(w for r in rows if not held(r.doc_id) for w in words(r.text))
    n, v = sum(seen.values()), len(seen)
    return {str(r.doc_id): (held(r.doc_id), len(words(r.text)), sum(w in seen for w in words(r.text)), n, sum(math.log10((seen[w] + 1) / (n + v + 1)) for w in words(r.text))) for r in rows}


def test_base_scores_and_rare_words(spark):
    docs = cases.clashing(spark)
    want = base_scores(docs.collect())
    for r in score(docs, vocabulary=4).collect():  # most words are looked up by the join
        held, n, known, total, base = want[str(r.doc_id)]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score < 0


def test_context_helps_and_batches_do_not_matter(spark):
    draw = random.Random(4)
    chain = {w: draw.sample("abcdefghijklmnop", 2) for w in "abcdefghijklmnop"}

    def text():
        w, out = draw.choice("abcdefghijklmnop"), []
        for _ in range(200):
            out.append(w)
            w = draw.choice(chain[w])
        return " ".join(out)

    docs = cases.table(spark, [(i, text(), "en", "s", 1) for i in range(120)])
    got = score(docs).toPandas().set_index("doc_id").sort_index()
    assert got[got.held_out].score.sum() > 0.6 * got[got.held_out].base_score.sum()  # one of two words, not of sixteen
    again = score(docs.repartition(7)).toPandas().set_index("doc_id").sort_index()
    assert np.allclose(got.score, again.score, rtol=1e-4)


def test_empty(spark):
    assert score(cases.empty(spark)).count() == 0
    alone = score(cases.table(spark, [(i, "x y", "en", "s", 1) for i in range(30) if zlib.crc32(str(i).encode()) % 7 == 2])).collect()
    assert alone and all(r.train_tokens == 0 and r.n_known == 0 and r.base_score == 0 for r in alone)


def test_each_bit_is_mixed_and_moves_its_weights():
    draw = random.Random(7)
    words = [f"w{n}".encode() for n in range(3000)]
    keys, counts = zip(*sorted((key_of(w), 1 + 30000 // (n + 1)) for n, w in enumerate([*words, b""])), strict=True)
    v = Vocabulary(np.array(keys, np.uint64), np.array(counts), rare=50)
    assert v.words.length.max() == huffman_lengths(np.r_[v.counts, 50]).max() > 10 and not v.words.tail.any()
    table = np.random.default_rng(7).integers(0, 9, 2 * sum(1 << b for b in (21, 22))).astype(np.uint32)
    mixer = Mixer.of(table)
    texts = [" ".join(f"w{min(2999, int(draw.paretovariate(0.4)))}" for _ in range(draw.choice((0, 3, 40, 90)))) for _ in range(60)]
    _, piece = next(stretches(texts, v))
    got = np.zeros(len(texts))
    mixer.add_scores(v.words, piece.streams[0], len(texts), 0, got)
    s, path = piece.streams[0], {}
    for d, (here, value, node, (one, two)) in enumerate(s.bits(v.words)):
        for i, b, n, x, y in zip(here, value, node, one, two, strict=True):
            path[int(i), d] = (int(b), int(n), int(x), int(y))
    want, weights = [0.0] * len(texts), {}
    for (i, d), (b, n, x, y) in sorted(path.items()):
        k, a1, a2 = int(s.doc[i]), int(mixer.odds[0][x]), int(mixer.odds[1][y])
        w = weights.setdefault((k, (a1 & 1) + 2 * (a2 & 1) + 4 * (d > 2)), None) or mixer.first_weights()[(a1 & 1) + 2 * (a2 & 1) + 4 * (d > 2)].tolist()
        inputs = [float(v.words.odds[n]), a1 / 12, a2 / 12]
        p = 1 / (1 + math.exp(-max(-11.5, min(11.5, sum(p * q for p, q in zip(w, inputs, strict=True))))))
        want[k] += math.log(p if b else 1 - p)
        weights[k, (a1 & 1) + 2 * (a2 & 1) + 4 * (d > 2)] = [p_ + mixer.rate * (b - p) * q for p_, q in zip(w, inputs, strict=True)]
    assert np.allclose(got, want, rtol=1e-4)


def test_documents_side_by_side_score_as_alone(monkeypatch):
    """Scores do not depend on which documents go together nor on how many of their symbols and bits do."""
    from wardenflow.llm import lm_score

    draw = random.Random(8)
    words = [f"w{n}".encode() for n in range(300)]
    keys, counts = zip(*sorted((key_of(w), 1 + 3000 // (n + 1)) for n, w in enumerate([*words, b""])), strict=True)
    v = Vocabulary(np.array(keys, np.uint64), np.array(counts), rare=50)
    mixer = Mixer.of(np.random.default_rng(8).integers(0, 9, 2 * sum(1 << b for b in (21, 22))).astype(np.uint32))
    texts = [" ".join(f"w{draw.randrange(330)}" for _ in range(draw.choice((0, 1, 30, 90, 400)))) for _ in range(70)]

    def scores(texts):
        got = np.zeros(len(texts))
        streams = [[], []]
        for part, piece in stretches(texts, v, 500):
            for own, stream in zip(streams, piece.streams, strict=False):
                stream.doc += part[0]
                own.append(stream)
        for number, (codes, own) in enumerate(zip(v.codes, streams, strict=True)):
            if own:
                mixer.add_scores(codes, lm_score.Stream.joined(own), len(texts), number, got)
        return got

    alone = np.concatenate([scores([t]) for t in texts])
    assert np.allclose(scores(texts), alone, rtol=1e-4)
    monkeypatch.setattr(lm_score, "FORWARD", 900)
    monkeypatch.setattr(lm_score, "AT_ONCE", 700)
    monkeypatch.setattr(lm_score, "FEW", 3)
    assert np.allclose(scores(texts), alone, rtol=1e-4)
