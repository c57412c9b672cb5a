import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tests.llm import cases
from wardenflow.llm.packing import Encoder, best_fit, cut, local_search, pack, packed

PATH = public_tokenizers.path("byte_bpe_50k.json")


def plain_ids(text):
    return Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids


def test_encoder_gives_the_tokenizers_ids():
    texts = ["", " ", "  a  b ", "a\n b", "x \n y", "don't we'll I'M", " \tz", "日本 語 é　 ç  ", "<|endoftext|> hi", "a<|endoftext|>", *[f"x {t.content}y" for t in Tokenizer.from_file(PATH).get_added_tokens_decoder().values()], "a\x1c b\n\n", " " * 20_000 + "x", "ab" * 3000]
    encode = Encoder(PATH)
    for text in texts:
        assert encode(text) == np.array(plain_ids(text), "<u4").tobytes(), text[:30]


def test_cut():
    assert cut(bytes(4 * 5), 4) == [(0, 1), (1, 4)]
    assert cut(bytes(4 * 8), 4) == [(0, 4), (4, 4)]
    assert cut(bytes(4 * 3), 4) == [(0, 3)]


def test_local_search_keeps_items_and_never_adds_bins():
    draw = random.Random(1)
    for _ in range(30):
        lengths = [draw.randint(1, 100) for _ in range(draw.randint(1, 200))]
        first = best_fit(lengths, 100)
        bins = local_search([list(b) for b in first], lengths, 100)
        assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
        assert all(sum(lengths[i] for i in b) <= 100 for b in bins)
        assert len(bins) <= len(first)


def test_exchanges_empty_a_bin():
    lengths = [70, 20, 30, 60, 20]  # 30 for 20 fills the first bin, then 20 moves into the last
    bins = local_search([[0, 1], [2], [3, 4]], lengths, 100)
    assert sorted(sum(lengths[i] for i in b) for b in bins) == [100, 100]
    lengths = [70, 15, 12, 13, 50, 35]  # two for one: 12 and 13 for 15 leave 15, which moves
    bins = local_search([[0, 1], [2, 3], [4, 5]], lengths, 95)
    assert len(bins) <= 3 and sorted(i for b in bins for i in b) == [*range(6)]
    assert len(pack([60, 40, 50, 50, 99, 1], 100)) == 3


def test_search_gains_over_its_start():
    draw = random.Random(7)
    middling = [draw.randint(250, 520) for _ in range(2000)]
    spread = [draw.randint(1, 1023) for _ in range(2000)]
    for lengths, share in ((middling, 0.97), (spread, 1.0)):
        starts = [best_fit(lengths, 1024, falling) for falling in (True, False)]
        ends = [local_search(x, lengths, 1024) for x in starts]
        assert len(ends[1]) < len(starts[1])  # from order of arrival it always empties bins
        best = pack(lengths, 1024)
        assert len(best) == min(map(len, ends)) <= share * len(starts[0])
        squares = lambda bins: sum(sum(lengths[i] for i in b) ** 2 for b in bins)
        assert all(squares(e) >= squares(s) for s, e in zip(starts, ends))
    assert len(pack([1] * 5000, 1024)) == 5  # very many short items


def test_ids_that_are_no_numbers(spark):
    rows = [("a", "x y"), (None, "z"), ("b", None)]
    got = packed(spark.createDataFrame(rows, "doc_id string, text string"), PATH).collect()
    assert sorted(str(r.doc_id) for r in got) == ["None", "a", "b"]
    big = (1 << 60) + 1  # beyond what a float holds, beside a null id
    got = packed(spark.createDataFrame([(big, "x"), (None, "y")], "doc_id long, text string"), PATH).collect()
    assert {r.doc_id for r in got} == {big, None}


def test_round_trip(spark):
    docs = cases.documents(spark)
    got = packed(docs, PATH, size=64, group=500).toPandas()
    want = sorted((str(r.doc_id), zlib.crc32(np.array(plain_ids(r.text or "") + [2], "<u4").tobytes())) for r in docs.collect() if len(plain_ids(r.text or "")) < 64)
    once = got[(got.start == 0) & (got.groupby("doc_id", dropna=False).piece.transform("max") == 0)]
    assert sorted(("None" if x != x or x is None else str(int(x)), c) for x, c in zip(once.doc_id.astype("object"), once.ids_crc32)) == want
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert (g.offset == g.length.cumsum().shift(fill_value=0)).all() and g.length.sum() <= 64
    long = got[got.doc_id == 9].sort_values("piece")
    ids = plain_ids("word " * 30_000) + [2]
    assert long.length.sum() == len(ids) and (long.length[1:] == 64).all()
    assert all(zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes()) == c for s, n, c in zip(long.start, long.length, long.ids_crc32))


def test_empty(spark):
    assert packed(cases.empty(spark), PATH).count() == 0
    assert packed(cases.clashing(spark), PATH).count() > 0
