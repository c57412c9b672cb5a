import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.llm import cases
from wardenflow.llm.token_files import Encoder, IndexPart, PerfectHash, TokenFiles, write_token_files, written_tokens

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(VOCABULARY)


def brute(rows, tokenizer):
    """doc_id, start, n_tokens, ids_crc32 in order of ids, null ones last."""
    out, at = [], 0
    for r in sorted(rows, key=lambda r: (r.doc_id is None, r.doc_id or 0)):
        ids = np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4")
        out.append((r.doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def in_order(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: (r[1], r[2]))


@pytest.mark.parametrize("shard_bytes,part_keys", [(32 << 20, 1 << 16), (4_000, 3)])
def test_against_brute_force(spark, tokenizer, shard_bytes, part_keys):
    docs = cases.clashing(spark).repartition(3)
    path = write_token_files(docs, VOCABULARY, shard_bytes=shard_bytes, part_keys=part_keys)
    assert in_order(TokenFiles(path).lookup(docs)) == brute(docs.collect(), tokenizer)


def test_whole_table(spark, tokenizer):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert in_order(written_tokens(docs, VOCABULARY)) == brute(docs.collect(), tokenizer)


def test_one_key_at_a_time(spark, tokenizer):
    docs = cases.documents(spark)
    files = TokenFiles(write_token_files(docs, VOCABULARY, shard_bytes=4_000, part_keys=3))
    wanted = {}
    for r in sorted(docs.collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0)):
        wanted.setdefault(r.doc_id, []).append([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2])
    for key, texts in wanted.items():
        assert [x.tolist() for x in files[key]] == texts
    assert files[12345] == [] and files["n"] == []


def test_a_key_with_most_rows_spreads_over_shards(spark, tokenizer):
    docs = cases.table(spark, [(7 if i % 10 else i, f"text number {i}", "en", "a", 1) for i in range(600)])
    files = TokenFiles(write_token_files(docs, VOCABULARY, shard_bytes=1_000, part_keys=16))
    assert len(files.shards) > 5
    got = in_order(files.lookup(docs, with_ids=True))
    assert [x[1] for x in got] == np.concatenate([[0], np.cumsum([x[2] for x in got])])[:-1].tolist()
    texts = sorted(tokenizer.decode(np.frombuffer(x[4], files.dtype)[:-1].tolist()) for x in got if x[0] == 7)
    assert texts == sorted(f"text number {i}" for i in range(600) if i % 10 or i == 7)


def test_keys_of_text_and_absent_ones(spark):
    rows = [("a\nb", "x"), ("a\\nb", "y"), ("n", "z"), (None, "w")]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    files = TokenFiles(write_token_files(docs, VOCABULARY))
    asked = spark.createDataFrame([("a\nb",), ("absent",), (None,), ("n",)], "doc_id string")
    assert sorted((str(r.doc_id), r.n_tokens) for r in files.lookup(asked).collect()) == [("None", 2), ("a\nb", 2), ("n", 2)]
    assert [len(files[k]) for k in ("a\nb", "a\\nb", "n", None, "absent")] == [1, 1, 1, 1, 0]


def test_empty(spark):
    docs = cases.empty(spark)
    assert written_tokens(docs, VOCABULARY).collect() == []
    assert TokenFiles(write_token_files(docs, VOCABULARY))[1] == []


def test_perfect_hash_is_minimal():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 1000, 50_000):
        keys = rng.integers(0, 1 << 63, n).astype("u8")
        perfect = PerfectHash.build(keys)
        assert sorted(perfect.slots(keys).tolist()) == list(range(n))
        if n >= 1000:
            assert 64 * len(perfect.words) / n < 4.5  # bits a key


def test_equal_hashes_are_listed():
    keys = [f"k{i}" for i in range(100)]
    h1 = np.arange(100).astype("u8")
    h1[10:13] = 10
    finger = np.arange(100).astype("<u4")
    values = {"fingerprint": finger, "shard": finger, "place": finger.astype("<u8"), "rows": finger.astype("<u8")}
    part = IndexPart(IndexPart.build(keys, h1, values))
    slot = part.find(keys, h1, finger)
    assert sorted(slot.tolist()) == list(range(100)) and part.held["shard"][slot].tolist() == list(range(100))
    assert (part.find(["kx"], np.array([5000], "u8"), np.array([1], "<u4")) == -1).all()


TEXTS = [
    "",
    " ",
    "a  b\n\n c\t\t",
    "It's we'll  they'RE 'd 12 34x",
    "Größe ¼ ² ª º x\xa0y\x85z ǅ ƻ ɐ",
    "naïve façade \xad soft",
    "日本語 テキスト ١٢٣ 𝟙 Ⅷ",
    "x\x1cy\x1f \x00\x7f",
    "emoji 😀😀 ok line",
    "<|endoftext|> inside <|endoftext|>",
    "x" * 5000,
    " " * 5000 + "y",
    "!?!?... -- ''",
    "́combining é à́",
]


@pytest.mark.parametrize("text", TEXTS)
def test_ids_are_those_of_tokenizers(tokenizer, text):
    encode = Encoder(VOCABULARY)
    for t in (text, text):  # asked for, then kept
        assert np.frombuffer(encode(t), encode.dtype).tolist() == tokenizer.encode(t, add_special_tokens=False).ids


def test_ids_of_all_characters(tokenizer):
    encode = Encoder(VOCABULARY)
    for low in range(0, 0x3000, 64):
        text = "".join(f"{chr(c)}{chr(c)} {chr(c)}a{chr(c)}1{chr(c)}." for c in range(low, low + 64))
        assert np.frombuffer(encode(text), encode.dtype).tolist() == tokenizer.encode(text, add_special_tokens=False).ids, low


def test_other_vocabularies_are_encoded_whole(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    other, encode = Tokenizer.from_file(path), Encoder(path)
    assert not encode.by_word
    assert np.frombuffer(encode("Some Words"), encode.dtype).tolist() == other.encode("Some Words", add_special_tokens=False).ids
