"""Token ids of documents in raw binary shards, with a minimal perfect hash index from document keys to places.

A folder holds, all numbers little-endian:

    shard-00007.ids   ids of the shard's documents one after another, unsigned, 2 bytes each if the vocabulary allows, else 4
    shard-00007.off   unsigned 64-bit: where each document starts in it, counted in ids, and the end of the last
    index-00003.npz   one part of the index, see below
    manifest.json     width of an id, end id, documents and ids of each shard, number of index parts; written last

Shards follow each other in ascending order of keys (null keys last), so ids before a document are those of the shards
before and of its own shard up to it. A key's part of the index follows from its hash. A part has a minimal perfect hash:
at each level keys are hashed into a bit array of twice as many bits, keys alone on their bit are done, others go to the
next level; a key's slot is the number of bits set before its own. Slots hold a 32-bit fingerprint of the key, the shard
and place of its first document and how many documents have it. So access by key takes an expected constant number of
steps and two reads: its offsets and its ids. Keys that no level tells apart (equal 64-bit hashes) are listed in full.

A task writes under a name of its own and renames at the end, so a repeated task leaves the same files. No file or list
is gathered on the driver but the manifest, a row for each shard, ``MOST_SHARDS`` at most.

Defined results
    null or empty text   the end id alone
    null key             a key of its own, after all others
    repeated rows        each row is a document; access by their key gives all of them, in the order of their shards
    key that is absent   no row; a wrong one is taken for present with a chance of 2^-32
    very long text       encoded and written whole; a shard may be larger than asked for
    special tokens       their strings become their ids, as tokenizers has it
    empty table          a manifest without shards
    other columns        are not read
"""

from __future__ import annotations

import json
import re
import unicodedata
import uuid
import zlib
from collections.abc import Iterator
from io import BytesIO

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardenflow.llm.common import settle, shared_dir

MOST_SHARDS = 65_536
MOST_PARTS = 65_536
#: Seed of Spark's xxhash64, and the word that is hashed before a key for the second hash.
SEED, SALT = 42, "fingerprint"

# --- ids of a text ----------------------------------------------------------------------------------------------


def _latin_pattern(last: int = 0x24F) -> tuple[re.Pattern, re.Pattern]:
    """The splitting rule of byte-level BPE for texts up to ``last``, in the standard library's quicker engine; and what finds other characters."""
    kind = {chr(c): unicodedata.category(chr(c))[0] for c in range(last + 1)}
    space = "\t-\r \x85\xa0"
    letters, numbers = ("".join(c for c, k in kind.items() if k == want) for want in "LN")
    words = f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{numbers}]+| ?[^{space}{letters}{numbers}]+|[{space}]+(?![^{space}])|[{space}]+"
    return re.compile(words), re.compile(f"[^\0-{chr(last)}]")


def _byte_letters() -> list[str]:
    """The letter that a byte-level BPE writes for each byte: printable ones for themselves, others from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class _Words(dict):
    """Ids of words that have been asked for; a word that is not there is encoded, and kept unless it is long."""

    MOST, LONGEST = 1 << 20, 64

    def __init__(self, model, dtype: str):
        self.tokenize, self.dtype = model.tokenize, dtype
        self.letters = dict(enumerate(_byte_letters()))

    def __missing__(self, word: str) -> bytes:
        ids = np.array([t.id for t in self.tokenize(word.encode().decode("latin-1").translate(self.letters))], self.dtype).tobytes()
        if len(word) <= self.LONGEST:
            if len(self) >= self.MOST:
                self.clear()
            self[word] = ids
        return ids


class Encoder:
    """Ids of whole texts by tokenizers. A byte-level BPE encodes each word by itself, so its model is asked for a word's ids once and they are kept.

    Texts with the string of an added token go to tokenizers whole; so does everything if the file is of another kind.
    """

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        said = json.loads(self.tokenizer.to_str())
        cutter = said.get("pre_tokenizer") or {}
        self.by_word = cutter.get("type") == "ByteLevel" and cutter.get("use_regex", True) and not cutter.get("add_prefix_space") and not said.get("normalizer") and not said.get("truncation")
        self.added = [t["content"] for t in said.get("added_tokens", [])]
        self.dtype = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.latin, self.beyond = _latin_pattern()
        self.any = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
        self.words = _Words(self.tokenizer.model, self.dtype)

    def __call__(self, text: str) -> bytes:
        if not self.by_word or any(x in text for x in self.added):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()
        words = (self.any if self.beyond.search(text) else self.latin).findall(text)
        return b"".join(map(self.words.__getitem__, words))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each vocabulary file and process, so that what it keeps serves many batches."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


# --- minimal perfect hash ---------------------------------------------------------------------------------------


def mixed(h: np.ndarray, level: int) -> np.ndarray:
    """64 bits that depend on all bits of ``h`` and on the level."""
    with np.errstate(over="ignore"):
        x = h + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Slots 0 to n - 1 for n keys given by 64-bit hashes."""

    def __init__(self, sizes: np.ndarray, words: np.ndarray):
        self.sizes, self.words = sizes, words
        self.starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words))]).astype(np.int64)

    @classmethod
    def build(cls, hashes: np.ndarray, levels: int = 40, spread: float = 2.0) -> PerfectHash:
        left, sizes, words = np.unique(hashes), [], []
        twice = len(left) < len(hashes)
        if twice:  # equal hashes would meet at every level
            values, times = np.unique(hashes, return_counts=True)
            left = values[times == 1]
        while len(left) and len(sizes) < levels:
            size = max(64, -(-int(spread * len(left)) // 64) * 64)
            spot = (mixed(left, len(sizes)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(spot, minlength=size) == 1
            words.append(np.packbits(alone, bitorder="little").view("<u8"))
            sizes.append(size)
            left = left[~alone[spot]]
        return cls(np.array(sizes, np.int64), np.concatenate(words) if words else np.zeros(0, "<u8"))

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        """The slot of each hash, -1 where no level has it."""
        out = np.full(len(hashes), -1, np.int64)
        left = np.arange(len(hashes))
        for level, size in enumerate(self.sizes.tolist()):
            if not len(left):
                break
            bit = (mixed(hashes[left], level) % np.uint64(size)).astype(np.int64) + self.starts[level]
            word, at = bit >> 6, (bit & 63).astype(np.uint64)
            here = (self.words[word] >> at) & np.uint64(1) == 1
            below = np.bitwise_count(self.words[word] & ((np.uint64(1) << at) - np.uint64(1)))
            out[left[here]] = (self.before[word] + below)[here]
            left = left[~here]
        return out

    def __len__(self) -> int:
        return int(self.before[-1])


class IndexPart:
    """A perfect hash with what its slots hold, and the keys that it could not tell apart."""

    FIELDS = ("fingerprint", "shard", "place", "rows")

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.hash = PerfectHash(arrays["sizes"], arrays["words"])
        self.held = {f: arrays[f] for f in self.FIELDS}
        self.rest = {k: len(self.hash) + i for i, k in enumerate(arrays["rest"].tobytes().decode().split("\n") if arrays["rest"].size else [])}

    @classmethod
    def build(cls, keys: list[str], h1: np.ndarray, values: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        """Arrays of a part. Keys are escaped, so that none has a line break."""
        perfect = PerfectHash.build(h1)
        slot = perfect.slots(h1)
        unplaced = _unplaced(h1, slot)
        slot[unplaced] = len(perfect) + np.arange(len(unplaced))
        rest = "\n".join(keys[i] for i in unplaced.tolist()).encode()
        out = {"sizes": perfect.sizes, "words": perfect.words, "rest": np.frombuffer(rest, np.uint8)}
        for f in cls.FIELDS:
            out[f] = np.zeros(len(keys), values[f].dtype)
            out[f][slot] = values[f]
        return out

    def find(self, keys: list[str], h1: np.ndarray, fingerprint: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 for absent ones."""
        slot = self.hash.slots(h1)
        if self.rest:
            for i, k in enumerate(keys):
                if k in self.rest:
                    slot[i] = self.rest[k]
        known = slot >= 0
        known[known] = self.held["fingerprint"][slot[known]] == fingerprint[known]
        return np.where(known, slot, -1)


def _unplaced(hashes: np.ndarray, slot: np.ndarray) -> np.ndarray:
    """Places of keys with no slot, or whose hash another key has too: their slot, if any, is not their own."""
    order = np.argsort(hashes, kind="stable")
    same = hashes[order][1:] == hashes[order][:-1]
    shared = np.zeros(len(hashes), bool)
    shared[order[1:][same]] = shared[order[:-1][same]] = True
    return np.flatnonzero(shared | (slot < 0))


# --- files ------------------------------------------------------------------------------------------------------


def _files(path: str):
    """File system and path in it; any that pyarrow knows: file, hdfs, s3, gs, abfs."""
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(path)


class _Whole:
    """A file that appears under its name only when it is complete."""

    def __init__(self, path: str):
        self.fs, self.path = _files(path)
        self.own = f"{self.path}.{uuid.uuid4().hex}"

    def __enter__(self):
        self.fs.create_dir(self.path.rsplit("/", 1)[0], recursive=True)
        self.out = self.fs.open_output_stream(self.own)
        return self.out

    def __exit__(self, kind, *_):
        self.out.close()
        if kind is None:
            self.fs.move(self.own, self.path)
        else:
            self.fs.delete_file(self.own)


def _key_text(column: Column) -> Column:
    """A key as text without line breaks; null is unlike any text."""
    text = F.replace(F.replace(column.cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))
    return F.when(column.isNull(), F.lit("n")).otherwise(F.concat(F.lit("k"), text))


def _hashed(df: DataFrame, parts: int) -> DataFrame:
    """``df`` with ``h1``, ``h2`` of its column ``key`` and the part of the index."""
    return df.withColumns({"h1": F.xxhash64("key"), "h2": F.xxhash64(F.lit(SALT), "key")}).withColumn("part", F.pmod(F.shiftright("h2", 32), F.lit(parts)).cast("int"))


def _numbers(batch: pa.RecordBatch, name: str, dtype: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False).astype(dtype)


def write_token_files(docs: DataFrame, vocabulary: str, path: str | None = None, end: int = 2, shard_bytes: int = 32 << 20, part_keys: int = 1 << 16, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Encode ``docs`` and write them as described above into ``path``, else into a new folder of ``spark.checkpoint.dir``; returns the folder.

    ``shard_bytes``: text of a shard, about, unless that gave more than ``MOST_SHARDS``. ``part_keys``: keys of a part of the index, likewise.
    """
    spark = docs.sparkSession
    root = (path or f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}").rstrip("/")
    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.monotonically_increasing_id().alias("row"))
    volume = chosen.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = int(min(MOST_SHARDS, max(1, -(-volume // shard_bytes))))
    order = [F.col("id").asc_nulls_last(), F.col("row").asc()]
    placed = chosen.repartitionByRange(shards, *order).sortWithinPartitions(*order).select(_key_text(F.col("id")).alias("key"), "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, shard = encoder(vocabulary), TaskContext.get().partitionId()
        last, at, starts = np.array([end], encode.dtype).tobytes(), 0, [np.zeros(1, "<u8")]
        width, out, place = len(last), None, 0
        name = f"{root}/shard-{shard:05d}"
        whole = _Whole(f"{name}.ids")
        for batch in batches:
            if not batch.num_rows:
                continue
            out = out or whole.__enter__()
            sizes = np.empty(batch.num_rows, np.int64)
            for i, text in enumerate(batch.column("text")):
                ids = encode(text.as_py() or "")
                out.write(ids)
                out.write(last)
                sizes[i] = len(ids) // width + 1
            ends = at + np.cumsum(sizes)
            at = int(ends[-1])
            starts.append(ends.astype("<u8"))
            n = np.arange(place, place + len(sizes))
            place += len(sizes)
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(np.full(len(sizes), shard, np.int32)), pa.array(n), pa.array(sizes)], names=["key", "shard", "place", "n"])
        if out:
            with _Whole(f"{name}.off") as offsets:
                offsets.write(np.concatenate(starts).tobytes())
            whole.__exit__(None)

    entries = settle(placed.mapInArrow(write, "key string, shard int, place long, n long"), "token_entries")
    written = [tuple(r) for r in entries.groupBy("shard").agg(F.count(F.lit(1)), F.sum("n")).orderBy("shard").collect()]  # a row for each shard
    parts = int(min(MOST_PARTS, max(1, -(-sum(r[1] for r in written) // part_keys))))
    first = F.min(F.struct("shard", "place"))
    keyed = entries.groupBy("key").agg(first.alias("first"), F.count(F.lit(1)).alias("rows")).select("key", "first.shard", "first.place", "rows")

    def index(rows: pa.Table) -> pa.Table:
        batch = rows.combine_chunks().to_batches()[0]
        h1 = _numbers(batch, "h1", "i8").view("u8")
        values = {"fingerprint": _numbers(batch, "h2", "i8").astype("<u4"), "shard": _numbers(batch, "shard", "<u4"), "place": _numbers(batch, "place", "<u8"), "rows": _numbers(batch, "rows", "<u8")}
        buffer = BytesIO()
        np.savez(buffer, **IndexPart.build(batch.column("key").to_pylist(), h1, values))
        part = batch.column("part")[0].as_py()
        with _Whole(f"{root}/index-{part:05d}.npz") as out:
            out.write(buffer.getbuffer())
        return pa.table({"part": [part], "keys": [len(h1)]}, schema=pa.schema([("part", pa.int32()), ("keys", pa.int64())]))

    _hashed(keyed, parts).groupBy("part").applyInArrow(index, "part int, keys long").write.format("noop").mode("overwrite").save()
    manifest = {"dtype": encoder(vocabulary).dtype, "end": end, "parts": parts, "shards": [r[0] for r in written], "documents": [r[1] for r in written], "ids": [r[2] for r in written]}
    with _Whole(f"{root}/manifest.json") as out:
        out.write(json.dumps(manifest).encode())
    return root


class TokenFiles:
    """A folder that :func:`write_token_files` wrote: access by key, one at a time or for a whole table of keys."""

    def __init__(self, path: str):
        self.path = path
        self.fs, self.root = _files(path)
        with self.fs.open_input_stream(f"{self.root}/manifest.json") as f:
            said = json.loads(f.read())
        self.dtype, self.parts, self.shards = np.dtype(said["dtype"]), said["parts"], said["shards"]
        self.first_document = np.concatenate([[0], np.cumsum(said["documents"])]).astype(np.int64)
        self.first_id = np.concatenate([[0], np.cumsum(said["ids"])]).astype(np.int64)
        self._parts: dict[int, IndexPart | None] = {}

    def __reduce__(self):
        return TokenFiles, (self.path,)

    def part(self, number: int, keep: int = 4) -> IndexPart | None:
        """A part of the index, ``keep`` of which stay in memory; None if no key fell into it."""
        if number not in self._parts:
            while len(self._parts) >= keep:
                self._parts.pop(next(iter(self._parts)))
            name = f"{self.root}/index-{number:05d}.npz"
            if self.fs.get_file_info(name).is_file:
                with self.fs.open_input_stream(name) as f:
                    self._parts[number] = IndexPart(dict(np.load(BytesIO(f.read()))))
            else:
                self._parts[number] = None
        return self._parts[number]

    def places(self, part: int, keys: list[str], h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which of ``keys`` are there, the number of the first document of each among all, and how many it has."""
        found = self.part(part)
        slot = found.find(keys, h1, h2.astype("<u4")) if found else np.full(len(keys), -1, np.int64)
        known = np.flatnonzero(slot >= 0)
        if not len(known):
            return known, known, known
        at = slot[known]
        shard = np.searchsorted(self.shards, found.held["shard"][at])
        return known, self.first_document[shard] + found.held["place"][at].astype(np.int64), found.held["rows"][at].astype(np.int64)

    def read(self, shard: int, places: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """First id, counted over all shards, and ids of each document of a shard; ``places`` ascending."""
        name = f"{self.root}/shard-{self.shards[shard]:05d}"
        with self.fs.open_input_file(f"{name}.off") as f:
            lowest, highest = int(places[0]), int(places[-1])
            f.seek(8 * lowest)
            offsets = np.frombuffer(f.read(8 * (highest - lowest + 2)), "<u8").astype(np.int64)
        with self.fs.open_input_file(f"{name}.ids") as f:
            for p in (places - lowest).tolist():
                f.seek(int(offsets[p]) * self.dtype.itemsize)
                yield int(self.first_id[shard] + offsets[p]), np.frombuffer(f.read(int(offsets[p + 1] - offsets[p]) * self.dtype.itemsize), self.dtype)

    def __getitem__(self, key) -> list[np.ndarray]:
        """Ids of each document with this key; an empty list for a key that is absent."""
        import xxhash

        text = "n" if key is None else "k" + str(key).replace("\\", "\\\\").replace("\n", "\\n")
        h1 = xxhash.xxh64_intdigest(text.encode(), SEED)
        h2 = xxhash.xxh64_intdigest(text.encode(), xxhash.xxh64_intdigest(SALT.encode(), SEED))
        signed = (h2 >> 32) - ((h2 >> 63) << 32)
        _, first, rows = self.places(signed % self.parts, [text], np.array([h1], "u8"), np.array([h2], "u8"))
        found = np.arange(first[0], first[0] + rows[0]) if len(first) else np.zeros(0, np.int64)
        return [ids for _, ids in self.documents(found)]

    def documents(self, numbers: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """First id and ids of documents by their ascending numbers among all."""
        shard = np.searchsorted(self.first_document, numbers, "right") - 1
        for s in np.unique(shard).tolist():
            yield from self.read(s, numbers[shard == s] - self.first_document[s])

    def lookup(self, keys: DataFrame, key_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
        """``key_col``, start, n_tokens, ids_crc32, and ``ids`` if asked for, of each document with one of ``keys``.

        Keys meet their part of the index in one shuffle, and the places found meet their shard in a second.
        """
        own = self
        wanted = keys.select(F.col(key_col).alias("id")).distinct().withColumn("key", _key_text(F.col("id")))
        wanted = _hashed(wanted, self.parts).repartition("part").sortWithinPartitions("part")
        kind = wanted.schema["id"].dataType.simpleString()

        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                part = _numbers(batch, "part", "i4")
                for p in np.unique(part).tolist():
                    rows = batch.filter(pa.array(part == p))
                    known, first, n = own.places(p, rows.column("key").to_pylist(), _numbers(rows, "h1", "i8").view("u8"), _numbers(rows, "h2", "i8").view("u8"))
                    ends = np.cumsum(n)
                    step = 1 << 16
                    for low in range(0, int(ends[-1]) if len(ends) else 0, step):  # a key may have very many documents
                        k = np.arange(low, min(low + step, int(ends[-1])))
                        which = np.searchsorted(ends, k, "right")
                        number = first[which] + k - (ends[which] - n[which])
                        shard = np.searchsorted(own.first_document, number, "right") - 1
                        yield pa.RecordBatch.from_arrays([rows.column("id").take(pa.array(known[which])), pa.array(shard.astype(np.int32)), pa.array(number - own.first_document[shard])], names=["id", "shard", "place"])

        def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                shard, place = _numbers(batch, "shard", "i4"), _numbers(batch, "place", "i8")
                for s in np.unique(shard).tolist():
                    mine = np.flatnonzero(shard == s)
                    some: list[tuple] = []
                    for k, (start, ids) in zip(mine.tolist(), own.read(s, place[mine]), strict=True):
                        some.append((k, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), ids.tobytes() if with_ids else None))
                        if len(some) == 1 << 10:
                            yield pack(batch, some)
                            some = []
                    if some:
                        yield pack(batch, some)

        def pack(batch: pa.RecordBatch, some: list[tuple]) -> pa.RecordBatch:
            which, start, n, crc, ids = zip(*some, strict=True)
            columns = [batch.column("id").take(pa.array(which)), pa.array(start, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64())]
            return pa.RecordBatch.from_arrays([*columns, pa.array(ids, pa.binary())][: 4 + with_ids], names=["id", "start", "n_tokens", "ids_crc32", "ids"][: 4 + with_ids])

        found = wanted.mapInArrow(find, f"id {kind}, shard int, place long").repartition("shard").sortWithinPartitions("shard", "place")
        return found.mapInArrow(fetch, f"id {kind}, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids).withColumnRenamed("id", key_col)


def written_tokens(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the token files of ``docs`` and give each document's start, n_tokens and ids_crc32 as read back by its key."""
    path = write_token_files(docs, vocabulary, id_col=id_col, text_col=text_col)
    return TokenFiles(path).lookup(docs, id_col)
