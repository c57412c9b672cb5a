"""Language-model scores by online logistic context mixing.

A text is a sequence of words in lower case and an end. Each word is a path of bits: its Huffman code over the frequent
vocabulary, or that of an escape and then those of its bytes. Three bit predictors estimate each bit of a path, to a
depth of ``DEPTH``: one from the words under the path so far, two from hashed contexts, the word before and the two words
before (within an escaped word: two and four bytes before). Their log odds are mixed with weights that a gate chooses,
from the depth of the path and from which contexts have been seen, and that are refined online: after each bit of a
document the weights that gave it follow the gradient of its coding cost. Bits below ``DEPTH``, which only words rarer
than about one in 2^``DEPTH`` have, get the probability that the words under the path give them. Each document starts
from the same weights, so its score does not depend on other documents in a batch. The sum over all bits, in total bits
per byte or as log10 of the text's probability, is the score.

What is learned comes from every training document: word counts by key, and counts of zeros and ones for each slot of
the predictors' tables. Tables have a fixed number of slots, as hashed contexts do; each task sends its counts in
blocks, which are summed as they stream in. Word counts are exact. At most ``vocabulary`` frequent words are broadcast;
the others are looked up by a join.

Words are known by the 64-bit hash of their bytes.

Defined results
    null or empty text   the end alone
    null id              crc32 of the empty string decides its part
    no training text     all counts are 0, each bit has probability 1/2
    repeated rows        each row is scored, and learned from, by itself
    empty table          empty result
    other columns        are not read
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardenflow.llm.common import crc_mod, settle

END = b""  # no word is empty
DEPTH = 20
SLOT_BITS = (21, 22)  # of the two hashed predictors
BLOCK = 1 << 16
GATES = 16
LIMIT = np.float32(11.5)  # of mixed log odds
FEW = 24  # with fewer documents left, each is mixed by itself
MOST_WORDS = 1_200_000  # of documents that are mixed together
FORWARD = 300_000  # symbols of all documents that are laid out at a time
AT_ONCE = 1 << 15  # bits whose inputs are made at a time
ONE = np.float32(1)
BIT = np.dtype([("words", np.float32), ("one", np.int8), ("two", np.int8), ("flags", np.int8), ("none", np.int8)])
FIND_BITS = 20
ODD = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
SCALE = 12.0  # log odds are kept as signed bytes, so many steps to one
START = np.uint64(0x27D4EB2F165667C5)


def key_of(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word)


def words_of(text: str | None) -> list[bytes]:
    """Words of a text in lower case, and the end."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # for bytes both look at ASCII only
    words.append(END)
    return words


def _keys(words: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.fromiter(map(digest, words), np.uint64, len(words))


# --- codes ------------------------------------------------------------------------------------------------------


def huffman_lengths(weights: np.ndarray) -> np.ndarray:
    """Length of each symbol's Huffman code; one symbol alone gets length 1."""
    n = len(weights)
    if n == 1:
        return np.ones(1, np.int64)
    order = np.argsort(weights, kind="stable")
    leaf, made, parent = weights[order].tolist(), [], [0] * (2 * n - 1)
    i = j = 0
    for node in range(n, 2 * n - 1):
        total = 0
        for _ in range(2):
            if i < n and (j >= len(made) or leaf[i] <= made[j]):
                total, child, i = total + leaf[i], i, i + 1
            else:
                total, child, j = total + made[j], n + j, j + 1
            parent[child] = node
        made.append(total)
    depth = [0] * (2 * n - 1)
    for node in range(2 * n - 3, -1, -1):
        depth[node] = depth[parent[node]] + 1
    out = np.empty(n, np.int64)
    out[order] = depth[:n]
    return out


@dataclass
class Codes:
    """The first DEPTH bits of each symbol's Huffman code, their number, and what log10 the rest has."""

    top: np.ndarray
    length: np.ndarray
    tail: np.ndarray
    odds: np.ndarray  # log odds of a one by node of the first DEPTH levels; a node is a one and the bits so far

    @classmethod
    def of(cls, weights: np.ndarray) -> Codes:
        lengths = huffman_lengths(weights)
        order = np.lexsort((np.arange(len(lengths)), lengths))
        depth = min(DEPTH, int(lengths.max()))
        top, short = np.zeros(len(lengths), np.int64), np.minimum(lengths, depth)
        code = before = at = 0
        for end in np.flatnonzero(np.diff(np.r_[lengths[order], 0])) + 1:  # canonical codes, by runs of equal length
            n, k = int(lengths[order[at]]), int(end - at)
            code <<= n - before
            if n <= depth:
                top[order[at:end]] = code + np.arange(k)
            elif n < 62:
                top[order[at:end]] = (code + np.arange(k)) >> (n - depth)
            else:
                top[order[at:end]] = [(code + j) >> (n - depth) for j in range(k)]
            code, before, at = code + k, n, int(end)
        below = np.zeros(2 << depth)  # weight under each node
        for d in range(depth + 1):
            deep = short >= d
            below += np.bincount((1 << d) | (top[deep] >> (short[deep] - d)), weights[deep], len(below))
        inner = np.arange(1 << depth)
        odds = np.log((below[2 * inner + 1] + 0.5) / (below[2 * inner] + 0.5))
        tail = np.where(lengths > depth, np.log10(weights / below[(1 << depth) | top].clip(1)), 0.0)
        return cls(top.astype(np.int32), short.astype(np.int32), tail.astype(np.float32), odds.astype(np.float32))


@dataclass
class Vocabulary:
    """Frequent words by sorted key, their counts, and the codes of words and of bytes."""

    keys: np.ndarray
    counts: np.ndarray
    words: Codes = field(init=False)
    letters: Codes = field(init=False)
    first: np.ndarray = field(init=False)  # place of the first key by its first bits
    most_alike: int = field(init=False)
    rare: int = 1
    letter_counts: np.ndarray | None = None

    def __post_init__(self):
        self.words = Codes.of(np.r_[self.counts, max(1, self.rare)].astype(np.int64))  # the last symbol is the escape
        heads = (self.keys >> np.uint64(64 - FIND_BITS)).astype(np.int64)
        self.first = np.searchsorted(heads, np.arange(1 << FIND_BITS)).astype(np.int32)
        self.most_alike = int(np.bincount(heads).max()) if len(heads) else 0
        self.letters = Codes.of((self.letter_counts if self.letter_counts is not None else np.zeros(256, np.int64)) + 1)

    @property
    def codes(self) -> tuple[Codes, Codes]:
        return self.words, self.letters

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Number of each word; the escape's for words that are not here."""
        none = len(self.keys)
        out = np.full(len(keys), none, np.int32)
        if not none:
            return out
        at = self.first[keys >> np.uint64(64 - FIND_BITS)]
        wanted = np.arange(len(keys))
        for _ in range(self.most_alike):  # keys with the same first bits follow each other
            hit = self.keys[np.minimum(at, none - 1)] == keys
            out[wanted[hit]] = at[hit]
            wanted, at, keys = wanted[~hit], at[~hit] + 1, keys[~hit]
            if not len(wanted):
                break
        return out


# --- bits -------------------------------------------------------------------------------------------------------


@dataclass
class Stream:
    """Symbols of one kind in order of their documents, with their hashed contexts."""

    symbols: np.ndarray
    doc: np.ndarray
    contexts: list[np.ndarray]
    salt: int

    def before(self, sizes: np.ndarray, documents: int) -> np.ndarray:
        """Sum of the ``sizes`` of earlier symbols of each symbol's document."""
        order = np.argsort(self.doc, kind="stable")
        ends, total = np.empty_like(sizes), np.cumsum(sizes[order])
        starts = np.r_[0, total][np.searchsorted(self.doc[order], np.arange(documents))]
        ends[order] = total
        return ends - sizes - starts[self.doc]

    @classmethod
    def joined(cls, parts: list[Stream]) -> Stream:
        """Streams of one kind, whose documents are numbered on, as one."""
        contexts = [np.concatenate(c) for c in zip(*(p.contexts for p in parts), strict=True)]
        return cls(np.concatenate([p.symbols for p in parts]), np.concatenate([p.doc for p in parts]), contexts, parts[0].salt)

    def at(self, where: np.ndarray) -> Stream:
        return Stream(self.symbols[where], self.doc[where], [c[where] for c in self.contexts], self.salt)

    def bits(self, codes: Codes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]]:
        """By depth: the symbols that have a bit there, its value, its node and its slots in the hashed tables."""
        length = codes.length[self.symbols]
        order = np.argsort((DEPTH - length).astype(np.uint8), kind="stable")  # the longest first: those with a bit at a depth are in front
        top, length, contexts = codes.top[self.symbols][order], length[order], [c[order] for c in self.contexts]
        for d in range(DEPTH):
            n = np.count_nonzero(length > d)
            if not n:
                return
            prefix = top[:n] >> (length[:n] - (d + 1))
            value, node = prefix & 1, (prefix >> 1) | (1 << d)
            step = (node + (self.salt << (DEPTH + 1))).astype(np.uint64)
            step *= ODD[0]
            slots = []
            for context, bits in zip(contexts, SLOT_BITS, strict=True):
                x = context[:n] + step
                x *= ODD[1]
                x >>= np.uint64(64 - bits)
                slots.append(x.view(np.int64))
            yield order[:n], value, node, slots


def _shifted(x: np.ndarray, by: int, fresh: np.ndarray, start) -> np.ndarray:
    """``x`` moved ``by`` places on; ``start`` where that reaches back over the beginning that ``fresh`` counts from."""
    out = np.full(len(x), start, x.dtype)
    out[by:] = x[: len(x) - by]
    out[fresh < by] = start
    return out


def _since(marks: np.ndarray) -> np.ndarray:
    """Places since the last mark; the first place must have one."""
    return np.arange(len(marks)) - np.maximum.accumulate(np.where(marks, np.arange(len(marks)), 0))


@dataclass
class Stretch:
    """Documents that are worked on together."""

    keys: np.ndarray
    found: np.ndarray
    doc: np.ndarray
    streams: list[Stream]


def _starts(docs: np.ndarray) -> np.ndarray:
    return np.r_[True, docs[1:] != docs[:-1]]


def stretch(words: list[list[bytes]], vocabulary: Vocabulary) -> Stretch:
    flat = [w for x in words for w in x]
    keys = _keys(flat)
    doc = np.repeat(np.arange(len(words)), [len(x) for x in words])
    found = vocabulary.find(keys)
    since = _since(_starts(doc))
    one = _shifted(keys, 1, since, START) * ODD[1]
    two = (_shifted(keys, 2, since, START) ^ (one >> np.uint64(7))) * ODD[2] ^ one
    streams = [Stream(found, doc, [one, two], 1)]
    escaped = np.flatnonzero(found == len(vocabulary.keys))
    if len(escaped):
        raw = np.frombuffer(b" ".join([flat[i] for i in escaped] + [b""]), np.uint8)  # each word and a space
        ends = np.flatnonzero(raw == 32)
        sizes = np.diff(np.r_[-1, ends])
        since = _since(np.r_[True, (raw == 32)[:-1]])
        wide = raw.astype(np.uint64) + np.uint64(1)
        c1, c2, c3, c4 = (_shifted(wide, n, since, np.uint64(0)) for n in (1, 2, 3, 4))
        two = c1 + (c2 << np.uint64(9))
        four = two + (c3 << np.uint64(18)) + (c4 << np.uint64(27)) + (np.uint64(1) << np.uint64(40))
        doc_of = np.repeat(doc[escaped], sizes)
        streams.append(Stream(raw, doc_of, [two * ODD[2], four * ODD[2]], 2))
    return Stretch(keys, found, doc, streams)


def stretches(texts: list[str | None], vocabulary: Vocabulary, most_words: int = 100_000) -> Iterator[tuple[list[int], Stretch]]:
    """Documents in turn, about ``most_words`` words at a time; a longer one alone."""
    part, words, n = [], [], 0
    for i, text in enumerate(texts):
        own = words_of(text)
        if part and n + len(own) > most_words:
            yield part, stretch(words, vocabulary)
            part, words, n = [], [], 0
        part.append(i)
        words.append(own)
        n += len(own)
    if part:
        yield part, stretch(words, vocabulary)


# --- learning ---------------------------------------------------------------------------------------------------


def word_counts(rows: DataFrame, most_held: int = 2_000_000) -> DataFrame:
    """A settled table ``key, c``; each task counts what it reads and sends ``most_held`` keys at most at a time."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_keys, held_counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

        def out(keys, counts):
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], names=["key", "c"])

        for batch in batches:
            keys = [_keys(words_of(t)) for t in batch.column(0).to_pylist()]
            if not keys:
                continue
            own, n = np.unique(np.concatenate(keys), return_counts=True)
            held_keys, where = np.unique(np.concatenate([held_keys, own]), return_inverse=True)
            held_counts = np.bincount(where, np.concatenate([held_counts, n]), len(held_keys)).astype(np.int64)
            if len(held_keys) > most_held:
                yield out(held_keys, held_counts)
                held_keys, held_counts = held_keys[:0], held_counts[:0]
        if len(held_keys):
            yield out(held_keys, held_counts)

    return settle(rows.select("text").mapInArrow(count, "key long, c long").groupBy("key").agg(F.sum("c").alias("c")), "word_counts")


def frequent_words(counts: DataFrame, most: int, least_power: int = 1) -> Vocabulary:
    """The words that occur 2^b times or more, for the smallest b from ``least_power`` on that leaves ``most`` at most.

    Words that occur once stay out, so that escapes and the bytes of new words are learned from them.
    """
    power = F.floor(F.log2("c")).cast("int")
    by_power = {int(p): (int(n), int(t)) for p, n, t in counts.groupBy(power.alias("p")).agg(F.count(F.lit(1)), F.sum("c")).collect()}  # 64 rows at most
    kept, low = 0, 64
    for p in range(63, least_power - 1, -1):
        if kept + by_power.get(p, (0, 0))[0] > most:
            break
        kept, low = kept + by_power.get(p, (0, 0))[0], p
    rare = sum(t for p, (_, t) in by_power.items() if p < low)
    table = counts.filter(F.col("c") >= F.lit(float(2**low))).toPandas() if kept else pd.DataFrame({"key": [], "c": []})
    keys = table["key"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(keys)
    return Vocabulary(keys[order], table["c"].to_numpy(np.int64)[order], rare=rare, letter_counts=_letter_weights())


def _letter_weights() -> np.ndarray:
    """Weights of bytes for their codes: Latin small letters and the word's end often, ASCII signs and digits less."""
    out = np.ones(256, np.int64)
    out[0x21:0x7F], out[0x80:0xC0], out[ord("a") : ord("z") + 1], out[0x20] = 40, 100, 400, 1500
    out[[ord(c) for c in "etaonisrh"]] = 1000
    out[[0xC2, 0xC3]] = 300
    return out


def slot_counts(rows: DataFrame, vocabulary) -> np.ndarray:
    """Counts of zeros and ones by slot, for all predictors in turn, over all of ``rows``."""
    offsets = np.r_[0, np.cumsum([1 << b for b in SLOT_BITS])]
    width = 2 * int(offsets[-1])

    def packed(block: int, part: int, sums: np.ndarray):
        return {"block": block, "part": part, "data": zlib.compress(np.minimum(sums, 2**32 - 1).astype("<u4").tobytes(), 1)}

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = np.zeros(width, np.uint32)
        some, part, waiting, n = False, 0, [[] for _ in SLOT_BITS], 0

        def take_in():
            for k, lists in enumerate(waiting):
                if lists:
                    held[2 * offsets[k] : 2 * offsets[k + 1]] += np.bincount(np.concatenate(lists), minlength=2 << SLOT_BITS[k]).astype(np.uint32)
                    lists.clear()

        for batch in batches:
            some = some or len(batch) > 0
            part = part or int(batch["part"].iloc[0]) if len(batch) else part
            for _, piece in stretches(batch["text"].tolist(), vocabulary.value):
                for codes, stream in zip(vocabulary.value.codes, piece.streams, strict=False):
                    for here, value, _, slots in stream.bits(codes):
                        n += len(here)
                        for lists, x in zip(waiting, slots, strict=True):
                            x <<= 1
                            x += value
                            lists.append(x)
                if n > 4_000_000:
                    take_in()
                    n = 0
        take_in()
        if some:
            blocks = [b for b in range(width // BLOCK) if held[b * BLOCK : (b + 1) * BLOCK].any()]
            for at in range(0, len(blocks), 16):
                yield pd.DataFrame([packed(b, part, held[b * BLOCK : (b + 1) * BLOCK]) for b in blocks[at : at + 16]])

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for block, part, data in zip(batch["block"], batch["part"], batch["data"], strict=True):
                sums = held.setdefault((block, part), np.zeros(BLOCK, np.int64))
                sums += np.frombuffer(zlib.decompress(data), "<u4")
        for (block, part), sums in held.items():
            yield pd.DataFrame([packed(block, part, sums)])

    schema = "block int, part int, data binary"
    sent = rows.select("text", F.shiftright(F.spark_partition_id(), 6).alias("part")).mapInPandas(count, schema)
    first = sent.repartition("block", "part").mapInPandas(add, schema)  # in two steps, so that no task gets a block from every task
    summed = first.withColumn("part", F.lit(0)).repartition("block").mapInPandas(add, schema).select("block", "data")
    out = np.zeros(width, np.uint32)
    for row in summed.toPandas().itertuples():  # a row for each block of the tables, whose size is fixed
        out[row.block * BLOCK : (row.block + 1) * BLOCK] = np.frombuffer(zlib.decompress(row.data), "<u4")
    return out


# --- scoring ----------------------------------------------------------------------------------------------------


@dataclass
class Mixer:
    """The predictors' log odds as signed bytes; the lowest bit says if the slot has been seen more than once."""

    odds: list[np.ndarray]
    rate: float = 0.03

    @classmethod
    def of(cls, counts: np.ndarray, **options) -> Mixer:
        pairs, odds, at = counts.reshape(-1, 2), [], 0
        for bits in SLOT_BITS:
            zeros, ones = pairs[at : at + (1 << bits)].T.astype(np.float32)
            steps = np.clip(np.round(SCALE * np.log((ones + np.float32(0.3)) / (zeros + np.float32(0.3)))), -127, 127).astype(np.int8)
            odds.append((steps & np.int8(-2)) | (zeros + ones > 1).astype(np.int8))
            at += 1 << bits
        return cls(odds, **options)

    def first_weights(self) -> np.ndarray:
        """By gate: the longest context that has been seen counts most; without one the words alone do."""
        out = np.zeros((GATES, 3), np.float32)
        for g in range(GATES):
            out[g] = (0.3, 0.3, 0.4) if g & 2 else (0.5, 0.5, 0.1) if g & 1 else (1.0, 0.05, 0.0)
        return out

    def add_scores(self, codes: Codes, stream: Stream, documents: int, number: int, out: np.ndarray) -> None:
        """Add natural logarithms of the stream's probabilities to ``out``, by document.

        Documents go forward side by side, some symbols of each at a time. Of these the n-th bits of all documents are
        mixed together, each with its own document's weights, which then move; a document's bits follow each other.
        """
        if not len(stream.symbols):
            return
        out += np.bincount(stream.doc, codes.tail[stream.symbols], documents) * np.log(10)
        place = _since(_starts(stream.doc))
        ends = np.cumsum(np.bincount(place))
        stream = stream.at(np.argsort(place.astype(np.uint16) if len(ends) <= 1 << 16 else place, kind="stable"))  # short numbers sort faster
        weights, at, symbols = np.repeat(self.first_weights().T, documents, axis=1), 0, 0
        while symbols < len(stream.symbols):
            at = max(at + 1, int(np.searchsorted(ends, symbols + FORWARD, side="right")))
            until = int(ends[at - 1])
            self._add_some(codes, stream.at(slice(symbols, until)), weights, number, out)
            symbols = until

    def _add_some(self, codes: Codes, stream: Stream, weights: np.ndarray, number: int, out: np.ndarray) -> None:
        """Add the scores of symbols, the n-th ones of all documents before the next, and move ``weights``, a row by predictor."""
        documents = len(out)
        size = codes.length[stream.symbols].astype(np.int64)
        bits = np.bincount(stream.doc, size, documents).astype(np.int64)
        order = np.argsort(-bits, kind="stable")
        seat = np.empty_like(order)
        seat[order] = np.arange(documents)
        going = np.searchsorted(-bits[order], -np.arange(int(bits.max()) + 1), side="left")  # documents with more bits than that
        rows = np.cumsum(going) - going
        first, seats = stream.before(size, documents), seat[stream.doc]
        laid = np.empty(int(size.sum()), BIT)
        for d, (here, bit, node, (one, two)) in enumerate(stream.bits(codes)):
            if not d:  # all symbols, in the order that later depths keep
                first, seats = first[here], seats[here]
            at = rows[first[: len(here)] + d]
            at += seats[: len(here)]
            made = np.empty(len(at), BIT)
            made["words"], made["one"], made["two"], made["flags"] = codes.odds[node], self.odds[0][one], self.odds[1][two], bit + 2 * (d > 2)
            laid.view(np.uint64)[at] = made.view(np.uint64)

        def inputs(at):
            """Minus the log odds of some bits, by predictor, their values and their gates."""
            own = laid[at]
            x, one, two, v = np.empty((3, len(own)), np.float32), own["one"], own["two"], own["flags"]
            np.negative(own["words"], out=x[0])
            np.multiply(one, np.float32(-1 / SCALE), out=x[1])
            np.multiply(two, np.float32(-1 / SCALE), out=x[2])
            return x, v & 1, (one & 1) | (two & 1) << 1 | (v & 2) << 1 | np.int8(8 * number)

        count, begin, t, rate, cost = going.tolist(), rows.tolist(), 0, np.float32(self.rate), np.zeros(documents)
        rest = int(np.searchsorted(-going, -FEW, side="right"))  # from this bit on there are few documents
        held, moved = np.empty((3, documents), np.float32), np.empty((3, documents), np.float32)
        while t < rest:
            end = max(t + 1, min(rest, int(np.searchsorted(rows, begin[t] + AT_ONCE))))
            base = begin[t]
            x, v, gate = inputs(slice(base, begin[end - 1] + count[end - 1]))
            seats = np.arange(len(v)) - np.repeat(rows[t:end] - base, going[t:end])
            to = gate.astype(np.int64)
            to *= documents
            to += order[seats]
            aims, z, sums = v * rate, np.empty(len(v), np.float32), np.empty(len(v), np.float32)
            while t < end:
                n, a = count[t], begin[t] - base
                b = a + n
                i, here, w, m, mixed, total = to[a:b], x[:, a:b], held[:, :n], moved[:, :n], z[a:b], sums[a:b]
                w0, w1, w2 = w
                weights[0].take(i, out=w0, mode="clip")
                weights[1].take(i, out=w1, mode="clip")
                weights[2].take(i, out=w2, mode="clip")
                np.multiply(w, here, out=m)
                miss = m[0]
                np.add(miss, m[1], out=mixed)
                np.add(mixed, m[2], out=mixed)
                np.minimum(mixed, LIMIT, out=mixed)
                np.maximum(mixed, -LIMIT, out=mixed)
                np.exp(mixed, out=total)
                np.add(total, ONE, out=total)
                np.divide(rate, total, out=miss)
                np.subtract(miss, aims[a:b], out=miss)
                np.multiply(here, miss, out=here)
                np.add(w, here, out=w)
                weights[0][i], weights[1][i], weights[2][i] = w0, w1, w2
                t += 1
            cost += np.bincount(seats, np.log(sums) - (1 - v) * z, documents)  # of each bit, in nats; z is minus the log odds
        for k in range(count[rest]):
            x, v, gate = inputs(rows[rest : bits[order[k]]] + k)
            own = weights[:, order[k] :: documents].T.tolist()
            z = np.clip(self._mixed(x.tolist(), v.tolist(), gate.tolist(), own), -LIMIT, LIMIT)
            weights[:, order[k] :: documents] = np.array(own).T
            cost[k] += (np.log1p(np.exp(z)) - (1 - v) * z).sum()
        out[order] -= cost

    def _mixed(self, x: list, value: list, gate: list, weights: list) -> list[float]:
        """Minus the mixed log odds of one document's bits."""
        exp, rate, most, out = math.exp, self.rate, float(LIMIT), []
        for a, b, c, v, g in zip(*x, value, gate, strict=True):
            w = weights[g]
            z = w[0] * a + w[1] * b + w[2] * c
            out.append(z)
            miss = rate * (1 / (1 + exp(z if -most < z < most else most if z > 0 else -most)) - v)
            w[0] += miss * a
            w[1] += miss * b
            w[2] += miss * c
        return out


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: int = 1 << 18) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte for each row.

    Rows whose crc32(id) mod 7 is 2 are held out. ``vocabulary``: most words that are broadcast.
    """
    sc = docs.sparkSession.sparkContext
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), (crc_mod(id_col, 7) == 2).alias("held_out"))
    train = rows.filter("not held_out")
    counts = word_counts(train)
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    common = sc.broadcast(frequent_words(counts, vocabulary))
    mixer = sc.broadcast(Mixer.of(slot_counts(train, common)))
    logs = sc.broadcast(np.log10(common.value.counts + 1.0))

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        escape = len(common.value.keys)
        known = np.r_[logs.value, 0.0]
        for batch in batches:
            parts, scores, batch = [], [], batch.iloc[np.argsort([len(t or "") for t in batch["text"]])]  # documents of like length are mixed together
            waiting, n, words = [[], []], 0, 0

            def mixed():
                total = np.zeros(n)
                for number, (codes, streams) in enumerate(zip(common.value.codes, waiting, strict=True)):
                    if streams:
                        mixer.value.add_scores(codes, Stream.joined(streams), n, number, total)
                return total / np.log(10)

            for part, piece in stretches(batch["text"].tolist(), common.value, 300_000):
                m = len(part)
                is_rare = piece.found == escape
                sizes = np.bincount(piece.doc, minlength=m)
                rare = np.split(piece.keys[is_rare].view(np.int64), np.cumsum(np.bincount(piece.doc[is_rare], minlength=m))[:-1])
                parts.append(pd.DataFrame({"n_tokens": sizes, "known": np.bincount(piece.doc, ~is_rare, m).astype(np.int64), "logs": np.bincount(piece.doc, known[piece.found], m), "rare": rare}))
                for streams, stream in zip(waiting, piece.streams, strict=False):
                    stream.doc += n
                    streams.append(stream)
                n, words = n + m, words + len(piece.doc)
                if words > MOST_WORDS:
                    scores.append(mixed())
                    waiting, n, words = [[], []], 0, 0
            scores.append(mixed())
            if parts:
                out = pd.concat(parts, ignore_index=True)
                out.insert(3, "score", np.concatenate(scores))
                out.insert(0, "held_out", batch["held_out"].to_numpy())
                out.insert(0, "doc_id", batch["doc_id"].to_numpy())
                out["bytes"] = [len((t or "").encode("utf-8", "replace")) for t in batch["text"]]
                yield out

    id_type = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, held_out boolean, n_tokens long, known long, logs double, score double, rare array<long>, bytes long"
    scored = settle(rows.select("doc_id", "held_out", "text").mapInPandas(each, schema).withColumn("row", F.monotonically_increasing_id()), "scored")
    rare = scored.select("row", F.explode("rare").alias("key")).groupBy("row", "key").agg(F.count(F.lit(1)).alias("times")).join(counts, "key")
    rare = rare.groupBy("row").agg(F.sum("times").alias("more_known"), F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("more_logs"))
    out = scored.drop("rare").join(rare, "row", "left")
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(int(n)).cast("long").alias("train_tokens"),
        (F.col("logs") + F.coalesce("more_logs", F.lit(0.0)) - F.col("n_tokens") * F.log10(F.lit(float(n + v + 1)))).alias("base_score"),
        "score",
        F.when(F.col("bytes") > 0, -F.col("score") * F.lit(float(np.log2(10))) / F.col("bytes")).alias("bits_per_byte"),
    )
