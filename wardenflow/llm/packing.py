"""Best-fit packing of documents into sequences, improved by a swap-based local search.

Documents become token ids; only those longer than a sequence are cut, and their first piece may be shorter. Pieces
are dealt evenly into groups of bounded size, and each group is packed by itself. Best fit gives two starts, in order of
falling length and in order of arrival. From each a local search goes on over the bins that are not full: the emptiest
gives, and of all moves, one-for-one and two-for-one exchanges with another bin that raise the sum of squared fills, the
one that moves most tokens is made, until the giver is empty, which saves a sequence, or no exchange is left. The search
ends when no bin can be saved any more, as all tokens need that many, or when no bin has an exchange. The packing with
fewer sequences is kept: falling order starts near the least possible, but leaves little to exchange; from order of
arrival the search gains more, and most where lengths lie between a quarter and a half of a sequence.

Groups have thousands of sequences, so the one part-filled sequence that each may leave is a small share.

Defined results
    null or empty text   one piece with the end id alone
    null id              packed like any other; its pieces carry a null id
    repeated rows        each row gives its own pieces
    very long text       cut into as many pieces as it needs
    special tokens       their strings become their ids, as tokenizers has it
    empty table          empty result
    other columns        are not read
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardenflow.llm.common import settle

END = (2).to_bytes(4, "little")
PIECES = "doc_id {id}, piece int, start long, length long, ids_crc32 long"


class Encoder:
    """Token ids of whole texts as little-endian unsigned 32-bit bytes.

    The vocabulary file is that of a byte-level BPE whose ids are its merge ranks, so tiktoken, several times as fast,
    gives the ids that tokenizers would. Texts with the string of an added token, or with a run of white space so long
    that tiktoken's pattern matcher may give up, are encoded by tokenizers.
    """

    LONG_RUN = re.compile(r"\s{5000}")

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        byte_of = {c: b for b, c in enumerate(_byte_letters())}
        ranks = {bytes(map(byte_of.__getitem__, x)): i for x, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if all(c in byte_of for c in x)}
        self.fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> bytes:
        if self.LONG_RUN.search(text) or any(x in text for x in self.added):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return np.array(self.fast.encode_ordinary(text), "<u4").tobytes()


def _byte_letters() -> list[str]:
    """The letter that a byte-level BPE writes for each byte: printable ones for themselves, others from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each vocabulary file and process, so that what it remembers serves many batches."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def cut(ids: bytes, size: int) -> list[tuple[int, int]]:
    """start and length of each piece: one if it fits, else pieces of ``size`` after a first one with the remainder."""
    n = len(ids) // 4
    if n <= size:
        return [(0, n)]
    head = n % size
    return [(0, head)] * bool(head) + [(s, size) for s in range(head, n, size)]


def pieces(docs: DataFrame, vocabulary: str, size: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A settled table of pieces with a row handle."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = encoder(vocabulary)
        for batch in batches:
            rows = []
            for place, text in enumerate(batch.column("text").to_pylist()):
                ids = memoryview(ids_of(text or "") + END)
                rows += [(place, k, s, n, zlib.crc32(ids[4 * s : 4 * (s + n)])) for k, (s, n) in enumerate(cut(ids, size))]
            if rows:
                place, *others = zip(*rows, strict=True)
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
                columns = [batch.column("doc_id").take(pa.array(place))] + [pa.array(x, t) for x, t in zip(others, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32"])

    chosen = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = PIECES.format(id=chosen.schema["doc_id"].dataType.simpleString())
    return settle(chosen.mapInArrow(encode, schema).withColumn("row", F.monotonically_increasing_id()), "pieces")


# --- packing one group ------------------------------------------------------------------------------------------


def best_fit(lengths: list[int], size: int, falling: bool = True) -> list[list[int]]:
    """Bins of item numbers: in order of falling length, or as they come, each item goes where it leaves least room."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(size + 1)]
    some = 0  # bit r is set while a bin has room r
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)) if falling else range(len(lengths)):
        n = lengths[i]
        if fits := some >> n:
            room = n + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                some ^= 1 << room
            bins[b].append(i)
        else:
            room, b = size, len(bins)
            bins.append([i])
        if rest := room - n:
            by_room[rest].append(b)
            some |= 1 << rest
    return bins


def _gifts(items: list[int], lengths: list[int]) -> list[tuple[int, tuple[int, ...]]]:
    """Length and items of what a bin may give: one item or two, of each length once."""
    by_length: dict[int, list[int]] = {}
    for i in items:
        by_length.setdefault(lengths[i], []).append(i)
    out = {n: (own[0],) for n, own in by_length.items()}
    different = sorted(by_length)
    for k, n in enumerate(different):
        for m in different[: k + 1]:
            if n != m or len(by_length[n]) > 1:
                out.setdefault(n + m, (by_length[n][-1], by_length[m][0]))
    return sorted(out.items())


def local_search(bins: list[list[int]], lengths: list[int], size: int) -> list[list[int]]:
    """``bins`` after improving exchanges: each raises the sum of squared fills, and a bin that runs empty goes.

    A gain of d tokens for a taker does so if d is more than the giver has above it. The search ends when as few bins
    are left as the tokens need, or when no bin has an improving exchange with another.
    """
    own = [list(b) for b in bins]
    length, home = np.asarray(lengths, np.int64), np.zeros(len(lengths), np.int64)
    for b, items in enumerate(own):
        home[items] = b
    fill = np.bincount(home, length, len(own)).astype(np.int64)
    left, least = len(own), -(-int(length.sum()) // size)
    vain: set[int] = set()  # bins that had no exchange when they were givers, and have not changed since
    while left > least:
        free = (fill > 0) & (fill < size)
        givers = [b for b in np.flatnonzero(free)[np.argsort(fill[free], kind="stable")].tolist() if b not in vain]
        if not givers:
            break
        g = givers[0]
        free[g] = False
        while fill[g]:
            room = np.where(free, size - fill, 0)
            over = np.maximum(0, fill[g] - fill)
            items = np.flatnonzero(free[home])
            back, bin_of = length[items], home[items]
            most, above = room[bin_of], over[bin_of]
            gain, chosen = 0, None
            for n, given in _gifts(own[g], lengths):
                takers = np.flatnonzero((room >= n) & (over < n)) if n > gain else []
                if len(takers):
                    gain, chosen = n, (given, int(takers[room[takers].argmin()]), ())
                worth = n - back
                worth[(worth > most) | (worth <= above)] = 0
                k = int(worth.argmax()) if len(worth) else 0
                if len(worth) and worth[k] > gain:
                    gain, chosen = int(worth[k]), (given, int(bin_of[k]), (int(items[k]),))
            if chosen is None:
                break
            given, t, returned = chosen
            own[g] = [i for i in own[g] if i not in given] + [*returned]
            own[t] = [i for i in own[t] if i not in returned] + [*given]
            home[list(given)], home[list(returned)] = t, g
            fill[g], fill[t] = fill[g] - gain, fill[t] + gain
            free[t] = fill[t] < size
            vain.discard(t)
        if fill[g]:
            vain.add(g)
        else:
            left -= 1
    return [b for b in own if b]


def pack(lengths: list[int], size: int) -> list[list[int]]:
    """The search from both starts; the one with fewer bins."""
    tried = [local_search(best_fit(lengths, size, falling), lengths, size) for falling in (True, False)]
    return min(tried, key=len)


# --- the operator -----------------------------------------------------------------------------------------------

PACKED = f"{PIECES}, sequence_id long, offset long"


def packed(docs: DataFrame, vocabulary: str, size: int = 1024, group: int = 8_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    ``group``: pieces that are packed together, about; their number follows from the table's.
    """
    table = pieces(docs, vocabulary, size, id_col, text_col)
    groups = max(1, -(-table.filter(F.col("length") < size).count() // group))

    def pack_group(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("row")
        number, at = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        lengths = rows["length"].to_pylist()
        for b, items in enumerate(pack(lengths, size)):
            offset = 0
            for i in items:
                number[i], at[i] = b, offset
                offset += lengths[i]
        first = rows["group"][0].as_py() << 32
        kept = rows.select(["doc_id", "piece", "start", "length", "ids_crc32"])
        return kept.append_column("sequence_id", pa.array(first + number)).append_column("offset", pa.array(at))

    short = table.filter(F.col("length") < size).withColumn("group", F.col("row") % groups)
    full = table.filter(F.col("length") == size).drop("row").withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    schema = PACKED.format(id=table.schema["doc_id"].dataType.simpleString())
    return short.groupBy("group").applyInArrow(pack_group, schema).unionByName(full)
