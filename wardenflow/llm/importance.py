"""Importance resampling towards a target distribution, over hashed word runs, with identical texts worked on once.

Features of a text are its words and its pairs of consecutive words, each hashed into one of ``buckets``. A bucket's gain
is the log of how much more frequent it is in the target than in the documents, both smoothed by one. A text's weight is
the mean gain of its features; with Gumbel noise of the document's own it is the score, and the documents with the
highest scores are a sample without replacement in proportion to the exponentials of the weights.

Documents are grouped by their full text. Each different text is read for features once and its buckets are kept; counts
over the documents are sums of those buckets times the copies; weights are taken once for each text and joined back to
its documents by digest, before the noise of each document is added. What is gathered on the driver are ``buckets``
counts. Features are found in bytes, batch by batch, without a loop over words: all word characters beyond ASCII are
bytes from 0x80 on, a word's checksum is advanced for all words at once, and that of a pair follows from its words'.

Defined results
    null or empty text   no features, weight 0; never drawn if words are asked for
    null id              noise of the empty id; sorts after all others at equal scores
    repeated rows        each row counts, scores and is drawn by itself
    equal scores         smaller ids first, then the order of the rows
    very long text       read whole, in stretches of bounded size
    empty tables         an empty table gives an empty result; an empty target leaves the smoothing alone
    other columns        are not read
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardenflow.llm.common import fresh, join_hot, settle, text_of
from wardenflow.operators.windows import numbered

# --- features of a batch of texts -------------------------------------------------------------------------------

#: Bytes of words: digits, letters and all of characters beyond ASCII; upper case counts as lower case.
_BYTES = np.arange(256)
_IS_UPPER = (_BYTES >= 65) & (_BYTES <= 90)
LOWER = np.where(_IS_UPPER, _BYTES + 32, _BYTES).astype(np.uint8)
IN_WORD = ((LOWER >= 48) & (LOWER <= 57)) | ((LOWER >= 97) & (LOWER <= 122)) | (LOWER >= 128)
#: Words up to this many bytes are hashed together, longer ones one by one.
LONGEST = 64


def _byte_table() -> np.ndarray:
    """crc32's table: what a byte's eight shifts leave."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1).astype(np.uint32)
    return t


STEP = _byte_table()


def _shift_tables(most: int) -> np.ndarray:
    """[n, j, b]: the value b in byte j of a checksum after n zero bytes more. Shifts are linear, so bytes go one by one."""
    out = np.empty((most + 1, 4, 256), np.uint32)
    out[0] = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for n in range(1, most + 1):
        out[n] = STEP[out[n - 1] & 255] ^ (out[n - 1] >> 8)
    return out


SHIFTS = _shift_tables(LONGEST + 1)
SPACE = np.uint32(zlib.crc32(b" "))


def shifted(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Checksums after ``n`` zero bytes more, of ``LONGEST`` + 1 at most."""
    out = SHIFTS[n, 0, crc & 255]
    for j in (1, 2, 3):
        out = out ^ SHIFTS[n, j, (crc >> np.uint32(8 * j)) & 255]
    return out


def word_checksums(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """crc32 of each word of lower-cased ``data``."""
    order = np.argsort(-np.minimum(sizes, LONGEST + 1).astype(np.int16), kind="stable")
    at, left = starts[order], sizes[order]
    crc = np.full(len(order), 0xFFFFFFFF, np.uint32)
    long = int(np.count_nonzero(left > LONGEST))
    for k in range(int(left[long]) if long < len(left) else 0):
        some = slice(long, int(np.searchsorted(-left[long:], -k, "left")) + long)  # words of more than k bytes
        crc[some] = STEP[(crc[some] ^ data[at[some] + k]) & 255] ^ (crc[some] >> np.uint32(8))
    crc ^= np.uint32(0xFFFFFFFF)
    for i in range(long):
        crc[i] = zlib.crc32(data[at[i] : at[i] + left[i]])
    out = np.empty_like(crc)
    out[order] = crc
    return out


def pair_checksums(data: np.ndarray, crc: np.ndarray, starts: np.ndarray, sizes: np.ndarray, before: np.ndarray) -> np.ndarray:
    """crc32 of each word's predecessor, a space and the word; ``before``: the predecessors' checksums."""
    n = np.minimum(sizes, LONGEST)
    out = shifted(before, n + 1) ^ shifted(np.full(len(n), SPACE), n) ^ crc
    for i in np.flatnonzero(sizes > LONGEST).tolist():
        out[i] = zlib.crc32(data[starts[i] : starts[i] + sizes[i]], zlib.crc32(b" ", int(before[i])))
    return out


def stretches(data: np.ndarray, offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ends of pieces of about ``most`` bytes that cut no word."""
    low, end, edges = int(offsets[0]), int(offsets[-1]), offsets
    while low < end:
        high = min(low + most, end)
        while high < end and IN_WORD[data[high]] and IN_WORD[data[high - 1]] and edges[np.searchsorted(edges, high)] != high:
            window = data[high : high + 4096]
            gap = np.flatnonzero(~IN_WORD[window])
            edge = int(edges[np.searchsorted(edges, high)])
            high = min(high + (int(gap[0]) if len(gap) else len(window)), edge)
        yield low, high
        low = high


def features(texts: pa.Array, buckets: int, most: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Number of words of each text, and the buckets of all features, text by text."""
    if pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.string())
    _, where, content = texts.buffers()
    offsets = np.frombuffer(where, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(content, np.uint8) if content is not None else np.zeros(0, np.uint8)
    words, found = np.zeros(len(texts), np.int64), []
    last_text, last_crc = -1, np.uint32(0)
    edges = np.unique(offsets)
    for low, high in stretches(raw, offsets, most):
        data = LOWER[raw[low:high]]
        inside = IN_WORD[data]
        begin = inside.copy()
        begin[1:] &= ~inside[:-1]
        here = edges[np.searchsorted(edges, low) : np.searchsorted(edges, high)] - low
        begin[here] = inside[here]
        starts = np.flatnonzero(begin)
        if not len(starts):
            continue
        stop = ~inside
        stop[here] = True  # a text's first byte ends the word before
        stops = np.append(np.flatnonzero(stop), len(data))
        sizes = stops[np.searchsorted(stops, starts, "right")] - starts
        text = np.searchsorted(offsets, starts + low, "right") - 1
        crc = word_checksums(data, starts, sizes)
        before, before_text = np.concatenate([[last_crc], crc[:-1]]), np.concatenate([[last_text], text[:-1]])
        both = np.empty((len(crc), 2), np.uint32)
        both[:, 0], both[:, 1] = pair_checksums(data, crc, starts, sizes, before.astype(np.uint32)), crc
        there = np.ones((len(crc), 2), bool)
        there[:, 0] = before_text == text
        found.append((both % np.uint32(buckets))[there])
        words += np.bincount(text, minlength=len(texts))
        last_text, last_crc = text[-1], crc[-1]
    return words, np.concatenate(found) if found else np.zeros(0, np.uint32)


# --- the operator -----------------------------------------------------------------------------------------------

DIGEST = "digest"


def _digest(column: str) -> Column:
    return F.unhex(F.sha2(F.col(column), 256))


def featured(docs: DataFrame, buckets: int, text_col: str = "text") -> DataFrame:
    """A settled row for each different text: digest, copies, words, buckets of its features."""
    kind = "<u2" if buckets <= 1 << 16 else "<u4"
    texts = docs.select(text_of(text_col).alias("text")).groupBy("text").agg(F.count(F.lit(1)).alias("copies"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            words, found = features(batch.column("text"), buckets)
            ends = np.concatenate([[0], np.cumsum(np.maximum(0, 2 * words - 1))]) * np.dtype(kind).itemsize
            raw = found.astype(kind).tobytes()
            packed = [raw[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(DIGEST), batch.column("copies"), pa.array(words), pa.array(packed, pa.binary())], names=[DIGEST, "copies", "words", "buckets"])

    return settle(texts.withColumn(DIGEST, _digest("text")).mapInArrow(read, f"{DIGEST} binary, copies long, words long, buckets binary"), "features", "zstd")


def _of_batch(batch: pa.RecordBatch, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """All buckets of a batch's texts, and how many each text has."""
    column = batch.column("buckets")
    kind = np.dtype("<u2" if buckets <= 1 << 16 else "<u4")
    raw = b"".join([x.as_py() for x in column])
    return np.frombuffer(raw, kind), np.maximum(0, 2 * batch.column("words").to_numpy() - 1)


def bucket_counts(table: DataFrame, buckets: int) -> np.ndarray:
    """Features in each bucket over all documents: a sum of ``buckets`` numbers from each task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(buckets, np.int64)
        for batch in batches:
            found, n = _of_batch(batch, buckets)
            copies = batch.column("copies").to_numpy()
            once = np.repeat(copies == 1, n)
            held += np.bincount(found[once], minlength=buckets)
            if not once.all():
                times = np.repeat(copies, n)[~once]
                np.add.at(held, found[~once], times)
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(held[some])], names=["bucket", "n"])

    sums = table.select("copies", "words", "buckets").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for bucket, n in sums.collect():  # ``buckets`` rows at most
        out[bucket] = n
    return out


def gains(target: np.ndarray, corpus: np.ndarray) -> np.ndarray:
    """Thousandths of a natural logarithm, floored, of each bucket's smoothed share in the target over that in the corpus."""
    n = len(target)
    t, s = target.astype(float), corpus.astype(float)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def weights(table: DataFrame, gain: np.ndarray) -> DataFrame:
    """digest, words, n_features, weight of each different text; the weight is the floored mean gain."""
    buckets = len(gain)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, n = _of_batch(batch, buckets)
            upto = np.concatenate([[0], np.cumsum(gain[found])])
            ends = np.cumsum(n)
            total = upto[ends] - upto[ends - n]
            weight = np.where(n > 0, total // np.maximum(n, 1), 0)
            yield pa.RecordBatch.from_arrays([batch.column(DIGEST), batch.column("words"), pa.array(n), pa.array(weight)], names=[DIGEST, "words", "n_features", "weight"])

    return table.select(DIGEST, "words", "buckets").mapInArrow(weigh, f"{DIGEST} binary, words long, n_features long, weight long")


def noise(id_column: str, seed: int) -> Column:
    """Gumbel noise in thousandths, floored, from a hash of the seed and the document's id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_column).cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000.0 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def importance(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, buckets: int = 10_000, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """doc_id, n_features, weight, score, rank and digest of each document; ``rank`` counts the drawn ones from 1 and is null for others.

    Of the documents with ``least_words`` words or more, ``percent`` in a hundred are drawn, rounded down.
    """
    table = featured(docs, buckets, text_col)
    gain = gains(bucket_counts(featured(target, buckets, target_col), buckets), bucket_counts(table, buckets))
    ids = docs.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("row"), text_of(text_col).alias("text"))
    ids = settle(ids.select("doc_id", "row", _digest("text").alias(DIGEST)), "importance_ids")
    scored = join_hot(ids, settle(weights(table, gain), "weights"), DIGEST)
    scored = scored.withColumn("score", F.col("weight") + noise("doc_id", seed)).withColumns({"short": F.col("words") < least_words, "no_id": F.col("doc_id").isNull(), "fall": -F.col("score")})
    scored = settle(scored, "scores")
    n, long = scored.agg(F.count(F.lit(1)), F.count_if(~F.col("short"))).first()
    drawn = percent * long // 100
    placed = numbered(scored, ["short", "fall", "no_id", "doc_id", "row"], "rank", buckets=int(min(4096, max(8, n >> 20))))
    rank = F.when(~F.col("short") & (F.col("rank") <= drawn), F.col("rank"))
    return placed.select("doc_id", "n_features", "weight", "score", rank.cast("long").alias("rank"), DIGEST)


def draw(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that are drawn, with all their columns; rows that share id and text come together if one is drawn."""
    own_id, own_digest, mark = fresh(docs, "drawn_id"), fresh(docs, "drawn_digest"), fresh(docs, "digest_of_text")
    drawn = importance(docs, target, id_col=id_col, text_col=text_col, **options).filter("rank is not null").select(F.col("doc_id").alias(own_id), F.col(DIGEST).alias(own_digest)).distinct()
    marked = docs.withColumn(mark, F.unhex(F.sha2(text_of(text_col), 256)))
    return marked.join(drawn, F.col(id_col).eqNullSafe(F.col(own_id)) & (F.col(mark) == F.col(own_digest)), "left_semi").drop(mark)
