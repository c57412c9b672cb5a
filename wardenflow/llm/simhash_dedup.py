"""SimHash near-dedup with pigeonring filtering.

Fingerprints of 64 bits link when they differ in at most three bits. Lay the bits out as a ring of four segments of
16. If a pair differs in at most three bits, some segment starts a chain whose first one, two and three segments
differ in at most 3/4, 6/4 and 9/4 bits, that is in 0, 1 and 2. So the first segment is equal, and either the second
is equal too, or it differs in one bit and the third in at most one: then a half of each of them is equal. That gives
five 32-bit keys for each start, 20 for each fingerprint, and every linked pair shares one. Pairs under a key must
then pass the chain condition before the full distance is taken.

Only distinct fingerprints are compared. Under a key a breadth-first walk compares each visited fingerprint with the
unvisited ones, so that a group of n gives n - 1 links at most, not its pairs. A key with more than ``crowd``
fingerprints is split into four by further bits of which one quarter must be equal, again and again, until it is
small or has so few free bits left that it cannot be large; no pair is lost by this.

Defined results
    null or empty text, or only white space   fingerprint zero, linked like any other
    one or two words                          one shingle of all words
    null id                                   takes part; component_id is the smallest id that is not null, or null
    repeated rows                             equal texts have equal fingerprints and one component
    empty table                               empty result
    other columns                             are not read
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardenflow.llm.common import fresh, join_hot, settle
from wardenflow.llm.components import connected_components

FULL = (1 << 64) - 1
SEED = 42


# --- fingerprints -----------------------------------------------------------------------------------------------


def simhash(text: str | None, shingle: int = 3, step: int = 65536) -> int:
    """Fingerprint of a whole text: bit b is 1 if it is set in over half of the shingles' hashes."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # for bytes both look at ASCII only
    if not words:
        return 0
    if len(words) <= shingle:
        parts = [b" ".join(words)]
    elif shingle == 3:
        parts = [b"%b %b %b" % x for x in zip(words, words[1:], words[2:])]
    else:
        parts = [b" ".join(words[i : i + shingle]) for i in range(len(words) - shingle + 1)]
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for i in range(0, len(parts), step):  # a very long text takes no more memory than this
        hashes = np.array([digest(x, SEED) for x in parts[i : i + step]], np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(parts), bitorder="little").view(np.uint64)[0])


def _simhashes(texts: pd.Series) -> pd.Series:
    return pd.Series(np.array([simhash(x) for x in texts], np.uint64).view(np.int64))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A settled table ``doc_id, fp``."""
    simhashes = F.pandas_udf(_simhashes, "long")
    return settle(docs.select(F.col(id_col).alias("doc_id"), simhashes(F.col(text_col).cast("string")).alias("fp")), "fingerprints")


# --- pigeonring keys --------------------------------------------------------------------------------------------


def ring_masks() -> list[int]:
    """The bits that each of the 20 keys takes from a fingerprint."""
    segment = lambda i: 0xFFFF << 16 * (i % 4)
    half = lambda i, h: 0xFF << (16 * (i % 4) + 8 * h)
    out = []
    for i in range(4):
        out.append(segment(i) | segment(i + 1))
        out += [segment(i) | half(i + 1, a) | half(i + 2, b) for a in (0, 1) for b in (0, 1)]
    return out


def finer(mask: int) -> list[int]:
    """``mask`` with each quarter of its free bits: a pair with three differences or less agrees on one of them."""
    free = [b for b in range(64) if not mask >> b & 1]
    return [mask | sum(1 << int(b) for b in part) for part in np.array_split(free, 4)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _keyed(rows: DataFrame, masks) -> DataFrame:
    """``mask, key, fp``: a row for each mask; ``masks`` is an array column of the masks to apply."""
    out = rows.select("fp", F.explode(masks).alias("mask"))
    return out.select("mask", F.xxhash64("mask", F.col("fp").bitwiseAND(F.col("mask"))).alias("key"), "fp")


def chained(p: np.uint64 | np.ndarray, others: np.ndarray, most: int = 3) -> np.ndarray:
    """Which of ``others`` are within ``most`` bits of ``p``, or of its element at the same place; the chain condition prunes before the full sum."""
    d = np.bitwise_count((others ^ p).view(np.uint16)).reshape(-1, 4).astype(np.int16)
    two = d + np.roll(d, -1, axis=1)
    three = two + np.roll(d, -2, axis=1)
    may = np.flatnonzero(((4 * d <= most) & (4 * two <= 2 * most) & (4 * three <= 3 * most)).any(axis=1))
    out = np.zeros(len(others), bool)
    out[may] = d[may].sum(axis=1) <= most
    return out


def spanning(fps: np.ndarray) -> list[tuple[int, int]]:
    """Links that join the fingerprints of one key as all their close pairs would; fewer than there are fingerprints."""
    links, left = [], fps
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            p = queue.pop()
            near = chained(p, left)
            if near.any():
                queue.extend(left[near])
                links += [(int(p), int(x)) for x in left[near]]
                left = left[~near]
    return links


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key come in; the links under each key go out. A key may go on in the next batch."""
    held = None
    for batch in batches:
        key, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        if not len(key):
            continue
        if held is not None:
            key, fp = np.concatenate([held[0], key]), np.concatenate([held[1], fp])
        last = np.searchsorted(key, key[-1])
        held = key[last:], fp[last:]
        yield from _linked(key[:last], fp[:last])
    if held is not None:
        yield from _linked(*held)


def _linked(key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
    if len(key) < 2:
        return
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[starts, len(key)])
    bits = np.ascontiguousarray(fp).view(np.uint64)
    two = starts[sizes == 2]
    close = chained(bits[two], bits[two + 1])
    found = [*zip(bits[two][close].tolist(), bits[two + 1][close].tolist(), strict=True)]
    for s, n in zip(starts[sizes > 2], sizes[sizes > 2], strict=True):
        found += spanning(bits[s : s + n])
    if found:
        pairs = np.array(found, np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def fingerprint_links(fps: DataFrame, crowd: int = 65536) -> DataFrame:
    """Links ``a, b`` between the distinct fingerprints ``fp``, enough for the components of all close pairs.

    ``crowd``: most fingerprints under a key that one task takes in; above it the key is split by further bits.
    """
    spark = fps.sparkSession
    masks = ring_masks()
    rows, found = _keyed(fps, F.array(*[F.lit(_signed(m)) for m in masks])), None
    while True:
        crowded = settle(rows.groupBy("mask", "key").count().filter(F.col("count") > crowd).drop("count"), "crowded")
        at_end = all(bin(FULL & ~m).count("1") <= 16 for m in masks)
        hot = not at_end and not crowded.isEmpty()
        cold = rows.join(crowded, ["mask", "key"], "left_anti") if hot else rows
        part = cold.select("key", "fp").repartition("key").sortWithinPartitions("key").mapInArrow(_links, "a long, b long")
        found = part if found is None else found.unionByName(part)
        if not hot:
            return found
        again = spark.createDataFrame([(_signed(m), [_signed(x) for x in finer(m)]) for m in masks], "mask long, finer array<long>")
        masks = [x for m in masks for x in finer(m)]
        rows = settle(_keyed(rows.join(crowded, ["mask", "key"], "left_semi").join(F.broadcast(again), "mask"), F.col("finer")), "finer")


# --- the operator -----------------------------------------------------------------------------------------------


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", crowd: int = 65536) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for each row of ``docs``."""
    table = fingerprints(docs, id_col, text_col)
    reps = settle(table.groupBy("fp").agg(F.min("doc_id").alias("rep")), "reps")
    linked = settle(connected_components(fingerprint_links(reps.select("fp"), crowd)), "components")
    named = linked.join(reps, linked["node"] == reps["fp"]).groupBy("component").agg(F.min("rep").alias("component_id"))
    named = join_hot(linked, named, "component").select(F.col("node").alias("fp"), "component_id")
    every = settle(reps.join(named, "fp", "left").select("fp", F.coalesce("component_id", "rep").alias("component_id")), "named")
    return join_hot(table, every, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", crowd: int = 65536) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of each component the row with the smallest id.

    Decisions are joined back by id, at every size by a merge join. Rows with a null id are kept. Rows that repeat a kept id and its text count once.
    """
    kept_id = fresh(docs, "kept_id")
    kept = settle(near_groups(docs, id_col, text_col, crowd).filter("doc_id = component_id").select(F.col("doc_id").alias(kept_id)).distinct(), "kept")
    out = docs.filter(F.col(id_col).isNull()).unionByName(docs.join(kept.hint("merge"), F.col(id_col) == F.col(kept_id), "left_semi"))
    held = docs.groupBy(id_col).count().filter(f"count > 1 and {id_col} is not null").limit(1)
    return out if held.isEmpty() else out.dropDuplicates([id_col, text_col])
