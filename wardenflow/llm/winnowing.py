"""Document fingerprints by winnowing, with DataFrame functions only.

A text's words are hashed; each run of ``gram`` words gets the cyclic polynomial hash of its word hashes, the one that
a rolling window would carry along, written in closed form as the window is short. Of each ``window`` consecutive
hashes the smallest is chosen, of equal ones the rightmost, and its position is kept. So any passage of
gram + window - 1 words (20 by default) that two texts share gives them a common fingerprint.

Window minima come from doubling: minima of 2, 4, 8 ... consecutive hashes, each from two of the step before, so the
work for each word does not depend on the window. Hashes are ordered by 32 bits, stored with the position in one long.

Defined results
    null or empty text, or only white space   no fingerprint; two such texts have likeness 1, with another text 0
    fewer words than ``gram``                 one hash of all words
    fewer hashes than ``window``              one choice among all of them
    ids of another type than integers         a TypeError, as they have no order of numbers
    null id                                   no place in the order: nothing follows it, and it follows nothing
    repeated ids                              ordered by text
    one document                              is its own next document
    empty table                               empty result
    other columns                             are not read
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardenflow.llm.common import SPACES, text_of

GRAM, WINDOW = 5, 16
LOW32, POSITIONS = (1 << 32) - 1, (1 << 31) - 1


def _rotated(x: Column, by: int) -> Column:
    return x if not by else F.shiftleft(x, by).bitwiseOR(F.shiftrightunsigned(x, 64 - by))


def _gram_hash(hashes: Column, at: Column, gram: int) -> Column:
    out = _rotated(F.get(hashes, at), gram - 1)
    for j in range(1, gram):
        out = out.bitwiseXOR(_rotated(F.get(hashes, at + j), gram - 1 - j))
    return out


def _least_of_two(m: Column, step: int):
    """For a lambda: the least of an element and the one ``step`` after it, or the last."""
    return lambda x, i: F.least(x, F.get(m, F.least(i + step, F.size(m) - 1)))


def winnow(df: DataFrame, text_col: str, out: str, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """``df`` with ``out``: chosen hashes in order of position, each a long of 32 bits of hash and 31 of position.

    ``text_col`` must not be null. Each step is a projection of its own, so that no array is computed twice.
    """
    h, m = F.col("h__"), F.col("m__")
    kept = df.columns
    df = df.withColumn("w__", F.array_remove(F.split(text_col, SPACES), ""))
    df = df.select(*kept, F.transform("w__", lambda w: F.xxhash64(w)).alias("h__"))
    count = F.size(h) - gram + 1
    grams = F.when(count > 0, F.transform(F.slice(h, 1, F.greatest(count, F.lit(1))), lambda _, i: _gram_hash(h, i, gram))).when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>"))
    df = df.select(*kept, grams.alias("m__"))
    low = F.transform(m, lambda x, i: F.shiftleft(x.bitwiseAND(F.lit(LOW32)), 31).bitwiseOR(F.lit(POSITIONS) - i))
    df = df.select(*kept, low.alias("m__"))
    have = 1
    while have < window:  # minima of ``have`` hashes become minima of ``have + step``
        step = min(have, window - have)
        df = df.select(*kept, F.transform(m, _least_of_two(m, step)).alias("m__"))
        have += step
    return df.select(*kept, F.array_distinct(F.slice(m, 1, F.greatest(F.size(m) - window + 1, F.lit(1)))).alias(out))


def hash_of(choice: Column) -> Column:
    return F.shiftrightunsigned(choice, 31)


def position_of(choice: Column) -> Column:
    return (F.lit(POSITIONS) - choice.bitwiseAND(F.lit(POSITIONS))).cast("int")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """doc_id, fingerprint: an array of ``hash, position`` for each row; position counts words from 0."""
    df = winnow(docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("t__")), "t__", "c__", gram, window)
    return df.select("doc_id", F.transform("c__", lambda c: F.struct(hash_of(c).alias("hash"), position_of(c).alias("position"))).alias("fingerprint"))


def _written(choices: str) -> Column:
    """hash:position, comma-joined; hash in 8 hex digits."""
    return F.array_join(F.transform(choices, lambda c: F.concat(F.lower(F.lpad(F.hex(hash_of(c)), 8, "0")), F.lit(":"), position_of(c).cast("string"))), ",")


def _hashes(choices: str) -> Column:
    return F.array_distinct(F.transform(choices, hash_of))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard index of two arrays without repeats; 1 for two empty ones."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either == 0, F.lit(1.0)).otherwise(both / either)


def _bucket(cuts: list[int], step: int = 256) -> Column:
    """How many of the rising ``cuts`` are below the id: whole runs of ``step`` first, then within the next run."""
    below = lambda some: F.size(F.filter(some, lambda c: c < F.col("doc_id")))
    whole = below(F.lit(np.array(cuts[step - 1 :: step], np.int64))) if len(cuts) >= step else F.lit(0)
    return whole * step + below(F.slice(F.lit(np.array(cuts, np.int64)), whole * step + 1, F.lit(step)))


def _with_next(rows: DataFrame, per_bucket: int, most_buckets: int) -> DataFrame:
    """``rows`` (doc_id, text, choices) with next_text and next_choices, those of the next id, cyclically.

    Ids are cut into buckets at approximate quantiles, ``most_buckets`` at most. Each bucket also gets a copy of the
    first document of the next one, so each row finds its successor in its own bucket and texts are shuffled once.
    """
    ids = rows.select("doc_id").filter("doc_id is not null")
    n = ids.count()
    buckets = max(1, min(most_buckets, n // per_bucket))
    cuts = sorted(set(ids.agg(F.percentile_approx("doc_id", [i / buckets for i in range(1, buckets)], 20 * buckets)).first()[0] or [])) if buckets > 1 else []
    bucket = _bucket(cuts) if cuts else F.lit(0)
    firsts = [tuple(x) for x in ids.groupBy(bucket.alias("b")).agg(F.min("doc_id")).orderBy("b").collect()]  # a row for each bucket
    spark = rows.sparkSession
    halo = spark.createDataFrame([(b, first, firsts[i - 1][0]) for i, (b, first) in enumerate(firsts)], "b__ int, first__ long, before__ int")
    placed = rows.filter("doc_id is not null").withColumn("bucket", bucket).join(F.broadcast(halo), F.col("bucket") == F.col("b__"))
    own = F.struct(F.col("bucket").alias("b"), F.lit(0).alias("h"))
    lent = F.struct(F.col("before__").alias("b"), F.lit(1).alias("h"))
    spots = F.when(F.col("doc_id") == F.col("first__"), F.array(own, lent)).otherwise(F.array(own))
    placed = placed.select("doc_id", "text", "choices", F.explode(spots).alias("spot")).select("doc_id", "text", "choices", F.col("spot.b").alias("bucket"), F.col("spot.h").alias("halo"))
    order = Window.partitionBy("bucket").orderBy("halo", "doc_id", "text")
    follow = placed.withColumns({"next_text": F.lead("text").over(order), "next_choices": F.lead("choices").over(order)})
    alone = rows.filter("doc_id is null").select("doc_id", "text", "choices", F.lit("").alias("next_text"), F.array().cast("array<bigint>").alias("next_choices"))
    return follow.filter("halo = 0").select("doc_id", "text", "choices", "next_text", "next_choices").unionByName(alone)


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", gram: int = GRAM, window: int = WINDOW, per_bucket: int = 2000, most_buckets: int = 1 << 16) -> DataFrame:
    """Fingerprints of each text and of its edited text, whose later half gives way to the next document's beginning.

    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for each row.
    """
    if docs.schema[id_col].dataType.typeName() not in ("byte", "short", "integer", "long", "void"):
        raise TypeError(f"{id_col} must be an integer: the next document is the one with the next larger id")
    rows = winnow(docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")), "text", "choices", gram, window)
    df = _with_next(rows, per_bucket, most_buckets)
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    df = df.withColumn("n_chars", n.cast("long")).withColumn("edited", F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half)))
    df = winnow(df.drop("text", "next_text"), "edited", "edited_choices", gram, window)
    df = df.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), _written("choices").alias("fingerprint"), _written("edited_choices").alias("edited_fingerprint"), _hashes("choices").alias("a"), _hashes("edited_choices").alias("b"), _hashes("next_choices").alias("c"))
    return df.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(F.col("a"), F.col("b")).alias("near_edited"), likeness(F.col("a"), F.col("c")).alias("near_next"))
