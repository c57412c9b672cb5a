"""Exact dedup: frequent digests go map-side, the others through an ordinary shuffle.

A bounded Misra-Gries summary (Spark's frequent-items sketch, a variant of it) proposes digests that may be
frequent; their exact counts are then taken, and the winners, at most ``tracked`` rows, are broadcast. Rows with a
winner's digest are decided where they are read. The remaining digests, none of which is frequent, are counted
with partial aggregation and joined back.

Defined results
    null text       counts as empty text, so null and empty texts form one group
    null id         sorts after every other id: such a row stays only if its whole group has null ids
    repeated rows   one row of the group stays, also where id and text repeat together
    empty table     empty result
    other columns   are not looked at; names used here cannot clash, as only id and text are read
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardenflow.llm.common import SPACES, fresh, settle, text_of


def normalised(column: str = "text"):
    """Runs of white space become one space."""
    return F.regexp_replace(text_of(column), SPACES, " ")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A settled table ``doc_id, row, digest``: one row for each input row, with a handle of its own."""
    return settle(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.monotonically_increasing_id().alias("row"),
            F.sha2(normalised(text_col), 256).alias("digest"),
        ),
        "digests",
    )


def _first():
    """Smallest id first, null ids last, then the row handle."""
    return F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("row"))


def frequent(table: DataFrame, column: str, tracked: int = 1024, fan_in: int = 256, heavy_rows: int = 64) -> DataFrame:
    """Exact count and first row of each value that the summary names and that has ``heavy_rows`` rows or more.

    The summaries are merged in two levels, so that no task merges one from every input partition. At most
    ``tracked`` rows come out, whatever the size of ``table``.
    """
    low = table.groupBy((F.spark_partition_id() % fan_in).alias("part")).agg(F.expr(f"approx_top_k_accumulate({column}, {4 * tracked})").alias("summary"))
    # grouped, as a partition without rows has no summary that could be merged
    top = low.groupBy(F.lit(0).alias("all")).agg(F.expr(f"approx_top_k_combine(summary, {4 * tracked})").alias("summary"))
    named = top.select(F.explode(F.expr(f"approx_top_k_estimate(summary, {tracked})")).alias("x")).select(F.col("x.item").alias(column), F.col("x.count").alias("guess"))
    named = named.filter(F.col("guess") >= heavy_rows).select(column)
    return table.join(F.broadcast(named), column).groupBy(column).agg(F.count(F.lit(1)).alias("group_size"), F.min(_first()).alias("first")).filter(F.col("group_size") >= heavy_rows)


def exact_groups(table: DataFrame, tracked: int = 1024) -> DataFrame:
    """``digests`` with the group of each row: keep_id, group_size, kept."""
    winners = settle(frequent(table, "digest", tracked), "winners")
    light = table.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
    groups = light.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"), F.min(_first()).alias("first"))
    out = table.join(F.broadcast(winners), "digest").unionByName(light.join(groups, "digest"))
    return out.select(
        "doc_id",
        "row",
        F.col("first.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("first.row")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tracked: int = 1024) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for each row of ``docs``, dropped ones too."""
    return exact_groups(digests(docs, id_col, text_col), tracked).drop("row")


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tracked: int = 1024) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Decisions are joined back by id, at every size by a merge join: ids spread evenly, and texts are shuffled once. Only if a kept id occurs in several rows, are those rows told apart by digest.
    """
    kept_id, kept_sha, sha = (fresh(docs, n) for n in ("kept_id", "kept_sha", "sha"))
    kept = settle(exact_dedup(docs, id_col, text_col, tracked).filter("kept").select(F.col("doc_id").alias(kept_id), F.col("text_sha256").alias(kept_sha)), "kept")
    plain = docs.join(kept.select(kept_id).hint("merge"), F.col(id_col).eqNullSafe(F.col(kept_id)), "left_semi")
    held = docs.groupBy(id_col).count().filter(f"count > 1 or {id_col} is null").limit(1)
    if held.isEmpty():
        return plain
    marked = plain.withColumn(sha, F.sha2(normalised(text_col), 256))
    same = F.col(id_col).eqNullSafe(F.col(kept_id)) & (F.col(sha) == F.col(kept_sha))
    return marked.join(kept, same, "left_semi").dropDuplicates([id_col, sha]).drop(sha)
