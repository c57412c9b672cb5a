"""Mixing sources to target weights by Pareto order sampling.

A source's target over its size says how often each of its documents is wanted. The whole part of that is given to
every document as certain copies; the rest is its inclusion probability in a sample without replacement of fixed size.
Pareto order sampling ranks documents by odds(u) / odds(probability) with u uniform, and takes the first ones. Here the
fixed size is in words: the first documents are taken as long as they fit into what the certain copies leave open, and
the next places, three at most, go each to the largest document not yet taken that still fits. If others fit even then,
as behind a very long document that did not, rounds go on until none does: in each, those that fit are taken in order,
then the largest one that is left. A round at least halves what is open, so there are few.

The rank is found without sorting a source in one task. The ranking quantity q is cut into ``buckets`` of q / (1 + q);
words are summed by bucket, and only in the one bucket where a source's sample ends are rows ordered. q is near one
there whatever the probability, so that bucket has a small part of the source's rows.

u comes from MD5 of seed and id, so reruns agree.

Defined results
    null text       size 0, taken 0
    null source     a source of its own, after the others
    null id         sampled as the id '' would be; rows with equal rank are told apart by a row handle
    repeated rows   each row is a document of its own; rows with one id follow each other in rank
    empty table     empty result; if all sizes are 0, all targets are 0
    other columns   are not looked at
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardenflow.llm.common import WORDS, fresh, settle, text_of

WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3.0


def uniform(id_col: str, seed: int) -> Column:
    """A number in (0, 1) with 52 bits from MD5 of seed and id."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """source, source_size, target: shares by weight, none above ``most`` times the source's size.

    Sources are capped in the order of cap over weight; a source is capped if the share left for it, when those before
    it are capped, is above its cap. What the caps leave goes to the others by weight. One row for each source is
    ordered here, so this window is as small as the list of sources.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (turn % len(weights) + 1).cast("int"))
    rows = by_source.select("source", "source_size", weight.alias("weight"), (F.lit(most) * F.col("source_size")).alias("cap"))
    order = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(0))
    rows = rows.withColumns(
        {
            "total": F.sum("source_size").over(whole).cast("double"),
            "capped_before": F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
            "weight_left": F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
        }
    )
    rows = rows.withColumn("capped", (F.col("total") - F.col("capped_before")) * F.col("weight") > F.col("cap") * F.col("weight_left"))
    left = F.col("total") - F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(whole), F.lit(0.0))
    open_weight = F.sum(F.when(~F.col("capped"), F.col("weight"))).over(whole)
    return rows.select("source", "source_size", F.when(F.col("capped"), F.col("cap")).otherwise(left * F.col("weight") / open_weight).alias("target"))


def in_order(rows: DataFrame, buckets: int) -> DataFrame:
    """``rows`` (row, doc_id, source, size, q, wanted) with ``chosen``: the first of each source by q that fit into ``wanted``."""
    ranked = rows.withColumn("bucket", F.floor(F.lit(float(buckets)) * F.col("q") / (F.lit(1.0) + F.col("q"))))
    sums = ranked.filter("q is not null").groupBy("source", "bucket").agg(F.sum("size").alias("here"), F.first("wanted").alias("wanted"))
    upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = sums.withColumn("upto", F.sum("here").over(upto)).withColumn("ahead", F.col("upto") - F.col("here"))
    sums = sums.select(F.col("source").alias("s__"), F.col("bucket").alias("b__"), "upto", "ahead")
    placed = ranked.join(sums, ranked["source"].eqNullSafe(F.col("s__")) & (ranked["bucket"] == F.col("b__")), "left").drop("s__", "b__")
    ends = F.coalesce((F.col("ahead") <= F.col("wanted")) & (F.col("upto") > F.col("wanted")), F.lit(False))
    rest = placed.filter(~ends).withColumn("chosen", F.coalesce(F.col("upto") <= F.col("wanted"), F.lit(False)))
    order = Window.partitionBy("source").orderBy("q", F.col("doc_id").asc_nulls_last(), "row").rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.col("ahead") + F.coalesce(F.sum("size").over(order), F.lit(0))
    last = placed.filter(ends).withColumn("chosen", ahead + F.col("size") <= F.col("wanted"))
    return rest.unionByName(last).drop("bucket", "upto", "ahead")


def largest() -> Column:
    """For a minimum: the largest document, then the first by rank."""
    return F.struct((-F.col("size")).alias("less"), F.col("q"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("row"))


def fill_up(rest: DataFrame, buckets: int) -> DataFrame | None:
    """``r__``, the rows of ``rest`` (as for :func:`in_order`, all of a size within ``wanted``) taken until none fits; None if there are none."""
    taken = []
    while not rest.isEmpty():
        placed = settle(in_order(rest, buckets), "more_places")
        gaps = placed.groupBy("source").agg((F.first("wanted") - F.sum(F.when(F.col("chosen"), F.col("size")).otherwise(0))).alias("gap"))
        gaps = gaps.withColumnRenamed("source", "s__")
        left = placed.filter("not chosen").join(gaps, F.col("source").eqNullSafe(F.col("s__"))).filter("size <= gap").drop("s__")
        left = settle(left, "more_left")
        found = settle(left.groupBy(F.col("source").alias("s__")).agg(F.min(largest()).alias("x")), "more_largest")
        taken += [placed.filter("chosen").select(F.col("row").alias("r__")), found.select(F.col("x.row").alias("r__"))]
        after = left.join(found, F.col("source").eqNullSafe(F.col("s__"))).filter(F.col("row") != F.col("x.row"))
        after = after.withColumn("wanted", F.col("gap") + F.col("x.less")).filter("size <= wanted")
        rest = settle(after.select(*rest.columns), "more_rest")
    return reduce(DataFrame.unionByName, taken) if taken else None


def pareto_sample(rows: DataFrame, buckets: int = 4096, fillers: int = 3, fill: bool = True) -> DataFrame:
    """``rows`` with a boolean ``chosen``: by Pareto rank what fits into ``wanted``, until no row fits; without ``fill``, until the fillers are used.

    ``rows`` has row, doc_id, source (the stratum), size, u, probability and wanted (words of the stratum's sample).
    Probabilities may differ within a stratum; a row with probability 0 is not chosen.
    """
    odds = lambda p: p / (F.lit(1.0) - p)
    ranked = rows.withColumn("q", F.when(F.col("probability") > 0, odds(F.col("u")) / odds(F.col("probability"))))
    first = settle(in_order(ranked, buckets), "first_places")

    # a row for each source: words taken so far and the rows that filled its gap
    state = first.groupBy("source").agg(F.first("wanted").alias("goal"), F.sum(F.when(F.col("chosen"), F.col("size")).otherwise(0)).alias("words"))
    state = settle(state.select(F.col("source").alias("s__"), "goal", "words", F.array().cast("array<bigint>").alias("fillers")), "gaps")
    same = F.col("source").eqNullSafe(F.col("s__"))
    open_ = first.filter("not chosen and q is not null and size > 0")
    fitting = lambda state: open_.join(state, same).filter((F.col("size") <= F.col("goal") - F.col("words")) & ~F.array_contains("fillers", F.col("row")))
    for _ in range(fillers):
        found = fitting(state).groupBy("source").agg(F.min(largest()).alias("x"))
        grown = state.join(found, same, "left").select(
            "s__",
            "goal",
            (F.col("words") - F.coalesce("x.less", F.lit(0))).alias("words"),
            F.when(F.col("x").isNull(), F.col("fillers")).otherwise(F.array_append("fillers", F.col("x.row"))).alias("fillers"),
        )
        state = settle(grown, "gaps")
    filler = state.select("s__", F.explode("fillers").alias("r__"))
    filled = first.join(filler, same & (F.col("row") == F.col("r__")), "left")
    filled = filled.withColumn("chosen", F.col("chosen") | F.col("r__").isNotNull()).drop("s__", "r__")
    rest = fitting(state).select("row", "doc_id", "source", "size", "q", (F.col("goal") - F.col("words")).alias("wanted"))
    more = fill_up(settle(rest, "more_rest"), buckets) if fill else None
    if more is not None:
        filled = filled.join(more, F.col("row") == F.col("r__"), "left")
        filled = filled.withColumn("chosen", F.col("chosen") | F.col("r__").isNotNull()).drop("r__")
    return filled.drop("q")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, most: float = MOST, seed: int = 7, buckets: int = 4096, fill: bool = True, most_broadcast: int = 100_000) -> DataFrame:
    """doc_id, size, source_size, target, taken and copies for each row of ``docs``; taken is copies times size.

    ``most_broadcast``: most sources whose targets are broadcast; more are joined by a shuffle.
    """
    sizes = settle(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).alias("source"),
            F.regexp_count(text_of(text_col), F.lit(WORDS)).cast("long").alias("size"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "sizes",
    )
    goals = settle(targets(sizes, weights, most).withColumnRenamed("source", "s__"), "targets")
    few = goals.count() <= most_broadcast
    rows = sizes.join(F.broadcast(goals) if few else goals, sizes["source"].eqNullSafe(goals["s__"])).drop("s__")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = rows.withColumn("whole", F.floor(ratio)).withColumn("probability", ratio - F.col("whole"))
    rows = rows.withColumn("wanted", F.col("target") - F.col("whole") * F.col("source_size")).withColumn("u", uniform("doc_id", seed))
    out = pareto_sample(rows, buckets, fill=fill)
    copies = F.col("whole") + F.col("chosen").cast("long")
    return out.select("doc_id", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"), "row")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it; all columns stay. Rows of size 0 are kept once.

    Decisions are joined back by id, at every size by a merge join. Rows that repeat an id are matched by their size; of
    rows equal in both, each is taken as often as the one that is taken most.
    """
    id_, size, copies, words, copy = (fresh(docs, n) for n in ("id_", "size", "copies", "words", "copy"))
    plan = mix(docs, id_col, text_col, source_col, **options)
    plan = plan.withColumn("copies", F.when(F.col("size") == 0, F.lit(1)).otherwise(F.col("copies"))).filter("copies > 0")
    plan = settle(plan.groupBy("doc_id", "size").agg(F.max("copies").alias("copies")).select(F.col("doc_id").alias(id_), F.col("size").alias(size), F.col("copies").alias(copies)), "copies")
    sized = docs.withColumn(words, F.regexp_count(text_of(text_col), F.lit(WORDS)).cast("long"))
    joined = sized.join(plan.hint("merge"), F.col(id_col).eqNullSafe(F.col(id_)) & (F.col(words) == F.col(size)))
    return joined.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*docs.columns)
