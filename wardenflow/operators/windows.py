"""Windowed operators (W1-W14): sliding counts, first triggers, sequences, caps, rotation.

Windows are partitioned by an actor, a file or a family. Where one actor may hold a large share of all rows, the
sliding counts come in a bucketed form: rows are dealt by actor and time bucket, and each bucket borrows the window's
length from the one before, so one hot actor is spread over many tasks. Rotation, look-back, next bounds and running
distinct counts number the rows of a group over range partitions first, so they too spread one hot group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardenflow.operators.scans import dealt, numbered_within, running_sum, segments


def sliding_count(df: DataFrame, actor: str, at: str, reach: int, out: str = "n_in_window") -> DataFrame:  # W1, W2
    """Rows of the same actor whose ``at`` lies in [at - reach, at], and the oldest of them.

    ``at`` is a whole number: milliseconds, or the row's index for the line-proxy form. Rows with a null ``at`` get no count.
    """
    return _slid(df, [actor], at, reach, out)


def _slid(df: DataFrame, by: list[str], at: str, reach: int, out: str) -> DataFrame:
    """``df`` with the two columns of :func:`sliding_count`, from frames that only grow.

    Spark goes over a frame with two moving ends again for every row, so that dense windows would cost the square of their
    rows. The count is what stands up to the row less what stands before its window; the oldest is a minimum from the end.
    """
    up, down = Window.partitionBy(*by).orderBy(F.col(at)), Window.partitionBy(*by).orderBy(F.col(at).desc())
    whole = F.count(at).over(up.rangeBetween(Window.unboundedPreceding, 0))
    before = F.count(at).over(up.rangeBetween(Window.unboundedPreceding, -reach - 1))
    oldest = F.min(at).over(down.rangeBetween(Window.unboundedPreceding, reach))
    known = F.col(at).isNotNull()
    return df.withColumns({out: F.when(known, whole - before), f"{out}_from": F.when(known, oldest)})


def sliding_count_dealt(df: DataFrame, actor: str, at: str, reach: int, out: str = "n_in_window", width: int | None = None) -> DataFrame:
    """As :func:`sliding_count`, dealt by actor and time bucket of ``width`` (10 times ``reach`` by default)."""
    width = width or 10 * reach
    if width < reach:
        raise ValueError("a bucket must be as wide as the window")
    bucket = F.floor(F.col(at) / F.lit(width))
    lends = F.floor((F.col(at) + F.lit(reach)) / F.lit(width)) > bucket
    spots = F.when(lends, F.array(F.struct(bucket.alias("b"), F.lit(False).alias("lent")), F.struct((bucket + 1).alias("b"), F.lit(True).alias("lent")))).otherwise(F.array(F.struct(bucket.alias("b"), F.lit(False).alias("lent"))))
    dealt = df.withColumn("spot__", F.explode(spots)).withColumns({"bucket__": F.col("spot__.b"), "lent__": F.col("spot__.lent")}).drop("spot__")
    counted = _slid(dealt, [actor, "bucket__"], at, reach, out)
    return counted.filter("not lent__").drop("bucket__", "lent__")


def first_trigger(df: DataFrame, actor: str, order: list[str], condition: Column) -> DataFrame:  # W3
    """The first row of each actor that meets ``condition``, by partial aggregation rather than a sort."""
    rest = [c for c in df.columns if c != actor]
    best = df.filter(condition).groupBy(actor).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("first__"))
    return best.select(actor, *[F.col(f"first__.{c}").alias(c) for c in rest])


def followed_by(triggers: DataFrame, events: DataFrame, actor: str, at: str, condition: Column, inclusive: bool = False, out: str = "followed_at") -> DataFrame:  # W8
    """Each trigger with the first later event of its actor that meets ``condition``; triggers without one go."""
    t = triggers.select(actor, F.col(at).alias("trigger__"))
    later = F.col(at) >= F.col("trigger__") if inclusive else F.col(at) > F.col("trigger__")
    hits = events.filter(condition).join(t, actor).filter(later).groupBy(actor).agg(F.min(at).alias(out))
    return triggers.join(hits, actor)


def line_budget(df: DataFrame, order: list, most: int) -> DataFrame:  # S6
    """The first ``most`` rows of a run, found with a top-k rather than a global sort of everything."""
    return df.orderBy(*order).limit(most)


def capped(df: DataFrame, group: list[str], order: list, most: int) -> DataFrame:  # W7
    """The first ``most`` rows of each group; Spark trims each partition to ``most`` before it shuffles."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("turn__", F.row_number().over(w)).filter(F.col("turn__") <= most).drop("turn__")


def overflow(df: DataFrame, group: list[str], most: int) -> DataFrame:  # W7
    """kept and left_out of each group under a cap, from counts alone."""
    return df.groupBy(*group).count().select(*group, F.least("count", F.lit(most)).alias("kept"), F.greatest(F.col("count") - most, F.lit(0)).alias("left_out"))


def round_robin(df: DataFrame, group: str, order: list, turn: str = "turn") -> DataFrame:  # W6
    """Each group's rows numbered in order; sorting by ``turn`` then visits groups breadth first."""
    return numbered_within(df, [group], order, turn).withColumn(turn, F.col(turn).cast("int"))


def numbered(df: DataFrame, order: list[str], out: str = "position", buckets: int = 64) -> DataFrame:
    """Rows numbered from 1 in the order of unique ``order`` columns, without one task that sorts them all.

    Rows are range-partitioned and sorted; a partition's first number is what the partitions before it hold.
    """
    from wardenflow.storage import cut

    placed = df.repartitionByRange(buckets, *order).sortWithinPartitions(*order).withColumn("place__", F.monotonically_increasing_id())
    placed = cut(placed, "numbered")
    part = F.shiftright("place__", 33)
    sizes = placed.groupBy(part.alias("part__")).agg(F.count(F.lit(1)).alias("n__"))
    starts = sizes.withColumn("start__", F.coalesce(F.sum("n__").over(Window.orderBy("part__").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n__")
    placed = placed.withColumn("part__", part).join(F.broadcast(starts), "part__")  # a row for each partition
    return placed.withColumn(out, F.col("start__") + F.col("place__").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("place__", "part__", "start__")


def running_total(df: DataFrame, order: str, value: str, out: str, buckets: int = 64) -> DataFrame:
    """Sum of ``value`` up to each row in the order of the unique ``order``, by range partitions and their totals."""
    from wardenflow.storage import cut

    placed = cut(df.repartitionByRange(buckets, order).withColumn("part__", F.spark_partition_id()), "ranged")
    totals = placed.groupBy("part__").agg(F.sum(value).alias("n__"))
    starts = totals.withColumn("start__", F.coalesce(F.sum("n__").over(Window.orderBy("part__").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n__")  # a row for each partition
    upto = Window.partitionBy("part__").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return placed.join(F.broadcast(starts), "part__").withColumn(out, F.col("start__") + F.sum(value).over(upto)).drop("part__", "start__")


def shard(df: DataFrame, order: list[str], shards: int, out: str = "shard") -> DataFrame:  # W9
    """Shard 0 to ``shards`` - 1 of each row over the stable order."""
    return numbered(df, order).withColumn(out, ((F.col("position") - 1) % shards).cast("int")).drop("position")


def batches(df: DataFrame, order: list[str], size: int = 8, out: str = "batch") -> DataFrame:  # W10
    return numbered(df, order).withColumn(out, F.floor((F.col("position") - 1) / size).cast("int")).drop("position")


def look_back(df: DataFrame, group: str, order: str, marker: Column, most: int, out: str) -> DataFrame:  # W11
    """The nearest marker at most ``most`` rows back, the row itself included."""
    rows, by = dealt(df.withColumn(out, marker), [group], [order], back=most)
    w = Window.partitionBy(*by).orderBy("n__").rowsBetween(-most, 0)
    return rows.withColumn(out, F.last(out, ignorenulls=True).over(w)).filter("not lent__").drop("n__", "block__", "lent__")


def rows_before(df: DataFrame, group: str, order: str, value: str, most: int, out: str) -> DataFrame:  # W12
    """Up to ``most`` values that are not null of the ``most`` rows before."""
    rows, by = dealt(df, [group], [order], back=most)
    w = Window.partitionBy(*by).orderBy("n__").rowsBetween(-most, -1)
    return rows.withColumn(out, F.collect_list(value).over(w)).filter("not lent__").drop("n__", "block__", "lent__")


def next_bound(df: DataFrame, group: str, order: str, out: str) -> DataFrame:  # W13
    """``order`` of the group's next row."""
    rows, by = dealt(df, [group], [order], ahead=1)
    return rows.withColumn(out, F.lead(order).over(Window.partitionBy(*by).orderBy("n__"))).filter("not lent__").drop("n__", "block__", "lent__")


def last_write_wins(df: DataFrame, key: str, order: str) -> DataFrame:  # W14
    """The last row of each key in the order of ``order``, by partial aggregation."""
    rest = [c for c in df.columns if c != key]
    last = df.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("last__"))
    return last.select(key, *[F.col(f"last__.{c}").alias(c) for c in rest])


def running_distinct(df: DataFrame, group: str, value: str, order: list[str], out: str) -> DataFrame:  # W5
    """How many different values the group has shown up to each row; rows are told apart by ``order``.

    The first row of each value is an aggregate, so no value is sorted; their sum is carried over the group's segments.
    """
    at = F.struct(*order)
    firsts = df.filter(F.col(value).isNotNull()).groupBy(group, value).agg(F.min(at).alias("at__")).groupBy(group, "at__").agg(F.count(F.lit(1)).alias("fresh__"))
    firsts = firsts.select(F.col(group).alias("group__"), *[F.col(f"at__.{c}").alias(f"o{n}__") for n, c in enumerate(order)], "fresh__")
    on = F.col(group).eqNullSafe(F.col("group__"))
    for n, c in enumerate(order):
        on = on & F.col(c).eqNullSafe(F.col(f"o{n}__"))
    marked = df.join(firsts, on, "left").select(*df.columns, "fresh__")
    return running_sum(segments(marked, [group], order), [group], order, F.coalesce("fresh__", F.lit(0)), out).drop("fresh__", "part__", "tie__n__")
