"""Scans along an order within groups of any size: what a row needs of the rows before it, without one task for a group.

Rows are dealt to range partitions of group and order, so a large group is cut into segments that follow each other. A
scan is taken within each segment; a segment's summary is a row, and the summaries before a segment are carried into
it. Only segments that continue a group have something carried in, one for each partition at most, which is what is broadcast.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from wardenflow.storage import cut

PART, TIE = "part__", "tie__n__"


def parts_for(rows: DataFrame, rows_per_part: int = 1 << 18) -> int:
    """Range partitions for ``rows``: those of a shuffle at least, more where they would hold too many rows."""
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // rows_per_part))


def spread(rows: DataFrame, rows_per_part: int = 1 << 12) -> DataFrame:
    """``rows`` dealt evenly to as many tasks as they need. A small file is read by one task, however much is made of each of its rows."""
    return rows.repartition(max(1, -(-rows.count() // rows_per_part)))


def segments(rows: DataFrame, group: list[str], order: list[str | Column], parts: int | None = None) -> DataFrame:
    """``rows`` as a table with ``part__``, the range partition of (group, order), and ``tie__n__``, which tells equal rows apart.

    ``tie__n__`` comes last in the order, so that rows that are equal in it do not have to share a task.
    """
    marked = rows.withColumn(TIE, F.monotonically_increasing_id())
    return cut(marked.repartitionByRange(parts or parts_for(rows), *group, *order, TIE).withColumn(PART, F.spark_partition_id()), "segments")


def upto(group: list[str], order: list, inclusive: bool = True) -> WindowSpec:
    """The rows of a segment up to the current one."""
    return Window.partitionBy(PART, *group).orderBy(*order, TIE).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)


def carried(placed: DataFrame, group: list[str], total: Column, before: Callable[[str, WindowSpec], Column], out: str) -> DataFrame:
    """``placed`` with ``out``: what ``before`` makes of the totals of the group's earlier segments, NULL in its first."""
    sums = placed.groupBy(PART, *group).agg(total.alias("total__"))
    earlier = Window.partitionBy(*group).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    brought = sums.withColumn(out, before("total__", earlier)).filter(F.col(out).isNotNull()).select(F.col(PART).alias("p__"), *[F.col(c).alias(f"g{n}__") for n, c in enumerate(group)], out)
    on = F.col(PART) == F.col("p__")
    for n, c in enumerate(group):
        on = on & F.col(c).eqNullSafe(F.col(f"g{n}__"))
    return placed.join(F.broadcast(brought), on, "left").drop("p__", *[f"g{n}__" for n in range(len(group))])  # a row for each segment that continues a group


def running_sum(placed: DataFrame, group: list[str], order: list, value: Column, out: str) -> DataFrame:
    """Sum of ``value`` over the group's rows up to each row of a table that :func:`segments` made."""
    marked = placed.withColumn("value__", value)
    with_base = carried(marked, group, F.sum("value__"), lambda c, w: F.sum(c).over(w), "base__")
    return with_base.withColumn(out, F.coalesce("base__", F.lit(0)) + F.coalesce(F.sum("value__").over(upto(group, order)), F.lit(0))).drop("value__", "base__")


def last_known(placed: DataFrame, group: list[str], order: list, value: str, out: str) -> DataFrame:
    """The last ``value`` of the group that is not null, up to each row of a table that :func:`segments` made."""
    at = F.struct(*[F.col(c) for c in order], F.col(TIE))
    known = F.max_by(F.col(value), F.when(F.col(value).isNotNull(), at))
    with_base = carried(placed, group, known, lambda c, w: F.last(c, ignorenulls=True).over(w), "base__")
    return with_base.withColumn(out, F.coalesce(F.last(value, ignorenulls=True).over(upto(group, order)), F.col("base__"))).drop("base__")


def numbered_within(rows: DataFrame, group: list[str], order: list, out: str, parts: int | None = None) -> DataFrame:
    """``rows`` with their number from 1 in their group."""
    placed = segments(rows, group, order, parts)
    base = carried(placed, group, F.count(F.lit(1)), lambda c, w: F.sum(c).over(w), "base__")
    here = F.row_number().over(Window.partitionBy(PART, *group).orderBy(*order, TIE))
    return base.withColumn(out, (F.coalesce("base__", F.lit(0)) + here).cast("long")).drop("base__", PART, TIE)


def dealt(rows: DataFrame, group: list[str], order: list, back: int = 0, ahead: int = 0, width: int | None = None, parts: int | None = None) -> tuple[DataFrame, list[str]]:
    """``rows`` dealt to blocks of ``width`` consecutive rows of a group, each with ``back`` rows of the block before and ``ahead`` of the one after.

    Gives the rows, with ``lent__`` true for those that a block only borrows, and the columns to partition by. A window
    that reaches ``back`` rows back or ``ahead`` rows on is then right on all rows that are not lent.
    """
    width = max(width or 1 << 16, back, ahead, 1)
    placed = numbered_within(rows, group, order, "n__", parts)
    block, at = F.floor((F.col("n__") - 1) / width).cast("long"), (F.col("n__") - 1) % width
    spots = F.filter(F.array(block, F.when(at >= width - back, block + 1) if back else F.lit(None).cast("long"), F.when((at < ahead) & (block > 0), block - 1) if ahead else F.lit(None).cast("long")), lambda x: x.isNotNull())
    out = placed.withColumn("block__", F.explode(spots)).withColumn("lent__", F.col("block__") != block)
    return out, [*group, "block__"]
