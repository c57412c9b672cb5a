"""Joins by position: as-of, innermost interval, range, longest prefix, last matching rule.

Each has an equality key or a broadcast side whose size is checked. As-of and innermost sort both sides once, in range
partitions of key and position, so that a key may hold any share of the rows, and never form pairs. ``last_rule`` looks
rules up by their literal prefix.
"""

from __future__ import annotations

import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardenflow.operators.scans import PART, TIE, last_known, parts_for, segments
from wardenflow.storage import cut


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, values: list[str], tie: str | None = None) -> DataFrame:  # J6, J4b
    """``left`` with ``values`` of the latest row of ``right`` of its key at or before ``at``; NULL where there is none.

    Both sides are stacked, sorted once by key and position in range partitions, and the last right row is carried
    forward, over partitions too: work grows with the rows, not with the pairs that a join would make, and a key may
    hold any share of them. ``tie``: of right rows at one place the largest wins. Rows of ``left`` without key or place go.
    """
    order_tie = F.col(tie) if tie else F.lit(0)
    a = left.select(F.struct(*left.columns).alias("l__"), F.col(key).alias("k__"), F.col(at).alias("t__"), F.lit(1).alias("side__"), F.lit(None).cast("long").alias("tie__"))
    a = a.withColumn("r__", F.lit(None).cast(right.select(F.struct(*values).alias("v")).schema["v"].dataType))
    b = right.select(F.lit(None).cast(a.schema["l__"].dataType).alias("l__"), F.col(key).alias("k__"), F.col(at).alias("t__"), F.lit(0).alias("side__"), order_tie.cast("long").alias("tie__"), F.struct(*values).alias("r__"))
    stacked = a.unionByName(b).filter("k__ is not null and t__ is not null")
    order = ["t__", "side__", "tie__"]
    swept = last_known(segments(stacked, ["k__"], order), ["k__"], order, "r__", "found__").filter("side__ = 1")
    return swept.select("l__.*", *[F.col(f"found__.{v}").alias(v) for v in values])


OPEN = (1 << 63) - 1  # the end of a span without one


def _sweep(key: list, at: list, is_point: list, end: list, name: list, carry: list[tuple[int, object]]) -> tuple[list, list]:
    """Names around the points of rows in order of key and position, and the spans that are open after the last row.

    Open spans are kept with ends that fall towards the latest start: an earlier span that ends no later can never be
    innermost again, so it is dropped when the later one opens. ``carry``: open spans of the first key, outermost first.
    """
    out, open_, now = [], list(carry), key[0] if key else None
    for k, t, point, z, n in zip(key, at, is_point, end, name, strict=True):
        if k != now:
            open_, now = [], k
        if point:
            while open_ and open_[-1][0] < t:
                open_.pop()
            out.append(open_[-1][1] if open_ else None)
        else:
            while open_ and open_[-1][0] <= z:
                open_.pop()
            open_.append((z, n))
    return out, open_


def innermost(points: DataFrame, spans: DataFrame, key: str, at: str, start: str, end: str, name: str, out: str = "enclosing") -> DataFrame:  # J4, J5
    """``points`` with the name of the innermost span [start, end] of their key that holds them; an open end has no bound.

    Of the spans that hold a point the latest start wins, then the earliest end, then the largest name. Positions are
    whole numbers. Points and spans are stacked in range partitions of key and position, and each partition is swept once
    with the open spans at hand; a partition that continues a key first gets the spans that earlier ones left open.
    Those are told by one sweep more: as many for each partition as spans nest there.
    """
    kind = {"l": points.select(F.struct(*points.columns).alias("l")).schema["l"].dataType, "n": spans.schema[name].dataType}
    last = F.coalesce(F.col(end).cast("long"), F.lit(OPEN))
    a = points.select(F.struct(*points.columns).alias("l__"), F.col(key).alias("k__"), F.col(at).cast("long").alias("t__"), F.lit(True).alias("point__"), F.lit(0).cast("long").alias("fall__"), F.lit(None).cast(kind["n"]).alias("n__"))
    b = spans.select(F.lit(None).cast(kind["l"]).alias("l__"), F.col(key).alias("k__"), F.col(start).cast("long").alias("t__"), F.lit(False).alias("point__"), (-last).alias("fall__"), F.col(name).alias("n__"))
    stacked = a.unionByName(b.filter(-F.col("fall__") >= F.col("t__"))).filter("k__ is not null and t__ is not null")
    order = ["t__", "point__", "fall__", "n__"]
    placed = segments(stacked, ["k__"], order, parts_for(stacked))
    sorts = [("k__", "ascending"), ("t__", "ascending"), ("point__", "ascending"), ("fall__", "ascending"), ("n__", "ascending"), (TIE, "ascending")]

    def lists(table: pa.Table) -> tuple[list, ...]:
        ends = [-x for x in table["fall__"].to_pylist()]
        return table["k__"].to_pylist(), table["t__"].to_pylist(), table["point__"].to_pylist(), ends, table["n__"].to_pylist()

    def left_open(table: pa.Table) -> pa.Table:
        table = table.sort_by(sorts)
        _, still = _sweep(*lists(table), [])
        at = table["t__"][-1].as_py()
        still = [x for x in still if x[0] >= at]
        return pa.Table.from_arrays([pa.array([table[PART][0].as_py()] * len(still), pa.int32()), pa.array([table["k__"][-1].as_py()] * len(still), table["k__"].type), pa.array(range(len(still)), pa.int32()), pa.array([x[0] for x in still], pa.int64()), pa.array([x[1] for x in still], table["n__"].type)], names=["from__", "key__", "level__", "z__", "name__"])

    key_type = stacked.schema["k__"].dataType.simpleString()
    swept = ["k__", "t__", "point__", "fall__", "n__", TIE, PART]
    bounds = placed.groupBy(PART).agg(F.min("k__").alias("first__"), F.max("k__").alias("last__"), F.min_by("t__", F.struct("k__", "t__")).alias("begin__"))
    bounds = cut(bounds, "bounds")  # a row for each partition
    # spans are left open to later partitions only where the last key of one is the first of another
    cut_keys = bounds.select(F.col(PART).alias("p__"), F.col("first__").alias("key__"), "begin__")
    ending = bounds.alias("x").join(F.broadcast(bounds.select(F.col(PART).alias("q__"), F.col("first__").alias("next__"))), (F.col("last__") == F.col("next__")) & (F.col("q__") > F.col(PART)), "left_semi").select(PART)
    tails = placed.select(*swept).join(F.broadcast(ending), PART, "left_semi").groupBy(PART).applyInArrow(left_open, f"from__ int, key__ {key_type}, level__ int, z__ long, name__ {kind['n'].simpleString()}")
    brought = tails.join(F.broadcast(cut_keys), "key__").filter("p__ > from__ and z__ >= begin__")
    brought = brought.select(F.lit(None).cast(kind["l"]).alias("l__"), F.col("key__").alias("k__"), F.lit(None).cast("long").alias("t__"), F.lit(False).alias("point__"), (-F.col("z__")).alias("fall__"), F.col("name__").alias("n__"), (F.col("from__").cast("long") * F.lit(1 << 31) + F.col("level__")).alias(TIE), F.col("p__").cast("int").alias(PART))

    def sweep(table: pa.Table) -> pa.Table:
        # what was brought along comes first, in the order in which it was opened
        old = table.filter(pc.is_null(table["t__"])).sort_by(TIE)
        own = table.filter(pc.is_valid(table["t__"])).sort_by(sorts)
        carry: list[tuple[int, object]] = []
        for z, n in zip(old["fall__"].to_pylist(), old["n__"].to_pylist(), strict=True):
            while carry and carry[-1][0] <= -z:
                carry.pop()
            carry.append((-z, n))
        names, _ = _sweep(*lists(own), carry)
        points = own.filter(own["point__"])
        return pa.Table.from_arrays([points["l__"].combine_chunks(), pa.array(names, own["n__"].type)], names=["l__", out])

    result = placed.select("l__", *swept).unionByName(brought).groupBy(PART).applyInArrow(sweep, f"l__ {kind['l'].simpleString()}, {out} {kind['n'].simpleString()}")
    lost = points.filter(F.col(key).isNull() | F.col(at).isNull()).withColumn(out, F.lit(None).cast(kind["n"]))
    return result.select("l__.*", out).unionByName(lost)


def in_range(left: DataFrame, right: DataFrame, key: str, start: str, end: str, at: str, width: int = 64) -> DataFrame:  # J7
    """Pairs of a span of ``left`` and a row of ``right`` of its key inside it, joined by key and position bucket.

    ``right``'s columns but the key are taken over. Spans are cut into buckets of ``width`` positions, so a large key
    is spread over tasks.
    """
    buckets = F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))
    a = left.filter(F.col(start) <= F.col(end)).withColumn("b__", F.explode(buckets))
    b = right.withColumn("b__", F.floor(F.col(at) / width))
    return a.join(b, [key, "b__"]).filter(F.col(at).between(F.col(start), F.col(end))).drop("b__")


def lines_around(steps: DataFrame, lines: DataFrame, before: int, after: int = 0) -> DataFrame:  # J23, K11
    """The source lines around each step (file, line), as an equality join on exploded line numbers."""
    near = steps.withColumn("near_line", F.explode(F.sequence(F.col("line") - before, F.col("line") + after)))
    return near.join(lines.withColumnRenamed("line", "near_line"), ["file", "near_line"])


def small(df: DataFrame, most_rows: int = 100_000) -> DataFrame:
    """``df`` marked for broadcast if it has ``most_rows`` rows or fewer, else as it is."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` marked to be joined by a shuffle. Spark guesses sizes from compressed files, and may broadcast a side that is far too large for it."""
    return df.hint("merge")


def literal_prefix(pattern: str) -> str:
    """The text with which every match of an anchored glob begins, up to the last slash before a wildcard; '' if there is none."""
    fixed = re.split(r"[*?\[{\\]", pattern.lstrip("/"), maxsplit=1)[0]
    if not pattern.startswith("/") and "/" not in pattern.rstrip("/"):
        return ""
    return fixed if fixed == pattern.lstrip("/") else fixed[: fixed.rfind("/") + 1]


def last_rule(rows: DataFrame, rules: DataFrame, value: str, order: str, picked: str, matches: Column, prefix: str | None = None) -> DataFrame:  # J12, J19
    """``rows`` with ``picked`` of the last rule that matches ``value``. Distinct values are matched, not rows.

    ``prefix``: a column of ``rules`` with the path that every match begins with, ended by a slash or whole; '' where there is
    none. A value then meets the rules of its own prefixes by equality, and only rules without one are compared with all
    values. Without ``prefix`` rules are broadcast if they are few, else compared pair by pair.
    """
    values = rows.select(value).distinct()
    if prefix is None:
        met = values.join(small(rules, 10_000), matches)
    else:
        parts = F.split(F.col(value), "/")
        own = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
        heads = F.concat(own, F.transform(own, lambda x: F.concat(x, F.lit("/"))))
        indexed = values.withColumn("head__", F.explode(F.array_distinct(heads))).join(rules.filter(F.col(prefix) != ""), F.col("head__") == F.col(prefix)).filter(matches).drop("head__")
        met = indexed.unionByName(values.join(small(rules.filter(F.col(prefix) == ""), 10_000), matches))
    best = met.groupBy(value).agg(F.max_by(picked, order).alias(picked))
    return rows.join(best, value, "left")


def first_rule(rows: DataFrame, rules: list[tuple[str, Column]], out: str) -> DataFrame:  # F1, F17
    """``rows`` with the name of the first rule that holds. Rules are few, so they fold into one expression."""
    chosen = None
    for name, condition in rules:
        chosen = F.when(condition, F.lit(name)) if chosen is None else chosen.when(condition, F.lit(name))
    return rows.withColumn(out, chosen)


def longest_prefix(rows: DataFrame, path: str, folders: DataFrame, folder: str, out: str = "region") -> DataFrame:  # J15
    """``rows`` with the longest folder that holds ``path``, else its first segment ('.' at the top).

    A path's own prefixes are looked up by equality, so no prefix is compared with every folder.
    """
    parts = F.split(F.col("p__"), "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    each = rows.select(F.col(path).alias("p__")).distinct().withColumn("f__", F.explode(prefixes)).filter(F.instr("p__", "/") > 0)
    best = each.join(folders.select(F.col(folder).alias("f__")).distinct(), "f__").groupBy("p__").agg(F.max_by("f__", F.char_length("f__")).alias("best__"))
    top = F.when(F.instr(path, "/") > 0, F.substring_index(path, "/", 1)).otherwise(F.lit("."))
    return rows.join(best, F.col(path) == F.col("p__"), "left").withColumn(out, F.coalesce("best__", top)).drop("p__", "best__")
