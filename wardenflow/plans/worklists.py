"""Worklists and their folds beyond verdicts (L4, L5, L7, L8): regions, units, guards, narratives, remediation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardenflow.functions import scalar as X
from wardenflow.operators import findings as N
from wardenflow.operators import fold as D
from wardenflow.operators import positional as P


def region_worklist(surface: DataFrame, edges: DataFrame, leads: DataFrame, files_each: int = 8, near_each: int = 12) -> DataFrame:  # L5, W7, J19
    """region, files (the highest scored), neighbours (files one edge away in other regions) and leads of each region.

    surface: region, file, score; edges: from, to; leads: at (a path or the beginning of one), claim.
    """
    best = Window.partitionBy("region").orderBy(F.col("score").desc(), "file")
    top = surface.withColumn("k", F.row_number().over(best)).filter(F.col("k") <= files_each)
    files = top.groupBy("region").agg(F.array_sort(F.collect_list(F.struct("k", "file"))).alias("f")).select("region", F.col("f.file").alias("files"))
    both = edges.select(F.col("from").alias("a"), F.col("to").alias("b")).unionByName(edges.select(F.col("to").alias("a"), F.col("from").alias("b"))).distinct()
    mine = surface.select(F.col("file").alias("a"), "region")
    other = surface.select(F.col("file").alias("b"), F.col("region").alias("other"))
    near = both.join(mine, "a").join(other, "b").filter("region <> other").groupBy("region", "b").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("region").orderBy(F.col("n").desc(), "b")
    near = near.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= near_each).groupBy("region").agg(F.array_sort(F.collect_list("b")).alias("neighbours"))
    places = leads.select(F.regexp_replace("at", ":\\d+$", "").alias("p"), "claim")
    # a file is looked up by its own beginnings, of the lengths that leads have: no more than a path has characters
    lengths = [r[0] for r in places.select(F.char_length("p").alias("n")).filter("n > 0").distinct().collect()]
    starts = F.transform(F.filter(F.array(*map(F.lit, lengths)).cast("array<int>"), lambda n: n <= F.char_length("file")), lambda n: F.substring(F.col("file"), F.lit(1), n))
    # files that begin alike meet a lead once for their region, not once each
    heads = surface.select("region", F.explode(starts).alias("p")).distinct()
    hit = heads.join(places, "p").groupBy("region").agg(F.array_sort(F.collect_set("claim")).alias("leads"))
    return files.join(near, "region", "left").join(hit, "region", "left").orderBy("region")


def assumption_units(symbols: DataFrame, hits: DataFrame, most: int = 120, each: int = 12) -> DataFrame:  # L7, T8
    """The symbols with most inputs and dangerous calls inside, ``each`` in a file and ``most`` in all.

    symbols: file, name, line, end; hits: file, line, role.
    """
    spans = symbols.filter("end is not null").select("file", "name", "line", "end")
    inside = P.in_range(spans, hits.select("file", F.col("line").alias("at"), "role"), "file", "line", "end", "at")
    counted = inside.groupBy("file", "name", "line").agg(F.count_if(F.col("role") == "entry").alias("inputs"), F.count_if(F.col("role") == "sink").alias("sinks")).withColumn("weight", F.col("inputs") + F.col("sinks"))
    turn = F.row_number().over(Window.partitionBy("file").orderBy(F.col("weight").desc(), "line"))
    return counted.withColumn("k", turn).filter(F.col("k") <= each).orderBy(F.col("weight").desc(), "file", "line").limit(most).drop("k")


def guard_findings(matrix: DataFrame) -> DataFrame:  # L4
    """Unguarded handlers as findings of missing authentication."""
    rows = matrix.filter("not guarded")
    return N.conform(rows.select(F.lit("unguarded-handler").alias("ident"), F.lit("Handler without an authentication check").alias("title"), F.lit("authz").alias("category"), F.lit("engine").alias("tool"), F.lit("high").alias("severity"), F.lit("low").alias("confidence"), "file", "line", F.lit("authz").alias("kind"), F.lit("CWE-306").alias("cwe"), F.concat(F.lit("handler "), F.coalesce("handler", F.lit("(module scope)"))).alias("message")))


def narrative(entries: DataFrame, findings: DataFrame) -> DataFrame:  # L8, J18
    return D.grounded(entries, findings).orderBy("entry")


def remediation(findings: DataFrame) -> DataFrame:  # L8, A17
    """Root causes of confirmed findings, the most severe and largest first, with where to look."""
    causes = N.root_causes(findings)
    confirmed = findings.filter("status = 'confirmed'")
    worst = confirmed.groupBy("category", F.coalesce("cwe", F.lit("")).alias("cwe")).agg(F.min(X.severity_rank(F.col("severity"))).alias("rank"), F.array_sort(F.collect_set("file")).alias("files"))
    return causes.join(worst, ["category", "cwe"]).orderBy("rank", F.col("members").desc(), "category", "cwe").withColumn("severity", X.severity_of_rank(F.col("rank"))).drop("rank")
