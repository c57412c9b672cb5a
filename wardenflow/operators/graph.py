"""Graph operators (J1-J3, G1-G5): edges, closures, neighbourhoods, components, bounded path search.

Walks are loops over frontiers. Each round is an equality join with the edges, loses what has been visited by an anti
join, and is cut to a table in the shared folder, so that lineage stays short and a lost executor costs one round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardenflow.operators.positional import as_of
from wardenflow.storage import cut, discard


def call_edges(calls: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:  # J2
    """Edges from a calling file to the only other file of its language that exports the callee.

    calls: file, callee, line; symbols: file, name, exported; files: file, lang.
    """
    unique = symbols.filter("exported").groupBy("name").agg(F.count_distinct("file").alias("n"), F.min("file").alias("to")).filter("n = 1").select("name", "to")
    langs = files.select(F.col("file").alias("f__"), F.col("lang").alias("l__"))
    hit = calls.join(unique, calls["callee"] == unique["name"]).filter("file <> to").join(files, "file").join(langs, F.col("to") == F.col("f__")).filter("lang = l__")
    return hit.groupBy(F.col("file").alias("from"), "to", F.lit("call").alias("kind"), F.col("callee").alias("to_symbol")).agg(F.count(F.lit(1)).alias("weight"))


def import_edges(imports: DataFrame, files: DataFrame, endings: tuple[str, ...] = ("", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".py", "/index.ts", "/index.js", "/__init__.py")) -> DataFrame:  # J1
    """Edges from an importing file to the first candidate path that exists; imports: file, spec (relative specs)."""
    folder = F.when(F.instr("file", "/") > 0, F.regexp_replace("file", "/[^/]*$", "")).otherwise(F.lit(""))
    joined = F.concat(folder, F.lit("/"), F.col("spec"))
    parts = F.filter(F.split(joined, "/"), lambda x: (x != "") & (x != "."))
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, x: F.when(x == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, x)))
    base = F.when(F.col("spec").startswith("."), F.array_join(kept, "/")).otherwise(F.replace(F.col("spec"), F.lit("."), F.lit("/")))
    tried = imports.select("file", "spec", F.posexplode(F.transform(F.array(*[F.lit(e) for e in endings]), lambda e: F.concat(base, e))).alias("priority", "to"))
    found = tried.join(files.select(F.col("file").alias("to")), "to").groupBy("file", "spec").agg(F.min_by("to", "priority").alias("to")).filter("file <> to")
    return found.groupBy(F.col("file").alias("from"), "to", F.lit("import").alias("kind"), F.lit(None).cast("string").alias("to_symbol")).agg(F.count(F.lit(1)).alias("weight"))


def callers(calls: DataFrame) -> DataFrame:  # J3
    """callee with its sorted call sites; for lookups of single names, not for joins."""
    return calls.groupBy("callee").agg(F.array_sort(F.collect_list(F.struct("file", "line", "symbol"))).alias("sites"))


def merge_edges(a: DataFrame, b: DataFrame, keys: list[str], weight: str = "weight") -> DataFrame:  # G5
    """Union of two edge tables; of an edge in both the larger weight stays."""
    return a.select(*keys, weight).unionByName(b.select(*keys, weight)).groupBy(*keys).agg(F.max(weight).alias(weight))


def reachable(edges: DataFrame, seeds: DataFrame, depth: int, source: str = "src", target: str = "dst", node: str = "node") -> DataFrame:  # G2
    """``node, depth`` of everything that the seeds reach in at most ``depth`` steps, seeds included, least depth each."""
    step = edges.select(F.col(source).alias("s__"), F.col(target).alias("t__")).distinct()
    seen = cut(seeds.select(F.col(node)).distinct().withColumn("depth", F.lit(0)), "reached")
    frontier = seen
    for d in range(1, depth + 1):
        found = frontier.join(step, F.col(node) == F.col("s__")).select(F.col("t__").alias(node)).distinct().join(seen, node, "left_anti").withColumn("depth", F.lit(d))
        frontier = cut(found, "frontier")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def reverse_dependents(edges: DataFrame, seeds: DataFrame, depth: int, source: str = "src", target: str = "dst") -> DataFrame:  # G2
    """What depends on the seeds: the walk against the edges."""
    return reachable(edges, seeds, depth, source=target, target=source)


def neighbours(edges: DataFrame, seed, depth: int, source: str = "src", target: str = "dst") -> DataFrame:  # G3
    """``node, depth, via, direction`` of the neighbourhood of one node in both directions; the first discovery wins.

    Ties within a round go to the smaller parent, then to outgoing before incoming edges.
    """
    both = edges.select(F.col(source).alias("p__"), F.col(target).alias("node"), F.lit("out").alias("direction"), F.lit(0).alias("o__")).unionByName(edges.select(F.col(target).alias("p__"), F.col(source).alias("node"), F.lit("in").alias("direction"), F.lit(1).alias("o__")))
    spark = edges.sparkSession
    kind = edges.schema[source].dataType
    seen = spark.createDataFrame([(seed,)], "node " + kind.simpleString()).select("node", F.lit(0).alias("depth"), F.lit(None).cast(kind).alias("via"), F.lit(None).cast("string").alias("direction"))
    frontier = seen
    for d in range(1, depth + 1):
        step = frontier.select(F.col("node").alias("f__")).join(both, F.col("f__") == F.col("p__"))
        best = step.groupBy("node").agg(F.min_by(F.struct("p__", "direction"), F.struct("p__", "o__")).alias("x"))
        found = best.select("node", F.lit(d).alias("depth"), F.col("x.p__").alias("via"), F.col("x.direction").alias("direction")).join(seen.select("node"), "node", "left_anti")
        frontier = cut(found, "frontier")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def _downward(edges: DataFrame) -> DataFrame:
    """Each edge once, from its larger node ``a`` to its smaller node ``b``."""
    return edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct()


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:  # G4
    """``node, component`` over edges ``a, b``; component is the smallest node that a node reaches.

    Stars in turn: every larger neighbour of a node is linked to the smallest one around it, then a node and its smaller
    neighbours are linked to the smallest of them. Both need minima alone, which are aggregated before they are shuffled,
    and rounds grow with the logarithm of the nodes. A node with loops only is its own component.
    """
    known = edges.select("a", "b").filter("a is not null and b is not null")
    now, mark = cut(_downward(known), "edges"), None
    for _ in range(rounds):
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        around = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = _downward(both.join(around, "u").filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")))
        below = large.groupBy("a").agg(F.min("b").alias("m"))
        small_ = large.join(below, "a").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = cut(_downward(small_.unionByName(below.select("a", F.col("m").alias("b")))), "edges")
        discard(now)
        now, before, mark = after, mark, tuple(after.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))")).first())
        if mark == before or not mark[0]:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    linked = now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
    loops = known.filter("a = b").select(F.col("a").alias("node")).distinct().join(linked.select("node"), "node", "left_anti")
    return linked.unionByName(loops.select("node", F.col("node").alias("component")))


def taint_paths(sinks: DataFrame, callers_of: DataFrame, sources: DataFrame, depth: int = 6, gate: Column | None = None) -> DataFrame:  # G1
    """For each sink, the paths back over callers to the nearest source above each frame's entry line.

    sinks: sink_id, file, symbol, line; callers_of: callee, file, symbol, line; sources: file, line, source, and match and
    ord if they are known: of the sources on one line the least ord counts. A frame is visited once per sink, under its
    file and symbol, at module level under its file and line; the first arrival wins, in the order of the parents, then
    of caller file and line. ``gate`` is a condition on a hop's columns (from_file, file, callee). Emits sink_id, source,
    source_file, source_line, match, depth, ord, and hops (file, line, symbol) from the sink to the frame that the source stands in.
    """
    frame = F.coalesce(F.col("symbol"), F.concat(F.lit("@"), F.col("line")))
    hop = lambda prefix="": F.struct(F.col(f"{prefix}file").alias("file"), F.col(f"{prefix}line").alias("line"), F.col(f"{prefix}symbol").alias("symbol"))
    frames = cut(sinks.select("sink_id", "file", "symbol", "line", F.array(hop()).alias("hops"), F.lit(0).alias("ord"), frame.alias("frame")), "frames")
    seen = frames.select("sink_id", "file", "frame").distinct()
    known = {c: F.col(c) if c in sources.columns else F.lit(None) for c in ("match", "ord")}
    given = sources.select("file", "line", F.col("line").alias("sl"), "source", known["match"].cast("string").alias("match"), (-known["ord"].cast("int")).alias("first"))
    c = callers_of.select("callee", F.col("file").alias("to_file"), F.col("symbol").alias("to_symbol"), F.col("line").alias("to_line"))
    # every frame begins at a sink or a call site, so the source above each of these places is looked up once, before the walk
    places = sinks.select("file", "line").unionByName(callers_of.select("file", "line")).distinct()
    near = cut(as_of(places, given, "file", "line", ["source", "sl", "match"], tie="first").filter("sl is not null"), "near")
    found = None
    for d in range(depth + 1):
        hit = frames.select("sink_id", "file", "line", "hops", "ord").join(near, ["file", "line"])
        hit = hit.select("sink_id", "source", F.col("file").alias("source_file"), F.col("sl").alias("source_line"), "match", F.lit(d).alias("depth"), "ord", "hops")
        found = hit if found is None else found.unionByName(hit)
        if d == depth:
            break
        step = frames.drop("frame").join(c, F.col("symbol") == F.col("callee")).withColumn("from_file", F.col("file"))
        if gate is not None:
            step = step.filter(gate)
        step = step.select("sink_id", F.col("ord").alias("parent"), F.array_append("hops", hop("to_")).alias("hops"), F.col("to_file").alias("file"), F.col("to_symbol").alias("symbol"), F.col("to_line").alias("line")).withColumn("frame", frame)
        order = F.struct("parent", "file", "line")
        first = step.groupBy("sink_id", "file", "frame").agg(F.min_by(F.struct("symbol", "line", "hops", "parent"), order).alias("x"))
        step = first.join(seen, ["sink_id", "file", "frame"], "left_anti").select("sink_id", "file", "frame", "x.*")
        step = step.withColumn("ord", F.row_number().over(Window.partitionBy("sink_id").orderBy("parent", "file", "line"))).drop("parent")
        frames = cut(step, "frames")
        if frames.isEmpty():
            break
        seen = cut(seen.unionByName(frames.select("sink_id", "file", "frame")), "seen")
    return found


def merge_graphs(a: dict[str, DataFrame], b: dict[str, DataFrame]) -> dict[str, DataFrame]:  # G5
    """Two graphs as relations put together: files (file), edges (from, to, kind, to_symbol, weight), defs (name, file), callers (callee, file, line, symbol).

    Of an edge in both the larger weight stays, everything else is a union without repeats.
    """
    out = {part: a[part].select(*columns).unionByName(b[part].select(*columns)).distinct() for part, columns in {"files": ["file"], "defs": ["name", "file"], "callers": ["callee", "file", "line", "symbol"]}.items()}
    return out | {"edges": merge_edges(a["edges"], b["edges"], ["from", "to", "kind", "to_symbol"])}
