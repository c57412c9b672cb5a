"""Line dedup: SimHash of normalised lines, pigeonhole blocks, edit similarity, connected groups; DataFrame functions only.

Lines are normalised (lower case; ASCII signs and white space as one space). The SimHash of a line has up to 16
segments: its different words are dealt to segments by four bits of their hashes, and a segment holds the majority bits
of its own words. A word that changes thus touches two segments at most, however many bits it moves; in one SimHash over
all words it would move bits anywhere. A block is three segments that follow each other on the ring of the line's
segments, at their places. By the pigeonhole principle some block is left whole where few segments differ: of 16, any
five may. Lines that share a block, and of the larger one's segments the share ``agree`` at least, are candidates;
candidates are verified by the edit similarity of the whole lines, by characters; and connected groups of verified links
keep the first occurrence in order of document and place.

Within a block not all pairs are compared. First each line is compared with the smallest key of its block, which
joins nearly all that are alike, however many. Blocks whose lines then are in one group are done. In others, lines of
different groups are compared with each other if the block has at most ``crowd`` lines; larger ones are cut by one more
equal segment beside those that the block has, whichever it be, and start anew. Candidates that ``agree`` asks for no
more equal segments than the block has need not share another, so lines that are short enough also stay in the uncut
block. What is crowded even after ``cuts`` such cuts is compared in full as well. All pairs of a block, crowded or not,
are spread over cells of ``crowd`` lines a side, so no task holds a block; their number grows with the square of what
stays crowded. So candidates end in one group if they are alike.

Lines are known by the 64-bit hash of their normalised text.

Defined results
    blank lines          are not compared and always stay
    up to three segments the whole line is one block
    null or empty text   no line; n_lines and n_kept are 0, nothing is removed
    null id              after all other ids in the order of occurrences
    repeated rows        occurrences like any other: of two equal documents the second loses its lines
    very long lines      are compared whole; a pair costs time with the square of what lies between their first and last difference
    empty table          empty result
    other columns        are not read
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardenflow.llm.common import forget, fresh, settle, text_of
from wardenflow.llm.components import connected_components

#: ASCII signs and white space but the line feed; they become spaces.
SIGNS = r"[\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F]+"
#: Segments by the top four bits of a word's hash; bits of a segment's majority, three counters of 21 bits to a long.
SEGMENTS, SUMS, LANE = 16, 5, 21
LANES = sum(1 << LANE * i for i in range(3))
CODE = (1 << 27) - 1


def line_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A settled table with a row for each line: row, doc_id, pos, line (normalised), key; key is NULL for blank lines."""
    plain = F.regexp_replace(F.lower(text_of(text_col)), SIGNS, " ")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.when(F.col(text_col).isNotNull(), plain).alias("plain"))
    lines = rows.select("row", "doc_id", F.posexplode_outer(F.split("plain", "\n")).alias("pos", "line"))
    lines = lines.select("row", "doc_id", F.coalesce("pos", F.lit(0)).alias("pos"), F.trim("line").alias("line"))
    return settle(lines.withColumn("key", F.when(F.col("line") != "", F.xxhash64("line"))), "lines", "zstd")


def _ahead() -> Column:
    """Order of occurrences: null ids last, then id, row and place."""
    return F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("row"), F.col("pos"))


def segment_codes(lines: DataFrame) -> DataFrame:
    """``key, codes``: the segments of each line's SimHash in order, empty ones left out, place and bits in one int."""
    # each line once and by key: its words then meet where they are made, and no word is shuffled
    once = lines.select("key", F.array_join(F.array_distinct(F.split("line", " ")), " ").alias("words")).groupBy("key").agg(F.first("words").alias("words"))
    words = once.select("key", F.explode(F.split("words", " ")).alias("word"))
    hashed = words.select("key", F.xxhash64("word").alias("h")).withColumn("segment", F.shiftrightunsigned("h", 60).cast("int"))
    sums = [F.sum(F.shiftrightunsigned("h", j).bitwiseAND(F.lit(LANES))).alias(f"s{j}") for j in range(SUMS)]
    counted = hashed.groupBy("key", "segment").agg(F.count(F.lit(1)).alias("n"), F.min("h").alias("one"), *sums)
    lane = lambda j, i: F.shiftrightunsigned(f"s{j}", LANE * i).bitwiseAND(F.lit((1 << LANE) - 1))
    majority = sum((F.when(2 * lane(j, i) > F.col("n"), F.lit(1 << 3 * j + i)).otherwise(F.lit(0)) for j in range(SUMS) for i in range(3)), F.lit(0))
    low = F.when(F.col("n") == 1, F.col("one").bitwiseAND(F.lit(CODE)).cast("int")).otherwise(majority)  # one word: more of its hash
    coded = counted.select("key", "segment", F.shiftleft("segment", 27).bitwiseOR(low).alias("code"))
    wide = coded.groupBy("key").agg(*[F.max(F.when(F.col("segment") == s, F.col("code"))).alias(f"c{s}") for s in range(SEGMENTS)])
    return settle(wide.select("key", F.array_compact(F.array(*[f"c{s}" for s in range(SEGMENTS)])).alias("codes")), "codes")


def ring_blocks(codes: DataFrame) -> DataFrame:
    """``key, block``: a row for each three neighbours on the ring of a line's segments."""
    ring = codes.select("key", "codes", F.concat("codes", F.slice("codes", 1, 2)).alias("ring"))
    three = F.transform("codes", lambda x, i: F.xxhash64(x, F.get("ring", i + 1), F.get("ring", i + 2)))
    return ring.select("key", F.explode(F.when(F.size("codes") > 3, three).otherwise(F.array(F.xxhash64("codes")))).alias("block"))


def finer_blocks(members: DataFrame, equal: int, agree: float) -> DataFrame:
    """``key, block, rest``: blocks of ``equal`` segments with one more, for each segment of each line that the block does not have yet.

    ``rest`` are the segments that stay. Lines with so few segments that ``agree`` may ask for no more than ``equal`` keep the old block too.
    """
    if "rest" not in members.columns:
        ring = F.concat("codes", F.slice("codes", 1, 2))
        own = F.transform("codes", lambda x, i: F.array(x, F.get(ring, i + 1), F.get(ring, i + 2)))
        own = F.get(F.filter(own, lambda x: F.xxhash64(F.get(x, F.lit(0)), F.get(x, F.lit(1)), F.get(x, F.lit(2))) == F.col("block")), F.lit(0))
        own = F.when(F.size("codes") > 3, own).otherwise(F.col("codes"))
        members = members.withColumn("rest", F.array_except("codes", own))
    more = members.select("key", "block", "rest", F.explode("rest").alias("code"))
    more = more.select("key", F.xxhash64("block", "code").alias("block"), F.array_remove("rest", F.col("code")).alias("rest"))
    few = members.filter(F.size("codes") * F.lit(agree) <= equal)
    return more.unionByName(few.select("key", "block", "rest"))


def _between(pairs: DataFrame) -> DataFrame:
    """Pairs of lists of words ``x, y`` as strings without the words that both begin and end with, at the same edit distance."""
    first = lambda x, y: F.array_position(F.zip_with(x, y, lambda u, v: u.eqNullSafe(v)), False).cast("int") - 1
    rest = lambda x: F.slice(x, F.col("head") + 1, F.greatest(F.size(x), F.lit(1)))
    pairs = pairs.withColumn("head", first("x", "y"))
    pairs = pairs.withColumns({"p": F.reverse(rest("x")), "q": F.reverse(rest("y"))}).withColumn("tail", first("p", "q"))

    def cut(x):
        n = F.size(x) - F.col("head") - F.col("tail")
        left, right = F.when(F.col("head") > 0, " ").otherwise(""), F.when(F.col("tail") > 0, " ").otherwise("")
        inner = F.array_join(F.slice(x, F.col("head") + 1, F.greatest(n, F.lit(0))), " ")
        return F.when(n > 0, F.concat(left, inner, right)).otherwise(F.when((F.col("head") > 0) & (F.col("tail") > 0), " ").otherwise(""))

    return pairs.select("a", "b", "most", cut("x").alias("x"), cut("y").alias("y"))


def agreeing(a: Column, b: Column, agree: float) -> Column:
    """Whether two lists of segments have the share ``agree`` of the longer one in common."""
    return F.size(F.array_intersect(a, b)) >= F.lit(agree) * F.greatest(F.size(a), F.size(b))


def _changed_words(x: Column, y: Column, known: Column) -> tuple[Column, Column]:
    """Two lists of words as strings with a character for each word, by its place among the ``known`` ones."""
    one = lambda words: F.decode(F.unhex(F.array_join(F.transform(words, lambda w: F.hex(F.array_position(known, w) + F.lit(0x3000))), "")), "UTF-16BE")
    return one(x), one(y)


def verified(pairs: DataFrame, texts: DataFrame, similarity: float = 0.8) -> DataFrame:
    """The pairs ``a, b`` of keys whose lines (``key, line``) differ by at most 1 - ``similarity`` of the longer one in edits."""
    side = lambda k, x: texts.select(F.col("key").alias(k), F.col("line").alias(x))
    both = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b")
    longest = F.greatest(F.char_length("x"), F.char_length("y"))
    both = both.withColumn("most", F.floor(longest * F.lit(1 - similarity) + F.lit(1e-9)).cast("int"))
    both = both.filter(F.abs(F.char_length("x") - F.char_length("y")) <= F.col("most"))
    parts = max(64, int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    both = both.select("a", "b", "most", F.split("x", " ").alias("x"), F.split("y", " ").alias("y")).repartition(parts, "a", "b")  # few bytes but much work for each
    both = _between(both)
    # changing one word takes at most the longest word and a space in edits: few changed words settle most pairs at less cost
    both = both.withColumns({"p": F.split("x", " "), "q": F.split("y", " ")}).withColumn("known", F.array_distinct(F.concat("p", "q")))
    p, q = _changed_words(F.col("p"), F.col("q"), F.col("known"))
    few = F.size("known") <= 40_000  # as many characters as there are from U+3000 on without a gap
    both = both.select("a", "b", "most", "x", "y", F.when(few, p).alias("p"), F.when(few, q).alias("q"), F.floor(F.col("most") / (F.array_max(F.transform("known", F.char_length)) + 1)).cast("int").alias("words"))
    both = settle(both, "changed")  # filters on these columns would otherwise compute them again and again
    settled = F.coalesce(F.expr("levenshtein(p, q, words) >= 0"), F.lit(False))
    return both.filter(settled | F.expr("levenshtein(x, y, most) >= 0")).select("a", "b")


class _Links:
    """Verified links so far and the groups that they make."""

    def __init__(self, spark, texts: DataFrame, similarity: float):
        self.texts, self.similarity = texts, similarity
        self.groups = spark.createDataFrame([], "node long, component long")

    def add(self, pairs: DataFrame) -> None:
        """Verify ``a, b`` and merge the groups."""
        pairs = settle(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
        checked = verified(pairs, self.texts, self.similarity)
        found = settle(checked, "links")
        forget(pairs)
        forget(checked)
        known = self.groups.select(F.col("node").alias("a"), F.col("component").alias("b"))
        if not found.isEmpty():
            before, self.groups = self.groups, settle(connected_components(known.unionByName(found)), "groups")
            forget(before)
        forget(found)

    def open(self, members: DataFrame) -> DataFrame:
        """The rows (block, key, codes and others) of blocks with more than one group, with their group's label and the block's size k."""
        named = members.join(self.groups, members["key"] == F.col("node"), "left")
        labelled = settle(named.select(*members.columns, F.coalesce("component", "key").alias("label")), "labelled")
        sizes = labelled.groupBy("block").agg(F.count(F.lit(1)).alias("k"), F.min("label").alias("low"), F.max("label").alias("high")).filter("low != high")
        opened = settle(labelled.join(sizes.select("block", "k"), "block"), "open")
        forget(labelled)
        return opened


def _candidates(pairs: DataFrame, agree: float) -> DataFrame:
    """The pairs (key, codes, label, b, b_codes, b_label) of different groups that have enough segments in common, as ``a, b``."""
    return pairs.filter((F.col("label") != F.col("b_label")) & agreeing(F.col("codes"), F.col("b_codes"), agree)).select(F.col("key").alias("a"), "b")


def _all_pairs(rows: DataFrame, side: int) -> DataFrame:
    """All pairs of rows (block, key, codes, label, k) within their block of ``k`` rows, spread over cells of about ``side`` rows a side."""
    parts = F.ceil(F.col("k") / side).cast("int")
    rows = rows.select("block", "key", "codes", "label", parts.alias("parts")).withColumn("part", F.pmod(F.xxhash64("block", "key"), F.col("parts")).cast("int"))
    left = rows.select("block", F.col("part").alias("i"), F.explode(F.sequence("part", F.col("parts") - 1)).alias("j"), "key", "codes", "label")
    right = rows.select("block", F.explode(F.sequence(F.lit(0), F.col("part"))).alias("i"), F.col("part").alias("j"), F.col("key").alias("b"), F.col("codes").alias("b_codes"), F.col("label").alias("b_label"))
    return left.join(right, ["block", "i", "j"]).filter((F.col("i") < F.col("j")) | (F.col("key") < F.col("b")))


def near_lines(lines: DataFrame, similarity: float = 0.8, agree: float = 0.35, crowd: int = 256, cuts: int = 1, most_broadcast: int = 1_000_000) -> DataFrame:
    """``node, component``: the connected groups of two or more of the lines ``key, line``; repeated lines count once."""
    spark, codes = lines.sparkSession, segment_codes(lines)
    blocks, links = ring_blocks(codes), None
    for cut in range(cuts + 1):
        shared = settle(blocks.groupBy("block").count().filter("count > 1").select("block"), "blocks")
        shared = F.broadcast(shared) if shared.count() <= most_broadcast else shared
        columns = ["block", "key", "codes", *(["rest"] if cut else [])]
        members = settle(blocks.join(shared, "block").join(codes, "key").select(*columns), "members")
        forget(shared)
        if cut:
            forget(blocks)
        if links is None:
            asked = settle(members.select("key").distinct(), "asked")
            asked = F.broadcast(asked) if asked.count() <= most_broadcast else asked
            texts = lines.select("key", "line").join(asked, "key", "left_semi").groupBy("key").agg(F.first("line").alias("line"))
            links = _Links(spark, settle(texts, "texts"), similarity)
            forget(asked)
        first = members.groupBy("block").agg(F.min_by(F.struct("key", "codes"), "key").alias("x"))
        first = first.select("block", F.col("x.key").alias("b"), F.col("x.codes").alias("b_codes"), F.col("x.key").alias("b_label"))
        links.add(_candidates(members.withColumn("label", F.col("key")).join(first, "block"), agree))
        left = links.open(members)
        forget(members)
        crowded = left.filter(F.col("k") > crowd).select(*columns) if cut < cuts else None
        links.add(_candidates(_all_pairs(left if crowded is None else left.filter(F.col("k") <= crowd), crowd), agree))
        if crowded is None or crowded.isEmpty():
            forget(left)
            break
        blocks = settle(finer_blocks(crowded, 3 + cut, agree), "finer")
        forget(left)
    forget(codes)
    forget(links.texts)
    return links.groups


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8, **options) -> DataFrame:
    """The line table with ``kept`` for each line."""
    lines = line_table(docs, id_col, text_col)
    nodes = lines.filter("key is not null").groupBy("key").agg(F.count(F.lit(1)).alias("times"), F.min(_ahead()).alias("first"))
    nodes = settle(nodes, "nodes")
    groups = near_lines(lines.filter("key is not null"), similarity, **options)
    linked = nodes.join(groups, F.col("key") == F.col("node")).select("key", "first", "component")
    heads = linked.groupBy("component").agg(F.min("first").alias("head"))
    near = linked.join(heads, "component").select("key", "head")
    alone = nodes.filter("times > 1").join(near.select("key"), "key", "left_anti").select("key", F.col("first").alias("head"))
    heads = settle(near.unionByName(alone).select("key", F.col("head.row").alias("head_row"), F.col("head.pos").alias("head_pos")), "heads")
    forget(nodes)
    forget(groups)
    kept = F.coalesce((F.col("row") == F.col("head_row")) & (F.col("pos") == F.col("head_pos")), F.lit(True))
    return lines.join(heads, "key", "left").select("row", "doc_id", "pos", "key", kept.alias("kept"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, n_lines, n_kept and removed (places of removed lines from 0, comma-joined) for each row."""
    some = F.col("key").isNotNull()
    out = repeated_lines(docs, id_col, text_col, **options).groupBy("row", "doc_id").agg(
        F.count_if(some).alias("n_lines"), F.count_if(some & F.col("kept")).alias("n_kept"), F.array_sort(F.collect_list(F.when(~F.col("kept"), F.col("pos")))).alias("removed")
    )
    return out.select("doc_id", "n_lines", "n_kept", F.array_join(F.transform("removed", lambda x: x.cast("string")), ",").alias("removed"))


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with the lines that stay in their texts; all rows and columns stay. Ids are taken as unique."""
    name, places = fresh(docs, "line_id"), fresh(docs, "removed_lines")
    gone = repeated_lines(docs, id_col, text_col, **options).filter("not kept").groupBy(F.col("doc_id").alias(name)).agg(F.collect_set("pos").alias(places))
    joined = docs.join(gone.hint("merge"), F.col(id_col).eqNullSafe(F.col(name)), "left")
    text = F.array_join(F.filter(F.split(text_col, "\n"), lambda x, i: ~F.array_contains(F.col(places), i)), "\n")
    return joined.withColumn(text_col, F.when(F.col(places).isNull(), F.col(text_col)).otherwise(text)).select(*docs.columns)
