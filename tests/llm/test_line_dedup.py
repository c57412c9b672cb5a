import random
import re
from itertools import combinations

import pytest
import xxhash

from tests.llm import cases
from wardenflow.llm.line_dedup import _all_pairs, dedup_lines, drop_repeated_lines, finer_blocks, line_table, near_lines, ring_blocks, segment_codes, verified

A = "all of the people in the town went to the market to buy bread and some milk today"
B = A.replace("bread", "breads")


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def alike(a, b):
    return edits(a, b) <= int(max(len(a), len(b)) * 0.2 + 1e-9)


def groups_of(pairs):
    reach = {}

    def root(x):
        while reach.setdefault(x, x) != x:
            x = reach[x]
        return x

    for a, b in pairs:
        reach[max(root(a), root(b))] = min(root(a), root(b))
    return {x: root(x) for x in reach}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def plain_codes(line):
    """The segments in plain Python."""
    dealt = {}
    for w in set(line.split(" ")):
        h = xxhash.xxh64_intdigest(w.encode(), 42)
        dealt.setdefault(h >> 60, []).append(h)
    out = []
    for s, own in sorted(dealt.items()):
        bits = [2 * sum(h >> (j + 21 * i) & 1 for h in own) > len(own) for j in range(5) for i in range(3)]
        low = own[0] & ((1 << 27) - 1) if len(own) == 1 else sum(1 << k for k, b in enumerate(bits) if b)
        code = s << 27 | low
        out.append(code - (1 << 32) if code >> 31 else code)
    return out


def nodes(spark, lines):
    return spark.createDataFrame([(signed(xxhash.xxh64_intdigest(x.encode(), 42)), x) for x in sorted(set(lines))], "key long, line string")


def near_copies(seed, n, words, changes, vocabulary=400):
    draw = random.Random(seed)
    vocab = ["".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=draw.randint(2, 9))) for _ in range(vocabulary)]
    out = []
    for _ in range(n):
        line = draw.choices(vocab, k=words)
        out.append(" ".join(line))
        for _ in range(3):
            copy = list(line)
            for _ in range(draw.randint(1, changes)):
                copy[draw.randrange(words)] = draw.choice(vocab)
            out.append(" ".join(copy))
    return sorted(set(out))


def test_equal_and_near_lines(spark):
    rows = [(1, f"{A}\nunique one here\n\nshort", "en", "a", 1), (2, f"SHORT!\n{A.upper()}.\nother words stand here alone now", "en", "a", 1), (3, f"{B}\n{A}", "en", "a", 1), (4, None, "en", "a", 1), (5, "", "en", "a", 1), (None, "short", "en", "a", 1)]
    got = {r.doc_id: (r.n_lines, r.n_kept, r.removed) for r in dedup_lines(cases.table(spark, rows)).collect()}
    assert got[1] == (3, 3, "") and got[2] == (3, 1, "0,1")
    assert got[4] == got[5] == (0, 0, "") and got[None] == (1, 0, "0")
    assert got[3] == (2, 0, "0,1")  # the near line goes too


def test_segments_against_brute_force(spark):
    docs = cases.documents(spark).unionByName(cases.table(spark, [(50, " ".join(f"w{i}" for i in range(9000)), "en", "a", 1), (51, "Größe ÉTÉ\r\nтест 例え", "en", "a", 1)]))
    lines = line_table(docs).filter("key is not null").select("key", "line").distinct()
    got = {r.line: list(r.codes) for r in segment_codes(lines).join(lines, "key").collect()}
    texts = [re.sub(r"[^a-z0-9\n\u0080-\U0010ffff]+", " ", (r.text or "").lower()) for r in docs.collect()]
    want = {x.strip() for t in texts for x in t.split("\n") if x.strip()}
    assert set(got) == want
    for line, codes in got.items():
        assert codes == plain_codes(line), line[:80]


@pytest.mark.parametrize(("words", "changes"), [(8, 1), (12, 2), (30, 4), (60, 4)])
def test_recall_of_near_pairs(spark, words, changes):
    """Of all pairs with an edit similarity of 0.8 or more, by brute force, at least nine tenths end in one group."""
    lines = near_copies(words, 8, words, changes)
    wanted = [(a, b) for a, b in combinations(lines, 2) if abs(len(a) - len(b)) <= 0.2 * max(len(a), len(b)) and alike(a, b)]
    table = nodes(spark, lines)
    found = {r.line: r.component for r in near_lines(table).join(table, near_lines_key(table)).collect()}
    hits = sum(a in found and found[a] == found.get(b) for a, b in wanted)
    assert len(wanted) > 20 and hits >= 0.9 * len(wanted)
    of = groups_of(wanted)
    assert all(of.get(a) == of.get(b) for a, b in combinations(lines, 2) if a in found and found[a] == found.get(b))  # and nothing else


def near_lines_key(table):
    from pyspark.sql import functions as F

    return F.col("node") == table["key"]


def plain_groups(spark, table):
    """Groups of all pairs that share a block and a third of their segments and are alike."""
    blocks = {}
    agree = lambda a, b: len(set(plain_codes(a)) & set(plain_codes(b))) >= 0.35 * max(len(plain_codes(a)), len(plain_codes(b)))
    for r in ring_blocks(segment_codes(table)).join(table, "key").collect():
        blocks.setdefault(r.block, set()).add(r.line)
    return groups_of({(a, b) for own in blocks.values() for a, b in combinations(sorted(own), 2) if agree(a, b) and alike(a, b)})


@pytest.mark.parametrize("options", [{"crowd": 256}, {"crowd": 3, "cuts": 1}, {"crowd": 3, "cuts": 0}])
def test_crowded_blocks_lose_no_link(spark, options):
    """Lines that begin alike and differ behind, in families: crowded blocks with several groups each."""
    draw = random.Random(5)
    word = lambda: "".join(draw.choices("abcdefghij", k=5))
    start, lines = " ".join(word() for _ in range(6)), []
    for _ in range(6):
        family = [word() for _ in range(8)]
        for _ in range(4):
            own = list(family)
            own[draw.randrange(8)] = word()
            lines.append(f"{start} {' '.join(own)}")
    table = nodes(spark, lines)
    want = plain_groups(spark, table)
    got = {r.line: r.component for r in near_lines(table, **options).join(table, near_lines_key(table)).collect()}
    together = lambda of: {(a, b) for a, b in combinations(sorted(set(lines)), 2) if a in of and of[a] == of.get(b)}
    assert together(got) == together(want) and len(together(want)) > 15


def test_verified_against_brute_force(spark):
    draw = random.Random(3)
    lines = near_copies(9, 6, 10, 3, 30) + ["a", "b", "a b", "b a", "a a", "a b a", "é é", "é ê é", "x" * 300, "x" * 290, "a " * 200 + "b", "b " + "a " * 199 + "b"]
    lines = sorted({" ".join(x.split()) for x in lines})
    pairs = [(a, b) for a, b in combinations(lines, 2) if draw.random() < 0.5 or len(a) < 20]
    table = nodes(spark, lines)
    key = {r.line: r.key for r in table.collect()}
    got = {(r.a, r.b) for r in verified(spark.createDataFrame([(key[a], key[b]) for a, b in pairs], "a long, b long"), table).collect()}
    assert got == {(key[a], key[b]) for a, b in pairs if alike(a, b)}


def test_texts_without_removed_lines(spark):
    docs = cases.table(spark, [(1, f"{A}\nx", "en", "a", 1), (2, f"y\n{A}", "en", "a", 1), (3, None, "en", "a", 1)])
    assert {r.doc_id: r.text for r in drop_repeated_lines(docs).collect()} == {1: f"{A}\nx", 2: "y", 3: None}
    assert drop_repeated_lines(cases.clashing(spark)).columns == cases.clashing(spark).columns
    assert dedup_lines(cases.empty(spark)).count() == 0


def test_very_long_lines(spark):
    long = " ".join(f"word{i}" for i in range(3000))
    docs = cases.table(spark, [(1, long, "en", "a", 1), (2, long.replace("word700 ", "other "), "en", "a", 1), (3, long[::-1], "en", "a", 1)])
    assert {r.doc_id: r.n_kept for r in dedup_lines(docs).collect()} == {1: 1, 2: 0, 3: 1}


def test_cuts_do_cut_and_lose_no_candidate(spark):
    """A cut leaves out what the block has already; pairs that agree by the block's segments alone still meet."""
    from pyspark.sql import functions as F

    word, lines, seen = iter(range(10**6)), [], set()
    start = []
    while len(start) < 3:  # three words in three segments that follow each other
        w = f"w{next(word)}"
        if xxhash.xxh64_intdigest(w.encode(), 42) >> 60 == 4 + len(start):
            start.append(w)
    for n in range(60):
        line = " ".join(start + [f"{'ab'[n % 2]}{next(word)}" for _ in range(1 if n % 3 else 14)])
        lines.append(line)
    table = nodes(spark, lines)
    codes = segment_codes(table)
    members = ring_blocks(codes).join(codes, "key")
    hot = members.groupBy("block").count().orderBy(F.desc("count")).first()
    members = members.filter(F.col("block") == hot["block"])
    assert hot["count"] > 30
    of = {r.key: set(r.codes) for r in members.collect()}
    own = set.intersection(*of.values())
    for r in finer_blocks(members, 3, 0.35).collect():
        seen.add((r.key, r.block))
        assert not own & set(r.rest) and (r.block != hot["block"] or 0.35 * len(of[r.key]) <= 3)
    blocks = {}
    for key, block in seen:
        blocks.setdefault(block, set()).add(key)
    meet = {(a, b) for keys in blocks.values() for a, b in combinations(sorted(keys), 2)}
    want = {(a, b) for a, b in combinations(sorted(of), 2) if len(of[a] & of[b]) >= 0.35 * max(len(of[a]), len(of[b]))}
    assert want and want <= meet
    assert max(len(keys) for block, keys in blocks.items() if block != hot["block"]) < hot["count"] / 2


def test_all_pairs_of_a_block_once(spark):
    rows = [(b, k, [k], k % 3, n) for b, n in ((1, 23), (2, 4), (3, 1)) for k in range(n)]
    table = spark.createDataFrame(rows, "block long, key long, codes array<int>, label long, k long")
    pairs = [(r.block, *sorted((r.key, r.b))) for r in _all_pairs(table, 4).collect()]
    assert sorted(pairs) == sorted((b, x, y) for b, n in ((1, 23), (2, 4), (3, 1)) for x, y in combinations(range(n), 2))
