import hashlib
import random
import re
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from churnlens.llm import catalog, prefix_trie
from churnlens.llm.common import stored

from .helpers import SF, rows_of

COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
TURNS = "conv_id long, turn long, role string, text string"


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        path = tuple(own.get(c - c % 20, [])[:h] + ts[h:])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
        ends[path].append(c)
    below = defaultdict(set)
    for p in members:
        if p:
            below[p[:-1]].add(p)
    totals = {}
    for p in sorted(members, key=len, reverse=True):
        saved = (len(members[p]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        totals[p] = (sum(totals[q][0] for q in below[p]) or 1, saved + sum(totals[q][1] for q in below[p]))
    sha = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(below[p]), *totals[p], sha(ends[p])) for p, m in members.items())


def same(spark, rows, **kw):
    df = rows if not isinstance(rows, list) else spark.createDataFrame(rows, TURNS)
    want = brute([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])
    assert sorted(tuple(r[c] for c in COLUMNS) for r in prefix_trie.trie(df).collect()) == want
    return want


def some(seed, convs=60, words=3, longest=7):
    rng = random.Random(seed)
    return [(c, t, rng.choice(["user", "assistant"]) if rng.random() < 0.2 else "user", " ".join(rng.choice(["yes", "no"]) for _ in range(rng.randint(1, words))))
            for c in range(convs) for t in range(rng.randint(1, longest))]


def test_random_conversations(spark):
    same(spark, some(0, words=1) + [(100 + c, t, r, x) for c, t, r, x in some(1, convs=30, words=2)])


def test_deep_chains_and_hot_groups(spark, monkeypatch):
    """One conversation with over half of all rows, copied and cut off, in small pieces."""
    monkeypatch.setattr(prefix_trie, "PIECE", 4)
    monkeypatch.setattr(prefix_trie, "IDS", 3)
    long = [(20, t, "user", f"turn {t} of many") for t in range(150)]
    copies = [(c, t, "user", f"turn {t} of many") for c in range(21, 36) for t in range(9)]
    same(spark, long + copies + some(7, 18))


def test_edge_rows(spark):
    rows = [(1, 0, "user", "hi"), (1, None, None, None), (1, 5, "user", ""), (None, 0, "user", "lost"), (2, 3, "b", "tie z"), (2, 3, "a", "tie"), (2, 3, "b", "tie y"),
            (2, 3, "b", "tie y"), (40, 1, "user", "one"), (43, 0, "user", "w " * 20_000), (43, 0, "user", "w " * 20_000), (7, None, "u", "x"), (7, None, "u", None),
            (65, 0, "user", "lender is absent"), (83, 2, "ab", "c"), (84, 2, "a", "bc")]
    df = spark.createDataFrame(rows, TURNS).selectExpr("*", "1 as pos", "'x' as tie", "2 as depth", "'y' as id", "3 as words", "4 as last", "5 as c")
    want = same(spark, df)
    assert any(r[1] == 0 for r in want)
    assert prefix_trie.trie(spark.createDataFrame([], TURNS)).count() == 0
    assert prefix_trie.trie(spark.createDataFrame([(None, 1, "a", "b")], TURNS)).count() == 0


def test_conversations_without_turns_end_at_the_root(spark):
    alone = [c for c in range(41, 60) if zlib.crc32(str(c).encode()) % 4 >= 1]          # their lender, 40, is absent
    want = same(spark, [(c, 0, "user", "gone") for c in alone])
    assert want == [(alone[0], 0, None, len(alone), 0, 1, 0, hashlib.sha256(",".join(map(str, alone)).encode()).hexdigest())]


def test_running_sums_in_pieces(spark):
    rows = [(g, p, p * (g + 1)) for g, n in ((0, 100), (1, 1), (2, 7)) for p in range(1, n + 1)]
    df = stored(spark.createDataFrame(rows, "g long, p long, v long").withColumn("v", F.col("v").cast("decimal(38,0)")), "test")
    for piece in (3, 1000):
        got = {(r["g"], r["p"]): int(r["v"]) for r in prefix_trie.running_sums(df, "g", "p", ["v"], piece).collect()}
        assert got == {(g, p): (g + 1) * p * (p + 1) // 2 for g, p, _ in rows}


def test_subtree_totals_of_any_trees(spark):
    """A path, a star, a caterpillar, random trees and a lone node, in one table."""
    rng, up = random.Random(3), {}
    add = lambda name, parents: up.update({f"{name}{i}": None if p is None else f"{name}{p}" for i, p in enumerate(parents)})
    add("path", [None, *range(70)])
    add("star", [None, *[0] * 60])
    add("worm", [None, *[i - i % 2 - (2 if i % 2 == 0 else 0) for i in range(1, 60)]])
    add("any", [None, *[rng.randrange(i) for i in range(1, 150)]])
    add("lone", [None])
    own = {k: rng.randint(-5, 9) for k in up}
    want = dict(own)
    depth = lambda k: 0 if up[k] is None else 1 + depth(up[k])
    for k in sorted(up, key=depth, reverse=True):
        if up[k] is not None:
            want[up[k]] += want[k]
    df = spark.createDataFrame([(k, p, own[k]) for k, p in up.items()], "id string, parent string, v long")
    assert rows_of(prefix_trie.subtree_totals(df, ["v"]), "id", "v") == sorted(want.items())


def test_query(spark):
    conversations = spark.read.parquet(f"{SF}/conversations.parquet")
    assert sorted(tuple(r[c] for c in COLUMNS) for r in catalog.op12_prefix_trie(spark, SF).collect()) == brute([tuple(r) for r in conversations.collect()])
