import random

import numpy as np
import pytest

from churnlens.llm import catalog, graph, minhash

from .helpers import SF, docs, prose


def brute(rows, k=4, similarity=80):
    """(shingles, component) by comparing all pairs."""
    sets = {}
    for d, t in rows:
        w = (t or "").encode().lower().split()
        sets.setdefault(d, []).append(frozenset(tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset())
    comp = {d: d for d in sets if d is not None}
    changed = True
    ids = sorted(comp)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1:] for x in sets[a] for y in sets[b]
             if x and y and 100 * len(x & y) >= similarity * len(x | y)]
    while changed:
        changed = False
        for a, b in links:
            m = min(comp[a], comp[b])
            changed |= comp[a] != m or comp[b] != m
            comp[a] = comp[b] = m
    return {d: (len(s[0]), comp.get(d)) for d, s in sets.items()}


def edited(text, rng, n):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = f"e{rng.randint(0, 10**9)}"
    return " ".join(w)


def result(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


def test_linked_is_exact():
    a = np.arange(10, dtype=np.uint64)
    assert minhash.linked(a, np.arange(8, dtype=np.uint64), 80)                # 8 of 10
    assert not minhash.linked(a, np.arange(7, dtype=np.uint64), 80)
    assert not minhash.linked(a, np.arange(1, 11, dtype=np.uint64)[:8], 90)
    assert minhash.linked(a[:1], a[:1], 80) and not minhash.linked(a[:1], a[5:6], 80)


def test_keys_pair_short_keys_of_both_collections():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**32, 32, dtype=np.uint64).astype(np.uint32)
    b = rng.integers(0, 2**32, 32, dtype=np.uint64).astype(np.uint32)
    b[2 * 3:2 * 4] = a[2 * 3:2 * 4]                      # short key 3 of the first collection
    assert not (minhash.table_keys(a, 2, 8) == minhash.table_keys(b, 2, 8)).any()
    b[16 + 2 * 5:16 + 2 * 6] = a[16 + 2 * 5:16 + 2 * 6]  # and 5 of the second
    same = np.flatnonzero(minhash.table_keys(a, 2, 8) == minhash.table_keys(b, 2, 8))
    assert same.tolist() == [3 * 8 + 5]


def test_components(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(50)] + [(100, 60 + i) for i in range(30)] + [(200, 200), (201, 200), (None, 3)] + [(rng.randint(300, 400), rng.randint(300, 400)) for _ in range(60)]
    comp = {}
    def root(x):
        while comp.setdefault(x, x) != x:
            x = comp[x]
        return x
    for a, b in links:
        if a is not None and a != b:
            x, y = root(a), root(b)
            comp[max(x, y)] = min(x, y)
    got = {r["id"]: r["component"] for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: root(x) for x in list(comp)}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_groups_chains_and_copies(spark):
    rng, rows = random.Random(2), []
    for g in range(12):
        base = " ".join(prose(g, 120))
        rows += [(g * 100 + i, edited(base, rng, rng.randint(0, 5))) for i in range(8)]
    chain = " ".join(prose(77, 150))
    for i in range(12):                                    # neighbours are near, the ends are not
        rows.append((5000 + i, chain))
        chain = edited(chain, rng, 3)
    rows += [(9000 + i, rows[0][1]) for i in range(30)] + [(9100, rows[0][1].upper())]
    assert result(minhash.near_duplicates(docs(spark, rows))) == brute(rows)


@pytest.mark.parametrize("small", [2, 8])
def test_large_buckets_lose_no_link(spark, monkeypatch, small):
    monkeypatch.setattr(minhash, "SMALL", small)
    monkeypatch.setattr(minhash, "BLOCK", 16)
    rng = random.Random(3)
    base = " ".join(prose(5, 200))
    rows = [(i, edited(base, rng, rng.randint(0, 12))) for i in range(150)]
    other = rows[40][1]
    rows += [(1000 + i, edited(other, rng, rng.randint(2, 9))) for i in range(60)]
    assert result(minhash.near_duplicates(docs(spark, rows))) == brute(rows)


def test_edge_rows(spark):
    long = " ".join(prose(8, 6000))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one two"), (5, "ONE two"), (6, "one two three four"), (7, long), (8, long + " end"), (7, long), (None, long), (9, None),
            (10, "É é"), (11, "é É")]
    df = docs(spark, rows, extra=True)
    got = sorted(((r["doc_id"] or 0, r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(df).collect()))
    n = len({tuple(long.split()[i:i + 4]) for i in range(5997)})
    assert got == sorted([(0, n, None, True), (1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (6, 1, 6, True), (7, n, 7, True),
                          (7, n, 7, True), (8, n + 1, 7, False), (9, 0, 9, True), (10, 1, 10, True), (11, 1, 11, True)])
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_query_against_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = catalog.op9_minhash(spark, SF)
    assert result(got) == brute(rows)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got.collect())


def test_an_id_in_many_rows_is_compared_once(spark):
    """Copies of rows add no sets to compare, whether an id has one text or some."""
    a, b, c = prose(1, 80), prose(2, 80), prose(3, 80)
    rows = [(1, " ".join(a)), (2, " ".join(a + ["end"])), (3, " ".join(b)), (3, " ".join(c)), (4, " ".join(c + ["end"])), (5, " ".join(["start"] + b))]
    many = rows * 25
    ids = spark.createDataFrame([(i,) for i in range(1, 6)], "doc_id long")
    sets = [minhash._different_sets(docs(spark, r), ids, docs(spark, r), 4).count() for r in (rows, many, rows[:2])]
    assert sets == [6, 6, 2]
    got = {(r["doc_id"], r["component_id"]) for r in minhash.near_duplicates(docs(spark, many)).collect()}
    assert got == {(1, 1), (2, 1), (3, 3), (4, 3), (5, 3)}


def test_sets_are_compared_pair_by_pair(spark):
    """In no batch of pairs, whose sets together have no bound; exact at the limit, for each of the sets of a repeated id."""
    sets = spark.createDataFrame([(1, list(range(10))), (2, list(range(8))), (3, list(range(7))), (4, list(range(-5, 0))), (4, list(range(9)))], "rep long, members array<long>")
    pairs = spark.createDataFrame([(1, 2), (1, 3), (1, 4), (2, 3)], "a long, b long")
    found = minhash._confirmed(pairs, sets, 80)
    assert sorted(map(tuple, found.collect())) == [(1, 2), (1, 4), (2, 3)]
    assert "Arrow" not in found._jdf.queryExecution().executedPlan().toString()
