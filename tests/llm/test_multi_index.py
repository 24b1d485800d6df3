import heapq

import numpy as np

from churnlens.llm import catalog, multi_index as mi

from .helpers import SF

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, asked, k):
    ok = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all() and any(v)]
    out = {}
    for q, x in ok:
        if q in asked:
            near = heapq.nsmallest(k, {(float(np.sqrt(((x - y) ** 2).sum())), i) for i, y in ok if i != q and len(y) == len(x)})
            out[q] = [i for _, i in near], [d for d, _ in near]
    return out


def result(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        ids, d = out.setdefault(r["query_id"], ([], []))
        assert r["rank"] == len(ids) + 1
        ids.append(r["vec_id"])
        d.append(r["score"])
    return out


def test_heap_walks_cells_by_summed_distance():
    rng = np.random.default_rng(1)
    index = mi.Index(rng.normal(size=(5, 3)), rng.normal(size=(7, 3)), np.ones(35, np.int64))
    for _ in range(20):
        v = rng.normal(size=6)
        cells = index.probes(v, 35)
        sums = ((index.left - v[:3]) ** 2).sum(1)[:, None] + ((index.right - v[3:]) ** 2).sum(1)[None, :]
        assert cells == np.argsort(sums.ravel(), kind="stable").tolist()
        assert index.probes(v, 4) == cells[:4]


def test_everything_probed_is_exact(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 6)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000 + i, x[3].tolist()) for i in range(100)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = result(mi.search(df, df.filter("vec_id % 20 = 0"), centroids=5, probed=1.0))
    want = brute(rows, {i for i, _ in rows if i % 20 == 0}, 10)
    assert {q: v[0] for q, v in got.items()} == {q: v[0] for q, v in want.items()}
    assert all(np.allclose(got[q][1], want[q][1], rtol=1e-12) for q in want)


def test_parts_change_nothing(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(200, 4)).astype(np.float32))]
    df = spark.createDataFrame(rows, SCHEMA)
    whole = result(mi.search(df, df.filter("vec_id % 5 = 0"), centroids=4, probed=0.5))
    monkeypatch.setattr(mi, "PART", 3)
    monkeypatch.setattr(mi, "AT_ONCE", 2)
    assert result(mi.search(df, df.filter("vec_id % 5 = 0"), centroids=4, probed=0.5)) == whole


def test_edge_rows(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.1]), (2, [1.0, 0.1]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [None, 1.0]), (8, []),
            (9, [1.0, 0.2, 0.3]), (None, [1.0, 0.0]), (2, [1.0, 0.1]), (10, [5.0, 5.0])]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as cell", "2 as v", "3 as line", "4 as score", "5 as rank")
    got = result(mi.search(df, df))
    assert set(got) == {0, 1, 2, 10}
    assert got[0][0] == [1, 2, 10] and got[1][0] == [2, 0, 10]                # ties to the smaller id; fewer than k: all
    assert got[1][1][0] == 0.0
    assert mi.search(df.limit(0), df).count() == 0 and mi.search(df, df.limit(0)).count() == 0


def test_recall_of_the_query(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = result(catalog.op10_ann(spark, SF))
    want = brute(rows, {i for i, _ in rows if i % 100 == 0}, 10)
    assert set(got) == set(want)
    recall = np.mean([len(set(got[q][0]) & set(want[q][0])) / len(want[q][0]) for q in want])
    assert recall >= 0.9
    for q, (ids, d) in got.items():
        x = {i: np.array(v, np.float32).astype(float) for i, v in rows}
        assert np.allclose(d, [np.sqrt(((x[q] - x[i]) ** 2).sum()) for i in ids], rtol=1e-12)


def test_repeated_rows_take_one_place(spark):
    rng = np.random.default_rng(4)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(60, 4)).astype(np.float32))]
    rows += [(i, (np.array(v) + 0.01).tolist()) for i, v in rows if i % 3 == 0]      # an id with two vectors
    df = spark.createDataFrame(rows * 10, SCHEMA)
    got = result(mi.search(df, spark.createDataFrame(rows[:60:10], SCHEMA), centroids=3, probed=1.0))
    near = {q: sorted((min(float(np.sqrt(((np.array(x, np.float32).astype(float) - np.array(v, np.float32)) ** 2).sum())) for i, v in rows if i == j), j)
                      for j in range(60) if j != q)[:10] for q, x in rows[:60:10]}
    assert {q: ids for q, (ids, _) in got.items()} == {q: [j for _, j in n] for q, n in near.items()}


def test_copies_do_not_use_up_the_probed_share(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 6)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    query = spark.createDataFrame([rows[7]], SCHEMA)
    plain = spark.createDataFrame(rows, SCHEMA)
    copies = spark.createDataFrame([*rows, *[(7, rows[7][1])] * 1200], SCHEMA)        # the query's own cell holds most of the rows
    want = brute(rows, {7}, 10)[7][0]
    got = [result(mi.search(df, query, centroids=4, probed=0.6))[7][0] for df in (plain, copies)]
    assert all(len(set(g) & set(want)) >= 7 and len(g) == 10 for g in got)


def test_an_id_with_a_third_of_all_rows_is_dealt_out(spark, monkeypatch):
    """As copies, and with many vectors of its own: results are those of brute force, and no part holds the id whole."""
    rng = np.random.default_rng(6)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(90, 4)).astype(np.float32))]
    own = [(7, v.tolist()) for v in rng.normal(size=(45, 4)).astype(np.float32)]
    df, queries = spark.createDataFrame([*rows, *own, *[rows[11]] * 60], SCHEMA), spark.createDataFrame([*rows[:60:10], *[rows[20]] * 30], SCHEMA)
    monkeypatch.setattr(mi, "PART", 16)
    got = result(mi.search(df, queries, centroids=3, probed=1.0))
    at = lambda v: np.array(v, np.float32).astype(float)
    near = lambda q, x: sorted((min(float(np.sqrt(((at(x) - at(v)) ** 2).sum())) for i, v in [*rows, *own] if i == j), j) for j in range(90) if j != q)[:10]
    assert {q: ids for q, (ids, _) in got.items()} == {q: [j for _, j in near(q, x)] for q, x in rows[:60:10]}
