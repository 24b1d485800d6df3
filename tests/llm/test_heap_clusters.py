import hashlib
import math
import random

import numpy as np
import pytest

from churnlens.llm import catalog, heap_clusters
from churnlens.llm.heap_clusters import Block, Bounds

from .helpers import SF, rows_of

COLUMNS = ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def brute(rows, clusters=16, rounds=3, dim=64, scale=64):
    """Every vector against every centroid in every round, in Python's integers."""
    kept = [(i, tuple(math.floor(scale * x) for x in v)) for i, v in rows
            if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    by_hash = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    cs = [q for _, q in by_hash[:clusters]]
    assign = lambda: [min((sum((a - b) ** 2 for a, b in zip(q, c)), j) for j, c in enumerate(cs)) for _, q in kept]
    for _ in range(rounds):
        own = [c for _, c in assign()]
        for j in range(len(cs)):
            mine = [q for (_, q), c in zip(kept, own) if c == j]
            if mine:
                cs[j] = tuple(sum(x) // len(mine) for x in zip(*mine))
    best = assign()
    inertia = [sum(d for d, c in best if c == j) for j in range(len(cs))]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cs]
    return sorted(((i, c, d, inertia[c], sum(inertia), sha[c]) for (i, _), (d, c) in zip(kept, best)), key=lambda t: tuple((x is None, x) for x in t))


def frame(spark, rows, dim=4):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>")


def cloud(seed, n, dim=4, centres=6):
    rng = random.Random(seed)
    middles = [[rng.uniform(-1, 1) for _ in range(dim)] for _ in range(centres)]
    return [(i, [m + rng.gauss(0, 0.05) for m in rng.choice(middles)]) for i in range(n)]


@pytest.mark.parametrize("seed", range(2))
def test_equals_full_scans(spark, seed, monkeypatch):
    monkeypatch.setattr(heap_clusters, "BLOCK", 32)
    rows = cloud(seed, 300)
    got = heap_clusters.cluster(frame(spark, rows).repartition(3), clusters=7, rounds=4, dim=4)
    assert rows_of(got, *COLUMNS) == brute(rows, 7, 4, 4)


def test_heaps_give_up_only_what_may_have_changed():
    """Against a scan of everything, round by round; and most vectors of separate clouds are never popped again."""
    x = np.floor(64 * np.array([v for _, v in cloud(9, 2000)])).astype(np.int16)
    bounds = Bounds([list(map(int, x[i])) for i in range(6)])
    block, popped = Block.scanned(x, bounds), []
    for _ in range(8):
        own = block.clusters()
        bounds.sums = [x[own == c].astype(int).sum(0).tolist() for c in range(6)]
        bounds.sizes = [int((own == c).sum()) for c in range(6)]
        bounds.move()
        waiting = [sorted(h) for h in block.heaps]
        popped.append(sum(key <= d for h, d in zip(waiting, bounds.drift) for key, _ in h))
        block.advance(bounds)
        assert (block.clusters() == heap_clusters.scan(x, bounds.centroids)[0]).all()
        assert sorted(i for h in block.heaps for _, i in h) == list(range(2000))
        assert all(h[(i - 1) // 2] <= h[i] for h in block.heaps for i in range(1, len(h)))
    assert sum(popped[3:]) < 0.5 * 2000 * len(popped[3:])


def test_ties_go_to_the_smaller_number_and_empty_centroids_stay(spark):
    rows = [(i, [0.5] * 4) for i in range(40)] + [(100 + i, [-0.5, 0.25, 0.0, 0.0]) for i in range(3)]
    assert rows_of(heap_clusters.cluster(frame(spark, rows), clusters=8, dim=4), *COLUMNS) == brute(rows, 8, 3, 4)
    one = [(1, [0.1, -0.1, 0.0, 1.0])]
    assert rows_of(heap_clusters.cluster(frame(spark, one), dim=4), *COLUMNS) == brute(one, dim=4)


def test_edge_rows(spark):
    good = cloud(3, 30)
    bad = [(50, None), (51, []), (52, [1.0] * 3), (53, [1.0, None, 0.0, 0.0]), (54, [float("nan")] * 4), (55, [float("inf"), 0.0, 0.0, 0.0])]
    twice = [(7, [0.3, 0.3, 0.3, 0.3])] * 5 + [(None, [0.2, 0.1, 0.0, -0.1])] * 2 + [(60, [0.0] * 4)]
    rows = good + bad + twice
    df = frame(spark, rows).selectExpr("*", "'x' as q", "1 as v", "2 as cluster", "'y' as ids", "3 as distance", "4 as n")
    assert rows_of(heap_clusters.cluster(df, clusters=5, dim=4), *COLUMNS) == brute(rows, 5, 3, 4)
    assert heap_clusters.cluster(frame(spark, bad), dim=4).count() == heap_clusters.cluster(frame(spark, []), dim=4).count() == 0


def test_large_numbers_stay_exact(spark):
    rng = random.Random(2)
    rows = [(i, [rng.choice([-1, 1]) * rng.uniform(1e5, 2e6) for _ in range(4)]) for i in range(60)]
    assert rows_of(heap_clusters.cluster(frame(spark, rows), clusters=5, dim=4), *COLUMNS) == brute(rows, 5, 3, 4)


def test_hot_vectors_spread_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(heap_clusters, "BLOCK", 64)
    rows = cloud(5, 200) + [(999, [0.1, 0.1, 0.1, 0.1])] * 200
    assert rows_of(heap_clusters.cluster(frame(spark, rows).repartition(4), clusters=6, dim=4), *COLUMNS) == brute(rows, 6, 3, 4)


def test_query(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert rows_of(catalog.op11_heap_clusters(spark, SF), *COLUMNS) == brute(rows)
