"""Centroid clustering with heap-ordered bounds (operator 11).

Lloyd's rounds over integer vectors, with the same result as scanning every vector against every centroid in every round. A
scan leaves a gap: how much farther the second nearest centroid is than the nearest. While centroids move, a vector's gap
shrinks by at most the drift of its own centroid and the largest drift of another. So each cluster keeps the drift added up
so far and a heap of its vectors by gap plus the drift there was when they were scanned: those whose gap may have expired are
on top, and only they are popped and rescanned exactly. A cluster whose top still holds is not looked into.

Vectors stand in blocks with the heaps of their clusters; a block is a row of a table, formed where its vectors are read, so
nothing is shuffled and no vector, however common, gathers others around it. A round is one pass over the blocks that sends
back, for each cluster, what vectors moved in and out have changed in its sum: clusters x components numbers a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from decimal import Decimal
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlens.llm.common import only, small, stored

CLUSTERS, ROUNDS, DIM, SCALE = 16, 3, 64, 64
#: Vectors of a block.
BLOCK = 4096

#: Up to this size of a component sums of products are exact in double precision; larger ones are Python's integers.
_EXACT = 1 << 20
_LONGEST = (1 << 63) - 1
#: Share of a length by which rounding may be wrong, far more than it is; a gap that small counts as expired.
_SLACK = 1e-9


def distances(x: np.ndarray, centroids: list[list[int]]) -> np.ndarray:
    """Squared distances of integer vectors to integer centroids, exact: int64, or Python's integers if they are large."""
    most = max([abs(int(x.min())), abs(int(x.max())), *(abs(v) for c in centroids for v in c)], default=0) if x.size else 0
    if most <= _EXACT:
        a, c = x.astype(np.float64), np.array(centroids, np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ c.T) + (c * c).sum(1)).astype(np.int64)
    a = x.astype(object)
    return np.stack([((a - np.array(c, object)) ** 2).sum(1) for c in centroids], 1)


def scan(x: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """(nearest centroid, the smaller number in a tie; gap to the second nearest), never a gap that is too large."""
    d = distances(x, centroids)
    own = d.argmin(1) if len(d) else np.zeros(0, np.int64)
    if len(centroids) == 1:
        return own, np.full(len(x), np.inf)
    upper, lower = (np.sqrt(s.astype(np.float64)) for s in np.sort(d, axis=1)[:, :2].T)
    return own, lower - upper - _SLACK * (1 + lower + upper)


@dataclass
class Bounds:
    """What the driver knows: the centroids, the drift that each cluster's gaps must have borne, sums and sizes."""

    centroids: list[list[int]]
    drift: list[float] = field(default_factory=list)
    sums: list[list[int]] = field(default_factory=list)
    sizes: list[int] = field(default_factory=list)

    def __post_init__(self) -> None:
        k, dim = len(self.centroids), len(self.centroids[0])
        self.drift, self.sizes, self.sums = [0.0] * k, [0] * k, [[0] * dim for _ in range(k)]

    def change(self, cluster: int, n: int, by: list[int]) -> None:
        self.sizes[cluster] += n
        self.sums[cluster] = [a + b for a, b in zip(self.sums[cluster], by)]

    def move(self) -> None:
        """Centroids to the floor of their vectors' mean; empty ones stay. Every gap has borne its share of that afterwards."""
        new = [[s // n for s in sums] if n else old for old, sums, n in zip(self.centroids, self.sums, self.sizes)]
        moved = [sum((a - b) ** 2 for a, b in zip(c, d)) ** 0.5 for c, d in zip(self.centroids, new)]
        for c in range(len(new)):
            others = max(moved[:c] + moved[c + 1:], default=0.0)
            self.drift[c] += (moved[c] + others) * (1 + _SLACK)
        self.centroids = new


class Block:
    """Vectors and, for each cluster, a heap of (gap + drift when scanned, vector)."""

    def __init__(self, x: np.ndarray, heaps: list[list[tuple[float, int]]]):
        self.x, self.heaps = x, heaps

    @classmethod
    def scanned(cls, x: np.ndarray, bounds: Bounds) -> Block:
        own, gap = scan(x, bounds.centroids)
        heaps: list[list[tuple[float, int]]] = [[] for _ in bounds.centroids]
        for i, (c, g) in enumerate(zip(own.tolist(), gap.tolist())):
            heaps[c].append((g + bounds.drift[c], i))
        for h in heaps:
            heapify(h)
        return cls(x, heaps)

    def expired(self, bounds: Bounds) -> list[tuple[int, int]]:
        """Pops (vector, its cluster) of all whose gap the drift may have used up."""
        out = []
        for c, (h, drift) in enumerate(zip(self.heaps, bounds.drift)):
            limit = drift * (1 + _SLACK)
            while h and h[0][0] <= limit:
                out.append((heappop(h)[1], c))
        return out

    def advance(self, bounds: Bounds) -> list[tuple[int, int, int]]:
        """Rescans what has expired; returns the (vector, old cluster, new cluster) that this moves."""
        popped = self.expired(bounds)
        if not popped:
            return []
        own, gap = scan(self.x[[i for i, _ in popped]], bounds.centroids)
        moved = []
        for (i, old), c, g in zip(popped, own.tolist(), gap.tolist()):
            heappush(self.heaps[c], (g + bounds.drift[c], i))
            if c != old:
                moved.append((i, old, c))
        return moved

    def clusters(self) -> np.ndarray:
        own = np.zeros(len(self.x), np.int64)
        for c, h in enumerate(self.heaps):
            own[[i for _, i in h]] = c
        return own


class _Changes:
    """What a task's vectors add to the clusters' sums."""

    def __init__(self, k: int, dim: int):
        self.n = np.zeros(k, np.int64)
        self.sums = np.zeros((k, dim), object)

    def add(self, cluster: np.ndarray, x: np.ndarray, sign: int) -> None:
        self.n += sign * np.bincount(cluster, minlength=len(self.n))
        wide = x.astype(np.int64 if x.size and max(abs(int(x.min())), abs(int(x.max()))) <= _EXACT else object)
        for c in np.unique(cluster):
            self.sums[c] += sign * wide[cluster == c].sum(0).astype(object)


_STATE = "ids array<long>, vectors binary, width int, gaps array<array<double>>, members array<array<int>>"
_CHANGE = "cluster int, n long, sums array<decimal(38,0)>"


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def _read(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[pa.Array, Block]]:
    for batch in small(batches, 4):
        cols = [_column(batch, n) for n in ("ids", "vectors", "width", "gaps", "members")]
        for ids, vectors, width, gaps, members in zip(*cols):
            x = np.frombuffer(vectors.as_py(), f"<i{width.as_py()}").reshape(-1, dim)
            yield ids.values, Block(x, [list(zip(*h)) for h in zip(gaps.as_py(), members.as_py())])


def _written(ids: pa.Array, block: Block) -> pa.RecordBatch:
    heaps = block.heaps
    cols = [pa.array([ids.to_pylist()], pa.list_(pa.int64())), pa.array([np.ascontiguousarray(block.x).tobytes()], pa.binary()),
            pa.array([block.x.dtype.itemsize], pa.int32()),
            pa.array([[[g for g, _ in h] for h in heaps]], pa.list_(pa.list_(pa.float64()))),
            pa.array([[[i for _, i in h] for h in heaps]], pa.list_(pa.list_(pa.int32())))]
    none = [pa.nulls(1, pa.int32()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.list_(pa.decimal128(38, 0)))]
    return pa.RecordBatch.from_arrays([*cols, *none], ["ids", "vectors", "width", "gaps", "members", "cluster", "n", "sums"])


def _changed(changes: _Changes) -> pa.RecordBatch:
    some = [c for c in range(len(changes.n)) if changes.n[c] or any(changes.sums[c])]
    none = [pa.nulls(len(some), t) for t in (pa.list_(pa.int64()), pa.binary(), pa.int32(), pa.list_(pa.list_(pa.float64())), pa.list_(pa.list_(pa.int32())))]
    cols = [pa.array(some, pa.int32()), pa.array([int(changes.n[c]) for c in some], pa.int64()),
            pa.array([[Decimal(int(v)) for v in changes.sums[c]] for c in some], pa.list_(pa.decimal128(38, 0)))]
    return pa.RecordBatch.from_arrays([*none, *cols], ["ids", "vectors", "width", "gaps", "members", "cluster", "n", "sums"])


def quantised(vectors: DataFrame, id_col: str, vector_col: str, dim: int, scale: int) -> DataFrame:
    """(vec_id, q): vectors of ``dim`` components, none null or not finite, each component x as floor(``scale`` * x)."""
    rows = only(vectors, vec_id=id_col, v=vector_col).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("v").cast("array<double>").alias("v"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return (rows.filter(F.col("v").isNotNull() & (F.size("v") == dim) & F.forall("v", finite))
            .select("vec_id", F.transform("v", lambda x: F.floor(x * F.lit(float(scale)))).alias("q")))


def _width(x: np.ndarray) -> int:
    return next(w for w in (1, 2, 4, 8) if w == 8 or (x.min() >= -(1 << 8 * w - 1) and x.max() < 1 << 8 * w - 1))


def cluster(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", clusters: int = CLUSTERS, rounds: int = ROUNDS,
            dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of every kept vector.

    Centroids start as the vectors with the smallest SHA-256 of ``1:<vec_id>``; ties (an id in several rows) go to the smaller
    vector. Null vectors, those of another length and those with a null or infinite component or NaN take no part. Fewer
    vectors than ``clusters`` make fewer centroids; equal centroids leave the later one empty. A null id counts as an empty text in
    that hash; each of repeated rows counts; an empty table gives no rows; other columns are ignored. Integers beyond 64 bits (components,
    distances, sums of them) are the largest number of 64 bits.
    """
    spark = vectors.sparkSession
    rows = quantised(vectors, id_col, vector_col, dim, scale)
    by_hash = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    first = rows.orderBy(by_hash, "q").limit(clusters).select("q").collect()     # clusters x dim numbers
    if not first:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    bounds = Bounds([list(r["q"]) for r in first])
    k = len(first)

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        changes = _Changes(k, dim)
        for batch in small(batches, BLOCK):
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            if len(x):
                block = Block.scanned(x.astype(f"<i{_width(x)}"), bounds)
                changes.add(block.clusters(), x, 1)
                yield _written(batch.column(0), block)
        yield _changed(changes)

    def advance(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        changes = _Changes(k, dim)
        for ids, block in _read(batches, dim):
            moved = block.advance(bounds)
            if moved:
                i, old, new = (np.array(m) for m in zip(*moved))
                changes.add(old, block.x[i], -1)
                changes.add(new, block.x[i], 1)
            yield _written(ids, block)
        yield _changed(changes)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, block in _read(batches, dim):
            block.advance(bounds)
            own, distance = block.clusters(), np.zeros(len(block.x), object)
            for c in np.unique(own):
                distance[own == c] = distances(block.x[own == c], [bounds.centroids[c]])[:, 0]
            distance = np.minimum(distance, _LONGEST).astype(np.int64)
            yield pa.RecordBatch.from_arrays([ids, pa.array(own.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])

    blocks: DataFrame | None = None
    for _ in range(rounds):
        step, source = (start, rows) if blocks is None else (advance, blocks)
        state = stored(source.mapInArrow(step, f"{_STATE}, {_CHANGE}"), "blocks")
        sums = [F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(dim)]
        for r in state.filter("cluster is not null").groupBy("cluster").agg(F.sum("n").alias("n"), *sums).collect():   # a row a cluster
            bounds.change(r["cluster"], r["n"], [int(r[f"s{i}"]) for i in range(dim)])
        blocks = state.filter("cluster is null")
        bounds.move()
    found = stored(blocks.mapInArrow(settle, "vec_id long, cluster int, distance long"), "clustered")
    each = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("inertia")).collect()     # a row a cluster
    digest = lambda c: hashlib.sha256(",".join(map(str, bounds.centroids[c])).encode()).hexdigest()
    total = min(sum(int(r["inertia"]) for r in each), _LONGEST)
    named = spark.createDataFrame([(r["cluster"], min(int(r["inertia"]), _LONGEST), total, digest(r["cluster"])) for r in each],
                                  "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(named), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
