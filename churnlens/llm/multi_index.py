"""Approximate nearest neighbours with an inverted multi-index (operator 10).

The two halves of a vector are quantised separately, each with a codebook of its own, so a few centroids a half make
their square of cells. A query walks the cells in the order of the summed distances of its halves to the two
centroids: a heap holds the next pairs, and taking the pair (i, j) puts (i + 1, j) and (i, j + 1) on it. It stops when
the cells taken hold enough different vectors. The entries of these cells are then ranked by their true distance.

Every usable vector is in exactly one cell. The cells of one left centroid are a row of the index; a query sends each row
the list of cells that it probes there, so there are queries x centroids messages at most, not queries x cells. Rows with
many entries are dealt out in parts, and so are the queries that probe one row, so neither a common vector nor a common
query is one task's work; each part sends only its own nearest.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlens.llm.common import shuffle_width, small, stored

#: Centroids of each half.
CENTROIDS = 192
#: Vectors that the codebooks are learnt from, at most, and rounds of k-means.
SAMPLE, ROUNDS = 10_000, 12
#: Share of all different vectors that a query's cells hold, at least. Vectors without any structure need as much as this for a recall
#: of 0.9; clustered ones far less.
PROBED = 0.32
#: Entries, and queries, that one part of an index row holds, about; and queries ranked at once.
PART, AT_ONCE = 4096, 128


@dataclass
class Index:
    """Codebooks of the two halves, and how many different vectors each cell holds."""

    left: np.ndarray
    right: np.ndarray
    counts: np.ndarray

    def cells(self, vectors: np.ndarray) -> np.ndarray:
        half = self.left.shape[1]
        return nearest(vectors[:, :half], self.left) * len(self.right) + nearest(vectors[:, half:], self.right)

    def probes(self, vector: np.ndarray, enough: int) -> list[int]:
        """Cells in the order of summed distance, until they hold ``enough`` different vectors."""
        half = self.left.shape[1]
        da = ((self.left - vector[:half]) ** 2).sum(1)
        db = ((self.right - vector[half:]) ** 2).sum(1)
        oa, ob = np.argsort(da, kind="stable"), np.argsort(db, kind="stable")
        heap, seen, out, held = [(da[oa[0]] + db[ob[0]], 0, 0)], {(0, 0)}, [], 0
        while heap and held < enough:
            _, i, j = heapq.heappop(heap)
            cell = int(oa[i] * len(ob) + ob[j])
            if self.counts[cell]:
                out.append(cell)
                held += int(self.counts[cell])
            for x, y in ((i + 1, j), (i, j + 1)):
                if x < len(oa) and y < len(ob) and (x, y) not in seen:
                    seen.add((x, y))
                    heapq.heappush(heap, (da[oa[x]] + db[ob[y]], x, y))
        return out


def nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return ((centroids ** 2).sum(1) - 2 * x @ centroids.T).argmin(1)


def kmeans(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """Lloyd's rounds from distinct points; a centroid that loses all its points stays."""
    rng = np.random.default_rng(seed)
    x = np.unique(x, axis=0)
    c = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        own = nearest(x, c)
        n = np.bincount(own, minlength=len(c))
        sums = np.stack([np.bincount(own, weights=x[:, d], minlength=len(c)) for d in range(x.shape[1])], 1)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v): vectors with an id, neither null, empty nor zero, all components finite."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    v = F.col("v")
    return (vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
            .filter(F.col("vec_id").isNotNull() & v.isNotNull() & F.forall(v, finite) & F.exists(v, lambda x: x != 0)))


def _parts(n: np.ndarray) -> np.ndarray:
    return np.maximum(1, -(-n // PART)).astype(np.int64)


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding",
           centroids: int = CENTROIDS, sample: int = SAMPLE, probed: float = PROBED) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found by Euclidean distance in double precision.

    ``queries`` has the columns of ``vectors``; a query's own id is no candidate. Ties go to the smaller id. Vectors that are
    null, empty, zero or hold a null or a number that is not finite take no part, on either side; those of another length
    than most are of another space and take no part either. Of rows with a repeated id each is a
    candidate, and the id is reported once, with the nearest. Fewer candidates than ``k`` are all found. Empty tables give no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    rows, asked = usable(vectors, id_col, vector_col), usable(queries, id_col, vector_col)
    schema = "query_id long, rank int, vec_id long, score double"
    lengths = rows.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").first()
    if lengths is None:
        return spark.createDataFrame([], schema)
    dim, total = lengths
    # a vector that an id has in many rows is one candidate
    rows = rows.filter(F.size("v") == dim).distinct()
    asked = asked.filter(F.size("v") == dim).distinct().repartition(shuffle_width(spark))      # few bytes, but much work each
    # codebooks: a bounded sample, the vectors whose ids have the smallest hashes
    share = min(1.0, 0.9 * sample / total)
    some = rows.filter(F.pmod(F.xxhash64("vec_id"), F.lit(1_000_000)) < 1_000_000 * share).limit(sample).toPandas()
    x = np.array(some["v"].tolist(), float).reshape(-1, dim)
    if not len(x):
        x = np.array([rows.first()["v"]])
    half = dim // 2
    index = Index(kmeans(x[:, :half], centroids, ROUNDS, 1), kmeans(x[:, half:], centroids, ROUNDS, 2), np.zeros(0, np.int64))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, 4096):
            cell = index.cells(_matrix(batch.column(1), dim)) if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cell.astype(np.int32))], ["vec_id", "v", "cell"])

    entries = stored(rows.mapInArrow(assign, "vec_id long, v array<double>, cell int"), "multi-index")
    columns = len(index.right)
    index.counts, by_cell = (np.zeros(len(index.left) * columns, np.int64) for _ in range(2))  # centroids^2 numbers at most
    # by value and cell first: a vector's copies are added up before they are dealt out
    values = entries.groupBy("cell", F.xxhash64("v").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    for cell, different, n in values.groupBy("cell").agg(F.count(F.lit(1)).alias("different"), F.sum("n").alias("n")).collect():
        index.counts[cell], by_cell[cell] = different, n
    enough = max(4 * k, int(np.ceil(probed * index.counts.sum())))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, 256):
            x = _matrix(batch.column(1), dim) if batch.num_rows else np.zeros((0, dim))
            at, line, asked_of = [], [], []
            for i, v in enumerate(x):
                cells = np.sort(np.array(index.probes(v, enough), np.int64))
                own, first = np.unique(cells // columns, return_index=True)
                at += [i] * len(own)
                line += own.tolist()
                asked_of += np.split(cells % columns, first[1:])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), batch.column(1).take(pa.array(at, pa.int64())),
                                              pa.array(line, pa.int32()), pa.array(asked_of, pa.list_(pa.int32()))], ["vec_id", "v", "line", "cells"])

    probes = stored(asked.mapInArrow(probe, "vec_id long, v array<double>, line int, cells array<int>"), "probes")
    by_line = np.zeros(len(index.left), np.int64)
    for line, n in probes.groupBy("line").agg(F.count(F.lit(1)).alias("n")).collect():
        by_line[line] = n
    parts = zip(_parts(by_cell.reshape(-1, columns).sum(1)), _parts(by_line))
    splits = F.broadcast(spark.createDataFrame([(i, int(a), int(b)) for i, (a, b) in enumerate(parts)], "line int, entry_parts long, query_parts long"))
    part = lambda of: F.pmod(F.xxhash64("vec_id", "v"), F.col(of))  # noqa: E731   an id in many rows is dealt out by its vectors
    all_of = lambda of: F.explode(F.sequence(F.lit(0).cast("long"), F.col(of) - 1))
    left = (entries.withColumn("line", F.floor(F.col("cell") / columns).cast("int")).withColumn("cell", F.col("cell") % columns).join(splits, "line")
            .select("line", part("entry_parts").alias("e"), all_of("query_parts").alias("q"), "vec_id", "v", "cell"))
    right = probes.join(splits, "line").select("line", all_of("entry_parts").alias("e"), part("query_parts").alias("q"), "vec_id", "v", "cells")

    def rank(entry: pd.DataFrame, query: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})]
        if len(entry) and len(query):
            entry = entry.sort_values("vec_id", kind="stable")
            ids, x, cell = entry["vec_id"].to_numpy(), np.stack(entry["v"].to_numpy()), entry["cell"].to_numpy()
            first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
            repeated = len(first) < len(ids)
            lengths = (x ** 2).sum(1)
            for i in range(0, len(query), AT_ONCE):
                some = query.iloc[i:i + AT_ONCE]
                v, q_ids = np.stack(some["v"].to_numpy()), some["vec_id"].to_numpy()
                probed_cells = np.zeros((len(some), columns), bool)
                for j, cells in enumerate(some["cells"]):
                    probed_cells[j, cells] = True
                about = lengths - 2 * v @ x.T                # squared distances less the query's own, nearly
                about[~probed_cells[:, cell] | (ids[None, :] == q_ids[:, None])] = np.inf
                for q, own, d in zip(q_ids, v, about):
                    nearest_of = np.minimum.reduceat(d, first) if repeated else d         # one place for an id, however often it is there
                    m = min(len(nearest_of), k) - 1
                    edge = np.partition(nearest_of, m)[m]
                    near = np.flatnonzero((d <= edge + 1e-9 * (1 + abs(edge))) & np.isfinite(d)) if np.isfinite(edge) else np.flatnonzero(np.isfinite(d))
                    exact = np.sqrt(((x[near] - own) ** 2).sum(1))
                    order = np.lexsort((ids[near], exact))
                    if repeated:
                        order = order[np.sort(np.unique(ids[near][order], return_index=True)[1])]
                    order = order[:k]
                    out.append(pd.DataFrame({"query_id": q, "vec_id": ids[near][order], "score": exact[order]}))
        return pd.concat(out, ignore_index=True)

    found = left.groupBy("line", "e", "q").cogroup(right.groupBy("line", "e", "q")).applyInPandas(rank, "query_id long, vec_id long, score double")
    best = (found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
            .groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("score", "vec_id"))), 1, k).alias("best")))   # k a probed part at most
    return best.select("query_id", F.posexplode("best").alias("p", "b")).select(
        "query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), F.col("b.score").alias("score"))
