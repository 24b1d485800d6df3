"""Near-duplicates by MinHash with tensored banding (operator 9).

A table key of plain banding takes K minhashes of its own. Here two collections of ``SIDES`` short keys of
``ROWS`` minhashes each are made, and the table keys are all pairs of a short key from the one and a short key
from the other: ``SIDES``^2 tables from 2 * SIDES * ROWS minhashes. Two sets meet in a table if they agree in a
short key of each collection. At a similarity of 0.8 that fails once in some ten thousand links.

Texts with equal sets are one representative. Representatives that meet are compared on their full sets:

* in tables' buckets of up to ``SMALL`` representatives every pair;
* in larger ones each with the bucket's first. Links found so far make components. Buckets that overlap are then
  taken together as a cluster; what is not in the cluster's largest component is compared with everything in the
  cluster that is not in its own component, block by block, so no cluster is ever in one task, and no pair that
  could join two components is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlens.llm.common import only, shuffle_width, small, stored
from churnlens.llm.graph import components
from churnlens.llm.words import hashes, mixed, window_hashes

WORDS = 4
#: Links have at least this many hundredths of the union in common.
SIMILARITY = 80
ROWS, SIDES = 2, 8
SMALL = 8
BLOCK = 256
#: Share of the minhashes in which a pair has to agree before its full sets are fetched: a link at the similarity of 0.8 agrees
#: in 25.6 of 32 on average, and in fewer than 15 with a probability of 2 in a million.
AGREEING = 0.45

_SLICE = 1 << 15


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; the whole sequence as one if there are fewer words."""
    found = text.encode().lower().split() if text else []   # bytes.lower() changes A-Z alone
    return np.unique(window_hashes(hashes(found), min(k, len(found)))) if found else np.zeros(0, np.uint64)


_RANDOM = np.random.default_rng(20240607)
_FACTORS = _RANDOM.integers(1 << 62, size=2 * 64 * 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TERMS = _RANDOM.integers(1 << 63, size=2 * 64 * 8, dtype=np.uint64)


def minhashes(members: np.ndarray, n: int) -> np.ndarray:
    """Smallest values of ``n`` hash functions over a set (upper 32 bits)."""
    out = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(members), _SLICE):
        out = np.minimum(out, (members[i:i + _SLICE, None] * _FACTORS[:n] + _TERMS[:n]).min(0))
    return (out >> np.uint64(32)).astype(np.uint32)


def table_keys(signature: np.ndarray, rows: int, sides: int) -> np.ndarray:
    """All pairs of a short key from either collection, as 64-bit numbers that tell the tables apart."""
    short = signature.reshape(2, sides, rows).astype(np.uint64)
    folded = np.zeros((2, sides), np.uint64)
    for r in range(rows):
        folded = mixed(folded * np.uint64(31) + short[:, :, r] + np.uint64(r + 1))
    number = np.arange(sides * sides, dtype=np.uint64).reshape(sides, sides)
    return mixed(mixed(folded[0][:, None] + number) ^ (folded[1][None, :] * np.uint64(0x9E3779B97F4A7C15))).ravel()


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64), pa.int64())


def _signatures(docs: DataFrame, k: int, rows: int, sides: int) -> DataFrame:
    """(doc_id, n_shingles, set_key, signature): ``set_key`` is a 128-bit hash of the whole set, null if empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            sizes, keys, sigs = [], [], []
            for text in batch.column(1).to_pylist():
                s = shingles(text, k)
                sizes.append(len(s))
                keys.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                sigs.append(minhashes(s, 2 * rows * sides).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary())],
                                             ["doc_id", "n_shingles", "set_key", "signature"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, set_key binary, signature binary")


def _buckets(reps: DataFrame, rows: int, sides: int) -> DataFrame:
    """(key, rep): a row for each representative and table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, 2048):
            keys = [table_keys(np.frombuffer(s, np.uint32), rows, sides) for s in batch.column(1).to_pylist()]
            if keys:
                yield pa.RecordBatch.from_arrays([_signed(np.concatenate(keys)), pa.array(np.repeat(batch.column(0).to_numpy(), sides * sides))], ["key", "rep"])

    # few bytes, but many rows come of each
    return reps.select("rep", "signature").repartition(shuffle_width(reps.sparkSession)).mapInArrow(run, "key long, rep long")


def _sets(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """(rep, members): full sets of the representatives asked for; a row for each row that has the id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            sets = [shingles(t, k) for t in batch.column(1).to_pylist()]
            bounds = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(bounds, _signed(np.concatenate([*sets, np.zeros(0, np.uint64)])))], ["rep", "members"])

    # by merging at every size: how many representatives are asked for has no bound, and the plan is the same on small tables
    return docs.join(ids.hint("merge"), "doc_id", "left_semi").mapInArrow(run, "rep long, members array<long>")


def _different_sets(docs: DataFrame, ids: DataFrame, signed: DataFrame, k: int) -> DataFrame:
    """(rep, members): a row for each different set that rows with the id have. Sets are moved only for ids in several rows."""
    many = stored(signed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 and doc_id is not null").select("doc_id"), "repeated")
    if many.isEmpty():
        return _sets(docs, ids, k)
    return _sets(docs, ids.join(many, "doc_id", "left_anti"), k).unionByName(_sets(docs, ids.join(many, "doc_id", "left_semi"), k).distinct())


def linked(a: np.ndarray, b: np.ndarray, similarity: int) -> bool:
    """Have two sets (sorted distinct numbers) enough in common? Exact."""
    if 100 * min(len(a), len(b)) < similarity * max(len(a), len(b)):
        return False
    if len(a) > len(b):
        a, b = b, a
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    both = int((b[at] == a).sum())
    return 100 * both >= similarity * (len(a) + len(b) - both)


def _likely(pairs: DataFrame, reps: DataFrame, similarity: int) -> DataFrame:
    """Pairs whose sizes allow the similarity and whose minhashes agree often enough."""
    own = lambda c: reps.select(F.col("rep").alias(c), F.col("n_shingles").alias(f"n_{c}"), F.col("signature").alias(f"s_{c}"))
    near = pairs.join(own("b"), "b").join(own("a"), "a").filter(100 * F.least("n_a", "n_b") >= similarity * F.greatest("n_a", "n_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, 4096):
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint32).reshape(batch.num_rows, -1) for i in (2, 3))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array((x == y).mean(1) >= AGREEING if len(x) else [], pa.bool_()))

    return near.select("a", "b", "s_a", "s_b").mapInArrow(run, "a long, b long")


def _confirmed(pairs: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """Pairs (a, b) whose full sets are similar. Compared pair by pair in Spark: batches of pairs, each with two sets of any size, would have no bound."""
    first = sets.select(F.col("rep").alias("a"), F.col("members").alias("set_a"))
    second = sets.select(F.col("rep").alias("b"), F.col("members").alias("set_b"))
    size = lambda c: F.size(c).cast("long")
    both = pairs.join(second, "b").join(first, "a").select("a", "b", (size("set_a") + size("set_b")).alias("n"), size(F.array_intersect("set_a", "set_b")).alias("both"))
    return both.filter(100 * F.col("both") >= similarity * (F.col("n") - F.col("both"))).select("a", "b")


def _cluster_links(star: DataFrame, found: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """Links that the comparison with first ones has left open in clusters of large buckets."""
    members = components(star).select(F.col("id").alias("rep"), F.col("component").alias("cluster"))
    members = (members.join(found.select(F.col("id").alias("rep"), "component"), "rep", "left")
               .withColumn("component", F.coalesce("component", "rep")))
    sizes = members.groupBy("cluster", "component").agg(F.count(F.lit(1)).alias("n"))
    main = stored(sizes.groupBy("cluster").agg(F.max(F.struct("n", "component")).alias("most"), F.sum("n").alias("all_n"))
            .select("cluster", F.col("most.component").alias("main"), "all_n", (F.col("all_n") - F.col("most.n")).alias("rest_n"))
            .filter("rest_n > 0"), "clusters")
    members = stored(members.join(main, "cluster").select(
        "cluster", "rep", "component", (F.col("component") != F.col("main")).alias("rest"),
        F.ceil(F.col("all_n") / BLOCK).cast("int").alias("all_blocks"), F.ceil(F.col("rest_n") / BLOCK).cast("int").alias("rest_blocks")), "members")
    full = members.join(sets, "rep")
    own = lambda of: F.pmod(F.xxhash64("rep"), F.col(of)).cast("int")
    rest = full.filter("rest").select("*", own("rest_blocks").alias("i"), F.explode(F.sequence(F.lit(0), F.col("all_blocks") - 1)).alias("j"), F.lit(True).alias("left"))
    every = full.select("*", F.explode(F.sequence(F.lit(0), F.col("rest_blocks") - 1)).alias("i"), own("all_blocks").alias("j"), F.lit(False).alias("left"))
    cols = ["cluster", "i", "j", "left", "rep", "component", "members"]

    def run(group: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple[int, int]] = []
        same: dict[int, int] = {}

        def root(c: int) -> int:
            while same.get(c, c) != c:
                c = same[c]
            return c

        x, y = group[group["left"]], group[~group["left"]]
        other = [(rep, c, np.asarray(m, np.int64).view(np.uint64)) for rep, c, m in zip(y["rep"], y["component"], y["members"])]
        for rep, c, m in zip(x["rep"], x["component"], x["members"]):
            mine = np.asarray(m, np.int64).view(np.uint64)
            for rep_b, c_b, theirs in other:
                if root(c) != root(c_b) and linked(mine, theirs, similarity):
                    same[root(c)] = root(c_b)
                    found.append((rep, rep_b))
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return rest.select(*cols).unionByName(every.select(*cols)).groupBy("cluster", "i", "j").applyInPandas(run, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = WORDS, similarity: int = SIMILARITY,
                    rows: int = ROWS, sides: int = SIDES) -> DataFrame:
    """Per document ``doc_id, n_shingles, component_id, kept``: its component's smallest id, and whether it is that.

    Documents are linked if their sets of ``k``-word shingles (A-Z lower-cased) have at least ``similarity`` hundredths
    of their union in common, copies included; components are what links reach. Null and empty texts, and texts
    without a word, have an empty set and are linked with nothing; fewer words than ``k`` are one shingle; texts of
    any length are taken whole. Rows with a repeated id each get a row; if their texts differ, that document is linked
    by any of them. A null id is linked with nothing and kept. An empty table gives no rows; other columns are ignored.
    """
    docs = only(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    signed = stored(_signatures(docs, k, rows, sides), "signatures")
    real = signed.filter("set_key is not null and doc_id is not null")
    reps = stored(real.groupBy("set_key").agg(F.min(F.struct("doc_id", "n_shingles", "signature")).alias("first"))
                  .select("set_key", F.col("first.doc_id").alias("rep"), "first.n_shingles", "first.signature"), "representatives")
    rows_in = _buckets(reps, rows, sides)
    # stored before it is joined: a join can deal out a frequent key's rows anew only if both sides come straight from a shuffle
    shared = stored(rows_in.groupBy("key").agg(F.min("rep").alias("hub"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "shared")
    held = stored(rows_in.join(shared, "key"), "buckets")
    star = held.filter((F.col("n") > SMALL) & (F.col("rep") != F.col("hub"))).select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct()
    lists = held.filter(F.col("n") <= SMALL).groupBy("key").agg(F.array_sort(F.collect_set("rep")).alias("r"))   # SMALL at most
    pairs = (lists.select(F.explode(F.expr("flatten(transform(r, (x, i) -> transform(slice(r, i + 2, size(r)), y -> struct(x as a, y as b))))")).alias("p"))
             .select("p.a", "p.b").distinct())
    star = stored(star, "star")
    pairs = stored(_likely(pairs.unionByName(star).distinct(), reps, similarity).distinct(), "pairs")
    ids = pairs.unionByName(star).select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    sets = stored(_different_sets(docs, ids, signed, k), "sets")
    links = stored(_confirmed(pairs, sets, similarity), "links")
    more = _cluster_links(star, components(links), sets, similarity)
    joined = components(links.unionByName(more)).select(F.col("id").alias("rep"), "component")
    by_set = reps.join(joined, "rep", "left").select("set_key", F.coalesce("component", "rep").alias("component"))
    out = signed.join(by_set, "set_key", "left").withColumn(
        "component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
