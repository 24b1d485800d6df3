"""Best-fit packing by large-item matching (operator 13).

Only a document that is longer than a sequence is cut. Pieces above a third of a sequence meet at most in pairs: the largest
takes the largest other that still fits beside it. Shorter pieces follow, longest first, each into the smallest gap that
holds it, and open a new sequence only if none does.

That decision needs no piece, only how many there are of each length, so it is made for equal pieces and equal gaps at once:
``lay_out`` turns the counts (one number a length, whatever the data) into a plan of slots, each a run of the pieces of one
length in a run of sequences. Tasks number their pieces by length, offsets make these numbers global, and a piece looks its
place up in the plan. Texts are read once and never shuffled, and the packing is one over all documents, however they are dealt out.
"""

from __future__ import annotations

import bisect
import zlib
from array import array
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from churnlens.llm.common import only, small, stored
from churnlens.llm.token_ids import text_ids

WINDOW = 2048

#: Columns of a plan: pieces of ``length`` from number ``first`` on, ``n`` of them, stand from sequence ``sequence`` on,
#: ``copies`` side by side in each, the first of these at ``offset``.
PLAN = ["length", "first", "n", "copies", "sequence", "offset"]


class _Layout:
    """Sequences under construction, kept as runs of equal gap."""

    def __init__(self, counts: Mapping[int, int], window: int):
        self.window, self.left = window, {k: int(n) for k, n in counts.items() if n}
        self.done: dict[int, int] = {}                 # pieces of a length that have a place
        self.made = 0                                  # sequences
        self.gaps: list[int] = []                      # gaps that some sequence has, ascending
        self.runs: dict[int, list[tuple[int, int]]] = {}   # gap -> (first sequence, how many)
        self.plan: list[tuple[int, int, int, int, int, int]] = []

    def put(self, length: int, copies: int, sequence: int, sequences: int, offset: int) -> None:
        n, first = copies * sequences, self.done.get(length, 0)
        self.plan.append((length, first, n, copies, sequence, offset))
        self.done[length] = first + n
        self.left[length] -= n

    def open(self, sequences: int, *pieces: tuple[int, int]) -> None:
        """New sequences, each with these (length, copies)."""
        at = 0
        for length, copies in pieces:
            self.put(length, copies, self.made, sequences, at)
            at += length * copies
        self.free(self.window - at, self.made, sequences)
        self.made += sequences

    def free(self, gap: int, sequence: int, sequences: int) -> None:
        if gap and sequences:
            if gap not in self.runs:
                bisect.insort(self.gaps, gap)
            self.runs.setdefault(gap, []).append((sequence, sequences))

    def take(self, gap: int) -> tuple[int, int]:
        """The last run of a gap, which it loses."""
        run = self.runs[gap].pop()
        if not self.runs[gap]:
            del self.runs[gap]
            self.gaps.remove(gap)
        return run

    def match(self, large: list[int]) -> None:
        """Greedy matching, largest first; every step uses up a length (or leaves one piece of it)."""
        for a in reversed(large):
            while self.left[a]:
                i = bisect.bisect_right(large, min(a, self.window - a)) - 1
                while i >= 0 and self.left[large[i]] < (2 if large[i] == a else 1):
                    i -= 1
                if i < 0:
                    self.open(self.left[a], (a, 1))
                elif large[i] == a:
                    self.open(self.left[a] // 2, (a, 2))
                else:
                    self.open(min(self.left[a], self.left[large[i]]), (a, 1), (large[i], 1))

    def fill(self, length: int) -> None:
        """Best fit: a piece shrinks the smallest gap that holds it, which is then the smallest for the next one, until it holds none."""
        while self.left[length]:
            i = bisect.bisect_left(self.gaps, length)
            if i == len(self.gaps):
                break
            gap = self.gaps[i]
            sequence, sequences = self.take(gap)
            copies = min(gap // length, self.left[length])
            used = min(sequences, self.left[length] // copies)
            self.put(length, copies, sequence, used, self.window - gap)
            self.free(gap - copies * length, sequence, used)
            self.free(gap, sequence + used, sequences - used)
        while self.left[length]:
            copies = min(self.window // length, self.left[length])
            self.open(self.left[length] // copies, (length, copies))


def lay_out(counts: Mapping[int, int], window: int = WINDOW) -> np.ndarray:
    """Plan for so many pieces of each length (1 to ``window``): one row of ``PLAN`` a slot, sorted by length and first piece.

    Its size depends on the number of different lengths, not on the counts.
    """
    if any(not 1 <= k <= window for k in counts):
        raise ValueError("a piece has 1 to window tokens")
    layout = _Layout(counts, window)
    lengths = sorted(layout.left)
    layout.match([k for k in lengths if 3 * k > window])
    for k in reversed([k for k in lengths if 3 * k <= window]):
        layout.fill(k)
    return np.array(sorted(layout.plan), np.int64).reshape(-1, len(PLAN))


def places(plan: np.ndarray, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of the pieces that are ``number``-th of their ``length``."""
    key = lambda k, n: (k << 50) + n
    slot = plan[np.searchsorted(key(plan[:, 0], plan[:, 1]), key(length, number), side="right") - 1]
    within = number - slot[:, 1]
    return slot[:, 4] + within // slot[:, 3], slot[:, 5] + within % slot[:, 3] * length


def cut(n: int, window: int) -> Iterator[tuple[int, int]]:
    """(start, end) of a document's pieces: full ones behind a first that may be shorter."""
    end = n % window or min(n, window)
    start = 0
    while start < n:
        yield start, end
        start, end = end, end + window


def pack(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, window: int = WINDOW) -> DataFrame:
    """Pieces laid into as few sequences of at most ``window`` tokens as the method finds: ``doc_id, piece, start, length,
    ids_crc32, sequence_id, offset``.

    A document's tokens are its text's ids and ``end_id``. One of at most ``window`` tokens is one piece; a longer one is cut
    into pieces of ``window``, the first of which may be shorter. Null and empty texts have the one token ``end_id``; repeated
    rows are packed each for itself; a null id stays null; an empty table gives no pieces; other columns are ignored. Equal
    lengths are interchangeable: which of them stands where depends on the tasks, how many sequences there are does not.
    """
    rows = only(docs, doc_id=id_col, text=text_col)
    spark = docs.sparkSession
    with open(vocabulary, encoding="utf-8") as f:
        conf = spark.sparkContext.broadcast(f.read())      # the vocabulary, whatever the data
    kind = rows.schema["doc_id"].dataType.simpleString()
    end = array("I", [end_id]).tobytes()
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task, seen = text_ids(conf.value), TaskContext.get().partitionId(), [0] * (window + 1)
        for batch in small(batches, 512):
            key_type = batch.schema.field(0).type
            cols: list[list] = [[] for _ in names]
            for key, ids in zip(batch.column(0).to_pylist(), encode.many(batch.column(1).to_pylist())):
                ids += end
                for i, (a, b) in enumerate(cut(len(ids) // 4, window)):
                    for c, v in zip(cols, (key, i, a, b - a, zlib.crc32(ids[4 * a:4 * b]), task, seen[b - a])):
                        c.append(v)
                    seen[b - a] += 1
            kinds = [key_type, pa.int32(), *[pa.int64()] * 5]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

    made = stored(rows.mapInArrow(pieces, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, task long, nth long"), "pieces")
    counted = stored(made.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n")), "counted")        # a row a task and length
    counts = {r["length"]: r["n"] for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}   # window rows at most
    plan = spark.sparkContext.broadcast(lay_out(counts, window))
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = counted.select("length", "task", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *own, before, nth = batch.columns
            sequence, offset = places(plan.value, own[3].to_numpy(), before.to_numpy() + nth.to_numpy())
            yield pa.RecordBatch.from_arrays([*own, pa.array(sequence), pa.array(offset)], [*names[:5], "sequence_id", "offset"])

    return (made.join(before.hint("merge"), ["length", "task"]).select(*names[:5], "before", "nth")
            .mapInArrow(placed, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"))
