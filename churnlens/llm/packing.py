"""Bounded-space online packing of token sequences (operator 5).

Every task keeps a fixed number of open windows. A document that fills windows by itself is cut
into whole windows; what is left of it goes best-fit into an open window. When it fits into none,
the fullest open window is emitted and a new one takes its place. The windows still open at the
end of a task are the leftovers; they are few (a fixed number a task), and a second pass lays
those of several tasks end to end, cutting at the window's edge.
"""

from __future__ import annotations

import bisect
import zlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlens.llm.common import ceil_div, only, small, stored
from churnlens.llm.token_ids import text_ids

WINDOW = 1024
OPEN_WINDOWS = 64
#: Tasks whose leftovers one task of the second pass lays end to end.
MERGED_TASKS = 8

_PIECE = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


class Packer:
    """``window`` and ``open_windows``: ids a sequence holds, windows kept open. Emits closed windows as lists of pieces."""

    def __init__(self, window: int, open_windows: int):
        self.window, self.most = window, open_windows
        self.open: list[tuple[int, int, list]] = []    # (ids so far, when opened, pieces), emptiest first
        self._made = 0

    def add(self, key, start: int, ids: bytes, total: int) -> Iterator[list]:
        """Place ids [start, end) of a document; yields the windows that this closes."""
        step, at = 4 * self.window, 0
        while len(ids) - at >= step:
            yield [(key, start + at // 4, ids[at:at + step], total)]
            at += step
        if at < len(ids):
            yield from self._place((key, start + at // 4, ids[at:], total))

    def _place(self, piece: tuple) -> Iterator[list]:
        n = len(piece[2]) // 4
        i = bisect.bisect_right(self.open, self.window - n, key=lambda w: w[0]) - 1
        if i >= 0:                                     # the fullest one that still has room
            used, made, pieces = self.open.pop(i)
        else:
            if len(self.open) >= self.most:
                yield self.open.pop()[2]               # none fits: the fullest goes
            used, made, pieces = 0, self._made, []
            self._made += 1
        pieces.append(piece)
        if used + n == self.window:
            yield pieces
        else:
            bisect.insort(self.open, (used + n, made, pieces), key=lambda w: w[:2])

    def rest(self) -> list[list]:
        out, self.open = [w[2] for w in self.open], []
        return out


def _rows(windows: list[tuple[int, list]], kind: pa.DataType, closed: bool, task: int) -> pa.RecordBatch:
    cols: list[list] = [[] for _ in range(9)]
    for seq, pieces in windows:
        at = 0
        for key, start, ids, total in pieces:
            n = len(ids) // 4
            for c, v in zip(cols, (key, start, n, zlib.crc32(ids), total, seq, at, task, None if closed else ids)):
                c.append(v)
            at += n
    kinds = [kind, *[pa.int64()] * 7, pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], [*_PIECE, "task", "left_ids"])


def pack(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0,
         window: int = WINDOW, open_windows: int = OPEN_WINDOWS) -> DataFrame:
    """Pieces of sequences of at most ``window`` tokens: ``doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset``.

    A document's tokens are its text's ids and ``end_id``; each lies in exactly one piece. Null and empty
    texts have the one token ``end_id``; a long text is cut; repeated rows are packed each for itself; a null
    id stays null; an empty table gives no pieces; other columns are ignored. Sequence ids are unique, not gapless.
    """
    rows = only(docs, doc_id=id_col, text=text_col)
    with open(vocabulary, encoding="utf-8") as f:
        conf = docs.sparkSession.sparkContext.broadcast(f.read())
    kind = rows.schema["doc_id"].dataType.simpleString()
    end = array("I", [end_id]).tobytes()

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer, task = text_ids(conf.value), Packer(window, open_windows), TaskContext.get().partitionId()
        key_type, seq = None, task << 36
        for batch in small(batches, 512):
            key_type, done = batch.schema.field(0).type, []
            for key, ids in zip(batch.column(0).to_pylist(), encode.many(batch.column(1).to_pylist())):
                ids += end
                done.extend(packer.add(key, 0, ids, len(ids) // 4))
            yield _rows(list(enumerate(done, seq)), key_type, True, task)
            seq += len(done)
        if key_type is not None:
            yield _rows(list(enumerate(packer.rest(), seq)), key_type, False, task)

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq, used, pieces, key_type = (1 << 62) + (TaskContext.get().partitionId() << 36), 0, [], None
        for batch in batches:
            key_type, done = batch.schema.field(0).type, []
            for key, start, total, ids in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "start", "doc_tokens", "left_ids"))):
                while ids:
                    part, ids = ids[:4 * (window - used)], ids[4 * (window - used):]
                    pieces.append((key, start, part, total))
                    start, used = start + len(part) // 4, used + len(part) // 4
                    if used == window:
                        done.append(pieces)
                        used, pieces = 0, []
            yield _rows(list(enumerate(done, seq)), key_type, True, 0)
            seq += len(done)
        if pieces:
            yield _rows([(seq, pieces)], key_type, True, 0)

    schema = (f"doc_id {kind}, " + ", ".join(f"{c} long" for c in _PIECE[1:]) + ", task long, left_ids binary")
    packed = stored(rows.mapInArrow(first, schema), "packed")
    closed, left = packed.filter("left_ids is null"), packed.filter("left_ids is not null")
    return closed.select(*_PIECE).unionByName(_merge(left, second, schema).select(*_PIECE))


def _merge(left: DataFrame, second, schema: str) -> DataFrame:
    tasks = left.agg(F.countDistinct("task")).first()[0]
    groups = max(2, ceil_div(tasks, MERGED_TASKS))
    return left.repartition(groups, "task").mapInArrow(second, schema)
