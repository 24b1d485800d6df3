"""Repeated-phrase removal with Aho-Corasick automata (operator 3).

A window is ``window`` consecutive words. A word goes if a window that covers it also starts in a document with a
smaller id. Three passes over the documents:

1. *Find.* In every window one phrase of ``PHRASE`` words is picked, the one with the smallest hash, so equal windows
   pick equal phrases. Neighbouring windows mostly pick the same phrase, and give one row: the phrase, a hash of all
   words that these windows cover (the stretch), document and place. One aggregate finds the phrases of two documents
   or more.
2. *Confirm.* A stretch that a document with a smaller id has too is recurring as a whole. Where one phrase stands in
   different stretches (at the ends of passages), the windows in the first occurrence of each stretch are hashed and
   compared one by one. What comes out are passages, with the smallest document that has them.
3. *Cut.* Documents go through in shards, each with the passages confirmed for it, as far as its own words have them.
   A shard's passages are compiled into an Aho-Corasick automaton over words, and all documents of the shard are
   streamed through it. Each occurrence in a document that comes after the passage's first one is cut out.

Rows of a phrase are aggregated or joined, never gathered; a shard holds a bounded number of words (a single longer
document is a shard of its own), so neither a common passage nor a large group of copies is one task's work.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlens.llm.common import small, stored
from churnlens.llm.words import hashes, span_hashes, window_hashes, words

WINDOW = 50
#: Words of the phrase that is picked in a window.
PHRASE = 16
#: Words of the documents that one automaton is made for.
SHARD_WORDS = 200_000

#: Words are letters to the automaton; these many letters there are.
_LETTERS = 0x110000 - 0x800


def first_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the first smallest value in each run of ``width`` values."""
    at = np.arange(len(values))
    best, size = values, 1
    while size < width:
        step = min(size, width - size)
        later = best[step:] < best[:len(best) - step]
        at = np.where(later, at[step:], at[:len(at) - step])
        best = np.where(later, best[step:], best[:len(best) - step])
        size += step
    return at


def stretches(h: np.ndarray, window: int, phrase: int) -> tuple[np.ndarray, ...]:
    """(phrase hash, stretch hash, first window, windows) of the words' stretches."""
    if len(h) < window:
        return (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 2
    grams = window_hashes(h, phrase)
    at = first_minima(grams, window - phrase + 1)
    new = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    count = np.diff(np.concatenate([new, [len(at)]]))
    return grams[at[new]], span_hashes(h, new, new + count + window - 1), new, count


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64), pa.int64())


def _find(docs: DataFrame, window: int, phrase: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            found = [stretches(hashes(words(t)), window, phrase) for t in batch.column(1).to_pylist()]
            ids = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), [len(f[0]) for f in found])
            if len(ids):
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *[_long(np.concatenate([f[i] for f in found])) for i in range(4)]],
                                                 ["doc_id", "phrase", "stretch", "start", "n"])

    return docs.mapInArrow(run, "doc_id long, phrase long, stretch long, start long, n long")


def _windows(docs: DataFrame, firsts: DataFrame, window: int) -> DataFrame:
    """(phrase, hash, doc_id, start): every window of the stretches in ``firsts``."""
    asked = firsts.groupBy("doc_id").agg(F.collect_list(F.struct("phrase", "stretch", "start", "n")).alias("asked"))  # bounded by the text
    rows = docs.join(asked, "doc_id").select("doc_id", "text", "asked.phrase", "asked.stretch", "asked.start", "asked.n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            cols: list[list[np.ndarray]] = [[], [], [], []]
            for key, text, *lists in zip(*(c.to_pylist() for c in batch.columns)):
                h = hashes(words(text))
                phrase, stretch, start, n = _own(h, *lists, window)
                at = np.repeat(start, n) + _counted(n)
                for c, v in zip(cols, (np.repeat(phrase, n), span_hashes(h, at, at + window), np.full(len(at), key), at)):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([_long(np.concatenate(c)) for c in cols], ["phrase", "hash", "doc_id", "start"])

    return rows.mapInArrow(run, "phrase long, hash long, doc_id long, start long")


def _counted(n: np.ndarray) -> np.ndarray:
    """0 .. n-1 for each n, one after the other."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def _own(h: np.ndarray, kept: list, stretch: list, start: list, n: list, window: int) -> tuple[np.ndarray, ...]:
    """The stretches (and what is kept with each) that these words really have: another row with the same id may have others."""
    p, s, a, c = (np.array(x, np.int64) for x in (kept, stretch, start, n))
    fits = a + c + window - 1 <= len(h)
    p, s, a, c = p[fits], s[fits], a[fits], c[fits]
    ok = span_hashes(h, a, a + c + window - 1).view(np.int64) == s if len(a) else np.zeros(0, bool)
    return p[ok], s[ok], a[ok], c[ok]


def _passages(docs: DataFrame, window: int, phrase: int) -> DataFrame:
    """(doc_id, start, n, first, stretch): windows from ``start`` on that the smaller document ``first`` has too, and their words' hash."""
    # what is aggregated here is stored before it is joined: a join can deal out a frequent key's rows anew only if
    # both of its sides come straight from a shuffle
    found = stored(_find(docs, window, phrase), "phrases")
    recurring = stored(found.groupBy("phrase").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"),
                                                   (F.min("stretch") != F.max("stretch")).alias("mixed"))
                       .filter("first < last").select("phrase", "first", "mixed"), "recurring")
    # a row that is stored many times is one from here on: what it shares with others is joined and listed once
    places = stored(found.join(recurring, "phrase").distinct(), "places")
    whole = places.filter("not mixed and doc_id > first").select("doc_id", "start", "n", "first", "stretch")
    mixed_places = places.filter("mixed").drop("first", "mixed")
    known = stored(mixed_places.groupBy("phrase", "stretch").agg(F.min("doc_id").alias("first")), "stretches")
    settled = stored(mixed_places.join(known, ["phrase", "stretch"]), "settled")
    copied = settled.filter("doc_id > first").select("doc_id", "start", "n", "first", "stretch")
    each = stored(_windows(docs, settled.filter("doc_id = first"), window), "windows")
    earliest = stored(each.groupBy("phrase", "hash").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
                      .filter("first < last").drop("last"), "earliest")
    single = (each.join(earliest, ["phrase", "hash"]).filter("doc_id > first")
              .select("doc_id", "start", F.lit(1).cast("long").alias("n"), "first", F.col("hash").alias("stretch")).distinct())
    return whole.unionByName(copied).unionByName(single)


def runs(start: list[int], n: list[int], first: list[int], window: int) -> list[tuple[int, int, int]]:
    """Windows as maximal runs of words: (from, to, largest of the first documents)."""
    out: list[tuple[int, int, int]] = []
    for s, c, f in sorted(zip(start, n, first)):
        e = s + c + window - 1
        if out and s <= out[-1][1]:
            a, b, g = out[-1]
            out[-1] = a, max(b, e), max(g, f)
        else:
            out.append((s, e, f))
    return out


class Shard:
    """Some documents, the passages confirmed for them, and the automaton made of these."""

    def __init__(self) -> None:
        self._letters: dict[bytes, str] = {}
        self.docs: list[tuple[int | None, list[bytes], str]] = []
        self._passages: dict[str, int] = {}
        self.size = 0

    def add(self, doc_id: int | None, tokens: list[bytes], confirmed: list[tuple[int, int, int]]) -> None:
        letters = self._letters
        spelled = []
        for w in tokens:
            c = letters.get(w)
            if c is None:
                k = len(letters)
                c = letters[w] = chr(k if k < 0xD800 else k + 0x800)
            spelled.append(c)
        text = "".join(spelled)
        self.docs.append((doc_id, tokens, text))
        self.size += len(tokens)
        for a, b, first in confirmed:
            key = text[a:b]
            self._passages[key] = min(first, self._passages.get(key, first))

    def covered(self) -> Iterator[tuple[list[bytes], np.ndarray | None]]:
        """Each document's words, and which of them are covered (None: none)."""
        automaton = ahocorasick.Automaton()
        for key, first in self._passages.items():
            automaton.add_word(key, (len(key), first))
        if self._passages:
            automaton.make_automaton()
        for doc_id, tokens, text in self.docs:
            steps = None
            if self._passages and doc_id is not None:
                for end, (n, first) in automaton.iter(text):
                    if first < doc_id:
                        if steps is None:
                            steps = np.zeros(len(tokens) + 1, np.int64)
                        steps[end + 1 - n] += 1
                        steps[end + 1] -= 1
            yield tokens, None if steps is None else np.cumsum(steps[:-1]) > 0


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, phrase: int = PHRASE,
                as_is: bool = False) -> DataFrame:
    """All columns of ``docs``, the text cut to its kept words joined by one space, plus ``n_words`` and ``n_removed``.

    With ``as_is`` a text that loses no word stays as it is, white space included. Null and empty texts, and texts
    without a word, have no words and become empty (with ``as_is`` they stay); texts of any length are taken whole. Of
    repeated rows none is the smaller, so they lose what a smaller id has and nothing else; a document with a null id
    loses nothing and takes nothing from others. An empty table stays empty; columns named like the two new ones are replaced.
    """
    names = [c for c in docs.columns if c not in ("n_words", "n_removed")]
    plain = docs.select(*[F.col(f"`{c}`") for c in names])
    texts = plain.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).filter("doc_id is not null")
    passages = _passages(texts, window, phrase)
    by_doc = (passages.groupBy(F.col("doc_id").alias("_id"))
              .agg(F.collect_list(F.struct("start", "n", "first", "stretch")).alias("_p"))         # bounded by the id's different texts
              .select("_id", F.col("_p.start").alias("_start"), F.col("_p.n").alias("_n"), F.col("_p.first").alias("_first"), F.col("_p.stretch").alias("_stretch")))
    rows = plain.join(by_doc, F.col(f"`{id_col}`").cast("long") == F.col("_id"), "left").drop("_id")
    at, key, width = names.index(text_col), names.index(id_col), len(names)

    def finish(shard: Shard, held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = iter(shard.covered())
        for batch in held:
            kept, sizes, gone = [], [], []
            for old in batch.column(at).to_pylist():
                tokens, cover = next(done)
                left = tokens if cover is None else [w for w, c in zip(tokens, cover) if not c]
                sizes.append(len(tokens))
                gone.append(len(tokens) - len(left))
                kept.append(old if as_is and not gone[-1] else b" ".join(left).decode())
            cols = list(batch.columns[:width])
            cols[at] = pa.array(kept, pa.string())
            yield pa.RecordBatch.from_arrays([*cols, pa.array(sizes, pa.int64()), pa.array(gone, pa.int64())], [*names, "n_words", "n_removed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held = Shard(), []
        for batch in small(batches, 32):
            for doc_id, text, start, n, first, stretch in zip(*(batch.column(i).to_pylist() for i in (key, at, *range(width, width + 4)))):
                tokens = words(text)
                confirmed = []
                if start:
                    first, _, start, n = _own(hashes(tokens), first, stretch, start, n, window)
                    confirmed = runs(start.tolist(), n.tolist(), first.tolist(), window)
                shard.add(None if doc_id is None else int(doc_id), tokens, confirmed)
            held.append(batch)
            if shard.size >= SHARD_WORDS:
                yield from finish(shard, held)
                shard, held = Shard(), []
        yield from finish(shard, held)

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in plain.schema)
    return rows.mapInArrow(run, f"{fields}n_words long, n_removed long")
