"""Language identification by prediction by partial matching over bytes (operator 7).

For each language a context tree counts which byte follows each context of up to ``ORDER`` bytes. The
code length of a byte is that of PPM, method C: a context that was followed by ``d`` different bytes in
``n`` places gives a byte seen ``c`` times the probability c / (n + d), and escapes to the next shorter
context with d / (n + d); bytes seen in the longer context are then excluded. Below the empty context all
256 bytes are alike. The counts are frozen after training, so the code length of a byte depends on
nothing but the bytes before it, and is looked up in a table made from the trees. The language with the
shortest code for the whole text wins.
"""

from __future__ import annotations

import functools
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnlens.llm.common import only, small

#: Longest context, in bytes.
ORDER = 2
#: Documents of each language that the trees are learnt from, about: a fixed share of its documents
#: by a hash of their id, so that the sample is bounded whatever the table holds.
TRAIN_DOCS = 600
#: Bytes of a text that are looked up at once.
CHUNK = 1 << 20
#: Runs of bytes, over all languages, that a task holds before it adds them up.
WAITING = 1 << 21
#: Standard deviations by which a text's mean code length may differ from its language's by chance.
CHANCE = 4.0
UNDETERMINED = "und"


def grams(data: bytes, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes and counts of the runs of ``order`` + 1 bytes of a text that starts after zero bytes."""
    return np.unique(_codes(data, order), return_counts=True)


def added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Codes and counts of several texts as those of one."""
    code, place = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
    n = np.zeros(len(code), np.int64)
    np.add.at(n, place, np.concatenate([n for _, n in parts]))
    return code, n


def _codes(data: bytes, order: int) -> np.ndarray:
    """At each byte: that byte and the ``order`` before it, as one number; ``data`` starts with ``order`` more bytes."""
    raw = np.frombuffer(data, dtype=np.uint8).astype(np.int32)
    out = raw[order:].copy()
    for k in range(1, order + 1):
        out |= raw[order - k:len(raw) - k] << (8 * k)
    return out


def _count(rows: DataFrame, order: int) -> DataFrame:
    """(lang, gram, n) over all texts of (text, lang): counted within tasks, then added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting = defaultdict(list), 0
        for batch in small(batches):
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held[lang].append(grams(b"\0" * order + text.encode(), order))
                waiting += len(held[lang][-1][0])
            if waiting > WAITING:                          # only runs that were met take room
                held, waiting = defaultdict(list, {x: [added(parts)] for x, parts in held.items()}), 0
        for lang, parts in held.items():
            code, n = added(parts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(code)), pa.array(code, pa.int64()), pa.array(n, pa.int64())], ["lang", "gram", "n"])

    return rows.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def ppm_bits(code: np.ndarray, n: np.ndarray, order: int, contexts: np.ndarray) -> np.ndarray:
    """Code lengths in bits of every byte after each of ``contexts`` (numbers of ``order`` bytes): contexts x 256.

    ``code`` and ``n``: the runs of at least ``order`` + 1 bytes that were counted, and how often.
    """
    prob = np.full((len(contexts), 256), 1 / 256)
    for k in range(order + 1):                              # from the empty context to the longest
        gram, place = np.unique(code % 256 ** (k + 1), return_inverse=True)
        times = np.bincount(place, weights=n, minlength=len(gram))
        short, row = np.unique(contexts % 256 ** k, return_inverse=True)
        at = np.minimum(np.searchsorted(short, gram // 256), len(short) - 1)
        asked = short[at] == gram // 256
        counts = np.zeros((len(short), 256))
        counts[at[asked], gram[asked] % 256] = times[asked]
        counts = counts[row]
        total, kinds = counts.sum(1, keepdims=True), (counts > 0).sum(1, keepdims=True)
        escapes = np.where(kinds < 256, kinds, 0)           # after all 256 there is nothing to escape to
        whole = np.maximum(total + escapes, 1)
        rest = np.where(counts > 0, 0.0, prob)              # the shorter context without the bytes excluded
        rest /= np.maximum(rest.sum(1, keepdims=True), 1e-300)
        prob = np.where(kinds == 0, prob, np.where(counts > 0, counts, escapes * rest) / whole)
    return -np.log2(prob)


@dataclass
class Trees:
    """One language's frozen statistics: the bits of each byte after each context that it has, and after each shorter one."""

    row_of: np.ndarray      # by context
    bits: np.ndarray        # rows * 256
    mean: float             # bits of a byte of the language's own texts, and how much they vary
    spread: float

    def of(self, code: np.ndarray) -> np.ndarray:
        return self.bits[(self.row_of[code >> 8] << 8) + (code & 255)]


@dataclass
class Model:
    langs: list[str]
    order: int
    trees: list[Trees]

    def code_lengths(self, text: str) -> np.ndarray:
        """Bits of the whole text, by language."""
        data = b"\0" * self.order + text.encode()
        out = np.zeros(len(self.langs))
        for i in range(0, len(data) - self.order, CHUNK):
            code = _codes(data[i:i + CHUNK + self.order], self.order)
            out += [t.of(code).sum(dtype=np.float64) for t in self.trees]
        return out

    def judge(self, text: str | None) -> tuple[str, float, float | None]:
        """Language, its posterior probability (all languages alike before; a tie goes to the first by name), and the surprise: the
        bits a byte of the text takes beyond one of the language's own texts, less what chance may add to a text so short."""
        if not text or not self.langs or not any(map(str.isalpha, text)):
            return UNDETERMINED, 0.0, None
        bits = self.code_lengths(text)
        best = int(bits.argmin())
        own, n = self.trees[best], len(text.encode())
        return (self.langs[best], float(1 / np.exp2(np.maximum(bits[best] - bits, -1000)).sum()),
                float(bits[best] / n - own.mean - CHANCE * own.spread / n ** 0.5))

    def predict(self, text: str | None) -> tuple[str, float]:
        return self.judge(text)[:2]


def build(counts: dict[str, tuple[np.ndarray, np.ndarray]], order: int) -> Model:
    """``counts``: per language the codes of runs of ``order`` + 1 bytes and their counts."""
    langs, trees = sorted(counts), []
    # a context that a language hasn't met gives what the next shorter one gives: one row for each of those
    shorter = np.arange(256 ** max(order - 1, 0))
    for lang in langs:
        code, n = counts[lang]
        contexts = np.unique(code // 256).astype(np.int64)
        row_of = np.tile(shorter, 256 ** order // len(shorter)).astype(np.int32)
        row_of[contexts] = len(shorter) + np.arange(len(contexts))
        bits = np.concatenate([ppm_bits(code, n, max(order - 1, 0), shorter), ppm_bits(code, n, order, contexts)]).astype(np.float32).ravel()
        own = Trees(row_of, bits, 0.0, 0.0)
        each, total = own.of(code.astype(np.int64)).astype(np.float64), max(1.0, float(n.sum()))
        own.mean = float((n * each).sum() / total)
        own.spread = max(0.0, float((n * each * each).sum() / total) - own.mean ** 2) ** 0.5
        trees.append(own)
    return Model(langs, order, trees)


def train(docs: DataFrame, order: int = ORDER, train_docs: int = TRAIN_DOCS) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Counts per language from (doc_id, text, lang); rows with a null text or lang teach nothing.

    About ``train_docs`` whole documents a language, picked by a hash of the id; the counts that come to the
    driver are bounded by languages x possible runs of ``order`` + 1 bytes that occur in so many documents.
    """
    rows = docs.filter("text is not null and lang is not null")
    have = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("train")), F.lit(1_000_000))
    share = F.lit(None).cast("double")
    for lang, n in have.items():
        share = F.when(F.col("lang") == lang, F.lit(1_000_000 * min(1.0, train_docs / n))).otherwise(share)
    counted = _count(rows.filter(place < share).select("text", "lang"), order).toPandas() if have else None
    return {} if counted is None else {lang: (g["gram"].to_numpy(np.int64), g["n"].to_numpy(np.float64)) for lang, g in counted.groupby("lang")}


@functools.lru_cache(maxsize=2)
def _model(order: int, broadcast) -> Model:
    return build(broadcast.value, order)


def predict(docs: DataFrame, counts: dict[str, tuple[np.ndarray, np.ndarray]], order: int = ORDER,
            id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` plus ``lang_pred``, ``score`` and ``surprise`` (see ``Model.judge``) for every whole text, whatever its length.

    Null texts, texts without a letter (empty ones too) and models without a language give ``und`` with score 0 and a null surprise.
    Repeated rows get the same answer; ties between languages go to the first by name; an empty table stays empty; columns of
    ``docs`` named like the three are replaced, all others are kept.
    """
    names = [c for c in docs.columns if c not in ("lang_pred", "score", "surprise")]
    rows = docs.select(*[F.col(f"`{c}`") for c in names])
    at = names.index(text_col)
    sent = docs.sparkSession.sparkContext.broadcast(counts)   # bounded, see train()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(order, sent)
        for batch in small(batches):
            found = [model.judge(t) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array([f[i] for f in found], t) for i, t in enumerate((pa.string(), pa.float64(), pa.float64()))]],
                                             [*names, "lang_pred", "score", "surprise"])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema)
    return rows.mapInArrow(run, f"{fields}lang_pred string, score double, surprise double")


def held_out(doc_id: Column) -> Column:
    """Documents that no language may be learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """Per document: ``doc_id, held_out, lang_pred, score``, learnt from the documents that are not held out."""
    rows = only(docs, doc_id="doc_id", text="text", lang="lang").withColumn("held_out", held_out(F.col("doc_id")))
    counts = train(rows.filter("not held_out"))
    return predict(rows.select("doc_id", "held_out", "text"), counts).select("doc_id", "held_out", "lang_pred", "score")
