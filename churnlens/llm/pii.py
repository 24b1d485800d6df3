"""Personal data by a character-level BiLSTM-CRF, beside exact patterns (operator 8).

The patterns (e-mail, IP address, payment card, phone) give the base spans. They also label a bounded sample of
documents, from which the tagger is trained. It then reads every place of every text where a span can be: all
kinds hold a digit or an @, so the windows around these are enough. Windows overlap; each character takes its tag
from the window in whose middle it stands nearest, and the tags of a whole text are read as spans at once, so a span
over a window's edge is one span. A span that the tagger adds has to be likely, to touch no base span, and to
be sound: its card digits pass Luhn's test, its address parts are at most 255, and so on.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlens.llm.common import only, small
from churnlens.llm.tagger import PAD, Tagger, symbols

KINDS = ("email", "ip", "card", "phone")

#: Characters of a window, and from one window's start to the next.
WINDOW, STRIDE = 64, 32
#: Characters read on either side of a digit or an @.
AROUND = 24
#: Documents that the tagger is trained on, about, picked by a hash of their id; and windows of them at most.
TRAIN_DOCS, TRAIN_WINDOWS = 1500, 1600
EPOCHS, EMBED, HIDDEN = 6, 12, 20
#: Mean probability that a span of the tagger has at least.
SURE = 0.9

# The patterns of the base spans.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_DOTTED = re.compile(r"[0-9.]+")
_NOT_DIGIT = re.compile(r"[^0-9]")
_SEED = re.compile(r"[0-9@]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) << (k & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            end = m.end()
            yield start, end
        at = text.find("@", at + 1)


def _addresses(text: str) -> Iterator[tuple[int, int]]:
    """Four numbers in a row, cut from runs of digits and dots left to right; linear where the pattern is not."""
    for run in _DOTTED.finditer(text):
        if run.end() - run.start() < 7:
            continue
        held: list[str] = []
        at = start = run.start()
        for part in run.group().split("."):
            if not part:
                held = []
            else:
                if not held:
                    start = at
                held.append(part)
                if len(held) == 4:
                    if all(_small(p) for p in held):
                        yield start, at + len(part)
                    held = []
            at += len(part) + 1


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := _NOT_DIGIT.sub("", m.group())) <= 19 and luhn(d):
            yield m.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
            yield m.span()


_BASE = (_emails, _addresses, _cards, _phones)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start."""
    return [(k, a, b) for k, find in enumerate(_BASE) for a, b in find(text)] if _SEED.search(text) else []


def sound(kind: int, span: str) -> bool:
    """Could a span be of its kind, whatever stands between its parts?"""
    digits = _NOT_DIGIT.sub("", span)
    if kind == 0:
        name, _, host = span.partition("@")
        return bool(name.strip()) and "." in host.strip(".") and not re.search(r"\s", span)
    if kind == 1:
        parts = [p for p in _NOT_DIGIT.split(span) if p]
        return len(parts) == 4 and all(_small(p) for p in parts)
    return 13 <= len(digits) <= 19 and luhn(digits) if kind == 2 else 9 <= len(digits) <= 15 and "+" in span


def regions(text: str) -> list[tuple[int, int]]:
    """What the tagger reads: all that stands near a digit or an @."""
    out: list[tuple[int, int]] = []
    for m in _SEED.finditer(text):
        a, b = max(0, m.start() - AROUND), min(len(text), m.end() + AROUND)
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], b
        else:
            out.append((a, b))
    return out


def windows(text: str) -> list[int]:
    """Starts of the windows over all regions; within a region they overlap by half."""
    return [a for lo, hi in regions(text) for a in range(lo, max(lo + 1, hi - WINDOW + STRIDE), STRIDE)]


def tags_of(text: str, spans: list[tuple[int, int, int]]) -> np.ndarray:
    """Tag of each character: 0 outside, 1 + 2 * kind at a span's start, 2 + 2 * kind within."""
    out = np.zeros(len(text), np.int64)
    for kind, a, b in reversed(spans):
        out[a:b] = 2 + 2 * kind
        out[a] = 1 + 2 * kind
    return out


def follows() -> np.ndarray:
    """Within a span of a kind only after its start or within it."""
    n = 1 + 2 * len(KINDS)
    ok = np.ones((n, n), bool)
    for k in range(len(KINDS)):
        ok[:, 2 + 2 * k] = False
        ok[1 + 2 * k, 2 + 2 * k] = ok[2 + 2 * k, 2 + 2 * k] = True
    return ok


def _batch(codes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    ids = np.full((len(codes), WINDOW), PAD, np.int64)
    mask = np.zeros((len(codes), WINDOW), np.float32)
    for i, c in enumerate(codes):
        ids[i, :len(c)], mask[i, :len(c)] = c, 1
    return ids, mask


def train(docs: DataFrame, epochs: int = EPOCHS, train_docs: int = TRAIN_DOCS, train_windows: int = TRAIN_WINDOWS) -> Tagger:
    """A tagger trained on windows of about ``train_docs`` documents that have a digit or an @, labelled by the base spans."""
    rows = docs.filter(F.col("text").rlike("[0-9@]"))
    have = rows.count()
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("pii")), F.lit(1_000_000))
    picked = rows.filter(place < 1_000_000 * min(1.0, train_docs / max(have, 1))).withColumn("place", place)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            out: list[tuple[int, str, list[int]]] = []
            for place, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                tags = tags_of(text, base_spans(text))
                for a in windows(text):
                    t = tags[a:a + WINDOW].copy()
                    k = 0
                    while k < len(t) and t[k] and t[k] % 2 == 0:          # the window starts within a span: it starts the window
                        t[k] -= k == 0
                        k += 1
                    out.append((place * 1000 + a % 1000, text[a:a + WINDOW], t.tolist()))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.string()),
                                              pa.array([x[2] for x in out], pa.list_(pa.int64()))], ["place", "text", "tags"])

    found = picked.select("place", "text").mapInArrow(run, "place long, text string, tags array<long>").orderBy("place", "text").limit(train_windows).toPandas()
    tagger = Tagger.new(follows(), EMBED, HIDDEN, seed=7)
    if len(found):
        ids, mask = _batch([symbols(t) for t in found["text"]])
        gold = np.zeros(ids.shape, np.int64)
        for i, t in enumerate(found["tags"]):
            gold[i, :len(t)] = t
        tagger.train(ids, mask, gold, epochs)
    return tagger


def reconciled(n: int, starts: list[int], tags: np.ndarray, sure: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tag and probability of each of ``n`` characters, from the window in which it stands nearest the middle."""
    out, p, depth = np.zeros(n, np.int64), np.zeros(n), np.full(n, -1)
    offset = np.arange(WINDOW)
    for a, t, s in zip(starts, tags, sure):
        m = min(WINDOW, n - a)
        # a window that starts or ends with the text has no edge there
        left = offset[:m] if a else np.full(m, WINDOW)
        right = m - 1 - offset[:m] if a + m < n else np.full(m, WINDOW)
        d = np.minimum(left, right)
        new = d > depth[a:a + m]
        out[a:a + m][new], p[a:a + m][new], depth[a:a + m][new] = t[:m][new], s[:m][new], d[new]
    return out, p


def read_spans(tags: np.ndarray, sure: np.ndarray) -> list[tuple[int, int, int, float]]:
    """(kind, start, end, mean probability) of the runs of a kind."""
    out, k = [], 0
    inside = np.flatnonzero(tags)
    while k < len(inside):
        a = b = int(inside[k])
        kind = (tags[a] - 1) // 2
        while b + 1 < len(tags) and tags[b + 1] == 2 + 2 * kind:
            b += 1
        out.append((int(kind), a, b + 1, float(sure[a:b + 1].mean())))
        k = int(np.searchsorted(inside, b + 1))
    return out


def tag_texts(tagger: Tagger, texts: list[str | None], batch: int = 256) -> Iterator[tuple[list, list]]:
    """For each text its base spans and all spans (kind, start, end)."""
    starts = [windows(t) if t else [] for t in texts]
    jobs = [(i, a) for i, s in enumerate(starts) for a in s]
    tags, sure = np.zeros((len(jobs), WINDOW), np.int64), np.zeros((len(jobs), WINDOW))
    for k in range(0, len(jobs), batch):
        ids, mask = _batch([symbols(texts[i][a:a + WINDOW]) for i, a in jobs[k:k + batch]])
        tags[k:k + batch], sure[k:k + batch] = tagger.decode(ids, mask)
    at = 0
    for text, own in zip(texts, starts):
        base = base_spans(text) if text else []
        if not own:
            yield base, base
            continue
        lo, hi = own[0], min(len(text), own[-1] + WINDOW)
        t, p = reconciled(hi - lo, [a - lo for a in own], tags[at:at + len(own)], sure[at:at + len(own)])
        at += len(own)
        taken = np.zeros(hi - lo, bool)
        for _, a, b in base:
            taken[max(0, a - lo):max(0, b - lo)] = True
        more = [(kind, a + lo, b + lo) for kind, a, b, s in read_spans(t, p)
                if s >= SURE and not taken[a:b].any() and sound(kind, text[a + lo:b + lo])]
        yield base, sorted(base + more)


def find(docs: DataFrame, tagger: Tagger, id_col: str = "doc_id", text_col: str = "text", redact: bool = False) -> DataFrame:
    """All columns of ``docs`` plus ``base`` and ``spans``: arrays of (kind, start, end) in code points, by kind then start.

    With ``redact`` the text's spans are replaced by <kind>. Null texts are empty; empty texts have no spans; texts of any
    length are read whole; repeated rows get the same spans; null ids stay; an empty table stays empty; columns of
    ``docs`` named like the two are replaced.
    """
    names = [c for c in docs.columns if c not in ("base", "spans")]
    rows = docs.select(*[F.col(f"`{c}`") for c in names])
    at = names.index(text_col)
    sent = docs.sparkSession.sparkContext.broadcast(tagger)            # some ten thousand numbers
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    named = lambda spans: [{"kind": KINDS[k], "start": a, "end": b} for k, a, b in spans]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            texts = batch.column(at).to_pylist()
            found = list(tag_texts(sent.value, texts))
            cols = list(batch.columns)
            if redact:
                cols[at] = pa.array([redacted(t, s) if s else t for t, (_, s) in zip(texts, found)], pa.string())
            yield pa.RecordBatch.from_arrays([*cols, pa.array([named(b) for b, _ in found], kind), pa.array([named(s) for _, s in found], kind)],
                                             [*names, "base", "spans"])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema)
    of = "array<struct<kind:string,start:long,end:long>>"
    return rows.mapInArrow(run, f"{fields}base {of}, spans {of}")


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """``text`` with each span replaced by its kind; of spans that overlap, one mark for all."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{KINDS[kind]}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def report(docs: DataFrame) -> DataFrame:
    """Per document the numbers of base spans by kind, a digest of them, and all spans as text."""
    rows = only(docs, doc_id="doc_id", text="text")
    found = find(rows, train(rows)).drop("text")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"), joined("spans").alias("spans"))
