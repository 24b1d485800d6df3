"""Byte-level BPE as a tokenization automaton (operator 1).

The merge list is compiled rule by rule. The automaton reads tokens; it starts as one state
with a loop for every byte. The gadget of a rule ``a b -> ab`` does three things:

* the state that ``a`` arcs lead to is split, if other arcs also lead there, so that it is
  reached by ``a`` alone;
* the ``b`` arc is taken out of that state (``a`` followed by ``b`` would have been merged);
* every state that still has an ``a`` arc gets an ``ab`` arc, leading where ``b`` arcs led.

After all rules every byte string has exactly one path, and its arc labels are the BPE tokens.
All arcs of one token lead to one state, so ``target[token]`` holds the transition. Which arcs
a state has is kept as the gadgets' records (split from which state and when, which arc was
taken out and when); a table cell is filled from them when it is first read.

Encoding cuts a text into pre-tokens, then walks each one left to right: from the state reached
at each byte, follow every arc whose label continues the word. Decoding emits the labels.
"""

from __future__ import annotations

import functools
import json
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlens.llm.common import only, small

# Fixed value: the pre-token pattern of the byte-level vocabulary.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Entries of a generation of the word cache; cells of the transition table before it starts anew.
CACHE_ENTRIES = 400_000
TABLE_CELLS = 400_000
#: Look-ahead answers of either length that are kept.
KEPT_ANSWERS = 100_000
#: Longer pieces between spaces are encoded without being kept.
CACHE_CHARS = 48

#: Bytes that the walk looks ahead at once; and where labels go on beyond these.
LOOK_AHEAD, FAR_AHEAD = 5, 10

_START = 0
_AFTER_ALL = 1 << 40


def _byte_names() -> dict[str, int]:
    """The vocabulary's printable name of each byte: itself if visible in Latin-1, else 256 + a count."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Automaton:
    """Deterministic automaton over tokens, compiled from an ordered merge list."""

    def __init__(self, labels: dict[bytes, int], merges: Iterable[tuple[bytes, bytes]]):
        n = max(labels.values()) + 1
        self.labels = labels
        self.target = [_START] * n            # state that the arcs of a token lead to
        self._left = [-1] * n                 # left part; -1: a byte
        self._born = [-1] * n                 # rule that made the token
        self._live = [False] * n              # tokens that some text can reach
        for b in range(256):
            self._live[labels[bytes([b])]] = True
        self._from, self._split = [-1], [-1]  # per state: split from, by which rule
        self._out: dict[tuple[int, int], int] = {}   # (state, token): rule that took the arc out
        users = [257]                         # arcs (and the start) that lead to a state, by token
        for k, (x, y) in enumerate(merges):
            a, b, ab = labels[x], labels[y], labels[x + y]
            before = self.target[a]
            if self._live[ab] or not (self._live[a] and self._live[b] and self._has(before, b, k - 1)):
                continue                      # no path holds a b: the rule never fires
            after_b = self.target[b]
            if users[before] > 1 or a == b:   # a == b: ab still leads to the state where a may follow
                users[before] -= 1
                self._from.append(before)
                self._split.append(k)
                users.append(1)
                self.target[a] = len(self._from) - 1
            self._out[self.target[a], b] = k
            self._left[ab], self._born[ab], self._live[ab] = a, k, True
            self.target[ab] = after_b
            users[after_b] += 1
        self._cells: dict[int, bool] = {}
        self._ahead: dict[bytes, tuple[tuple[int, int, int], ...]] = {}
        self.longest = max(map(len, labels))
        self._far_ahead: dict[bytes, tuple[tuple[int, int, int], ...]] = {}
        self.longer = {x[:k] for k in (LOOK_AHEAD, FAR_AHEAD) for x in labels if len(x) > k}
        self.trie: dict[bytes, int] = {}      # prefixes of labels -> token, or -1
        for label, t in labels.items():
            for i in range(1, len(label)):
                self.trie.setdefault(label[:i], -1)
            if self._live[t]:
                self.trie[label] = t

    def _has(self, state: int, token: int, rule: int) -> bool:
        """Has ``state`` an arc for ``token`` just after ``rule``?"""
        while True:
            if self._out.get((state, token), rule + 1) <= rule:
                return False
            if self._split[state] > self._born[token]:      # state is younger: as in the state it was split from
                rule, state = self._split[state] - 1, self._from[state]
            elif self._left[token] < 0:
                return True
            else:                                           # got with the token's rule, if it had the left part then
                rule, token = self._born[token], self._left[token]

    def has_arc(self, state: int, token: int) -> bool:
        """One cell of the transition table."""
        key = state << 20 | token
        got = self._cells.get(key)
        if got is None:
            if len(self._cells) >= TABLE_CELLS:
                self._cells.clear()
            got = self._cells[key] = self._has(state, token, _AFTER_ALL)
        return got

    def _labels_at(self, ahead: bytes) -> tuple[tuple[int, int, int], ...]:
        """(token, its length, the state it leads to) for tokens whose labels start ``ahead``, longest first."""
        found = []
        for e in range(1, len(ahead) + 1):
            t = self.trie.get(ahead[:e])
            if t is None:
                break
            if t >= 0:
                found.append((t, e, self.target[t]))
        return tuple(found[::-1])

    def _spelled(self, word: bytes, at: int) -> tuple[tuple[int, int, int], ...]:
        """The same for what ``word`` holds from ``at`` on, where the shorter look-ahead has no answer yet."""
        ahead = word[at:at + LOOK_AHEAD]
        kept = self._ahead
        if ahead in self.longer:              # labels go on beyond it
            ahead, kept = word[at:at + FAR_AHEAD], self._far_ahead
            if ahead in self.longer:
                return self._labels_at(word[at:at + self.longest])
        got = kept.get(ahead)
        if got is None:
            if len(kept) >= KEPT_ANSWERS:
                kept.clear()
            got = kept[ahead] = self._labels_at(ahead)
        return got

    def encode_word(self, word: bytes) -> list[int]:
        """Arc labels of the one path that spells ``word``, longest arcs tried first.

        The path to any byte is unique, so a byte from which the walk could not go on is never
        tried again: the walk is linear in the word.
        """
        n, at, state, ahead, cells = len(word), 0, _START, self._ahead, self._cells
        out: list[int] = []
        back: list[tuple[int, int, Iterator]] = []
        dead: set[int] = set()
        arcs = iter(ahead.get(word[:LOOK_AHEAD]) or self._spelled(word, 0))
        while True:
            for t, size, leads in arcs:
                free = cells.get(state << 20 | t)
                if free or free is None and self.has_arc(state, t):
                    end = at + size
                    if end == n:
                        out.append(t)
                        return out
                    if end not in dead:
                        out.append(t)
                        back.append((at, state, arcs))
                        at, state = end, leads
                        arcs = iter(ahead.get(word[at:at + LOOK_AHEAD]) or self._spelled(word, at))
                        break
            else:
                dead.add(at)
                out.pop()
                at, state, arcs = back.pop()


def segments(text: str) -> list[str]:
    """``text`` cut before each space that a visible character follows; no pre-token spans a cut.

    The first piece stands as it is; the others lack their leading space.
    """
    if ODD_SPACES.search(text) is None:
        return text.split(" ")
    return _CUT.split(text)


_CUT = re.compile(r" (?=\S)")
#: A space that no visible character follows.
ODD_SPACES = re.compile(r" (?:\s|$)")
_ENDS = frozenset(".,;:!?")


class Cached(dict):
    """Piece after a space -> its ids as little-endian unsigned 32-bit bytes.

    Two generations: when the younger is full it becomes the older one, from which pieces that are
    met again come back, so frequent pieces stay and memory is bounded.
    """

    def __init__(self, encode):
        super().__init__()
        self._encode = encode
        self._older: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        out = self._older.get(piece)
        if out is None:
            out = self._encode(piece)
        self.keep(piece, out)
        return out

    def keep(self, piece: str, out: bytes) -> None:
        if len(piece) <= CACHE_CHARS:
            if len(self) >= CACHE_ENTRIES:
                self._older = dict(self)
                self.clear()
            self[piece] = out


class Codec:
    """Text <-> ids, from the JSON of a byte-level vocabulary."""

    def __init__(self, config: str):
        spec = json.loads(config)
        names = _byte_names()
        raw = lambda s: bytes(names[c] for c in s)
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocab = {raw(s): i for s, i in spec["model"]["vocab"].items() if s not in special}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        self._vocab, self._merges = vocab, [(raw(a), raw(b)) for a, b in pairs]
        self.special = special
        self._cut = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self._words = regex.compile(PRE_TOKEN)
        self._labels = [b""] * (max([*vocab.values(), *special.values()]) + 1)
        for label, i in [*vocab.items(), *((s.encode(), i) for s, i in special.items())]:
            self._labels[i] = label
        self._cache = Cached(self._after_space)

    @functools.cached_property
    def automaton(self) -> Automaton:
        """Compiled on first use: decoding needs the labels only."""
        return Automaton(self._vocab, self._merges)

    def _ids(self, piece: str) -> bytes:
        out = array("I")
        for w in self._words.findall(piece):
            out.extend(self.automaton.encode_word(w.encode()))
        return out.tobytes()

    def _after_space(self, piece: str) -> bytes:
        encode = self.automaton.encode_word
        if piece.isalpha():                             # one pre-token, as letters are
            return array("I", encode(b" " + piece.encode())).tobytes()
        if piece[-1:] in _ENDS and piece[:-1].isalpha():
            return array("I", encode(b" " + piece[:-1].encode()) + encode(piece[-1].encode())).tobytes()
        return self._ids(" " + piece)

    def _plain(self, text: str) -> bytes:
        if not text:
            return b""
        first, *rest = segments(text)
        return (self._ids(first) if first else b"") + b"".join(map(self._cache.__getitem__, rest))

    def encode_bytes(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if self._cut is None or not any(s in text for s in self.special):
            return self._plain(text)
        return b"".join(array("I", [self.special[p]]).tobytes() if p in self.special else self._plain(p)
                        for p in self._cut.split(text))

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(self.encode_bytes(text), dtype="<u4")

    def decode(self, ids: Iterable[int]) -> str:
        """Labels of the arcs, joined; bytes that are not UTF-8 become replacement characters."""
        return b"".join(map(self._labels.__getitem__, ids)).decode("utf-8", errors="replace")


@functools.lru_cache(maxsize=2)
def codec(config: str) -> Codec:
    """The compiled codec of a vocabulary, made once per Python worker."""
    return Codec(config)


def _config(docs: DataFrame, vocabulary: str):
    """The vocabulary's JSON (1.5 MB, whatever the data), read once by the driver and broadcast."""
    with open(vocabulary, encoding="utf-8") as f:
        return docs.sparkSession.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token ids of every whole text: (``doc_id``, ``ids`` array<int>), one row per input row.

    Null and empty texts give an empty array; repeated rows and null ids stay; a text of any length is
    encoded whole in time linear in its length; an empty table gives no rows; other columns are ignored.
    """
    rows = only(docs, doc_id=id_col, text=text_col)
    conf = _config(docs, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(conf.value)
        for batch in small(batches):
            ids = [c.encode_bytes(t) if t else b"" for t in batch.column(1).to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32)
            values = pa.array(np.frombuffer(b"".join(ids), dtype="<i4"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, values)], ["doc_id", "ids"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decode(tokens: DataFrame, vocabulary: str, ids_col: str = "ids") -> DataFrame:
    """All columns of ``tokens`` plus ``decoded``: the text that the ids spell (null ids: empty text)."""
    conf = _config(tokens, vocabulary)
    names = [c for c in tokens.columns if c != "decoded"]
    at = names.index(ids_col)
    rows = tokens.select(*[F.col(f"`{c}`") for c in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(conf.value)
        for batch in small(batches):
            texts = [c.decode(x.values.to_pylist()) if x.is_valid else "" for x in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*names, "decoded"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{fields}, decoded string")


def digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Per document: token count, SHA-256 of the ids, SHA-256 of the text decoded from them."""
    tokens = decode(encode(docs, vocabulary), vocabulary)
    return tokens.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
