"""Token ids of whole texts by the tokenizers library, remembering pieces between spaces (operators 5 and 13).

No pre-token of the byte-level vocabulary spans a cut before a space that a visible character follows, so a text's ids are
those of its pieces. The different pieces of some hundred texts are looked up; new ones go through the library in one call, and their ids
are told apart by the tokens that begin with a space. Texts' ids are then put together in one step from those of their pieces.
"""

from __future__ import annotations

import functools
import os
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

from churnlens.llm.bpe import ODD_SPACES, segments

#: Pieces of a generation of the cache; longer ones are not kept.
REMEMBERED, KEPT_CHARS = 400_000, 48

_MARKS = frozenset(".,;:!?")


class TextIds:
    """Text -> ids as little-endian unsigned 32-bit bytes, as ``encode(text, add_special_tokens=False)`` gives them.

    Two generations of pieces: a full one becomes the older, from which pieces that are met again come back, so memory is bounded.
    """

    def __init__(self, config: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self._tok = Tokenizer.from_str(config)
        self._tok.no_truncation()
        self._tok.no_padding()
        self._special = [t.content for t in self._tok.get_added_tokens_decoder().values()]
        vocabulary = self._tok.get_vocab()
        self._starts = np.zeros(max(vocabulary.values(), default=0) + 1, bool)      # tokens that begin with a space
        self._starts[[i for token, i in vocabulary.items() if token.startswith("Ġ")]] = True
        self._marks = {m: self._plain(m) for m in _MARKS}
        self._young: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}

    def __call__(self, text: str) -> bytes:
        return self.many([text])[0]

    def many(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text (null: none). Different pieces of all the texts are looked up once."""
        out, at, heads, rests = [b""] * len(texts), [], [], []
        for i, text in enumerate(texts):
            if not text:
                continue
            if any(s in text for s in self._special):
                out[i] = self._plain(text)
            elif ODD_SPACES.search(text):
                first, *rest = segments(text)
                different = list(dict.fromkeys(rest))
                known = dict(zip(different, self._ids_of(different)))
                out[i] = (self._plain(first) if first else b"") + b"".join(map(known.__getitem__, rest))
            else:
                head, space, rest = text.partition(" ")
                at.append(i)
                heads.append(head)
                rests.append(rest if space else None)
        if not at:
            return out
        pieces = pc.split_pattern(pa.array(rests, pa.string()), " ")
        coded = pieces.flatten().dictionary_encode()
        different = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        ids = self._ids_of(different)
        lengths = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        starts = np.cumsum(lengths) - lengths
        piece = coded.indices.to_numpy()
        sizes = lengths[piece]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        # the pieces' ids side by side: each taken from where its different piece has them
        data = np.frombuffer(b"".join(ids), "<u4")[np.repeat(starts[piece] - ends[:-1], sizes) + np.arange(ends[-1])].tobytes()
        of_text = pa.array(pc.fill_null(pc.list_value_length(pieces), 0)).to_numpy(zero_copy_only=False)
        cuts = (4 * ends[np.concatenate([[0], np.cumsum(of_text)])]).tolist()
        first = self._tok.encode_batch_fast(heads, add_special_tokens=False)
        for i, e, a, b in zip(at, first, cuts, cuts[1:]):
            out[i] = array("I", e.ids).tobytes() + data[a:b]
        return out

    def _ids_of(self, pieces: list[str]) -> list[bytes]:
        """Ids of different pieces, each after a space."""
        ids = list(map(self._young.get, pieces))
        if None in ids:
            found = self._found([p for p, x in zip(pieces, ids) if x is None])
            ids = [found[p] if x is None else x for p, x in zip(pieces, ids)]
        return ids

    def _plain(self, text: str) -> bytes:
        return array("I", self._tok.encode_batch_fast([text], add_special_tokens=False)[0].ids).tobytes()

    def _found(self, pieces: list[str]) -> dict[str, bytes]:
        """Ids of pieces that the younger generation lacks, kept there from now on."""
        found: dict[str, bytes] = {}
        new: dict[str, bytes | None] = {}
        closed = []                                     # a word and the mark that ends it are two pre-tokens
        young, old = self._young, self._old
        for p in pieces:
            x = old.get(p)
            if x is not None:
                found[p] = x
            elif p[-1:] in _MARKS and p[:-1].isalpha():
                word = p[:-1]
                x = young.get(word) or old.get(word)
                if x is None:
                    new[word] = None
                    closed.append(p)
                else:
                    found[p] = x + self._marks[p[-1]]
            elif " " in p:
                found[p] = self._plain(" " + p)
            else:                                       # just one of its tokens begins with a space, the first
                new[p] = None
        words = list(new)
        found.update(zip(words, self._together(words)))
        for p in closed:
            found[p] = found[p[:-1]] + self._marks[p[-1]]
        if len(self._young) + len(found) > REMEMBERED:
            self._old, self._young = self._young, {}
        self._young.update((p, x) for p, x in found.items() if len(p) <= KEPT_CHARS)
        return found

    def _together(self, pieces: list[str]) -> list[bytes]:
        text = " " + " ".join(pieces)
        if not pieces or any(s in text for s in self._special):
            return [self._plain(" " + p) for p in pieces]
        ids = np.array(self._tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        cuts = [*(4 * np.flatnonzero(self._starts[ids])).tolist(), 4 * len(ids)]
        if len(cuts) != len(pieces) + 1 or cuts[0]:
            return [self._plain(" " + p) for p in pieces]
        data = ids.tobytes()
        return [data[a:b] for a, b in zip(cuts, cuts[1:])]


@functools.lru_cache(maxsize=2)
def text_ids(config: str) -> TextIds:
    """Made once per Python worker."""
    return TextIds(config)
