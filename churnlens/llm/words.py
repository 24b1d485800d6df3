"""Words and word n-grams as 64-bit hashes."""

from __future__ import annotations

import functools

import numpy as np
import xxhash

#: Words whose hash a Python worker remembers before it starts anew.
REMEMBERED = 400_000

_BASE = 0x9E3779B97F4A7C15


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(word) <= 64:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = h
        return h


_HASHES = _Hashes()


def words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a whole text, in UTF-8; bytes.split() cuts at just these bytes."""
    return text.encode().split() if text else []


def hashes(tokens: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_HASHES.__getitem__, tokens), np.uint64, len(tokens))


@functools.lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def mixed(h: np.ndarray) -> np.ndarray:
    """The 64-bit numbers stirred (a bijection), so that any of their bits may be used."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _sums(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running sums of the words' hashes, each times a power of the base, and the inverse powers."""
    size = 1 << max(10, (len(h) - 1).bit_length())          # few sizes, so that the powers are found again
    up, down = _powers(size)
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up[:len(h)], out=sums[1:])
    return sums, down


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` words, from their hashes: equal runs have equal hashes."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    sums, down = _sums(h)
    return mixed((sums[k:] - sums[:-k]) * down[:len(h) - k + 1])


def span_hashes(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the runs of words [start, end); runs of different lengths count as different."""
    if not len(start):
        return np.zeros(0, np.uint64)
    sums, down = _sums(h)
    return mixed((sums[end] - sums[start]) * down[start] ^ mixed((end - start).astype(np.uint64)))
