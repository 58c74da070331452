"""Words and shingles of texts as arrays of hashes, by numpy within tasks."""

from __future__ import annotations

import numpy as np

#: A text is hashed in pieces of about so many bytes, so that work arrays stay small however long it is.
PIECE = 1 << 18
_P = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += 32
_LOWER += 1
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True
_powers: tuple[np.ndarray, np.ndarray] | None = None


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit numbers, one to one."""
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if _powers is None or len(_powers[0]) < n:
        up = np.full(n, _P, np.uint64)
        down = np.full(n, pow(_P, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _powers = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers


def _hash_piece(data: np.ndarray) -> np.ndarray:
    word = _WORD[data]
    edge = np.flatnonzero(np.diff(word, prepend=False, append=False))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.empty(0, np.uint64)
    up, down = _tables(max(len(data), PIECE) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_LOWER[data] * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts])


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash for each word: digits, letters A-Z in either case, and all characters beyond ASCII."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    if len(data) <= PIECE:
        return _hash_piece(data)
    found, at = [], 0
    while at < len(data):
        end = at + PIECE
        while end < len(data):  # to the end of the word that stands there
            gap = np.flatnonzero(~_WORD[data[end : end + PIECE]])
            if len(gap):
                end += int(gap[0])
                break
            end += PIECE
        found.append(_hash_piece(data[at:end]))
        at = end
    return np.concatenate(found)


def shingles(text: str, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of runs of k words, sorted, and how often each occurs; a shorter text's words are one run."""
    w = word_hashes(text)
    if not len(w):
        return w, np.empty(0, np.int64)
    k, h = min(k, len(w)), np.zeros(len(w) - min(k, len(w)) + 1, np.uint64)
    for j in range(k):
        h = h * np.uint64(_P) + w[j : len(w) - k + 1 + j]
    return np.unique(mix(h), return_counts=True)
