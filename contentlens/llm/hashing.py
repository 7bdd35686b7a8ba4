"""Vectorised 64-bit hashes of words and character n-grams of many texts at once (numpy, inside tasks).

All texts of a batch are joined, each after a line end, into one array of code points.  With
P[i] = sum of (c_j + 1) * B^j for j < i (mod 2^64) and B odd, the hash of any piece [s, e) is
(P[e] - P[s]) * B^-s, so hashing every n-gram is a few array operations.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_B = 0x9E3779B97F4A7C15
_B_INV = pow(_B, -1, 1 << 64)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 1 << 18)
        for k, base in enumerate((_B, _B_INV)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(29))


def batches(texts: list[str], chars: int = 1 << 18) -> Iterator[tuple[int, list[str]]]:
    """(index of the first text, texts): runs of whole texts of about ``chars`` characters."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) > chars:
            yield start, texts[start:i]
            start, held = i, 0
        held += len(t) + 1
    if start < len(texts):
        yield start, texts[start:]


class Pieces:
    """Code points, words and hashes of a list of texts."""

    def __init__(self, texts: list[str]):
        # a line end before each text and one after the last: the borders of a text's first and last word
        cps = np.frombuffer(("\n" + "\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
        lens = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        self.starts = np.concatenate(([0], np.cumsum(lens)[:-1]))
        space = (cps == 32) | ((cps >= 9) & (cps <= 13))
        self.n, self.space = len(cps), space
        up, self._down = _power_tables(self.n + 1)
        codes = np.where(space, np.uint32(32), cps).astype(np.uint64) + np.uint64(1)
        self._sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(codes * up[: self.n], dtype=np.uint64)))
        self._spaces = np.concatenate(([0], np.cumsum(space, dtype=np.int32)))
        edge = np.flatnonzero(np.diff(np.concatenate(([True], space)).astype(np.int8)))
        # the text ends with a line end, so starts and ends alternate and pair up
        self.w_start, self.w_end = edge[0::2], edge[1::2]
        self.w_doc = np.searchsorted(self.starts, self.w_start, "right") - 1

    def hashes(self, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        return mixed((self._sums[e] - self._sums[s]) * self._down[s])

    def words(self) -> np.ndarray:
        return self.hashes(self.w_start, self.w_end)

    def char_ngrams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash of the n-gram at each position, whether it lies in one word with its borders)."""
        last = self.n - n + 1
        if last <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, bool)
        h = mixed((self._sums[n:n + last] - self._sums[:last]) * self._down[:last])
        inner = self._spaces[n - 1:n - 1 + last] == self._spaces[1:1 + last]
        return h, inner
