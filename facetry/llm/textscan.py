"""Words, shingles and hashes of many texts at once, over one array of UTF-8 bytes."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_P = 0x9E3779B97F4A7C15 | 1
_P_INVERSE = pow(_P, -1, 1 << 64)
U64 = np.uint64

#: ``[\x20\x09-\x0D]``
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit of a 64-bit hash over all others."""
    h = h ^ (h >> U64(33))
    h = h * U64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U64(33))
    h = h * U64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U64(33))


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _P, U64), np.full(n, _P_INVERSE, U64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


class Scan:
    """Texts joined to one byte array, a newline after each; positions are offsets in ``buf``."""

    def __init__(self, raw: list[bytes], lower: bool = False):
        self.buf = np.frombuffer(b"\n".join([*raw, b""]), np.uint8)
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        self.lengths = lengths
        self.starts = np.cumsum(lengths + 1) - lengths - 1
        self.ends = self.starts + lengths
        if lower:
            self.buf = _LOWER[self.buf]
        self._sums = None

    def doc_of(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, positions, "right") - 1

    def per_doc(self, flags: np.ndarray) -> np.ndarray:
        """How many bytes of each text are flagged."""
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return total[self.ends] - total[self.starts]

    def hashes(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit hashes of the byte strings ``buf[begin:end]``."""
        size = 1 << max(10, int(len(self.buf)).bit_length())
        up, down = _powers(size)
        if self._sums is None:
            value = (self.buf.astype(U64) + U64(1)) * up[: len(self.buf)]
            self._sums = np.concatenate([np.zeros(1, U64), np.cumsum(value, dtype=U64)])
        return mix((self._sums[end] - self._sums[begin]) * down[begin] + (end - begin).astype(U64))

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Begin, end and text number of every word ``[^\\x20\\x09-\\x0D]+``."""
        dark = ~SPACE[self.buf]
        edge = np.diff(dark.astype(np.int8), prepend=0, append=0)
        begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        return begin, end, self.doc_of(begin)


def windows(word_hash: np.ndarray, doc: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of ``size`` words inside one text, and the number of its first word."""
    n = len(word_hash) - size + 1
    if n <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    first = np.flatnonzero(doc[:n] == doc[size - 1 :])
    h = np.zeros(len(first), U64)
    for k in range(size):
        h = mix(h * U64(0x9E3779B97F4A7C15) + word_hash[first + k])
    return h, first
