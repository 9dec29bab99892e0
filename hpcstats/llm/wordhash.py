"""Words of many texts at once as numpy arrays: 64-bit hashes of words and word n-grams.

A batch of texts is one byte array (texts apart by three line ends); a word is
a run of bytes other than white space (x20, x09-x0D), hashed as a polynomial in
its bytes over 64 bits by one running sum for the whole batch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[65:91] += 32
GAP = b"\n\n\n"

# Odd multipliers of a 64-bit mixer, and a base with its inverse modulo 2**64.
MIX_1, MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
STEP = np.uint64(0xD6E8FEB86659FD93)

_powers: dict[int, np.ndarray] = {}


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (a bijection)."""
    h = (h ^ (h >> np.uint64(30))) * MIX_1
    h = (h ^ (h >> np.uint64(27))) * MIX_2
    return h ^ (h >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2**64, kept for the next batch."""
    known = _powers.get(base)
    if known is None or len(known) < n:
        size = max(n, 1 << 20)
        known = np.full(size, base, dtype=np.uint64)
        known[0] = 1
        _powers[base] = known = np.cumprod(known, dtype=np.uint64)
    return known[:n]


def released() -> None:
    """Give back what a worker keeps between batches: it idles beside the JVM when its task has ended."""
    _powers.clear()
    pa.default_memory_pool().release_unused()


BYTE_VALUES = mixed(np.arange(1, 257, dtype=np.uint64) * STEP)


class Batch:
    """Bytes and words of a list of texts: word_hash, word_doc, word_start, word_end (in data)."""

    def __init__(self, texts: list[str], fold: bool = False):
        encoded = [t.encode("utf-8", "surrogatepass") for t in texts]
        self.data = np.frombuffer(GAP + GAP.join(encoded) + GAP, dtype=np.uint8)
        if fold:
            self.data = LOWERED[self.data]
        sizes = np.array([len(e) for e in encoded], dtype=np.int64)
        self.ends = np.cumsum(sizes + len(GAP)) + len(GAP) - len(GAP)
        self.starts = self.ends - sizes
        self.space = SPACE[self.data]
        edges = np.diff(self.space.view(np.int8))
        self.word_start = np.flatnonzero(edges == -1) + 1
        self.word_end = np.flatnonzero(edges == 1) + 1
        self.word_doc = np.searchsorted(self.ends, self.word_start, side="right")
        running = np.zeros(len(self.data) + 1, dtype=np.uint64)
        np.cumsum(BYTE_VALUES[self.data] * powers(BASE, len(self.data)), out=running[1:])
        inverse = powers(INVERSE, len(self.data))
        self.word_hash = mixed((running[self.word_end] - running[self.word_start]) * inverse[self.word_start])
        self.docs = len(texts)

    def per_doc(self, flags: np.ndarray) -> np.ndarray:
        """Sum of a per-byte array inside each text."""
        running = np.zeros(len(flags) + 1, dtype=np.int64)
        np.cumsum(flags, out=running[1:])
        return running[self.ends] - running[self.starts]

    def words(self) -> np.ndarray:
        return np.bincount(self.word_doc, minlength=self.docs)

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash and first word of every window of k words inside one text."""
        n = len(self.word_hash) - k + 1
        if n <= 0:
            return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        h = self.word_hash[:n].copy()
        for j in range(1, k):
            h = h * STEP + self.word_hash[j:n + j]
        at = np.flatnonzero(self.word_doc[:n] == self.word_doc[k - 1:])
        return mixed(h[at]), at
