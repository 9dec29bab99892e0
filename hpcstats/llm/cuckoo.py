"""A cuckoo filter over 128-bit keys as one numpy array: many insertions, deletions and lookups at once.

Buckets have four slots of 16-bit fingerprints (0: free).  A key may lie in two
buckets, and either one is found from the other and the fingerprint, so a
fingerprint can move without its key.  A lookup never misses a key that was
inserted; it finds other keys with a chance of about 8 / 65536.  Deleting is
right only for keys that are in the filter: the callers' exact tables see to it.
"""

from __future__ import annotations

import numpy as np

from hpcstats.llm.wordhash import mixed

SLOTS = 4
FULLEST = 0.85   # of the slots
ROUNDS = 400


def key_parts(keys) -> tuple[np.ndarray, np.ndarray]:
    """Two unsigned 64-bit numbers per 16-byte key (its first and its second half, big-endian)."""
    both = np.frombuffer(b"".join(keys), dtype=">u8").reshape(-1, 2).astype(np.uint64)
    return both[:, 0], both[:, 1]


class Cuckoo:
    """``slots`` holds the whole state: buckets x 4 fingerprints, a power of two of buckets."""

    def __init__(self, slots: np.ndarray):
        self.slots = slots
        self.mask = np.uint64(len(slots) - 1)

    @classmethod
    def sized(cls, keys: int) -> Cuckoo:
        buckets = 16
        while buckets * SLOTS * FULLEST < keys:
            buckets *= 2
        return cls(np.zeros((buckets, SLOTS), dtype=np.uint16))

    @classmethod
    def built(cls, keys) -> Cuckoo:
        """A filter of the given keys, larger where an unlucky draw leaves no room."""
        made = cls.sized(len(keys))
        while not made.insert(keys):
            made = cls(np.zeros((2 * len(made.slots), SLOTS), dtype=np.uint16))
        return made

    @classmethod
    def from_bytes(cls, data: bytes) -> Cuckoo:
        return cls(np.frombuffer(data, dtype="<u2").astype(np.uint16).reshape(-1, SLOTS))

    def to_bytes(self) -> bytes:
        return self.slots.astype("<u2").tobytes()

    def items(self) -> int:
        return int((self.slots > 0).sum())

    def _places(self, keys) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        high, low = key_parts(keys)
        print_ = (low & np.uint64(0xFFFF)).astype(np.uint16)
        print_[print_ == 0] = 1
        first = mixed(high) & self.mask
        return print_, first, self._other(first, print_)

    def _other(self, bucket: np.ndarray, print_: np.ndarray) -> np.ndarray:
        return (bucket ^ mixed(print_.astype(np.uint64) + np.uint64(1))) & self.mask

    def has(self, keys) -> np.ndarray:
        """Whether each key may be in the filter (never False for one that is)."""
        if not len(keys):
            return np.zeros(0, dtype=bool)
        print_, a, b = self._places(keys)
        return ((self.slots[a] == print_[:, None]) | (self.slots[b] == print_[:, None])).any(axis=1)

    def insert(self, keys) -> bool:
        """Add keys (each once); False if no place was found, and the filter is to be built anew."""
        if not len(keys):
            return True
        if self.items() + len(keys) > FULLEST * self.slots.size:
            return False
        print_, at, other = self._places(keys)
        # every round each waiting fingerprint tries its bucket: free slots go by rank, one of the rest takes another's slot
        for turn in range(ROUNDS):
            order = np.argsort(at, kind="stable")
            at, print_ = at[order], print_[order]
            starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
            rank = np.arange(len(at)) - np.repeat(starts, np.diff(np.r_[starts, len(at)]))
            free = self.slots[at] == 0
            placed = rank < free.sum(axis=1)
            # the slot of rank r is the r-th free one
            nth = np.cumsum(free[placed], axis=1) - 1
            slot = ((nth == rank[placed][:, None]) & free[placed]).argmax(axis=1)
            self.slots[at[placed], slot] = print_[placed]
            at, print_, rank = at[~placed], print_[~placed], rank[~placed]
            if not len(at):
                return True
            lead = np.r_[True, at[1:] != at[:-1]]
            out = np.flatnonzero(lead)
            victim = (mixed(at[out] + np.uint64(turn)) % np.uint64(SLOTS)).astype(np.int64)
            if turn % 2:  # every other round the waiting ones only try their other bucket
                at = self._other(at, print_)
                continue
            moved = self.slots[at[out], victim]
            self.slots[at[out], victim] = print_[out]
            print_ = print_.copy()
            print_[out] = moved
            at = self._other(at, print_)
        return False

    def delete(self, keys) -> None:
        """Take out one fingerprint of each key; the keys must be in the filter."""
        if not len(keys):
            return
        print_, buckets, other = self._places(keys)
        for last in (False, True):
            # equal (bucket, fingerprint) take different slots, by rank
            order = np.lexsort((print_, buckets))
            b, p = buckets[order], print_[order]
            starts = np.flatnonzero(np.r_[True, (b[1:] != b[:-1]) | (p[1:] != p[:-1])])
            rank = np.arange(len(b)) - np.repeat(starts, np.diff(np.r_[starts, len(b)]))
            hit = self.slots[b] == p[:, None]
            found = rank < hit.sum(axis=1)
            nth = np.cumsum(hit[found], axis=1) - 1
            slot = ((nth == rank[found][:, None]) & hit[found]).argmax(axis=1)
            self.slots[b[found], slot] = 0
            left = order[~found]
            if not len(left):
                return
            if last:
                raise ValueError("a key to be deleted is not in the filter")
            print_, buckets = print_[left], other[left]
