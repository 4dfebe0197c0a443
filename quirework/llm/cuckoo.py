"""A cuckoo filter over 128-bit keys in numpy: membership without false negatives, with deletion.

Buckets hold four 16-bit fingerprints. A key's second bucket follows from its first one and its
fingerprint, so a fingerprint can move between its two buckets without its key. Keys are inserted and
removed many at a time: all that find a free slot are placed at once, the others push out one
fingerprint a bucket and round. What is removed must have been inserted, which exact tables ensure.
"""

from __future__ import annotations

import numpy as np

from .common import mix

SLOTS = 4
LOAD = 0.8
ROUNDS = 400


def _rank(sorted_at: np.ndarray) -> np.ndarray:
    """The place of each entry among those of equal value."""
    first = np.append(True, sorted_at[1:] != sorted_at[:-1])
    return np.arange(len(sorted_at)) - np.maximum.accumulate(np.where(first, np.arange(len(sorted_at)), 0))


class Cuckoo:
    def __init__(self, slots: np.ndarray):
        self.slots = slots.reshape(-1, SLOTS)  # 0: free
        self.mask = np.uint64(len(self.slots) - 1)

    @classmethod
    def sized(cls, keys: int) -> Cuckoo:
        return cls(np.zeros((1 << max(0, int(np.ceil(keys / SLOTS / LOAD)) - 1).bit_length(), SLOTS), np.uint16))

    @classmethod
    def of(cls, hi: np.ndarray, lo: np.ndarray) -> Cuckoo:
        """A filter of distinct keys; it doubles until all have a place."""
        own = cls.sized(len(hi))
        while not own.insert(hi, lo):
            own = cls(np.zeros((2 * len(own.slots), SLOTS), np.uint16))
        return own

    @property
    def size(self) -> int:
        return int(np.count_nonzero(self.slots))

    def _places(self, hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Fingerprint (never 0) and first bucket."""
        print_ = (lo.view(np.uint64) >> np.uint64(48)).astype(np.uint16)
        return np.maximum(print_, 1), (hi.view(np.uint64) & self.mask).astype(np.int64)

    def _other(self, print_: np.ndarray, at: np.ndarray) -> np.ndarray:
        return at ^ (mix(print_.astype(np.uint64)) & self.mask).astype(np.int64)

    def holds(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        print_, at = self._places(hi, lo)
        return (self.slots[at] == print_[:, None]).any(1) | (self.slots[self._other(print_, at)] == print_[:, None]).any(1)

    def _fill(self, print_: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Puts fingerprints into free slots; tells which found none."""
        order = np.argsort(at, kind="stable")
        rank, own = _rank(at[order]), self.slots[at[order]]
        fits = rank < (own == 0).sum(1)
        slot = np.argsort(own != 0, axis=1, kind="stable")[fits, rank[fits]]
        self.slots[at[order][fits], slot] = print_[order][fits]
        left = np.ones(len(at), bool)
        left[order[fits]] = False
        return left

    def insert(self, hi: np.ndarray, lo: np.ndarray) -> bool:
        """False if some found no place; the filter is then to be built anew, larger."""
        print_, at = self._places(hi, lo)
        rng = np.random.default_rng(7)
        for _ in range(ROUNDS):
            for _side in range(2):
                left = self._fill(print_, at) if len(at) else np.zeros(0, bool)
                print_, at = print_[left], self._other(print_[left], at[left])
            if not len(at):
                return True
            _, one = np.unique(at, return_index=True)
            slot = rng.integers(0, SLOTS, len(one))
            out = self.slots[at[one], slot]
            self.slots[at[one], slot] = print_[one]
            print_[one], at[one] = out, self._other(out, at[one])
        return False

    def remove(self, hi: np.ndarray, lo: np.ndarray) -> None:
        print_, at = self._places(hi, lo)
        while len(at):
            before = len(at)
            for _side in range(2):
                found = self.slots[at] == print_[:, None]
                cell = at * SLOTS + found.argmax(1)
                has = np.flatnonzero(found.any(1))
                _, one = np.unique(cell[has], return_index=True)
                self.slots.reshape(-1)[cell[has[one]]] = 0
                left = np.ones(len(at), bool)
                left[has[one]] = False
                print_, at = print_[left], self._other(print_[left], at[left])
            if len(at) == before:
                raise ValueError("a key to remove is not in the filter")
