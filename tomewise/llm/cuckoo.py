"""Cuckoo filter over 64-bit keys as one numpy table: insertion and deletion of many keys at a time."""

from __future__ import annotations

import numpy as np

from tomewise.llm.words import mix

SLOTS = 4
MAX_ROUNDS = 64


class CuckooFilter:
    """Buckets of four 16-bit fingerprints; each key has two buckets, each computable from the other.

    `add` never loses a key: when fingerprints cannot be placed, the caller rebuilds a larger filter from its exact
    table (`add` then returns False). A key that the filter seems to know by chance needs a fingerprint of its own all
    the same, so that `discard`, which takes out one fingerprint of each key, leaves those of other keys alone.
    """

    def __init__(self, table: np.ndarray):
        self.table = table
        self.mask = np.uint64(len(table) - 1)

    @classmethod
    def for_keys(cls, n: int) -> "CuckooFilter":
        """An empty filter that n keys fill to 70 % at most."""
        buckets = 1 << max(3, int(np.ceil(np.log2(max(n, 1) / (0.7 * SLOTS)))))
        return cls(np.zeros((buckets, SLOTS), dtype=np.uint16))

    @classmethod
    def build(cls, keys: np.ndarray) -> "CuckooFilter":
        size = len(keys)
        while True:
            made = cls.for_keys(size)
            if made.add(keys):
                return made
            size *= 2

    @classmethod
    def from_bytes(cls, data: bytes) -> "CuckooFilter":
        return cls(np.frombuffer(data, dtype=np.uint16).reshape(-1, SLOTS).copy())

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        hashed = mix(keys.astype(np.uint64))
        print_ = (hashed >> np.uint64(48)).astype(np.uint16)
        print_[print_ == 0] = 1
        first = hashed & self.mask
        return print_, first, self._other(first, print_)

    def _other(self, bucket: np.ndarray, print_: np.ndarray) -> np.ndarray:
        return (bucket ^ mix(print_.astype(np.uint64))) & self.mask

    def contains(self, keys: np.ndarray) -> np.ndarray:
        print_, first, second = self._places(keys)
        wanted = print_[:, None]
        return (self.table[first] == wanted).any(1) | (self.table[second] == wanted).any(1)

    def _settle(self, print_: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """Put fingerprints into free slots of their buckets, as many a bucket as it has room; which were put."""
        order = np.argsort(bucket, kind="stable")
        b = bucket[order]
        begin = np.concatenate(([True], b[1:] != b[:-1])) if len(b) else np.zeros(0, dtype=bool)
        at = np.arange(len(b))
        rank = at - np.maximum.accumulate(np.where(begin, at, 0)) if len(b) else at
        free = self.table[b] == 0
        fits = rank < free.sum(1)
        slot = (free.cumsum(1) > rank[:, None]).argmax(1)
        self.table[b[fits], slot[fits]] = print_[order][fits]
        done = np.zeros(len(bucket), dtype=bool)
        done[order[fits]] = True
        return done

    def add(self, keys: np.ndarray) -> bool:
        """Insert a fingerprint for each key; False if some found no place, after which the filter must be rebuilt."""
        print_, first, second = self._places(keys)
        done = self._settle(print_, first)
        print_, bucket = print_[~done], second[~done]
        rng = np.random.default_rng(len(keys))
        for _ in range(MAX_ROUNDS):
            done = self._settle(print_, bucket)
            print_, bucket = print_[~done], bucket[~done]
            if not len(print_):
                return True
            full, one = np.unique(bucket, return_index=True)  # one kick a bucket and round
            slot = rng.integers(0, SLOTS, len(full))
            kicked = self.table[full, slot]
            self.table[full, slot] = print_[one]
            print_[one], bucket[one] = kicked, self._other(full, kicked)
        return False

    def discard(self, keys: np.ndarray) -> None:
        """Remove one fingerprint for each of these distinct keys."""
        print_, first, second = self._places(keys)
        for f, a, b in zip(print_.tolist(), first.tolist(), second.tolist()):
            for bucket in (a, b):
                hit = np.flatnonzero(self.table[bucket] == f)
                if len(hit):
                    self.table[bucket, hit[0]] = 0
                    break
