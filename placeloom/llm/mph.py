"""Minimal perfect hash over a fixed set of byte strings.

Hash and displace: keys fall into about n/4 buckets by one hash; for each bucket,
largest first, a displacement is sought that sends its keys to free slots of a
table of exactly n slots. Buckets of one key take what is left, their slot being
stored directly. A lookup costs one 64-bit hash, two array reads and a compare.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import xxhash

_MIX1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray, d: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = h + (d + np.uint64(1)) * _STEP
        x = (x ^ (x >> np.uint64(30))) * _MIX1
        x = (x ^ (x >> np.uint64(27))) * _MIX2
        return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Maps each of ``keys`` to its own value; any other string to -1."""

    def __init__(self, keys: Sequence[bytes], values: Sequence[int]):
        n = len(keys)
        self.n = n
        self.buckets = max(1, n // 4)
        hashes = np.array([xxhash.xxh3_64_intdigest(k) for k in keys], dtype=np.uint64)
        if len(np.unique(hashes)) != n:
            raise ValueError("two keys are equal or share a 64-bit hash")
        home = (hashes % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(home, kind="stable")
        starts = np.searchsorted(home[order], np.arange(self.buckets + 1))
        sizes = np.diff(starts)
        free = np.ones(n, dtype=bool)
        self.shift = np.zeros(self.buckets, dtype=np.int64)
        slots = np.full(n, -1, dtype=np.int64)
        trial = np.arange(256, dtype=np.uint64)
        singles = []
        for b in np.argsort(-sizes, kind="stable"):
            size = sizes[b]
            if size == 0:
                break
            own = order[starts[b] : starts[b + 1]]
            if size == 1:
                singles.append((b, own[0]))
                continue
            base = 0
            while True:
                at = (_mix(hashes[own][None, :], trial[:, None] + np.uint64(base)) % np.uint64(n)).astype(np.int64)
                good = free[at].all(axis=1)
                s = np.sort(at, axis=1)
                good &= (s[:, 1:] != s[:, :-1]).all(axis=1)
                hit = np.flatnonzero(good)
                if len(hit):
                    self.shift[b] = base + hit[0]
                    slots[own] = at[hit[0]]
                    free[at[hit[0]]] = False
                    break
                base += len(trial)
        for (b, key), slot in zip(singles, np.flatnonzero(free)):
            self.shift[b] = -1 - slot
            slots[key] = slot
        self.check = np.zeros(n, dtype=np.uint64)
        self.value = np.zeros(n, dtype=np.int64)
        self.check[slots] = hashes
        self.value[slots] = np.asarray(values, dtype=np.int64)
        stored = [b""] * n
        for i, k in zip(slots, keys):
            stored[i] = bytes(k)
        self.stored = stored

    def lookup(self, keys: Sequence[bytes]) -> np.ndarray:
        """The value of each key, -1 where it is not in the set."""
        if not len(keys) or not self.n:
            return np.full(len(keys), -1, dtype=np.int64)
        h = np.array([xxhash.xxh3_64_intdigest(k) for k in keys], dtype=np.uint64)
        d = self.shift[(h % np.uint64(self.buckets)).astype(np.int64)]
        slot = np.where(d < 0, -1 - d, (_mix(h, np.maximum(d, 0).astype(np.uint64)) % np.uint64(self.n)).astype(np.int64))
        out = np.where(self.check[slot] == h, self.value[slot], -1)
        for i in np.flatnonzero(out >= 0):
            if self.stored[slot[i]] != keys[i]:
                out[i] = -1
        return out
