"""A minimal perfect hash of byte strings: hash and displace, with direct slots for lone keys."""

from __future__ import annotations

import numpy as np

from ._shingles import U64, mix

_K = 0x9E3779B97F4A7C15


def hashes(keys: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each key, by numpy over 8-byte steps of all keys at once."""
    sizes = np.fromiter(map(len, keys), np.int64, len(keys))
    out = mix(sizes.astype(U64) + U64(_K))
    if not len(keys):
        return out
    begins = np.cumsum(sizes) - sizes
    raw = np.frombuffer(b"".join(keys) + bytes(8), np.uint8)
    live, at = np.arange(len(keys)), 0
    while len(live := live[sizes[live] > at]):
        word = np.zeros(len(live), U64)
        for k in range(8):
            inside = sizes[live] > at + k
            word |= np.where(inside, raw[np.minimum(begins[live] + at + k, len(raw) - 1)], 0).astype(U64) << U64(8 * k)
        out[live] = mix(out[live] ^ word) + U64(_K)
        at += 8
    return out


class PerfectHash:
    """Gives each of n distinct keys its own slot in 0..n-1; any other key gets some slot."""

    def __init__(self, keys: list[bytes]) -> None:
        self.n = n = len(keys)
        self.buckets = nb = max(1, n * 2 // 3)
        h = hashes(keys)
        if len(np.unique(h)) != n:
            raise ValueError("equal keys or hashes")
        of = (h % U64(nb)).astype(np.int64)
        order = np.argsort(of, kind="stable")
        sizes = np.bincount(of, minlength=nb)
        begins = np.cumsum(sizes) - sizes
        self.shift = np.zeros(nb, np.int64)
        free = np.ones(n, bool)
        for b in np.argsort(-sizes, kind="stable"):
            if sizes[b] < 2:
                break
            mine = h[order[begins[b] : begins[b] + sizes[b]]]
            d = 0
            while True:
                slots = self._slots(mine, d)
                if free[slots].all() and len(set(slots.tolist())) == len(slots):
                    break
                d += 1
            free[slots] = False
            self.shift[b] = d
        lone = np.flatnonzero(sizes == 1)
        self.shift[lone] = -1 - np.flatnonzero(free)[: len(lone)]

    def _slots(self, h: np.ndarray, d: np.ndarray | int) -> np.ndarray:
        return (mix(h + np.asarray(d).astype(U64) * U64(_K) + U64(1)) % U64(max(1, self.n))).astype(np.int64)

    def slots(self, keys: list[bytes]) -> np.ndarray:
        h = hashes(keys)
        d = self.shift[(h % U64(self.buckets)).astype(np.int64)]
        return np.where(d < 0, -1 - d, self._slots(h, np.maximum(d, 0)))
