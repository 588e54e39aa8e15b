"""Fast similarity sketches: hashed bin placement in rounds until every coordinate is filled.

In round i < t every element goes to a hashed bin with a hashed value; in round
t + j every element goes to bin j. A bin keeps the least (round, value) it gets, so
an early round decides it, and after 2t rounds all are filled whatever the set's
size. Two sets agree in a coordinate with probability equal to their Jaccard
similarity, and the number of agreeing coordinates concentrates as if the
coordinates were drawn independently.
"""

from __future__ import annotations

import numpy as np

from ._shingles import U64, mix

_EMPTY = U64(2**64 - 1)
_STEP = 0x9E3779B97F4A7C15


def sketch(hashes: np.ndarray, places: np.ndarray, t: int) -> np.ndarray:
    """The (sets, t) sketch of consecutive sets; a row of an empty set is all ones."""
    counts = np.diff(places)
    n = len(counts)
    out = np.full(n * t, _EMPTY, U64)
    live = np.flatnonzero(counts)
    owner = np.repeat(np.arange(n), counts)
    for i in range(2 * t):
        if not len(live):
            break
        if i:
            chosen = np.zeros(n, bool)
            chosen[live] = True
            keep = chosen[owner]
            if not keep.all():
                hashes, owner = hashes[keep], owner[keep]
        x = mix(hashes ^ U64((i + 1) * _STEP % 2**64))
        place = ((x >> U64(32)) * U64(t) >> U64(32)).astype(np.int64) if i < t else i - t
        # 54 bits of value below 9 of the round: a later round never replaces an earlier one.
        value = (U64(i) << U64(54)) | (mix(x) >> U64(10))
        np.minimum.at(out, owner * t + place, value)
        live = live[(out.reshape(n, t)[live] == _EMPTY).any(axis=1)]
    return out.reshape(n, t)


def bands(sketches: np.ndarray, rows: int) -> np.ndarray:
    """The (sets, t // rows) band keys as signed 64-bit integers."""
    n, t = sketches.shape
    parts = mix(sketches.copy()).reshape(n, t // rows, rows)
    key = np.zeros((n, t // rows), U64) + np.arange(1, t // rows + 1, dtype=U64) * U64(_STEP)
    for k in range(rows):
        key = mix(key ^ parts[:, :, k])
    return key.view(np.int64)
