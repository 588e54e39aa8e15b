"""Word shingles of Arrow string columns as 64-bit hashes, by numpy over whole batches.

Words are maximal runs of bytes other than space and 0x09-0x0D, A-Z lower-cased.
A text's shingles are its distinct runs of ``width`` words; a text with fewer words
has its whole word sequence as one shingle; a text without words (or null) has none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_rng = np.random.Generator(np.random.PCG64(20240607))
#: A random odd value for each byte, the same one for both cases of A-Z.
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_BYTE[65:91] = _BYTE[97:123]
_BASE = 0x9E3779B97F4A7C15 | 5
_INVERSE = pow(_BASE, -1, 2**64)
_PLACE = _rng.integers(1, 2**63, 64, dtype=np.uint64) * U64(2) + U64(1)
_SEGMENT = 1 << 17
CHUNK_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U64)
    out[0] = 1
    return np.cumprod(out, dtype=U64)


_UP, _DOWN = _powers(_BASE, _SEGMENT + 1), _powers(_INVERSE, _SEGMENT + 1)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string or binary column and its n+1 offsets; null is empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where words begin and end, and the n+1 places at which each text's words begin."""
    size = len(raw)
    if not size:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~_SPACE[raw]
    first = np.zeros(size + 1, bool)
    first[offsets] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | first[1:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | first[1:-1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word, and the n+1 places at which each text's words begin."""
    starts, ends, places = word_spans(raw, offsets)
    out = np.empty(len(starts), U64)
    i = 0
    while i < len(starts):
        lo = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, lo + _SEGMENT, "right")))
        n = int(ends[j - 1] - lo)
        up, down = (_UP, _DOWN) if n <= _SEGMENT else (_powers(_BASE, n + 1), _powers(_INVERSE, n + 1))
        total = np.zeros(n + 1, U64)
        np.cumsum(_BYTE[raw[lo : lo + n]] * up[:n], out=total[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = (total[e] - total[s]) * down[s]
        i = j
    return mix(out), places


def shingle_sets(column: pa.Array, width: int = 5) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Chunks of texts as (first row, sorted distinct hashes, their n+1 places), each of about CHUNK_BYTES."""
    raw, offsets = text_bytes(column)
    row, rows = 0, len(offsets) - 1
    while row < rows:
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK_BYTES, "right")) - 1)
        part = offsets[row : last + 1]
        words, places = word_hashes(raw[part[0] : part[-1]], part - part[0])
        yield row, *_sets(words, places, width)
        row = last


def _sets(words: np.ndarray, places: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    counts = np.diff(places)
    made = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    begin = np.concatenate(([0], np.cumsum(made)))
    total = int(begin[-1])
    if not total:
        return np.zeros(0, U64), begin
    owner = np.repeat(np.arange(len(counts)), made)
    at = np.arange(total) - begin[owner] + places[owner]
    hashed = np.zeros(total, U64)
    length = np.minimum(counts, width)[owner]
    short = bool((length < width).any())
    for k in range(width):
        if short:
            use = length > k
            hashed[use] += words[at[use] + k] * _PLACE[k]
        else:
            hashed += words[at + k] * _PLACE[k]
    hashed = mix(hashed + length.astype(U64))
    for a, b in zip(begin[:-1], begin[1:], strict=True):
        if b - a > 1:
            hashed[a:b].sort()
    keep = np.ones(total, bool)
    keep[1:] = hashed[1:] != hashed[:-1]
    keep[begin[:-1][made > 0]] = True
    kept = np.concatenate(([0], np.cumsum(keep)))
    return hashed[keep], kept[begin]
