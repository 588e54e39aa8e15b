"""Byte-pair merging with a heap over a linked list of symbols: O(n log n) for a piece of n symbols."""

from __future__ import annotations

from heapq import heapify, heappop, heappush

#: Bits of a symbol's number, and of a place in a piece.
BITS, PLACE = 24, 32
_SYMBOL, _AT = (1 << BITS) - 1, (1 << PLACE) - 1


def pair(left: int, right: int) -> int:
    """The key of two neighbours in a table of merges."""
    return left << BITS | right


def outcome(rank: int, joined: int) -> int:
    """The entry of a pair in a table of merges: its rank and the symbol it becomes."""
    return rank << BITS | joined


def merge(symbols: list[int], merges: dict[int, int]) -> list[int]:
    """Joins the neighbours of least rank, the leftmost first, until no pair is in ``merges``."""
    n = len(symbols)
    if n < 2:
        return symbols
    get = merges.get
    now = [get(symbols[i] << BITS | symbols[i + 1]) for i in range(n - 1)]
    # A heap entry is the outcome of a pair, rank first, above the place of its left symbol.
    heap = [v << PLACE | i for i, v in enumerate(now) if v is not None]
    if not heap:
        return symbols
    heapify(heap)
    parts, after, before = [*symbols, -1], list(range(1, n + 1)), list(range(-1, n))
    now.append(None)
    while heap:
        entry = heappop(heap)
        i = entry & _AT
        v = entry >> PLACE
        # An entry is out of date once the pair at its place is another one.
        if now[i] != v:
            continue
        j = after[i]
        parts[i] = joined = v & _SYMBOL
        parts[j], now[j] = -1, None
        after[i] = k = after[j]
        before[k] = i
        if k < n:
            now[i] = v = get(joined << BITS | parts[k])
            if v is not None:
                heappush(heap, v << PLACE | i)
        else:
            now[i] = None
        h = before[i]
        if h >= 0:
            now[h] = v = get(parts[h] << BITS | joined)
            if v is not None:
                heappush(heap, v << PLACE | h)
    return [p for p in parts if p >= 0]
