"""Token ids of the blank-separated words of Arrow string columns, each distinct word encoded once by the library.

A word of at most ``SHORT`` bytes is its own exact key, packed into two 64-bit numbers and looked up in an
open-addressing table by numpy over all words of a batch; longer words are keyed by their bytes, and those of
more than ``KEPT`` bytes are forgotten after the batch. Memory is bounded by ``MOST`` words; when they are
reached, the memo starts anew.

Cutting at blanks, and before a mark of ``_MARKS`` that follows an ASCII letter or digit, is right only for
tokenizers whose tokens never span such a place: ``cuts_at_blanks`` knows the configuration for which this
holds. With any other, a text is one word.
"""

from __future__ import annotations

import json
import os
from itertools import batched, chain

import numpy as np

from ._shingles import U64, mix, word_spans

SHORT, KEPT, MOST = 15, 64, 1 << 20
#: Bytes of text that are looked up together, and words that the library gets at a time.
CHUNK, BATCH = 4 << 20, 512
#: The keys' bits for each number of bytes.
_BITS = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)
#: Fixed value: a pattern of pre-tokens none of which holds white space.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_ALNUM, _MARKS = np.zeros(256, bool), np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_MARKS[[ord(c) for c in ',.;:!?)"']] = True


def cuts_at_blanks(source: str) -> bool:
    """Whether no token or special string of a tokenizers file spans a blank, and no normaliser looks across one."""
    data = json.loads(source)
    normal = data["normalizer"] or {}
    kinds = [x.get("type") for x in normal.get("normalizers", [normal])]
    before = data["pre_tokenizer"] or {}
    steps = before.get("pretokenizers", [before])
    cut = bool(steps) and steps[0].get("type") == "Split" and steps[0]["pattern"] == {"Regex": _PATTERN} and steps[0]["behavior"] == "Removed" and steps[0]["invert"]
    rest = all(x["type"] == "ByteLevel" and not x["add_prefix_space"] and not x["use_regex"] for x in steps[1:])
    marks = all(not t["lstrip"] and not t["rstrip"] and not any(c.isspace() or _MARKS[ord(c) % 256] for c in t["content"]) for t in data["added_tokens"])
    return kinds == ["NFC", "Replace", "Lowercase"] and cut and rest and marks


class Words:
    """The memo of one worker process."""

    def __init__(self, source: str, end: int) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(source)
        self.library.no_truncation()
        self.library.no_padding()
        self.blanks = cuts_at_blanks(source)
        # The token of a single zero byte, if byte-level words have one.
        zero = self.library.encode("\0", add_special_tokens=False).ids
        self.mark = zero[0] if self.blanks and len(zero) == 1 else None
        self.end = end
        self._clear()

    def _clear(self) -> None:
        self.pool = np.array([self.end], np.uint32)
        self.begin, self.size = np.zeros(1, np.int64), np.ones(1, np.int64)
        self.long: dict[bytes, int] = {}
        self._table(1 << 16)

    def _table(self, capacity: int) -> None:
        self.low, self.high = np.zeros(capacity, U64), np.zeros(capacity, U64)
        self.slot = np.full(capacity, -1, np.int64)
        self.used = 0

    def _find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 for unknown ones."""
        mask = len(self.slot) - 1
        out = np.full(len(low), -1, np.int64)
        at = (mix(low ^ mix(high)) & U64(mask)).astype(np.int64)
        open_ = np.arange(len(low))
        while len(open_):
            place = at[open_]
            slot = self.slot[place]
            same = (slot >= 0) & (self.low[place] == low[open_]) & (self.high[place] == high[open_])
            out[open_[same]] = slot[same]
            open_ = open_[(slot >= 0) & ~same]
            at[open_] = (at[open_] + 1) & mask
        return out

    def _put(self, low: np.ndarray, high: np.ndarray, slots: np.ndarray) -> None:
        """Adds distinct unknown keys."""
        if 2 * (self.used + len(low)) > len(self.slot):
            full = self.slot >= 0
            low, high, slots = (np.concatenate(x) for x in ((self.low[full], low), (self.high[full], high), (self.slot[full], slots)))
            capacity = len(self.slot)
            while capacity < 4 * len(low):
                capacity *= 2
            self._table(capacity)
        mask = len(self.slot) - 1
        at = (mix(low ^ mix(high)) & U64(mask)).astype(np.int64)
        left = np.arange(len(low))
        while len(left):
            free = left[self.slot[at[left]] < 0]
            self.slot[at[free]] = slots[free]
            won = free[self.slot[at[free]] == slots[free]]
            self.low[at[won]], self.high[at[won]] = low[won], high[won]
            left = left[self.slot[at[left]] != slots[left]]
            at[left] = (at[left] + 1) & mask
        self.used += len(low)

    def _ids(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in a row, and the number of each word's ids."""
        if self.mark is None:
            found = [e.ids for some in batched(words, BATCH) for e in self.library.encode_batch_fast([w.decode() for w in some], add_special_tokens=False)]
            size = np.fromiter(map(len, found), np.int64, len(found))
            return np.fromiter(chain.from_iterable(found), np.uint32, int(size.sum())), size
        # Words that are encoded in one text are told apart by the token of a byte that none of them has.
        parts = [self.library.encode_batch_fast([(b" \0 ".join(some) + b" \0").decode()], add_special_tokens=False)[0].ids for some in batched(words, BATCH)]
        ids = np.fromiter(chain.from_iterable(parts), np.uint32, sum(map(len, parts)))
        ends = np.flatnonzero(ids == self.mark)
        return np.delete(ids, ends), np.diff(ends, prepend=-1) - 1

    def _learn(self, words: list[bytes]) -> np.ndarray:
        """New slots with the ids of ``words``."""
        if self.mark is not None and any(b"\0" in w for w in words):
            plain, mark = [w for w in words if b"\0" not in w], self.mark
            slots = dict(zip(plain, self._learn(plain).tolist(), strict=True))
            self.mark = None
            odd = [w for w in words if b"\0" in w]
            slots |= zip(odd, self._learn(odd).tolist(), strict=True)
            self.mark = mark
            return np.array([slots[w] for w in words], np.int64)
        ids, size = self._ids(words)
        first, at = len(self.size), len(self.pool)
        self.pool = np.concatenate((self.pool, ids))
        self.begin = np.concatenate((self.begin, at + np.cumsum(size) - size))
        self.size = np.concatenate((self.size, size))
        return np.arange(first, first + len(words))

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts with the end id after each, and the n+1 places at which texts begin."""
        parts, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        row, rows = 0, len(offsets) - 1
        while row < rows:
            last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK, "right")) - 1)
            part = offsets[row : last + 1]
            text, places = raw[part[0] : part[-1]], part - part[0]
            if len(text) > CHUNK and self.blanks:
                found = [self._chunk(piece, np.array([0, len(piece)]))[0][:-1] for piece in _pieces(text)]
                ids = np.concatenate([*found, np.array([self.end], np.uint32)])
                size = np.array([len(ids)])
            else:
                ids, size = self._chunk(text, places)
            parts.append(ids)
            sizes.append(size)
            row = last
        return np.concatenate(parts), np.concatenate(([0], np.cumsum(np.concatenate(sizes))))

    def _chunk(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.used + len(self.long) > MOST:
            self._clear()
        starts, ends, places = _cut(raw, offsets) if self.blanks else _texts(offsets)
        length = ends - starts
        held = raw.tobytes()
        slots = np.empty(len(starts), np.int64)

        short = np.flatnonzero(length <= SHORT)
        n = length[short]
        padded = np.concatenate((raw, np.zeros(16, np.uint8)))
        eight = np.ndarray((len(raw) + 9,), "<u8", padded, strides=(1,))
        low = eight[starts[short]] & _BITS[np.minimum(n, 8)]
        high = (eight[starts[short] + np.minimum(n, 8)] & _BITS[np.maximum(n - 8, 0)]) | (n.astype(U64) << U64(56))
        found = self._find(low, high)
        new = np.flatnonzero(found < 0)
        if len(new):
            new = new[np.lexsort((high[new], low[new]))]
            first = np.ones(len(new), bool)
            first[1:] = (low[new[1:]] != low[new[:-1]]) | (high[new[1:]] != high[new[:-1]])
            once = new[first]
            made = self._learn([held[a:b] for a, b in zip(starts[short[once]].tolist(), ends[short[once]].tolist(), strict=True)])
            self._put(low[once], high[once], made)
            found[new] = made[np.cumsum(first) - 1]
        slots[short] = found

        rest = np.flatnonzero(length > SHORT)
        words = [held[a:b] for a, b in zip(starts[rest].tolist(), ends[rest].tolist(), strict=True)]
        fresh = set(words).difference(self.long)
        keep, drop = [w for w in fresh if len(w) <= KEPT], [w for w in fresh if len(w) > KEPT]
        self.long.update(zip(keep, self._learn(keep).tolist(), strict=True))
        mark = len(self.size), len(self.pool)
        passing = dict(zip(drop, self._learn(drop).tolist(), strict=True))
        slots[rest] = [passing[w] if w in passing else self.long[w] for w in words]

        # The end id is slot 0 and follows the last word of each text.
        slots = np.insert(slots, places[1:], 0)
        size = self.size[slots]
        after = np.cumsum(size)
        ids = self.pool[np.repeat(self.begin[slots] - after + size, size) + np.arange(int(after[-1]) if len(after) else 0)]
        last = after[places[1:] + np.arange(len(places) - 1)]
        self.begin, self.size, self.pool = self.begin[: mark[0]], self.size[: mark[0]], self.pool[: mark[1]]
        return ids, np.diff(last, prepend=0)


def _cut(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of words, cut before marks as well."""
    starts, ends, _ = word_spans(raw, offsets)
    more = np.zeros(len(raw) + 1, bool)
    more[1:-1] = _MARKS[raw[1:]] & _ALNUM[raw[:-1]]
    more[offsets] = False
    at = np.flatnonzero(more)
    starts, ends = np.sort(np.concatenate((starts, at))), np.sort(np.concatenate((ends, at)))
    return starts, ends, np.searchsorted(starts, offsets)


def _texts(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of whole texts; an empty one has none."""
    starts, ends = offsets[:-1], offsets[1:]
    full = ends > starts
    return starts[full], ends[full], np.concatenate(([0], np.cumsum(full)))


def _pieces(raw: np.ndarray) -> list[np.ndarray]:
    """A long text cut at blanks into pieces of about CHUNK bytes, longer where a word is."""
    blanks = np.flatnonzero(raw == 0x20)
    out, at = [], 0
    while at < len(raw):
        k = int(np.searchsorted(blanks, at + CHUNK))
        stop = int(blanks[k]) + 1 if k < len(blanks) and len(raw) - at > CHUNK else len(raw)
        out.append(raw[at:stop])
        at = stop
    return out


_held: dict[tuple[str, int], Words] = {}


def words(source: str, end: int) -> Words:
    """The memo of this process for a tokenizers file; it outlives tasks and is the only one."""
    if (source, end) not in _held:
        _held.clear()
        _held[source, end] = Words(source, end)
    return _held[source, end]
