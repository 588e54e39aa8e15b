"""Byte-level BPE encoding and decoding by a two-tier lookup.

Tier one: the distinct pre-tokens of a batch are looked up in a minimal perfect hash
of the vocabulary, whose entry is compared with the whole pre-token. Tier two: misses
are merged with a heap over linked bytes. Decoding gathers the tokens' bytes by numpy.

Defined results: a null text encodes as an empty one; both give no ids; repeated rows
get equal answers; an empty table gives an empty result; other columns are not read
by ``encoded`` and ``tokens``.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator, Sequence
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._memory import released
from ._merge import merge, outcome, pair
from ._perfect_hash import PerfectHash

#: Most distinct pre-tokens that a worker remembers; characters of texts, and pre-tokens of a longer text, that share a lookup.
MEMO, CHUNK, PIECES = 450_000, 1 << 20, 200_000
#: Characters of the longest pre-token that is remembered beyond the texts at hand.
LONGEST = 48


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks file: a base64 token and its rank in each line."""
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}


class Codec:
    """Encodes and decodes with ``ranks``, cutting texts by ``pattern``; small enough to broadcast (the vocabulary's size).

    ``most`` pre-tokens are remembered; it decides time and memory, never a result.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, most: int = MEMO) -> None:
        keys = list(ranks)
        self.ranks, self.pattern, self.most = ranks, pattern, most
        self.hash = PerfectHash(keys)
        self.slots: list[bytes] = [b""] * len(keys)
        for key, slot in zip(keys, self.hash.slots(keys).tolist(), strict=True):
            self.slots[slot] = key
        top = max(ranks.values(), default=-1) + 1
        tokens = [b""] * top
        for key, rank in ranks.items():
            tokens[rank] = key
        self.raw = np.frombuffer(b"".join(tokens), np.uint8)
        self.size = np.fromiter(map(len, tokens), np.int64, top)
        self.begin = np.cumsum(self.size) - self.size
        # Every split of a token into two tokens is a merge of the token's rank.
        self.one = [ranks.get(bytes((b,)), -1) for b in range(256)]
        splits = ((rank, ranks.get(key[:k]), ranks.get(key[k:])) for key, rank in ranks.items() for k in range(1, len(key)))
        self.merges = {pair(a, b): outcome(rank, rank) for rank, a, b in splits if a is not None and b is not None}
        #: The ids of each token alone, and of remembered pre-tokens, as little-endian 32-bit bytes.
        self.alone = [rank.to_bytes(4, "little") for rank in range(top)]
        self.memo: dict[str, bytes] = {}
        self.cut = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"memo": {}, "cut": None}

    def _learn(self, pieces: list[str]) -> None:
        """Puts the ids of new distinct pre-tokens into the memo."""
        keys = [p.encode() for p in pieces]
        ranks, slots, memo, merges, one, alone = self.ranks, self.slots, self.memo, self.merges, self.one, self.alone
        for piece, key, slot in zip(pieces, keys, self.hash.slots(keys).tolist(), strict=True):
            memo[piece] = alone[ranks[key]] if slots[slot] == key else b"".join([alone[i] for i in merge([one[b] for b in key], merges)])

    def encode(self, text: str | None) -> np.ndarray:
        return next(self.encode_all([text]))

    def encode_all(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        """The ids of each text; short texts share a lookup, a long one takes several."""
        if self.cut is None:
            import regex

            self.cut = regex.compile(self.pattern)
        group, size = [], 0
        for text in texts:
            text = text or ""
            if size + len(text) > CHUNK:
                yield from self._group(group)
                group, size = [], 0
            if len(text) > CHUNK:
                found = (m[0] for m in self.cut.finditer(text))
                yield np.concatenate([np.zeros(0, np.uint32), *(ids for part in batched(found, PIECES) for ids in self._group([part]))])
            else:
                group.append(self.cut.findall(text))
                size += len(text)
        yield from self._group(group)

    def _group(self, group: list[Sequence[str]]) -> Iterator[np.ndarray]:
        memo = self.memo
        new = set().union(*group).difference(memo)
        if len(memo) + len(new) > self.most:
            memo.clear()
            new = set().union(*group)
        if new:
            self._learn(list(new))
        for pieces in group:
            yield np.frombuffer(b"".join(map(memo.__getitem__, pieces)), "<u4")
        for piece in new:
            if len(piece) > LONGEST:
                del memo[piece]

    def decode(self, ids: np.ndarray) -> bytes:
        sizes = self.size[ids]
        ends = np.cumsum(sizes)
        if not len(ids):
            return b""
        return self.raw[np.repeat(self.begin[ids] - ends + sizes, sizes) + np.arange(ends[-1])].tobytes()


def _texts(batch: pa.RecordBatch) -> Iterator[str | None]:
    for x in batch["text"]:
        yield x.as_py()


def encoded(docs: DataFrame, codec: Codec) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_tokens, ids_sha256, decoded_sha256."""
    shared = docs.sparkSession.sparkContext.broadcast(codec)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = shared.value
        # Decimal strings of all ids, for the digest.
        names = np.array([str(i) for i in range(len(coder.size))], object)
        for batch in batches:
            n, ids, back = [], [], []
            for found in coder.encode_all(_texts(batch)):
                n.append(len(found))
                ids.append(hashlib.sha256(",".join(names[found].tolist()).encode()).hexdigest())
                back.append(hashlib.sha256(coder.decode(found)).hexdigest())
            yield pa.record_batch({"doc_id": batch["doc_id"], "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids, pa.string()), "decoded_sha256": pa.array(back, pa.string())})

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def tokens(docs: DataFrame, codec: Codec) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, ids (array<int>), text as decoded from the ids."""
    shared = docs.sparkSession.sparkContext.broadcast(codec)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = shared.value
        for batch in batches:
            for at in range(0, len(batch), 64):
                part = batch.slice(at, 64)
                found = list(coder.encode_all(_texts(part)))
                ends = np.cumsum([0, *map(len, found)])
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(found).astype(np.int32)))
                text = pa.array([coder.decode(x).decode() for x in found], pa.string())
                yield pa.record_batch({"doc_id": part["doc_id"], "ids": ids, "text": text})

    return docs.select("doc_id", "text").mapInArrow(released(run), f"doc_id {kind}, ids array<int>, text string")
