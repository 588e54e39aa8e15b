"""Token counts of a word-end BPE vocabulary by a whole-token shortcut.

On the driver, once: a vocabulary string is proven to encode alone as one token by
merging its bytes. A worker cuts a text into pre-tokens; those whose string is proven
count 1 by a table lookup, only the rest is merged (each distinct one once while the
bounded memo holds it).

Defined results: a null or empty text has 0 bytes and 0 tokens; special strings in a
text are one token each, as in the library's default; repeated rows get equal
answers; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._merge import merge, outcome, pair

LIMIT = 2048
#: Most distinct pre-tokens whose merged counts a worker remembers, and the characters of the longest of them.
MEMO, LONGEST = 200_000, 64
END = "</w>"
#: Characters of which NFC keeps every text and lower-casing needs no context.
PLAIN = r"[^\t\n\r\x20-\x7E\xA1-\xAC\xAE-ɏ‐-‧€]"


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in own]
    found = {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(other)}
    return [found[b] for b in range(256)]


class Vocabulary:
    """What a worker needs of a tokenizer file: merges, special strings, pattern and the proven strings."""

    def __init__(self, source: str) -> None:
        self.source = source
        data = json.loads(source)
        model = data["model"]
        number = model["vocab"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.merges = {pair(number[a], number[b]): outcome(rank, number[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.special = [t["content"] for t in data["added_tokens"]]
        self.pattern = data["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.letters = byte_letters()
        self.bytes = {c: b for b, c in enumerate(self.letters)}
        self.inner, self.last = [number[c] for c in self.letters], [number[c + END] for c in self.letters]
        self.whole = self._proven(number)

    def _proven(self, vocabulary: dict[str, int]) -> set[str]:
        out = set()
        for word, number in vocabulary.items():
            if word.endswith(END) and len(word) > len(END):
                try:
                    text = bytes(self.bytes[c] for c in word[: -len(END)]).decode()
                except (KeyError, UnicodeDecodeError):
                    continue
                if self.merged(text) == [number]:
                    out.add(text)
        return out

    def merged(self, piece: str) -> list[int]:
        raw = piece.encode()
        inner = self.inner
        return merge([*[inner[b] for b in raw[:-1]], self.last[raw[-1]]], self.merges)


class _Memo(dict):
    """Counts of pre-tokens: 1 for the proven ones from the start, merged at first sight for others."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        super().__init__(dict.fromkeys(vocabulary.whole, 1))
        self.vocabulary = vocabulary

    def __missing__(self, piece: str) -> int:
        if len(self) >= MEMO + len(self.vocabulary.whole):
            self.clear()
            self.update(dict.fromkeys(self.vocabulary.whole, 1))
        n = len(self.vocabulary.merged(piece))
        if len(piece) <= LONGEST:
            self[piece] = n
        return n


class Counter:
    """Counts tokens of texts; one per worker task."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        import regex

        self.vocabulary = vocabulary
        self.pieces = regex.compile(vocabulary.pattern).findall
        self.odd = regex.compile(PLAIN).search
        self.marks = regex.compile("|".join(map(regex.escape, vocabulary.special))) if vocabulary.special else None
        self.memo = _Memo(vocabulary)
        self.library = None

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if not self.marks or not any(s in text for s in self.vocabulary.special):
            return self._segment(text)
        segments = self.marks.split(text)
        return len(segments) - 1 + sum(self._segment(s) for s in segments if s)

    def _segment(self, text: str) -> int:
        found = self._by_library(text) if self.odd(text) else self.pieces(text.lower())
        return sum(map(self.memo.__getitem__, found))

    def _by_library(self, text: str) -> list[str]:
        """Pre-tokens of a text with unusual characters, normalised and cut by the library."""
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_str(self.vocabulary.source)
        of = self.vocabulary.bytes
        cut = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes(of[c] for c in piece).decode() for piece, _ in cut]


def token_counts(docs: DataFrame, path: str, *, limit: int = LIMIT) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_bytes, n_tokens, over_limit.

    ``path`` is a tokenizers file that the driver reads; it is broadcast (its size is that of the vocabulary).
    """
    with open(path, encoding="utf-8") as file:
        shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(file.read()))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(shared.value)
        for batch in batches:
            n = [counter.count(x.as_py()) for x in batch["text"]]
            yield pa.record_batch({"doc_id": batch["doc_id"], "n_bytes": batch["n_bytes"], "n_tokens": pa.array(n, pa.int64())})

    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    counted = docs.select("doc_id", "text", size.alias("n_bytes")).mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
