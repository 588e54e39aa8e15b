"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts of hashed 1- to 3-grams per language are summed by Spark from per-batch
numpy counts; at most languages x ``BUCKETS`` sums reach the driver, which makes the
matrix of log probabilities and broadcasts it. A batch is scored as a sparse matrix:
the n-gram indices of all its texts in a row and the places where texts begin.

Defined results: a null text or one without a letter is ``und`` with score 0, and so
is every text if no labelled row was learned from; the training set leaves out rows
with a null text or language; ties go to the least language; repeated rows get equal
answers; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._memory import released

#: Hash buckets of n-grams, the longest n-gram, and the most characters handled at once.
BUCKETS, LONGEST, SEGMENT = 1 << 15, 3, 1 << 17
#: Scores that are held at once, one for each code and language, and texts that are judged at once.
SCORES, SLICE = 1 << 21, 512
#: About how many labelled rows the fit reads (whole texts; all of them if there are fewer), shared out by language, and the most languages.
FIT_ROWS, MAX_LANGUAGES = 20_000, 512
#: Below this score a document counts as rejected, and so does a text of at least FEW n-grams whose mean log probability
#: lies more than MARGIN below what the chosen language's own n-grams have: it is in no learned language.
LEAST_SCORE, MARGIN, FEW = 0.5, 3.5, 30
UNKNOWN = "und"
_letter: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    if not _letter:
        _letter.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letter[0]


def segments(texts: list[str | None], most: int = SEGMENT) -> Iterator[tuple[list[int], np.ndarray, np.ndarray, np.ndarray]]:
    """Texts as runs of lower-cased code points, others than letters as blanks: (owners, their beginnings, codes, least).

    A text longer than ``most`` comes in pieces that overlap by LONGEST - 1. At a place of a piece with ``least`` or
    more codes left n-grams begin; those at its end begin in the next piece again and count there.
    """
    owners: list[int] = []
    parts: list[np.ndarray] = []
    least: list[int] = []
    size = 0

    def flush() -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray]:
        return owners, np.cumsum([0] + [len(p) for p in parts]), np.concatenate(parts), np.array(least)

    for i, text in enumerate(texts):
        if not text:
            continue
        codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = np.where(letters()[codes], codes, np.uint32(32))
        for at in range(0, max(1, len(codes) - LONGEST + 1), most):
            piece = codes[at : at + most + LONGEST - 1]
            owners.append(i)
            parts.append(piece)
            least.append(LONGEST if at + most < len(codes) - LONGEST + 1 else 1)
            size += len(piece)
            if size >= most:
                yield flush()
                owners, parts, least, size = [], [], [], 0
    if parts:
        yield flush()


def grams(begins: np.ndarray, codes: np.ndarray, least: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n: the bucket of the n-gram at every place, and whether it counts there."""
    left = np.repeat(begins[1:], np.diff(begins)) - np.arange(len(codes))
    need = np.repeat(least, np.diff(begins))
    mixed = np.zeros(len(codes), np.uint32)
    for n in range(1, LONGEST + 1):
        mixed[: len(codes) - n + 1] = (mixed[: len(codes) - n + 1] ^ codes[n - 1 :]) * np.uint32(0x9E3779B1)
        x = mixed + np.uint32(n * 0x85EBCA6B % 2**32)
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        yield (x >> np.uint32(17)).astype(np.int32), left >= np.maximum(need, n)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = batch["lang"].to_pylist()
        for owners, begins, codes, least in segments(batch["text"].to_pylist()):
            kinds = sorted({langs[i] for i in owners})
            place = np.repeat([kinds.index(langs[i]) for i in owners], np.diff(begins))
            for found, whole in grams(begins, codes, least):
                seen = np.bincount((place * BUCKETS + found)[whole], minlength=len(kinds) * BUCKETS).reshape(-1, BUCKETS)
                for k, row in zip(kinds, seen, strict=True):
                    total[k] = total.get(k, 0) + row
    for k, row in total.items():
        at = np.flatnonzero(row)
        yield pa.record_batch({"lang": pa.array([k] * len(at), pa.string()), "bucket": pa.array(at, pa.int32()), "n": pa.array(row[at], pa.int64())})


class Model:
    """Languages in order and the (BUCKETS, languages) log probabilities with the log priors."""

    def __init__(self, langs: list[str], logs: np.ndarray, prior: np.ndarray) -> None:
        self.langs, self.logs, self.prior = langs, logs, prior
        self.usual = (np.exp(logs, dtype=np.float64) * logs).sum(axis=0)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Languages, scores, and which texts are to be rejected."""
        if not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        likely = np.zeros((len(texts), len(self.langs)))
        n = np.zeros(len(texts), np.int64)
        spoken = np.zeros(len(texts), bool)
        for owners, begins, codes, least in segments(texts, max(LONGEST, min(SEGMENT, SCORES // len(self.langs)))):
            starts = begins[:-1]
            part = np.zeros((len(owners), len(self.langs)))
            for found, whole in grams(begins, codes, least):
                score = self.logs[found]
                score[~whole] = 0
                part += np.add.reduceat(score, starts, axis=0, dtype=np.float64)
                np.add.at(n, owners, np.add.reduceat(whole, starts, dtype=np.int64))
            np.add.at(likely, owners, part)
            np.logical_or.at(spoken, owners, np.logical_or.reduceat(codes != 32, starts))
        sums = likely + self.prior
        best = sums.argmax(axis=1)
        chance = np.where(spoken, 1 / np.exp(sums - sums.max(axis=1, keepdims=True)).sum(axis=1), 0.0)
        foreign = (n >= FEW) & (likely[np.arange(len(texts)), best] < n * (self.usual[best] - MARGIN))
        return [self.langs[b] if s else UNKNOWN for b, s in zip(best, spoken, strict=True)], chance, ~spoken | (chance < LEAST_SCORE) | foreign


def fold(doc_id: Column) -> Column:
    """The fold of a document: crc32 of its id as text, mod 3; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def _most(counts: list[int], rows: int) -> float:
    """The share of a frequent language, so that it and all rows of the rarer ones add up to ``rows``."""
    left = rows
    for k, n in enumerate(sorted(counts)):
        if n * (len(counts) - k) >= left:
            return left / (len(counts) - k)
        left -= n
    return float(max(counts, default=0))


def fit(docs: DataFrame, *, rows: int = FIT_ROWS) -> Model:
    """Learns from text and lang of documents of folds 0 and 2: all of a rare language, a sample of a frequent one."""
    known = docs.select("doc_id", "text", "lang").filter(F.col("text").isNotNull() & F.col("lang").isNotNull() & (fold(F.col("doc_id")) != 1))
    per_lang = known.groupBy("lang").count().orderBy("lang").limit(MAX_LANGUAGES + 1).collect()
    if len(per_lang) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    total = sum(r["count"] for r in per_lang)
    if total > rows:
        most = _most([r["count"] for r in per_lang], rows)
        bounds = {r["lang"]: int(most / r["count"] * (1 << 30)) for r in per_lang if r["count"] > most}
        bound = F.coalesce(F.create_map(*[F.lit(x) for pair in bounds.items() for x in pair])[F.col("lang")], F.lit(1 << 30))
        known = known.filter(F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(1 << 30)) < bound)
    counts = known.select("text", "lang").mapInArrow(released(_count), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(counts["lang"].to_pylist()))
    if not langs:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0))
    seen = np.zeros((BUCKETS, len(langs)))
    place = {k: i for i, k in enumerate(langs)}
    np.add.at(seen, (counts["bucket"].to_numpy(), np.array([place[k] for k in counts["lang"].to_pylist()])), counts["n"].to_numpy())
    prior = np.array([next(r["count"] for r in per_lang if r["lang"] == k) for k in langs], float)
    return Model(langs, np.log((seen + 0.5) / (seen + 0.5).sum(axis=0)).astype(np.float32), np.log(prior / prior.sum()))


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, and lang to fit on): doc_id, held_out, lang_pred, score, rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(model or fit(docs))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), SLICE):
                part = batch.slice(at, SLICE)
                langs, score, out = shared.value.predict(part["text"].to_pylist())
                yield pa.record_batch({"doc_id": part["doc_id"], "lang_pred": pa.array(langs, pa.string()), "score": pa.array(score, pa.float64()), "rejected": pa.array(out, pa.bool_())})

    found = docs.select("doc_id", "text").mapInArrow(released(run), f"doc_id {kind}, lang_pred string, score double, rejected boolean")
    return found.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


def accepted(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """The rows of ``docs`` that are not rejected, in its columns: judged in one pass, without a join."""
    shared = docs.sparkSession.sparkContext.broadcast(model or fit(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [shared.value.predict(batch["text"].slice(at, SLICE).to_pylist())[2] for at in range(0, len(batch), SLICE)]
            yield batch.filter(pa.array(~np.concatenate([np.zeros(0, bool), *out]), pa.bool_()))

    return docs.mapInArrow(released(run), docs.schema)
