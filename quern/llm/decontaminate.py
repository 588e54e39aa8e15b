"""Benchmark decontamination: size-partitioned MinHash containment search.

Test items are short and documents are long, so a document's Jaccard similarity with an item that it contains is tiny
(the README has figures of what banded signatures of the two would find). The sketches here are bottom-k MinHashes of
the items, partitioned by size: a partition fixes how many minima its sketches have and how many of them a document must
hold. If a document holds ``need`` = ceil(percent * q) of an item's q shingles, it lacks q - need of them at most, so of
the item's k least hashes it holds at least k - (q - need), whatever the hash function. A partition takes k = q - need +
m minima and asks for m of them, more for larger items: no contaminated document is missed, and one passage that many
items share does not make all of them candidates. Candidates are verified on the full shingle sets.

Items are dealt into blocks of ``BLOCK_SHINGLES`` shingles and one item at most; each block is broadcast and all
documents are searched against it, so what is broadcast is bounded.

Defined results: a null, empty or blank document or item has no shingles and matches
nothing; an item of fewer words than a shingle matches only documents of just these
words; repeated items are found each; a null item id is listed as null; empty tables
give clean documents or an empty result; other columns are not read by ``contamination``
and kept by ``clean``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ._memory import released
from ._shingles import U64, shingle_sets
from ._stash import Stash

WIDTH, PERCENT = 5, 75
#: Shingles of test items in a broadcast block (8 MB of hashes and as much of sketches), and the minima that a sketch of a large item must share.
BLOCK_SHINGLES, SHARED = 1_000_000, 8
#: Tasks that the rows of one text are dealt to where hits of several blocks are merged.
SALTS = 16


class Partition:
    """The sketches of items of 2^size to 2^(size + 1) - 1 shingles: their minima in ascending order, and the number a document must hold."""

    def __init__(self, size: int, items: list[int], sets: list[np.ndarray], need: list[int]) -> None:
        #: An eighth of the least item's shingles, but one at least.
        self.least = max(1, min(SHARED, 1 << size >> 3))
        take = [min(len(sets[i]), len(sets[i]) - need[i] + self.least) for i in items]
        # Where an item has fewer shingles than that, all of them are its sketch.
        self.ask = np.array([k - (len(sets[i]) - need[i]) for i, k in zip(items, take, strict=True)])
        self.items = np.array(items)
        hashes = np.concatenate([sets[i][:k] for i, k in zip(items, take, strict=True)])
        owner = np.repeat(np.arange(len(items)), take)
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.owner = hashes[order], owner[order]

    def candidates(self, found: np.ndarray) -> np.ndarray:
        """The items of whose sketches a document's sorted set holds enough."""
        lo = np.searchsorted(self.hashes, found, "left")
        hit = np.flatnonzero((lo < len(self.hashes)) & (self.hashes[np.minimum(lo, len(self.hashes) - 1)] == found))
        if not len(hit):
            return self.items[:0]
        first = lo[hit]
        n = np.searchsorted(self.hashes, found[hit], "right") - first
        owners = self.owner[np.repeat(first - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]
        which, held = np.unique(owners, return_counts=True)
        return self.items[which[held >= self.ask[which]]]


class Index:
    """Items' shingle sets with their sketches by partition."""

    def __init__(self, ids: list, sets: list[np.ndarray], percent: int) -> None:
        self.ids, self.sets = ids, sets
        self.need = [-(-len(s) * percent // 100) for s in sets]
        sizes = [len(s).bit_length() - 1 for s in sets]
        self.partitions = [Partition(k, [i for i, x in enumerate(sizes) if x == k], sets, self.need) for k in sorted(set(sizes))]

    def search(self, found: np.ndarray) -> list[tuple[int, int]]:
        """(item, shared shingles) of the items that the sorted set ``found`` contains."""
        out = []
        for i in sorted(int(i) for p in self.partitions for i in p.candidates(found)):
            mine = self.sets[i]
            at = np.minimum(np.searchsorted(found, mine), len(found) - 1)
            both = int((found[at] == mine).sum())
            if both >= self.need[i]:
                out.append((i, both))
        return out


def _indexes(items: DataFrame, width: int, percent: int, block: int) -> Iterator[Index]:
    kind = items.schema["item_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, hashes, places in shingle_sets(batch["text"], width):
                parts = [hashes[a:b].tobytes() for a, b in zip(places[:-1], places[1:], strict=True)]
                yield pa.record_batch({"item_id": batch["item_id"].slice(at, len(parts)), "n": pa.array(np.diff(places), pa.int64()), "shingles": pa.array(parts, pa.binary())})

    sets = items.select("item_id", "text").mapInArrow(run, f"item_id {kind}, n long, shingles binary").filter("n > 0")
    sets = Stash(items.sparkSession, "items").put(sets, "sets").select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    # Running totals of shingles, within files and over the files' sums, deal items into blocks of one size.
    files = sets.groupBy("file").agg(F.sum("n").alias("all"))
    before = files.select("file", (F.sum("all").over(Window.orderBy("file")) - F.col("all")).alias("before"))
    within = F.sum("n").over(Window.partitionBy("file").orderBy("row")) - F.col("n")
    total = files.agg(F.sum("all")).first()[0] or 0
    dealt = sets.withColumn("within", within).join(before, "file").withColumn("block", F.floor((F.col("within") + F.col("before")) / block))
    for k in range(max(1, -(-total // block))):
        rows = dealt.filter(F.col("block") == k).select("item_id", "shingles").collect()
        yield Index([r["item_id"] for r in rows], [np.frombuffer(r["shingles"], U64) for r in rows], percent)


def _search(docs: DataFrame, shared: Broadcast, width: int, key: T.DataType) -> DataFrame:
    """The items of one broadcast index in each row of ``docs``, whose columns but the text are kept."""
    kept = [f for f in docs.schema.fields if f.name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = shared.value.ids
        for batch in batches:
            for at, hashes, places in shingle_sets(batch["text"], width):
                found = [shared.value.search(hashes[a:b]) if b > a else [] for a, b in zip(places[:-1], places[1:], strict=True)]
                yield pa.record_batch({f.name: batch[f.name].slice(at, len(found)) for f in kept} | {
                    "n_shingles": pa.array(np.diff(places), pa.int64()),
                    "items": pa.array([[ids[i] for i, _ in x] for x in found], key_type),
                    "shared": pa.array([[n for _, n in x] for x in found], pa.list_(pa.int64())),
                })

    key_type = pa.list_(to_arrow_type(key))
    before = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in kept)
    return docs.mapInArrow(run, f"{before}n_shingles long, items array<{key.simpleString()}>, shared array<long>")


def contamination(docs: DataFrame, items: DataFrame, *, width: int = WIDTH, percent: int = PERCENT, block: int = BLOCK_SHINGLES) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, items (ids found), shared (shingles of each), contaminated.

    The first block of items is searched for every row. Hits of further blocks are written one block
    after the other, a row per text that has any, and joined by the text's digest: equal texts have equal hits.
    """
    key = items.schema["item_id"].dataType
    context, stash = docs.sparkSession.sparkContext, Stash(docs.sparkSession, "hits")
    rows = docs.select("doc_id", "text")
    texts = docs.select(F.sha2(F.col("text").cast("binary"), 256).alias("digest"), "text")
    indexes = _indexes(items, width, percent, block)
    first, more = context.broadcast(next(indexes)), []
    for k, index in enumerate(indexes):
        shared = context.broadcast(index)
        hits = _search(texts, shared, width, key).filter(F.size("items") > 0).select("digest", F.arrays_zip("items", "shared").alias("hits"))
        more.append(stash.put(hits.dropDuplicates(["digest"]), f"block-{k}"))
        shared.unpersist()
    if more:
        # Rows are salted and hits repeated for each salt, so that copies of one text go to several tasks.
        salted = rows.select("doc_id", "text", F.sha2(F.col("text").cast("binary"), 256).alias("digest"), F.pmod(F.spark_partition_id(), F.lit(SALTS)).alias("salt"))
        hits = reduce(DataFrame.union, more).groupBy("digest").agg(F.flatten(F.collect_list("hits")).alias("hits"))
        hits = hits.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        found = _search(salted, first, width, key).join(hits, ["digest", "salt"], "left")
        both = [F.when(F.col("hits").isNull(), F.col(c)).otherwise(F.concat(c, f"hits.{c}")).alias(c) for c in ("items", "shared")]
        out = found.select("doc_id", "n_shingles", *both)
    else:
        out = _search(rows, first, width, key)
    return out.withColumn("contaminated", F.size("items") > 0)


def clean(docs: DataFrame, items: DataFrame, *, width: int = WIDTH, percent: int = PERCENT, block: int = BLOCK_SHINGLES) -> DataFrame:
    """The rows of ``docs`` that contain no item, in its columns; blocks of items filter one after the other."""
    for index in _indexes(items, width, percent, block):
        docs = _filtered(docs, index, width)
    return docs


def _filtered(docs: DataFrame, index: Index, width: int) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [b == a or not shared.value.search(hashes[a:b]) for _, hashes, places in shingle_sets(batch["text"], width) for a, b in zip(places[:-1], places[1:], strict=True)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(released(run), docs.schema)
