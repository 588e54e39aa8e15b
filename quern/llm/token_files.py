"""Token-id files: frequency-ranked ids in byte-aligned variable-length coding.

Format. Ids are replaced by their frequency ranks over the whole corpus (0 is the most
frequent; ties by id). A rank takes 1 to 4 bytes, little-endian. A block holds whole
documents: their ids and lengths, the control bytes (2 bits per rank, four ranks to a
byte, lowest bits first: bytes - 1) and, apart from them, the data bytes. Blocks are
rows of Parquet files, so any store that Spark writes to serves, and the commit of a
task is atomic; the rank table is one more Parquet table beside them.

A control byte's table row gives the four lengths; a reader decodes by numpy gathers.

Defined results: a null text is an empty one and has the end id only; documents come in
ascending doc_id, null ids first, ties by content hash; repeated rows follow each other;
an empty table writes empty files and reads back as an empty result; other columns are
not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shingles import text_bytes
from ._stash import Stash
from ._words import words

END_ID = 2
#: Ids after which a block is closed.
BLOCK = 1 << 17
#: Lengths of the four ranks of each control byte.
LENGTHS = np.array([[(c >> 2 * k & 3) + 1 for k in range(4)] for c in range(256)], np.uint8)


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of 32-bit ranks."""
    n = len(ranks)
    four = ranks.astype("<u4")
    size = 1 + (four >= 1 << 8) + (four >= 1 << 16) + (four >= 1 << 24)
    padded = np.ones(-(-n // 4) * 4, np.uint8)
    padded[:n] = size
    control = ((padded.reshape(-1, 4) - 1) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1).astype(np.uint8)
    data = four.view(np.uint8).reshape(-1, 4)[np.arange(4) < size[:, None]]
    return control.tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n ranks of control and data bytes."""
    size = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n].astype(np.int64)
    begin = np.cumsum(size) - size
    raw = np.frombuffer(data, np.uint8)
    out = np.zeros(n, np.uint32)
    for k in range(4):
        has = size > k
        if not has.any():
            break
        out[has] |= raw[begin[has] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def _binary(ids: np.ndarray, places: np.ndarray, narrow: bool) -> pa.Array:
    """Runs of ids as little-endian bytes, 2 a piece where the vocabulary allows."""
    width = 2 if narrow else 4
    at = pa.array(places * width, pa.int64()).buffers()[1]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(places) - 1, [None, at, pa.py_buffer(ids.astype("<u2" if narrow else "<u4"))]).cast(pa.binary())


def _ids(column: pa.Array, narrow: bool) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all rows of a binary column, and the n+1 places at which rows begin."""
    raw, offsets = text_bytes(column)
    return np.frombuffer(raw.tobytes(), "<u2" if narrow else "<u4"), offsets // (2 if narrow else 4)


def _encode(source, end: int, narrow: bool):
    """Ids of each text with the end id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = words(source.value, end)
        for batch in batches:
            ids, places = memo.encode(*text_bytes(batch["text"]))
            yield pa.record_batch({"doc_id": batch["doc_id"], "content": batch["content"], "row": batch["row"], "ids": _binary(ids, places, narrow)})

    return run


def _tally(narrow: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            seen = np.bincount(_ids(batch["ids"], narrow)[0], minlength=len(total))
            seen[: len(total)] += total
            total = seen
        at = np.flatnonzero(total)
        yield pa.record_batch({"id": pa.array(at, pa.int64()), "n": pa.array(total[at], pa.int64())})

    return run


def _blocks(rank_of, narrow: bool, id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, start = TaskContext.get().partitionId(), 0, 0
        docs: list = []
        held: list[np.ndarray] = []

        def close() -> pa.RecordBatch:
            ranks = np.concatenate(held)
            control, data = pack(ranks)
            row = {"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "start": pa.array([start], pa.int64()), "n": pa.array([len(ranks)], pa.int64())}
            row |= {"docs": pa.array([docs], pa.list_(id_type)), "sizes": pa.array([[len(x) for x in held]], pa.list_(pa.int64()))}
            return pa.record_batch(row | {"control": pa.array([control], pa.binary()), "data": pa.array([data], pa.binary())})

        size = 0
        for batch in batches:
            ids, places = _ids(batch["ids"], narrow)
            ranks = rank_of.value[ids]
            for doc, a, b in zip(batch["doc_id"].to_pylist(), places[:-1].tolist(), places[1:].tolist(), strict=True):
                held.append(ranks[a:b])
                docs.append(doc)
                size += len(held[-1])
                if size >= BLOCK:
                    yield close()
                    seq, start, size, docs, held = seq + 1, start + size, 0, [], []
        if held:
            yield close()

    return run


def write(docs: DataFrame, tokenizer: str, folder: str, *, end_id: int = END_ID) -> None:
    """Encodes ``docs`` (doc_id, text) with a tokenizers file and writes the corpus below ``folder``."""
    spark = docs.sparkSession
    with open(tokenizer, encoding="utf-8") as file:
        source = file.read()
    from tokenizers import Tokenizer

    narrow = max(end_id, Tokenizer.from_str(source).get_vocab_size()) < 1 << 16
    stash = Stash(spark, "ids")
    kind = docs.schema["doc_id"].dataType
    # The row number only tells equal rows apart, so that many of them are dealt to several tasks.
    base = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("content"), F.monotonically_increasing_id().alias("row"))
    encode = _encode(spark.sparkContext.broadcast(source), end_id, narrow)
    ids = stash.put(base.mapInArrow(encode, f"doc_id {kind.simpleString()}, content long, row long, ids binary"), "ids")

    # At most one row per vocabulary entry.
    ranked = ids.select("ids").mapInArrow(_tally(narrow), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "id").select("id").toArrow()["id"].to_numpy()
    rank_of = np.zeros(int(ranked.max(initial=0)) + 1, np.uint32)
    rank_of[ranked] = np.arange(len(ranked))
    spark.createDataFrame(pa.table({"rank": np.arange(len(ranked)), "id": ranked.astype(np.int64)})).coalesce(1).write.mode("overwrite").parquet(f"{folder}/ranks")

    key = (F.col("doc_id").asc_nulls_first(), F.col("content"), F.col("row"))
    ordered = ids.repartitionByRange(*key).sortWithinPartitions(*key)
    from pyspark.sql.pandas.types import to_arrow_type

    made = _blocks(spark.sparkContext.broadcast(rank_of), narrow, to_arrow_type(kind))
    schema = f"part int, seq int, start long, n long, docs array<{kind.simpleString()}>, sizes array<long>, control binary, data binary"
    ordered.select("doc_id", "ids").mapInArrow(made, schema).write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/blocks")
    stash.drop("ids")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document of the files: doc_id, start, n_tokens, ids_crc32 and the ids as little-endian 32-bit binary."""
    blocks = spark.read.parquet(f"{folder}/blocks")
    # One row per written part, one entry per vocabulary entry.
    ids = np.array([r["id"] for r in spark.read.parquet(f"{folder}/ranks").orderBy("rank").collect()], "<u4")
    sizes = {r["part"]: r["n"] for r in blocks.groupBy("part").agg(F.sum("n").alias("n")).collect()}
    before, total = {}, 0
    for part in sorted(sizes):
        before[part], total = total, total + sizes[part]
    id_of = spark.sparkContext.broadcast(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                n = batch["n"][i].as_py()
                found = id_of.value[unpack(batch["control"][i].as_py(), batch["data"][i].as_py(), n)]
                sizes = np.array(batch["sizes"][i].as_py(), np.int64)
                ends = np.cumsum(sizes)
                parts = [found[a:b].tobytes() for a, b in zip(ends - sizes, ends, strict=True)]
                first = before[batch["part"][i].as_py()] + batch["start"][i].as_py()
                yield pa.record_batch({
                    "doc_id": batch["docs"][i].values, "start": pa.array(first + ends - sizes, pa.int64()), "n_tokens": pa.array(sizes, pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(x) for x in parts], pa.int64()), "ids": pa.array(parts, pa.binary()),
                })

    kind = blocks.schema["docs"].dataType.elementType.simpleString()
    return blocks.mapInArrow(run, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long, ids binary")
