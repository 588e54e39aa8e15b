"""From raw documents to training rows: the corpus pipeline.

Each stage reads what the one before kept, whole, and but for the last returns rows of ``documents`` as they were.

Defined results: a null, empty or letterless text is rejected by the language stage, and so is every row if no row has a
language to learn from; rows with a null id take part like others, repeated rows are exact copies, rows of one id with
different texts are judged each by itself; ties of ids go to other columns (exact) or to the text's hash (near); an empty
table gives an empty result; further columns are carried along up to the encoding, which returns doc_id, ids and text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.llm import byte_bpe, decontaminate, exact_dedup, language_id, near_dedup, registry
from quern.llm._stash import Stash


#: Pre-tokens that an encoding worker remembers: it serves the other stages as well and shares an executor's memory with them.
MEMO = 100_000


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is recognised."""
    return language_id.accepted(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of equal texts."""
    return exact_dedup.survivors(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates, decided per row."""
    return near_dedup.survivors(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents without benchmark items."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training rows: doc_id, the token ids and the text as decoded from them."""
    return byte_bpe.tokens(docs, registry.byte_codec(MEMO))


STAGES = [("language", language), ("exact_dedup", exact), ("near_dedup", near), ("decontaminate", decontaminated), ("encode", encoded)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over ``documents``, each one's rows written as Parquet and read again by the next."""
    stash = Stash(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stash.put(stage(spark, docs, sf_dir), name)
        stash.keep(name)
    return STAGES[-1][1](spark, docs, sf_dir)
