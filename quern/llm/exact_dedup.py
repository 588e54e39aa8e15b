"""Exact duplicates by skew-safe combining, on built-in functions only.

Three stages, each of which groups by the digest and the whole text, so equal
digests of different texts never merge:

1. locally, a map-side combine leaves one row per text and input partition;
2. those rows meet by (digest, text, salt), the salt being the input partition, so
   that copies of one text go to as many as ``SALTS`` tasks;
3. the at most ``SALTS`` salt winners of a text meet by (digest, text).

Each row then finds its group by (digest, part), the part being a hash of its id: a group
is repeated for the parts that its rows have, which the stages gather as bits of a number,
so that the rows of one text go to several tasks on the way back as well.

Defined results: a null text counts as empty, and all empty texts are one group; a
null id is the least id and stays only in a group of null ids; repeated rows are
copies, so rows that repeat the staying id are all marked ``kept`` (``survivors``
returns one of them); an empty table gives an empty result; other columns are not
read by ``duplicates`` and carried along by ``survivors``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._stash import Stash

SALTS = 16
#: Parts of a group on the way back to its rows; bits of an int.
PARTS = 16


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def _rows(docs: DataFrame, digest: Callable[[Column], Column], salts: int, *more: Column) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(*more, text.alias("t"), digest(text).alias("d"), F.pmod(F.spark_partition_id(), F.lit(salts)).alias("salt"))


def duplicates(docs: DataFrame, *, digest: Callable[[Column], Column] = sha256, salts: int = SALTS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256."""
    part = F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)).cast("int")
    rows = _rows(docs, digest, salts, F.col("doc_id"), part.alias("part"))
    parts = F.bit_or(F.call_function("shiftleft", F.lit(1), F.col("part"))).alias("m")
    local = rows.groupBy("d", "t", "salt").agg(F.max("doc_id").alias("k"), F.count("*").alias("n"), parts)
    groups = local.groupBy("d", "t").agg(F.max("k").alias("k"), F.sum("n").alias("n"), F.bit_or("m").alias("m"))
    # The text is not needed any more where a digest stands for one text.
    of_digest = groups.groupBy("d").agg(F.count("*").alias("texts"), F.max("k").alias("keep_id"), F.sum("n").alias("group_size"), F.bit_or("m").alias("m"))
    known = Stash(docs.sparkSession, "exact").put(of_digest, "groups")
    spelled = F.lower(F.hex("d")) if digest is sha256 else F.sha2(F.col("t").cast("binary"), 256)
    named = rows.select("doc_id", "d", "part", spelled.alias("text_sha256"))
    used = F.filter(F.sequence(F.lit(0), F.lit(PARTS - 1)), lambda i: F.getbit(F.col("m"), i) == 1)
    out = named.join(known.filter("texts = 1").withColumn("part", F.explode(used)), ["d", "part"])
    if not known.filter("texts > 1").isEmpty():
        shared = known.filter("texts > 1").select("d")
        mixed = groups.join(shared, "d", "left_semi").select("d", "t", F.col("k").alias("keep_id"), F.col("n").alias("group_size"))
        far = rows.join(shared, "d", "left_semi").join(mixed, ["d", "t"]).withColumn("text_sha256", F.sha2(F.col("t").cast("binary"), 256))
        out = out.select("doc_id", "keep_id", "group_size", "text_sha256").union(far.select("doc_id", "keep_id", "group_size", "text_sha256"))
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def survivors(docs: DataFrame, *, digest: Callable[[Column], Column] = sha256, salts: int = SALTS) -> DataFrame:
    """One whole row of each group of equal texts, that with the largest doc_id, in the columns of ``docs``.

    Ties of doc_id go to the largest row by the other columns, which must be orderable.
    """
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    # A null and an empty text are one group: the row remembers which it was.
    small = F.struct("doc_id", F.col("text").isNull().alias("no_text"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rest)])
    rows = _rows(docs, digest, salts, small.alias("r"))
    local = rows.groupBy("d", "t", "salt").agg(F.max("r").alias("r"))
    best = local.groupBy("d", "t").agg(F.max("r").alias("r"))
    place = {"doc_id": F.col("r.doc_id"), "text": F.when(~F.col("r.no_text"), F.col("t"))} | {c: F.col(f"r.c{i}") for i, c in enumerate(rest)}
    return best.select(*[place[c].alias(c) for c in docs.columns])
