"""MinHash near-duplicates: fast similarity sketches, banding, exact verification.

Plan, with nothing unbounded in one task and no pair list of a group:

1. One Python pass turns each text into its shingle set's fingerprint and band keys.
   Rows with equal sets collapse into one class by a combinable aggregation.
2. Classes that share a band key form a bucket. Each bucket's least class is its
   star; every other member is verified against it on full sets.
3. Connected components of the verified links leave most buckets in one piece. In
   the others all pairs that no link connects yet and whose sizes allow a link are
   compared on full sets: members are dealt by classes of size, of which only equal
   and neighbouring ones can link, into blocks of about ``BLOCK`` members a side.
4. Components of all links; one row per input row comes back.

Two sets of similarity ``s`` share a band with probability 1 - (1 - s^ROWS)^(T/ROWS):
0.999995 at 0.75. Sets are compared by 64-bit shingle hashes.

Defined results: a null, empty or blank text has no shingles, links with nothing and
is its own component; a null id is carried along, never chosen as a component's id
(a component of null ids only has a null id and its rows are kept); repeated rows
are copies of each other; an empty table gives an empty result; other columns of the
input are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._components import components
from ._memory import released
from ._shingles import U64, shingle_sets
from ._sketch import bands, sketch
from ._stash import Stash

WIDTH, T, ROWS, BLOCK = 5, 128, 4, 256
#: Tasks that the members of a bucket of more than a block are dealt to.
SALTS = 16
SIMILAR = 75


def _signatures(width: int, t: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, hashes, places in shingle_sets(batch["text"], width):
                n = len(places) - 1
                keys = bands(sketch(hashes, places, t), rows)
                size = np.diff(places)
                prints = [hashlib.blake2b(hashes[a:b], digest_size=16).digest() if b > a else None for a, b in zip(places[:-1], places[1:], strict=True)]
                part = batch.slice(at, n)
                yield pa.record_batch({
                    "doc_id": part["doc_id"], "content": part["content"], "n_shingles": pa.array(size, pa.int64()), "fp": pa.array(prints, pa.binary()),
                    "bands": pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * keys.shape[1], pa.int32()), pa.array(keys.ravel())),
                })

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, hashes, places in shingle_sets(batch["text"], width):
                part = batch.slice(at, len(places) - 1)
                yield pa.record_batch({"fp": part["fp"], "shingles": pa.array([hashes[a:b].tobytes() for a, b in zip(places[:-1], places[1:], strict=True)], pa.binary())})

    return run


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * |a & b| >= percent * |a | b| for sorted distinct non-empty arrays."""
    if len(a) > len(b):
        a, b = b, a
    if 100 * len(a) < percent * len(b):
        return False
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int((b[at] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = batch["a"], batch["b"]
            keep = [similar(np.frombuffer(one[i].as_buffer(), U64), np.frombuffer(two[i].as_buffer(), U64), percent) for i in range(len(batch))]
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return run


def _unit(percent: int):
    """Links between members of a unit that no link connects yet: among all of one block, or across the sides of two."""

    def run(table: pa.Table) -> pa.Table:
        order = table.sort_by("n_shingles")
        nodes, roots, stars, sides = (order[c].to_pylist() for c in ("fp", "root", "star", "side"))
        sets = [np.frombuffer(x, U64) for x in order["shingles"].to_pylist()]
        across = order["across"][0].as_py()
        up: dict[bytes, bytes] = {}

        def top(x: bytes) -> bytes:
            while x in up:
                x = up[x]
            return x

        out: list[tuple[bytes, bytes]] = []
        for j in range(len(nodes)):
            for i in range(j - 1, -1, -1):
                if 100 * len(sets[i]) < percent * len(sets[j]):
                    break
                if stars[j] in (nodes[i], nodes[j]) or across and sides[i] == sides[j]:
                    continue
                a, b = top(roots[i]), top(roots[j])
                if a != b and similar(sets[i], sets[j], percent):
                    up[a] = b
                    out.append((nodes[i], nodes[j]))
        return pa.table({"u": pa.array([x[0] for x in out], pa.binary()), "v": pa.array([x[1] for x in out], pa.binary())})

    return run


def _units(members: DataFrame, percent: int, block: int) -> DataFrame:
    """The units that compare what the stars left apart, a row per unit and member.

    ``members`` (band, salt, n, fp, root, star, n_shingles) of buckets of three or more. A bucket of at most ``block``
    members is one unit. In others ``far`` members, those apart from the star's component, meet the near ones and each
    other: sets of size classes that differ by more than one cannot link, and each class is dealt into blocks.
    """
    salts = lambda df: df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.when(F.col("n") > block, SALTS - 1).otherwise(0))))
    stars = salts(members.filter(F.col("fp") == F.col("star")).select("band", "n", F.col("root").alias("r0"))).drop("n")
    # A class spans less than the ratio that a link allows: sizes that can link are in equal or neighbouring classes.
    cls = F.floor(F.log(F.col("n_shingles").cast("double")) / math.log(100 / percent) if percent < 100 else F.col("n_shingles")).cast("int")
    outer = members.join(stars, ["band", "salt"]).withColumns({"far": F.col("root") != F.col("r0"), "cls": cls}).drop("r0")
    counts = outer.filter(F.col("n") > block).groupBy("band", "salt", "n", "cls").agg(F.count_if("far").alias("f"), F.count_if(~F.col("far")).alias("m"))
    counts = counts.groupBy("band", "n", "cls").agg(F.ceil(F.sum("f") / block).cast("int").alias("f"), F.ceil(F.sum("m") / block).cast("int").alias("m"))
    # For each class, the blocks of itself and its neighbours; far ones of the class or none to compare with, none at all.
    step = F.explode(F.array(*[F.lit(d) for d in (-1, 0, 1)]))
    near = counts.withColumn("d", step).select("band", "n", (F.col("cls") - F.col("d")).alias("cls"), F.struct("d", "f", "m").alias("s"))
    near = near.groupBy("band", "n", "cls").agg(F.map_from_entries(F.collect_list(F.struct("s.d", "s"))).alias("s"))
    large = outer.filter(F.col("n") > block).join(salts(near).drop("n"), ["band", "salt", "cls"])
    small = outer.filter(F.col("n") <= block)
    small = small.join(small.filter("far").select("band").distinct(), "band")

    def blocks(d: int, kind: str) -> Column:
        return F.coalesce(F.col("s")[F.lit(d)][kind], F.lit(0))

    def unit(kind: int, a: Column, b: Column, i: Column, j: Column, side: int | Column, across: bool | Column = True) -> Column:
        side, across = (x if isinstance(x, Column) else F.lit(x) for x in (side, across))
        return F.struct(F.lit(kind).alias("kind"), a.alias("a"), b.alias("b"), i.cast("int").alias("i"), j.cast("int").alias("j"), side.alias("side"), across.alias("across"))

    def each(n: Column, one) -> Column:
        return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda k: one(k - 1))).otherwise(F.array().cast(kind))

    kind = "array<struct<kind:int,a:int,b:int,i:int,j:int,side:int,across:boolean>>"
    c = F.col("cls")
    mine = lambda which: F.pmod(F.xxhash64("fp"), F.greatest(blocks(0, which), F.lit(1))).cast("int")
    as_near = F.concat(*[each(blocks(d, "f"), lambda j, d=d: unit(1, c, c + d, mine("m"), j, 0)) for d in (-1, 0, 1)])
    as_far = F.concat(
        *[each(blocks(d, "m"), lambda i, d=d: unit(1, c + d, c, i, mine("f"), 1)) for d in (-1, 0, 1)],
        each(blocks(1, "f"), lambda j: unit(2, c, c + 1, mine("f"), j, 0)),
        each(blocks(-1, "f"), lambda i: unit(2, c - 1, c, i, mine("f"), 1)),
        each(blocks(0, "f"), lambda k: unit(2, c, c, F.least(k, mine("f")), F.greatest(k, mine("f")), F.when(k < mine("f"), 1).otherwise(0), k != mine("f"))),
    )
    zero = F.lit(0)
    parts = [large.withColumn("k", F.explode(F.when(F.col("far"), as_far).otherwise(as_near))), small.withColumn("k", unit(0, zero, zero, zero, zero, 0, False))]
    columns = [F.col(x) for x in ("band", "k.*", "fp", "root", "star", "n_shingles")]
    return parts[0].select(*columns).union(parts[1].select(*columns))


def _buckets(keyed: DataFrame) -> DataFrame:
    """The buckets of two or more classes of ``keyed`` (fp, n_shingles, band): band, n, star, star_n; equal buckets once.

    Equal members are told by two independent xors of 64-bit hashes: no number of members overflows them.
    """
    marks = [F.bit_xor(F.xxhash64(F.lit(seed), "fp")).alias(f"m{seed}") for seed in (1, 2)]
    found = keyed.groupBy("band").agg(F.count("*").alias("n"), F.min(F.struct("fp", "n_shingles")).alias("s"), *marks).filter("n > 1")
    once = found.groupBy("n", "s", "m1", "m2").agg(F.min("band").alias("band"))
    return once.select("band", "n", F.col("s.fp").alias("star"), F.col("s.n_shingles").alias("star_n"))


def _content(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def near_duplicates(docs: DataFrame, *, width: int = WIDTH, percent: int = SIMILAR, t: int = T, rows: int = ROWS, block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept."""
    out = _placed(docs, width, percent, t, rows, block)
    component = F.when(F.col("fp").isNull(), F.col("doc_id")).otherwise(F.col("least.doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def survivors(docs: DataFrame, *, width: int = WIDTH, percent: int = SIMILAR, t: int = T, rows: int = ROWS, block: int = BLOCK) -> DataFrame:
    """The row of each component with the least doc_id, in the columns of ``docs``; rows without shingles stay.

    Null ids come last and ties go to the least content hash, so rows are told apart by id and text:
    rows that repeat both stay together (``exact_dedup.survivors`` leaves none).
    """
    out = _placed(docs, width, percent, t, rows, block)
    stays = F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("content") == F.col("least.content"))
    dropped = out.filter(F.col("fp").isNotNull() & ~stays).select("doc_id", "content")
    return docs.alias("d").join(dropped.alias("x"), F.col("d.doc_id").eqNullSafe(F.col("x.doc_id")) & (_content(F.col("d.text")) == F.col("x.content")), "left_anti")


def _placed(docs: DataFrame, width: int, percent: int, t: int, rows: int, block: int) -> DataFrame:
    """One row per row of ``docs``: doc_id, content, n_shingles, fp and the least row of the component (x, doc_id, content)."""
    stash = Stash(docs.sparkSession, "near")
    base = docs.select("doc_id", "text", _content(F.col("text")).alias("content"))
    kind = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}"
    signed = stash.put(base.mapInArrow(released(_signatures(width, t, rows)), f"{kind}, content long, n_shingles long, fp binary, bands array<long>"), "signed")

    # Classes of equal sets, each with the place of one text.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "content"))
    classes = stash.put(
        signed.filter("fp is not null").groupBy("fp").agg(first.alias("r"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"))
        .select("fp", "n_shingles", "bands", F.col("r.doc_id").alias("doc_id"), F.col("r.content").alias("content")), "classes")

    # Buckets of two or more classes; a bucket that another band has as well counts once.
    keyed = classes.select("fp", "n_shingles", F.explode("bands").alias("band"))
    buckets = stash.put(_buckets(keyed), "buckets")
    salt = F.when(F.col("n") > block, F.pmod(F.xxhash64("fp"), F.lit(SALTS))).otherwise(0).cast("int")
    members = stash.put(keyed.join(buckets, "band").withColumn("salt", salt), "members")
    alike = F.least("n_shingles", "star_n") * 100 >= F.greatest("n_shingles", "star_n") * percent
    tries = members.filter((F.col("fp") != F.col("star")) & alike).select(F.col("fp").alias("u"), F.col("star").alias("v")).distinct()

    # The sets of bucket members, from the texts again.
    needed = members.select("fp").distinct().join(classes.select("fp", "doc_id", "content"), "fp")
    found = base.alias("d").join(needed.alias("n"), F.expr("d.content = n.content and d.doc_id <=> n.doc_id")).select("n.fp", "d.text")
    sets = stash.put(found.mapInArrow(released(_sets(width)), "fp binary, shingles binary").dropDuplicates(["fp"]), "sets")

    def sides(pairs: DataFrame) -> DataFrame:
        one = sets.select(F.col("fp").alias("u"), F.col("shingles").alias("a"))
        two = sets.select(F.col("fp").alias("v"), F.col("shingles").alias("b"))
        return pairs.join(one, "u").join(two, "v").select("u", "v", "a", "b")

    links = stash.put(sides(tries).mapInArrow(released(_verify(percent)), "u binary, v binary"), "links")
    roots = components(links, stash, "stars")

    # What the stars left apart.
    placed = members.filter("n > 2").join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    spread = _units(stash.put(placed, "placed"), percent, block)
    more = spread.join(sets, "fp").groupBy("band", "kind", "a", "b", "i", "j").applyInArrow(_unit(percent), "u binary, v binary")
    links = stash.put(links.union(more), "all-links")
    roots = components(links, stash, "all")

    # The least row of each component, then of each class, then of each row.
    ids = classes.select("fp", "doc_id", "content").join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = ids.groupBy("root").agg(first.alias("least"))
    named = stash.put(ids.select("fp", "root").join(least, "root").select("fp", "least"), "named")
    stash.keep("signed", "named")
    return signed.select("doc_id", "content", "n_shingles", "fp").join(named, "fp", "left")
