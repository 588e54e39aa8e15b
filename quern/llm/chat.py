"""Chat formatting with cumulative-snapshot collapse, on built-in functions only.

Logs often hold a conversation once per turn, each snapshot a prefix of the next. Every
turn gets the hash of all turns up to it, a running sum of 128-bit turn hashes that is
independent of the order in which rows arrive. A conversation whose last hash occurs as
a proper prefix hash of another is dropped by an anti-join; of equal conversations the
least conv_id stays. Kept turns are rendered one row each, so that a conversation of
any length needs no large row.

Running sums go in levels: within blocks of ``TURNS`` turns, then over the blocks' sums in
blocks of blocks, and so on for ``LEVELS`` levels, so that no task gets more than a small
part of a long conversation. Turns count by their numbers: the same turns numbered from 0
and from 1 are different conversations.

Defined results: a null conv_id is one more conversation, a null role or text counts as
an empty one in comparisons and rendering; rows with the same conv_id and turn count
together, in any order; a null turn comes first; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._stash import Stash

TURNS, LEVELS = 64, 4
START, END = "<|im_start|>", "<|im_end|>"


def _running(rows: DataFrame, place: str, block: int, levels: int) -> DataFrame:
    """``rows`` (conv_id, place, a, b, n) with a, b and n summed up to each place of its conversation, and whether it is the last."""
    order = F.asc_nulls_first(place)
    if levels == 1:
        over = Window.partitionBy("conv_id").orderBy(order)
        return rows.select("conv_id", place, *[F.sum(c).over(over).alias(c) for c in "abn"], F.lead(F.lit(1)).over(over).isNull().alias("last"))
    above = f"{place}_"
    rows = rows.withColumn(above, F.floor(F.col(place) / block))
    over = Window.partitionBy("conv_id", above).orderBy(order)
    inner = rows.select("conv_id", place, above, *[F.sum(c).over(over).alias(c) for c in "abn"], F.lead(F.lit(1)).over(over).isNull().alias("end"))
    sums = rows.groupBy("conv_id", above).agg(*[F.sum(c).alias(c) for c in "abn"])
    outer = _running(sums, above, block, levels - 1)
    # What comes before a block is the sum up to its end less its own.
    own = outer.alias("o").join(sums.alias("s"), F.expr(f"o.conv_id <=> s.conv_id and o.{above} <=> s.{above}"))
    before = own.select("o.conv_id", f"o.{above}", "o.last", *[(F.col(f"o.{c}") - F.col(f"s.{c}")).alias(f"b{c}") for c in "abn"])
    joined = inner.alias("i").join(before.alias("b"), F.expr(f"i.conv_id <=> b.conv_id and i.{above} <=> b.{above}"))
    return joined.select("i.conv_id", f"i.{place}", *[(F.col(f"i.{c}") + F.col(f"b.b{c}")).alias(c) for c in "abn"], (F.col("i.end") & F.col("b.last")).alias("last"))


def maximal(turns: DataFrame, *, block: int = TURNS) -> DataFrame:
    """The conv_id of each conversation that no other one continues (the least of equal ones)."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    h = [F.xxhash64(F.lit(k), F.coalesce(F.col("turn"), F.lit(-1)), F.col("turn").isNull(), role, text).cast("decimal(20,0)") for k in ("a", "b")]
    each = turns.select("conv_id", "turn", h[0].alias("a"), h[1].alias("b"))
    each = each.groupBy("conv_id", "turn").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.count("*").alias("n"))
    each = Stash(turns.sparkSession, "chat").put(each, "turns")
    state = _running(each, "turn", block, LEVELS)
    key = F.sha2(F.concat_ws(",", *[F.col(c).cast("string") for c in "abn"]), 256)
    # One row per distinct hash: does it end conversations, and does it continue in one?
    state = state.select(F.unhex(key).alias("key"), "conv_id", F.col("last").alias("whole"))
    totals = state.filter("whole").groupBy("key").agg(F.min(F.struct(F.col("conv_id").isNull().alias("x"), "conv_id")).alias("c"))
    prefixes = state.filter("not whole").select("key").distinct()
    return totals.join(prefixes, "key", "left_anti").select("c.conv_id")


def render(turns: DataFrame, *, block: int = TURNS) -> DataFrame:
    """The turns of maximal conversations: conv_id, turn, role, rendered (the turn as chat markup)."""
    kept = maximal(turns, block=block).select(F.col("conv_id").alias("kept_id"))
    markup = F.concat(F.lit(START), F.coalesce("role", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit(f"{END}\n"))
    plain = turns.select("conv_id", "turn", "role", "text").join(kept, F.expr("conv_id <=> kept_id"), "left_semi")
    return plain.select("conv_id", "turn", "role", markup.alias("rendered"))
