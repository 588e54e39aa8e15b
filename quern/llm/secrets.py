"""Secret scans by a trigram inverted index, on built-in functions only.

Each rule's regex is turned into a Boolean trigram query (``_trigrams``). The index maps each trigram that a query names
to the posting list of the texts that have it; texts are named by a 64-bit hash, and lists are kept for blocks of about
``BLOCK`` texts, so that none grows with the corpus. Per block, the lists of a query are intersected and united; what is
left are the rule's candidates, which are verified with the regex. Two texts of one hash share candidates: that costs a
verification and loses nothing. A rule without a mandatory trigram has an empty query and scans every document.

Candidates meet their documents by a broadcast while they are few (``MOST_SENT``), else by a join whose keys are salted,
since copies of one text may be a large share of the rows.

Defined results: null counts as empty, an empty text has no spans; repeated rows get equal answers; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._stash import Stash
from ._trigrams import Query, trigram_query

#: Texts of a block of posting lists, candidates (12 bytes and their rules' numbers) that are broadcast at most, and salts beyond that.
BLOCK, MOST_SENT, SALTS = 8192, 1_000_000, 16


@dataclass(frozen=True)
class Rule:
    """A kind of secret; of its matches those count whose ``group`` has ``least`` characters or more."""

    kind: str
    regex: str
    group: int = 0
    least: int = 1

    @property
    def query(self) -> Query:
        return trigram_query(self.regex)


BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    # Shorter runs fail and hold no longer match, so the least length is part of the regex.
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
)
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("private", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
)


def index(docs: DataFrame, rules: tuple[Rule, ...], *, block: int = BLOCK) -> DataFrame:
    """The posting lists of the rules' trigrams in the column ``text``: block, lists (trigram -> hashes of texts)."""
    grams = sorted({g for r in rules for one in r.query for grams in one for g in grams})
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    held = docs.select(F.xxhash64("text").alias("h"), lower.alias("l")).select("h", *[F.col("l").contains(g).alias(f"g{i}") for i, g in enumerate(grams)])
    found = F.array_compact(F.array(*[F.when(F.col(f"g{i}"), F.lit(g)) for i, g in enumerate(grams)])) if grams else F.array().cast("array<string>")
    blocks = max(1, -(-docs.count() // block))
    postings = held.select("h", F.explode(found).alias("gram")).groupBy(F.pmod("h", F.lit(blocks)).alias("block"), "gram").agg(F.collect_set("h").alias("list"))
    return postings.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("gram", "list"))).alias("lists"))


def candidates(lists: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """The texts that fulfil the queries of ``rules``: h, rules (the numbers of those that it fulfils)."""

    def posting(gram: str) -> Column:
        return F.coalesce(F.col("lists")[gram], F.array().cast("array<bigint>"))

    def fulfilling(query: Query) -> Column:
        demands = [reduce(F.array_union, [reduce(F.array_intersect, [posting(g) for g in sorted(grams)]) for grams in one]) for one in query]
        return reduce(F.array_intersect, demands)

    asked = [F.struct(F.lit(i).alias("rule"), fulfilling(r.query).alias("list")) for i, r in enumerate(rules) if r.query]
    if not asked:
        return lists.sparkSession.createDataFrame([], "h long, rules array<int>")
    each = lists.select(F.explode(F.array(*asked)).alias("a")).select("a.rule", F.explode("a.list").alias("h"))
    return each.groupBy("h").agg(F.collect_set("rule").alias("rules"))


def _spans(text: Column, rule: Rule, rank: int) -> Column:
    """(start, rank, end) of the matches, whose places follow from the lengths of what lies between them."""
    pattern = F.lit(rule.regex)
    matches = F.regexp_extract_all(text, pattern, F.lit(0))
    between = F.split(text, rule.regex, -1)
    steps = F.arrays_zip(
        F.transform(between, lambda x: F.length(x)).alias("gap"),
        F.transform(matches, lambda x: F.length(x)).alias("size"),
        F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), lambda x: F.length(x)).alias("part"),
    )
    kind = "struct<at:int,out:array<struct<start:int,rank:int,end:int>>>"

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.coalesce(x["size"], F.lit(0))
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"))
        keep = F.coalesce(x["part"] >= rule.least, F.lit(False))
        return F.struct(end.alias("at"), F.when(keep, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out")).cast(kind)

    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,rank:int,end:int>>").alias("out")).cast(kind)
    return F.when(F.size(matches) > 0, F.aggregate(steps, first, step)["out"])


def scan(docs: DataFrame, *, base: tuple[Rule, ...] = BASE, more: tuple[Rule, ...] = MORE, block: int = BLOCK, most_sent: int = MOST_SENT) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_<kind> of each rule, base (spans), found (all spans).

    Spans are (start, rank, end) in code points by start, then rule; ends are exclusive.
    """
    rules = base + more
    stash = Stash(docs.sparkSession, "secrets")
    plain = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    known = stash.put(candidates(stash.put(index(plain, rules, block=block), "index"), rules), "candidates")
    stash.drop("index")
    hashed = plain.withColumn("h", F.xxhash64("text"))
    if known.count() <= most_sent:
        marked = hashed.join(F.broadcast(known), "h", "left")
    else:
        repeated = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        marked = hashed.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS))).join(repeated, ["h", "salt"], "left")
    none = F.array().cast("array<struct<start:int,rank:int,end:int>>")
    verified = lambda i, r: F.when(F.array_contains("rules", i) if r.query else F.lit(True), _spans(F.col("text"), r, i))
    spans = [F.coalesce(verified(i, r), none).alias(r.kind) for i, r in enumerate(rules)]
    found = marked.select("doc_id", *spans)
    counts = [F.size(r.kind).cast("long").alias(f"n_{r.kind}") for r in rules]
    joined = lambda some: F.array_sort(F.concat(*[F.col(r.kind) for r in some]))
    return found.select("doc_id", *counts, joined(base).alias("base"), joined(rules).alias("found"))


def spelled(spans: Column, rules: tuple[Rule, ...] = BASE + MORE) -> Column:
    """Spans as kind:start:end, comma-joined."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
