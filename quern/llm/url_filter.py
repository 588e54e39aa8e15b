"""URL filters: rules first, then gradient-boosted trees on lexical features, on built-in functions only.

The urls that a rule judges are the labelled ones. Boosted trees are fitted on at most
about ``FIT_ROWS`` of them and then written out as CASE expressions, so judging is one
scan. Suffix statistics are the smoothed share of blocked urls by the host's last label
among all labelled rows.

Defined results: a null url, or one without ``://``, has an empty host and path, matches
no rule and is judged by the trees on an empty url; no labelled url gives verdict
``allow``, labels of one kind only give that kind; repeated rows get equal answers; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._stash import Stash

#: About how many labelled urls the fit reads (all of them if there are fewer), trees and their depth.
FIT_ROWS, TREES, DEPTH = 20_000, 10, 3
#: Rows of the table of suffixes up to which it is broadcast (hosts are cut at 253 characters in practice: some MB).
MOST_SUFFIXES = 10_000
FEATURES = ("length", "depth", "digits", "entropy", "params", "suffix_length", "suffix_rate")


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def parts(url: Column) -> tuple[Column, Column]:
    """The lower-cased host and the path of a url."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def fitting(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule that fits, as a struct of name and verdict; null if none does."""
    out = None
    for r in sorted(rules, key=lambda r: (-len(r.name), r.name)):
        fits = ((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path)
        found = F.struct(F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict"))
        out = F.when(fits, found) if out is None else out.when(fits, found)
    return out if out is not None else F.lit(None).cast("struct<name:string,verdict:string>")


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """Features that need the url alone."""
    size = F.length(url)
    letters = F.array_distinct(F.filter(F.split(url, ""), lambda c: c != ""))
    share = lambda c: (size - F.length(F.replace(url, c, F.lit("")))) / size
    entropy = F.aggregate(letters, F.lit(0.0), lambda acc, c: acc - share(c) * F.log2(share(c)))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    digits = F.length(F.regexp_replace(url, "[^0-9]", ""))
    return {
        "length": size.cast("double"),
        "depth": (F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))).cast("double"),
        "digits": F.when(size > 0, digits / size).otherwise(0.0),
        "entropy": F.when(size > 0, entropy).otherwise(0.0),
        "params": F.when(query == "", 0).otherwise(F.length(F.regexp_replace(query, "[^&]", "")) + 1).cast("double"),
        "suffix": F.regexp_extract(host, r"[^.]*$", 0),
    }


_SPLIT = re.compile(r"(If|Else) \(feature (\d+) (?:<=|>) (\S+)\)|Predict: (\S+)")


def _case(lines: Iterator[str]) -> Column:
    """The next tree of a model's description, a line for each branch and leaf, as nested CASE expressions."""
    branch, feature, threshold, leaf = _SPLIT.search(next(lines)).groups()
    if leaf is not None:
        return F.lit(float(leaf))
    low = _case(lines)
    next(lines)  # Else, with the same feature and threshold.
    return F.when(F.col(FEATURES[int(feature)]) <= float(threshold), low).otherwise(_case(lines))


def fitted(train: DataFrame, trees: int, depth: int):
    """Boosted trees over FEATURES and label."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    data = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(train).select("features", "label")
    return GBTClassifier(maxIter=trees, maxDepth=depth, seed=7, stepSize=0.3).fit(data)


def margin(model) -> Column:
    """The model's margin of a row of FEATURES; above 0 it predicts 1."""
    out = F.lit(0.0)
    for tree, weight in zip(model.trees, model.treeWeights, strict=True):
        out = out + F.lit(float(weight)) * _case(line for line in tree.toDebugString.split("\n") if _SPLIT.search(line))
    return out


def judge(pages: DataFrame, rules: list[Rule], *, rows: int = FIT_ROWS, trees: int = TREES, depth: int = DEPTH, held_out: Column | None = None) -> DataFrame:
    """One row per row of ``pages`` (page_id, url): page_id, host, path, rule, verdict, margin (of the trees; above 0 is block).

    Nothing is learned from the rows that ``held_out``, a condition on page_id, names.
    """
    url = F.coalesce(F.col("url"), F.lit(""))
    host, path = parts(url)
    split = pages.select("page_id", url.alias("url"), host.alias("host"), path.alias("path"))
    ruled = split.withColumn("r", fitting(F.col("host"), F.col("path"), rules))
    features = ruled.select("page_id", "host", "path", "r", *[c.alias(k) for k, c in lexical(F.col("url"), F.col("host"), F.col("path")).items()])
    features = features.withColumn("suffix_length", F.length("suffix").cast("double"))

    learned = F.col("r").isNotNull() & (F.lit(True) if held_out is None else ~F.coalesce(held_out, F.lit(False)))
    known = ruled.filter(learned)
    labels = {r["verdict"]: r["count"] for r in known.groupBy(F.col("r.verdict").alias("verdict")).count().collect()}
    total = sum(labels.values())
    name = F.col("r.name")
    if len(labels) < 2:
        verdict = next(iter(labels), "allow")
        return ruled.select("page_id", "host", "path", name.alias("rule"), F.coalesce("r.verdict", F.lit(verdict)).alias("verdict"), F.lit(0.0).alias("margin"))
    labelled = features.filter(learned).withColumn("label", (F.col("r.verdict") == "block").cast("double"))
    overall = labels["block"] / total
    # All labelled rows count; a fitted row's own label is taken out of its suffix's rate, so that no tree learns it back.
    counted = Stash(pages.sparkSession, "urls").put(labelled.groupBy("suffix").agg(F.sum("label").alias("blocked"), F.count("*").alias("of")), "suffixes")
    rate = lambda own, n: (F.coalesce(F.col("blocked"), F.lit(0.0)) - own + 2 * overall) / (F.coalesce(F.col("of"), F.lit(0)) - n + 2)
    # As many rows as there are last labels of hosts: sent to all only while they are few.
    known_suffixes = F.broadcast(counted) if counted.count() <= MOST_SUFFIXES else counted
    sample = labelled
    if total > rows:
        sample = sample.filter(F.pmod(F.xxhash64("page_id", "host", "path"), F.lit(1 << 30)) < int(rows / total * (1 << 30)))
    sample = sample.join(known_suffixes, "suffix", "left").withColumn("suffix_rate", rate(F.col("label"), 1)).select(*FEATURES, "label")
    sample = Stash(pages.sparkSession, "urls").put(sample, "sample")
    kinds = sample.select("label").distinct().count()
    trees_margin = margin(fitted(sample, trees, depth)) if kinds == 2 else F.lit(1.0 if overall >= 0.5 else -1.0)
    found = features.join(known_suffixes, "suffix", "left").withColumn("suffix_rate", rate(F.lit(0.0), 0)).withColumn("margin", trees_margin)
    verdict = F.coalesce("r.verdict", F.when(F.col("margin") > 0, "block").otherwise("allow"))
    return found.select("page_id", "host", "path", name.alias("rule"), verdict.alias("verdict"), "margin")
