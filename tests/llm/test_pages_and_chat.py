from collections import Counter, defaultdict

from quern.llm import chat, registry, url_filter


def parts(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    rest = rest[cut:]
    return host, rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]


def ruled(host, path):
    fits = [r for r in registry.URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.name), default=None)


def test_urls(spark):
    real = [r.url for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("url").collect()]
    odd = [None, "", "no scheme", "http://", "HTTP://A.EXAMPLE.COM/en/7?x=1#y", "http://com/en/", "http://xcom/en/", "http://a.com?/en/", "http://a.net/de/8#/x", "http://é.example.net/de/8/\nz", real[0], "x" * 50_000]
    rows = [(i, u, "", "s", 1.0) for i, u in enumerate(real + odd)] + [(None, real[1], None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, suffix string, r string, label double")
    found = url_filter.judge(pages, registry.URL_RULES).collect()
    assert Counter((r.page_id, r.host, r.path, r.rule) for r in found) == Counter((i, *parts(u), (x := ruled(*parts(u))) and x.name) for i, u, *_ in rows)
    for r in found:
        x = ruled(r.host, r.path)
        assert r.verdict == (x.verdict if x else "block" if r.margin > 0 else "allow")
    assert url_filter.judge(pages.filter("false"), registry.URL_RULES).count() == 0
    assert {r.verdict for r in url_filter.judge(pages, []).collect()} == {"allow"}


def test_trees(spark):
    """The CASE expressions give the model's own margin, features equal their definitions, and held-out urls are mostly judged as their rule does."""
    import math
    from pyspark.ml.feature import VectorAssembler
    from pyspark.sql import functions as F

    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url").filter("url is not null")
    host, path = url_filter.parts(F.col("url"))
    rows = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    made = rows.select("*", *[c.alias(k) for k, c in url_filter.lexical(F.col("url"), F.col("host"), F.col("path")).items()])
    for r in made.limit(300).collect():
        counts = Counter(r.url)
        query = r.url.split("?", 1)[1].split("#")[0] if "?" in r.url else ""
        entropy = -sum(n / len(r.url) * math.log2(n / len(r.url)) for n in counts.values())
        assert (r.length, r.depth, r.digits, r.params) == (len(r.url), r.path.count("/"), sum(c in "0123456789" for c in r.url) / len(r.url), query.count("&") + 1 if query else 0)
        assert abs(r.entropy - entropy) < 1e-9 and r.suffix == r.host.rsplit(".", 1)[-1]
    labelled = made.withColumns({"suffix_length": F.length("suffix").cast("double"), "suffix_rate": F.lit(0.5), "r": url_filter.fitting(F.col("host"), F.col("path"), registry.URL_RULES)}).filter("r is not null")
    labelled = labelled.withColumn("label", (F.col("r.verdict") == "block").cast("double"))
    model = url_filter.fitted(labelled, 4, 3)
    both = model.transform(VectorAssembler(inputCols=list(url_filter.FEATURES), outputCol="features").transform(labelled.limit(500).withColumn("m", url_filter.margin(model))))
    assert all(abs(r.m - r.rawPrediction[1] / 2) < 1e-9 or abs(r.m - r.rawPrediction[1]) < 1e-9 for r in both.collect())
    judged = url_filter.judge(pages, registry.URL_RULES, held_out=F.col("page_id") % 2 == 1).filter("rule is not null and page_id % 2 = 1")
    right, n = judged.agg(F.count_if((F.col("margin") > 0) == (F.col("verdict") == "block")), F.count("*")).first()
    print("held-out accuracy", right / n, n)
    assert right >= 0.85 * n


def test_chat(spark):
    turn = lambda c, k, text, role="user": (c, k, role, text, 1, "x", b"")
    rows = [turn(1, 0, "a"), turn(1, 1, "b"), turn(2, 0, "a"), turn(2, 1, "b"), turn(2, 2, "c"), turn(3, 0, "a"), turn(4, 0, "z"), turn(5, 0, "z"), turn(6, 0, "a", "system")]
    rows += [turn(7, 0, None), turn(7, None, "n"), turn(8, 0, ""), turn(None, 0, "a"), turn(9, 0, "a"), turn(9, 0, "a")]
    rows += [turn(10, k, f"long{k}") for k in range(300)] + [turn(11, k, f"long{k}") for k in range(130)] + [turn(12, k, f"long{k}") for k in range(129)] + [turn(12, 129, "other")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, block long, a string, key binary").repartition(3)
    lists = defaultdict(list)
    for c, k, role, text, *_ in rows:
        lists[c].append((k is not None, k or 0, role or "", text or ""))
    lists = {c: tuple(tuple(sorted(v)) for v in [x]) [0] for c, x in lists.items()}
    by_turn = lambda x: [tuple(t for t in x if t[:2] == key) for key in sorted({t[:2] for t in x})]
    grouped = {c: by_turn(x) for c, x in lists.items()}
    want = set()
    for c, x in grouped.items():
        longer = any(len(y) > len(x) and y[: len(x)] == x for y in grouped.values())
        same = [d for d, y in grouped.items() if y == x]
        if not longer and c == min(same, key=lambda v: (v is None, v or 0)):
            want.add(c)
    for block in (64, 2, 1000):
        assert {r.conv_id for r in chat.maximal(turns, block=block).collect()} == want
    out = chat.render(turns).collect()
    assert Counter(r.conv_id for r in out) == Counter(c for c, *_ in rows if c in want)
    assert all(r.rendered.startswith(f"<|im_start|>{r.role}\n") and r.rendered.endswith("<|im_end|>\n") for r in out)
    assert chat.render(turns.filter("false")).count() == 0
