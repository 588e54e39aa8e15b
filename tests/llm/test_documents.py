import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.llm import decontaminate, exact_dedup, language_id, secrets
from quern.llm._trigrams import trigram_query
from quern.llm.near_dedup import _buckets, near_duplicates


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_exact(docs, rows, empty):
    groups = defaultdict(list)
    for i, x, *_ in rows:
        groups[x or ""].append(i)
    want = Counter()
    for x, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        for i in ids:
            want[(i, keep, len(ids), i == keep, hashlib.sha256(x.encode()).hexdigest())] += 1
    assert Counter(map(tuple, exact_dedup.duplicates(docs).collect())) == want
    # A digest that does not tell texts apart changes nothing.
    weak = lambda t: F.unhex(F.sha2(F.length(t).cast("string"), 256))
    assert Counter(map(tuple, exact_dedup.duplicates(docs, digest=weak).collect())) == want
    assert exact_dedup.duplicates(empty).count() == 0
    kept = exact_dedup.survivors(docs)
    assert kept.columns == docs.columns
    assert Counter((r.doc_id, r.text or "") for r in kept.collect()) == Counter({(max((i for i in ids if i is not None), default=None), x): 1 for x, ids in groups.items()})
    assert exact_dedup.survivors(empty).count() == 0


def test_near(docs, rows, empty):
    sets = [(i, shingles(x)) for i, x, *_ in rows]
    up = list(range(len(sets)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                up[top(a)] = top(b)
    least = defaultdict(list)
    for j, (i, _) in enumerate(sets):
        least[top(j)].append(i)
    want = Counter()
    for j, (i, s) in enumerate(sets):
        c = min((x for x in least[top(j)] if x is not None), default=None) if s else i
        want[(i, len(s), c, i == c)] += 1
    assert Counter(map(tuple, near_duplicates(docs).collect())) == want
    assert near_duplicates(empty).count() == 0


def test_near_in_blocks(spark):
    # Families that share boilerplate: one bucket holds several components, of which some hide behind the star.
    rng = random.Random(9)
    base = [f"w{i}" for i in range(40)]
    texts = []
    for family in range(9):
        own = base[: 22 + family] + [f"f{family}x{i}" for i in range(18 + 3 * family)]
        for _ in range(5):
            mine = list(own)
            mine[rng.randrange(len(mine))] = f"y{rng.random()}"
            texts.append(" ".join(mine))
    sets = [shingles(x) for x in texts]
    up = list(range(len(sets)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in range(len(sets)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    want = {i: top(i) for i in range(len(texts))}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert 5 < len(set(want.values())) < len(texts)
    # One row a band makes buckets of nearly everything.
    for block, rows in ((2, 1), (3, 4), (7, 1), (256, 1)):
        assert {r.doc_id: r.component_id for r in near_duplicates(docs, block=block, rows=rows, t=16 if rows == 1 else 128).collect()} == want, (block, rows)


def test_near_buckets_of_any_size(spark):
    # Hashes whose sum as a long leaves 64 bits, in two equal buckets and a different one.
    sets = spark.range(8000).select(F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("fp"), F.lit(9).cast("long").alias("n_shingles"))
    sets = sets.filter(F.xxhash64("fp") > 1 << 62)
    n, least = sets.count(), sets.agg(F.min("fp")).first()[0]
    keyed = sets.withColumn("band", F.explode(F.array(*[F.lit(x).cast("long") for x in (5, 3)])))
    keyed = keyed.union(sets.orderBy("fp").limit(n - 1).withColumn("band", F.lit(7).cast("long"))).union(sets.limit(1).withColumn("band", F.lit(8).cast("long")))
    assert n > 1000
    assert sorted(map(tuple, _buckets(keyed).collect())) == [(3, n, least, 9), (7, n - 1, least, 9)]


def test_decontaminate(spark, docs, rows, empty):
    by_id = [x for _, x, *_ in rows]
    passage = " ".join(by_id[6].split()[100:140])
    items = [(0, passage), (1, passage), (2, "never seen " * 9), (3, None), (4, ""), (5, "ONE  two three\nfour"), (None, by_id[14]), (6, passage[:-40] + " and then some other words")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    want = Counter()
    for i, x, *_ in rows:
        s = shingles(x)
        hits = [k for k, y in items if (q := shingles(y)) and 100 * len(q & s) >= 75 * len(q)]
        want[(i, len(s), tuple(sorted(map(str, hits))))] += 1
    found = decontaminate.contamination(docs, benchmark).collect()
    assert Counter((r.doc_id, r.n_shingles, tuple(sorted(map(str, r["items"])))) for r in found) == want
    clean = Counter(i for (i, _, hits), n in want.items() if not hits for _ in range(n))
    assert Counter(r.doc_id for r in decontaminate.clean(docs, benchmark).collect()) == clean
    assert Counter(r.doc_id for r in decontaminate.clean(docs, benchmark, block=20).collect()) == clean
    # Items dealt into several blocks: still one row per document, with the hits of all blocks.
    few = decontaminate.contamination(docs, benchmark, block=20).collect()
    assert Counter((r.doc_id, r.n_shingles, tuple(sorted(map(str, r["items"])))) for r in few) == want
    pairs = lambda rs: Counter((r.doc_id, r.n_shingles, r.contaminated, tuple(sorted((str(i), n) for i, n in zip(r["items"], r.shared, strict=True)))) for r in rs)
    assert pairs(few) == pairs(found)
    assert decontaminate.contamination(empty, benchmark, block=20).count() == 0
    assert decontaminate.contamination(empty, benchmark).count() == 0
    assert decontaminate.contamination(docs, benchmark.filter("false")).filter("contaminated").count() == 0


def test_language(spark, docs, rows, empty):
    found = language_id.identify(docs).collect()
    assert len(found) == len(rows)
    blank = Counter(i for i, x, *_ in rows if not any(c.isalpha() for c in x or ""))
    assert Counter(r.doc_id for r in found if r.lang_pred == "und") == blank
    assert all(0 <= r.score <= 1 and (r.lang_pred in ("de", "en", "fr", "und")) for r in found)
    assert language_id.identify(empty).count() == 0
    assert {r.lang_pred for r in language_id.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    real = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    judged = language_id.identify(real).filter("held_out").join(real.select("doc_id", "lang"), "doc_id")
    assert judged.filter("lang = lang_pred").count() >= 0.97 * judged.count()
    assert language_id.accepted(docs).columns == docs.columns


def test_rare_language_is_learned_from_a_sample(spark):
    rows = [(i, "the cat sat on the mat", "en") for i in range(3000)] + [(i, "der Hund und die Katze", "de") for i in range(3000, 5000)] + [(i, "água e pão são açúcar", "pt") for i in range(9000, 9004)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    known = docs.filter(language_id.fold(F.col("doc_id")) != 1)
    assert known.filter("lang = 'pt'").count() > 0
    model = language_id.fit(docs, rows=40)
    assert model.langs == ["de", "en", "pt"]
    assert model.predict(["pão e água"])[0] == ["pt"]
    assert language_id._most([3, 2000, 1300], 40) == 18.5
    assert language_id._most([10, 10], 5) == 2.5


def test_language_against_brute_force(monkeypatch):
    # Buckets so many that no two n-grams of these texts share one would be needed for string counts: the bucket function is taken as given.
    def buckets(text):
        codes = [c if c.isalpha() else " " for c in text.lower()]
        for n in range(1, language_id.LONGEST + 1):
            for i in range(len(codes) - n + 1):
                mixed = 0
                for c in codes[i : i + n]:
                    mixed = (mixed ^ ord(c)) * 0x9E3779B1 % 2**32
                x = (mixed + n * 0x85EBCA6B % 2**32) % 2**32
                x ^= x >> 15
                yield (x * 0x2C1B3C6D % 2**32) >> 17

    train = {"a": ["the cat sat on the mat", "a dog's day"], "b": ["der Hund und die Katze", "Ünd"]}
    counts = {k: Counter(g for t in texts for g in buckets(t)) for k, texts in train.items()}
    logs = np.array([[np.log((counts[k][g] + 0.5) / (sum(counts[k].values()) + 0.5 * language_id.BUCKETS)) for k in "ab"] for g in range(language_id.BUCKETS)]).astype(np.float32)
    texts = ["the hund sat", None, "die Katze on the mat " * 9, "x", "123", "und the cat", "Ωμέγα και άλφα είναι γράμματα"]
    for segment in (language_id.SEGMENT, 64, 7, 3):
        monkeypatch.setattr(language_id, "SEGMENT", segment)
        found = {k: language_id._count(iter([pa.record_batch({"text": t, "lang": [k] * len(t)})])) for k, t in train.items()}
        assert {k: {b: n for batch in bs for b, n in zip(batch["bucket"].to_pylist(), batch["n"].to_pylist(), strict=True)} for k, bs in found.items()} == counts
        langs, score, out = language_id.Model(["a", "b"], logs, np.log([0.4, 0.6])).predict(texts)
        for text, lang, chance, rejected in zip(texts, langs, score, out, strict=True):
            grams = list(buckets(text or ""))
            likely = np.array([sum(float(logs[g, j]) for g in grams) for j in range(2)])
            sums = likely + np.log([0.4, 0.6])
            best = int(sums.argmax())
            spoken = any(c.isalpha() for c in text or "")
            assert lang == ("ab"[best] if spoken else "und")
            assert abs(chance - (1 / np.exp(sums - sums.max()).sum() if spoken else 0)) < 1e-4
            usual = float((np.exp(logs[:, best].astype(float)) * logs[:, best]).sum())
            assert rejected == (not spoken or chance < 0.5 or len(grams) >= language_id.FEW and likely[best] < len(grams) * (usual - language_id.MARGIN))


def test_texts_in_no_learned_language_are_rejected(spark):
    real = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.fit(real)
    rng = random.Random(1)
    noise = ["".join(rng.choice(alphabet) for _ in range(300)) for alphabet in ("abcdefghijklmnopqrstuvwxyz ", "абвгдежзийклмноп ") for _ in range(20)]
    assert model.predict(noise)[2].all() and model.predict(["zażółć gęślą jaźń prosimy czytać polski tekst w tym miejscu"])[2].all()
    texts = [r.text for r in real.select("text").collect() if r.text and any(c.isalpha() for c in r.text)]
    assert model.predict(texts)[2].sum() == 0


def reference_spans(text):
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 12:
            out.append((m.start(), 0, m.end()))
    for rank, pattern, least in ((1, "AKIA[A-Z0-9]+", 18), (2, "[0-9a-f]+", 16)):
        out += [(m.start(), rank, m.end()) for m in re.finditer(pattern, text) if len(m[0]) >= least]
    return sorted(out)


def test_secrets(spark, docs, rows, empty):
    names = ("assign", "access", "hex")
    want = Counter()
    for i, x, *_ in rows:
        spans = reference_spans(x or "")
        want[(i, ",".join(f"{names[r]}:{a}:{b}" for a, r, b in spans))] += 1
    found = secrets.scan(docs)
    assert Counter((r[0], r[1]) for r in found.select("doc_id", secrets.spelled(F.col("base"))).collect()) == want
    assert "github:" in "".join(r[0] for r in found.select(secrets.spelled(F.col("found"))).collect())
    assert secrets.scan(empty).count() == 0
    real = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r[0]: r[1] for r in secrets.scan(real).select("doc_id", secrets.spelled(F.col("base"))).collect()}
    for r in real.select("doc_id", "text").collect():
        assert got[r.doc_id] == ",".join(f"{names[k]}:{a}:{b}" for a, k, b in reference_spans(r.text or ""))


def test_secrets_in_blocks(spark, docs):
    want = Counter(map(str, secrets.scan(docs).collect()))
    for block, most in ((1, 1000), (5, 0), (1000, 3)):
        assert Counter(map(str, secrets.scan(docs, block=block, most_sent=most).collect())) == want


def test_candidates_are_those_of_the_queries(spark, rows, docs):
    rules = secrets.BASE + secrets.MORE
    plain = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    found = {r.h: set(r.rules) for r in secrets.candidates(secrets.index(plain, rules, block=4), rules).collect()}
    named = {r.h: r.text for r in plain.select(F.xxhash64("text").alias("h"), "text").collect()}
    ascii_lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for h, text in named.items():
        low = text.translate(ascii_lower)
        fulfilled = {i for i, r in enumerate(rules) if r.query and all(any(all(g in low for g in grams) for grams in one) for one in r.query)}
        assert found.get(h, set()) == fulfilled


def test_trigram_queries():
    assign, access, hexadecimal = (r.query for r in secrets.BASE)
    assert hexadecimal == [] and access == [[{"aki", "kia"}]]
    assert {"api", "pik", "ike", "key"} in assign[0] and {"api", "pi_", "i_k", "_ke", "key"} in assign[0]
    assert trigram_query("ab?c{2}d+(xyz|uv[wW]s)") == [[{"abc", "bcc", "ccd"}, {"acc", "ccd"}], [{"uvw", "vws"}, {"xyz"}]]
    assert trigram_query("abc|.*") == [] and trigram_query("a") == [] and trigram_query("(abcd|x*)y") == []
    for odd in (r"\d", "[^a]", "(?=a)", "a**", "^a", "(a", "[[:alpha:]]"):
        with pytest.raises(ValueError):
            trigram_query(odd)


EXPRESSIONS = [r.regex for r in secrets.BASE + secrets.MORE] + ["ab?c{2}d+(xyz|uv[wW]s)", "(foo|ba[rz]{1,3})+(quux)?end", "x{5}y{2,}|(?:one|two(three|four)?)five", "[a-c][d-f][g-i]stem(s|)", "(?i:ABC)d.ef|\\x41BCD"]


@settings(max_examples=300, deadline=None)
@given(st.data())
def test_no_match_escapes_its_query(data):
    pattern = data.draw(st.sampled_from(EXPRESSIONS))
    text = data.draw(st.from_regex(re.compile(pattern, re.A)))
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    assert all(any(all(g in low for g in grams) for grams in one) for one in trigram_query(pattern))


def test_sketches_miss_nothing():
    rng = np.random.default_rng(3)
    u64 = lambda n: rng.integers(0, 2**63, n, dtype=np.uint64)
    common = u64(12)
    sets = [np.unique(np.concatenate((common[: q // 4], u64(q - q // 4)))) for q in [*range(1, 70), 100, 129, 255, 256, 1000] for _ in range(3)]
    for percent in (75, 100, 30, 1):
        index = decontaminate.Index(list(range(len(sets))), sets, percent)
        for s in sets:
            for share in (0.2, 0.6, 0.74, 0.75, 0.76, 1.0):
                part = rng.permutation(s)[: int(np.ceil(share * len(s)))]
                document = np.unique(np.concatenate((part, u64(500))))
                want = [(i, n) for i, x in enumerate(sets) if 100 * (n := len(np.intersect1d(x, document))) >= percent * len(x)]
                assert index.search(document) == want


def test_one_text_in_a_third_of_all_rows(spark):
    # Copies with ids of their own, with one id, and without any, beside others.
    texts = [(i, "hot") for i in range(400)] + [(7, "hot")] * 200 + [(None, "hot")] * 50 + [(1000 + i, f"t{i % 300}") for i in range(900)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(7)
    groups = defaultdict(list)
    for i, x in texts:
        groups[x].append(i)
    keep = {x: max(i for i in ids if i is not None) for x, ids in groups.items()}
    want = Counter((i, keep[x], len(groups[x]), i == keep[x], hashlib.sha256(x.encode()).hexdigest()) for i, x in texts)
    found = exact_dedup.duplicates(docs)
    assert Counter(map(tuple, found.collect())) == want
    # The rows of the hot text go back to their group in several tasks.
    spread = docs.filter("text = 'hot'").select(F.pmod(F.xxhash64("doc_id"), F.lit(exact_dedup.PARTS)).alias("part")).distinct().count()
    assert spread == exact_dedup.PARTS
    assert Counter((r.doc_id, r.text) for r in exact_dedup.survivors(docs).collect()) == Counter((i, x) for x, i in keep.items())
    near = {(r.doc_id, r.component_id) for r in near_duplicates(docs.filter("doc_id is not null")).collect()}
    assert near == {(i, min(j for j in groups[x] if j is not None)) for i, x in texts if i is not None}
