import random
import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken

import corpus_pipeline
from quern.llm import byte_bpe, language_id, near_dedup, registry
from tests.llm.test_documents import shingles


def test_stages_keep_columns_and_take_effect(spark, docs, tmp_path):
    base = "/root/testdata/sf0.001"
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        columns = now.columns
        path = f"{tmp_path}/{name}"
        stage(spark, now, base).write.parquet(path)
        now = spark.read.parquet(path)
        if name != "encode":
            assert now.columns == columns
    assert now.columns == ["doc_id", "ids", "text"]
    assert 0 < now.count() < docs.count()


def test_stages_on_empty_documents(spark, empty):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "/root/testdata/sf0.001").count() == 0


def test_near_decides_per_row(spark):
    word = lambda k, n=60: " ".join(f"{k}{i}" for i in range(n))
    groups = {
        # The near copy of an older document shares its id with a clean row.
        "older": [(1, word("a")), (2, word("a") + " more")], "clean": [(2, word("b"))],
        # Two near copies that share the component's least id.
        "tie": [(5, word("c")), (5, word("c") + " more"), (6, word("c") + " again")],
        "no_id": [(None, word("d")), (None, word("d") + " more")], "some_id": [(None, word("e")), (9, word("e") + " more")],
        "blank": [(3, None), (4, "")],
    }
    rows = [(i, x, g) for g, members in groups.items() for i, x in members]
    docs = spark.createDataFrame(rows, "doc_id long, text string, g string").repartition(3)
    kept = corpus_pipeline.near(spark, docs, "")
    assert kept.columns == docs.columns
    found = [tuple(r) for r in kept.collect()]
    assert set(found) <= set(rows)
    ids = lambda g: sorted(i for i, _, h in found if h == g)
    assert (ids("older"), ids("clean"), ids("tie"), ids("some_id"), ids("blank")) == ([1], [2], [5], [9], [3, 4])
    assert len([1 for r in found if r[2] == "no_id"]) == 1


def test_run_against_brute_force(spark, rows, tmp_path):
    """Each stage worked out by hand on what the stage before kept."""
    rng = random.Random(8)
    word = lambda k, n=50: " ".join(f"{k}{rng.choice(['the', 'und', 'les'])}{i}" for i in range(n))
    passage, other = word("q", 40), word("z", 30)
    texts = [word("a"), word("b"), word("c") + " " + passage + " " + word("d"), passage, passage[:-60], other + " tail", None, "", "12 34"]
    texts += [texts[0], texts[0] + " more", texts[1] + " more words", texts[1].replace("b", "B"), texts[2] + " end"]
    table = [(i if i % 7 else None, x, "en" if i % 2 else "de", "s", len(x or "")) for i, x in enumerate(texts * 2 + [x for _, x, *_ in rows])]
    spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars int").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    items = [(1, passage), (2, other), (3, None), (4, "one two three four")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    out = language_id.fit(spark.read.parquet(f"{tmp_path}/documents.parquet")).predict([r[1] for r in table])[2]
    now = [r for r, rejected in zip(table, out, strict=True) if not rejected]
    assert len(now) < len(table)
    number = lambda i: (i is not None, i or 0)
    best: dict = {}
    for r in now:
        if r[1] not in best or (number(r[0]), r[2:]) > (number(best[r[1]][0]), best[r[1]][2:]):
            best[r[1]] = r
    assert len(best) < len(now)
    now = list(best.values())
    sets = [shingles(r[1]) for r in now]
    up = list(range(len(now)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in range(len(now)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                up[top(a)] = top(b)
    groups: dict = {}
    for k, r in enumerate(now):
        groups.setdefault(top(k), []).append(r)
    assert len(groups) < len(now)
    # Of a group the least id stays; where only nulls compete, any one row.
    allowed = [[r for r in g if r[0] == min((x[0] for x in g if x[0] is not None), default=None)] for g in groups.values()]
    banned = [q for _, x in items if (q := shingles(x))]
    clean = lambda r: not any(100 * len(q & shingles(r[1])) >= 75 * len(q) for q in banned)
    assert any(not clean(r) for g in allowed for r in g)
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    oracle = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    left = {(r.doc_id, r.text, tuple(r.ids)) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    for group in allowed:
        made = [(r[0], r[1], tuple(oracle.encode_ordinary(r[1]))) for r in group]
        found = [m for m in made if m in left]
        # A group of one candidate is decided; among several the one that stays may be clean or not.
        assert len(found) == clean(group[0]) if len(group) == 1 else len(found) <= 1
        left -= set(found)
    assert not left


def test_memory_of_the_stages_workers():
    """A worker serves all stages: what one holds at its peak, and what encoding leaves behind, is bounded."""
    rng = random.Random(3)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(400)) for _ in range(1500)]
    batch = pa.record_batch({"doc_id": list(range(1500)), "text": texts, "content": [0] * 1500})

    def peak(run):
        tracemalloc.start()
        run()
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return most / 1e6

    model = language_id.Model(["a", "b", "c"], np.zeros((language_id.BUCKETS, 3), np.float32), np.zeros(3))
    # In pieces of 4 MB or half a million characters both take about 40.
    assert peak(lambda: [len(x) for x in near_dedup._signatures(5, 128, 4)([batch])]) < 20
    assert peak(lambda: model.predict(texts)) < 20
    made = []
    codec = registry.byte_codec(corpus_pipeline.MEMO)
    for at in range(0, 1500, 64):
        made += codec.encode_all(texts[at : at + 64])
        assert len(codec.memo) <= corpus_pipeline.MEMO
    assert [codec.decode(x).decode() for x in made] == texts
