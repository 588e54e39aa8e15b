import hashlib
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quern.llm import _words, byte_bpe, registry, token_counts, token_files
from quern.llm._perfect_hash import PerfectHash
from quern.llm._shingles import text_bytes

WORDS = public_tokenizers.path("word_bpe_49k.json")
library = Tokenizer.from_file(WORDS)
ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
oracle = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
codec = registry.byte_codec()
counter = token_counts.Counter(token_counts.Vocabulary(open(WORDS, encoding="utf-8").read()))
TEXT = st.text(st.one_of(st.characters(exclude_categories=["Cs"], max_codepoint=0x2FF), st.characters(exclude_categories=["Cs"]), st.sampled_from(" \n\t\r\x1c\x85\xa0's'reΣİéÉ<|>,.;:!?)\"xJ\u030c\u0338")), max_size=80)


@settings(max_examples=500, deadline=None)
@given(TEXT)
def test_counts_equal_the_library(text):
    assert counter.count(text) == len(library.encode(text, add_special_tokens=False).ids)


@settings(max_examples=500, deadline=None)
@given(TEXT)
def test_bytes_equal_the_library(text):
    ids = codec.encode(text)
    assert ids.tolist() == oracle.encode_ordinary(text)
    assert codec.decode(ids) == text.encode()


def test_perfect_hash_is_minimal():
    keys = [str(i).encode() for i in range(5000)] + [b"", b"\0", b"\0\0"]
    found = PerfectHash(keys).slots(keys)
    assert sorted(found) == list(range(len(keys)))
    assert len(PerfectHash([]).slots([b"x"])) == 1


def test_proven_strings_are_whole():
    vocabulary = counter.vocabulary
    assert len(vocabulary.whole) > 20_000
    for word in sorted(vocabulary.whole)[::97]:
        if regex.fullmatch(vocabulary.pattern, word):
            assert len(library.encode(word, add_special_tokens=False).ids) == 1


def test_count_query(docs, rows, empty):
    found = Counter(map(tuple, token_counts.token_counts(docs, WORDS).collect()))
    want = Counter()
    for i, x, *_ in rows:
        n = len(library.encode(x or "", add_special_tokens=False).ids)
        want[(i, len((x or "").encode()), n, n > 2048)] += 1
    assert found == want
    assert token_counts.token_counts(empty, WORDS).count() == 0


def test_byte_query(docs, rows, empty):
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = Counter()
    for i, x, *_ in rows:
        ids = oracle.encode_ordinary(x or "")
        want[(i, len(ids), sha(",".join(map(str, ids)).encode()), sha((x or "").encode()))] += 1
    assert Counter(map(tuple, byte_bpe.encoded(docs, codec).collect())) == want
    assert byte_bpe.encoded(empty, codec).count() == 0
    assert Counter((r.doc_id, tuple(r.ids), r.text) for r in byte_bpe.tokens(docs, codec).collect()) == Counter((i, tuple(oracle.encode_ordinary(x or "")), x or "") for i, x, *_ in rows)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300)))
def test_pack_round_trip(values):
    control, data = token_files.pack(np.array(values, np.uint32))
    assert len(control) == -(-len(values) // 4)
    assert token_files.unpack(control, data, len(values)).tolist() == values


def test_token_files(spark, docs, rows, empty, tmp_path):
    token_files.write(docs, WORDS, f"file://{tmp_path}/a")
    found = token_files.read(spark, f"file://{tmp_path}/a").orderBy("start").collect()
    want = Counter()
    for i, x, *_ in rows:
        ids = np.array([*library.encode(x or "", add_special_tokens=False).ids, 2], "<u4")
        want[(i, len(ids), zlib.crc32(ids.tobytes()))] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in found) == want
    assert [r.doc_id for r in found] == sorted((r.doc_id for r in found), key=lambda v: (v is not None, v))
    at = 0
    for r in found:
        assert r.start == at
        at += r.n_tokens
    token_files.write(empty, WORDS, f"file://{tmp_path}/b")
    assert token_files.read(spark, f"file://{tmp_path}/b").count() == 0


memo = _words.Words(open(WORDS, encoding="utf-8").read(), 2)


def encoded_by(held, texts):
    ids, places = held.encode(*text_bytes(pa.array(texts, pa.string())))
    return [ids[a:b].tolist() for a, b in zip(places[:-1], places[1:], strict=True)]


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.none() | TEXT, max_size=5))
def test_words_equal_the_library(texts):
    assert encoded_by(memo, texts) == [[*library.encode(x or "", add_special_tokens=False).ids, 2] for x in texts]


def test_words_in_small_pieces(monkeypatch, rows):
    texts = [x for _, x, *_ in rows] + ["\0a a\0 a \0 " + "x" * 15 + " " + "x" * 16 + " " + "y" * 300 + " e \u0301e", "a,'s b.'re c.\u0338d x,<|endoftext|>,y 1.2.3 J\u030c!!! don't.'t", "a,"]
    want = [[*library.encode(x or "", add_special_tokens=False).ids, 2] for x in texts]
    for chunk, most in ((64, 50), (1 << 10, 3000), (1 << 22, 1 << 20)):
        monkeypatch.setattr(_words, "CHUNK", chunk)
        monkeypatch.setattr(_words, "MOST", most)
        held = _words.Words(open(WORDS, encoding="utf-8").read(), 2)
        assert encoded_by(held, texts) == want
        assert encoded_by(held, texts) == want


def test_other_tokenizers_take_whole_texts(rows):
    source = open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read()
    assert _words.cuts_at_blanks(open(WORDS, encoding="utf-8").read()) and not _words.cuts_at_blanks(source)
    other = Tokenizer.from_str(source)
    texts = [x for _, x, *_ in rows]
    assert encoded_by(_words.Words(source, 50256), texts) == [[*other.encode(x or "", add_special_tokens=False).ids, 50256] for x in texts]
