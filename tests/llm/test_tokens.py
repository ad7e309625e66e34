import base64
import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from klaxon.llm import bpe
from klaxon.llm import token_output as T

public_tokenizers = pytest.importorskip("public_tokenizers")

TEXTS = ["", "a", "It's \"quoted\", isn't it?", "ΑΣ ΣΑΣ. İstanbul", "éÉ, É", "#tag ## a.b, x',' y's, 12.5% ½", "<|endoftext|> x</w>", "a <|endoftext|> b", "a<|endoftext|>B<|startoftext|>", "<|EndOfText|> x's", "A<|endoftext|><|endoftext|>'s", "<|ENDOFTEXT|><|endoftext|>",
         "  \t\n ", "word" * 500, "a b\x0bc   d…, e", "日本語 テキスト。", "x_y_ z__,"]


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(T.default_tokenizer())


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.one_of(st.characters(codec="utf-8"), st.sampled_from([*"abcAB '.,#\n\t_1é", "<|endoftext|>", "<|EndOfText|>", "<|startoftext|>"])), max_size=60).map("".join), min_size=1, max_size=5))
def test_words_give_the_ids_of_whole_texts(texts):
    t, w = library_(), words_()
    ids, counts = w.encode(texts, 2)
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [t.encode(x, add_special_tokens=False).ids + [2] for x in texts]


_kept = {}


def library_():
    return _kept.setdefault("t", library())


def words_():
    return _kept.setdefault("w", T.WordIds(T.default_tokenizer(), most=50))


def test_words_tricky():
    test = T.WordIds(T.default_tokenizer(), most=20)
    for _ in range(3):
        ids, counts = test.encode(TEXTS, 2)
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [library_().encode(x, add_special_tokens=False).ids + [2] for x in TEXTS]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1) | st.integers(0, 70000) | st.just(0), max_size=3000))
def test_simple8b_round_trip(values):
    a = np.array(values, dtype=np.uint64)
    words, offsets, escapes = T.pack(a)
    assert (T.unpack(words, offsets, escapes, len(a)) == a).all()
    data = T.file_bytes(a, np.array([-5], dtype=np.int64), np.array([True]), np.array([len(a)]))
    ids, doc_ids, has_id, lengths = T.read_file(data)
    assert (ids == a).all() and doc_ids.tolist() == [-5] and has_id.tolist() == [True] and lengths.tolist() == [len(a)]


def test_token_files(spark):
    rows = [(3, "b b"), (1, "Hello, world."), (None, "none"), (2, None), (1, "Hello, world."), (7, "x " * 30000)]
    df = spark.createDataFrame([(a, b, "clash", 1) for a, b in rows], "doc_id long, text string, ids string, start int").repartition(3)
    got = sorted(map(tuple, T.tokens_of_documents(df).collect()), key=lambda r: r[1])
    want, start = [], 0
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = library_().encode(t or "", add_special_tokens=False).ids + [2]
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    assert got == want
    assert T.tokens_of_documents(df.where("false")).collect() == []
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    several = T.write(df, file_ids=3)  # several files in a partition
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert several.count() > 3 and sorted(map(tuple, T.read_back(several).collect()), key=lambda r: r[1]) == want


@pytest.mark.parametrize(("chunk", "overlap"), [(bpe.CHUNK, bpe.OVERLAP), (40, 12), (7, 3)])
def test_bpe_equals_tiktoken(spark, chunk, overlap):
    import tiktoken

    path, pattern = bpe.default_ranks()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("t", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    rows = [(k, t) for k, t in enumerate(TEXTS)] + [(None, "no id " * 40), (0, "same"), (0, "same"), (99, None), (100, "same   long " * 50), (100, "same   long " * 50)]
    df = spark.createDataFrame([(a, b, "x") for a, b in rows], "doc_id long, text string, n_tokens string")
    got = sorted(map(tuple, bpe.encode_documents(df, chunk=chunk, overlap=overlap).collect()), key=str)
    want = []
    for d, t in rows:
        ids = library.encode_ordinary(t or "")
        want.append((d, len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert bpe.encode_documents(df.where("false"), chunk=chunk, overlap=overlap).collect() == []
