import random

import pytest

from marlstone.llm import bpe, token_counts

tokenizers = pytest.importorskip("tokenizers")
P = pytest.importorskip("public_tokenizers")
PATH = P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(PATH)


TEXTS = [None, "", " ", "a b c", "I'll go, we've gone!!", "x<|endoftext|> y<|endoftext|>", "naïve café 中文 😀\t\n\n  end ", "a" * 3000, "\u00a0\u2003 z\x1c\x85", "word " * 4000, "same", "same"]


def test_ids_and_text_equal_the_library(spark, library, prose):
    texts = [*TEXTS, prose(1, 500)]
    df = spark.createDataFrame([(k, t, "c") for k, t in enumerate(texts)], "doc_id long, text string, ids string")
    rows = {r.doc_id: r for r in bpe.encode(df, PATH, decoded=True).collect()}
    for k, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert rows[k].ids == ids and rows[k].decoded == (t or "") == library.decode(ids, skip_special_tokens=False)


def test_decode_of_stored_ids(spark):
    df = spark.createDataFrame([(1, [50256, 0]), (2, []), (3, None)], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in bpe.decode(df, PATH).collect()} == {1: "<|endoftext|>!", 2: "", 3: ""}


def test_merge_order_of_overlapping_pairs(library):
    coder = bpe.PairIndexBPE(PATH)
    for t in ("aaaa", "aaaaa", "ababab", "mississippi", "zzzzzzzzzzzz"):
        flat, counts = coder.encode([t, t + t])
        assert flat.tolist() == library.encode(t).ids + library.encode(t + t).ids and counts.sum() == len(flat)


def test_random_texts_equal_the_library(library):
    draw = random.Random(5)
    kinds = (lambda: draw.randrange(32, 127), lambda: draw.randrange(160, 0xD7FF), lambda: draw.randrange(0xE000, 0x1FFFF), lambda: draw.choice(b"ab \n'"))
    texts = ["".join(chr(draw.choice(kinds)()) for _ in range(draw.randrange(80))) for _ in range(1500)] + ["", "ab" * 3001, "a" * 5003]
    coder = bpe.PairIndexBPE(PATH)
    flat, counts = coder.encode(texts)
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert counts.tolist() == [len(ids) for ids in want] and flat.tolist() == [i for ids in want for i in ids]
    assert coder.decode(flat, counts) == texts
    assert [len(x) for x in coder.encode([])] == [0, 0]


def test_every_code_point_is_cut_as_by_the_library(library):
    coder = bpe.PairIndexBPE(PATH)
    known = bpe.newer_characters()
    some = known + "".join(chr(c) for c in range(0x80, 0x30000, 5) if not 0xD800 <= c < 0xE000)
    texts = ["".join(lead + c for c in some[k : k + 500]) for lead in ("a", "1", "!", " ") for k in range(0, len(some), 500)]
    flat, counts = coder.encode(texts)
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert counts.tolist() == [len(ids) for ids in want] and flat.tolist() == [i for ids in want for i in ids]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.encode(df, PATH).count() == 0 and token_counts.count_tokens(df, PATH).count() == 0


def test_counts_equal_the_library(spark, library):
    df = spark.createDataFrame([(k, t, 1) for k, t in enumerate(TEXTS)], "doc_id long, text string, n_tokens int")
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in token_counts.count_tokens(df, PATH).collect()}
    assert got == {k: (len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for k, t in enumerate(TEXTS)}


def test_cache_is_used_and_extended(spark, tmp_path):
    cache = str(tmp_path / "cache")
    a = spark.createDataFrame([(1, "one two"), (2, "three"), (3, "three")], "doc_id long, text string")
    token_counts.count_tokens(a, PATH, cache).collect()
    stored = spark.read.parquet(cache)
    assert stored.count() == 2
    # a stored count is trusted: only misses are encoded
    faked = stored.selectExpr("digest", "tokenizer", "n_tokens + 100 AS n_tokens")
    other = str(tmp_path / "other")
    faked.write.parquet(other)
    b = spark.createDataFrame([(1, "one two"), (9, "new text")], "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(b, PATH, other).collect()}
    assert got == {1: 102, 9: 2} and spark.read.parquet(other).count() == 3


def test_versions_do_not_mix(spark, tmp_path):
    pytest.importorskip("sentencepiece")
    import sentencepiece

    other, cache = P.path("piece_bpe_32k.model"), str(tmp_path / "cache")
    df = spark.createDataFrame([(1, "Hello wide world")], "doc_id long, text string")
    first = token_counts.count_tokens(df, PATH, cache).first().n_tokens
    second = token_counts.count_tokens(df, other, cache).first().n_tokens
    assert first == 3 and second == len(sentencepiece.SentencePieceProcessor(model_file=other).encode("Hello wide world"))
