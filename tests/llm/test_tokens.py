import random
from pathlib import Path

import pytest

from tessera.llm import tokens as T

pytestmark = pytest.mark.skipif(not Path(T.FOLDER, T.NAME).exists(), reason="no tokenizer files")


def plain_encoder():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=T.PATTERN, mergeable_ranks=T._ranks(Path(T.FOLDER, T.NAME).read_bytes()), special_tokens={})


def test_pattern_is_the_published_one():
    import public_tokenizers as P

    assert {*P.PATTERN.split("|")} - {*T.PATTERN.split("|")} <= {"'s", "'t", "'re", "'ve", "'m", "'ll", "'d"}


def test_exact_against_whole_text_encoding(spark, monkeypatch):
    rng = random.Random(7)
    texts = ["", None, " ", "a", "<|endoftext|> x", "the " * 5000, "café ٹ漢字 🙂", "don't we'll", "\n\n  x", "x" * 3000]
    texts += ["".join(rng.choice("ab é漢🙂'\n s1​") for _ in range(rng.randrange(40))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 AS ids", "2 AS block").repartition(3)
    got = {r.doc_id: r.ids for r in T.encode(df, "doc_id", "text").collect()}
    enc = plain_encoder()
    assert len(got) == len(texts)
    assert all(got[i] == (enc.encode_ordinary(t) if t else []) for i, t in enumerate(texts))
    assert {r.doc_id: r.n_tokens for r in T.count(df, "doc_id", "text").collect()} == {i: len(x) for i, x in got.items()}
    ids = T.encode(df, "doc_id", "text")
    assert {r.doc_id: r.text for r in T.decode(ids, "doc_id", "ids").collect()} == {i: t or "" for i, t in enumerate(texts)}


def test_repeated_rows_blocks_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (2, "x" * (T.BLOCK_CHARS + 5)), (3, "end")], "doc_id long, text string").coalesce(1)
    got = T.encode(df, "doc_id", "text").collect()
    assert sorted(r.doc_id for r in got) == [1, 1, 2, 3]
    assert T.encode(df.limit(0), "doc_id", "text").count() == 0


def test_hot_words_and_decoding_edges(spark, monkeypatch):
    monkeypatch.setattr(T, "HOT_ROWS", 3)
    monkeypatch.setattr(T, "HOT_SHARE", 0.01)
    monkeypatch.setattr(T, "BLOCK_CHARS", 50)
    rng = random.Random(5)
    texts = [" ".join(["qwertzuiop"] * 4 + [rng.choice(["zyxwvut", "漢字語", "plain", "ٹڈڑ"]) for _ in range(5)]) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    enc = plain_encoder()
    got = {r.doc_id: r.ids for r in T.encode(df, "doc_id", "text").collect()}
    assert got == {i: enc.encode_ordinary(t) for i, t in enumerate(texts)}
    odd = spark.createDataFrame([(1, None), (2, []), (3, [64, 10**8]), (3, [64, 10**8]), (4, got[0])], "doc_id long, ids array<int>")
    back = sorted((r.doc_id, r.text) for r in T.decode(odd, "doc_id", "ids").collect())
    assert back == [(1, None), (2, ""), (3, enc.decode([64]) + "\ufffd"), (4, texts[0])]


def test_a_word_is_encoded_once(spark, monkeypatch):
    texts = [f"xqzvword {i} xqzvword" for i in range(40)]
    monkeypatch.setattr(T, "BLOCK_CHARS", 30)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    seen = []
    monkeypatch.setattr(T, "checkpoint", lambda x: (seen.append(x), x)[1])
    T.encode(df, "doc_id", "text")
    words = [r.word for r in seen[1].collect()]
    assert len(words) == len(set(words)) and "xqzvword" in words
