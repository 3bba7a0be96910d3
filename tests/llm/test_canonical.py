import unicodedata

from tessera.llm import canonical as C


def forms(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "k long, t string").selectExpr("*", "'x' AS cp", "1 AS canonical")
    got = {r.k: r.canonical for r in C.canonical(df, ["k"], "t").collect()}
    assert len(got) == len(texts)
    return [got[i] for i in range(len(texts))]


def test_equal_looks_become_equal(spark):
    same = [
        ("Ｌｅｔ us", "Let us"), ("café", "café"), ("a​b⁠c﻿", "abc"), ("a b c", "a b c"), ("ﻼم", "لام"), ("раper", "paper"), ("ﬁne", "fine"), ("كي", "کی"),
        ("ئ", "ئ"), ("بَّ", "بَّ"), ("⼈", "人"), ("۱۲", "١٢"), ("q̣̇", "q̣̇"), ("ṩ", "ṩ"),
    ]
    a, b = forms(spark, [x for x, _ in same]), forms(spark, [y for _, y in same])
    assert a == b


def test_different_looks_stay_different(spark):
    pairs = [("cat", "cot"), ("Cat", "cat"), ("بَ", "بِ"), ("a.", "a"), ("7", "8"), ("a b", "a  b"), ("۴", "٤")]
    for x, y in zip(forms(spark, [p[0] for p in pairs]), forms(spark, [p[1] for p in pairs])):
        assert x != y


def test_edges_and_recomposition(spark):
    long = "é" * 20_000
    got = forms(spark, [None, "", "​", "plain", long, "́start", "ệ", "Å"])
    assert got == [None, "", "", "plain", "é" * 20_000, "́start", unicodedata.normalize("NFC", "ệ"), "Å"]


def test_hangul_and_mathematical_letters(spark):
    got = forms(spark, ["한글", unicodedata.normalize("NFD", "한글"), "각ᄀ", "𝐀𝒃", "Ꮮоndоn", "가\u0301"])
    assert got == ["한글", "한글", "각ᄀ", "Ab", "London", "가\u0301"]


def test_marks_in_any_order(spark):
    import random

    rng = random.Random(9)
    marks = ["\u0300", "\u0323", "\u0327", "\u0301", "\u0338"]
    texts = ["".join(rng.choice("aeq <=ω") + "".join(rng.choice(marks) for _ in range(rng.randrange(4))) for _ in range(8)) for _ in range(200)]
    want = [unicodedata.normalize("NFC", t) for t in texts]
    assert forms(spark, texts) == want


def test_canonical_is_stable_and_nfc_for_latin(spark):
    import random

    rng = random.Random(2)
    texts = ["".join(rng.choice("abcuöéşğ ̧̣́̈") for _ in range(20)) for _ in range(200)]
    once = forms(spark, texts)
    assert once == [unicodedata.normalize("NFC", t) for t in texts]
    assert forms(spark, once) == once


def test_found_pairs(spark):
    seg = "seg_key long, recording string, seq int, version string, text string, item_key int"
    s = spark.createDataFrame([(1, "r", 0, "v2", "a b", 0), (2, "r", 0, "v3", "a b", 0), (2, "r", 0, "v3", "a b", 0), (3, "r", 1, "v2", "x", 0), (4, "r", 1, "v3", "x", 0), (5, "r", 2, "v2", None, 0), (6, "r", 2, "v3", "x", 0), (7, "r", 3, "v2", "x", 0), (8, "r", 3, "v3", "y", 0)], seg)
    e = spark.createDataFrame([(1, "ayah", "كي", "کی"), (2, "hadith", "كي", "کی"), (3, "dua", "a", None), (4, "ayah", "ab", "abc")], "entity_id long, etype string, text string, canonical_text string")
    assert {tuple(r) for r in C.found_pairs(s, e).collect()} == {("segment", 2), ("entity", 1)}
    assert C.found_pairs(s.limit(0), e.limit(0)).count() == 0


def test_forms_of_every_text(spark):
    from tessera.llm import canonical, queries

    segments = spark.createDataFrame([(1, "v0", "caf\u0065\u0301"), (1, "v0", "caf\u0065\u0301"), (2, "v1", "ab\u200cc"), (3, "v2", "plain"), (4, "v3", None), (5, "v2", "")], "seg_key long, version string, text string")
    entities = spark.createDataFrame([(1, "hadith", "\uff41b", None), (1, "hadith", "\uff41b", None), (2, "topic", "x", "x\u00a0y")], "entity_id long, etype string, text string, canonical_text string")
    rows = canonical.forms(segments, entities).collect()
    got = {(r.item_kind, r.item_key): r.form for r in rows}
    assert len(rows) == len(got) == 9
    assert [got["segment", i] for i in range(1, 6)] == ["caf\u00e9", "abc", "plain", None, ""]
    assert got["entity_text", 1] == "ab" and got["entity_canonical_text", 1] is None and got["entity_canonical_text", 2] == "x y"
    assert "p7_forms" in queries.QUERIES
