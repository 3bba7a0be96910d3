import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import text as T


def one(spark, column, **cols):
    df = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} string" for k in cols))
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize(("text", "want"), [("ٱلرَّحْمٰن، ﷺ", None), ("الْكِتَابُ الْكَبِيرُ!", "الكتاب الكبير"), ("  a  b c. ", "a b c"), (None, ""), ("مکتبۃ ی", None), ("آية", "ايه")])
def test_matching_form(spark, text, want):
    got = one(spark, T.for_matching(F.col("t")), t=text)
    assert got is not None and (want is None or got == want)


def test_scores(spark):
    assert one(spark, T.edit_score(F.col("a"), F.col("b")), a="", b="") == 1.0
    assert one(spark, T.edit_score(F.col("a"), F.col("b")), a="kitten", b="sitting") == pytest.approx(1 - 3 / 7)
    f1 = T.token_f1(T.words(F.col("a")), T.words(F.col("b")))
    assert one(spark, f1, a="a a b", b="a b b") == pytest.approx(2 / 3)
    assert (one(spark, f1, a="", b=""), one(spark, f1, a="", b="x")) == (1.0, 0.0)


def test_correction_window(spark):
    ok = T.correction_accepted(F.col("a"), F.col("b"))
    assert one(spark, ok, a="one two three", b="one two three.") is True
    assert one(spark, ok, a="one two three", b="one two") is False
    assert one(spark, ok, a="one", b=" ") is False


def test_small_expressions(spark):
    assert one(spark, T.slug(F.col("t")), t="  Ab-c (d) ") == "Ab_c_d"
    assert one(spark, T.seconds_of(F.col("t")), t="1:02:03") == 3723 and one(spark, T.seconds_of(F.col("t")), t="2:05") == 125 and one(spark, T.seconds_of(F.col("t")), t="x") is None
    assert one(spark, T.verse_numbers(F.col("t")), t="3-5") == [3, 4, 5] and one(spark, T.verse_numbers(F.col("t")), t="7") == [7] and one(spark, T.verse_numbers(F.col("t")), t="5-3") == []
    assert one(spark, T.collection_id(F.col("t")), t="AD_12") == "SD_0012" and one(spark, T.collection_id(F.col("t")), t="Ahmad_1") is None
    assert one(spark, T.controlled(F.col("t"), T.USAGE), t=" Explicit Paraphrase") == "Paraphrase" and one(spark, T.controlled(F.col("t"), T.USAGE), t="other") is None
    assert one(spark, T.local_name(F.col("t")), t="http://a/b#C") == "C"
    assert one(spark, T.dominant_script(F.col("t")), t="HRكو") == "arabic" and one(spark, T.dominant_script(F.col("t")), t="12") is None
    assert one(spark, T.verse_key(F.col("a"), F.col("b")), a="2", b="255") == "CH002_V255" and one(spark, T.verse_key(F.col("a"), F.col("b")), a="2", b="1-3") is None


@pytest.mark.parametrize("reply", ['{"a": 1}', '<think>{"b": 2}</think> {"a": 1}', '```json\n{"a": 1}\n```', 'Here: {"a": 1} done'])
def test_json_reply(spark, reply):
    assert one(spark, F.get_json_object(T.json_reply(F.col("t")), "$.a"), t=reply) == "1"


def test_rounding_is_that_of_python(spark):
    xs = [0.35, 12.35, 2.5, -0.05, 1.005, 0.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    assert [r[0] for r in df.select(T.half_even("x", F.lit(1))).collect()] == [round(x, 1) for x in xs]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=12), st.lists(st.sampled_from("abc"), max_size=12))
def test_alignment_is_least_and_turns_one_into_the_other(a, b):
    edits = T.align(a, b)
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        d, p = [i], d
        for j, y in enumerate(b, 1):
            d.append(min(p[j - 1] + (x != y), p[j] + 1, d[-1] + 1))
    assert len(edits) == d[-1]
    out, i, j = [], 0, 0
    for kind, at, to in edits:
        out += a[i:at]
        i = at + (kind != "insertion")
        if kind != "deletion":
            out.append(b[to])
    assert out + a[i:] == b


def test_profiles(spark):
    assert one(spark, T.in_profile(F.col("t"), "relaxed_without_diacritics"), t="أَهْلًا ہے۔") == "اهلا هے ۔"
    assert one(spark, T.in_profile(F.col("t"), "with_diacritics"), t="أَ  ب") == "أَ ب"


def test_differences_have_context(spark):
    rows = one(spark, T.word_differences(F.col("a"), F.col("b")), a="one two three four", b="one too three four five")
    assert [(r.kind, r.at, r.ref_word, r.hyp_word) for r in rows] == [("substitution", 1, "two", "too"), ("insertion", 4, None, "five")]
    assert rows[0].before == "one" and rows[0].after == "three four"


def test_sequence_ratio(spark):
    import difflib

    assert one(spark, T.sequence_ratio(F.col("a"), F.col("b")), a="Abcd", b="bcde") == difflib.SequenceMatcher(None, "abcd", "bcde").ratio()


def test_bits_and_band_give_the_distance(spark):
    import random

    from pyspark.sql import functions as F

    from tessera.functions import text as T

    def table(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(last[j - 1] + (x != y), last[j] + 1, row[-1] + 1))
        return row[-1]

    rng = random.Random(3)
    pairs = []
    for _ in range(1500):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(14))] for _ in range(2))
        n = table(a, b)
        got = T.align(a, b)
        assert T.n_edits(a, b) == n == len(got)
        out, at = [], 0
        for kind, i, j in got:
            out += a[at:i]
            at = i + (kind != "insertion")
            out += [] if kind == "deletion" else [b[j]]
        assert out + a[at:] == b
        pairs.append((*T.as_letters(a, b), n))
    df = spark.createDataFrame(pairs, "a string, b string, n int")
    assert df.where(T.distance(F.col("a"), F.col("b")) != F.col("n")).count() == 0
    assert T.distance is not None and T.n_edits(["w"] * 5000, ["w"] * 4000 + ["x"]) == 1000


def test_profiles_by_their_rules():
    import unicodedata

    from tessera.functions import text as T

    def slow(text, profile):
        drop, rules, part = T.PROFILES[profile]
        t = unicodedata.normalize("NFC", text)
        if rules:
            t = unicodedata.normalize("NFC", "".join(rules.get(c, c) for ch in t for c in (unicodedata.normalize("NFKC", ch) if ord(ch) in T.FORMS else ch)))
        if part:
            t = __import__("re").sub(r"(?<=\S)([۔،؟!.,?])", r" \1", t)
        return " ".join("".join(ch for ch in t if not (drop and T.is_arabic_mark(ch))).split())

    for text in ("كِتابٌ، ﻼﷲ ٱلقرآن؟! abc.", "کی أإآ ہ", "", "  a\u00a0b ", "ﳍ ئـؤ"):
        for profile in T.PROFILES:
            assert T._in_profile(text, profile) == slow(text, profile)


def test_checked_values_raise(spark):
    import pytest
    from pyspark.sql import functions as F

    from tessera.functions import text as T

    df = spark.createDataFrame([(" Explicit paraphrase",), (None,)], "u string")
    assert [r[0] for r in df.select(T.checked(F.col("u"), T.USAGE)).collect()] == ["Paraphrase", None]
    with pytest.raises(Exception, match="unknown value"):
        spark.createDataFrame([("other",)], "u string").select(T.checked(F.col("u"), T.USAGE)).collect()


def test_recording_names(spark):
    from pyspark.sql import functions as F

    from tessera.functions import text as T

    given = {"https://x.y/a%20b/Le%C3%A7on+1.mp3?q=1": "Leçon_1", "/data/rec 01.final.wav": "rec_01.final", "...": "recording", "https://x.y/": "recording", "سبق ۱.m4a": "سبق_۱"}
    df = spark.createDataFrame([(k,) for k in given], "s string")
    assert [r[0] for r in df.select(T.recording_name(F.col("s"))).collect()] == list(given.values())
