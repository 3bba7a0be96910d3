import pytest

from tessera.llm import sentences as S

MODEL = S.Model({"en": frozenset({"dr", "p.m", "fig", "i.e", "vol"}), "ur": frozenset({"م", "ص"}), "tr": frozenset({"vb"})}, {"en": frozenset({"there", "we"}), "ur": frozenset()})


@pytest.mark.parametrize(
    ("lang", "parts"),
    [
        ("en", ["Dr. Selvane came at 7.40 a.m. with notes.", "We left.", "Why?!", "Good!"]),
        ("en", ["1. Bring a pen.", "2. Sit down."]),
        ("en", ["The class ended at 6 p.m.", "There are pages."]),
        ("en", ["They left at 6 p.m., i.e. early.", "Done."]),
        ("en", ['"Is this it?" asked Tarvin.', 'He said: "Come. Sit."', "Then we left."]),
        ("en", ["(He saw fig. 5 here.)", "We went on."]),
        ("en", ["Some waited... and then left.", "See notes.example.invalid/p1.html today."]),
        ("ur", ["«کیا یہ سبق ہے؟» ترون نے پوچھا۔", "م۔ دورون آئے۔", "ص۔ ۴ دیکھیں۔"]),
        ("ur", ["اوسط ۸۔۷ رہا۔", "۱۔ قلم لائیں۔"]),
        ("zh", ["他停了一下……然后念。", "“最后一课吗？”他问道。", "好！"]),
        ("th", ["ขอบคุณทุกคน", "มีผู้ฟัง 6 คนพอดี", "คะแนนคือ 2.8 คะแนน"]),
        ("hi", ["आज हम बात करेंगे।", "क्या यह ठीक है?"]),
        ("tr", ["Kalem vb. şeyler 6. günde geldi.", "Bitti."]),
    ],
)
def test_known_sentences(lang, parts):
    joined = ("" if lang == "zh" else " ").join(parts)
    assert [joined[a:b] for a, b in S.split(joined, lang, MODEL)] == parts
    lines = "\n".join(parts)
    assert [lines[a:b] for a, b in S.split(lines, lang, MODEL)] == parts


def test_edges():
    assert S.split("", "en", MODEL) == S.split(" \t\n", "en", MODEL) == []
    assert S.split("no mark", "en", MODEL) == [(0, 7)]
    assert S.split("  a.  ", "", MODEL) == [(2, 4)]
    assert S.split("One​ two.​ Three.", "en", MODEL) == [(0, 10), (11, 17)]
    long = "word " * 50_000 + "end. Next one."
    assert len(S.split(long, "en", MODEL)) == 2
    for t in ("«open", ")(", '"""', "...", "。。", "a\r\nb", "١.", "﻿"):
        spans = S.split(t, "en", MODEL)
        assert all(0 <= a < b <= len(t) for a, b in spans)


def test_spans_hold_all_text():
    import random

    rng = random.Random(5)
    alphabet = "ab A.!?۔ \n«»()\"“”1۱。…ก​"
    for _ in range(3000):
        t = "".join(rng.choice(alphabet) for _ in range(rng.randrange(30)))
        spans = S.split(t, "en", MODEL)
        at = 0
        for a, b in spans:
            assert at <= a < b and not t[at:a].replace("\u200b", "").strip() and not t[a].isspace()
            at = b
        assert not t[at:].replace("​", "").strip()


def test_learned_abbreviations(spark):
    ends = ["They left early.", "We came today.", "It hangs on the wall."]
    rows = [(i, f"Dr. Name{i % 7} saw fig. {i} there. {ends[i % 3]} {ends[(i + i // 3) % 3]}", "en") for i in range(90)]
    m = S.train(spark.createDataFrame(rows, "k long, t string, lang string"), "t", "lang")
    assert {"dr", "fig"} <= m.abbreviations["en"] and not {"today", "wall", "early"} & m.abbreviations["en"]


def test_operator(spark, matrix):
    rows = [(1, "Here we are. Now we go.", "v2"), (1, "Here we are. Now we go.", "v2"), (2, None, "v2"), (3, "", "v2"), (4, " ", "v2")]
    tagged = S.with_language(spark.createDataFrame(rows, "k long, text string, lang string"), "k", "text", matrix)
    got = S.sentences(tagged, "k", S.train(tagged, "_text", "lang")).collect()
    assert [(r.k, r.sentence_no, r.start_pos, r.end_pos) for r in sorted(got)] == [(1, 0, 0, 12), (1, 1, 13, 23)]
    empty = spark.createDataFrame([], "k long, text string")
    tagged = S.with_language(empty, "k", "text", matrix)
    assert S.sentences(tagged, "k", S.train(tagged, "_text", "lang")).count() == 0


def test_learned_abbreviation_of_six_letters(spark):
    ends = ["They left early.", "We came today.", "It hangs on the wall."]
    rows = [(i, f"Name{i % 7} read approx. {i} pages. {ends[i % 3]} {ends[(i + i // 3) % 3]}", "en") for i in range(90)]
    m = S.train(spark.createDataFrame(rows, "k long, t string, lang string"), "t", "lang")
    assert "approx" in m.abbreviations["en"] and "today" not in m.abbreviations["en"]
    assert len(S.split("He read approx. 40 words. We ended.", "en", m)) == 2


def test_only_the_collocation_decides(spark):
    """A number before a title stays in the sentence only where the two are learned to belong together."""
    rng = __import__("random").Random(3)
    starts, ends = ["Sonra", "Herkes", "Biz", "Bugün", "Hoca"], ["geldi", "bitti", "gitti", "durdu"]
    plain = lambda m: f"{rng.choice(starts)} {rng.choice(['eve', 'okula'])} {rng.choice(ends)}{m}"
    rows = [(i, " ".join([plain("!"), plain("!"), f"{rng.choice(starts)} bize {i}. Bölüm yetti.", plain("!"), f"{rng.choice(starts)} sayı {i}.", plain("?")]), "tr") for i in range(200)]
    m = S.train(spark.createDataFrame(rows, "k long, t string, lang string"), "t", "lang")
    assert m.collocations["tr"] == {"##" + S.PAIR + "bölüm"}
    text = "Dün bize 7. Bölüm yetti. Biz sayı 8. Sonra durdu."
    assert [text[a:b] for a, b in S.split(text, "tr", m)] == ["Dün bize 7. Bölüm yetti.", "Biz sayı 8.", "Sonra durdu."]
    m.collocations["tr"] = frozenset()
    m._of.clear()
    assert len(S.split(text, "tr", m)) == 4


def test_long_quotation_is_one_sentence(spark):
    for n in (3, 80, 4_000):
        text = 'They called it a"' + "very long quotation. " * n + 'indeed" and left. Then they came.'
        assert len(S.split(text, "en", MODEL)) == 2


def test_dotted_types_are_learned(spark):
    rows = [(i, f"They came at {i % 9} p.m. and left. He said i.e. that. See notes.example here.", "en") for i in range(60)]
    m = S.train(spark.createDataFrame(rows, "k long, t string, lang string"), "t", "lang")
    assert {"p.m", "i.e"} <= m.abbreviations["en"] and "notes.example" not in m.abbreviations["en"]


def test_ratios():
    from math import log

    import numpy as np

    def plain(k, n, j, m):
        """Twice the gain in log likelihood of two rates over one."""
        ll = lambda k, n, p: k * log(p) + (n - k) * log(1 - p)
        return 2 * (ll(k, n, k / n) + ll(j, m, j / m) - ll(k, n, (k + j) / (n + m)) - ll(j, m, (k + j) / (n + m)))

    got = S._ratio(*(np.array(x, float) for x in ([10, 1, 0], [20, 100, 0], [5, 50, 1], [100, 100, 2])))
    assert abs(got[0] - plain(10, 20, 5, 100)) < 1e-9 and got[1] < -50 and got[2] == 0
