import random

from tessera.llm import subjects as S

TOPICS = {"sport": ["football league", "archery practice", "horse racing"], "law": ["contract clause", "witness testimony", "legal capacity"], "science": ["moon sighting", "tide tables", "star charts"]}
FILL = ["We will return after the break.", "Thank you for waiting.", "Dr. Selvane came late."]


def make(rng, parts):
    out = []
    for s, n in parts:
        for _ in range(n):
            out.append(rng.choice([f"The speaker explained {rng.choice(TOPICS[s])} again.", f"Remember that {rng.choice(TOPICS[s])} asks for patience."]))
    out += [rng.choice(FILL) for _ in range(4)]
    rng.shuffle(out)
    return " ".join(out)


def test_subjects_of_documents(spark):
    rng = random.Random(4)
    plans = [[(rng.choice(list(TOPICS)), 8)] for _ in range(150)] + [[(a, 5), (b, 5)] for a, b in (rng.sample(list(TOPICS), 2) for _ in range(60))] + [[(a, 9), (b, 1)] for a, b in (rng.sample(list(TOPICS), 2) for _ in range(40))]
    docs = [(i, make(rng, p), "en") for i, p in enumerate(plans)] + [(900, None, "en"), (901, "", None), (902, " ", "en"), (903, "Thank you for waiting.", "en")]
    labels = [(i, rng.choice(list(TOPICS)) if rng.random() < 0.1 else p[0][0], "x") for i, p in enumerate(plans) if i % 3 == 0]
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string").selectExpr("*", "1 AS subject")
    lab = spark.createDataFrame(labels + labels[:4] + [(900, None, "x")], "doc_id long, subject string, annotator string").selectExpr("*", "'a' AS text")
    got = {(r.doc_id, r.subject) for r in S.found_subjects(d, lab).collect()}
    want = {(i, s) for i, p in enumerate(plans) for s, n in p if n >= 0.25 * sum(m for _, m in p)}
    assert len(got & want) >= 0.98 * len(want) and len(got - want) <= 0.02 * len(want)
    assert not [x for x in got if x[0] >= 900]


def test_empty_tables(spark):
    d = spark.createDataFrame([], "doc_id long, text string, lang string")
    lab = spark.createDataFrame([], "doc_id long, subject string, annotator string")
    assert S.found_subjects(d, lab).count() == 0
    one = spark.createDataFrame([(1, "We read the lesson.", "en")], "doc_id long, text string, lang string")
    assert S.found_subjects(one, lab).count() == 0


def test_longer_rules_win_and_all_words_count():
    r = S.Rules(by_words={(0,): {"x": 0.9}, (0, 1): {"y": 0.95}}, telling={"en": {"a": 0, "b": 1}})
    assert r.known(["b", "c", "a"], "en") == (0, 1) and r.known(["a"], None) == ()
    assert r.evidence((0,))[0] == "x" and r.evidence((0, 1))[0] == "y" and r.evidence((5,)) == (None, 0.0)
    many = S.Rules(by_words={(29,): {"law": 0.9}}, telling={"": {f"w{i:02d}": i for i in range(30)}})
    assert many.evidence(many.known([f"w{i:02d}" for i in range(30)], ""))[0] == "law"


def test_growth_against_brute_force(spark):
    """Every rule that is not redundant is found, however many telling words a sentence has."""
    from collections import Counter
    from itertools import combinations

    rng = random.Random(6)
    sents = [(tuple(sorted(rng.sample(range(9), rng.randrange(1, 8)))), rng.choice("ab")) for _ in range(150)]
    sents += [(tuple(range(9)), "a")] * 6 + [((0, 4, 8), "b")] * 30 + [((7,), "b")] * 40
    n, whole = Counter(), Counter()
    for got, c in sents:
        for k in range(1, len(got) + 1):
            for x in combinations(got, k):
                n[x, c] += 1
                whole[x] += 1
    least = 4
    raw: dict = {}
    for (x, c), k in n.items():
        if k >= least and k >= S.MIN_CONFIDENCE * whole[x]:
            raw.setdefault(x, {})[c] = S._confidence(k, whole[x])
    want = {a: {c: p for c, p in by.items() if all(raw.get(x, {}).get(c, 0) < p - S.GAIN for k in range(1, len(a)) for x in combinations(a, k))} for a, by in raw.items()}
    want = {a: by for a, by in want.items() if by}
    rows = [(got[j], list(got[:j]), c) for got, c in sents for j in range(len(got))]
    parts = spark.createDataFrame(rows, "item int, before array<int>, subject string").groupBy("item", "before", "subject").count().withColumnRenamed("count", "n")
    found: dict = {}
    for r in S.patterns(parts, least).collect():
        assert (n[tuple(r.words), r.subject], whole[tuple(r.words)]) == (r.n, r["all"])
        found.setdefault(tuple(r.words), {})[r.subject] = S._confidence(r.n, r["all"])
    assert S.pruned(found) == want and max(map(len, want)) > 2


def test_sentence_of_thirty_telling_words(spark):
    words = [f"telling{'abcdefghij'[i % 10] * (1 + i // 10)}" for i in range(30)]
    docs = [(i, (" ".join(words) if i % 2 else "Other words entirely. " + words[i % 30] + " here") + ". ", "en") for i in range(60)]
    labels = [(i, "law" if i % 2 else "art", "x") for i in range(60)]
    got = S.found_subjects(spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, subject string, annotator string"))
    assert {r.doc_id for r in got.where("subject = 'law'").collect()} >= {i for i in range(60) if i % 2}


def test_bounded_sample(spark):
    docs = spark.createDataFrame([(i, "x", "en" if i % 10 else None) for i in range(5_000)], "doc_id long, text string, lang string")
    n = {r.lang: r["count"] for r in S.fitted_on(docs, 400).groupBy("lang").count().collect()}
    assert 300 < n["en"] < 500 and 300 < n[None] < 500
    assert S.fitted_on(docs, 10_000).count() == 5_000


def test_cut_up():
    assert [sorted(x) for x in S.sentences_of(S.cut_up("The cat, the 12 cats! 我们上课。好\nEnd"))] == [["cat", "cats", "the"], ["上课", "们上", "我们"], ["end"]]
    assert S.cut_up("") == S.cut_up("1 2. 3") == ""
