import random

from tessera.llm import sentences as S
from tessera.llm import splitting as X

NONE = S.Model()


def test_pieces_cover_and_overlap():
    rng = random.Random(3)
    for _ in range(400):
        n = rng.choice([5, 401, 900, 3000])
        t = "".join(rng.choice("abc   .") if rng.random() < 0.97 else "x" * rng.choice([3, 90, 450]) for _ in range(n))
        spans = S.split(t, "en", NONE)
        got = X.pieces(t, spans)
        assert got[0][0] == 0 and got[-1][1] == len(t)
        assert all(0 < e - s <= 400 for s, e, *_ in got) or len(t) == 0
        assert all(b[0] == a[1] - 40 for a, b in zip(got, got[1:]))


def test_cuts_at_sentences_where_possible():
    t = ("A short sentence about nothing at all. " * 40).strip()
    got = X.pieces(t, S.split(t, "en", NONE))
    assert {k for _, _, k, *_ in got} == {"sentence", "end"} and all(t[e - 2] == "." for _, e, k, *_ in got if k == "sentence")


def test_deepest_valley():
    a, b = "The market sells fish and bread today. ", "Stars and moons shine over hills. "
    t = a * 6 + b * 12
    first = X.pieces(t, S.split(t, "en", NONE))[0]
    assert first[1] == len(a * 6)


def whole_kind(text, spans, limit=400):
    """Where a text can be cut, by its sentences and runs themselves."""
    if all(e - s <= limit for s, e in spans):
        return "sentence"
    return "space" if all(len(run) <= limit for run in text.split()) else "inside"


def piece_kind(text, spans):
    got = X.pieces(text, spans)
    return "sentence" if max(g[3] for g in got) <= 400 else "space" if max(g[4] for g in got) <= 400 else "inside"


def test_kinds():
    kind = lambda t: piece_kind(t, S.split(t, "en", NONE))
    assert kind("One. " * 200) == "sentence"
    assert kind("word " * 200) == "space"
    assert kind("x" * 401 + " a") == "inside"
    assert kind("ab\u200b" * 200) == "inside"
    assert kind("ab\u00a0" * 200) == "space"
    assert kind("Y" * 390 + ". " + "Y" * 398 + ".") == "sentence"


def test_pieces_tell_the_kind_of_the_text():
    rng = random.Random(8)
    seen = set()
    for _ in range(1500):
        part = lambda: rng.choice(["Word", "x" * rng.choice([1, 30, 355, 395, 400, 401, 800])]) + rng.choice([" ", ". ", ".", "\n", " ", ""])
        t = "".join(part() for _ in range(rng.randrange(1, 40)))
        if len(t) > 400:
            spans = S.split(t, "en", NONE)
            assert piece_kind(t, spans) == whole_kind(t, spans)
            seen.add(whole_kind(t, spans))
    assert seen == {"sentence", "space", "inside"}


def test_depths_are_those_of_the_slopes():
    rng = random.Random(2)
    parts = [" ".join(rng.choice("abcdef") for _ in range(4)) for _ in range(60)]
    bags = [X._words(p) for p in parts]
    curve = []
    for i in range(1, len(bags)):
        left, right = sum(bags[max(0, i - 2) : i], X.Counter()), sum(bags[i : i + 2], X.Counter())
        curve.append(sum(n * right[w] for w, n in left.items()) / X.math.sqrt(sum(n * n for n in left.values()) * sum(n * n for n in right.values())))
    for i, d in enumerate(X.depths(parts)):
        a = b = i
        while a > 0 and curve[a - 1] >= curve[a]:
            a -= 1
        while b + 1 < len(curve) and curve[b + 1] >= curve[b]:
            b += 1
        assert abs(d - (curve[a] + curve[b] - 2 * curve[i])) < 1e-12


def test_operator(spark, documents):
    long = "We read the next page of the lesson. " * 20
    rows = [(1, long, 10.0, 20.0), (1, long, 10.0, 20.0), (2, "short", 0.0, 1.0), (3, None, 0.0, 1.0), (4, long, None, None), (5, long, 9.0, 3.0), (6, "y" * 500, float("nan"), 4.0), (7, "x" * 400, 0.0, 1.0)]
    df = spark.createDataFrame(rows, "k long, text string, s double, e double").selectExpr("*", "'q' AS cut", "1 AS lang")
    got = X.split_oversized(df, "k", "text", "s", "e", documents).collect()
    assert {r.k for r in got} == {1, 4, 5, 6}
    by = {k: sorted((r for r in got if r.k == k), key=lambda r: r.piece_no) for k in (1, 4, 5, 6)}
    assert [r.piece_no for r in by[1]] == list(range(len(by[1]))) and all(10 <= r.start_at < 20 for r in by[1])
    assert {r.start_at for r in by[4]} == {None} and {r.start_at for r in by[5]} == {9.0} and {r.start_at for r in by[6]} == {4.0}
    assert {r.k: r.cut for r in X.text_cuts(spark.createDataFrame(got), "k").collect()} == {1: "sentence", 4: "sentence", 5: "sentence", 6: "inside"}
    assert "".join(r.piece[0 if i == 0 else 40 :] for i, r in enumerate(by[1])) == long
    assert X.split_oversized(df.limit(0), "k", "text", "s", "e", documents).count() == 0
