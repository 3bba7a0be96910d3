import difflib
import random

import numpy as np
import pyarrow as pa
import pytest

from tessera.functions import likeness
from tessera.operators import topics

RATIO = lambda a, b: difflib.SequenceMatcher(None, a.lower(), b.lower()).ratio()


def names(n, seed=2):
    """Of one to some 230 letters, of two scripts, many of them alike."""
    rng = random.Random(seed)
    made = ["", "A", "İx", "\U0001f600 b", "ab" * 105, "ab" * 104 + "c", "the river " * 13]
    stems = ["the lesson of the ", "a long talk about some ", "سبق میں ", "x" * 60, "the notes that the hall took of the old chronicle and of "]
    while len(made) < n:
        made.append(rng.choice(stems) + "".join(rng.choice("abcdе تک ") for _ in range(rng.choice([0, 3, 9, 30, 70, 150]))))
    return made


def test_matching_is_that_of_difflib():
    t = [x.lower() for x in names(90)]
    flat, starts = likeness.coded(t)
    a, b = (x.ravel() for x in np.meshgrid(np.arange(len(t)), [i for i, x in enumerate(t) if len(x) < likeness.JUNK]))
    want = [sum(m.size for m in difflib.SequenceMatcher(None, t[i], t[j]).get_matching_blocks()) for i, j in zip(a, b)]
    assert likeness.matching(flat, starts, a, b).tolist() == want


def test_candidates_are_those_of_the_longest_common_subsequence():
    t = [x.lower() for x in names(60)]
    flat, starts = likeness.coded(t)

    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for c in a:
            last = 0
            for j, x in enumerate(b, 1):
                last, row[j] = row[j], last + 1 if c == x else max(row[j], row[j - 1])
        return row[-1]

    enough = {(i, j) for i, a in enumerate(t) for j, b in enumerate(t) if 2 * lcs(a, b) >= 0.599 * (len(a) + len(b))}
    every, some = np.arange(len(t)), np.arange(20, 40)
    pairs = lambda ids, texts: {(int(i), k) for x, k in likeness.candidates(flat, starts, ids, texts, 0.599) for i in x}
    assert pairs(every, every) == {(i, j) for i, j in enough if i < j}
    assert pairs(some, every[:20]) == {(i, j) for i, j in enough if i in some and j < 20}
    assert pairs(every[:0], every) == pairs(every, every[:0]) == set()


def test_no_pair_of_names_goes_to_difflib_unless_long(monkeypatch):
    """A call for each pair took 249 CPU seconds for 4,317 topics."""
    t = [x for x in names(40) if 0 < len(x.lower()) < likeness.JUNK]
    table = pa.table({"slug": [f"s{i:02d}" for i in range(len(t))], "name": t, "_l": [x.lower() for x in t], "_one": [True] * len(t), "_pair": [False] * len(t)})
    want = {(i, j): round(r, 3) for i, a in enumerate(t) for j, b in enumerate(t) if i < j and a.lower() != b.lower() and (r := RATIO(a, b)) >= 0.6}
    monkeypatch.setattr(difflib, "SequenceMatcher", None)
    got = {(int(i), int(j)): s for x in topics._alike(table, 0.6) for i, j, s in zip(*x)}
    assert got == pytest.approx(want, abs=0.0011) and got.keys() == want.keys() and got


@pytest.mark.parametrize("small", [250, 7])
def test_merge_proposals_by_blocks(spark, monkeypatch, small):
    monkeypatch.setattr(topics, "SMALL_BLOCK", small)
    t = names(60)
    series = [[[], ["S"], ["T", "S"], ["T", None], None][i % 5] for i in range(len(t))]
    df = spark.createDataFrame([(f"s{i * 37 % 61:02d}", n, g) for i, (n, g) in enumerate(zip(t, series))] + [(None, "the river", ["S"]), ("nameless", None, ["S"])], "slug string, name string, series array<string>")
    rows = sorted((f"s{i * 37 % 61:02d}", n, {x for x in g or () if x}) for i, (n, g) in enumerate(zip(t, series)) if n)
    want = {(a, b): (RATIO(x, y), bool(g & h)) for a, x, g in rows for b, y, h in rows if a < b and x.lower() != y.lower() and RATIO(x, y) >= 0.5995}
    got = {(r.a, r.b): (r.similarity, r.shared) for r in topics.merge_proposals(df, groups="series").collect()}
    assert got.keys() == want.keys() and {s for _, s in got.values()} == {True, False}
    assert all(abs(got[k][0] - want[k][0]) <= 0.00051 and got[k][1] == want[k][1] for k in want)


@pytest.mark.parametrize("small", [250, 7])
def test_alike_is_the_dictionary_of_the_proposals(spark, monkeypatch, small):
    monkeypatch.setattr(topics, "SMALL_BLOCK", small)
    df = spark.createDataFrame([(f"s{i * 37 % 61:02d}", n) for i, n in enumerate(names(60))] + [(None, "the river"), ("nameless", None)], "slug string, name string")
    got = sorted(map(repr, topics.alike(df).collect()))
    assert got == sorted(map(repr, topics.dictionary(df, topics.merge_proposals(df)).collect())) and any("; " in x for x in got)
    assert topics.alike(df.limit(0)).count() == 0


def test_dictionary_of_the_topics_makes_the_pairs_once(spark, data):
    """The proposals were made twice, and their names shuffled with every pair."""
    from tessera.plans import queries

    plan = queries.QUERIES["topic_dictionary"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow pairs") == 1 and "Join" not in plan
