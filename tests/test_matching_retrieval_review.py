import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import matching, retrieval
from tessera.operators import review
from tessera.operators.review import Session, fold


def test_matching_decisions(spark):
    top = spark.createDataFrame([("a", "k1", 0.9, 1), ("a", "k2", 0.7, 2), ("b", "k1", 0.6, 1), ("b", "k3", 0.595, 2), ("c", "k1", 0.2, 1), ("d", "k9", 0.8, 1)], "c string, key string, x double, rank int")
    got = {r.c: (r.best_key, r.margin, r.verdict) for r in matching.decisions(top, "key", "x", 0.5, 0.02, ("c",)).collect()}
    assert got == {"a": ("k1", pytest.approx(0.2), "verified"), "b": ("k1", pytest.approx(0.005), "ambiguous"), "c": ("k1", None, "unresolved"), "d": ("k9", None, "verified")}


def test_score_matrix_has_every_pair(spark):
    c = spark.createDataFrame([("k", "one word"), ("k", "none"), ("q", "x")], "kind string, text string")
    corpus = spark.createDataFrame([("k", "a", "one word"), ("k", "b", "else"), ("q", "c", "x y")], "kind string, key string, t string")
    got = {(r.text, r.key): r.lexical for r in matching.score_matrix(c, corpus, "kind", "text", "kind", "key", "t").collect()}
    assert set(got) == {("one word", "a"), ("one word", "b"), ("none", "a"), ("none", "b"), ("x", "c")} and got["one word", "a"] == 1.0


def test_best_matches_against_the_whole_product(spark):
    from tessera.functions import text as T
    from tessera.operators.ports import hashed_embedding

    corpus = spark.createDataFrame([("ayah", "k1", "النهر طويل جدا هنا"), ("ayah", "k2", "النهر طويل جدا هناك"), ("ayah", "k3", "باب"), ("ayah", "k4", None), ("dua", "d1", "باب الدار"), ("dua", "d2", "نور نور")], "kind string, key string, t string")
    cand = spark.createDataFrame([("ayah", "النَّهرُ طويلٌ جدا هنا"), ("ayah", "بابا"), ("dua", "بابا"), ("dua", "نور نور نور"), ("dua", " "), ("ayah", None), ("ayah", "بابا")], "etype string, text string")
    got = {(r.etype, r.text, r.alpha, r.key): (r.rank, r.score) for r in matching.best_matches(cand, corpus, "etype", "text", "kind", "key", "t", alphas=[0.0, 0.7, 1.0]).collect()}
    pairs = cand.distinct().where("trim(text) <> ''").join(corpus.where("t is not null"), F.col("etype") == F.col("kind")).withColumn("n", T.for_matching(F.col("text"))).withColumn("m", T.for_matching(F.col("t")))
    n, m = F.col("n"), F.col("m")
    lexical = {(r.etype, r.text, r.key): (r.x, r.t) for r in pairs.select("etype", "text", "key", "t", ((T.edit_score(n, m) + T.token_f1(T.words(n), T.words(m))) / 2).alias("x")).collect()}
    assert len(lexical) == 3 + 3 + 2 + 2
    for alpha in (0.0, 0.7, 1.0):
        want = {}
        for (kind, text, key), (x, t) in lexical.items():
            a, b = hashed_embedding([text, t]).astype(float)
            want.setdefault((kind, text), []).append((-round(alpha * x + (1 - alpha) * float(a @ b), 6), key))
        for (kind, text), rows in want.items():
            for rank, (s, key) in enumerate(sorted(rows), 1):
                assert got[kind, text, alpha, key] == (rank, pytest.approx(-s, abs=2e-6))
    assert len(got) == 3 * len(lexical)


def test_every_verse_and_dua_is_grounded(spark, data):
    from tessera.plans.scalars import QUERIES

    cited = spark.read.parquet(f"{data}/entities.parquet").where("etype in ('ayah', 'dua')")
    got = QUERIES["ground_candidates"](spark, data).collect()
    assert sorted(r.entity_id for r in got) == sorted(r[0] for r in cited.select("entity_id").distinct().collect())
    kinds = {r.entity_id: r.etype for r in cited.collect()}
    assert all(r.best_key.startswith("D" if kinds[r.entity_id] == "dua" else "CH") for r in got if r.best_key)
    assert all(r.best_key for r in got if r.entity_id in {x.entity_id for x in cited.where("trim(text) <> ''").collect()})


def test_semantic_score_and_weight_of_the_sweep(spark, data):
    from tessera.plans.scalars import ALPHA, QUERIES

    rows = QUERIES["match_top5"](spark, data).collect()
    assert any(r.semantic != r.lexical for r in rows) and all(r.score == pytest.approx(ALPHA * r.lexical + (1 - ALPHA) * r.semantic, abs=3e-6) for r in rows)
    best = spark.createDataFrame([(0.2, "a", 0.9, 0.5, "a"), (0.8, "b", 0.9, 0.5, "a")], "alpha double, best_key string, best_score double, margin double, gold_key string")
    assert {r.alpha: (r.correct, r.wrong) for r in matching.grid(best, [0.5], [0.0], ("alpha",)).collect()} == {0.2: (1, 0), 0.8: (0, 1)}
    sweep = QUERIES["threshold_sweep"](spark, data).collect()
    quoted = spark.read.parquet(f"{data}/entities.parquet").where("etype in ('ayah', 'dua') and lower(trim(usage)) = 'quotation'").dropDuplicates(["entity_id"])
    gold = quoted.where("etype = 'dua' and reference is not null or try_cast(surah_number as int) is not null and try_cast(ayah_number as int) is not null").count()
    assert len(sweep) == 30 and {r.positives for r in sweep if r.scope == "quotation"} == {gold} and {r.alpha for r in sweep} <= {x / 10 for x in range(11)}
    assert all(r.missed + r.correct + r.wrong >= r.positives and r.rejected <= r.negatives for r in sweep)


def test_corpus_in_blocks(spark, monkeypatch):
    c = spark.createDataFrame([("k", f"t{i} word{i % 7} and more{i % 5}") for i in range(30)], "kind string, text string")
    corpus = spark.createDataFrame([("k", f"c{i:02d}", f"word{i % 7} and more{i % 4} t{i}") for i in range(40)], "kind string, key string, ctext string")
    run = lambda: sorted(map(tuple, matching.best_matches(c, corpus, "kind", "text", "kind", "key", "ctext", alphas=[0.3, 1.0], top=4).collect()))
    whole = run()
    monkeypatch.setattr(matching, "CORPUS_BLOCK", 7)
    assert run() == whole and len(whole) == 30 * 2 * 4


def test_verdicts_and_grid(spark):
    df = spark.createDataFrame([(0.9, 0.01), (0.9, None), (0.4, 0.3), (None, None)], "b double, m double")
    assert [r[0] for r in df.select(matching.verdict(F.col("b"), F.col("m"), 0.5, 0.02)).collect()] == ["ambiguous", "verified", "unresolved", "unresolved"]
    best = spark.createDataFrame([("a", 0.9, 0.5, "a"), ("b", 0.8, 0.5, "c"), ("d", 0.3, None, "d"), ("e", 0.9, 0.2, None)], "best_key string, best_score double, margin double, gold_key string")
    r = matching.grid(best, [0.5], [0.0]).first()
    assert (r.correct, r.wrong, r.positives, r.missed, r.negatives, r.rejected) == (1, 2, 3, 1, 1, 0) and r.f1 == pytest.approx(1 / 3, abs=1e-6)


def test_knn_against_brute_force(spark):
    rng = np.random.default_rng(0)
    v = rng.integers(-2, 3, (120, 4)).astype("float32")
    df = spark.createDataFrame([(i, [float(x) for x in r], 1) for i, r in enumerate(v)] + [(500, None, 1), (501, [1.0], 1)], "vec_id long, e array<float>, score int").repartition(5)
    old, retrieval.QUERY_BLOCK, retrieval.VECTOR_BLOCK = retrieval.QUERY_BLOCK, 4, 50
    try:
        got = retrieval.knn(df.where("vec_id % 20 = 0 and vec_id < 200"), df, "vec_id", "e", 7).collect()
    finally:
        retrieval.QUERY_BLOCK, retrieval.VECTOR_BLOCK = old, 50_000
    s = v.astype(float) @ v.astype(float).T
    for q in range(0, 120, 20):
        want = sorted(((-s[q, j], j) for j in range(120) if j != q))[:7]
        assert [(r.neighbour_id, r.score) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == [(j, -x) for x, j in want]
    assert retrieval.knn(df.limit(0), df, "vec_id", "e", 3).count() == 0


def opened():
    return Session([{"id": "a", "start": 0.0, "end": 10.0, "text": "abcde fghi"}, {"id": "b", "start": 10.0, "end": 12.0, "text": "x"}], [{"type": "dua", "start": 1.0}, {"type": "topics", "start": 0.0, "end": 1.0}])


def test_session_segments():
    s = opened()
    s.apply({"op": "seg.accept", "uid": "s0"})
    s.apply({"op": "seg.accept", "uid": "s0"})  # nothing more happens
    for bad in ({"op": "seg.accept", "uid": "q"}, {"op": "nothing"}, {}, {"op": "seg.split", "uid": "s0", "at": 10}, {"op": "seg.merge", "uids": ["s0"]}, {"op": "seg.merge", "uids": ["s0", "s0"]}, {"op": "seg.accept", "uid": "s1", "role": "guest"}):
        with pytest.raises(ValueError):
            s.apply(bad)
    first, second = s.apply({"op": "seg.split", "uid": "s0", "at": 5})
    assert [(x["data"]["end"], x["data"]["text"], x["data"].get("id")) for x in s.segments[:2]] == [(5.0, "abcde", "a"), (10.0, "fghi", None)] and first == "s0"
    s.apply({"op": "seg.merge", "uids": [second, first]})  # in any order
    assert len(s.segments) == 2 and s.segments[0]["data"] == {"id": "a", "start": 0.0, "end": 10.0, "text": "abcde fghi"}
    (new,) = s.apply({"op": "seg.insert", "start": 1, "end": 2, "text": "n"})
    s.apply({"op": "seg.edit", "uid": new, "text": "m"})
    assert s.segments[0]["status"] == "inserted" and s.segments[0]["data"] == {"start": 1.0, "end": 2.0, "text": "m"}
    s.apply({"op": "seg.edit", "uid": "s1", "data": {"start": 3.0, "end": 2.0, "text": "y"}})
    assert s.segments[-1]["data"] == {"start": 3.0, "end": 2.0, "text": "y"}
    s.apply({"op": "seg.merge", "uids": ["s0", "s1"]})
    assert s.segments[1]["data"]["end"] == 2.0  # that of the last
    s.apply({"op": "seg.split", "uid": "s0", "parts": [{"start": 0.0, "end": 1.0, "text": str(i)} for i in range(3)]})
    assert [x["data"]["text"] for x in s.segments] == ["m", "0", "1", "2"]


def test_session_entities():
    s = opened()
    for bad in ({"op": "ent.retype", "uid": "e0", "type": "poem"}, {"op": "ent.scope", "uid": "e0", "scope": "lecture"}, {"op": "ent.add", "type": "poem", "fields": {}}):
        with pytest.raises(ValueError):
            s.apply(bad)
    s.apply({"op": "ent.accept", "uid": "e0", "position": 4})
    orders = [s.entities[-1]["order"] for start in (0.5, 2.0, 1.5, None) if s.apply({"op": "ent.add", "type": "dua", "fields": {"start": start}})]
    assert orders == [3.5, 5.0, 4.5, 3.0]
    assert Session().apply({"op": "ent.add", "type": "dua", "fields": {}}) and review.place_among([], 3.0) == 1.0
    added = s.entities[-1]["uid"]
    for op in ({"op": "ent.edit", "fields": {"text": "t"}}, {"op": "ent.retype", "type": "hadith"}):
        s.apply(op | {"uid": added})
        assert s.entities[-1]["status"] == "added"
    s.apply({"op": "ent.edit", "uid": "e0", "fields": {"text": "t"}, "replace": True})
    assert s.entities[0]["status"] == "edited" and s.entities[0]["fields"] == {"text": "t"}
    s.apply({"op": "ent.scope", "uid": "e1", "scope": "lecture"})
    assert s.entities[1]["fields"] == {"start": 0.0, "end": 12.0}
    s.apply({"op": "ent.reject", "uid": "e0"})
    assert {"text": "t"} not in s.outputs()[1]["dua"] and len(s.outputs()[1]["hadith"]) == 1


def test_session_flags_and_end():
    s = opened()
    for bad in ({"op": "flag.add", "target": "q", "issue": "missing text"}, {"op": "flag.add", "target": "s1", "issue": "odd"}):
        with pytest.raises(ValueError):
            s.apply(bad)
    (flag,) = s.apply({"op": "flag.add", "target": {"kind": "segment", "uid": "s1"}, "issue": "missing text"})
    s.apply({"op": "flag.escalate", "uid": flag})
    for bad in ({"op": "flag.resolve", "uid": flag}, {"op": "flag.escalate", "uid": flag}, {"op": "finalize"}):
        with pytest.raises(ValueError):
            s.apply(bad)
    s.apply({"op": "flag.resolve", "uid": flag, "role": "super"})
    with pytest.raises(ValueError):
        s.apply({"op": "flag.resolve", "uid": flag, "role": "super"})
    (other,) = s.apply({"op": "flag.add", "target": "s1", "issue": "missing text"})
    s.apply({"op": "seg.delete", "uid": "s1"})
    assert s.flags[1]["status"] == "resolved" and other == s.flags[1]["uid"]
    with pytest.raises(ValueError):
        s.apply({"op": "finalize"})  # the dua has no text, reference, usage
    s.apply({"op": "ent.reject", "uid": "e0"})
    s.apply({"op": "finalize"})
    with pytest.raises(ValueError):
        s.apply({"op": "ent.accept", "uid": "e0"})
    s.apply({"op": "reopen"})
    s.apply({"op": "ent.accept", "uid": "e1"})


def test_violations():
    ok = {"id": 1, "start": 0, "end": 1, "text": "t"}
    dua = {"reference": "1", "text": "t", "start": 0, "end": 1, "usage": " Explicit Paraphrase", "extent": "partial"}
    assert review.violations([ok], {"dua": [dua], "headings": []}) == [] and review.violations([], {}) == ["no segments"]
    assert len(review.violations([ok, ok | {"text": None}], {"dua": [dua | {"usage": "x", "extent": None}]})) == 4


def test_fold(spark):
    acts = [{"op": "open", "segments": [{"id": "a", "start": 0, "end": 1, "text": "t"}]}, {"op": "seg.accept", "uid": "s0"}, {"op": "seg.accept", "uid": "q"}, {"op": "finalize"}]
    rows = [("x", i, json.dumps(a)) for i, a in enumerate(acts)] + [("y", 0, "no json"), ("y", 1, None), ("y", 2, "[]"), (None, 1, "{}")]
    log = spark.createDataFrame(rows, "session string, n int, action string")
    got = {r.session: r for r in fold(log).collect()}
    assert (got["x"].applied, got["x"].refused, got["x"].finalized) == (3, 1, True) and (got["y"].applied, got["y"].refused) == (0, 3) and len(got) == 2
    assert [(r.session, r.uid, r.status, r.text) for r in review.folded_segments(log).collect()] == [("x", "s0", "accepted", "t")]
