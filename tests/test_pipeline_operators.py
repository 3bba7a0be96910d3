import json
import random

import numpy as np
from pyspark.sql import functions as F

from tessera.operators import ports, replacement, replay, topics
from tessera.operators.review import Session


def test_replace_once():
    r = replacement.replace_once
    assert r("قال: الكتاب الكبير، ثم", "الْكِتَابُ الْكَبِيرُ", "X") == "قال: X، ثم"
    assert r("قال الْكِتَابُ ثم", "الكتاب", "X") == "قال X ثم"
    assert r("abc", "d", "X") is None and r("abc", "", "X") is None and r("", "a", "X") is None and r("abc", "!", "X") is None
    form, at = replacement.with_places("  أَب،  c ")
    assert form == "اب c" and len(at) == len(form)


def test_replace_quotations(spark):
    s = spark.createDataFrame([("r", 0, "no"), ("r", 1, "one two three four"), ("r", 2, "one two"), ("q", 0, "one two"), ("q", 1, None)], "recording string, seq int, text string")
    q = spark.createDataFrame([("r", 1, "two, three", "2 3"), ("r", 2, "one", "1"), ("r", 3, "absent", "0"), ("q", 4, "one two", None), ("r", 5, None, "n")], "recording string, n long, fragment string, canonical string")
    assert [tuple(r) for r in replacement.replace_quotations(s, q).collect()] == [("r", 1, "1 2 3 four", 2)]
    assert replacement.replace_quotations(s, q.limit(0)).count() == 0


def test_quotations_inside_words(spark):
    rng = random.Random(8)
    text = lambda n: " ".join("".join(rng.choice("abc") for _ in range(rng.randrange(1, 5))) for _ in range(n))
    seg = [("r", i, text(6)) for i in range(40)]
    quo = [("r", n, rng.choice([text(1), text(2), text(3), "zz"]), "X") for n in range(60)]
    s, q = spark.createDataFrame(seg, "recording string, seq int, text string"), spark.createDataFrame(quo, "recording string, n long, fragment string, canonical string")
    want = {i: t for _, i, t in seg}
    first = {n: next((i for _, i, t in seg if f in t), None) for _, n, f, _ in quo}
    for _, n, f, c in quo:
        if first[n] is not None:
            new = replacement.replace_once(want[first[n]], f, c)
            want[first[n]] = want[first[n]] if new is None else new
    got = {r.seq: r.text for r in replacement.replace_quotations(s, q).collect()}
    assert got == {i: want[i] for _, i, t in seg if want[i] != t} and got


def test_topics(spark):
    t = spark.createDataFrame([("a", "Patience in hardship"), ("b", "Patience and hardship"), ("c", "Trade"), ("d", "TRADE"), ("e", "x")], "slug string, name string")
    p = topics.merge_proposals(t)
    assert [(r.a, r.b) for r in p.collect()] == [("a", "b")]
    d = spark.createDataFrame([("b", "a", " Accept")], "a string, b string, decision string")
    assert topics.decided(p, d).first().status == "accepted" and topics.decided(p, d.limit(0)).first().status == "pending"
    assert {r.slug: r.alike for r in topics.dictionary(t, p).collect()} == {"a": "b", "b": "a", "c": "-", "d": "-", "e": "-"}
    c = spark.createDataFrame([(1, "r", 5, "k"), (2, "r", 5, "m"), (3, "r", 9, "k")], "id long, recording string, at long, key string")
    g = spark.createDataFrame([("r", 5, "z", 2), ("r", 5, "k", 1), ("r", 5, "k", 1)], "recording string, at long, key string, n long")
    assert sorted(map(tuple, topics.gold_labels(c, g).collect())) == [(1, "accept", "k"), (2, "accept_different", "k"), (3, "reject", None)]


def test_upsert(spark):
    r = spark.createDataFrame([("a", "A", ["S"]), ("b", "B", ["T"])], "slug string, name string, series array<string>")
    t = spark.createDataFrame([("a", "other"), ("c", "Z"), ("c", "C"), (None, "n")], "slug string, name string")
    got = {x.slug: (x.name, x.series) for x in topics.upsert(topics.upsert(r, t, "R"), t, "R").collect()}
    assert got == {"a": ("A", ["R", "S"]), "b": ("B", ["T"]), "c": ("C", ["R"])}


def test_plans_turn_old_into_new():
    rng = random.Random(6)
    for _ in range(2000):
        def make(n):
            out, at = [], 0.0
            for _ in range(n):
                at += rng.choice([0, 0.005, 1, 2])
                end = at + rng.choice([0, 1, 1, 3, -1])
                out.append({"start": at, "end": end, "text": rng.choice("abc")})
                at = max(at, end) - rng.choice([0, 0, 0.5])
            return sorted(out, key=lambda x: x["start"])

        old, new = make(rng.randrange(6)), make(rng.randrange(6))
        kinds = [{"type": rng.choice(["dua", "topics"]), "reference": rng.choice("xy"), "start": rng.choice([0.25, 0.35, 1.0])} for _ in range(rng.randrange(5))]
        want = {t: [{k: v for k, v in e.items() if k != "type"} for e in [{"type": rng.choice(["dua", "topics"]), "reference": rng.choice("xy"), "start": rng.choice([0.25, 0.35, 1.0])} for _ in range(rng.randrange(5))] if e["type"] == t] for t in ("dua", "topics")}
        s = Session(old, kinds)
        actions = replay.interleaved(replay.plan(s.segments, new), replay.plan_entities(s.entities, want))
        segments, entities = replay.run_plan(s, actions).outputs()
        assert segments == new and {t: entities[t] for t in want} == want


def test_interleaving():
    seg = [{"op": f"s{i}", "anchor": a} for i, a in enumerate([5.0, 2.0, 9.0])]
    ent = [{"op": f"e{i}", "anchor": a} for i, a in enumerate([1.0, 5.0, 4.9, 8.9, 9.0, 99.0])]
    assert [a["op"] for a in replay.interleaved(seg, ent)] == ["s0", "e0", "e2", "s1", "e1", "e3", "s2", "e4", "e5"]
    assert replay.interleaved([], ent[:2]) == ent[:2] and replay.interleaved(seg, []) == seg


def test_merge_then_split():
    s = Session([{"start": 0.0, "end": 2.0, "text": "a"}, {"start": 2.0, "end": 4.0, "text": "b"}])
    acts = replay.plan(s.segments, [{"start": 0.0, "end": 1.0, "text": "a"}, {"start": 1.0, "end": 4.0, "text": "b"}])
    assert [a["op"] for a in acts] == ["seg.merge", "seg.split"]


def test_entity_moves(spark):
    from tessera.operators.replay import entity_moves

    f = spark.createDataFrame([("k", 1, "a"), ("k", 2, "b"), ("m", 1, "a")], "k string, o int, t string")
    w = spark.createDataFrame([("k", 5, "a"), ("k", 6, "x"), ("k", 7, "y"), ("z", 1, "a")], "k string, o int, t string")
    got = {(r.k, r.n): r.move for r in entity_moves(f, w, ["k"], "o", F.col("f_t") == F.col("w_t")).collect()}
    assert got == {("k", 1): "accept", ("k", 2): "edit", ("k", 3): "add", ("m", 1): "reject", ("z", 1): "add"}


def test_plans_by_group(spark):
    cols = "recording string, seq int, start_ms long, end_ms long, text string"
    old = spark.createDataFrame([("r", 0, 0, 10, "a"), ("r", 1, 100, 200, "b"), ("r", 2, 200, 300, "c"), ("r", 3, None, 5, "x")], cols)
    new = spark.createDataFrame([("r", 0, 0, 10, "a"), ("r", 1, 100, 300, "b c"), ("r", 2, 900, 999, "d")], cols)
    got = {r.from_ms: [json.loads(a)["op"] for a in r.actions] for r in replay.plans(old, new).collect()}
    assert got == {0: ["seg.accept"], 100: ["seg.merge", "seg.edit"], 900: ["seg.insert"]} and replay.plans(old, new).where("not exact").count() == 0


def test_ports(spark):
    v = ports.hashed_embedding(["the moon rises", "the moon sets", "", None])
    assert np.allclose(np.linalg.norm(v[:2], axis=1), 1) and not v[2:].any() and v[0] @ v[1] > 0.3
    df = spark.createDataFrame([(1, "a b"), (2, None)], "id long, t string")
    assert [len(r[0]) for r in df.select(ports.embed(F.col("t"))).collect()] == [ports.DIMENSIONS] * 2
    c = spark.createDataFrame([(7, "what moon?", f"c{i}", t, i + 1) for i, t in enumerate(["sun", "a moon", "what moon", "x", "y"])], "query_id long, question string, chunk_id string, text string, rank int")
    assert [r.chunk_id for r in sorted(ports.rerank(c).collect(), key=lambda r: r.new_rank)] == ["c2", "c1", "c0", "c3"]

    def broken(q, t):
        raise RuntimeError

    assert [(r.chunk_id, r.status) for r in sorted(ports.rerank(c, broken).collect(), key=lambda r: r.new_rank)] == [(f"c{i}", "failed") for i in range(4)]


def test_ask_retries(spark):
    df = spark.createDataFrame([(1, "fine"), (2, "bad"), (3, None), (4, "down")], "id long, t string")

    def model(p):
        if p == "down":
            raise TimeoutError
        return "" if p == "bad" else p.upper()

    got = {r.id: (r.reply, r.tries, r.status) for r in ports.ask(df, "id", F.col("t"), model).collect()}
    assert got == {1: ("FINE", 1, "ok"), 2: (None, 3, "refused by the check"), 3: (None, 0, "no prompt"), 4: (None, 3, "TimeoutError")}


def test_merge_proposals_against_the_whole_product(spark):
    import difflib
    import random

    rng = random.Random(1)
    names = ["ab-cd-ef-gh", "abxcdxefxgh", "no", "on", "ns", "The River", "the river"] + ["".join(rng.choice("abcd ") for _ in range(rng.randint(1, 9))) + "x" for _ in range(40)]
    t = spark.createDataFrame([(f"s{i:02d}", n) for i, n in enumerate(names)], "slug string, name string")
    ratio = lambda a, b: round(difflib.SequenceMatcher(None, a.lower(), b.lower()).ratio(), 3)
    want = {(f"s{i:02d}", f"s{j:02d}"): r for i, a in enumerate(names) for j, b in enumerate(names) if i < j and a.lower() != b.lower() and (r := ratio(a, b)) >= 0.6}
    assert ("s00", "s01") in want  # no three letters in a row are shared
    assert {(r.a, r.b): r.similarity for r in topics.merge_proposals(t).collect()} == want
