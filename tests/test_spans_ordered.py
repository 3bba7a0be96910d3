import random

from pyspark.sql import functions as F

from tessera.operators import ordered
from tessera.operators.spans import best_overlap, last_before, overlap_join


def spans(rng, n, base):
    return [(base + i, rng.choice("ab"), *sorted((rng.randrange(500), rng.randrange(500)))) if rng.random() > 0.05 else (base + i, "a", None, 4) for i in range(n)]


def test_overlap_join_and_best(spark):
    rng = random.Random(1)
    left, right = spans(rng, 80, 0), spans(rng, 80, 1000)
    a = spark.createDataFrame(left, "l long, k string, ls long, le long")
    b = spark.createDataFrame(right, "r long, k string, rs long, re long")
    want = {(i, j) for i, k, s, e in left for j, q, u, v in right if k == q and None not in (s, u) and s < v and u < e}
    j = overlap_join(a, b, "k", "ls", "le", "rs", "re", block=60)
    got = [(r.l, r.r) for r in j.select("l", "r").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    best = {r.l: (r.r, r.shared_ms) for r in best_overlap(j, "l", "r", "ls", "le", "rs", "re").collect()}
    ls, rs = {x[0]: x[2:] for x in left}, {x[0]: x[2:] for x in right}
    for i in {x for x, _ in want}:
        n = lambda q: min(ls[i][1], rs[q][1]) - max(ls[i][0], rs[q][0])
        assert best[i] == min(((q, n(q)) for x, q in want if x == i), key=lambda t: (-t[1], t[0]))


def test_overlap_join_of_very_long_spans(spark):
    day = 86_400_000
    left = [(1, "k", 0, 400_000 * day), (2, "k", 5, 70), (3, "k", 90 * day, 91 * day), (4, "k", 100_000, 90_000)]
    right = [(11, "k", 50, 60), (12, "k", -3 * day, 200_000 * day), (13, "k", 90 * day + 5, 90 * day + 9), (14, "x", 0, 9)]
    a, b = spark.createDataFrame(left, "l long, k string, ls long, le long"), spark.createDataFrame(right, "r long, k string, rs long, re long")
    got = sorted((r.l, r.r) for r in overlap_join(a, b, "k", "ls", "le", "rs", "re").collect())
    assert got == sorted((i, j) for i, k, s, e in left for j, q, u, v in right if k == q and s < v and u < e)


def test_neighbours(spark):
    rng = random.Random(7)
    rows = [(k, i, rng.choice([None, i])) for k in "ab" for i in rng.sample(range(500), 90)]
    got = ordered.neighbours(spark.createDataFrame(rows, "k string, i int, n int"), ["k"], ["i"], F.floor(F.col("i") / 20), before={"b": "n", "bi": "i"}, after={"a": "n"}).collect()
    for k in "ab":
        mine = sorted((r for r in got if r.k == k), key=lambda r: r.i)
        assert [(r.b, r.bi) for r in mine] == [(None, None), *[(r.n, r.i) for r in mine[:-1]]] and [r.a for r in mine] == [*[r.n for r in mine[1:]], None]


def test_last_before(spark):
    rng = random.Random(2)
    pts = [(i, rng.choice(["a", "b", None]), rng.choice([None, rng.randrange(1000)])) for i in range(120)]
    sts = [(500 + i, rng.choice(["a", "b"]), rng.choice([None, rng.randrange(1000)])) for i in range(60)]
    want = {}
    for i, k, t in pts:
        c = [(u, j) for j, q, u in sts if k == q and None not in (t, u) and u <= t]
        if c:
            want[i] = max(c)[1]
    p, s = spark.createDataFrame(pts, "p long, k string, t long"), spark.createDataFrame(sts, "s long, k string, u long")
    for block in (30, 3_600_000):
        assert {r.p: r.s for r in last_before(p, s, "k", "p", "t", "s", "u", block=block).collect()} == want


def test_running(spark):
    rng = random.Random(3)
    rows = [(k, i, rng.randrange(10)) for k in "ab" for i in rng.sample(range(1000), 150)]
    got = ordered.running(spark.createDataFrame(rows, "k string, i int, n int"), ["k"], ["i"], F.floor(F.col("i") / 40), {"s": ("sum", "n"), "m": ("max", "n")})
    for r in got.collect():
        before = [n for k, i, n in rows if k == r.k and i < r.i]
        assert r.s == sum(before) and r.m == (max(before) if before else None)


MARKS = {".": 3, ",": 1}


def chunked(rows, whole=True):
    return list(ordered.chunk_stream(((i, a, b, t.strip(), MARKS.get(t.strip()[-1:], 0)) for i, (a, b, t) in enumerate(rows)), whole))


def test_chunk_rules():
    seg = lambda *xs: [(float(a), float(b), t) for a, b, t in xs]
    assert [c[0] for c in chunked(seg((0, 10, "a"), (10, 20, "b.")))] == [[0, 1]]
    rows = seg(*[(10 * i, 10 * i + 10, "x." if i == 2 else "x") for i in range(12)])
    assert [c[0] for c in chunked(rows)] == [[0, 1, 2], [3, 4, 5], [6, 7, 8, 9, 10, 11]]
    assert [c[0] for c in chunked(rows, False)] == [c[0] for c in chunked(rows)] and chunked(seg((0, 90, "long"), (90, 95, "b")))[0][0] == [0]
    # A pause beats a clause, a sentence beats a pause; of equal places the one nearest the target, then the later.
    assert chunked(seg((0, 20, "a,"), (20, 30, "b"), (35, 50, "c"), (50, 70, "d")))[0][0] == [0, 1]
    assert chunked(seg((0, 16, "a."), (16, 30, "b"), (35, 50, "c"), (50, 70, "d")))[0][0] == [0]
    assert chunked(seg((0, 20, "a."), (20, 40, "b."), (40, 70, "c"), (70, 99, "d")))[0][0] == [0, 1]
    assert chunked([]) == []


def test_chunks_cut_at_pauses_are_those_of_the_whole(spark):
    rng = random.Random(4)
    rows, at = [], 0.0
    for i in range(300):
        at += rng.choice([0, 0, 0, 0.5, 2, 90, 200])
        end = at + rng.choice([1, 4, 9, 30, 70])
        rows.append(("r", i, at, end, rng.choice(["a.", "b,", " c ", "d", "", "e.”", "f)"])))
        at = end
    got = sorted((r.chunk_start, r.chunk_end, r.n_segments, r.text) for r in ordered.chunks(spark.createDataFrame(rows, "recording string, seq int, start_s double, end_s double, text string")).collect())
    want = chunked([(a, b, t.rstrip("”)") if t != "f)" else t) for _, _, a, b, t in rows])
    assert [(s, e, n) for s, e, n, _ in got] == sorted((s, e, len(i)) for i, s, e, _ in want)


def test_groups_are_streamed_in_order(spark):
    rows = [(k, i) for k in ("a", "b", "c") for i in random.Random(5).sample(range(4_000), 4_000)]
    fn = lambda g: ((r[0], n) for n, r in enumerate(g) if r[1] == n)
    got = ordered.apply_groups(spark.createDataFrame(rows, "k string, i int"), ["k"], ["i"], fn, "k string, n long")
    assert got.count() == 12_000


def test_word_buffers(spark):
    rows = [("a", i, f"w{i}") for i in range(35)] + [("b", i, f"w{i}") for i in range(3)] + [("c", i, "x") for i in range(38)]
    df = spark.createDataFrame(rows, "k string, no long, w string").selectExpr("*", "no * 1.0D AS s", "no + 1.0D AS e")
    got = {(r.k, r.buffer): r.n_words for r in ordered.word_buffers(df, ["k"], "no", "s", "e", "w").collect()}
    assert got == {("a", 0): 15, ("a", 1): 20, ("b", 0): 3, ("c", 0): 15, ("c", 1): 15, ("c", 2): 8}
