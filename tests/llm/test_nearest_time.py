import random

from tessera.llm.nearest_time import nearest


def brute(left, right, tol):
    out = {}
    for i, k, t in left:
        c = [(abs(u - t), u, j) for j, q, u in right if k is not None and q == k and t is not None and u is not None and abs(u - t) <= tol]
        if c:
            out[i] = min(c)[2]
    return out


def run(spark, left, right, **kw):
    a = spark.createDataFrame(left, "a long, rec string, t long").selectExpr("*", "1 AS seg_key", "'x' AS _k")
    b = spark.createDataFrame(right, "b long, rec string, t long").selectExpr("*", "2 AS entity_id")
    rows = nearest(a, b, left_id="a", right_id="b", entity="rec", left_ms="t", right_ms="t", tolerance=1500, **kw).collect()
    assert len({r.a for r in rows}) == len(rows)
    return {r.a: r.b for r in rows}


def test_against_brute_force(spark):
    rng = random.Random(1)
    time = lambda: rng.choice([None, rng.randrange(-3000, 60_000), rng.randrange(0, 60_000, 500)])
    left = [(i, rng.choice(["h", "h", "x", None]), time()) for i in range(400)]
    right = [(i, rng.choice(["h", "h", "x", None]), time()) for i in range(400)]
    for block in (4_000, 120_000):
        assert run(spark, left + left[:20], right + right[:20], block=block) == brute(left, right, 1500)


def test_ties_and_empty(spark):
    left = [(1, "r", 1000)]
    assert run(spark, left, [(9, "r", 500), (4, "r", 1500), (5, "r", 500)]) == {1: 5}
    assert run(spark, left, [(9, "r", 2500), (8, "r", 2501)]) == {1: 9}
    assert run(spark, left, []) == run(spark, [], [(1, "r", 5)]) == {}
