import random

from pyspark.sql import functions as F

from tessera.operators.intervals import millis, periods_and_gaps


def brute(rows, max_gap=None):
    by = {}
    for k, s, e in rows:
        if k is not None and s is not None and e is not None and e > s:
            by.setdefault(k, set()).add((s, e))
    out = set()
    for k, spans in by.items():
        done = []
        for s, e in sorted(spans):
            if done and s <= done[-1][1]:
                done[-1][1] = max(done[-1][1], e)
            else:
                done.append([s, e])
        out |= {(k, "period", s, e) for s, e in done}
        out |= {(k, "gap", a[1], b[0]) for a, b in zip(done, done[1:]) if max_gap is None or b[0] - a[1] <= max_gap}
    return out


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, "rec string, s long, e long").selectExpr("*", "1 AS t", "'x' AS kind", "0 AS first")
    got = [tuple(r) for r in periods_and_gaps(df, ["rec"], "s", "e", **kw).collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_against_brute_force(spark):
    rng = random.Random(0)
    for n, block in ((60, 50), (400, 70), (400, 600_000)):
        rows = []
        for _ in range(n):
            s = rng.choice([None, rng.randrange(-200, 3000)])
            e = None if rng.random() < 0.05 or s is None else s + rng.choice([-3, 0, 1, 5, 20, 200])
            rows.append((rng.choice(["a", "a", "b", None]), s, e))
        rows += rows[:10]
        assert run(spark, rows, block=block) == brute(rows)
        assert run(spark, rows, block=block, max_gap=15) == brute(rows, 15)


def test_touching_nested_and_empty(spark):
    assert run(spark, [("a", 0, 5), ("a", 5, 9), ("a", 1, 2), ("a", 12, 13)]) == {("a", "period", 0, 9), ("a", "gap", 9, 12), ("a", "period", 12, 13)}
    assert run(spark, []) == set()
    assert run(spark, [("a", 3, 3), ("a", 5, 4)]) == set()


def test_millis(spark):
    df = spark.createDataFrame([(1.0005,), (None,), (float("nan"),), (float("inf"),), (-0.25,)], "x double")
    assert [r[0] for r in df.select(millis(F.col("x"))).collect()] == [1001, None, None, None, -250]
