from pathlib import Path

import pytest

from tessera.llm import mixing as M
from tessera.llm import tokens as T

pytestmark = pytest.mark.skipif(not Path(T.FOLDER, T.NAME).exists(), reason="no tokenizer files")
TARGETS = [("big", 0.5, 1), ("mid_size", 0.4, 2), ("small", 0.1, 3)]


def tables(spark, docs):
    return spark.createDataFrame(docs, "doc_id long, text string, source string").selectExpr("*", "0 AS h", "1 AS copies"), spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")


def test_shares_repeats_and_nesting(spark):
    docs = [(i, "one two three four five", "big") for i in range(2000)] + [(10_000 + i, "six seven eight nine", [" Mid-Size", "MID_SIZE", "mid size"][i % 3]) for i in range(700)] + [(20_000 + i, "ten more words", "small") for i in range(60)]
    docs += [(30_000, "no target", "else"), (30_001, "null source", None), (30_002, None, "big"), (30_003, "", "small")]
    d, t = tables(spark, docs + docs[:5])
    mix, report = M.mix(d, t)
    rows, rep = mix.collect(), {r.source: r for r in report.collect()}
    assert len({r.doc_id for r in rows}) == len(rows) and not {30_000, 30_001} & {r.doc_id for r in rows}
    assert all(1 <= r.copies <= dict((s, m) for s, _, m in TARGETS)[r.source] for r in rows)
    for s, share, _ in TARGETS:
        assert abs(rep[s].actual_share - share) < 0.01
        assert rep[s].mixed_tokens == sum(r.n_tokens * r.copies for r in rows if r.source == s)
    assert rep["small"].most_copies == 3
    less = {r.doc_id: r.copies for r in M.mix(d, t, total=900)[0].collect()}
    more = {r.doc_id: r.copies for r in rows}
    assert less and all(more.get(k, 0) >= n for k, n in less.items())
    assert abs(sum(r.n_tokens * less.get(r.doc_id, 0) for r in rows) - 900) <= 15


def test_threshold_is_the_nearest_prefix_by_hash(spark):
    import random

    rng = random.Random(3)
    rows = [(i, "s", rng.randrange(1, 9), rng.randrange(1 << M.HASH_BITS)) for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, source string, n_tokens long, h long")
    for want in (1, 77, 1000, 10**9):
        below = M.thresholds(df, {"s": want})["s"]
        order = sorted((h, n) for _, _, n, h in rows)
        sums = [sum(n for _, n in order[:i]) for i in range(len(order) + 1)]
        inside = sum(n for h, n in order if h < below)
        assert abs(inside - want) == min(abs(x - want) for x in sums)


def test_empty_tables(spark):
    d, t = tables(spark, [])
    mix, report = M.mix(d, t)
    assert mix.count() == 0 and [r.mixed_tokens for r in report.collect()] == [0, 0, 0]
    assert M.mix(tables(spark, [(1, "a b", "big")])[0], t.limit(0))[0].count() == 0
