import random

from pyspark.sql import functions as F

from tessera.operators import agreement as A


def test_counts_against_sets(spark):
    rng = random.Random(4)
    rows = lambda: [(rng.choice("gh"), rng.choice("abc"), rng.choice([0.5, 1.0, 2.0]), rng.choice([" x", "x", "y", None]), i) for i in range(60)]
    f, w = rows(), rows()
    cols = "g string, e string, at double, t string, o int"
    got = {r.g: r for r in A.counts(spark.createDataFrame(f, cols), spark.createDataFrame(w, cols), ["g"], ["e"], "at", "t", "o").collect()}
    for g in "gh":
        F_, W_ = ({(r[1], r[2]): (r[3] or "").strip() for r in x if r[0] == g} for x in (f, w))
        both = F_.keys() & W_.keys()
        r = got[g]
        assert (r.found, r.wanted) == (sum(x[0] == g for x in f), sum(x[0] == g for x in w))
        assert (r.matched, r.rejected, r.added) == (len(both), len(F_.keys() - both), len(W_.keys() - both))
        assert r.retained == sum(F_[k] == W_[k] for k in both) and r.corrected == r.matched - r.retained
        ef, ew = {k[0] for k in F_}, {k[0] for k in W_}
        assert (r.found_entities, r.wanted_entities, r.entity_matched) == (len(ef), len(ew), len(ef & ew))
    empty = spark.createDataFrame([], cols)
    only = A.rates(A.counts(empty, spark.createDataFrame(w, cols), ["g"], ["e"], "at", "t", "o")).first()
    assert only.occurrence_precision is None and only.occurrence_recall == 0 and only.occurrence_f1 is None and only.omission > 0
    assert A.counts(empty, empty, ["g"], ["e"], "at", "t", "o").count() == 0


def test_pooled_sums_before_ratios(spark):
    rows = [("s", "a", *[1] * len(A.COUNTS)), ("t", "a", *[3] * len(A.COUNTS))]
    df = spark.createDataFrame(rows, "series string, k string, " + ", ".join(f"{c} long" for c in A.COUNTS))
    got = {r.series: r.matched for r in A.pooled(df, ["k"], "series").collect()}
    assert got == {"s": 1, "t": 3, "ALL": 4}


def test_retrieval_and_citation(spark):
    rows = [(["a", "b"], ["x", "b", "a"], ["a", "x"], ["a", "x", "x"], "see a and x"), ([], ["a"], ["a"], ["a"], "a"), (["q"], ["a"], ["a"], [], None)]
    df = spark.createDataFrame(rows, "g array<string>, i array<string>, r array<string>, s array<string>, t string")
    got = [r[0] for r in df.select(A.retrieval_metrics(F.col("g"), F.col("i"), F.col("r"), F.col("s"))).collect()]
    assert tuple(got[0]) == (True, 2, True, 1, True, 0.5, 0.5) and tuple(got[1]) == (None,) * 7 and tuple(got[2]) == (False, None, False, None, False, None, 0.0)
    cited = [r[0] for r in df.select(A.citation_metrics(F.col("g"), F.col("t"), F.col("s"))).collect()]
    assert tuple(cited[0]) == (["a", "x"], 0.5, 0.5, False) and tuple(cited[1]) == (["a"], None, None, False) and tuple(cited[2]) == ([], None, 0.0, True)
