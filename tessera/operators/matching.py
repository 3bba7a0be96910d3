"""Grounding of passages in a canonical corpus: scores, ranking, threshold and margin rules, parameter grids."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import for_matching, words
from tessera.operators import ports
from tessera.session import checkpoint

TOP = 5
#: Candidates scored at once, and entries of the corpus that go to the tasks at once.
SLICE, CORPUS_BLOCK = 500, 10_000


def _unit(rows: list) -> np.ndarray:
    m = np.asarray(rows, np.float64)
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def best_matches(candidates: DataFrame, corpus: DataFrame, kind: str, text: str, corpus_kind: str, corpus_key: str, corpus_text: str, *, alphas: list[float], top: int = TOP, model: Callable[[list[str]], np.ndarray] = ports.hashed_embedding) -> DataFrame:
    """``kind, text, alpha, rank, corpus_key, lexical, semantic, score``: the ``top`` corpus entries of its kind of each distinct candidate text, ties by key.

    Every entry of the kind is scored: alpha * lexical + (1 - alpha) * semantic, the lexical score being the mean of the edit
    score and the word F1 of the matching forms, the semantic one the cosine of the vectors of the texts as they stand.
    Null and blank candidate texts give no row.  A corpus of up to CORPUS_BLOCK entries goes to every task as a whole; a larger
    one block by block, the best of each block being ranked again.  Candidates aren't sorted.
    """
    known = corpus.select(F.col(corpus_kind).alias("k"), F.col(corpus_key).alias("key"), for_matching(F.col(corpus_text)).alias("norm"), ports.embed(F.col(corpus_text), model).alias("v")).where("norm <> ''").withColumn("ws", words(F.col("norm")))
    n = -(-known.count() // CORPUS_BLOCK)
    if n <= 1:
        return _best_in(candidates, known, kind, text, corpus_key, alphas, top, model)
    known = checkpoint(known)
    found = reduce(DataFrame.unionByName, [_best_in(candidates, known.where(F.pmod(F.xxhash64("key"), F.lit(n)) == i), kind, text, corpus_key, alphas, top, model) for i in range(n)])
    w = Window.partitionBy(kind, text, "alpha").orderBy(F.desc("score"), corpus_key)
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def _best_in(candidates: DataFrame, known: DataFrame, kind: str, text: str, corpus_key: str, alphas: list[float], top: int, model: Callable[[list[str]], np.ndarray]) -> DataFrame:
    """``best_matches`` among the entries ``known`` (k, key, norm, v, ws), which are collected."""
    spark = candidates.sparkSession
    entries: dict[str, list] = {}
    for r in sorted(known.collect(), key=lambda r: r.key):
        entries.setdefault(r.k, []).append(r)
    shared = spark.sparkContext.broadcast({k: ([r.key for r in rs], [len(r.norm) for r in rs], [r.ws for r in rs], [r.v for r in rs]) for k, rs in entries.items()})
    norms = spark.createDataFrame([(k, [r.norm for r in rs]) for k, rs in entries.items()], f"`{kind}` string, _norms array<string>")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    texts = candidates.select(kind, text).where(F.trim(text) != "").distinct().repartition(parts).withColumn("_norm", for_matching(F.col(text)))
    vectors = texts.withColumn("_v", ports.embed(F.col(text), model)).join(F.broadcast(norms), kind)
    edits = vectors.select(kind, text, F.char_length("_norm").alias("_n"), words(F.col("_norm")).alias("_ws"), "_v", F.transform("_norms", lambda x: F.levenshtein("_norm", x)).alias("_edits"))

    def scored(rows: list[dict], index: dict[str, tuple[np.ndarray, np.ndarray]], lengths: np.ndarray, n_words: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        both = np.zeros((len(rows), len(lengths)))
        for i, r in enumerate(rows):
            for w, c in Counter(r["_ws"]).items():
                if w in index:
                    at, n = index[w]
                    both[i, at] += np.minimum(n, c)
        edit = 1 - np.array([r["_edits"] for r in rows], np.float64) / np.maximum(np.array([r["_n"] for r in rows])[:, None], lengths)
        f1 = 2 * both / (np.array([len(r["_ws"]) for r in rows])[:, None] + n_words)
        return (edit + f1) / 2, _unit([r["_v"] for r in rows]) @ unit.T

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[str, tuple] = {}
        for k, (_, lengths, ws, vs) in shared.value.items():
            index: dict[str, list] = {}
            for j, x in enumerate(ws):
                for w, c in Counter(x).items():
                    index.setdefault(w, []).append((j, c))
            made[k] = ({w: (np.array([j for j, _ in x]), np.array([c for _, c in x])) for w, x in index.items()}, np.array(lengths), np.array([len(x) for x in ws]), _unit(vs))
        for b in it:
            for at in range(0, b.num_rows, SLICE):
                rows, out = b.slice(at, SLICE).to_pylist(), [[] for _ in range(8)]
                for k in sorted({r[kind] for r in rows}):
                    own, keys = [r for r in rows if r[kind] == k], shared.value[k][0]
                    lexical, semantic = scored(own, *made[k])
                    for alpha in alphas:
                        score = np.round(alpha * lexical + (1 - alpha) * semantic, 6)
                        best = np.argsort(-score, axis=1, kind="stable")[:, :top]
                        for i, r in enumerate(own):
                            for rank, j in enumerate(best[i], 1):
                                for col, x in zip(out, (k, r[text], alpha, rank, keys[j], round(float(lexical[i, j]), 6), round(float(semantic[i, j]), 6), float(score[i, j]))):
                                    col.append(x)
                kinds = (pa.string(), pa.string(), pa.float64(), pa.int32(), pa.string(), pa.float64(), pa.float64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names=[kind, text, "alpha", "rank", corpus_key, "lexical", "semantic", "score"])

    return edits.mapInArrow(run, f"`{kind}` string, `{text}` string, alpha double, rank int, `{corpus_key}` string, lexical double, semantic double, score double")


def score_matrix(candidates: DataFrame, corpus: DataFrame, kind: str, text: str, corpus_kind: str, corpus_key: str, corpus_text: str, **more) -> DataFrame:
    """``kind, text, corpus_key, lexical, semantic`` of every distinct candidate text and every entry of its kind."""
    n = corpus.count()
    rows = best_matches(candidates, corpus, kind, text, corpus_kind, corpus_key, corpus_text, alphas=[1.0], top=max(1, n), **more)
    return rows.select(kind, text, corpus_key, "lexical", "semantic")


def decisions(top: DataFrame, corpus_key: str, score: str, tau: float, delta: float, by: tuple[str, ...]) -> DataFrame:
    """``by, best_key, best_score, margin, verdict``: verified, ambiguous (margin under delta), unresolved (score under tau)."""
    two = top.where(F.col("rank") <= 2).groupBy(*by).agg(
        F.max(F.when(F.col("rank") == 1, F.col(corpus_key))).alias("best_key"), F.max(F.when(F.col("rank") == 1, F.col(score))).alias("best_score"), F.max(F.when(F.col("rank") == 2, F.col(score))).alias("_second"),
    )
    margin = F.round(F.col("best_score") - F.col("_second"), 6)
    return two.select(*by, "best_key", "best_score", margin.alias("margin"), verdict(F.col("best_score"), margin, tau, delta).alias("verdict"))


def verdict(best: Column, margin: Column, tau: float | Column, delta: float | Column) -> Column:
    return F.when(best.isNull() | (best < tau), "unresolved").when(margin < delta, "ambiguous").otherwise("verified")


def grid(best: DataFrame, taus: list[float], deltas: list[float], by: tuple[str, ...] = ()) -> DataFrame:
    """Counts and F1 by (tau, delta), and the columns ``by``, of candidates ``best_key, best_score, margin, gold_key`` (null: should be rejected).

    ``correct`` and ``wrong`` are of those accepted, ``missed`` are positives that aren't, ``rejected`` negatives that aren't.
    """
    points = F.explode(F.array(*[F.struct(F.lit(t).alias("tau"), F.lit(d).alias("delta")) for t in taus for d in deltas])).alias("g")
    kept = (F.col("best_score") >= F.col("g.tau")) & (F.col("margin").isNull() | (F.col("margin") >= F.col("g.delta")))
    right = kept & (F.col("best_key") == F.col("gold_key"))
    n = best.select(*by, "best_key", "best_score", "margin", "gold_key", points).groupBy(*by, "g.tau", "g.delta").agg(
        F.count_if(F.coalesce(right, F.lit(False))).alias("correct"), F.count_if(kept & ~F.coalesce(right, F.lit(False))).alias("wrong"), F.count_if(F.col("gold_key").isNotNull()).alias("positives"),
        F.count_if(F.col("gold_key").isNull()).alias("negatives"), F.count_if(kept & F.col("gold_key").isNotNull()).alias("_on_positives"), F.count_if(kept & F.col("gold_key").isNull()).alias("_on_negatives"),
    )
    p, r = F.try_divide(F.col("correct"), F.col("correct") + F.col("wrong")), F.try_divide(F.col("correct"), F.col("positives"))
    return n.select(*by, "tau", "delta", "correct", "wrong", "positives", (F.col("positives") - F.col("_on_positives")).alias("missed"), "negatives", (F.col("negatives") - F.col("_on_negatives")).alias("rejected"), F.round(F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)), 6).alias("f1"))
