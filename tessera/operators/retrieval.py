"""Nearest-neighbour search over embeddings and the metrics of retrieval and citation."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Queries and vectors that one task compares.
QUERY_BLOCK, VECTOR_BLOCK = 5_000, 50_000


def knn(queries: DataFrame, vectors: DataFrame, key: str, vector: str, top: int) -> DataFrame:
    """``query_id, neighbour_id, score, rank``: for each query the ``top`` vectors by dot product (double), ties by id.

    Queries and vectors are cut into blocks by hash and every block of the one meets every block of the other in a task,
    which keeps its best for each query; these are ranked.  Nothing goes through the driver.  A vector isn't its own
    neighbour.  Null vectors, and vectors of another length than the query, are left out; keys must be unique.
    """
    some = lambda df: df.select(F.col(key).cast("bigint").alias("k"), F.col(vector).cast("array<double>").alias("v")).where(F.col("v").isNotNull() & F.col("k").isNotNull())
    q, v = some(queries), some(vectors)
    nq, nv = max(1, -(-q.count() // QUERY_BLOCK)), max(1, -(-v.count() // VECTOR_BLOCK))
    place = lambda n, salt: F.pmod(F.xxhash64("k", F.lit(salt)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = q.withColumn("qb", place(nq, 1)).withColumn("vb", every(nv))
    v = v.withColumn("vb", place(nv, 2)).withColumn("qb", every(nq))

    def best(a: pa.Table, b: pa.Table) -> pa.Table:
        found: list[tuple[list, list, list]] = []
        asked, there = _by_length(a), _by_length(b)
        for n, (qk, qm) in asked.items():
            if n not in there:
                continue
            vk, vm = there[n]
            for i in range(0, len(qk), 200):
                scores = qm[i : i + 200] @ vm.T
                scores[qk[i : i + 200, None] == vk[None, :]] = -np.inf
                few = min(top, scores.shape[1])
                cuts = np.partition(scores, -few, axis=1)[:, -few]
                for r, c in enumerate(cuts):
                    at = np.flatnonzero((scores[r] >= c) & (scores[r] > -np.inf))
                    at = at[np.lexsort((vk[at], -scores[r, at]))][:top]
                    found.append(([qk[i + r]] * len(at), vk[at].tolist(), scores[r, at].tolist()))
        cols = [[x for f in found for x in f[j]] for j in range(3)]
        return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "neighbour_id", "score"])

    got = q.groupBy("qb", "vb").cogroup(v.groupBy("qb", "vb")).applyInArrow(best, "query_id bigint, neighbour_id bigint, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "neighbour_id")
    return got.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def _by_length(t: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Keys and matrix of the vectors of each length, in order of the keys."""
    keys, lists = t.column("k").to_numpy(), t.column("v").to_pylist()
    out: dict[int, list[int]] = {}
    for i in np.argsort(keys, kind="stable"):
        out.setdefault(len(lists[i]), []).append(i)
    return {n: (keys[at], np.array([lists[i] for i in at], np.float64)) for n, at in out.items()}


def shares(gold: Column, got: Column) -> tuple[Column, Column]:
    """Precision and recall of an array of ids as sets; null where the denominator is empty."""
    g, c = F.array_distinct(F.coalesce(gold, F.array().cast("array<string>"))), F.array_distinct(F.coalesce(got, F.array().cast("array<string>")))
    both = F.size(F.array_intersect(g, c))
    return F.try_divide(both, F.size(c)), F.try_divide(both, F.size(g))
