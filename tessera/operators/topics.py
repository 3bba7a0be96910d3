"""Topics across series: merge proposals, reviewed decisions, dictionary; gold labels of candidates."""

from __future__ import annotations

import difflib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import likeness
from tessera.session import checkpoint

LIKE = 0.6


#: Topics of a block (two blocks are compared in a task), and the least worth a block of their own.
BLOCK, SMALL_BLOCK = 5000, 250
#: Pairs that are matched, and pairs found that are kept, at once; topics, and bytes of text, that are written at once.
PAIRS, KEPT, ROWS, TEXT = 1 << 16, 1 << 21, 500, 1 << 23


def _block_pairs(topics: DataFrame, n: int) -> DataFrame:
    """Topics with a non-empty name by pairs of blocks, each pair in a partition of its own: ``_t`` has its number, ``_one`` the topics of its first block."""
    spark = topics.sparkSession
    blocks = max(1, -(-n // BLOCK), min(-(-n // SMALL_BLOCK), math.ceil((6 * spark.sparkContext.defaultParallelism) ** 0.5)))
    t = topics.withColumn("_l", F.lower("name")).dropDuplicates(["slug"]).where(F.col("slug").isNotNull() & (F.col("_l") != "")).withColumn("_b", F.pmod(F.xxhash64("slug"), F.lit(blocks)).cast("int"))
    t = t.withColumn("_o", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    i, j = F.least("_b", "_o"), F.greatest("_b", "_o")
    t = t.withColumn("_t", (i * (2 * blocks - i + 1) / 2 + j - i).cast("int")).withColumn("_one", F.col("_b") == i).withColumn("_pair", F.col("_b") != F.col("_o")).drop("_b", "_o")
    return t.repartitionById(blocks * (blocks + 1) // 2, "_t")


def _by_task(it: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    batches = [b for b in it if b.num_rows]
    if batches:
        t = pa.Table.from_batches(batches).combine_chunks()
        for k in pc.unique(t["_t"]):
            yield t.filter(pc.equal(t["_t"], k))


def _alike(t: pa.Table, least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of topics of like names in a pair of blocks, those before by slug first, and how alike they are."""
    names, slugs = [x.lower() for x in t["name"].to_pylist()], t["slug"].to_pylist()
    flat, starts = likeness.coded(names)
    rank = np.empty(len(slugs), np.int64)
    rank[sorted(range(len(slugs)), key=slugs.__getitem__)] = np.arange(len(slugs))
    form, size = t["_l"].combine_chunks().dictionary_encode().indices.to_numpy(), starts[1:] - starts[:-1]
    one, short = t["_one"].to_numpy(), size <= likeness.WORD
    s1, l1, s2, l2 = (np.flatnonzero(x) for x in (one & short, one & ~short, ~one & short, ~one & ~short))
    # Short names are patterns where either is short: they take one word.
    jobs = [(s1, s2), (s1, l2), (s2, l1), (l1, l2)] if t["_pair"][0].as_py() else [(s1, s1), (s1, l1), (l1, l1)]

    def matched(found: list[tuple[np.ndarray, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x, y = np.concatenate([ids for ids, _ in found]), np.repeat([k for _, k in found], [len(ids) for ids, _ in found])
        differ = form[x] != form[y]
        x, y = x[differ], y[differ]
        a, b = np.where(rank[x] < rank[y], x, y), np.where(rank[x] < rank[y], y, x)
        letters, plain = np.empty(len(a), np.int64), size[b] < likeness.JUNK
        letters[plain] = likeness.matching(flat, starts, a[plain], b[plain])
        letters[~plain] = [sum(m.size for m in difflib.SequenceMatcher(None, names[i], names[j]).get_matching_blocks()) for i, j in zip(a[~plain], b[~plain])]
        both = size[a] + size[b]
        alike = (4000 * letters + both) // (2 * both) / 1000  # rounded half up
        return a[alike >= least], b[alike >= least], alike[alike >= least]

    found, n = [], 0
    for ids, texts in jobs:
        for x in likeness.candidates(flat, starts, ids, texts, least - 0.001):  # the likeness is rounded
            found.append(x)
            n += len(x[0])
            if n >= PAIRS:
                yield matched(found)
                found, n = [], 0
    if found:
        yield matched(found)


def merge_proposals(topics: DataFrame, least: float = LIKE, groups: str | None = None) -> DataFrame:
    """``a, b, similarity`` of topics (slug, name) whose names are at least so alike, a before b; names equal but for case are none.

    All pairs are compared; only those that by their letters or their longest common subsequence can't be so alike are left
    out.  With ``groups``, a column of arrays, ``shared`` tells whether the two have a group in common.
    """
    t = checkpoint(topics.select("slug", "name", *([F.col(groups).alias("_g")] if groups else [])))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _by_task(it):
            slugs = x["slug"].combine_chunks()
            if groups:
                own = x["_g"].to_pylist()
                number = {g: i for i, g in enumerate({g for gs in own for g in gs or ()})}
                held = np.zeros((len(own), len(number)), bool)
                for i, gs in enumerate(own):
                    held[i, [number[g] for g in gs or () if g is not None]] = True
                held = np.packbits(held, axis=1)
            for a, b, alike in _alike(x, least):
                out = {"a": slugs.take(pa.array(a)), "b": slugs.take(pa.array(b)), "similarity": pa.array(alike)}
                if groups:
                    out["shared"] = pa.array((held[a] & held[b]).any(axis=1))
                yield pa.RecordBatch.from_pydict(out)

    return _block_pairs(t, t.count()).mapInArrow(run, "a string, b string, similarity double" + ", shared boolean" * bool(groups))


def alike(topics: DataFrame, least: float = LIKE) -> DataFrame:
    """``dictionary`` of the topics and their ``merge_proposals``; pairs travel as numbers of their slugs, of which every task gets the list."""
    spark = topics.sparkSession
    t = checkpoint(topics.select("slug", "name"))
    slugs = sorted({r.slug for r in t.where(F.col("slug").isNotNull()).select("slug").collect()})
    shared, schema = spark.sparkContext.broadcast(slugs), "slug string, own struct<name: string>, others array<int>"

    def rows(slug: pa.Array, number: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        x, y = np.concatenate([a, b]), number[np.concatenate([b, a])]
        order = np.argsort(x, kind="stable")
        ids, n = np.unique(x, return_counts=True)
        others = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(y[order], pa.int32()))
        return pa.RecordBatch.from_arrays([slug.take(pa.array(ids)), pa.nulls(len(ids), pa.struct([("name", pa.string())])), others], names=["slug", "own", "others"])

    def pairs(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = {s: i for i, s in enumerate(shared.value)}
        for x in _by_task(it):
            slug, number = x["slug"].combine_chunks(), np.array([numbers[s] for s in x["slug"].to_pylist()], np.int32)
            kept, n = [], 0
            for a, b, _ in _alike(x, least):
                kept.append((a, b))
                n += len(a)
                if n >= KEPT:
                    yield rows(slug, number, *map(np.concatenate, zip(*kept)))
                    kept, n = [], 0
            if kept:
                yield rows(slug, number, *map(np.concatenate, zip(*kept)))

    def texts(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for b in it:
            out, size = [], 0
            for i, (slug, own) in enumerate(zip(b["slug"].to_pylist(), b["own"].to_pylist())):
                text = "; ".join([known[k] for k in np.sort(b["others"][i].values.to_numpy()).tolist()]) or "-"
                out += [{"slug": slug, "name": x["name"], "alike": text} for x in own]
                size += len(text) * len(own)
                if size >= TEXT:
                    yield pa.RecordBatch.from_pylist(out, schema=as_written)
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=as_written)

    as_written = pa.schema([(c, pa.string()) for c in ("slug", "name", "alike")])
    every = t.select("slug", F.struct("name").alias("own"), F.array().cast("array<int>").alias("others"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism, -(-len(slugs) // ROWS))
    both = _block_pairs(t, len(slugs)).mapInArrow(pairs, schema).unionByName(every).repartition(parts, "slug")
    return both.groupBy("slug").agg(F.collect_list("own").alias("own"), F.flatten(F.collect_list("others")).alias("others")).mapInArrow(texts, "slug string, name string, alike string")


def decided(proposals: DataFrame, decisions: DataFrame) -> DataFrame:
    """Proposals with the reviewed decision on their unordered pair: accepted, related (rejected but kept as related), rejected, or pending."""
    pair = lambda x, y: F.array_sort(F.array(x, y))
    d = decisions.select(pair("a", "b").alias("_p"), F.lower(F.trim("decision")).alias("_d")).dropDuplicates(["_p"])
    status = F.when(F.col("_d") == "accept", "accepted").when(F.col("_d") == "reject_but_related", "related").when(F.col("_d").isNotNull(), "rejected").otherwise("pending")
    return proposals.withColumn("_p", pair("a", "b")).join(d, "_p", "left").select(*proposals.columns, status.alias("status"))


def dictionary(topics: DataFrame, proposals: DataFrame) -> DataFrame:
    """``slug, name, alike``: each topic with the topics proposed for it, '-' where there are none."""
    pair = lambda x, y: F.struct(F.col(x).alias("slug"), F.col(y).alias("o"))
    both = proposals.select(F.inline(F.array(pair("a", "b"), pair("b", "a"))))
    text = both.groupBy("slug").agg(F.array_join(F.array_sort(F.collect_set("o")), "; ").alias("alike"))
    return topics.select("slug", "name").join(text, "slug", "left").withColumn("alike", F.coalesce("alike", F.lit("-")))


def gold_labels(candidates: DataFrame, gold: DataFrame) -> DataFrame:
    """Label of each candidate (id, recording, at, key): accept where gold has its key at its time, accept_different (with the
    first other key) where gold has another one there, else reject."""
    exact = gold.select("recording", "at", "key").distinct().withColumn("_same", F.lit(1))
    other = gold.groupBy("recording", "at").agg(F.min(F.struct("n", "key"))["key"].alias("_other"))
    j = candidates.join(exact, ["recording", "at", "key"], "left").join(other, ["recording", "at"], "left")
    label = F.when(F.col("_same") == 1, "accept").when(F.col("_other").isNotNull(), "accept_different").otherwise("reject")
    return j.select("id", label.alias("label"), F.when(F.col("_same") == 1, F.col("key")).otherwise(F.col("_other")).alias("gold_key"))


def upsert(registry: DataFrame, topics: DataFrame, series: str) -> DataFrame:
    """``slug, name, series`` after the topics (``slug, name``) of a series: known slugs keep their name and gain the series, new ones are added.

    Of several names of a new slug the first by name is taken; a series already there isn't added again.
    """
    new = topics.where(F.col("slug").isNotNull()).groupBy("slug").agg(F.min("name").alias("_name"))
    both = registry.select("slug", "name", "series").join(new, "slug", "full_outer")
    grown = F.when(F.col("_name").isNull(), F.col("series")).otherwise(F.array_sort(F.array_union(F.coalesce("series", F.array().cast("array<string>")), F.array(F.lit(series)))))
    return both.select("slug", F.coalesce("name", "_name").alias("name"), grown.alias("series"))
