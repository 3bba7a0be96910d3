"""Joins of time spans within an entity: overlap, best overlap, last start before."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_MS = 60_000
#: A span over more blocks than this is long, and meets others in blocks so many times as wide.
LONG_BLOCKS, WIDER = 64, 4_096


def overlap_join(left: DataFrame, right: DataFrame, key: str, l_start: str, l_end: str, r_start: str, r_end: str, *, block: int = BLOCK_MS) -> DataFrame:
    """Pairs of rows of one ``key`` whose spans (integers, in ms) share more than a boundary: l_start < r_end and r_start < l_end.

    Spans are put into every time block they touch and meet there; a pair is given only in the block where the later of
    the two starts lies, so once.  Long spans, should there be any, meet all others in wide blocks.  Spans with a null bound
    match nothing.  Columns of both sides must differ in name but for ``key``.
    """

    def blocks(df: DataFrame, s: str, e: str, width: int) -> DataFrame:
        lo, hi = F.floor(F.least(s, e) / width), F.floor(F.greatest(s, e) / width)
        return df.withColumn("_b", F.explode(F.sequence(lo, hi)))

    def meet(a: DataFrame, b: DataFrame, width: int) -> DataFrame:
        both = blocks(a, l_start, l_end, width).join(blocks(b, r_start, r_end, width), [key, "_b"])
        once = F.col("_b") == F.floor(F.greatest(F.col(l_start), F.col(r_start)) / width)
        return both.where((F.col(l_start) < F.col(r_end)) & (F.col(r_start) < F.col(l_end)) & once).drop("_b")

    def parted(df: DataFrame, s: str, e: str) -> tuple[DataFrame, DataFrame, bool]:
        there = df.where(F.col(s).isNotNull() & F.col(e).isNotNull())
        is_long = F.abs(F.col(e) - F.col(s)) > LONG_BLOCKS * block
        long = there.where(is_long)
        return there.where(~is_long), long, not long.isEmpty()

    short_l, long_l, any_l = parted(left, l_start, l_end)
    short_r, long_r, any_r = parted(right, r_start, r_end)
    out = meet(short_l, short_r, block)
    if any_l:
        out = out.unionByName(meet(long_l, short_r, block * WIDER))
    if any_r:
        out = out.unionByName(meet(short_l, long_r, block * WIDER))
    return out.unionByName(meet(long_l, long_r, block * WIDER)) if any_l and any_r else out


def best_overlap(pairs: DataFrame, left_id: str, right_id: str, l_start: str, l_end: str, r_start: str, r_end: str) -> DataFrame:
    """Of overlapping pairs the one that shares most time with each left row; of equal ones the smallest right id."""
    shared = F.least(l_end, r_end) - F.greatest(l_start, r_start)
    best = pairs.groupBy(left_id).agg(F.max(F.struct(shared.alias("ms"), (-F.col(right_id)).alias("neg"))).alias("_x"))
    return best.select(left_id, (-F.col("_x.neg")).alias(right_id), F.col("_x.ms").alias("shared_ms"))


def last_before(points: DataFrame, starts: DataFrame, key: str, point_id: str, at: str, start_id: str, start: str, *, block: int = 3_600_000) -> DataFrame:
    """For each point the row of its key with the last start at or before it; of equal starts the largest id.

    Within a time block both sides are ranked together; a point with no start before it in its block takes the last of
    the earlier blocks, of which there is one row per block.
    """
    from pyspark.sql import Window

    p = points.where(F.col(at).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("_k"), F.col(at).alias("_t"), F.col(point_id).alias("_p"), F.lit(None).cast("struct<t: bigint, id: bigint>").alias("_s"))
    s = starts.where(F.col(start).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("_k"), F.col(start).alias("_t"), F.lit(None).cast("bigint").alias("_p"), F.struct(F.col(start).cast("bigint").alias("t"), F.col(start_id).cast("bigint").alias("id")).alias("_s"))
    both = p.unionByName(s).withColumn("_b", F.floor(F.col("_t") / block)).repartition("_k", "_b")
    inside = Window.partitionBy("_k", "_b").orderBy("_t").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    local = both.withColumn("_last", F.max("_s").over(inside))
    before = Window.partitionBy("_k").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = both.groupBy("_k", "_b").agg(F.max("_s").alias("_m")).select("_k", "_b", F.max("_m").over(before).alias("_c"))
    out = local.where(F.col("_p").isNotNull()).join(carried, ["_k", "_b"]).withColumn("_x", F.coalesce("_last", "_c"))
    return out.where(F.col("_x").isNotNull()).select(F.col("_p").alias(point_id), F.col("_x.id").alias(start_id))


def nearest_span(left: DataFrame, right: DataFrame, key: str, left_id: str, right_id: str, l_start: str, l_end: str, r_start: str, r_end: str) -> DataFrame:
    """``left_id, right_id, shared_ms``: for each left row the right row of its key that shares most time with it or, where none
    does, the nearest one (the shared time is then the gap, negative or 0); of equal ones the smallest right id.

    Rows with a null bound or an end not after the start are left out on the right; on the left those with a null bound.
    """
    a = left.where(F.col(l_start).isNotNull() & F.col(l_end).isNotNull()).select(key, left_id, l_start, l_end)
    b = right.where(F.col(r_end) > F.col(r_start)).select(key, right_id, r_start, r_end)
    met = best_overlap(overlap_join(a, b, key, l_start, l_end, r_start, r_end), left_id, right_id, l_start, l_end, r_start, r_end)
    alone = a.join(met.select(left_id), left_id, "left_anti")
    # The latest end at or before the start, and the earliest start at or after the end (found with times turned round).
    ids = b.select(key, (-F.col(right_id)).alias("_n"), F.col(r_end).alias("_e"), (-F.col(r_start)).alias("_s"))
    before = last_before(alone, ids, key, left_id, l_start, "_n", "_e").join(b.select((-F.col(right_id)).alias("_n"), F.col(r_end).alias("_at")), "_n")
    after = last_before(alone.withColumn("_t", -F.col(l_end)), ids, key, left_id, "_t", "_n", "_s").join(b.select((-F.col(right_id)).alias("_n"), F.col(r_start).alias("_at")), "_n")
    gaps = before.join(alone, left_id).select(left_id, "_n", (F.col("_at") - F.col(l_start)).alias("shared_ms")).unionByName(after.join(alone, left_id).select(left_id, "_n", (F.col(l_end) - F.col("_at")).alias("shared_ms")))
    nearest = gaps.groupBy(left_id).agg(F.max(F.struct("shared_ms", "_n")).alias("_x")).select(left_id, (-F.col("_x._n")).alias(right_id), F.col("_x.shared_ms").alias("shared_ms"))
    return met.unionByName(nearest)
