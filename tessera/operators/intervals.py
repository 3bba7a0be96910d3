"""Continuous periods and gaps of overlapping, nested and touching time spans.

Starts and ends are sorted independently per entity.  With ``s(i)`` the i-th smallest start and ``e(i)`` the i-th
smallest end, a gap lies between ``e(i)`` and ``s(i+1)`` exactly where ``s(i+1) > e(i)``; the boundaries around the
gaps, paired in order, are the periods.  In terms of ranks: at an instant ``t`` let S be the rank of the last start
<= t and E the rank of the last end <= t; a period ends at ``t`` iff an end lies there and S = E.

The ranks are computed without putting an entity into one task: boundaries are partitioned by (entity, time block),
ranked within the block, and the number of boundaries in earlier blocks (one row per block) is added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Width of a time block in ms: bounds the distinct instants that one window group can hold.
BLOCK_MS = 600_000


def millis(seconds: Column) -> Column:
    """Seconds times 1000, rounded to a bigint; null for null, NaN and infinite values."""
    ok = seconds.isNotNull() & ~F.isnan(seconds) & (F.abs(seconds) < F.lit(9e14))
    return F.when(ok, F.round(seconds * 1000).cast("bigint"))


def _ranked(bounds: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """``bounds`` with running totals ``r_<c>`` of ``cols`` over (keys, t), block by block."""
    group = [*keys, "_block"]
    inside = Window.partitionBy(*group).orderBy("t").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = bounds.select("*", *[F.sum(c).over(inside).alias(f"l_{c}") for c in cols])
    totals = bounds.groupBy(*group).agg(*[F.sum(c).alias(f"n_{c}") for c in cols])
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*group, *[F.coalesce(F.sum(f"n_{c}").over(before), F.lit(0)).alias(f"o_{c}") for c in cols])
    joined = local.join(offsets, group)
    return joined.select(*bounds.columns, *[(F.col(f"l_{c}") + F.col(f"o_{c}")).alias(f"r_{c}") for c in cols])


def periods_and_gaps(spans: DataFrame, keys: list[str], start: str, end: str, *, max_gap: int | None = None, block: int = BLOCK_MS) -> DataFrame:
    """Periods and gaps of integer spans ``[start, end]`` per ``keys``.

    Returns ``keys..., kind ('period' | 'gap'), from_ms, to_ms``.  Spans with a null bound, an end not after the start
    or a null key are left out; touching spans are continuous; repeated spans change nothing; an empty table gives an
    empty result; columns besides ``keys``, ``start`` and ``end`` are ignored.  Gaps longer than ``max_gap`` are no gaps.
    """
    named = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    ks = [f"_k{i}" for i in range(len(keys))]
    valid = F.col(end) > F.col(start)
    for k in keys:
        valid = valid & F.col(k).isNotNull()
    ends = F.array(F.struct(F.col(start).alias("t"), F.lit(1).alias("s"), F.lit(0).alias("e")), F.struct(F.col(end).alias("t"), F.lit(0).alias("s"), F.lit(1).alias("e")))
    bounds = (
        spans.where(valid).select(*named, F.inline(ends)).groupBy(*ks, "t").agg(F.sum("s").alias("s"), F.sum("e").alias("e"))
        .withColumn("_block", F.floor(F.col("t") / block)).repartition(*[F.col(c) for c in (*ks, "_block")])
    )
    open_after = F.col("r_s") - F.col("r_e")
    marks = (
        _ranked(bounds, ks, ["s", "e"])
        .select(*ks, "_block", "t", (open_after - F.col("s") + F.col("e") == 0).cast("int").alias("first"), (open_after == 0).cast("int").alias("last"))
        .where((F.col("first") == 1) | (F.col("last") == 1))
    )
    numbered = _ranked(marks, ks, ["first", "last"])
    # The n-th beginning belongs to period n and closes gap n - 1; the n-th ending closes period n and opens gap n.
    pieces = F.filter(
        F.array(
            F.struct(F.lit("period").alias("kind"), F.when(F.col("first") == 1, F.col("r_first")).alias("n"), F.col("t").alias("from_ms"), F.lit(None).cast("bigint").alias("to_ms")),
            F.struct(F.lit("gap").alias("kind"), F.when(F.col("first") == 1, F.col("r_first") - 1).alias("n"), F.lit(None).cast("bigint").alias("from_ms"), F.col("t").alias("to_ms")),
            F.struct(F.lit("period").alias("kind"), F.when(F.col("last") == 1, F.col("r_last")).alias("n"), F.lit(None).cast("bigint").alias("from_ms"), F.col("t").alias("to_ms")),
            F.struct(F.lit("gap").alias("kind"), F.when(F.col("last") == 1, F.col("r_last")).alias("n"), F.col("t").alias("from_ms"), F.lit(None).cast("bigint").alias("to_ms")),
        ),
        lambda x: x["n"].isNotNull(),
    )
    out = numbered.select(*ks, F.inline(pieces)).groupBy(*ks, "kind", "n").agg(F.max("from_ms").alias("from_ms"), F.max("to_ms").alias("to_ms")).where(F.col("from_ms").isNotNull() & F.col("to_ms").isNotNull())
    if max_gap is not None:
        out = out.where((F.col("kind") == "period") | (F.col("to_ms") - F.col("from_ms") <= max_gap))
    return out.select(*[F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)], "kind", "from_ms", "to_ms")
