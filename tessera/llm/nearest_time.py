"""Nearest record in time of the same entity within a tolerance.

Rows are hash-partitioned by (entity, time block) into Arrow groups; inside each, DuckDB joins the nearest earlier and
the nearest later record (ASOF), and the nearer one within the tolerance is kept.  Records near the edge of a block are
also put into the neighbouring block, so no pair is lost and a hot entity is spread over its blocks.  The records of one
instant are combined before the shuffle, and so are the query instants, so a block holds at most two rows an instant.
The number of groups grows with the rows, about GROUP_ROWS each.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_MS = 120_000
#: Rows that a group has on average at most.
GROUP_ROWS = 50_000


def _asof(t: pa.Table) -> pa.Table:
    import duckdb

    con = duckdb.connect(config={"threads": 1, "memory_limit": "512MB", "temp_directory": ""})
    try:
        con.register("rows_", t)
        out = con.sql("""
            WITH l AS (SELECT _k, _b, _t FROM rows_ WHERE _id IS NULL),
                 r AS (SELECT _k, _b, _t, _id FROM rows_ WHERE _id IS NOT NULL),
                 back AS (SELECT l._k, l._b, l._t, r._t AS t, r._id AS id FROM l ASOF LEFT JOIN r ON l._k = r._k AND l._b = r._b AND l._t >= r._t),
                 fore AS (SELECT l._k, l._b, l._t, r._t AS t, r._id AS id FROM l ASOF LEFT JOIN r ON l._k = r._k AND l._b = r._b AND l._t <= r._t)
            SELECT b._k, b._t,
                   CASE WHEN f.t IS NULL OR (b.t IS NOT NULL AND b._t - b.t <= f.t - f._t) THEN b.id ELSE f.id END AS _id,
                   CASE WHEN f.t IS NULL OR (b.t IS NOT NULL AND b._t - b.t <= f.t - f._t) THEN b.t ELSE f.t END AS _rt
            FROM back b JOIN fore f ON b._k = f._k AND b._b = f._b AND b._t = f._t
        """).to_arrow_table()
    finally:
        con.close()
    return out.cast(pa.schema([("_k", pa.string()), ("_t", pa.int64()), ("_id", pa.int64()), ("_rt", pa.int64())]))


def nearest(left: DataFrame, right: DataFrame, *, left_id: str, right_id: str, entity: str, left_ms: str, right_ms: str, tolerance: int, block: int = BLOCK_MS) -> DataFrame:
    """``left_id, right_id, distance_ms`` of every left row with a right row at most ``tolerance`` ms away.

    Of equally near records the earlier, then the smaller id.  Rows with a null entity or time are left out; repeated
    rows count once; an empty side gives an empty result.  ``left_id`` and ``right_id`` must be integers and differ in
    name.
    """
    asked = left.where(F.col(entity).isNotNull() & F.col(left_ms).isNotNull() & F.col(left_id).isNotNull()).select(F.col(left_id).alias("_lid"), F.col(entity).cast("string").alias("_k"), F.col(left_ms).alias("_t")).distinct()
    block_of = lambda t: F.floor(t / block)
    points = asked.groupBy("_k", "_t").agg(F.lit(None).cast("bigint").alias("_id")).withColumn("_b", block_of(F.col("_t")))
    there = right.where(F.col(entity).isNotNull() & F.col(right_ms).isNotNull()).groupBy(F.col(entity).cast("string").alias("_k"), F.col(right_ms).alias("_t")).agg(F.min(right_id).cast("bigint").alias("_id"))
    near = F.array_distinct(F.array(block_of(F.col("_t") - tolerance), block_of(F.col("_t")), block_of(F.col("_t") + tolerance)))
    both = points.select("_k", "_t", "_id", "_b").unionByName(there.select("_k", "_t", "_id", F.explode(near).alias("_b")))
    spark = left.sparkSession
    groups = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(left.count() + 2 * right.count()) // GROUP_ROWS))
    grouped = both.withColumn("_g", F.pmod(F.xxhash64("_k", "_b"), F.lit(groups)))
    found = grouped.groupBy("_g").applyInArrow(lambda t: _asof(t.drop_columns(["_g"])), "_k string, _t bigint, _id bigint, _rt bigint").where(F.col("_id").isNotNull() & (F.abs(F.col("_rt") - F.col("_t")) <= tolerance))
    return asked.join(found, ["_k", "_t"]).select(F.col("_lid").alias(left_id), F.col("_id").alias(right_id), F.abs(F.col("_rt") - F.col("_t")).alias("distance_ms"))
