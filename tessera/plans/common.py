"""Tables of the project with every key once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.intervals import millis
from tessera.session import table

#: The same in SQL, for the queries' oracles.
SEGMENTS_SQL = "segs AS (SELECT DISTINCT ON (seg_key) * FROM segments)"
ENTITIES_SQL = "ents AS (SELECT DISTINCT ON (entity_id) * FROM entities)"
REVIEWS_SQL = "revs AS (SELECT DISTINCT ON (review_id) * FROM reviews)"


def segments(spark: SparkSession, d: str, *versions: str) -> DataFrame:
    t = table(spark, d, "segments")
    return (t.where(F.col("version").isin(*versions)) if versions else t).dropDuplicates(["seg_key"])


def entities(spark: SparkSession, d: str, *kinds: str) -> DataFrame:
    t = table(spark, d, "entities")
    return (t.where(F.col("etype").isin(*kinds)) if kinds else t).dropDuplicates(["entity_id"])


def reviews(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "reviews").dropDuplicates(["review_id"])


def timed(df: DataFrame, start: str = "start_ms", end: str = "end_ms") -> DataFrame:
    return df.withColumn(start, millis(F.col("start_s"))).withColumn(end, millis(F.col("end_s")))


def words_sql(column: str) -> str:
    """The words of a column as a list, parted by any Unicode white space."""
    return f"list_filter(string_split_regex(coalesce({column}, ''), '[\\s\\x0b\\x{{85}}\\p{{Z}}]+'), lambda w: w <> '')"
