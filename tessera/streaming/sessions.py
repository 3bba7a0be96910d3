"""Streams: new segment files as they come, and activity sessions with a watermark (an extension to the batch operators)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GAP, LATE = "10 minutes", "1 hour"


def activity(events: DataFrame, *, key: str = "user_id", ts: str = "ts", gap: str = GAP, late: str = LATE) -> DataFrame:
    """Sessions of each key: events less than ``gap`` apart; for streams and tables alike.

    On a stream a session is given out once the watermark (``late`` behind the latest event) has passed its end.
    """
    timed = events.select(F.col(key), F.col(ts).cast("timestamp").alias("_ts")).where(F.col(key).isNotNull())
    if events.isStreaming:
        timed = timed.withWatermark("_ts", late)
    return timed.groupBy(key, F.session_window("_ts", gap).alias("w")).agg(F.count("*").alias("n_events"), F.min("_ts").alias("first_ts"), F.max("_ts").alias("last_ts")).drop("w")


def segment_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of segment tables that are added to a folder; copies delivered within the watermark count once."""
    rows = spark.readStream.schema(schema).parquet(path)
    return rows.withColumn("_at", F.col("ingested_at").cast("timestamp")).withWatermark("_at", LATE).dropDuplicatesWithinWatermark(["seg_key"]).drop("_at")


def review_stream(actions: DataFrame) -> DataFrame:
    """State of review sessions as their actions (``session, n, action``) come in: ``session, applied, refused, n_segments, open_flags, finalized``.

    The log of each session is kept as state and folded again with what is new, so actions that arrive out of order take
    their place; a row is given for every session that has new actions.
    """
    import pandas as pd

    from tessera.operators.review import _played

    def run(key, frames, state):
        log = dict(zip(*state.get)) if state.exists else {}
        for pdf in frames:
            log.update(zip(map(int, pdf["n"]), pdf["action"]))
        order = sorted(log)
        state.update(([*order], [log[n] for n in order]))
        s, applied, refused = _played(log[n] for n in order)
        yield pd.DataFrame([(key[0], applied, refused, len(s.segments), len(s.blockers()), s.finalized)], columns=["session", "applied", "refused", "n_segments", "open_flags", "finalized"])

    rows = actions.where(F.col("session").isNotNull()).select("session", F.col("n").cast("long").alias("n"), "action")
    return rows.groupBy("session").applyInPandasWithState(run, "session string, applied int, refused int, n_segments int, open_flags int, finalized boolean", "ns array<long>, actions array<string>", "update", "NoTimeout")
