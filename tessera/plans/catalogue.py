"""Queries of what there is and where it lies: totals, languages, look-ups, places of entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators.spans import last_before, nearest_span, overlap_join
from tessera.plans.common import ENTITIES_SQL, SEGMENTS_SQL, entities, segments, timed
from tessera.session import table

QUERIES, SQL = {}, {}


def _q(fn):
    QUERIES[fn.__name__] = fn
    return fn


@_q
def released_totals(spark: SparkSession, d: str) -> DataFrame:
    """By series the recordings, those reviewed, their hours, segments and entities; and over all."""
    s = segments(spark, d, "v3").groupBy("recording").agg(F.count("*").alias("n_segments"))
    e = entities(spark, d).groupBy("recording").agg(F.count("*").alias("n_entities"))
    r = table(spark, d, "recordings").join(s, "recording", "left").join(e, "recording", "left")
    sums = r.rollup("series").agg(F.count("*").alias("n_recordings"), F.count("n_segments").alias("n_reviewed"), F.round(F.sum("duration_s") / 3600, 4).alias("hours"), F.sum("n_segments").alias("n_segments"), F.sum("n_entities").alias("n_entities"), F.grouping("series").alias("g"))
    return sums.select(F.when(F.col("g") == 1, "ALL").otherwise(F.col("series")).alias("series"), "n_recordings", "n_reviewed", "hours", "n_segments", "n_entities")


SQL["released_totals"] = f"""
    WITH {SEGMENTS_SQL}, {ENTITIES_SQL}, s AS (SELECT recording, count(*) AS n FROM segs WHERE version = 'v3' GROUP BY ALL), e AS (SELECT recording, count(*) AS n FROM ents GROUP BY ALL)
    SELECT CASE WHEN grouping(series) = 1 THEN 'ALL' ELSE series END AS series, count(*) AS n_recordings, count(s.n) AS n_reviewed, round(sum(duration_s) / 3600, 4) AS hours, CAST(sum(s.n) AS BIGINT) AS n_segments, CAST(sum(e.n) AS BIGINT) AS n_entities
    FROM recordings r LEFT JOIN s ON r.recording = s.recording LEFT JOIN e ON r.recording = e.recording GROUP BY ROLLUP (series)
"""


@_q
def lecture_languages(spark: SparkSession, d: str) -> DataFrame:
    """Language of each recording: its label, else the one most of its questions are labelled with (the first by name of several), else null."""
    q = table(spark, d, "questions").where(F.trim("question_language") != "").groupBy("recording", F.lower(F.trim("question_language")).alias("l")).agg(F.count("*").alias("n"))
    most = q.groupBy("recording").agg(F.min(F.struct((-F.col("n")).alias("n"), "l"))["l"].alias("asked"))
    r = table(spark, d, "recordings").join(most, "recording", "left")
    return r.select("recording", F.coalesce("lang_label", "asked").alias("language"), F.when(F.col("lang_label").isNotNull(), "label").when(F.col("asked").isNotNull(), "questions").alias("source"))


SQL["lecture_languages"] = """
    WITH q AS (SELECT recording, lower(trim(question_language, ' ')) AS l, count(*) AS n FROM questions WHERE trim(question_language, ' ') <> '' GROUP BY ALL), m AS (SELECT recording, l AS asked FROM q QUALIFY row_number() OVER (PARTITION BY recording ORDER BY n DESC, l) = 1)
    SELECT r.recording, coalesce(lang_label, asked) AS language, CASE WHEN lang_label IS NOT NULL THEN 'label' WHEN asked IS NOT NULL THEN 'questions' END AS source FROM recordings r LEFT JOIN m ON r.recording = m.recording
"""


@_q
def entity_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Each entity with its canonical text and translation by type, whether it was found, and why not."""
    e = entities(spark, d)
    key = F.when(F.col("etype") == "dua", F.col("reference")).when(F.col("etype") == "ayah", T.verse_key_of("surah_number", "ayah_number"))
    c = table(spark, d, "canon").select(F.col("kind").alias("etype"), F.col("canon_key").alias("k"), F.col("text").alias("canon"), F.col("en_text").alias("translation"))
    j = e.select("entity_id", "etype", "reference", key.alias("k")).join(c, ["etype", "k"], "left")
    hadith = T.collection_id("reference")
    message = (
        F.when(F.col("canon").isNotNull(), None).when(~F.col("etype").isin("ayah", "dua", "hadith"), "no corpus for this type").when((F.col("etype") == "hadith") & hadith.isNull(), "not in a known collection")
        .when(F.col("etype") == "hadith", "no corpus given").when(F.col("k").isNull(), "no single reference").otherwise("not in the corpus")
    )
    return j.select("entity_id", "etype", F.col("canon").isNotNull().alias("found"), F.char_length("canon").alias("n_chars"), F.char_length("translation").alias("n_translated"), message.alias("message"))


SQL["entity_lookup"] = f"""
    WITH {ENTITIES_SQL}, e AS (SELECT entity_id, etype, reference, CASE WHEN etype = 'dua' THEN reference WHEN etype = 'ayah' AND TRY_CAST(surah_number AS INTEGER) IS NOT NULL AND TRY_CAST(ayah_number AS INTEGER) IS NOT NULL THEN format('CH{{:03d}}_V{{:03d}}', TRY_CAST(surah_number AS INTEGER), TRY_CAST(ayah_number AS INTEGER)) END AS k FROM ents)
    SELECT entity_id, etype, c.text IS NOT NULL AS found, CAST(length(c.text) AS INTEGER) AS n_chars, CAST(length(c.en_text) AS INTEGER) AS n_translated,
        CASE WHEN c.text IS NOT NULL THEN NULL WHEN etype NOT IN ('ayah', 'dua', 'hadith') THEN 'no corpus for this type' WHEN etype = 'hadith' AND NOT coalesce(regexp_full_match(upper(reference), '({"|".join((*T.COLLECTIONS, *T.COLLECTION_ALIASES))})_\\d+'), false) THEN 'not in a known collection'
            WHEN etype = 'hadith' THEN 'no corpus given' WHEN k IS NULL THEN 'no single reference' ELSE 'not in the corpus' END AS message
    FROM e LEFT JOIN canon c ON c.kind = e.etype AND c.canon_key = e.k
"""


@_q
def cited_hadith(spark: SparkSession, d: str) -> DataFrame:
    """Distinct hadith cited, over all recordings, with the number of recordings that cite each."""
    e = entities(spark, d, "hadith").where(F.trim("reference") != "")
    return e.groupBy(F.upper(F.trim("reference")).alias("reference")).agg(F.count_distinct("recording").alias("n_recordings"))


SQL["cited_hadith"] = f"WITH {ENTITIES_SQL} SELECT upper(trim(reference, ' ')) AS reference, count(DISTINCT recording) AS n_recordings FROM ents WHERE etype = 'hadith' AND trim(reference, ' ') <> '' GROUP BY 1"


@_q
def panel_segments(spark: SparkSession, d: str) -> DataFrame:
    """The v2 segment that each citation is shown at: the last that starts at or before it, else the first of its recording."""
    e = timed(entities(spark, d, "ayah", "dua", "hadith")).where(F.col("recording").isNotNull()).select("recording", "entity_id", F.coalesce("start_ms", F.lit(0)).alias("at"))
    s = timed(segments(spark, d, "v2")).where(F.col("start_ms").isNotNull()).select("recording", "seg_key", "start_ms")
    got = last_before(e, s, "recording", "entity_id", "at", "seg_key", "start_ms")
    first = s.groupBy("recording").agg(F.min(F.struct("start_ms", "seg_key"))["seg_key"].alias("_first"))
    return e.join(got, "entity_id", "left").join(first, "recording").select("entity_id", F.coalesce("seg_key", "_first").alias("seg_key"))


SQL["panel_segments"] = f"""
    WITH {SEGMENTS_SQL}, {ENTITIES_SQL}, e AS (SELECT entity_id, recording, coalesce(CAST(round(start_s * 1000) AS BIGINT), 0) AS t FROM ents WHERE etype IN ('ayah', 'dua', 'hadith') AND recording IS NOT NULL),
    s0 AS (SELECT recording, CAST(round(start_s * 1000) AS BIGINT) AS t, seg_key FROM segs WHERE version = 'v2' AND start_s IS NOT NULL), s AS (SELECT recording, t, max(seg_key) AS seg_key FROM s0 GROUP BY ALL), f AS (SELECT recording, arg_min(seg_key, (t, seg_key)) AS first FROM s0 GROUP BY recording)
    SELECT entity_id, coalesce(s.seg_key, f.first) AS seg_key FROM e ASOF LEFT JOIN s ON e.recording = s.recording AND e.t >= s.t JOIN f ON f.recording = e.recording
"""


@_q
def panel_topics(spark: SparkSession, d: str) -> DataFrame:
    """Topics and the v2 segments they are shown on: all that share time with them; a topic without length those that hold its instant, edges included."""
    e = timed(entities(spark, d, "topic"), "e_start", "e_end").withColumn("e_start", F.coalesce("e_start", F.lit(0))).withColumn("e_end", F.coalesce("e_end", "e_start")).select("recording", "entity_id", "e_start", "e_end")
    s = timed(segments(spark, d, "v2"), "a", "b").where(F.col("a").isNotNull() & F.col("b").isNotNull()).select("recording", "seg_key", F.least("a", "b").alias("s_start"), F.greatest("a", "b").alias("s_end"))
    point = F.col("e_start") == F.col("e_end")
    # An instant, edges included, is a span of one ms more on both sides in whole ms.
    spans = e.select("recording", "entity_id", F.when(point, F.col("e_start") - 1).otherwise(F.col("e_start")).alias("e_start"), F.when(point, F.col("e_end") + 1).otherwise(F.col("e_end")).alias("e_end"))
    return overlap_join(spans, s, "recording", "e_start", "e_end", "s_start", "s_end").select("entity_id", "seg_key")


SQL["panel_topics"] = f"""
    WITH {SEGMENTS_SQL}, {ENTITIES_SQL}, e AS (SELECT entity_id, recording, coalesce(CAST(round(start_s * 1000) AS BIGINT), 0) AS a, CAST(round(end_s * 1000) AS BIGINT) AS b0 FROM ents WHERE etype = 'topic'), t AS (SELECT *, coalesce(b0, a) AS b FROM e),
    s AS (SELECT recording, seg_key, CAST(round(least(start_s, end_s) * 1000) AS BIGINT) AS lo, CAST(round(greatest(start_s, end_s) * 1000) AS BIGINT) AS hi FROM segs WHERE version = 'v2' AND start_s IS NOT NULL AND end_s IS NOT NULL)
    SELECT entity_id, seg_key FROM t JOIN s ON t.recording = s.recording AND ((a < hi AND b > lo) OR (a = b AND a BETWEEN lo AND hi))
"""


@_q
def nearest_segment_span(spark: SparkSession, d: str) -> DataFrame:
    """The v2 segment that shares most time with each entity, or is nearest where none does."""
    e = timed(entities(spark, d), "e_start", "e_end").where(F.col("e_end") > F.col("e_start")).select("recording", "entity_id", "e_start", "e_end")
    s = timed(segments(spark, d, "v2"), "s_start", "s_end").select("recording", "seg_key", "s_start", "s_end")
    return nearest_span(e, s, "recording", "entity_id", "seg_key", "e_start", "e_end", "s_start", "s_end")


SQL["nearest_segment_span"] = f"""
    WITH {SEGMENTS_SQL}, {ENTITIES_SQL}, e AS (SELECT recording, entity_id, CAST(round(start_s * 1000) AS BIGINT) AS a, CAST(round(end_s * 1000) AS BIGINT) AS b FROM ents), s AS (SELECT recording, seg_key, CAST(round(start_s * 1000) AS BIGINT) AS c, CAST(round(end_s * 1000) AS BIGINT) AS d FROM segs WHERE version = 'v2')
    SELECT entity_id, seg_key, least(b, d) - greatest(a, c) AS shared_ms FROM e JOIN s ON e.recording = s.recording AND b > a AND d > c QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY shared_ms DESC, seg_key) = 1
"""
