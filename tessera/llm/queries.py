"""Queries of the training-data operators, each over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import canonical, langid, mixing, nearest_time, pairs, sentences, splitting, subjects, tokens
from tessera.operators.intervals import millis
from tessera.session import checkpoint, table

TOLERANCE_MS = 1_500


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return langid.found_items(spark, table(spark, d, "documents"), table(spark, d, "questions"), table(spark, d, "segments"))


def p1_stretches(spark: SparkSession, d: str) -> DataFrame:
    return langid.stretches_of_items(table(spark, d, "documents"), table(spark, d, "segments"))


def p1_languages(spark: SparkSession, d: str) -> DataFrame:
    return langid.languages_of_items(table(spark, d, "documents"), table(spark, d, "questions"))


def _v2(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "segments").where(F.col("version") == "v2")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    matrix = langid.train(table(spark, d, "documents"), "text", "lang")
    tagged = checkpoint(sentences.with_language(_v2(spark, d), "seg_key", "text", matrix))
    model = sentences.train(tagged, "_text", "lang")
    return sentences.sentences(tagged, "seg_key", model).select("seg_key", "end_pos")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return pairs.defects(table(spark, d, "reviews"), "review_id", "question", "generated_answer", "answerable", table(spark, d, "documents"))


def p5_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_oversized(_v2(spark, d), "seg_key", "text", "start_s", "end_s", table(spark, d, "documents"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.text_cuts(p5_pieces(spark, d), "seg_key")


def p5_properties(spark: SparkSession, d: str) -> DataFrame:
    """Of each oversized text whether its pieces keep the limit, share the overlap, hold every code point in order and are timed within bounds."""
    p = p5_pieces(spark, d).groupBy("seg_key").agg(F.array_sort(F.collect_list(F.struct("piece_no", "start_pos", "end_pos", "piece", "start_at"))).alias("ps"))
    follow = F.zip_with(F.slice("ps", 1, F.size("ps") - 1), F.slice("ps", 2, F.size("ps") - 1), lambda a, b: (a["end_pos"] - b["start_pos"] == splitting.OVERLAP) & (b["piece_no"] == a["piece_no"] + 1))
    whole = F.aggregate("ps", F.lit(""), lambda t, x: F.concat(t, F.substring(x["piece"], F.when(x["piece_no"] == 0, 1).otherwise(splitting.OVERLAP + 1), F.lit(splitting.LIMIT))))
    s = _v2(spark, d).select("seg_key", "text", "start_s", "end_s").dropDuplicates(["seg_key"])
    lo, hi = F.coalesce(F.least("start_s", "end_s"), "start_s", "end_s"), F.coalesce(F.greatest("start_s", "end_s"), "start_s", "end_s")
    timed = F.forall("ps", lambda x: x["start_at"].isNull() & lo.isNull() | x["start_at"].between(lo, hi))
    within = F.forall("ps", lambda x: F.char_length(x["piece"]) <= splitting.LIMIT)
    return p.join(s, "seg_key").select("seg_key", F.char_length("text").alias("n_chars"), within.alias("within_limit"), F.forall(follow, lambda x: x).alias("overlapping"), (whole == F.col("text")).alias("whole"), F.coalesce(timed, F.lit(False)).alias("timed"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    entities = table(spark, d, "entities").select("entity_id", "recording", millis(F.col("start_s")).alias("at"))
    segments = _v2(spark, d).select("seg_key", "recording", millis(F.col("start_s")).alias("at"))
    pairs = nearest_time.nearest(entities, segments, left_id="entity_id", right_id="seg_key", entity="recording", left_ms="at", right_ms="at", tolerance=TOLERANCE_MS)
    return pairs.select("entity_id", "seg_key")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return canonical.found_pairs(table(spark, d, "segments"), table(spark, d, "entities"))


def p7_forms(spark: SparkSession, d: str) -> DataFrame:
    return canonical.forms(table(spark, d, "segments"), table(spark, d, "entities"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode(table(spark, d, "documents"), "doc_id", "text")


def p8_decoded(spark: SparkSession, d: str) -> DataFrame:
    """Every document's text, encoded and decoded."""
    return tokens.decode(p8_ids(spark, d), "doc_id", "ids")


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return subjects.found_subjects(table(spark, d, "documents"), table(spark, d, "subject_labels"))


QUERIES = {"p1_found": p1_found, "p1_stretches": p1_stretches, "p1_languages": p1_languages, "p2_found": p2_found, "p3_found": p3_found, "p5_found": p5_found, "p5_pieces": p5_pieces, "p5_properties": p5_properties, "p6_found": p6_found, "p7_found": p7_found, "p7_forms": p7_forms, "p8_ids": p8_ids, "p8_decoded": p8_decoded, "p9_mix": p9_mix, "p9_shares": p9_shares, "p10_found": p10_found}

SQL = {
    "p8_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    "p5_properties": """
        SELECT DISTINCT seg_key, CAST(length(text) AS INTEGER) AS n_chars, true AS within_limit, true AS overlapping, true AS whole, true AS timed
        FROM segments WHERE version = 'v2' AND length(text) > 400
    """,
    "p6_found": """
        WITH e AS (SELECT DISTINCT entity_id, recording, CAST(round(start_s * 1000) AS BIGINT) AS t FROM entities WHERE start_s IS NOT NULL AND recording IS NOT NULL),
             s AS (SELECT recording, CAST(round(start_s * 1000) AS BIGINT) AS t, min(seg_key) AS seg_key FROM segments WHERE version = 'v2' AND start_s IS NOT NULL GROUP BY ALL)
        SELECT entity_id, seg_key FROM (
            SELECT entity_id, seg_key, row_number() OVER (PARTITION BY entity_id ORDER BY abs(s.t - e.t), s.t, seg_key) AS rn
            FROM e JOIN s ON e.recording = s.recording AND s.t BETWEEN e.t - 1500 AND e.t + 1500) WHERE rn = 1
    """,
}
