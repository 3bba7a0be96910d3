"""Queries of the composed operators: replacement, topics, replay, retrieval traces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import ordered, ports, replacement, replay, topics
from tessera.operators.retrieval import knn
from tessera.plans import drivers
from tessera.plans.common import ENTITIES_SQL, REVIEWS_SQL, SEGMENTS_SQL, entities, reviews, segments, timed
from tessera.plans.spans import CHUNKS_SQL
from tessera.plans.scalars import topic_registry
from tessera.session import checkpoint, table

QUERIES, SQL = {}, {}


def _q(fn):
    QUERIES[fn.__name__] = fn
    return fn


@_q
def quotations_replaced(spark: SparkSession, d: str) -> DataFrame:
    """v2 segments in which a cited verse or dua is replaced by its canonical text."""
    e = entities(spark, d, "ayah", "dua")
    q = e.select("recording", F.col("entity_id").alias("n"), F.col("text").alias("fragment"), F.col("canonical_text").alias("canonical"))
    return replacement.replace_quotations(segments(spark, d, "v2"), q)


@_q
def validated_segments(spark: SparkSession, d: str) -> DataFrame:
    """v2 segments in which grounded verses and duas are replaced by their canonical text."""
    s = segments(spark, d, "v2").where(F.col("recording").isNotNull() & F.col("seq").isNotNull())
    return drivers.validate(entities(spark, d), s, table(spark, d, "canon"))[1].where(F.col("n_replaced") > 0).select("recording", "seq", "text", "n_replaced")


@_q
def validation_counts(spark: SparkSession, d: str) -> DataFrame:
    """Entities by kind, verdict and outcome of their grounding."""
    s = segments(spark, d, "v2").where(F.col("recording").isNotNull() & F.col("seq").isNotNull())
    return drivers.validate(entities(spark, d), s, table(spark, d, "canon"))[0].groupBy("etype", "verdict", "outcome").agg(F.count("*").alias("n"))


@_q
def topic_merge_proposals(spark: SparkSession, d: str) -> DataFrame:
    """Topics of like names, and whether they meet within a series or only across series."""
    p = topics.merge_proposals(topic_registry(spark, d), groups="series")
    return p.select("a", "b", "similarity", F.when(F.col("shared"), "within_series").otherwise("cross_series").alias("scope"))


@_q
def topic_dictionary(spark: SparkSession, d: str) -> DataFrame:
    """Each topic with those of like names."""
    return topics.alike(topic_registry(spark, d))


@_q
def gold_labels(spark: SparkSession, d: str) -> DataFrame:
    """Quoted verses labelled by the other mentions at their time (tenths of a second) in the recording."""
    e = entities(spark, d, "ayah").where(F.col("start_s").isNotNull() & F.col("recording").isNotNull()).select(F.col("entity_id").alias("id"), "recording", F.round(F.col("start_s") * 10).cast("bigint").alias("at"), F.concat_ws("_", "surah_number", "ayah_number").alias("key"), (F.lower(F.trim("usage")) == "quotation").alias("quoted"))
    return topics.gold_labels(e.where("quoted").select("id", "recording", "at", "key"), e.where("NOT quoted OR quoted IS NULL").select("recording", "at", "key", F.col("id").alias("n")))


SQL["gold_labels"] = f"""
    WITH {ENTITIES_SQL}, e AS (SELECT entity_id AS id, recording, CAST(round(start_s * 10) AS BIGINT) AS "at", concat_ws('_', surah_number, ayah_number) AS key, coalesce(lower(trim(usage)) = 'quotation', false) AS quoted FROM ents WHERE etype = 'ayah' AND start_s IS NOT NULL AND recording IS NOT NULL),
    o AS (SELECT recording, "at", min_by(key, id) AS other FROM e WHERE NOT quoted GROUP BY ALL), x AS (SELECT DISTINCT recording, "at", key FROM e WHERE NOT quoted)
    SELECT c.id, CASE WHEN x.key IS NOT NULL THEN 'accept' WHEN other IS NOT NULL THEN 'accept_different' ELSE 'reject' END AS label, CASE WHEN x.key IS NOT NULL THEN c.key ELSE other END AS gold_key
    FROM e c LEFT JOIN x ON c.recording = x.recording AND c."at" = x."at" AND c.key = x.key LEFT JOIN o ON c.recording = o.recording AND c."at" = o."at" WHERE quoted
"""


@_q
def character_mappings(spark: SparkSession, d: str) -> DataFrame:
    """Letters that the equivalence rules change in the v2 texts, by series."""
    s = segments(spark, d, "v2").where(F.col("text").isNotNull())
    n = s.select("series", F.explode(F.array(*[F.struct(F.lit(f"U+{ord(c):04X}").alias("letter"), F.regexp_count("text", F.lit(c)).alias("n")) for c in T.EQUIVALENT])).alias("x"))
    return n.groupBy("series", "x.letter").agg(F.sum("x.n").alias("n")).where(F.col("n") > 0)


SQL["character_mappings"] = f"""
    WITH {SEGMENTS_SQL}, r AS (SELECT * FROM (VALUES {", ".join(f"('U+{ord(c):04X}', '{c}')" for c in T.EQUIVALENT)}) AS v(letter, c))
    SELECT series, letter, CAST(sum(length(text) - length(replace(text, c, ''))) AS BIGINT) AS n FROM segs, r WHERE version = 'v2' AND text IS NOT NULL GROUP BY series, letter HAVING n > 0
"""


@_q
def replay_plans(spark: SparkSession, d: str) -> DataFrame:
    """Review actions from v2 to v3 by recording and kind."""
    side = lambda v: timed(segments(spark, d, v)).select("recording", "seq", "start_ms", "end_ms", "text")
    new = side("v3")
    old = side("v2").join(new.select("recording").distinct(), "recording", "left_semi")
    p = replay.plans(old, new)
    return p.select("recording", F.explode("actions").alias("a")).groupBy("recording", F.get_json_object("a", "$.op").alias("op")).agg(F.count("*").alias("n"))


@_q
def replay_exact(spark: SparkSession, d: str) -> DataFrame:
    """By recording the segments of v2 and v3 with a span, and whether the planned actions, taken on the one, give the other."""
    side = lambda v: timed(segments(spark, d, v)).select("recording", "seq", "start_ms", "end_ms", "text")
    new = side("v3")
    old = side("v2").join(new.select("recording").distinct(), "recording", "left_semi")
    return replay.plans(old, new).groupBy("recording").agg(F.sum("n_old").alias("n_v2"), F.sum("n_new").alias("n_v3"), F.every("exact").alias("exact"))


SQL["replay_exact"] = f"""
    WITH {SEGMENTS_SQL}, s AS (SELECT recording, version FROM segs WHERE version IN ('v2', 'v3') AND CAST(round(end_s * 1000) AS BIGINT) > CAST(round(start_s * 1000) AS BIGINT))
    SELECT recording, count(*) FILTER (version = 'v2') AS n_v2, count(*) FILTER (version = 'v3') AS n_v3, true AS exact FROM s WHERE recording IN (SELECT recording FROM segs WHERE version = 'v3') GROUP BY recording
"""


@_q
def entity_replay(spark: SparkSession, d: str) -> DataFrame:
    """What a reviewer does with the quotations of each recording to come to all its citations of complete extent, by kind of action."""
    e = entities(spark, d, "ayah", "dua", "hadith").where(F.col("recording").isNotNull()).select("recording", "etype", F.coalesce(F.when(F.col("etype") == "ayah", F.concat_ws(":", "surah_number", "ayah_number")).otherwise(F.col("reference")), F.lit("")).alias("key"), T.half_even(F.coalesce("start_s", F.lit(0.0)), F.lit(1)).alias("at"), "entity_id", "text", "extent", F.lower(F.trim("usage")).alias("use"))
    found, wanted = e.where(F.col("use") == "quotation"), e.where(F.lower(F.trim("extent")) == "complete")
    moves = replay.entity_moves(found, wanted, ["recording", "etype", "key", "at"], "entity_id", F.col("f_text").eqNullSafe(F.col("w_text")))
    return moves.groupBy("recording", "etype", "move").agg(F.count("*").alias("n"))


SQL["entity_replay"] = f"""
    WITH {ENTITIES_SQL}, e AS (SELECT recording, etype, coalesce(CASE WHEN etype = 'ayah' THEN concat_ws(':', surah_number, ayah_number) ELSE reference END, '') AS key, CAST(printf('%.1f', coalesce(start_s, 0.0)) AS DOUBLE) AS t, entity_id, text, lower(trim(extent)) AS extent, lower(trim(usage)) AS use
        FROM ents WHERE etype IN ('ayah', 'dua', 'hadith') AND recording IS NOT NULL),
    f AS (SELECT *, row_number() OVER (PARTITION BY recording, etype, key, t ORDER BY entity_id) AS n FROM e WHERE use = 'quotation'), w AS (SELECT *, row_number() OVER (PARTITION BY recording, etype, key, t ORDER BY entity_id) AS n FROM e WHERE extent = 'complete')
    SELECT coalesce(f.recording, w.recording) AS recording, coalesce(f.etype, w.etype) AS etype, CASE WHEN w.n IS NULL THEN 'reject' WHEN f.n IS NULL THEN 'add' WHEN f.text IS NOT DISTINCT FROM w.text THEN 'accept' ELSE 'edit' END AS move, count(*) AS n
    FROM f FULL JOIN w ON f.recording = w.recording AND f.etype = w.etype AND f.key = w.key AND f.t = w.t AND f.n = w.n GROUP BY 1, 2, 3
"""


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    c = ordered.chunks(segments(spark, d, "v2"))
    n = ordered.running(c.withColumn("_one", F.lit(1)), ["recording"], ["chunk_start", "chunk_end"], F.floor(F.col("chunk_start") / 3600), {"_no": ("sum", "_one")})
    return n.select(*c.columns, F.format_string("%s_chunk_%04d", "recording", F.col("_no").cast("bigint")).alias("chunk_id"))


@_q
def cited_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks that each review cites, in the order cited, with their time; null where there is none of that name."""
    r = reviews(spark, d).select("review_id", F.posexplode("cited_chunk_ids").alias("n", "chunk_id"))
    return r.join(_chunks(spark, d).select("chunk_id", "chunk_start", "chunk_end"), "chunk_id", "left").select("review_id", "n", "chunk_id", F.round("chunk_start", 3).alias("chunk_start"), F.round("chunk_end", 3).alias("chunk_end"))


SQL["cited_chunks"] = f"""
    WITH RECURSIVE {CHUNKS_SQL}, {REVIEWS_SQL}, k AS (SELECT *, recording || '_chunk_' || lpad(CAST(row_number() OVER (PARTITION BY recording ORDER BY chunk_start, chunk_end) - 1 AS VARCHAR), 4, '0') AS chunk_id FROM chunks),
    r AS (SELECT review_id, unnest(cited_chunk_ids) AS chunk_id, CAST(generate_subscripts(cited_chunk_ids, 1) - 1 AS INTEGER) AS n FROM revs)
    SELECT review_id, n, r.chunk_id, round(chunk_start, 3) AS chunk_start, round(chunk_end, 3) AS chunk_end FROM r LEFT JOIN k ON r.chunk_id = k.chunk_id
"""


@_q
def retrieval_traces(spark: SparkSession, d: str) -> DataFrame:
    """Ten nearest chunks of every twentieth question's key against all chunks, the four best reranked, and the prompt's context."""
    # Chunks are made and embedded once; their numbers are those of their names in order.
    named_chunks = checkpoint(_chunks(spark, d).select("chunk_id", "chunk_start", "text").withColumn("v", ports.embed(F.col("text"))))
    chunks = checkpoint(named_chunks.withColumn("vec_id", F.monotonically_increasing_id()))
    asked = checkpoint(table(spark, d, "questions").where((F.col("q_key") % 20 == 0) & (F.trim("question") != "")).select((-F.col("q_key") - 1).alias("vec_id"), "question").withColumn("v", ports.embed(F.col("question"))))
    near = knn(asked, chunks, "vec_id", "v", 10)
    named = checkpoint(near.join(chunks.select(F.col("vec_id").alias("neighbour_id"), "chunk_id", "chunk_start", "text"), "neighbour_id").join(asked.select(F.col("vec_id").alias("query_id"), "question"), "query_id"))
    best = ports.rerank(named.select("query_id", "question", "chunk_id", "text", "rank"))
    j = best.join(named.select("query_id", "chunk_id", "chunk_start", "text", F.round("score", 4).alias("similarity")), ["query_id", "chunk_id"])
    part = F.struct("new_rank", "chunk_id", "rank", "similarity", "score", "status", ports.context(F.col("chunk_id"), F.col("chunk_start"), F.col("text")).alias("context"))
    t = j.groupBy((-F.col("query_id") - 1).alias("q_key")).agg(F.array_sort(F.collect_list(part)).alias("sent"))
    return t.select("q_key", "sent", F.array_join(F.transform("sent", lambda x: x["context"]), "\n\n").alias("context"))
