"""Queries over time and order: overlaps, as-of joins, sequences, chunks, gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import ordered
from tessera.operators.intervals import millis, periods_and_gaps
from tessera.operators.spans import best_overlap, last_before, overlap_join
from tessera.plans.common import ENTITIES_SQL, SEGMENTS_SQL, entities, segments, timed, words_sql
from tessera.session import table
from tessera.streaming.sessions import activity

QUERIES, SQL = {}, {}
#: A longer pause is a break between sittings.
MAX_GAP_MS = 900_000


def _q(fn):
    QUERIES[fn.__name__] = fn
    return fn


@_q
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    spoken = table(spark, d, "segments").where(F.col("version") == "v2").select(F.lit("segment").alias("layer"), "recording", "start_s", "end_s")
    verses = table(spark, d, "entities").where(F.col("etype") == "ayah").select(F.lit("ayah").alias("layer"), "recording", "start_s", "end_s")
    spans = spoken.unionByName(verses).select("recording", "layer", millis(F.col("start_s")).alias("s"), millis(F.col("end_s")).alias("e"))
    return periods_and_gaps(spans, ["recording", "layer"], "s", "e", max_gap=MAX_GAP_MS)


SQL["p4_found"] = """
    WITH spans AS (
        SELECT DISTINCT recording, layer, CAST(round(start_s * 1000) AS BIGINT) AS s, CAST(round(end_s * 1000) AS BIGINT) AS e FROM (
            SELECT recording, 'segment' AS layer, start_s, end_s FROM segments WHERE version = 'v2'
            UNION ALL SELECT recording, 'ayah', start_s, end_s FROM entities WHERE etype = 'ayah')
        WHERE start_s IS NOT NULL AND end_s IS NOT NULL AND recording IS NOT NULL),
    marked AS (
        SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY recording, layer ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh
        FROM spans WHERE e > s),
    numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY recording, layer ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS n FROM marked),
    periods AS (SELECT recording, layer, n, min(s) AS from_ms, max(e) AS to_ms FROM numbered GROUP BY ALL),
    gaps AS (SELECT recording, layer, to_ms AS from_ms, lead(from_ms) OVER (PARTITION BY recording, layer ORDER BY n) AS to_ms FROM periods)
    SELECT recording, layer, 'period' AS kind, from_ms, to_ms FROM periods
    UNION ALL SELECT recording, layer, 'gap', from_ms, to_ms FROM gaps WHERE to_ms - from_ms <= 900000
"""


def _overlaps(spark: SparkSession, d: str) -> DataFrame:
    e = timed(entities(spark, d), "e_start", "e_end").select("recording", "entity_id", "e_start", "e_end")
    s = timed(segments(spark, d, "v2"), "s_start", "s_end").select("recording", "seg_key", "s_start", "s_end")
    return overlap_join(e, s, "recording", "e_start", "e_end", "s_start", "s_end")


_OVERLAP_SQL = f"""{SEGMENTS_SQL}, {ENTITIES_SQL},
    e AS (SELECT recording, entity_id, CAST(round(start_s * 1000) AS BIGINT) AS e_start, CAST(round(end_s * 1000) AS BIGINT) AS e_end FROM ents),
    s AS (SELECT recording, seg_key, CAST(round(start_s * 1000) AS BIGINT) AS s_start, CAST(round(end_s * 1000) AS BIGINT) AS s_end FROM segs WHERE version = 'v2'),
    o AS (SELECT entity_id, seg_key, e_start, e_end, s_start, s_end FROM e JOIN s ON e.recording = s.recording AND e_start < s_end AND s_start < e_end)"""


@_q
def overlap_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Entities and the v2 segments they share time with."""
    return _overlaps(spark, d).select("entity_id", "seg_key")


SQL["overlap_pairs"] = f"WITH {_OVERLAP_SQL} SELECT entity_id, seg_key FROM o"


@_q
def overlap_best_match(spark: SparkSession, d: str) -> DataFrame:
    return best_overlap(_overlaps(spark, d), "entity_id", "seg_key", "e_start", "e_end", "s_start", "s_end")


SQL["overlap_best_match"] = f"""
    WITH {_OVERLAP_SQL}, r AS (SELECT entity_id, seg_key, least(e_end, s_end) - greatest(e_start, s_start) AS shared_ms FROM o)
    SELECT entity_id, seg_key, shared_ms FROM r QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY shared_ms DESC, seg_key) = 1
"""


@_q
def asof_segment(spark: SparkSession, d: str) -> DataFrame:
    """Each entity's last v2 segment that starts at or before it."""
    e = timed(entities(spark, d)).select("recording", "entity_id", F.col("start_ms").alias("at"))
    s = timed(segments(spark, d, "v2")).select("recording", "seg_key", "start_ms")
    return last_before(e, s, "recording", "entity_id", "at", "seg_key", "start_ms")


SQL["asof_segment"] = f"""
    WITH {SEGMENTS_SQL}, {ENTITIES_SQL}, e AS (SELECT recording, entity_id, CAST(round(start_s * 1000) AS BIGINT) AS t FROM ents WHERE start_s IS NOT NULL),
    s AS (SELECT recording, CAST(round(start_s * 1000) AS BIGINT) AS t, max(seg_key) AS seg_key FROM segs WHERE version = 'v2' AND start_s IS NOT NULL GROUP BY ALL)
    SELECT entity_id, seg_key FROM e ASOF JOIN s ON e.recording = s.recording AND e.t >= s.t
"""


@_q
def interval_chains(spark: SparkSession, d: str) -> DataFrame:
    """Groups of v2 segments that overlap, directly or through others (touching ones too), with their number of segments."""
    s = timed(segments(spark, d, "v2")).where(F.col("end_ms") > F.col("start_ms"))
    p = periods_and_gaps(s, ["recording"], "start_ms", "end_ms").where(F.col("kind") == "period").select("recording", F.col("from_ms").alias("p_start"), F.col("from_ms").alias("p"))
    at = last_before(s.select("recording", F.col("seg_key").alias("k"), "start_ms"), p, "recording", "k", "start_ms", "p", "p_start")
    return at.join(s.select("recording", F.col("seg_key").alias("k")), "k").groupBy("recording", F.col("p").alias("from_ms")).agg(F.count("*").alias("n_segments"))


SQL["interval_chains"] = f"""
    WITH {SEGMENTS_SQL}, s AS (SELECT recording, CAST(round(start_s * 1000) AS BIGINT) AS a, CAST(round(end_s * 1000) AS BIGINT) AS b FROM segs WHERE version = 'v2'),
    m AS (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY recording ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM s WHERE b > a),
    g AS (SELECT *, sum(fresh) OVER (PARTITION BY recording ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS n FROM m)
    SELECT recording, min(a) AS from_ms, count(*) AS n_segments FROM g GROUP BY recording, n
"""


@_q
def segment_sequence(spark: SparkSession, d: str) -> DataFrame:
    """Position of each v2 segment in its recording and the segment that follows."""
    s = segments(spark, d, "v2").select("recording", "seq", "seg_key", F.lit(1).alias("one"))
    n = ordered.running(s, ["recording"], ["seq"], F.floor(F.col("seq") / 1000), {"position": ("sum", "one")})
    n = ordered.neighbours(n, ["recording"], ["seq"], F.floor(F.col("seq") / 1000), after={"next_key": "seg_key"})
    return n.select("recording", "seg_key", F.col("position").cast("int").alias("position"), "next_key")


SQL["segment_sequence"] = f"""
    WITH {SEGMENTS_SQL} SELECT recording, seg_key, CAST(row_number() OVER w - 1 AS INTEGER) AS position, lead(seg_key) OVER w AS next_key FROM segs WHERE version = 'v2' WINDOW w AS (PARTITION BY recording ORDER BY seq)
"""


@_q
def review_gate(spark: SparkSession, d: str) -> DataFrame:
    """What stands against taking a reviewed version: one row per violation, fatal or warning."""
    s = segments(spark, d, "v3")
    rows = ordered.neighbours(s.select("recording", "seq", "seg_key", "id", "start_s", "end_s", "text"), ["recording"], ["seq"], F.floor(F.col("seq") / 1000), before={"before": "start_s"})
    rule = lambda bad, severity, name: F.when(bad, F.struct(F.lit(severity).alias("severity"), F.lit(name).alias("rule")))
    found = F.filter(F.array(
        rule(F.col("start_s").isNull() | F.col("end_s").isNull(), "fatal", "missing time"), rule(F.col("text").isNull(), "fatal", "missing text"),
        rule(F.col("end_s") < F.col("start_s"), "warning", "end before start"), rule(F.col("start_s") < F.col("before"), "warning", "start before previous"),
    ), lambda x: x.isNotNull())
    own = rows.select("recording", F.col("seg_key").alias("item"), F.inline(found))
    twice = s.where(F.col("id").isNotNull()).groupBy("recording", "id").agg(F.count("*").alias("n"), F.min("seg_key").alias("item")).where(F.col("n") > 1).select("recording", "item", F.lit("fatal").alias("severity"), F.lit("id used twice").alias("rule"))
    last = s.groupBy("recording").agg(F.max(F.greatest("start_s", "end_s")).alias("last"))
    e = entities(spark, d).join(last, "recording", "left")
    cited = F.col("etype") != "topic"
    key = F.when(F.col("etype") == "ayah", F.col("surah_number").isNull() | F.col("ayah_number").isNull()).otherwise(cited & F.col("reference").isNull())
    usage = ~F.coalesce(F.lower(F.trim("usage")).isin(*T.USAGE), F.lit(False))
    extent = F.col("etype").isin("ayah", "dua") & ~F.coalesce(F.lower(F.trim("extent")).isin(*T.EXTENT), F.lit(False))
    ent = F.filter(F.array(
        rule(cited & usage, "fatal", "usage"), rule(extent, "fatal", "extent"), rule(key, "fatal", "missing key"), rule(F.col("start_s").isNull() | F.col("end_s").isNull(), "fatal", "missing entity time"), rule(cited & F.col("text").isNull(), "fatal", "missing entity text"),
        rule(F.col("end_s") < F.col("start_s"), "warning", "entity end before start"), rule(F.col("start_s") > F.col("last"), "warning", "entity after the last segment"),
    ), lambda x: x.isNotNull())
    # A recording that is being reviewed but has no segment or no entity at all.
    there, cites = s.select("recording").distinct(), e.select("recording").distinct().where(F.col("recording").isNotNull())
    bare = lambda df, name: df.select("recording", F.lit(None).cast("bigint").alias("item"), F.lit("fatal").alias("severity"), F.lit(name).alias("rule"))
    known = table(spark, d, "segments").select("recording").distinct()
    empty = bare(known.join(there, "recording", "left_anti"), "no segments").unionByName(bare(there.join(cites, "recording", "left_anti"), "no entities"))
    return own.unionByName(twice).unionByName(e.select("recording", F.col("entity_id").alias("item"), F.inline(ent))).unionByName(empty)


SQL["review_gate"] = f"""
    WITH {SEGMENTS_SQL}, {ENTITIES_SQL}, r AS (SELECT *, lag(start_s) OVER (PARTITION BY recording ORDER BY seq) AS before FROM segs WHERE version = 'v3'), l AS (SELECT recording, max(greatest(start_s, end_s)) AS last FROM r GROUP BY recording), e AS (SELECT ents.*, last FROM ents LEFT JOIN l ON ents.recording = l.recording)
    SELECT recording, seg_key AS item, 'fatal' AS severity, 'missing time' AS rule FROM r WHERE start_s IS NULL OR end_s IS NULL
    UNION ALL SELECT recording, seg_key, 'fatal', 'missing text' FROM r WHERE text IS NULL
    UNION ALL SELECT recording, seg_key, 'warning', 'end before start' FROM r WHERE end_s < start_s
    UNION ALL SELECT recording, seg_key, 'warning', 'start before previous' FROM r WHERE start_s < before
    UNION ALL SELECT recording, min(seg_key), 'fatal', 'id used twice' FROM r WHERE id IS NOT NULL GROUP BY recording, id HAVING count(*) > 1
    UNION ALL SELECT DISTINCT recording, CAST(NULL AS BIGINT), 'fatal', 'no segments' FROM segments WHERE recording NOT IN (SELECT recording FROM r) UNION ALL SELECT DISTINCT recording, CAST(NULL AS BIGINT), 'fatal', 'no entities' FROM r WHERE recording NOT IN (SELECT recording FROM ents WHERE recording IS NOT NULL)
    UNION ALL SELECT recording, entity_id, 'fatal', 'missing key' FROM e WHERE CASE etype WHEN 'ayah' THEN surah_number IS NULL OR ayah_number IS NULL WHEN 'topic' THEN false ELSE reference IS NULL END
    UNION ALL SELECT recording, entity_id, 'fatal', 'missing entity time' FROM e WHERE start_s IS NULL OR end_s IS NULL UNION ALL SELECT recording, entity_id, 'fatal', 'missing entity text' FROM e WHERE etype <> 'topic' AND text IS NULL
    UNION ALL SELECT recording, entity_id, 'warning', 'entity after the last segment' FROM e WHERE start_s > last
    UNION ALL SELECT recording, entity_id, 'fatal', 'usage' FROM e WHERE etype <> 'topic' AND coalesce(lower(trim(usage)) NOT IN ('quotation', 'translation', 'paraphrase', 'explicit paraphrase'), true)
    UNION ALL SELECT recording, entity_id, 'fatal', 'extent' FROM e WHERE etype IN ('ayah', 'dua') AND coalesce(lower(trim(extent)) NOT IN ('complete', 'partial'), true)
    UNION ALL SELECT recording, entity_id, 'warning', 'entity end before start' FROM e WHERE end_s < start_s
"""


@_q
def word_offsets(spark: SparkSession, d: str) -> DataFrame:
    """Number of words in the v2 segments before each one of its recording."""
    s = segments(spark, d, "v2").select("recording", "seq", "seg_key", F.size(T.words(F.col("text"))).alias("n_words"))
    return ordered.running(s, ["recording"], ["seq"], F.floor(F.col("seq") / 1000), {"word_offset": ("sum", "n_words")}).select("seg_key", "n_words", "word_offset")


_OFFSETS_SQL = f"""{SEGMENTS_SQL}, n AS (SELECT recording, seq, seg_key, len({words_sql("text")}) AS n_words FROM segs WHERE version = 'v2'),
    o AS (SELECT recording, seg_key, n_words, coalesce(sum(n_words) OVER (PARTITION BY recording ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS word_offset FROM n)"""
SQL["word_offsets"] = f"WITH {_OFFSETS_SQL} SELECT seg_key, n_words, word_offset FROM o"


@_q
def asof_word(spark: SparkSession, d: str) -> DataFrame:
    """The v2 segment that holds each word of a recording; of segments at one offset the last."""
    o = word_offsets(spark, d).where(F.col("n_words") > 0)
    return o.select("seg_key", F.explode(F.sequence(F.col("word_offset"), F.col("word_offset") + F.col("n_words") - 1)).alias("word_no"))


SQL["asof_word"] = f"""
    WITH {_OFFSETS_SQL}, t AS (SELECT recording, max(word_offset + n_words) AS total FROM o GROUP BY ALL), w AS (SELECT recording, unnest(range(0, total)) AS word_no FROM t),
    f AS (SELECT * FROM o WHERE n_words > 0) SELECT seg_key, word_no FROM w ASOF JOIN f ON w.recording = f.recording AND w.word_no >= f.word_offset
"""


@_q
def word_buffers(spark: SparkSession, d: str) -> DataFrame:
    """Words of the v2 recordings in groups of fifteen, each word timed by its share of its segment."""
    s = segments(spark, d, "v2").where(F.col("start_s").isNotNull() & (F.col("end_s") >= F.col("start_s"))).select("recording", "seq", "start_s", "end_s", T.words(F.col("text")).alias("ws")).withColumn("n", F.size("ws"))
    o = ordered.running(s, ["recording"], ["seq"], F.floor(F.col("seq") / 1000), {"off": ("sum", "n")})
    w = o.select("recording", "start_s", "end_s", "n", "off", F.posexplode("ws").alias("i", "word"))
    step = (F.col("end_s") - F.col("start_s")) / F.col("n")
    timed_words = w.select("recording", (F.col("off") + F.col("i")).alias("no"), (F.col("start_s") + step * F.col("i")).alias("w_start"), (F.col("start_s") + step * (F.col("i") + 1)).alias("w_end"), "word")
    out = ordered.word_buffers(timed_words, ["recording"], "no", "w_start", "w_end", "word")
    return out.select("recording", "buffer", F.round("start_s", 3).alias("start_s"), F.round("end_s", 3).alias("end_s"), "n_words", "text")


STRIP_SQL = "[\\s\\x0b\\x{85}\\p{Z}]+"
SQL["word_buffers"] = f"""
    WITH {SEGMENTS_SQL}, s AS (SELECT recording, seq, start_s, end_s, {words_sql("text")} AS ws FROM segs WHERE version = 'v2' AND start_s IS NOT NULL AND end_s >= start_s),
    o AS (SELECT *, len(ws) AS n, coalesce(sum(len(ws)) OVER (PARTITION BY recording ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off FROM s),
    w AS (SELECT recording, off + i AS no, start_s + (end_s - start_s) / n * i AS a, start_s + (end_s - start_s) / n * (i + 1) AS b, ws[i + 1] AS word FROM (SELECT *, unnest(range(0, n)) AS i FROM o WHERE n > 0)),
    g AS (SELECT *, no // 15 AS g, count(*) OVER (PARTITION BY recording) AS total FROM w),
    h AS (SELECT *, CASE WHEN total % 15 BETWEEN 1 AND 7 AND g = total // 15 AND g > 0 THEN g - 1 ELSE g END AS buffer FROM g)
    SELECT recording, buffer, round(min(a), 3) AS start_s, round(max(b), 3) AS end_s, count(*) AS n_words, string_agg(word, ' ' ORDER BY no) AS text FROM h GROUP BY recording, buffer
"""


@_q
def greedy_chunks(spark: SparkSession, d: str) -> DataFrame:
    return ordered.chunks(segments(spark, d, "v2"))


# For every segment the stop of a chunk that begins there; then the chain from the first of each recording.
_ENDING = "[\"''”’»)\\]}]*$"
CHUNKS_SQL = f"""{SEGMENTS_SQL},
    s0 AS (SELECT recording, seq, start_s, end_s, regexp_replace(coalesce(text, ''), '^{STRIP_SQL}|{STRIP_SQL}$', '', 'g') AS text FROM segs WHERE version = 'v2' AND start_s IS NOT NULL AND end_s >= start_s),
    s AS (SELECT *, row_number() OVER (PARTITION BY recording ORDER BY start_s, seq) - 1 AS n, count(*) OVER (PARTITION BY recording) AS total, lead(start_s) OVER (PARTITION BY recording ORDER BY start_s, seq) AS following,
        CASE WHEN regexp_matches(text, '[.!?۔؟]{_ENDING}') THEN 3 WHEN regexp_matches(text, '[,;:،؛]{_ENDING}') THEN 1 ELSE 0 END AS mark FROM s0),
    w AS (SELECT a.recording, a.n AS i, b.n AS j, b.total, b.following, b.mark, a.start_s AS origin, max(b.end_s) OVER (PARTITION BY a.recording, a.n ORDER BY b.n) AS reach
        FROM s a JOIN s b ON a.recording = b.recording AND b.n >= a.n AND b.start_s <= a.start_s + 60),
    c AS (SELECT *, reach - origin AS len, CASE WHEN mark = 3 THEN 3 WHEN following - reach >= 1.0 THEN 2 ELSE mark END AS worth FROM w WHERE reach - origin <= 60 OR j = i),
    stops AS (SELECT recording, i, CASE WHEN max(j) = max(total) - 1 THEN max(total) ELSE coalesce(arg_max(j, (worth, -abs(len - 30), j)) FILTER (len >= 15), max(j)) + 1 END AS stop FROM c GROUP BY recording, i),
    chain AS (SELECT recording, i, stop FROM stops WHERE i = 0 UNION ALL SELECT t.recording, t.i, t.stop FROM chain h JOIN stops t ON t.recording = h.recording AND t.i = h.stop),
    chunks AS (SELECT h.recording, min(s.start_s) FILTER (s.n = h.i) AS chunk_start, max(s.end_s) AS chunk_end, CAST(count(*) AS INTEGER) AS n_segments, list(s.seq ORDER BY s.n) AS seqs, coalesce(string_agg(s.text, ' ' ORDER BY s.n) FILTER (s.text <> ''), '') AS text
        FROM chain h JOIN s ON s.recording = h.recording AND s.n >= h.i AND s.n < h.stop GROUP BY h.recording, h.i)"""
SQL["greedy_chunks"] = f"WITH RECURSIVE {CHUNKS_SQL} SELECT * FROM chunks"


@_q
def activity_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of users with pauses under ten minutes (the batch form of the stream)."""
    a = activity(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    return a.select("user_id", "n_events", F.unix_micros("first_ts").alias("first_us"), F.unix_micros("last_ts").alias("last_us"))


SQL["activity_sessions"] = """
    WITH m AS (SELECT user_id, epoch_us(ts) AS t, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w < 600000000 THEN 0 ELSE 1 END AS fresh FROM events WHERE user_id IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS n FROM m)
    SELECT user_id, count(*) AS n_events, min(t) AS first_us, max(t) AS last_us FROM g GROUP BY user_id, n
"""
