"""Queries of the scalar functions, matching, graph, retrieval and catalogue operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import matching, retrieval
from tessera.operators.review import fold
from tessera.plans.common import ENTITIES_SQL, SEGMENTS_SQL, entities, segments, timed
from tessera.session import table

QUERIES, SQL = {}, {}


def _q(fn):
    QUERIES[fn.__name__] = fn
    return fn


@_q
def recording_catalogue(spark: SparkSession, d: str) -> DataFrame:
    """What there is of each recording, and which next stages it is ready for."""
    v = segments(spark, d).groupBy("recording").agg(F.collect_set("version").alias("vs"))
    e = entities(spark, d).groupBy("recording").agg(F.count("*").alias("n_entities"))
    r = table(spark, d, "recordings").select("recording", "series").join(v, "recording", "left").join(e, "recording", "left")
    has = {x: F.coalesce(F.array_contains("vs", x), F.lit(False)) for x in ("v0", "v1", "v2", "v3")}
    return r.select("recording", "series", *[c.alias(f"has_{x}") for x, c in has.items()], F.coalesce("n_entities", F.lit(0)).alias("n_entities"), (has["v2"] & ~has["v3"]).alias("reviewable"), (has["v3"] & (F.coalesce("n_entities", F.lit(0)) > 0)).alias("buildable"))


SQL["recording_catalogue"] = f"""
    WITH {ENTITIES_SQL}, v AS (SELECT recording, list(DISTINCT version) AS vs FROM segments GROUP BY ALL), e AS (SELECT recording, count(*) AS n FROM ents GROUP BY ALL)
    SELECT r.recording, r.series, {", ".join(f"coalesce(list_contains(vs, '{x}'), false) AS has_{x}" for x in ("v0", "v1", "v2", "v3"))}, coalesce(n, 0) AS n_entities,
        coalesce(list_contains(vs, 'v2'), false) AND NOT coalesce(list_contains(vs, 'v3'), false) AS reviewable, coalesce(list_contains(vs, 'v3'), false) AND coalesce(n, 0) > 0 AS buildable
    FROM recordings r LEFT JOIN v ON r.recording = v.recording LEFT JOIN e ON r.recording = e.recording
"""


@_q
def verse_range_rows(spark: SparkSession, d: str) -> DataFrame:
    """A row for each verse that an entity's number or range of numbers stands for, with its key."""
    e = entities(spark, d, "ayah").select("entity_id", F.expr("try_cast(surah_number AS int)").alias("sura"), F.explode(T.verse_numbers(F.col("ayah_number"))).alias("aya"))
    return e.where(F.col("sura").isNotNull()).select("entity_id", "sura", "aya", F.format_string("CH%03d_V%03d", "sura", "aya").alias("verse_key"))


SQL["verse_range_rows"] = f"""
    WITH {ENTITIES_SQL}, n AS (SELECT entity_id, TRY_CAST(surah_number AS INTEGER) AS sura, TRY_CAST(regexp_extract(ayah_number, '^\\s*(\\d+)', 1) AS INTEGER) AS lo,
        CASE WHEN regexp_matches(ayah_number, '^\\s*\\d+\\s*$') THEN TRY_CAST(trim(ayah_number) AS INTEGER) ELSE TRY_CAST(regexp_extract(ayah_number, '^\\s*\\d+\\s*-\\s*(\\d+)\\s*$', 1) AS INTEGER) END AS hi FROM ents WHERE etype = 'ayah'),
    x AS (SELECT entity_id, sura, CAST(unnest(range(lo, hi + 1)) AS INTEGER) AS aya FROM n WHERE hi >= lo AND sura IS NOT NULL)
    SELECT entity_id, sura, aya, format('CH{{:03d}}_V{{:03d}}', sura, aya) AS verse_key FROM x
"""


@_q
def citation_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Each entity with the canonical text its reference names; a miss keeps the entity with a null text and a warning."""
    e = entities(spark, d, "ayah", "dua")
    single = F.expr("CASE WHEN etype = 'dua' THEN reference WHEN try_cast(surah_number AS int) IS NOT NULL AND try_cast(ayah_number AS int) IS NOT NULL THEN format_string('CH%03d_V%03d', try_cast(surah_number AS int), try_cast(ayah_number AS int)) END")
    c = table(spark, d, "canon").select(F.col("kind").alias("etype"), F.col("canon_key").alias("ref_key"), F.col("text").alias("canon"))
    j = e.select("entity_id", "etype", single.alias("ref_key")).join(c, ["etype", "ref_key"], "left")
    return j.select("entity_id", "etype", "ref_key", F.char_length("canon").alias("n_chars"), F.when(F.col("canon").isNull(), "not in the corpus").alias("warning"))


SQL["citation_lookup"] = f"""
    WITH {ENTITIES_SQL}, e AS (SELECT entity_id, etype, CASE WHEN etype = 'dua' THEN reference WHEN TRY_CAST(surah_number AS INTEGER) IS NOT NULL AND TRY_CAST(ayah_number AS INTEGER) IS NOT NULL
        THEN format('CH{{:03d}}_V{{:03d}}', TRY_CAST(surah_number AS INTEGER), TRY_CAST(ayah_number AS INTEGER)) END AS ref_key FROM ents WHERE etype IN ('ayah', 'dua'))
    SELECT entity_id, etype, ref_key, length(c.text) AS n_chars, CASE WHEN c.text IS NULL THEN 'not in the corpus' END AS warning FROM e LEFT JOIN canon c ON c.kind = e.etype AND c.canon_key = e.ref_key
"""


@_q
def controlled_values(spark: SparkSession, d: str) -> DataFrame:
    """Usage and extent of citations as controlled names, counted; unknown values are null."""
    e = entities(spark, d, "ayah", "dua", "hadith")
    return e.groupBy("etype", T.controlled(F.col("usage"), T.USAGE).alias("usage_type"), T.controlled(F.col("extent"), T.EXTENT).alias("extent_type")).agg(F.count("*").alias("n"))


SQL["controlled_values"] = f"""
    WITH {ENTITIES_SQL} SELECT etype, CASE lower(trim(usage)) WHEN 'quotation' THEN 'Quotation' WHEN 'translation' THEN 'Translation' WHEN 'paraphrase' THEN 'Paraphrase' WHEN 'explicit paraphrase' THEN 'Paraphrase' END AS usage_type,
        CASE lower(trim(extent)) WHEN 'complete' THEN 'CompleteCitation' WHEN 'partial' THEN 'PartialCitation' END AS extent_type, count(*) AS n FROM ents WHERE etype IN ('ayah', 'dua', 'hadith') GROUP BY ALL
"""


@_q
def script_profile(spark: SparkSession, d: str) -> DataFrame:
    """Segments of each series and version by the script of most of their letters."""
    s = segments(spark, d)
    return s.groupBy("series", "version", T.dominant_script(F.col("text")).alias("script")).agg(F.count("*").alias("n"))


SQL["script_profile"] = f"""
    WITH {SEGMENTS_SQL}, n AS (SELECT series, version, length(regexp_replace(coalesce(text, ''), '[^\\x{{620}}-\\x{{64A}}\\x{{66E}}-\\x{{6D3}}\\x{{6D5}}\\x{{6FA}}-\\x{{6FC}}]', '', 'g')) AS a,
        length(regexp_replace(coalesce(text, ''), '[^\\x{{904}}-\\x{{939}}]', '', 'g')) AS h, length(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')) AS l FROM segs)
    SELECT series, version, CASE WHEN greatest(a, h, l) = 0 THEN NULL WHEN a >= h AND a >= l THEN 'arabic' WHEN h >= l THEN 'devanagari' ELSE 'latin' END AS script, count(*) AS n FROM n GROUP BY ALL
"""


@_q
def clock_marks(spark: SparkSession, d: str) -> DataFrame:
    """Time marks such as [00:01:05] of each document: how many, and the last in seconds."""
    t = table(spark, d, "documents").select("doc_id", F.expr(r"regexp_extract_all(text, '\\[(\\d+:\\d{2}:\\d{2})\\]', 1)").alias("m")).where(F.size("m") > 0)
    return t.select("doc_id", F.size("m").alias("n_marks"), T.seconds_of(F.element_at("m", -1)).alias("last_s"))


SQL["clock_marks"] = r"""
    WITH m AS (SELECT doc_id, regexp_extract_all(text, '\[(\d+:\d{2}:\d{2})\]', 1) AS m FROM documents), l AS (SELECT doc_id, len(m) AS n_marks, string_split(m[len(m)], ':') AS p FROM m WHERE len(m) > 0)
    SELECT doc_id, n_marks, CAST(p[1] AS INTEGER) * 3600 + CAST(p[2] AS INTEGER) * 60 + CAST(p[3] AS INTEGER) AS last_s FROM l
"""


@_q
def reference_slugs(spark: SparkSession, d: str) -> DataFrame:
    """References and series as they stand in node names."""
    e = entities(spark, d, "hadith", "dua").where(F.col("reference").isNotNull())
    return e.select("entity_id", T.iri_part("reference").alias("iri_part"), T.slug(F.concat_ws(" ", "etype", "reference")).alias("slug"))


SQL["reference_slugs"] = f"""
    WITH {ENTITIES_SQL} SELECT entity_id, regexp_replace(reference, '[^A-Za-z0-9_.-]', '_', 'g') AS iri_part,
        regexp_replace(regexp_replace(concat_ws(' ', etype, reference), '[^\\p{{L}}\\p{{N}}]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug FROM ents WHERE etype IN ('hadith', 'dua') AND reference IS NOT NULL
"""


@_q
def event_reply_parse(spark: SparkSession, d: str) -> DataFrame:
    """The JSON object of each event's properties, and a field of it."""
    e = table(spark, d, "events").select("event_type", T.json_reply(F.col("props")).alias("j"))
    return e.groupBy("event_type").agg(F.count("j").alias("n_parsed"), F.sum(F.get_json_object("j", "$.k").cast("bigint")).alias("sum_k"))


SQL["event_reply_parse"] = "SELECT event_type, count(props) AS n_parsed, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS sum_k FROM events GROUP BY ALL"


#: A text to be grounded is known by its kind and itself.
CANDIDATE = ("etype", "text")
#: Weight of the lexical score; the sweep tries all.
ALPHA, ALPHAS = 0.7, [round(0.1 * i, 1) for i in range(11)]


def _cited(spark: SparkSession, d: str) -> DataFrame:
    """Verses and duas of any usage, with the key of the corpus that their single reference proposes."""
    verse = F.expr("CASE WHEN try_cast(surah_number AS int) IS NOT NULL AND try_cast(ayah_number AS int) IS NOT NULL THEN format_string('CH%03d_V%03d', try_cast(surah_number AS int), try_cast(ayah_number AS int)) END")
    return entities(spark, d, "ayah", "dua").select("entity_id", "usage", *CANDIDATE, F.when(F.col("etype") == "dua", F.trim("reference")).otherwise(verse).alias("proposed"))


def _matches(spark: SparkSession, d: str, e: DataFrame, alphas: list[float], top: int = matching.TOP) -> DataFrame:
    """The best entries of each text in its own kind of canon."""
    return matching.best_matches(e, table(spark, d, "canon"), *CANDIDATE, "kind", "canon_key", "text", alphas=alphas, top=top)


@_q
def ground_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Verses and duas of every usage grounded in the corpus of their kind: best entry, score, margin, verdict, and whether it is the proposed one."""
    e = _cited(spark, d)
    got = matching.decisions(_matches(spark, d, e, [ALPHA], 2), "canon_key", "score", 0.5, 0.02, CANDIDATE)
    j = e.join(got, [*CANDIDATE], "left")
    return j.select("entity_id", "best_key", "best_score", "margin", F.coalesce("verdict", F.lit("unresolved")).alias("verdict"), F.when(F.col("verdict") == "verified", F.when(F.col("proposed") == F.col("best_key"), "confirmed").otherwise("alternative_reference_selected")).alias("outcome"))


@_q
def match_top5(spark: SparkSession, d: str) -> DataFrame:
    """The five best entries, in the corpus of its kind, of each distinct text of a verse or dua."""
    return _matches(spark, d, _cited(spark, d), [ALPHA]).select("etype", F.sha2("text", 256).alias("candidate"), "canon_key", "lexical", "semantic", "score", "rank")


@_q
def threshold_sweep(spark: SparkSession, d: str) -> DataFrame:
    """The fifteen best settings of lexical weight, threshold and margin, on the quoted verses and duas and on those of every usage."""
    e = _cited(spark, d).withColumnRenamed("proposed", "gold_key")
    got = matching.decisions(_matches(spark, d, e, ALPHAS, 2), "canon_key", "score", 0.0, 0.0, ("alpha", *CANDIDATE))
    scopes = F.when(F.lower(F.trim("usage")) == "quotation", F.array(F.lit("quotation"), F.lit("all"))).otherwise(F.array(F.lit("all")))
    tried = e.withColumn("alpha", F.explode(F.array(*map(F.lit, ALPHAS)))).withColumn("scope", F.explode(scopes))
    g = matching.grid(tried.join(got, ["alpha", *CANDIDATE], "left"), [round(0.3 + 0.05 * i, 2) for i in range(10)], [0.0, 0.01, 0.02, 0.05, 0.1, 0.15, 0.2], ("scope", "alpha"))
    w = Window.partitionBy("scope").orderBy(F.desc("f1"), "wrong", F.desc("tau"), "delta", "alpha")  # 770 settings a scope
    return g.withColumn("place", F.row_number().over(w)).where(F.col("place") <= 15)


@_q
def topic_registry(spark: SparkSession, d: str) -> DataFrame:
    """Topics by slug over all series: the name met first, and the series that have it."""
    r = table(spark, d, "recordings").select("recording", "series")
    e = entities(spark, d, "topic").where(F.trim("text") != "").join(r, "recording").select(T.slug(F.lower(F.trim("text"))).alias("slug"), F.col("text").alias("name"), "entity_id", "series")
    return e.where(F.col("slug") != "").groupBy("slug").agg(F.min_by("name", "entity_id").alias("name"), F.array_sort(F.collect_set("series")).alias("series"))


SQL["topic_registry"] = f"""
    WITH {ENTITIES_SQL}, e AS (SELECT regexp_replace(regexp_replace(lower(trim(e.text)), '[^\\p{{L}}\\p{{N}}]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug, e.text AS name, entity_id, r.series FROM ents e JOIN recordings r ON e.recording = r.recording WHERE etype = 'topic' AND trim(e.text) <> '')
    SELECT slug, min_by(name, entity_id) AS name, list_sort(list(DISTINCT series)) AS series FROM e WHERE slug <> '' GROUP BY slug
"""


@_q
def knn_top10(spark: SparkSession, d: str) -> DataFrame:
    """Ten nearest vectors of each vector whose id is divisible by 20, against all."""
    v = table(spark, d, "embeddings")
    return retrieval.knn(v.where(F.col("vec_id") % 20 == 0), v, "vec_id", "embedding", 10).select("query_id", "neighbour_id", F.round("score", 4).alias("score"), "rank")


_KNN_SQL = """k AS (SELECT q.vec_id AS query_id, v.vec_id AS neighbour_id, q.label AS ql, v.label AS vl, list_dot_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS score FROM embeddings q JOIN embeddings v ON q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, neighbour_id) AS rank FROM k QUALIFY rank <= 10)"""
SQL["knn_top10"] = f"WITH {_KNN_SQL} SELECT query_id, neighbour_id, round(score, 4) AS score, CAST(rank AS INTEGER) AS rank FROM r"


@_q
def knn_label_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Rank of the first neighbour with the query's label, and share of such among the ten, by label."""
    v = table(spark, d, "embeddings").select("vec_id", "label")
    n = knn_top10(spark, d).join(v.select(F.col("vec_id").alias("query_id"), F.col("label").alias("ql")), "query_id").join(v.select(F.col("vec_id").alias("neighbour_id"), F.col("label").alias("vl")), "neighbour_id")
    q = n.groupBy("query_id", "ql").agg(F.min(F.when(F.col("ql") == F.col("vl"), F.col("rank"))).alias("first"), F.avg((F.col("ql") == F.col("vl")).cast("double")).alias("share"))
    return q.groupBy(F.col("ql").alias("label")).agg(F.count("*").alias("n"), F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 6).alias("mrr"), F.round(F.avg("share"), 6).alias("precision"))


SQL["knn_label_metrics"] = f"""
    WITH {_KNN_SQL}, q AS (SELECT query_id, ql, min(rank) FILTER (ql = vl) AS first, avg(CASE WHEN ql = vl THEN 1.0 ELSE 0.0 END) AS share FROM r GROUP BY ALL)
    SELECT ql AS label, count(*) AS n, round(avg(coalesce(1.0 / first, 0)), 6) AS mrr, round(avg(share), 6) AS precision FROM q GROUP BY ql
"""


OPENED = '{"op": "open", "segments": [{"start": 0, "end": 1, "text": "t"}]}'


@_q
def review_fold(spark: SparkSession, d: str) -> DataFrame:
    """State of review sessions after the actions that a user's events stand for."""
    e = table(spark, d, "events").where(F.col("user_id").isNotNull())
    act = F.when(F.col("event_type") == "error", F.lit('{"op": "flag.add", "target": "s0", "issue": "missing text"}')).when(F.col("event_type") == "click", F.lit('{"op": "seg.insert", "start": 1, "end": 2, "text": "a line"}')).when(F.col("event_type") == "purchase", F.lit('{"op": "finalize"}')).otherwise(F.lit('{"op": "seg.accept", "uid": "s0"}'))
    log = e.select(F.col("user_id").cast("string").alias("session"), F.col("event_id").cast("bigint").alias("n"), act.alias("action"))
    first = log.groupBy("session").agg((F.min("n") - 1).alias("n")).select("session", "n", F.lit(OPENED).alias("action"))
    return fold(log.unionByName(first))


SQL["review_fold"] = """
    WITH e AS (SELECT CAST(user_id AS VARCHAR) AS session, event_id AS n, event_type AS t FROM events WHERE user_id IS NOT NULL),
    f AS (SELECT session, min(n) FILTER (t = 'purchase') AS bought, min(n) FILTER (t = 'error') AS failed FROM e GROUP BY session),
    x AS (SELECT e.*, CASE WHEN bought IS NOT NULL AND (failed IS NULL OR bought < failed) THEN bought END AS done FROM e JOIN f USING (session)),
    c AS (SELECT session, CASE WHEN done IS NULL THEN t <> 'purchase' ELSE n <= done END AS ok, t, done FROM x)
    SELECT session, CAST(1 + count(*) FILTER (ok) AS INTEGER) AS applied, CAST(count(*) FILTER (NOT ok) AS INTEGER) AS refused, CAST(1 + count(*) FILTER (ok AND t = 'click') AS INTEGER) AS n_segments, 0 AS n_entities,
        CAST(count(*) FILTER (ok AND t = 'error') AS INTEGER) AS open_flags, max(done) IS NOT NULL AS finalized FROM c GROUP BY session
"""
