"""The knowledge graph of recordings, segments, citations and topics, and the questions it answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import graph as G
from tessera.operators import sparql
from tessera.operators.ordered import running
from tessera.operators.spans import overlap_join
from tessera.plans.common import ENTITIES_SQL, SEGMENTS_SQL, entities, segments, timed
from tessera.session import table

QUERIES, SQL = {}, {}
# Public vocabularies that nodes are linked to.
QUR, TAFSIR, HADITH = "http://quranontology.com/Resource/", "http://www.semantictafsir.com/ontology/", "http://www.semantichadith.com/ontology/"
SKOS = "http://www.w3.org/2004/02/skos/core#"
PROLOGUE = f"PREFIX : <{G.NS}> PREFIX skos: <{SKOS}> PREFIX tafsir: <{TAFSIR}> PREFIX hadith: <{HADITH}> PREFIX qur: <{QUR}>\n"
EXACT, CLOSE = SKOS + "exactMatch", SKOS + "closeMatch"


def _q(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _iri(kind: str, *c: str | Column) -> Column:
    return F.concat_ws("_", F.lit(kind), *c)


def _segments(spark: SparkSession, d: str) -> DataFrame:
    """v3 segments with their place in the recording."""
    s = segments(spark, d, "v3").withColumn("one", F.lit(1))
    n = running(s, ["recording"], ["seq"], F.floor(F.col("seq") / 1000), {"i": ("sum", "one")})
    return timed(n, "s_start", "s_end").withColumn("node", _iri("Segment", "recording", F.format_string("%04d", F.col("i").cast("bigint"))))


def _occurrences(spark: SparkSession, d: str) -> DataFrame:
    """Citations and topics with the group of segments they lie in, one row for each verse of a range."""
    e = timed(entities(spark, d), "e_start", "e_end")
    e = e.withColumn("group", F.when(F.col("e_start").isNotNull() & F.col("e_end").isNotNull(), _iri("SegmentGroup", "recording", F.col("e_start").cast("string"), F.col("e_end").cast("string"))))
    e = e.withColumn("sura", F.col("surah_number").try_cast("int")).withColumn("verses", F.when(F.col("etype") == "ayah", T.verse_numbers(F.col("ayah_number"))).otherwise(F.array(F.lit(None).cast("int"))))
    return e.withColumn("aya", F.explode("verses")).withColumn("usage_name", T.controlled(F.col("usage"), T.USAGE)).withColumn("extent_name", T.controlled(F.col("extent"), T.EXTENT))


def graph(spark: SparkSession, d: str) -> G.Triples:
    """All nodes and links; every property reads only the tables that make it."""
    c, iri = F.col, "iri"
    r = table(spark, d, "recordings")
    rec, series, transcript = _iri("Recording", "recording"), _iri("AudioSeries", "series"), _iri("Transcript", "recording")
    language = F.when(c("lang_label").isNotNull(), _iri("Language", "lang_label"))
    s, o = _segments(spark, d), _occurrences(spark, d)
    before = F.when(c("i") > 0, _iri("Segment", "recording", F.format_string("%04d", (c("i") - 1).cast("bigint"))))
    spans = o.where(c("group").isNotNull()).select("recording", "group", "e_start", "e_end", F.col("start_s").alias("a"), F.col("end_s").alias("b"))
    held = lambda: overlap_join(spans.select("recording", "group", "e_start", "e_end").distinct(), s.select("recording", "node", "s_start", "s_end"), "recording", "e_start", "e_end", "s_start", "s_end")
    occ = lambda kind: _iri(f"{kind}Occurrence", c("entity_id").cast("string"), *([c("aya").cast("string")] if kind == "Verse" else []))
    ayah, hadith, dua = o.where((c("etype") == "ayah") & c("sura").isNotNull()), o.where((c("etype") == "hadith") & c("reference").isNotNull()), o.where((c("etype") == "dua") & c("reference").isNotNull())
    verse = _iri("QuranVerse", c("sura").cast("string"), c("aya").cast("string"))
    topic = o.where((c("etype") == "topic") & (F.trim("text") != "")).withColumn("slug", T.slug(F.lower(F.trim("text")))).where("slug <> ''")
    named = topic.groupBy("slug").agg(F.min_by("text", "entity_id").alias("name"))
    canon = table(spark, d, "canon")
    verses, duas = canon.where(c("kind") == "ayah"), canon.where(c("kind") == "dua")
    cited = ayah.select("sura", "aya").distinct().join(verses.select("sura", "aya", "text", "en_text", "ur_text"), ["sura", "aya"], "left")
    asked = dua.select("reference").distinct().join(duas.select(c("canon_key").alias("reference"), "text", "en_text", "ur_text"), "reference", "left")
    # References of hadith in these tables name no collection; they are taken as of the first.
    external = T.collection_id(F.regexp_replace("reference", "^H-", "SB_"))
    close = concept_hits(named.select("slug", "name"), table(spark, d, "subjects"))
    cite = lambda kind: [(G.TYPE, f"{kind}Occurrence", iri), ("evidenceText", c("text"), "literal"), ("startTime", c("start_s"), "literal"), ("endTime", c("end_s"), "literal"), ("hasUsageType", c("usage_name"), iri), ("occursIn", c("group"), iri)]
    words = lambda *xs: [(p, c(col), "literal") for p, col in xs]
    return G.Triples.of_rules([
        (r, series, [(G.TYPE, "AudioSeries", iri), ("hasRecording", rec, iri), *words(("seriesCode", "series"), ("titleEn", "series"))]),
        (r, _iri("Speaker", "speaker"), [(G.TYPE, "Speaker", iri), *words(("nameEn", "speaker"))]),
        (r, language, [(G.TYPE, "Language", iri), *words(("label", "lang_label"))]),
        (r, rec, [(G.TYPE, "Recording", iri), ("recordingId", c("recording"), "literal"), ("hasPrimarySpeaker", F.when(c("speaker").isNotNull(), _iri("Speaker", "speaker")), iri), ("hasPrimaryLanguage", language, iri), ("hasAudio", _iri("Audio", "recording"), iri), ("hasTranscript", transcript, iri)]),
        (r, _iri("Audio", "recording"), [(G.TYPE, "Audio", iri), *words(("durationSeconds", "duration_s"))]),
        (r, transcript, [(G.TYPE, "Transcript", iri)]),
        (s, c("node"), [(G.TYPE, "TranscriptSegment", iri), ("sequenceIndex", c("i").cast("bigint"), "literal"), *words(("startTime", "start_s"), ("endTime", "end_s"), ("text", "text"))]),
        (s, transcript, [("hasSegment", c("node"), iri)]),
        (s, before, [("precedesSegment", c("node"), iri)]),
        (spans, c("group"), [(G.TYPE, "SegmentGroup", iri), *words(("startTime", "a"), ("endTime", "b"))]),
        (held, c("group"), [("containsSegment", c("node"), iri)]),
        (ayah, occ("Verse"), [*cite("Verse"), ("hasExtentType", c("extent_name"), iri), ("refersTo", verse, iri)]),
        (hadith, occ("Hadith"), [*cite("Hadith"), ("refersTo", _iri("Hadith", T.iri_part(c("reference"))), iri)]),
        (dua, occ("Dua"), [*cite("Dua"), ("hasExtentType", c("extent_name"), iri), ("refersTo", _iri("Dua", T.iri_part(c("reference"))), iri)]),
        (cited, verse, [(G.TYPE, "QuranVerse", iri), *words(("surahNumber", "sura"), ("verseNumber", "aya"), ("textClean", "text"), ("translationEn", "en_text"), ("translationUr", "ur_text")),
                        (EXACT, F.concat(F.lit(QUR + "quran"), c("sura").cast("string"), F.lit("-"), c("aya").cast("string")), iri), (EXACT, F.format_string(TAFSIR + "V%03d_%03d", "sura", "aya"), iri)]),
        (hadith, _iri("Hadith", T.iri_part(c("reference"))), [(G.TYPE, "Hadith", iri), *words(("reference", "reference")), (EXACT, F.concat(F.lit(HADITH), external), iri)]),
        (asked, _iri("Dua", T.iri_part(c("reference"))), [(G.TYPE, "Dua", iri), *words(("reference", "reference"), ("translationEn", "en_text"), ("translationUr", "ur_text"))]),
        (named, _iri("Topic", "slug"), [(G.TYPE, "Topic", iri), *words(("nameEn", "name"))]),
        (topic, c("group"), [("discussesTopic", _iri("Topic", "slug"), iri)]),
        (close, _iri("Topic", "slug"), [(CLOSE, F.concat(F.lit(HADITH), c("subject")), iri)]),
        (o.where(c("usage_name").isNotNull()), c("usage_name"), [("label", c("usage_name"), "literal")]),
    ])


def concept_hits(topics: DataFrame, subjects: DataFrame) -> DataFrame:
    """``slug, subject, hits`` of topics whose name holds a keyword of a subject: its name or a word of its description over four letters.

    The subjects are few and go to every task with their keywords.
    """
    kw = subjects.select("subject", F.explode(F.array_distinct(F.concat(F.array(F.lower("subject")), F.filter(F.split(F.lower("description"), r"[^\p{L}]+"), lambda w: F.char_length(w) > 4)))).alias("kw"))
    held = topics.join(F.broadcast(kw), F.contains(F.lower("name"), F.col("kw")))
    return held.groupBy("slug", "subject").agg(F.array_sort(F.collect_set("kw")).alias("hits"))


_USAGE_SQL = "CASE lower(trim(usage)) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in T.USAGE.items()) + " END"
_EXTENT_SQL = "CASE lower(trim(extent)) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in T.EXTENT.items()) + " END"
_SLUG_SQL = "regexp_replace(regexp_replace(lower(trim(text)), '[^\\p{L}\\p{N}]+', '_', 'g'), '^_+|_+$', '', 'g')"
#: The tables behind the graph in SQL: sg segments, oc citations and topics, gr groups, cs what groups hold, tp topics, cl concepts.
TABLES_SQL = f"""{SEGMENTS_SQL}, {ENTITIES_SQL},
    sg AS (SELECT recording, row_number() OVER (PARTITION BY recording ORDER BY seq) - 1 AS i, start_s, end_s, text, CAST(round(start_s * 1000) AS BIGINT) AS sa, CAST(round(end_s * 1000) AS BIGINT) AS sb FROM segs WHERE version = 'v3'),
    sn AS (SELECT *, 'Segment_' || recording || '_' || lpad(CAST(i AS VARCHAR), CAST(greatest(4, length(CAST(i AS VARCHAR))) AS INTEGER), '0') AS node FROM sg),
    e1 AS (SELECT *, CAST(round(start_s * 1000) AS BIGINT) AS ea, CAST(round(end_s * 1000) AS BIGINT) AS eb, TRY_CAST(surah_number AS INTEGER) AS sura, {_USAGE_SQL} AS usage_name, {_EXTENT_SQL} AS extent_name,
        CASE WHEN etype <> 'ayah' THEN [NULL] WHEN regexp_full_match(ayah_number, '\\s*\\d+\\s*') THEN [CAST(trim(ayah_number) AS INTEGER)]
            WHEN regexp_full_match(ayah_number, '\\s*\\d+\\s*-\\s*\\d+\\s*') THEN range(CAST(trim(split_part(ayah_number, '-', 1)) AS INTEGER), CAST(trim(split_part(ayah_number, '-', 2)) AS INTEGER) + 1) ELSE [] END AS verses FROM ents),
    oc AS (SELECT *, CASE WHEN ea IS NOT NULL AND eb IS NOT NULL THEN 'SegmentGroup_' || recording || '_' || ea || '_' || eb END AS grp, CAST(unnest(verses) AS INTEGER) AS aya FROM e1),
    gr AS (SELECT DISTINCT recording, grp, ea, eb FROM oc WHERE grp IS NOT NULL),
    cs AS (SELECT gr.recording, grp, sn.node, sn.i, sn.start_s, sn.text FROM gr JOIN sn ON gr.recording = sn.recording AND ea < sb AND sa < eb),
    tp AS (SELECT *, {_SLUG_SQL} AS slug FROM oc WHERE etype = 'topic' AND trim(text) <> '' AND {_SLUG_SQL} <> ''),
    nm AS (SELECT slug, min_by(text, entity_id) AS name FROM tp GROUP BY slug),
    kw AS (SELECT subject, unnest(list_distinct(list_concat([lower(subject)], list_filter(string_split_regex(lower(description), '[^\\p{{L}}]+'), lambda w: length(w) > 4)))) AS kw FROM subjects),
    cl AS (SELECT slug, subject, list_sort(list(DISTINCT kw)) AS hits FROM nm JOIN kw ON contains(lower(name), kw) GROUP BY slug, subject),
    vo AS (SELECT * FROM oc WHERE etype = 'ayah' AND sura IS NOT NULL), hd AS (SELECT * FROM oc WHERE etype = 'hadith' AND reference IS NOT NULL), du AS (SELECT * FROM oc WHERE etype = 'dua' AND reference IS NOT NULL),
    vs AS (SELECT DISTINCT vo.sura, vo.aya, c.text, c.en_text, c.ur_text FROM vo LEFT JOIN canon c ON c.kind = 'ayah' AND c.sura = vo.sura AND c.aya = vo.aya),
    dd AS (SELECT DISTINCT du.reference, c.en_text, c.ur_text FROM du LEFT JOIN canon c ON c.kind = 'dua' AND c.canon_key = du.reference)"""


def _facts(source: str, subject: str, *facts: tuple[str, str, str]) -> str:
    return " UNION ALL ".join(f"SELECT {subject} AS s, '{p}' AS p, CAST({o} AS VARCHAR) AS o, '{kind}' AS kind FROM {source}" for p, o, kind in facts)


def _cite_sql(source: str, kind: str, node: str, target: str) -> str:
    extent = () if kind == "Hadith" else (("hasExtentType", "extent_name", "iri"),)
    return _facts(source, node, (G.TYPE, f"'{kind}Occurrence'", "iri"), ("evidenceText", "text", "literal"), ("startTime", "start_s", "literal"), ("endTime", "end_s", "literal"), ("hasUsageType", "usage_name", "iri"), ("occursIn", "grp", "iri"), ("refersTo", target, "iri"), *extent)


_VERSE_NODE, _SAFE = "'QuranVerse_' || sura || '_' || aya", "regexp_replace(reference, '[^A-Za-z0-9_.-]', '_', 'g')"
GRAPH_SQL = f"""{TABLES_SQL}, raw AS ({" UNION ALL ".join([
    _facts("recordings", "'AudioSeries_' || series", (G.TYPE, "'AudioSeries'", "iri"), ("hasRecording", "'Recording_' || recording", "iri"), ("seriesCode", "series", "literal"), ("titleEn", "series", "literal")),
    _facts("recordings", "'Speaker_' || speaker", (G.TYPE, "'Speaker'", "iri"), ("nameEn", "speaker", "literal")),
    _facts("recordings", "'Language_' || lang_label", (G.TYPE, "'Language'", "iri"), ("label", "lang_label", "literal")),
    _facts("recordings", "'Recording_' || recording", (G.TYPE, "'Recording'", "iri"), ("recordingId", "recording", "literal"), ("hasPrimarySpeaker", "'Speaker_' || speaker", "iri"), ("hasPrimaryLanguage", "'Language_' || lang_label", "iri"), ("hasAudio", "'Audio_' || recording", "iri"), ("hasTranscript", "'Transcript_' || recording", "iri")),
    _facts("recordings", "'Audio_' || recording", (G.TYPE, "'Audio'", "iri"), ("durationSeconds", "duration_s", "literal")),
    _facts("recordings", "'Transcript_' || recording", (G.TYPE, "'Transcript'", "iri")),
    _facts("sn", "node", (G.TYPE, "'TranscriptSegment'", "iri"), ("sequenceIndex", "i", "literal"), ("startTime", "start_s", "literal"), ("endTime", "end_s", "literal"), ("text", "text", "literal")),
    _facts("sn", "'Transcript_' || recording", ("hasSegment", "node", "iri")),
    _facts("sn a JOIN sn b ON a.recording = b.recording AND a.i + 1 = b.i", "a.node", ("precedesSegment", "b.node", "iri")),
    _facts("oc WHERE grp IS NOT NULL", "grp", (G.TYPE, "'SegmentGroup'", "iri"), ("startTime", "start_s", "literal"), ("endTime", "end_s", "literal")),
    _facts("cs", "grp", ("containsSegment", "node", "iri")),
    _cite_sql("vo", "Verse", "'VerseOccurrence_' || entity_id || '_' || aya", _VERSE_NODE), _cite_sql("hd", "Hadith", "'HadithOccurrence_' || entity_id", f"'Hadith_' || {_SAFE}"), _cite_sql("du", "Dua", "'DuaOccurrence_' || entity_id", f"'Dua_' || {_SAFE}"),
    _facts("vs", _VERSE_NODE, (G.TYPE, "'QuranVerse'", "iri"), ("surahNumber", "sura", "literal"), ("verseNumber", "aya", "literal"), ("textClean", "text", "literal"), ("translationEn", "en_text", "literal"), ("translationUr", "ur_text", "literal"), (EXACT, f"'{QUR}quran' || sura || '-' || aya", "iri"), (EXACT, f"'{TAFSIR}V' || lpad(CAST(sura AS VARCHAR), 3, '0') || '_' || lpad(CAST(aya AS VARCHAR), 3, '0')", "iri")),
    _facts("hd", f"'Hadith_' || {_SAFE}", (G.TYPE, "'Hadith'", "iri"), ("reference", "reference", "literal"), (EXACT, f"CASE WHEN regexp_full_match(reference, 'H-\\d+') THEN '{HADITH}SB_' || lpad(substr(reference, 3), 4, '0') END", "iri")),
    _facts("dd", f"'Dua_' || {_SAFE}", (G.TYPE, "'Dua'", "iri"), ("reference", "reference", "literal"), ("translationEn", "en_text", "literal"), ("translationUr", "ur_text", "literal")),
    _facts("nm", "'Topic_' || slug", (G.TYPE, "'Topic'", "iri"), ("nameEn", "name", "literal")),
    _facts("tp", "grp", ("discussesTopic", "'Topic_' || slug", "iri")),
    _facts("cl", "'Topic_' || slug", (CLOSE, f"'{HADITH}' || subject", "iri")),
    _facts("oc", "usage_name", ("label", "usage_name", "literal")),
])}), g AS (SELECT DISTINCT s, p, o, kind FROM raw WHERE s IS NOT NULL AND o IS NOT NULL)"""


@_q
def kg_triples(spark: SparkSession, d: str) -> DataFrame:
    return graph(spark, d).all()


SQL["kg_triples"] = f"WITH {GRAPH_SQL} SELECT s, p, o, kind FROM g"


@_q
def kg_statistics(spark: SparkSession, d: str) -> DataFrame:
    return G.statistics(graph(spark, d).all())


SQL["kg_statistics"] = f"""
    WITH {GRAPH_SQL} SELECT 'triples' AS metric, '' AS name, count(*) AS n FROM g UNION ALL SELECT 'individuals', '', count(DISTINCT s) FROM g WHERE p = 'rdf:type'
    UNION ALL SELECT 'class', o, count(*) FROM g WHERE p = 'rdf:type' GROUP BY o UNION ALL SELECT 'property', p, count(*) FROM g GROUP BY p
"""

LINKS = [
    ("refersTo QuranVerse", "refersTo", None, "QuranVerse", None), ("refersTo Hadith", "refersTo", None, "Hadith", None), ("refersTo Dua", "refersTo", None, "Dua", None), ("verses linked to the ontology", EXACT, "QuranVerse", None, QUR),
    ("verses linked to the commentary", EXACT, "QuranVerse", None, TAFSIR), ("hadith linked", EXACT, "Hadith", None, HADITH), ("topics close to a concept", CLOSE, "Topic", None, HADITH), ("containsSegment", "containsSegment", None, None, None),
]


@_q
def kg_links(spark: SparkSession, d: str) -> DataFrame:
    """Counts of links by the class of their ends, and of links out of the graph."""
    return G.link_statistics(graph(spark, d), LINKS)


SQL["kg_links"] = f"WITH {GRAPH_SQL} " + " UNION ALL ".join(
    f"SELECT '{name}' AS metric, count(*) AS n FROM g WHERE p = '{p}'" + (f" AND s IN (SELECT s FROM g WHERE p = 'rdf:type' AND o = '{a}')" if a else "") + (f" AND o IN (SELECT s FROM g WHERE p = 'rdf:type' AND o = '{b}')" if b else "") + (f" AND starts_with(o, '{x}')" if x else "")
    for name, p, a, b, x in LINKS
)


@_q
def kg_usage(spark: SparkSession, d: str) -> DataFrame:
    """Citations by usage, the most frequent first."""
    return G.value_counts(graph(spark, d), "hasUsageType")


SQL["kg_usage"] = f"WITH {GRAPH_SQL} SELECT o AS name, count(*) AS n FROM g WHERE p = 'hasUsageType' GROUP BY o"


@_q
def kg_merge(spark: SparkSession, d: str) -> DataFrame:
    """The graph with speakers of names that differ in case made one node."""
    g = graph(spark, d)
    s = g.of("hasPrimarySpeaker").select(F.col("o").alias("drop")).distinct()
    keep = s.groupBy(F.lower("drop").alias("_l")).agg(F.min("drop").alias("keep"))
    same = s.withColumn("_l", F.lower("drop")).join(keep, "_l").where(F.col("drop") != F.col("keep")).select("drop", "keep")
    return G.merge_nodes(g.all(), same, name="nameEn").groupBy("p").agg(F.count("*").alias("n"), F.count_distinct("o").alias("n_objects"))


SQL["kg_merge"] = f"""
    WITH {GRAPH_SQL}, sp AS (SELECT DISTINCT o AS drop_, min(o) OVER (PARTITION BY lower(o)) AS keep FROM g WHERE p = 'hasPrimarySpeaker'), same AS (SELECT * FROM sp WHERE drop_ <> keep),
    m AS (SELECT g.s, g.p, coalesce(a.keep, g.o) AS o FROM g LEFT JOIN same a ON g.o = a.drop_ WHERE g.s NOT IN (SELECT drop_ FROM same) UNION SELECT keep, 'altLabel', g.o FROM g JOIN same ON g.s = same.drop_ AND g.p = 'nameEn')
    SELECT p, count(*) AS n, count(DISTINCT o) AS n_objects FROM m GROUP BY p
"""


@_q
def kg_decided(spark: SparkSession, d: str) -> DataFrame:
    """Triples by property once topics of one concept are decided on: the first two by name merged, others related."""
    g = graph(spark, d)
    first = F.row_number().over(_by_concept()).alias("n")
    c = concept_hits(g.of("nameEn").join(g.of(G.TYPE, "Topic").select("s"), "s", "left_semi").select(F.col("s").alias("slug"), F.col("o").alias("name")), table(spark, d, "subjects")).select("subject", "slug", first)
    pairs = c.alias("x").join(c.alias("y"), (F.col("x.subject") == F.col("y.subject")) & (F.col("x.n") + 1 == F.col("y.n"))).select(F.col("x.slug").alias("a"), F.col("y.slug").alias("b"), F.when(F.col("x.n") == 1, "accepted").otherwise("related").alias("status"))
    return G.applied(g.all(), pairs, name="nameEn").groupBy("p").agg(F.count("*").alias("n"))


SQL["kg_decided"] = f"""
    WITH RECURSIVE {GRAPH_SQL}, n AS (SELECT subject, 'Topic_' || slug AS node, row_number() OVER (PARTITION BY subject ORDER BY 'Topic_' || slug) AS n FROM cl),
    pr AS (SELECT x.node AS a, y.node AS b, x.n = 1 AS accepted FROM n x JOIN n y ON x.subject = y.subject AND x.n + 1 = y.n),
    dk AS (SELECT b AS drop_, min(a) AS keep FROM pr WHERE accepted AND a <> b GROUP BY b), fl AS (SELECT drop_, keep FROM dk UNION SELECT fl.drop_, dk.keep FROM fl JOIN dk ON fl.keep = dk.drop_),
    rs AS (SELECT drop_, keep FROM fl WHERE keep NOT IN (SELECT drop_ FROM dk)),
    m AS (SELECT g.s, g.p, coalesce(rs.keep, g.o) AS o, g.kind FROM g LEFT JOIN rs ON g.o = rs.drop_ WHERE g.s NOT IN (SELECT drop_ FROM rs) UNION SELECT keep, 'altLabel', g.o, g.kind FROM g JOIN rs ON g.s = rs.drop_ AND g.p = 'nameEn'
        UNION SELECT a, 'skos:related', b, 'iri' FROM pr WHERE NOT accepted UNION SELECT b, 'skos:related', a, 'iri' FROM pr WHERE NOT accepted)
    SELECT p, count(*) AS n FROM m GROUP BY p
"""


def _by_concept():
    from pyspark.sql import Window

    return Window.partitionBy("subject").orderBy("slug")


CQ: dict[str, tuple[str, str]] = {}


def _cq(name: str, doc: str, query: str, sql: str) -> None:
    """Register a question with the SQL on the tables that gives its answer."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        return sparql.select(graph(spark, d), PROLOGUE + query)

    run.__doc__ = doc
    QUERIES[name], SQL[name] = run, f"WITH {TABLES_SQL} {sql}"


REC = "MJL-LIVE-L000000"
_IN_REC = f"""?rec :recordingId "{REC}" . ?rec :hasTranscript/:hasSegment ?seg ."""
_cq("cq01_verses_of_a_recording", "Verses that a recording cites, by start, once for each segment they lie in.",
    f"SELECT ?surah ?verse ?text ?start WHERE {{ {_IN_REC} ?occ :occursIn ?sg . ?sg :containsSegment ?seg . ?occ :refersTo ?v . ?v :surahNumber ?surah ; :verseNumber ?verse ; :textClean ?text . ?occ :startTime ?start . }} ORDER BY ?start ?surah ?verse LIMIT 5",
    f"SELECT CAST(vo.sura AS VARCHAR) AS surah, CAST(vo.aya AS VARCHAR) AS verse, vs.text, CAST(vo.start_s AS VARCHAR) AS start FROM vo JOIN cs USING (grp) JOIN vs ON vs.sura = vo.sura AND vs.aya = vo.aya WHERE vo.recording = '{REC}' AND vs.text IS NOT NULL ORDER BY vo.start_s, vo.sura, vo.aya, vs.text LIMIT 5")
_cq("cq02_recordings_of_a_verse", "Recordings that cite a verse.",
    "SELECT DISTINCT ?id WHERE { ?v :surahNumber 1 ; :verseNumber 1 . ?occ :refersTo ?v ; :occursIn ?sg . ?sg :containsSegment ?seg . ?t :hasSegment ?seg . ?rec :hasTranscript ?t ; :recordingId ?id . }",
    "SELECT DISTINCT cs.recording AS id FROM vo JOIN cs USING (grp) WHERE vo.sura = 1 AND vo.aya = 1")
_cq("cq03_topics_of_a_recording", "Topics of a recording, with a second name where there is one.",
    f"SELECT DISTINCT ?name ?other WHERE {{ {_IN_REC} ?sg :containsSegment ?seg ; :discussesTopic ?topic . ?topic :nameEn ?name . OPTIONAL {{ ?topic :nameUr ?other }} }}",
    f"SELECT DISTINCT nm.name, CAST(NULL AS VARCHAR) AS other FROM tp JOIN cs USING (grp) JOIN nm USING (slug) WHERE cs.recording = '{REC}'")
_cq("cq04_topics_of_several_series", "Topics that more than one series discusses.",
    "SELECT ?name (COUNT(DISTINCT ?series) AS ?n) (GROUP_CONCAT(DISTINCT ?code; separator=', ') AS ?codes) WHERE { ?sg :discussesTopic ?topic . ?sg :containsSegment ?seg . ?t :hasSegment ?seg . ?rec :hasTranscript ?t . ?a :hasRecording ?rec ; :seriesCode ?code . ?topic :nameEn ?name . BIND(?code AS ?series) } GROUP BY ?name HAVING (COUNT(DISTINCT ?series) > 1) ORDER BY DESC(?n)",
    "SELECT nm.name, count(DISTINCT r.series) AS n, string_agg(DISTINCT r.series, ', ' ORDER BY r.series) AS codes FROM tp JOIN cs USING (grp) JOIN nm USING (slug) JOIN recordings r ON r.recording = cs.recording GROUP BY nm.name HAVING count(DISTINCT r.series) > 1")
_cq("cq04_verses_of_several_series", "The same of cited verses.",
    "SELECT ?surah ?verse (COUNT(DISTINCT ?series) AS ?n) (GROUP_CONCAT(DISTINCT ?code; separator=', ') AS ?codes) WHERE { ?occ :refersTo ?v ; :occursIn ?sg . ?sg :containsSegment ?seg . ?t :hasSegment ?seg . ?rec :hasTranscript ?t . ?a :hasRecording ?rec ; :seriesCode ?code . ?v :surahNumber ?surah ; :verseNumber ?verse . BIND(?code AS ?series) } GROUP BY ?surah ?verse HAVING (COUNT(DISTINCT ?series) > 1) ORDER BY DESC(?n)",
    "SELECT CAST(vo.sura AS VARCHAR) AS surah, CAST(vo.aya AS VARCHAR) AS verse, count(DISTINCT r.series) AS n, string_agg(DISTINCT r.series, ', ' ORDER BY r.series) AS codes FROM vo JOIN cs USING (grp) JOIN recordings r ON r.recording = cs.recording GROUP BY vo.sura, vo.aya HAVING count(DISTINCT r.series) > 1")
_cq("cq05_external_hadith", "External entries of the cited hadith.",
    "SELECT ?reference ?uri ?text WHERE { ?h a :Hadith ; skos:exactMatch ?uri ; :reference ?reference . OPTIONAL { ?h :textUthmani ?text } }",
    f"SELECT DISTINCT reference, '{HADITH}SB_' || lpad(substr(reference, 3), 4, '0') AS uri, CAST(NULL AS VARCHAR) AS text FROM hd WHERE regexp_full_match(reference, 'H-\\d+')")
_cq("cq06_topics_of_a_concept", "Topics close to a concept.",
    "SELECT ?name WHERE { ?topic skos:closeMatch hadith:health ; :nameEn ?name . }",
    "SELECT nm.name FROM cl JOIN nm USING (slug) WHERE subject = 'health'")
_cq("cq07_text_of_a_verse", "What is said where a verse is cited.",
    "SELECT ?text ?start WHERE { ?v :surahNumber 1 ; :verseNumber 1 . ?occ :refersTo ?v ; :occursIn ?sg . ?sg :containsSegment ?seg . ?seg :text ?text ; :startTime ?start . } ORDER BY ?start ?text LIMIT 3",
    "SELECT cs.text, CAST(cs.start_s AS VARCHAR) AS start FROM vo JOIN cs USING (grp) WHERE vo.sura = 1 AND vo.aya = 1 AND cs.text IS NOT NULL ORDER BY cs.start_s, cs.text LIMIT 3")
_cq("cq08_series_and_speaker_of_topics", "Series and speaker that discuss each topic of a concept.",
    "SELECT DISTINCT ?title ?speaker WHERE { ?topic skos:closeMatch hadith:health . ?sg :discussesTopic ?topic ; :containsSegment ?seg . ?t :hasSegment ?seg . ?rec :hasTranscript ?t ; :hasPrimarySpeaker ?sp . ?a :hasRecording ?rec ; :titleEn ?title . ?sp :nameEn ?speaker . }",
    "SELECT DISTINCT r.series AS title, r.speaker FROM cl JOIN tp USING (slug) JOIN cs USING (grp) JOIN recordings r ON r.recording = cs.recording WHERE subject = 'health' AND r.speaker IS NOT NULL")
_cq("cq09_hadith_occurrences", "References of hadith occurrences, one row each.",
    "SELECT ?reference WHERE { ?occ a :HadithOccurrence ; :refersTo ?h . ?h :reference ?reference . }",
    f"SELECT h.reference FROM hd o JOIN (SELECT DISTINCT reference, {_SAFE} AS k FROM hd) h ON {_SAFE.replace('reference', 'o.reference')} = h.k")
_cq("cq10_duas_of_a_recording", "Duas of a recording with their translation.",
    f"SELECT DISTINCT ?ref ?en WHERE {{ {_IN_REC} ?occ a :DuaOccurrence ; :occursIn ?sg . ?sg :containsSegment ?seg . ?occ :refersTo ?dua . ?dua :reference ?ref . OPTIONAL {{ ?dua :translationEn ?en }} }} LIMIT 5",
    f"SELECT DISTINCT dd.reference AS ref, dd.en_text AS en FROM du JOIN cs USING (grp) JOIN dd ON dd.reference = du.reference WHERE du.recording = '{REC}' ORDER BY ref NULLS FIRST, en NULLS FIRST LIMIT 5")
_cq("cq11_completeness", "Recordings, and those with a speaker and a language.",
    "SELECT (COUNT(?rec) AS ?total) (COUNT(?sp) AS ?speakers) (COUNT(?lang) AS ?languages) WHERE { ?rec a :Recording . OPTIONAL { ?rec :hasPrimarySpeaker ?sp } OPTIONAL { ?rec :hasPrimaryLanguage ?lang } }",
    "SELECT count(*) AS total, count(speaker) AS speakers, count(lang_label) AS languages FROM recordings")
_cq("cq12_segments_of_recordings", "Number of segments of each recording.",
    "SELECT ?id (COUNT(?seg) AS ?n) WHERE { ?rec :recordingId ?id ; :hasTranscript ?t . ?t :hasSegment ?seg . } GROUP BY ?id",
    "SELECT recording AS id, count(*) AS n FROM sn GROUP BY recording")
_cq("cq13_usage_of_a_citation", "How a recording cites verses.",
    f"SELECT ?label ?surah ?verse WHERE {{ {_IN_REC} ?occ a :VerseOccurrence ; :occursIn ?sg . ?sg :containsSegment ?seg . ?occ :refersTo ?v ; :hasUsageType ?usage . ?v :surahNumber ?surah ; :verseNumber ?verse . ?usage :label ?label . }} ORDER BY ?surah ?verse LIMIT 3",
    f"SELECT usage_name AS label, CAST(sura AS VARCHAR) AS surah, CAST(aya AS VARCHAR) AS verse FROM vo JOIN cs USING (grp) WHERE vo.recording = '{REC}' AND usage_name IS NOT NULL ORDER BY sura, aya, usage_name LIMIT 3")
_cq("cq14_next_segment", "What follows the first segment of each recording.",
    "SELECT ?id ?next WHERE { ?seg :sequenceIndex 0 . ?rec :recordingId ?id ; :hasTranscript ?t . ?t :hasSegment ?seg . ?seg :precedesSegment ?n . ?n :text ?next . }",
    "SELECT recording AS id, text AS next FROM sn WHERE i = 1 AND text IS NOT NULL")
_cq("cq15_external_verses", "Commentary entries of cited verses.",
    "SELECT ?surah ?verse ?uri WHERE { ?a :surahNumber ?surah ; :verseNumber ?verse . ?a skos:exactMatch ?uri . FILTER(STRSTARTS(STR(?uri), STR(tafsir:))) }",
    f"SELECT CAST(sura AS VARCHAR) AS surah, CAST(aya AS VARCHAR) AS verse, '{TAFSIR}V' || lpad(CAST(sura AS VARCHAR), 3, '0') || '_' || lpad(CAST(aya AS VARCHAR), 3, '0') AS uri FROM vs")


@_q
def cq16_commentary(spark: SparkSession, d: str) -> DataFrame:
    """Two steps: a verse's entry in the commentary, then what a second graph says of it (here its translations, by fragment)."""
    g = graph(spark, d)
    one = sparql.select(g, PROLOGUE + "SELECT ?entry WHERE { ?a :surahNumber 1 ; :verseNumber 1 ; skos:exactMatch ?entry . FILTER(STRSTARTS(STR(?entry), STR(tafsir:))) }")
    canon = table(spark, d, "canon").where("kind = 'ayah'")
    node = lambda kind: F.format_string(f"{TAFSIR}{kind}%03d_%03d", "sura", "aya")
    other = G.Triples.of_rules([(canon, node("V"), [(TAFSIR + "containsVerseFragment", node("F"), "iri")]), (canon, node("S"), [(TAFSIR + "isAbout", node("F"), "iri"), (TAFSIR + "containsCommentary", node("C"), "iri")]), (canon, node("C"), [(TAFSIR + "hasText", F.col("en_text"), "literal")])])
    two = sparql.select(other, f"PREFIX t: <{TAFSIR}> SELECT ?entry ?text WHERE {{ ?entry t:containsVerseFragment ?f . ?section t:isAbout ?f ; t:containsCommentary ?c . ?c t:hasText ?text . }}")
    return one.join(two, "entry")


SQL["cq16_commentary"] = f"""
    WITH {TABLES_SQL} SELECT '{TAFSIR}V001_001' AS entry, c.en_text AS text FROM canon c WHERE c.kind = 'ayah' AND c.sura = 1 AND c.aya = 1 AND c.en_text IS NOT NULL AND EXISTS (SELECT 1 FROM vs WHERE sura = 1 AND aya = 1)
"""


@_q
def concept_keywords(spark: SparkSession, d: str) -> DataFrame:
    """Topics whose name holds a keyword of a subject, with the keywords held."""
    e = entities(spark, d, "topic").where(F.trim("text") != "").withColumn("slug", T.slug(F.lower(F.trim("text")))).where("slug <> ''")
    return concept_hits(e.groupBy("slug").agg(F.min_by("text", "entity_id").alias("name")), table(spark, d, "subjects"))


SQL["concept_keywords"] = f"WITH {TABLES_SQL} SELECT slug, subject, hits FROM cl"


@_q
def collection_tally(spark: SparkSession, d: str) -> DataFrame:
    """Hadith occurrences by the collection of their reference."""
    rows = sparql.select(graph(spark, d), PROLOGUE + "SELECT ?reference WHERE { ?occ a :HadithOccurrence ; :refersTo ?h . ?h :reference ?reference . }")
    return rows.groupBy(F.split_part(F.regexp_replace("reference", "-", "_"), F.lit("_"), F.lit(1)).alias("collection")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "collection")


SQL["collection_tally"] = f"WITH {TABLES_SQL} SELECT split_part(replace(reference, '-', '_'), '_', 1) AS collection, count(*) AS n FROM hd GROUP BY 1"


@_q
def kg_segment_groups(spark: SparkSession, d: str) -> DataFrame:
    """Groups of v3 segments that each citation or topic covers."""
    return graph(spark, d).of("containsSegment").groupBy(F.col("s").alias("node")).agg(F.count("*").alias("n_segments"), F.min("o").alias("first_segment"))


SQL["kg_segment_groups"] = f"WITH {TABLES_SQL} SELECT grp AS node, count(*) AS n_segments, min(node) AS first_segment FROM cs GROUP BY grp"
