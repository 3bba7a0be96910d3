"""Reports: error rates, agreement, retrieval and citation metrics, pooled by group."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import agreement
from tessera.operators.retrieval import shares
from tessera.plans.common import ENTITIES_SQL, REVIEWS_SQL, SEGMENTS_SQL, entities, reviews, segments, words_sql
from tessera.session import table

QUERIES, SQL = {}, {}


def _q(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _versions(spark: SparkSession, d: str, ref: str, hyp: str) -> DataFrame:
    """Texts of two versions of each logical segment."""
    s = segments(spark, d, ref, hyp)
    side = lambda v, n: s.where(F.col("version") == v).select("recording", "seq", "series", F.col("text").alias(n))
    return side(ref, "ref").join(side(hyp, "hyp").drop("series"), ["recording", "seq"])


@_q
def changed_segment_rate(spark: SparkSession, d: str) -> DataFrame:
    p = _versions(spark, d, "v3", "v2")
    return p.groupBy("recording").agg(F.count("*").alias("n_segments"), F.count_if(~F.col("ref").eqNullSafe(F.col("hyp"))).alias("n_changed")).withColumn("rate", F.round(F.col("n_changed") / F.col("n_segments"), 6))


SQL["changed_segment_rate"] = f"""
    WITH {SEGMENTS_SQL} SELECT a.recording, count(*) AS n_segments, count(*) FILTER (a.text IS DISTINCT FROM b.text) AS n_changed,
        round(count(*) FILTER (a.text IS DISTINCT FROM b.text) / count(*), 6) AS rate
    FROM segs a JOIN segs b ON a.recording = b.recording AND a.seq = b.seq AND a.version = 'v3' AND b.version = 'v2' GROUP BY a.recording
"""


HEADLINE = "without_diacritics"
COMPARED = ("v0", "v1", "v2")


def _rates(spark: SparkSession, d: str, profiles: tuple[str, ...], group: str = "series") -> DataFrame:
    s = segments(spark, d, "v3", *COMPARED)
    by = s.groupBy("recording", "seq").agg(F.max("series").alias("series"), F.map_from_entries(F.collect_list(F.struct("version", F.coalesce("text", F.lit("")).alias("text")))).alias("t"))
    hyp = F.explode(F.filter(F.array(*[F.when(F.map_contains_key("t", v), F.struct(F.lit(v).alias("version"), F.col("t")[v].alias("hyp"))) for v in COMPARED]), lambda x: x.isNotNull()))
    pairs = by.where(F.map_contains_key("t", "v3")).select(F.col(group).alias("series"), F.col("t")["v3"].alias("ref"), hyp.alias("h")).select("series", "h.version", F.explode(T.in_profiles(F.col("ref"), F.col("h.hyp"), profiles)).alias("x"))
    one = pairs.select("series", "version", T.distance(F.col("x.ref"), F.col("x.hyp")).alias("e"), F.explode("x.of").alias("o")).select("series", "version", "o.profile", "o.unit", "e", F.col("o.n").alias("n"))
    sums = one.groupBy("series", "version", "profile", "unit").agg(F.sum("e").alias("e"), F.sum("n").alias("n")).groupingSets([["series", "version", "profile", "unit"], ["version", "profile", "unit"]], "series", "version", "profile", "unit").agg(F.sum("e").alias("edits"), F.sum("n").alias("units"), F.grouping("series").alias("g"))
    return sums.select(F.when(F.col("g") == 1, "ALL").otherwise(F.col("series")).alias("series"), "version", "profile", "unit", "edits", "units", F.round(F.try_divide(100 * F.col("edits"), F.col("units")), 6).alias("rate"))


@_q
def error_profiles(spark: SparkSession, d: str) -> DataFrame:
    """Character and word error rates of each version against v3 in all six profiles, pooled (sums before ratios) by series and in all.

    Segments are compared with their own reviewed text, over the whole stored texts; null texts are empty.
    """
    return _rates(spark, d, tuple(T.PROFILES))


def _sql_text(column: str) -> str:
    return "'" + column.replace("'", "''") + "'"


def _profile_sql(profile: str, text: str) -> str:
    """The rules of a profile in SQL, from the same tables of letters and marks."""
    letters, marks = T.profile_tables(profile)
    t = f"nfc_normalize({text})"
    if letters:
        table = "MAP {" + ", ".join(f"{_sql_text(chr(k))}: {_sql_text(v)}" for k, v in letters.items()) + "}"
        t = f"nfc_normalize(list_aggregate(list_transform(string_split({t}, ''), lambda c: coalesce({table}[c], c)), 'string_agg', ''))"
    if T.PROFILES[profile][2]:
        t = f"regexp_replace({t}, '([^\\s\\x0b\\x{{85}}\\p{{Z}}])([۔،؟!.,?])', '\\1 \\2', 'g')"
        t = f"regexp_replace({t}, '([۔،؟!.,?])([۔،؟!.,?])', '\\1 \\2', 'g')"
        t = f"regexp_replace({t}, '([۔،؟!.,?])([۔،؟!.,?])', '\\1 \\2', 'g')"
    if marks:
        t = f"regexp_replace({t}, '[{''.join(map(chr, marks))}]', '', 'g')"
    return words_sql(t)


# The distance of two lists row by row; slow, for the few with more shared items than there are bytes.
_TABLE_SQL = """list_reduce(list_prepend(range(0, len(r) + 1), list_transform(range(1, len(h) + 1), lambda j: [j])), lambda row, x:
        list_transform([list_prepend(row[1] + 1, list_transform(range(1, len(r) + 1), lambda i: least(row[i + 1] + 1, row[i] + CASE WHEN r[i] = h[x[1]] THEN 0 ELSE 1 END)))], lambda t:
            list_transform(range(1, len(r) + 2), lambda i: list_min(list_transform(range(1, i + 1), lambda m: t[m] + i - m))))[1])[len(r) + 1]"""
# Distances in SQL are of bytes: what both lists begin and end with is cut off, and of the rest each item that both have is
# one character of one byte; all that only one side has are alike.
_DISTANCE_SQL = f"""
    cut1 AS (SELECT *, coalesce(list_position(list_transform(range(1, least(len(r), len(h)) + 1), lambda i: r[i] <> h[i]), true) - 1, least(len(r), len(h))) AS lead FROM units),
    cut2 AS (SELECT * EXCLUDE (r, h), len(r) AS n, r[lead + 1:] AS r, h[lead + 1:] AS h FROM cut1),
    cut3 AS (SELECT *, coalesce(list_position(list_transform(range(1, least(len(r), len(h)) + 1), lambda i: r[len(r) + 1 - i] <> h[len(h) + 1 - i]), true) - 1, least(len(r), len(h))) AS tail FROM cut2),
    cut4 AS (SELECT * EXCLUDE (r, h), r[:len(r) - tail] AS r, h[:len(h) - tail] AS h FROM cut3),
    known AS (SELECT *, list_sort(list_distinct(list_intersect(r, h))) AS k FROM cut4),
    coded AS (SELECT *, coalesce(list_aggregate(list_transform(r, lambda x: chr(CAST(least(coalesce(list_position(k, x), 126), 126) AS INTEGER))), 'string_agg', ''), '') AS a,
        coalesce(list_aggregate(list_transform(h, lambda x: chr(CAST(least(coalesce(list_position(k, x), 127), 127) AS INTEGER))), 'string_agg', ''), '') AS b FROM known),
    edits AS (SELECT series, version, profile, unit, CASE WHEN len(k) > 125 THEN {_TABLE_SQL} WHEN a = '' THEN length(b) WHEN b = '' THEN length(a) ELSE levenshtein(a, b) END AS e, n FROM coded)"""


def _error_sql(profiles: tuple[str, ...], units: tuple[str, ...], group: str = "series") -> str:
    words = " UNION ALL ".join(f"SELECT series, version, '{p}' AS profile, {_profile_sql(p, 'rt')} AS rw, {_profile_sql(p, 'ht')} AS hw FROM p" for p in profiles)
    letters = lambda w: f"CASE WHEN len({w}) = 0 THEN [] ELSE string_split(array_to_string({w}, ' '), '') END"
    made = {"cer": f"SELECT series, version, profile, 'cer' AS unit, {letters('rw')} AS r, {letters('hw')} AS h FROM w", "wer": "SELECT series, version, profile, 'wer' AS unit, rw AS r, hw AS h FROM w"}
    return f"""{SEGMENTS_SQL},
    p AS (SELECT a.{group} AS series, b.version, coalesce(a.text, '') AS rt, coalesce(b.text, '') AS ht FROM segs a JOIN segs b ON a.recording = b.recording AND a.seq = b.seq AND a.version = 'v3' AND b.version IN ('v0', 'v1', 'v2')),
    w AS ({words}), units AS ({" UNION ALL ".join(made[u] for u in units)}), {_DISTANCE_SQL},
    rates AS (SELECT CASE WHEN grouping(series) = 1 THEN 'ALL' ELSE series END AS series, version, profile, unit, CAST(sum(e) AS BIGINT) AS edits, CAST(sum(n) AS BIGINT) AS units, CASE WHEN sum(n) > 0 THEN round(100 * sum(e) / sum(n), 6) END AS rate
        FROM edits GROUP BY GROUPING SETS ((series, version, profile, unit), (version, profile, unit)))"""


SQL["error_profiles"] = f"WITH {_error_sql(tuple(T.PROFILES), ('cer', 'wer'))} SELECT * FROM rates"


@_q
def pooled_error_rate(spark: SparkSession, d: str) -> DataFrame:
    """The rates of the headline profile."""
    return _rates(spark, d, (HEADLINE,)).drop("profile")


SQL["pooled_error_rate"] = f"WITH {_error_sql((HEADLINE,), ('cer', 'wer'))} SELECT * EXCLUDE (profile) FROM rates"


@_q
def error_reduction(spark: SparkSession, d: str) -> DataFrame:
    """Relative reduction of the headline rates between versions, by series and unit; null where the first rate is 0."""
    r = pooled_error_rate(spark, d).groupBy("series", "unit").pivot("version", list(COMPARED)).agg(F.first("rate"))
    drop = lambda a, b: F.round(F.try_divide(100 * (F.col(a) - F.col(b)), F.col(a)), 4).alias(f"{a}_to_{b}")
    return r.select("series", "unit", drop("v0", "v1"), drop("v1", "v2"), drop("v0", "v2"))


SQL["error_reduction"] = f"""
    WITH {_error_sql((HEADLINE,), ("cer", "wer"))}, v AS (SELECT series, unit, max(rate) FILTER (version = 'v0') AS v0, max(rate) FILTER (version = 'v1') AS v1, max(rate) FILTER (version = 'v2') AS v2 FROM rates GROUP BY series, unit)
    SELECT series, unit, round(100 * (v0 - v1) / nullif(v0, 0), 4) AS v0_to_v1, round(100 * (v1 - v2) / nullif(v1, 0), 4) AS v1_to_v2, round(100 * (v0 - v2) / nullif(v0, 0), 4) AS v0_to_v2 FROM v
"""


@_q
def word_error_totals(spark: SparkSession, d: str) -> DataFrame:
    """Substitutions, deletions and insertions of words from v3 to v2 by series, in the relaxed profile without marks."""
    p = _versions(spark, d, "v3", "v2").where(F.col("ref").isNotNull() & F.col("hyp").isNotNull())
    prof = "relaxed_without_diacritics"
    e = p.select("series", T.word_edits(T.in_profile(F.col("ref"), prof), T.in_profile(F.col("hyp"), prof)).alias("e")).select("series", "e.*")
    return e.groupBy("series").agg(*[F.sum(c).alias(c) for c in ("substitutions", "deletions", "insertions", "units")])


@_q
def word_edit_rows(spark: SparkSession, d: str) -> DataFrame:
    """One row per word edit between v3 and v2 with its class and context."""
    p = _versions(spark, d, "v3", "v2").where(~F.col("ref").eqNullSafe(F.col("hyp")) & F.col("ref").isNotNull() & F.col("hyp").isNotNull())
    rows = p.select("recording", "seq", F.inline(T.word_differences(F.col("ref"), F.col("hyp"))))
    return rows.withColumn("category", edit_category(F.col("kind"), F.col("ref_word"), F.col("hyp_word")))


# Words of set phrases, and names, that put an edit into a class of its own.
PHRASE_WORDS = (
    "الله", "اللہ", "اله", "إله", "له", "لله", "وهو", "لا", "الا", "إلا", "سبحان", "سبحانه", "وحده", "شريك", "اكبر", "أكبر", "حمد", "للہ", "الحليم",
    "صلى", "صلي", "صل", "عليه", "عليہ", "وسلم", "رسول", "اللهم",
)
NAMES = (
    "محمد", "ابرهيم", "ابراهيم", "علي", "عمر", "عمرو", "عثمان", "عائشہ", "عائشة", "بلال", "خالد", "ابوبكر", "ابو", "هريرہ", "ہريرہ", "حرارہ", "حريرہ",
    "اسماعيل", "موسى", "موسي", "عيسى", "عيسي", "يوسف", "يعقوب",
)


def edit_category(kind, ref, hyp):
    """Class of an edit: the first rule of punctuation, name, set phrase, script, spelling that holds, else content."""
    mark = lambda c: F.coalesce(F.trim(c).rlike(r"^[،۔؟!.,?:;؛-]+$"), F.lit(False))
    among = lambda c, xs: F.coalesce(c.isin(*xs), F.lit(False))
    a, b = T.dominant_script(ref), T.dominant_script(hyp)
    other = (kind == "substitution") & a.isNotNull() & b.isNotNull() & (a != b)
    near = (kind == "substitution") & (F.levenshtein(ref, hyp) <= 2) & (F.greatest(F.char_length(ref), F.char_length(hyp)) >= 2)
    return (
        F.when(mark(ref) | mark(hyp), "punctuation").when(among(ref, NAMES) | among(hyp, NAMES), "proper_noun_identity").when(among(ref, PHRASE_WORDS) | among(hyp, PHRASE_WORDS), "formula_wording")
        .when(other & ((a == "latin") | (b == "latin")), "code_switch_transliteration").when(other, "script_conversion").when(near, "spelling_typographical").otherwise("wrong_missing_text")
    )


@_q
def error_taxonomy(spark: SparkSession, d: str) -> DataFrame:
    """Word edits and affected segments by recording and class."""
    return word_edit_rows(spark, d).groupBy("recording", "category").agg(F.count("*").alias("n_edits"), F.count_distinct("seq").alias("n_segments"))


TAXONOMY = ("content", "spelling", "punctuation", "formula_wording", "script_form", "code_switch", "name_form")


@_q
def taxonomy_report(spark: SparkSession, d: str) -> DataFrame:
    """Residual differences pooled by series and in all, with the share of content errors."""
    t = table(spark, d, "rq1_error_taxonomy")
    sums = t.rollup("series").agg(F.count("*").alias("n_recordings"), F.sum("residual_diffs").alias("residual_diffs"), *[F.sum(c).alias(c) for c in TAXONOMY])
    return sums.select(F.coalesce("series", F.lit("ALL")).alias("series"), "n_recordings", "residual_diffs", *TAXONOMY, F.round(F.try_divide(F.col("content"), F.col("residual_diffs")), 6).alias("content_share"))


SQL["taxonomy_report"] = f"""
    SELECT coalesce(series, 'ALL') AS series, count(*) AS n_recordings, CAST(sum(residual_diffs) AS BIGINT) AS residual_diffs,
        {", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in TAXONOMY)}, round(sum(content) / nullif(sum(residual_diffs), 0), 6) AS content_share
    FROM rq1_error_taxonomy GROUP BY ROLLUP (series)
"""


@_q
def stale_segment_counts(spark: SparkSession, d: str) -> DataFrame:
    """Evaluated recordings whose stated number of v2 segments isn't the number there is."""
    have = segments(spark, d, "v2").groupBy("recording").agg(F.count("*").alias("n_v2"))
    t = table(spark, d, "rq1_error_taxonomy").select("recording", "v2_segments").join(have, "recording", "left")
    return t.select("recording", "v2_segments", F.coalesce("n_v2", F.lit(0)).alias("n_v2")).where(~F.col("v2_segments").eqNullSafe(F.col("n_v2")))


SQL["stale_segment_counts"] = f"""
    WITH {SEGMENTS_SQL}, h AS (SELECT recording, count(*) AS n FROM segs WHERE version = 'v2' GROUP BY recording)
    SELECT t.recording, v2_segments, coalesce(n, 0) AS n_v2 FROM rq1_error_taxonomy t LEFT JOIN h ON t.recording = h.recording WHERE v2_segments IS DISTINCT FROM coalesce(n, 0)
"""


@_q
def structure_classes(spark: SparkSession, d: str) -> DataFrame:
    """How the reviewed segments of a recording stand to those of v2: ratios of segments and of words (two digits, before they are
    compared), and a class."""
    s = segments(spark, d, "v2", "v3")
    n = s.groupBy("recording").pivot("version", ["v2", "v3"]).agg(F.count(F.lit(1)).alias("n"), F.sum(F.size(T.words(F.col("text")))).alias("w"))
    seg, word = F.round(F.try_divide(F.coalesce("v3_n", F.lit(0)), F.col("v2_n")), 2), F.round(F.try_divide(F.coalesce("v3_w", F.lit(0)), F.col("v2_w")), 2)
    close = F.coalesce(F.abs(word - 1) <= 0.15, F.lit(False))
    kind = F.when(seg.isNull(), "none").when(F.abs(seg - 1) <= 0.1, "neutral").when((seg > 1.1) & close, "split").when((seg < 0.9) & close, "merge").otherwise("both")
    return n.where(F.col("v3_n").isNotNull()).select("recording", seg.alias("segment_ratio"), word.alias("word_ratio"), kind.alias("structure"))


SQL["structure_classes"] = f"""
    WITH {SEGMENTS_SQL}, n AS (SELECT recording, count(*) FILTER (version = 'v2') AS n2, count(*) FILTER (version = 'v3') AS n3, coalesce(sum(len({words_sql("text")})) FILTER (version = 'v2'), 0) AS w2, coalesce(sum(len({words_sql("text")})) FILTER (version = 'v3'), 0) AS w3 FROM segs GROUP BY recording),
    r AS (SELECT recording, round(n3 / nullif(n2, 0), 2) AS segment_ratio, round(w3 / nullif(w2, 0), 2) AS word_ratio FROM n WHERE n3 > 0)
    SELECT *, CASE WHEN segment_ratio IS NULL THEN 'none' WHEN abs(segment_ratio - 1) <= 0.1 THEN 'neutral' WHEN segment_ratio > 1.1 AND abs(word_ratio - 1) <= 0.15 THEN 'split' WHEN segment_ratio < 0.9 AND abs(word_ratio - 1) <= 0.15 THEN 'merge' ELSE 'both' END AS structure FROM r
"""


@_q
def correction_acceptance(spark: SparkSession, d: str) -> DataFrame:
    """Corrections v0 to v1 by recording: all, and those within the character and word ratios."""
    p = _versions(spark, d, "v0", "v1")
    ok = F.coalesce(T.correction_accepted(F.coalesce(F.col("ref"), F.lit("")), F.col("hyp")), F.lit(False))
    return p.groupBy("recording").agg(F.count("*").alias("n_corrections"), F.count_if(ok).alias("n_accepted"))


SQL["correction_acceptance"] = f"""
    WITH {SEGMENTS_SQL}, p AS (SELECT a.recording, coalesce(a.text, '') AS r, b.text AS h FROM segs a JOIN segs b ON a.recording = b.recording AND a.seq = b.seq AND a.version = 'v0' AND b.version = 'v1'),
    n AS (SELECT recording, h, length(regexp_replace(h, '{T.MARKS}', '', 'g')) / greatest(length(regexp_replace(r, '{T.MARKS}', '', 'g')), 1) AS c, len({words_sql("h")}) / greatest(len({words_sql("r")}), 1) AS w, len({words_sql("h")}) AS k FROM p)
    SELECT recording, count(*) AS n_corrections, count(*) FILTER (h IS NOT NULL AND k > 0 AND c BETWEEN 0.90 AND 1.10 AND w BETWEEN 1.00 AND 1.15) AS n_accepted FROM n GROUP BY recording
"""


@_q
def review_effort(spark: SparkSession, d: str) -> DataFrame:
    """Hours spent per hour of audio, pooled by series and in all (sums before the ratio)."""
    spent = reviews(spark, d).groupBy(F.col("scope_label").alias("recording")).agg(F.sum("elapsed_seconds").alias("spent"))
    r = table(spark, d, "recordings").where(F.col("duration_s") > 0).join(spent, "recording")
    sums = r.rollup("series").agg(F.count("*").alias("n_recordings"), F.sum("spent").alias("spent"), F.sum("duration_s").alias("audio"))
    return sums.select(F.coalesce("series", F.lit("ALL")).alias("series"), "n_recordings", F.round(F.col("spent") / 3600, 6).alias("hours"), F.round(F.try_divide(F.col("spent"), F.col("audio")), 6).alias("rtf"))


SQL["review_effort"] = f"""
    WITH {REVIEWS_SQL}, s AS (SELECT scope_label AS recording, sum(elapsed_seconds) AS spent FROM revs GROUP BY ALL)
    SELECT coalesce(series, 'ALL') AS series, count(*) AS n_recordings, round(sum(spent) / 3600, 6) AS hours, round(sum(spent) / sum(duration_s), 6) AS rtf
    FROM recordings r JOIN s ON r.recording = s.recording WHERE duration_s > 0 GROUP BY ROLLUP (series)
"""


def _graded(spark: SparkSession, d: str) -> DataFrame:
    r = reviews(spark, d)
    p, c = shares(F.col("gold_chunk_ids"), F.col("cited_chunk_ids"))
    return r.withColumn("precision", p).withColumn("recall", c).withColumn("model", F.coalesce("generation_model", F.lit("unknown"))).withColumn("language", F.coalesce(F.nullif(F.lower(F.trim("question_language")), F.lit("")), F.lit("unknown")))


_GRADED_SQL = f"""{REVIEWS_SQL}, g AS (SELECT *, coalesce(generation_model, 'unknown') AS model, coalesce(nullif(lower(trim(question_language)), ''), 'unknown') AS language,
        list_distinct(coalesce(gold_chunk_ids, [])) AS gs, list_distinct(coalesce(cited_chunk_ids, [])) AS cs FROM revs),
    m AS (SELECT *, len(list_intersect(gs, cs)) / nullif(len(cs), 0) AS precision, len(list_intersect(gs, cs)) / nullif(len(gs), 0) AS recall FROM g)"""


@_q
def answer_slices(spark: SparkSession, d: str) -> DataFrame:
    """Citation precision and recall, share without citation and of right answers by model, language, both, and in all."""
    g = _graded(spark, d).groupingSets([["model"], ["language"], ["model", "language"], []], "model", "language").agg(
        F.count("*").alias("n"), F.round(F.avg("precision"), 6).alias("precision"), F.round(F.avg("recall"), 6).alias("recall"),
        F.round(F.avg((F.size(F.coalesce("cited_chunk_ids", F.array().cast("array<string>"))) == 0).cast("double")), 6).alias("no_citation"),
        F.count("answer_verdict").alias("graded"), F.count_if(F.col("answer_verdict").isin("correct_grounded", "correct_refusal")).alias("correct"), F.grouping_id().alias("level"),
    )
    return g.select(F.coalesce("model", F.lit("*")).alias("model"), F.coalesce("language", F.lit("*")).alias("language"), F.col("level").cast("int").alias("level"), "n", "precision", "recall", "no_citation", "graded", "correct", F.round(F.try_divide(F.col("correct"), F.col("graded")), 6).alias("accuracy"))


SQL["answer_slices"] = f"""
    WITH {_GRADED_SQL}
    SELECT coalesce(model, '*') AS model, coalesce(language, '*') AS language, CAST(grouping(model, language) AS INTEGER) AS level, count(*) AS n, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall,
        round(avg(CASE WHEN len(coalesce(cited_chunk_ids, [])) = 0 THEN 1.0 ELSE 0.0 END), 6) AS no_citation, count(answer_verdict) AS graded,
        count(*) FILTER (answer_verdict IN ('correct_grounded', 'correct_refusal')) AS correct,
        round(count(*) FILTER (answer_verdict IN ('correct_grounded', 'correct_refusal')) / nullif(count(answer_verdict), 0), 6) AS accuracy
    FROM m GROUP BY GROUPING SETS ((model), (language), (model, language), ())
"""

VERDICTS = ("correct_grounded", "partially_correct", "incorrect", "correct_refusal")


@_q
def verdict_pivot(spark: SparkSession, d: str) -> DataFrame:
    """Answers by model and verdict, zero where there are none."""
    r = reviews(spark, d).withColumn("model", F.coalesce("generation_model", F.lit("unknown")))
    return r.groupBy("model").pivot("answer_verdict", list(VERDICTS)).count().fillna(0)


SQL["verdict_pivot"] = f"""
    WITH {REVIEWS_SQL} SELECT coalesce(generation_model, 'unknown') AS model, {", ".join(f"count(*) FILTER (answer_verdict = '{v}') AS {v}" for v in VERDICTS)} FROM revs GROUP BY ALL
"""


@_q
def reciprocal_rank(spark: SparkSession, d: str) -> DataFrame:
    """Mean reciprocal rank of the first gold chunk among the cited ones, and share of questions with one, by scope; no gold found counts 0."""
    r = reviews(spark, d).where(F.size("gold_chunk_ids") > 0)
    rank = F.array_min(F.filter(F.transform("gold_chunk_ids", lambda g: F.array_position(F.coalesce("cited_chunk_ids", F.array().cast("array<string>")), g)), lambda x: x > 0))
    n = r.select("search_scope", rank.alias("rank")).groupBy("search_scope").agg(F.count("*").alias("n"), F.round(F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))), 6).alias("mrr"), F.round(F.avg(F.col("rank").isNotNull().cast("double")), 6).alias("hit"))
    return n


SQL["reciprocal_rank"] = f"""
    WITH {REVIEWS_SQL}, k AS (SELECT search_scope, list_min(list_filter(list_transform(gold_chunk_ids, lambda g: list_position(coalesce(cited_chunk_ids, []), g)), lambda x: x > 0)) AS rank FROM revs WHERE len(gold_chunk_ids) > 0)
    SELECT search_scope, count(*) AS n, round(avg(coalesce(1.0 / rank, 0)), 6) AS mrr, round(avg(CASE WHEN rank IS NULL THEN 0.0 ELSE 1.0 END), 6) AS hit FROM k GROUP BY search_scope
"""


@_q
def citation_containment(spark: SparkSession, d: str) -> DataFrame:
    """Cited chunk ids that the answer's text holds, by review; reviews that cite nothing are left out."""
    r = reviews(spark, d).where(F.size("cited_chunk_ids") > 0)
    held = F.filter("cited_chunk_ids", lambda c: F.coalesce(F.contains("generated_answer", c), F.lit(False)))
    return r.select("review_id", F.size("cited_chunk_ids").alias("n_cited"), F.size(held).alias("n_in_text"))


SQL["citation_containment"] = f"""
    WITH {REVIEWS_SQL} SELECT review_id, len(cited_chunk_ids) AS n_cited, len(list_filter(cited_chunk_ids, lambda c: coalesce(contains(generated_answer, c), false))) AS n_in_text FROM revs WHERE len(cited_chunk_ids) > 0
"""


@_q
def review_integrity(spark: SparkSession, d: str) -> DataFrame:
    """Reviews without a question, those whose copied fields differ from their question's, and those whose cited chunks aren't in the answer's text."""
    q = table(spark, d, "questions").select("q_key", F.col("question").alias("_q"), F.col("answerable").alias("_a"), F.col("gold_chunk_ids").alias("_g"))
    j = reviews(spark, d).join(q.withColumn("_there", F.lit(True)), "q_key", "left")
    said = F.forall(F.coalesce("cited_chunk_ids", F.array().cast("array<string>")), lambda c: F.coalesce(F.contains("generated_answer", c), F.lit(False)))
    issue = (
        F.when(F.col("_there").isNull(), "no question").when(~F.col("question").eqNullSafe(F.col("_q")), "question").when(~F.col("answerable").eqNullSafe(F.col("_a")), "answerable")
        .when(~F.col("gold_chunk_ids").eqNullSafe(F.col("_g")), "gold").when(~said, "citations")
    )
    return j.select("review_id", issue.alias("issue")).where(F.col("issue").isNotNull())


SQL["review_integrity"] = f"""
    WITH {REVIEWS_SQL}, j AS (SELECT review_id, CASE WHEN q.q_key IS NULL THEN 'no question' WHEN r.question IS DISTINCT FROM q.question THEN 'question'
        WHEN r.answerable IS DISTINCT FROM q.answerable THEN 'answerable' WHEN r.gold_chunk_ids IS DISTINCT FROM q.gold_chunk_ids THEN 'gold'
        WHEN len(list_filter(coalesce(r.cited_chunk_ids, []), lambda c: NOT coalesce(contains(r.generated_answer, c), false))) > 0 THEN 'citations' END AS issue FROM revs r LEFT JOIN questions q ON r.q_key = q.q_key)
    SELECT review_id, issue FROM j WHERE issue IS NOT NULL
"""


FOUND_USES, WANTED_USES = ("quotation", "translation"), ("quotation", "paraphrase")


def _agreement(spark: SparkSession, d: str) -> DataFrame:
    """Counts by series, recording and kind of the citations in two overlapping sets of uses, starts in tenths of a second as Python rounds."""
    e = entities(spark, d, "ayah", "dua", "hadith").where(F.col("recording").isNotNull()).join(table(spark, d, "recordings").select("recording", "series"), "recording")
    e = e.select("series", "recording", "etype", F.when(F.col("etype") == "ayah", F.col("surah_number")).otherwise(F.col("reference")).alias("k1"), F.when(F.col("etype") == "ayah", F.col("ayah_number")).alias("k2"), T.half_even(F.coalesce("start_s", F.lit(0.0)), F.lit(1)).alias("at"), "text", "entity_id", F.lower(F.trim("usage")).alias("use"))
    side = lambda uses: e.where(F.col("use").isin(*uses))
    return agreement.counts(side(FOUND_USES), side(WANTED_USES), ["series", "recording", "etype"], ["k1", "k2"], "at", "text", "entity_id")


def _rates_sql(source: str) -> str:
    d = lambda a, b: f"({a}) / nullif({b}, 0)"
    f1 = lambda p, r: f"CASE WHEN {p} > 0 AND {r} > 0 THEN 2 * {p} * {r} / ({p} + {r}) END"
    p, r, ep, er = d("matched", "matched + rejected"), d("matched", "matched + added"), d("entity_matched", "found_entities"), d("entity_matched", "wanted_entities")
    new = {"occurrence_precision": p, "occurrence_recall": r, "occurrence_f1": f1(p, r), "entity_precision": ep, "entity_recall": er, "entity_f1": f1(ep, er), "retention": d("retained", "found"), "correction": d("corrected", "found"), "rejection": d("rejected", "found"), "omission": d("added", "wanted")}
    return f"SELECT *, {', '.join(f'round({v}, 6) AS {k}' for k, v in new.items())} FROM {source}"


_AGREEMENT_SQL = f"""{ENTITIES_SQL},
    e AS (SELECT r.series, e.recording, etype, CASE WHEN etype = 'ayah' THEN surah_number ELSE reference END AS k1, CASE WHEN etype = 'ayah' THEN ayah_number END AS k2, CAST(printf('%.1f', coalesce(start_s, 0.0)) AS DOUBLE) AS t, trim(coalesce(text, ''), ' ') AS text, entity_id, lower(trim(usage)) AS use
        FROM ents e JOIN recordings r ON e.recording = r.recording WHERE etype IN ('ayah', 'dua', 'hadith')),
    b AS (SELECT *, 0 AS w FROM e WHERE use IN {FOUND_USES} UNION ALL SELECT *, 1 FROM e WHERE use IN {WANTED_USES}),
    o AS (SELECT series, recording, etype, k1, k2, t, count(*) FILTER (w = 0) AS nf, count(*) FILTER (w = 1) AS nw, arg_max(text, entity_id) FILTER (w = 0) AS tf, arg_max(text, entity_id) FILTER (w = 1) AS tw FROM b GROUP BY ALL),
    n AS (SELECT series, recording, etype, k1, k2, sum(nf) AS found, sum(nw) AS wanted, count(*) FILTER (nf > 0 AND nw > 0) AS matched, count(*) FILTER (nf > 0 AND nw > 0 AND tf = tw) AS retained, count(*) FILTER (nw = 0) AS rejected, count(*) FILTER (nf = 0) AS added FROM o GROUP BY ALL),
    c AS (SELECT series, recording, etype, CAST(sum(found) AS BIGINT) AS found, CAST(sum(wanted) AS BIGINT) AS wanted, count(*) FILTER (found > 0) AS found_entities, count(*) FILTER (wanted > 0) AS wanted_entities, count(*) FILTER (found > 0 AND wanted > 0) AS entity_matched,
        CAST(sum(matched) AS BIGINT) AS matched, CAST(sum(retained) AS BIGINT) AS retained, CAST(sum(matched) - sum(retained) AS BIGINT) AS corrected, CAST(sum(rejected) AS BIGINT) AS rejected, CAST(sum(added) AS BIGINT) AS added FROM n GROUP BY ALL)"""


@_q
def entity_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Agreement of two sets of citations in each recording by kind: occurrences, entities, rates."""
    return agreement.rates(_agreement(spark, d))


SQL["entity_agreement"] = f"WITH {_AGREEMENT_SQL} {_rates_sql('c')}"


@_q
def entity_agreement_pooled(spark: SparkSession, d: str) -> DataFrame:
    """The same by series and in all: sums of counts before the ratios."""
    return agreement.rates(agreement.pooled(_agreement(spark, d), ["etype"], "series"))


SQL["entity_agreement_pooled"] = f"""
    WITH {_AGREEMENT_SQL}, s AS (SELECT etype, CASE WHEN grouping(series) = 1 THEN 'ALL' ELSE series END AS series, {", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in agreement.COUNTS)} FROM c GROUP BY GROUPING SETS ((etype, series), (etype)))
    {_rates_sql("s")}
"""


@_q
def retrieval_report(spark: SparkSession, d: str) -> DataFrame:
    """Retrieval and citation figures by scope and model: the cited chunks in order stand for what was first retrieved, in reverse
    for the reranked, the first two with the gold ones for what was sent."""
    none = F.array().cast("array<string>")
    r = reviews(spark, d).withColumn("model", F.coalesce("generation_model", F.lit("unknown"))).withColumn("gold", F.coalesce("gold_chunk_ids", none)).withColumn("cited", F.coalesce("cited_chunk_ids", none))
    sent = F.concat(F.slice("cited", 1, 2), F.slice("gold", 1, 1))
    m = r.select("search_scope", "model", agreement.retrieval_metrics(F.col("gold"), F.col("cited"), F.reverse("cited"), sent).alias("r"), agreement.citation_metrics(F.col("gold"), F.col("generated_answer"), sent).alias("c"), (F.size("gold") > 0).alias("some"))
    mean = lambda x, n: F.round(F.avg(x.cast("double")), 6).alias(n)
    rr = lambda x, n: F.round(F.avg(F.when(F.col("some"), F.coalesce(F.try_divide(F.lit(1), F.col(x)), F.lit(0.0)))), 6).alias(n)
    return agreement.named_slices(m, [["search_scope", "model"], ["search_scope"], []], ["search_scope", "model"], [
        F.count("*").alias("n"), mean(F.col("r.initial_hit"), "initial_recall"), rr("r.initial_rank", "initial_mrr"), rr("r.reranked_rank", "reranked_mrr"), mean(F.col("r.sent_precision"), "sent_precision"), mean(F.col("r.sent_recall"), "sent_recall"),
        mean(F.col("c.precision"), "citation_precision"), mean(F.col("c.recall"), "citation_recall"), mean(F.col("c.no_citation"), "no_citation"),
    ])


SQL["retrieval_report"] = f"""
    WITH {REVIEWS_SQL}, r AS (SELECT search_scope, coalesce(generation_model, 'unknown') AS model, list_distinct(coalesce(gold_chunk_ids, [])) AS g, coalesce(gold_chunk_ids, []) AS gold, coalesce(cited_chunk_ids, []) AS cited, generated_answer AS a FROM revs),
    t AS (SELECT *, list_distinct(list_concat(cited[:2], gold[:1])) AS sent, list_reverse(cited) AS back FROM r),
    m AS (SELECT search_scope, model, len(g) AS n_gold, list_has_any(g, cited) AS hit, list_min(list_filter(list_transform(g, lambda x: list_position(cited, x)), lambda x: x > 0)) AS r1, list_min(list_filter(list_transform(g, lambda x: list_position(back, x)), lambda x: x > 0)) AS r2,
        len(list_intersect(g, sent)) AS n_both, len(sent) AS n_sent, list_filter(sent, lambda x: coalesce(contains(a, x), false)) AS said, g FROM t),
    k AS (SELECT *, len(list_intersect(said, g)) AS ok FROM m)
    SELECT CASE WHEN grouping(search_scope) = 1 THEN '*' ELSE search_scope END AS search_scope, CASE WHEN grouping(model) = 1 THEN '*' ELSE model END AS model, count(*) AS n,
        round(avg(CASE WHEN n_gold > 0 THEN CASE WHEN hit THEN 1.0 ELSE 0.0 END END), 6) AS initial_recall, round(avg(CASE WHEN n_gold > 0 THEN coalesce(1.0 / r1, 0) END), 6) AS initial_mrr, round(avg(CASE WHEN n_gold > 0 THEN coalesce(1.0 / r2, 0) END), 6) AS reranked_mrr,
        round(avg(CASE WHEN n_gold > 0 AND n_sent > 0 THEN n_both / n_sent END), 6) AS sent_precision, round(avg(CASE WHEN n_gold > 0 THEN n_both / n_gold END), 6) AS sent_recall,
        round(avg(CASE WHEN n_gold > 0 AND len(said) > 0 THEN ok / len(said) END), 6) AS citation_precision, round(avg(CASE WHEN n_gold > 0 THEN ok / n_gold END), 6) AS citation_recall, round(avg(CASE WHEN len(said) = 0 THEN 1.0 ELSE 0.0 END), 6) AS no_citation
    FROM k GROUP BY GROUPING SETS ((search_scope, model), (search_scope), ())
"""


@_q
def fifo_text_match(spark: SparkSession, d: str) -> DataFrame:
    """Segments of v2 and v3 paired one to one by equal text within a recording, in order; counts of pairs and leftovers."""
    from pyspark.sql import Window

    s = segments(spark, d, "v2", "v3").where(F.col("text").isNotNull())
    n = s.withColumn("h", F.sha2("text", 256)).select("recording", "version", "h", F.row_number().over(Window.partitionBy("recording", "version", "h").orderBy("seq")).alias("n"))
    side = lambda v: n.where(F.col("version") == v).select("recording", "h", "n", F.lit(1).alias(v))
    j = side("v2").join(side("v3"), ["recording", "h", "n"], "full_outer")
    return j.groupBy("recording").agg(F.count_if(F.col("v2").isNotNull() & F.col("v3").isNotNull()).alias("paired"), F.count_if(F.col("v3").isNull()).alias("only_v2"), F.count_if(F.col("v2").isNull()).alias("only_v3"))


SQL["fifo_text_match"] = f"""
    WITH {SEGMENTS_SQL}, n AS (SELECT recording, version, text, row_number() OVER (PARTITION BY recording, version, text ORDER BY seq) AS n FROM segs WHERE text IS NOT NULL AND version IN ('v2', 'v3')),
    a AS (SELECT * FROM n WHERE version = 'v2'), b AS (SELECT * FROM n WHERE version = 'v3')
    SELECT coalesce(a.recording, b.recording) AS recording, count(*) FILTER (a.n IS NOT NULL AND b.n IS NOT NULL) AS paired, count(*) FILTER (b.n IS NULL) AS only_v2, count(*) FILTER (a.n IS NULL) AS only_v3
    FROM a FULL JOIN b ON a.recording = b.recording AND a.text = b.text AND a.n = b.n GROUP BY 1
"""


@_q
def macro_mean_rates(spark: SparkSession, d: str) -> DataFrame:
    """By version and unit the mean of the recordings' headline rates, each recording weighing the same, and the best of them."""
    r = _rates(spark, d, (HEADLINE,), "recording").where((F.col("series") != "ALL") & F.col("rate").isNotNull())
    return r.groupBy("version", "unit").agg(F.count("*").alias("n_recordings"), F.round(F.avg("rate"), 4).alias("mean_rate"), F.round(F.min("rate"), 4).alias("best_rate"))


SQL["macro_mean_rates"] = f"""
    WITH {_error_sql((HEADLINE,), ("cer", "wer"), "recording")} SELECT version, unit, count(*) AS n_recordings, round(avg(rate), 4) AS mean_rate, round(min(rate), 4) AS best_rate FROM rates WHERE series <> 'ALL' AND rate IS NOT NULL GROUP BY version, unit
"""


@_q
def provenance_summary(spark: SparkSession, d: str) -> DataFrame:
    """What each recording has of every stage, with first and last delivery."""
    s = segments(spark, d)
    return s.groupBy("recording").agg(*[F.count_if(F.col("version") == v).alias(f"n_{v}") for v in ("v0", "v1", "v2", "v3")], F.count_if(F.col("id").isNull()).alias("n_no_id"), F.max("seq").alias("last_seq"))


SQL["provenance_summary"] = f"""
    WITH {SEGMENTS_SQL} SELECT recording, {", ".join(f"count(*) FILTER (version = '{v}') AS n_{v}" for v in ("v0", "v1", "v2", "v3"))}, count(*) FILTER (id IS NULL) AS n_no_id, max(seq) AS last_seq FROM segs GROUP BY recording
"""
