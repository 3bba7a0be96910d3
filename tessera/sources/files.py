"""Sources and sinks: tolerant segment files, corpora, triples, provenance."""

from __future__ import annotations

import json
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SEGMENT = "struct<id: string, start: double, end: double, text: string>"
STAGE = "recording string, stage string, started_at timestamp, finished_at timestamp, status string, detail map<string,string>, error string"


def read_segments(spark: SparkSession, path: str, *, strict: bool = False) -> DataFrame:
    """``path, seq, id, start, end, text`` of JSON files that hold a list of segments or an object with ``segments``.

    A byte-order mark is skipped.  Files that hold neither give no row; with ``strict`` they, and null ids, are an error.
    """
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", "^﻿", "").alias("v"))
    got = files.select("path", F.when(F.ltrim("v").startswith("["), F.from_json("v", f"array<{SEGMENT}>")).otherwise(F.from_json("v", f"segments array<{SEGMENT}>")["segments"]).alias("segments"))
    if strict:
        got = got.withColumn("segments", F.when(F.col("segments").isNull(), F.raise_error(F.concat(F.lit("no segments in "), F.col("path")))).otherwise(F.col("segments")))
    rows = got.select("path", F.posexplode("segments").alias("seq", "s")).select("path", "seq", "s.id", "s.start", "s.end", "s.text")
    return rows.withColumn("id", F.when(F.col("id").isNull(), F.raise_error(F.lit("a segment has no id"))).otherwise(F.col("id"))) if strict else rows


def read_canon(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """``canon_key, text`` of a CSV of verses (sura, aya, text) or duas (id, text); rows without id or text are left out."""
    raw = spark.read.csv(path, header=True, multiLine=True)
    raw = raw.toDF(*[c.lstrip("﻿").strip() for c in raw.columns])
    key = F.format_string("CH%03d_V%03d", F.col("sura").cast("int"), F.col("aya").cast("int")) if kind == "ayah" else F.col("id")
    return raw.select(key.alias("canon_key"), "text").where((F.trim("text") != "") & F.col("canon_key").isNotNull())


def read_ntriples(spark: SparkSession, path: str) -> DataFrame:
    """``s, p, o, kind`` of N-Triples lines; comments, blank and broken lines are left out."""
    pattern = r'^\s*<([^>]*)>\s+<([^>]*)>\s+(?:<([^>]*)>|"((?:[^"\\]|\\.)*)"(?:@[\w-]+|\^\^<[^>]*>)?)\s*\.\s*$'
    g = lambda i: F.regexp_extract("value", pattern, i)
    lines = spark.read.text(path).where(F.col("value").rlike(pattern))
    iri = g(3) != ""
    return lines.select(g(1).alias("s"), g(2).alias("p"), F.when(iri, g(3)).otherwise(unescape(g(4))).alias("o"), F.when(iri, "iri").otherwise("literal").alias("kind"))


def unescape(c: Column) -> Column:
    out = F.replace(c, F.lit("\\\\"), F.lit("\0"))
    for a, b in (('\\"', '"'), ("\\n", "\n"), ("\\t", "\t"), ("\\r", "\r"), ("\0", "\\")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def write_ntriples(graph: DataFrame, path: str) -> None:
    esc = F.col("o")
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        esc = F.replace(esc, F.lit(a), F.lit(b))
    line = F.concat(F.lit("<"), "s", F.lit("> <"), "p", F.lit("> "), F.when(F.col("kind") == "iri", F.concat(F.lit("<"), "o", F.lit(">"))).otherwise(F.concat(F.lit('"'), esc, F.lit('"'))), F.lit(" ."))
    graph.select(line.alias("value")).write.mode("overwrite").text(path)


def read_blocks(spark: SparkSession, path: str, ids: DataFrame, pattern: str, end: str = " .\n") -> DataFrame:
    """``id, block`` of a large dump of text blocks: those whose id (first group of ``pattern``) is wanted; null where missing."""
    blocks = spark.read.text(path, lineSep=end).select(F.regexp_extract("value", pattern, 1).alias("id"), F.col("value").alias("block")).where(F.col("id") != "")
    first = blocks.join(ids.select("id").distinct(), "id", "left_semi").groupBy("id").agg(F.min("block").alias("block"))
    return ids.select("id").distinct().join(first, "id", "left")


def block_fields(block: Column, texts: str, number: str, address: str) -> Column:
    """Struct of a Turtle block's ``texts`` (lang, text), ``number`` and ``address``, by the names of their properties; null for null.

    Only strings of the property ``texts`` count; a language mark at the end of a string is taken off, and blank strings and
    '0' are left out.
    """
    part = F.regexp_extract(block, rf"(?s):{texts}\s+((?:\s*,?\s*\"(?:[^\"\\]|\\.)*\"\^\^[\w:]+)*)", 1)
    raw = F.transform(F.regexp_extract_all(part, F.lit(r'(?s)"((?:[^"\\]|\\.)*)"'), F.lit(1)), unescape)
    lang = lambda t: F.nullif(F.regexp_extract(t, r"@(en|ur|ar)$", 1), F.lit(""))
    made = F.transform(raw, lambda t: F.struct(lang(t).alias("lang"), F.trim(F.regexp_replace(t, r"@(en|ur|ar)$", "")).alias("text")))
    one = lambda p, v: F.nullif(F.regexp_extract(block, rf':{p}\s+"({v})"', 1), F.lit(""))
    return F.when(block.isNotNull(), F.struct(F.filter(made, lambda x: (x["text"] != "") & (x["text"] != "0")).alias("texts"), one(number, r"\d+").alias("number"), one(address, r'[^"]+').alias("address")))


def append_stage(stages: DataFrame, path: str) -> None:
    """Append rows of STAGE to the provenance table, failures included."""
    stages.write.mode("append").parquet(path)


def write_index(chunks: DataFrame, path: str) -> None:
    """Chunks with their vectors, one folder per series, so that a scope is a partition."""
    chunks.repartition("series").write.mode("overwrite").partitionBy("series").parquet(path)


def load_index(spark: SparkSession, path: str, *, series: str | None = None, recording: str | None = None) -> DataFrame:
    out = spark.read.parquet(path)
    out = out if series is None else out.where(F.col("series") == series)
    return out if recording is None else out.where(F.col("recording") == recording)


# -- recordings and their files: <root>/<series>/<recording>/<name> --
def discover(spark: SparkSession, root: str, order: list[str] = ()) -> DataFrame:
    """``place, series, recording, files`` of the recordings under a folder: series of ``order`` first, then by name."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    part = lambda n: F.element_at(F.split("path", "/"), -n)
    r = found.select(part(3).alias("series"), part(2).alias("recording"), part(1).alias("file")).groupBy("series", "recording").agg(F.array_sort(F.collect_set("file")).alias("files"))
    known = F.array_position(F.array(*map(F.lit, order)).cast("array<string>"), F.col("series"))
    return r.select(F.when(known > 0, known).otherwise(len(order) + 1).cast("int").alias("place"), "series", "recording", "files").orderBy("place", "series", "recording")


def buildable(recordings: DataFrame, listed: DataFrame) -> DataFrame:
    """Recordings (``files``) with what can be made of them next, and whether it is there; ``listed`` (recording) are those configured for the graph."""
    has = lambda f: F.array_contains("files", f)
    r = recordings.join(listed.select("recording", F.lit(True).alias("_listed")).distinct(), "recording", "left")
    return r.select(
        "series", "recording", has("v0.json").alias("can_correct"), has("v1.json").alias("corrected"), has("v1.json").alias("can_extract"), has("e1.json").alias("extracted"), (has("v2.json") & has("e1.json")).alias("reviewable"), has("v3.json").alias("reviewed"),
        (has("v3.json") & has("e2.json") & F.coalesce("_listed", F.lit(False))).alias("can_graph"), has("v3.json").alias("can_index"),
    )


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """``path, text`` of files that hold a list of segments, an object with ``segments``, or one with ``text``: the stripped texts
    joined by one space.  A file that holds none of these is an error."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", "^\ufeff", "").alias("v"))
    seg = F.coalesce(F.when(F.ltrim("v").startswith("["), F.from_json("v", f"array<{SEGMENT}>")), F.from_json("v", f"segments array<{SEGMENT}>")["segments"])
    joined = F.array_join(F.transform(seg, lambda x: F.trim(F.regexp_replace(x["text"], r"(?U)^\s+|\s+$", ""))), " ")
    whole = F.when(seg.isNotNull() & F.forall(seg, lambda x: x["text"].isNotNull()), joined).otherwise(F.from_json("v", "text string")["text"])
    return files.select("path", F.coalesce(whole, F.raise_error(F.concat(F.lit("no segments and no text in "), F.col("path"))).cast("string")).alias("text"))


def read_pairs(spark: SparkSession, root: str, first: str = "e1.json", second: str = "e2.json") -> DataFrame:
    """``series, recording, first, second``: the JSON of two files of each recording that has both."""
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").text(root, wholetext=True).select(F.split(F.col("_metadata.file_path"), "/").alias("p"), F.regexp_replace("value", "^\ufeff", "").alias("v"))
    rows = raw.select(F.element_at("p", -3).alias("series"), F.element_at("p", -2).alias("recording"), F.element_at("p", -1).alias("f"), "v").where(F.col("f").isin(first, second))
    return rows.groupBy("series", "recording").agg(F.max(F.when(F.col("f") == first, F.col("v"))).alias("first"), F.max(F.when(F.col("f") == second, F.col("v"))).alias("second")).where(F.col("first").isNotNull() & F.col("second").isNotNull())


ITEM = "struct<surah_number: string, ayah_number: string, reference: string, expanded_reference: string, text: string, name: string, name_en: string, name_ur: string, description: string, description_en: string, title_en: string, title_ur: string, start: double, end: double, usage: string, extent: string>"
KINDS = ("ayat", "hadith", "dua", "topics", "headings")


def entity_rows(df: DataFrame, json: str, *keys: str) -> DataFrame:
    """A row for each item of an entity set in JSON: ``keys, etype, n`` and its fields; items without text and topics without a name are left out."""
    sets = df.select(*keys, F.from_json(json, ", ".join(f"{k} array<{ITEM}>" for k in KINDS)).alias("_s"))
    none = F.expr(f"cast(array() as array<struct<etype: string, n: int, x: {ITEM}>>)")

    def items(kind: str) -> Column:
        return F.coalesce(F.transform(F.col("_s")[kind], lambda x, i: F.struct(F.lit(kind).alias("etype"), i.alias("n"), x.alias("x"))), none)

    each = F.flatten(F.array(*map(items, KINDS)))
    rows = sets.select(*keys, F.explode(each).alias("r")).select(*keys, "r.etype", "r.n", "r.x.*")
    name = F.coalesce(F.nullif(F.trim("name_en"), F.lit("")), F.nullif(F.trim("name"), F.lit("")))
    rows = rows.withColumn("name_en", name)
    cited = F.col("etype").isin("ayat", "hadith", "dua")
    return rows.where((cited & (F.trim(F.coalesce("text", F.lit(""))) != "")) | ((F.col("etype") == "topics") & F.col("name_en").isNotNull()) | (F.col("etype") == "headings"))


def read_asr_runs(spark: SparkSession, root: str, excluded: list[str] = ()) -> DataFrame:
    """``recording, backend, model, elapsed_seconds, excluded, text`` of runs stored as <root>/<recording>/<backend>/<model>.json."""
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").text(root, wholetext=True).select(F.split(F.col("_metadata.file_path"), "/").alias("p"), F.from_json("value", f"backend string, model string, runtime struct<elapsed_seconds: double>, segments array<{SEGMENT}>").alias("r"))
    model = F.coalesce("r.model", F.regexp_replace(F.element_at("p", -1), r"\.json$", ""))
    return raw.select(F.element_at("p", -3).alias("recording"), F.coalesce("r.backend", F.element_at("p", -2)).alias("backend"), model.alias("model"), F.col("r.runtime.elapsed_seconds").alias("elapsed_seconds"), model.isin(*excluded).alias("excluded") if excluded else F.lit(False).alias("excluded"), F.array_join(F.transform("r.segments", lambda x: F.trim(x["text"])), " ").alias("text"))


CONFIG = "series_code string, recordings_dir string, category string, series map<string, string>, speaker map<string, string>, language map<string, string>, recordings array<struct<recording_id: string, kg_recording_id: string, audio: map<string, string>>>, concept_keywords map<string, array<string>>, reviewed_merges array<struct<topics: array<string>, decision: string>>, reviewed_concepts array<struct<topic: string, concept: string, decision: string>>, topic_related array<array<string>>, hub_related struct<hub: string, members: array<string>>, manual_concept_matches array<struct<topic: string, match: string, concept: string>>"


def read_series_configs(spark: SparkSession, path: str, order: list[str] = ()) -> DataFrame:
    """Series configurations, one row a file; files of proposals are passed over.  Those of ``order`` come first."""
    raw = spark.read.schema(CONFIG).option("multiLine", True).option("pathGlobFilter", "*.json").json(path).select("*", F.col("_metadata.file_name").alias("file"))
    at = F.array_position(F.array(*map(F.lit, order)).cast("array<string>"), F.col("series_code"))
    return raw.where(~F.col("file").rlike("_topic_proposals")).withColumn("place", F.when(at > 0, at).otherwise(len(order) + 1).cast("int")).orderBy("place", "series_code")


def read_json_files(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Objects of JSON files (one object or a list each) with the name of their file: traces, registries, gold questions, reviews."""
    return spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").json(path).select("*", F.col("_metadata.file_name").alias("file"))


def read_effort(spark: SparkSession, path: str) -> DataFrame:
    """``series, recording, audio_minutes, hours`` of a CSV of review effort."""
    return spark.read.csv(path, header=True, schema="series string, recording string, audio_minutes double, hours double", enforceSchema=False)


def cached(spark: SparkSession, make: Callable[[], DataFrame], folder: str, *content: str) -> DataFrame:
    """A table kept under ``folder`` by the hash of what it is made from; made only where it isn't there."""
    import hashlib

    path = f"{folder}/{hashlib.sha256(json.dumps(sorted(content)).encode()).hexdigest()}"
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        make().write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)


def cached_blocks(spark: SparkSession, path: str, ids: DataFrame, pattern: str, folder: str, end: str = " .\n") -> DataFrame:
    """``read_blocks``, kept by the set of ids asked for (their order doesn't matter)."""
    distinct = ids.select(F.col("id").cast("string").alias("id")).distinct()
    mark = distinct.agg(F.count("*").alias("n"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("h"), F.bit_xor(F.xxhash64("id")).alias("x")).first()
    return cached(spark, lambda: read_blocks(spark, path, ids, pattern, end), folder, path, pattern, str(tuple(mark)))


# -- sinks --
def write_segments(segments: DataFrame, path: str, *, as_json: bool = False) -> None:
    """Segments by series and recording; ``as_json`` also as a list in order for each recording."""
    segments.repartition("series", "recording").sortWithinPartitions("series", "recording", "seq").write.mode("overwrite").partitionBy("series", "recording").parquet(path)
    if as_json:
        # A line for each segment, so that no recording has to be one value.
        lines = segments.select("series", "recording", "seq", F.to_json(F.struct("id", F.col("start_s").alias("start"), F.col("end_s").alias("end"), "text"), {"ignoreNullFields": "false"}).alias("value"))
        lines.repartition("series", "recording").sortWithinPartitions("series", "recording", "seq").select("series", "recording", "value").write.mode("overwrite").partitionBy("series", "recording").text(path + "_json")


def write_pair(entities: DataFrame, segments: DataFrame, path: str) -> None:
    """Entities and the segments that follow from them, under one folder."""
    write_segments(segments, f"{path}/v2")
    entities.write.mode("overwrite").partitionBy("series", "recording").parquet(f"{path}/e1")


def record_stage(spark: SparkSession, path: str, recording: str, stage: str, work: Callable[[], dict[str, str]]) -> dict[str, str]:
    """Run ``work`` and append its stage to the provenance table, with its detail or with the error, which is raised again."""
    began, detail, error = datetime.now(timezone.utc), {}, None
    try:
        detail = work()
        return detail
    except Exception as e:
        error = f"{type(e).__name__}: {e}"
        raise
    finally:
        append_stage(spark.createDataFrame([(recording, stage, began, datetime.now(timezone.utc), "error" if error else "ok", {k: str(v) for k, v in detail.items()}, error)], STAGE), path)


def open_trace(traces: DataFrame, path: str, key: str = "recording") -> None:
    """Append the rows whose key the table doesn't have yet."""
    spark = traces.sparkSession
    try:
        traces = traces.join(spark.read.parquet(path).select(key).distinct(), key, "left_anti")
    except AnalysisException:
        pass
    traces.dropDuplicates([key]).write.mode("append").parquet(path)


def export_chunks(chunks: DataFrame, path: str) -> None:
    """Chunks as CSV, the ids of their segments joined by semicolons."""
    chunks.withColumn("seqs", F.array_join(F.transform("seqs", lambda x: x.cast("string")), ";")).write.mode("overwrite").option("header", True).csv(path)


def concat_index(spark: SparkSession, chunk_path: str, vector_path: str, path: str) -> int:
    """The index of a series from the chunks and the vectors (``chunk_id``) of its recordings; every chunk must have one vector and the other way about."""
    chunks, vectors = spark.read.parquet(chunk_path), spark.read.parquet(vector_path)
    both = chunks.select("chunk_id", F.lit(1).alias("c"), F.lit(0).alias("v")).unionByName(vectors.select("chunk_id", F.lit(0).alias("c"), F.lit(1).alias("v"))).groupBy("chunk_id").agg(F.sum("c").alias("c"), F.sum("v").alias("v"))
    bad = both.where((F.col("c") != 1) | (F.col("v") != 1)).count()
    if bad:
        raise ValueError(f"{bad} chunks and vectors don't match")
    write_index(chunks.join(vectors, "chunk_id"), path)
    return chunks.count()


def write_traces(traces: DataFrame, path: str) -> None:
    """Retrieval traces, by the scope they were made in: a recording or a series."""
    label = F.when(F.col("search_scope") == "series", F.concat(F.lit("series_"), "scope_label")).otherwise(F.col("scope_label"))
    traces.withColumn("scope", label).write.mode("append").partitionBy("scope").parquet(path)


def write_report(df: DataFrame, path: str, title: str) -> str:
    """A small report as JSON lines and as a Markdown table; gives the table.  Meant for pooled results of a few hundred rows."""
    rows = df.collect()
    df.coalesce(1).write.mode("overwrite").json(path)
    show = lambda v: "-" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v)
    return "\n".join([f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "-|" * len(df.columns), *("| " + " | ".join(map(show, r)) + " |" for r in rows)]) + "\n"


def write_differences(edits: DataFrame, path: str) -> None:
    """Rows of edits as CSV with a header and as JSON lines."""
    edits.write.mode("overwrite").option("header", True).csv(f"{path}/csv")
    edits.write.mode("overwrite").json(f"{path}/json")


def write_dictionary(topics: DataFrame, path: str) -> None:
    """A topic dictionary (slug, name, alike) as lines of Markdown."""
    topics.select(F.format_string("- **%s** (`%s`): %s", "name", "slug", "alike").alias("value")).write.mode("overwrite").text(path)


def hand_off(violations: DataFrame, segments: DataFrame, entities: DataFrame, path: str) -> list[str]:
    """Write reviewed segments and entities if nothing fatal stands against them; gives the warnings.

    ``violations`` has ``severity, rule``; with a fatal one nothing is written and ValueError is raised.
    """
    rules = {(r.severity, r.rule): r.n for r in violations.groupBy("severity", "rule").agg(F.count("*").alias("n")).collect()}
    fatal = sorted(f"{rule} ({n})" for (severity, rule), n in rules.items() if severity == "fatal")
    if fatal:
        raise ValueError("; ".join(fatal))
    write_segments(segments, f"{path}/v3")
    entities.write.mode("overwrite").partitionBy("recording").parquet(f"{path}/e2")
    return sorted(f"{rule} ({n})" for (severity, rule), n in rules.items() if severity != "fatal")


class SessionStore:
    """Review logs as a table by session: actions are appended, so a session can be saved, reopened and continued anywhere."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def append(self, actions: DataFrame) -> None:
        """Add rows ``session, n, action``."""
        actions.select("session", F.col("n").cast("long").alias("n"), "action").write.mode("append").parquet(self.path)

    def log(self, *sessions: str) -> DataFrame:
        rows = self.spark.read.parquet(self.path)
        return rows.where(F.col("session").isin(*sessions)) if sessions else rows

    def reopen(self, session: str) -> None:
        """Append the action that opens a finalized session again."""
        last = self.log(session).agg(F.max("n")).first()[0]
        self.append(self.spark.createDataFrame([(session, (last or 0) + 1, json.dumps({"op": "reopen"}))], "session string, n long, action string"))
