"""Stages from one version of a corpus to the next, with their files and provenance."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import matching, ports, replacement
from tessera.session import checkpoint
from tessera.sources import files

ALPHA, TAU, DELTA = 0.7, 0.5, 0.02


def validate(entities: DataFrame, segments: DataFrame, corpus: DataFrame, *, alpha: float = ALPHA, tau: float = TAU, delta: float = DELTA, model: Callable[[list[str]], np.ndarray] = ports.hashed_embedding) -> tuple[DataFrame, DataFrame]:
    """Entities with ``best_key, best_score, margin, verdict, outcome``, and the segments with the verified quotations replaced.

    Verses and duas are ranked against their kind of ``corpus`` (kind, canon_key, text); others pass through with nulls.  A
    verified one goes, as its canonical text, into the first segment of its recording that holds it, verses before duas.
    """
    cited = entities.where(F.col("etype").isin("ayah", "dua"))
    top = matching.best_matches(cited, corpus, "etype", "text", "kind", "canon_key", "text", alphas=[alpha], top=2, model=model)
    got = matching.decisions(top, "canon_key", "score", tau, delta, ("etype", "text"))
    proposed = F.when(F.col("etype") == "ayah", T.verse_key_of("surah_number", "ayah_number"))  # a dua proposes no key
    judged = entities.join(got, ["etype", "text"], "left").withColumn("verdict", F.when(F.col("etype").isin("ayah", "dua"), F.coalesce("verdict", F.lit("unresolved"))))
    outcome = F.when(F.col("verdict") == "verified", F.when(proposed == F.col("best_key"), "confirmed").otherwise("alternative_reference_selected"))
    judged = checkpoint(judged.withColumn("outcome", outcome))
    canon = corpus.select(F.col("canon_key").alias("best_key"), F.col("text").alias("canonical"))
    q = judged.where(F.col("verdict") == "verified").join(canon, "best_key").select("recording", F.struct((F.col("etype") == "dua").alias("late"), "entity_id").alias("n"), F.col("text").alias("fragment"), "canonical")
    changed = replacement.replace_quotations(segments, q).select("recording", "seq", F.col("text").alias("_new"), "n_replaced")
    out = segments.join(changed, ["recording", "seq"], "left").select(*[F.coalesce("_new", "text").alias(c) if c == "text" else F.col(c) for c in segments.columns], F.coalesce("n_replaced", F.lit(0)).alias("n_replaced"))
    return judged.select(*entities.columns, "best_key", "best_score", "margin", "verdict", "outcome"), out


def run_v0_v1(spark: SparkSession, v0: DataFrame, model: Callable[[str], str], path: str) -> dict[str, str]:
    """Correct the segments (series, recording, seq, id, start_s, end_s, text), write them under ``path`` and record the stage."""

    def work() -> dict[str, str]:
        done = checkpoint(ports.correct(v0, "text", model))
        files.write_segments(done.drop("changed", "fallback", "reason"), f"{path}/v1")
        n = done.agg(F.count("*").alias("total"), F.count_if("changed").alias("changed"), F.count_if("fallback").alias("fallback")).first()
        return {k: str(n[k]) for k in ("total", "changed", "fallback")}

    return files.record_stage(spark, f"{path}/provenance", "*", "V1", work)


def run_e1_v2(spark: SparkSession, v1: DataFrame, model: Callable[[str], str], corpus: DataFrame, path: str) -> dict[str, str]:
    """Extract candidates from every segment, ground them, write E1 and V2 and record the stage."""

    def work() -> dict[str, str]:
        found, failed = ports.extract(v1, ["series", "recording", "seq"], "text", model)
        kinds = F.create_map(*[F.lit(x) for kv in (("ayat", "ayah"), ("dua", "dua"), ("hadith", "hadith"), ("topics", "topic"), ("headings", "heading")) for x in kv])
        e = checkpoint(found.withColumn("etype", kinds[F.col("etype")]).withColumn("entity_id", F.concat_ws("/", "recording", F.format_string("%08d", "seq"), "etype", F.format_string("%04d", "n"))))
        judged, v2 = validate(e, v1, corpus)
        judged, v2 = checkpoint(judged), checkpoint(v2)
        files.write_pair(judged, v2.drop("n_replaced"), path)
        n = judged.agg(F.count("*").alias("candidates"), F.count_if(F.col("verdict") == "verified").alias("verified")).first()
        return {"candidates": str(n.candidates), "verified": str(n.verified), "replaced": str(v2.agg(F.sum("n_replaced")).first()[0] or 0), "segments_without_reply": str(failed.count())}

    return files.record_stage(spark, f"{path}/provenance", "*", "V2", work)
