"""Models as injected functions over columns, with deterministic defaults."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMENSIONS, TRIES = 128, 3


def hashed_embedding(texts: list[str]) -> np.ndarray:
    """Unit vectors of hashed words and character trigrams; zero for blank texts."""
    out = np.zeros((len(texts), DIMENSIONS), np.float32)
    for i, t in enumerate(texts):
        for w in (t or "").lower().split():
            for g in {w, *(w[j : j + 3] for j in range(len(w) - 2))}:
                h = zlib.crc32(g.encode("utf-8", "replace"))
                out[i, h % DIMENSIONS] += 1 if h >> 31 else -1
    n = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, n, out=np.zeros_like(out), where=n > 0)


def embed(text: Column, model: Callable[[list[str]], np.ndarray] = hashed_embedding) -> Column:
    """Vectors by a model that maps a list of texts to rows; the model is loaded once per worker if it caches itself."""

    def run(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in it:
            yield pd.Series(list(np.asarray(model([t or "" for t in s]), np.float32)))

    run.__annotations__ = {"it": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "array<float>")(text)


def lexical_relevance(question: str, texts: list[str]) -> list[float]:
    """Share of the question's distinct words that each text has."""
    q = {w.strip(".,?!؟۔").lower() for w in (question or "").split()} - {""}
    return [len(q & {w.strip(".,?!؟۔").lower() for w in (t or "").split()}) / len(q) if q else 0.0 for t in texts]


def rerank(candidates: DataFrame, model: Callable[[str, list[str]], list[float]] = lexical_relevance, top: int = 4) -> DataFrame:
    """The ``top`` candidates (query_id, question, chunk_id, text, rank) of each query by the model's score, ties by first rank.

    Where the model fails the first ranking stands, with status ``failed``.  A query's candidates are the few of its top-k.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank", kind="stable")
        try:
            scores, status = model(pdf.question.iloc[0], pdf.text.tolist()), "ok"
        except Exception:  # noqa: BLE001
            scores, status = [0.0] * len(pdf), "failed"
        pdf = pdf.assign(score=scores, status=status).sort_values(["score", "rank"], ascending=[False, True], kind="stable").head(top)
        return pdf.assign(new_rank=range(1, len(pdf) + 1))[["query_id", "chunk_id", "rank", "new_rank", "score", "status"]]

    return candidates.groupBy("query_id").applyInPandas(run, "query_id long, chunk_id string, rank int, new_rank int, score double, status string")


def ask(df: DataFrame, key: str, prompt: Column, model: Callable[[str], str], check: Callable[[str, str], bool] = lambda p, r: bool(r and r.strip()), tries: int = TRIES) -> DataFrame:
    """``key, reply, tries, status`` of a model asked up to ``tries`` times until its reply passes; else a null reply and the reason."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = []
            for k, p in zip(pdf[key], pdf["_prompt"]):
                reply, status, n = None, "no prompt", 0
                while p is not None and n < tries and reply is None:
                    n += 1
                    try:
                        got = model(p)
                        reply, status = (got, "ok") if check(p, got) else (None, "refused by the check")
                    except Exception as e:  # noqa: BLE001
                        status = type(e).__name__
                rows.append((k, reply, n, status))
            yield pd.DataFrame(rows, columns=[key, "reply", "tries", "status"])

    src = df.select(F.col(key), prompt.alias("_prompt"))
    return src.mapInPandas(run, f"`{key}` {src.schema[key].dataType.simpleString()}, reply string, tries int, status string")


def context(chunk_id: Column, start: Column, text: Column) -> Column:
    """A chunk as it stands in a prompt."""
    return F.concat(F.format_string("[chunk_id=%s start=%.2fs] ", chunk_id, start), text)


def correct(segments: DataFrame, text: str, model: Callable[[str], str], tries: int = TRIES) -> DataFrame:
    """``segments`` with ``text`` corrected by a model that replies with a JSON object of a text, and ``changed, fallback, reason``.

    A reply that can't be read, or leaves the bounds of a correction, is asked for again; after the last try the text stays
    and the reason is kept.  Null texts stay.
    """
    import json

    from tessera.functions.text import correction_accepted, json_reply

    src = segments.withColumn("_row", F.struct(*segments.columns))

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out = []
            for t in pdf["_text"]:
                replies, errors = [], []
                for _ in range(tries if t is not None else 0):
                    try:
                        replies.append(model(t))
                    except Exception as e:  # noqa: BLE001
                        errors.append(f"{type(e).__name__}: {e}")
                        replies.append(None)
                out.append((json.dumps(replies), errors[-1] if errors else None))
            yield pd.DataFrame({"_row": pdf["_row"], "_replies": [o[0] for o in out], "_error": [o[1] for o in out]})

    # The model is deterministic or not: every try is made once, and the first acceptable reply taken.
    row = src.schema["_row"].dataType.simpleString()
    asked = src.select("_row", F.col(text).alias("_text")).mapInPandas(run, f"_row {row}, _replies string, _error string")
    read = F.transform(F.from_json("_replies", "array<string>"), lambda r: F.get_json_object(json_reply(r), "$.text"))
    t0 = F.col(f"_row.{text}")
    good = F.filter(read, lambda x: x.isNotNull() & correction_accepted(F.coalesce(t0, F.lit("")), x))
    new = F.try_element_at(good, F.lit(1))
    reason = F.when(new.isNull() & t0.isNotNull(), F.coalesce("_error", F.lit("out of bounds, or no text")))
    picked = asked.select("_row", new.alias("_new"), reason.alias("reason"))
    cols = [F.coalesce("_new", t0).alias(c) if c == text else F.col(f"_row.{c}").alias(c) for c in segments.columns]
    return picked.select(*cols, (F.col("_new").isNotNull() & (F.col("_new") != t0)).alias("changed"), F.col("reason").isNotNull().alias("fallback"), "reason")


def extract(segments: DataFrame, keys: list[str], text: str, model: Callable[[str], str], tries: int = TRIES) -> tuple[DataFrame, DataFrame]:
    """Candidates ``keys, etype, n`` with their fields, from replies that are JSON objects of lists by kind; and the segments without a readable reply, with the reason."""
    from tessera.functions.text import json_reply
    from tessera.sources.files import entity_rows

    named = segments.withColumn("_key", F.to_json(F.struct(*keys)))
    readable = lambda p, r: bool(r) and "{" in r
    got = ask(named.where(F.col(text).isNotNull()), "_key", F.col(text), model, readable, tries).withColumn("_json", json_reply(F.col("reply")))
    back = named.select("_key", *keys, "start_s", "end_s").join(got, "_key")
    items = entity_rows(back.where(F.col("_json").isNotNull()), "_json", *keys, "start_s", "end_s").drop("start", "end")
    return items, back.where(F.col("_json").isNull()).select(*keys, F.coalesce(F.nullif(F.col("status"), F.lit("ok")), F.lit("no JSON object")).alias("reason"))
