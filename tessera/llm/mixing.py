"""Mixing sources to target weights.

Every document has a fixed hash.  The tokens of each source are summed by hash bucket; its budget is met by whole copies
of the source plus the documents whose hash lies under a threshold.  The threshold is found on the histogram: the bucket
in which the running sum passes the budget is the boundary, and only that bucket is summed again by finer buckets, until
the hash is used up.  Thresholds of growing budgets are nested: a larger mix holds every document of a smaller one.
The mix is a filter on the hash; nothing is sorted, and only the thresholds (a few rows a source) reach the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm import tokens
from tessera.session import checkpoint

BITS, LEVELS = 10, 5
HASH_BITS = BITS * LEVELS
SEED = 20_210


def canonical_source(source: Column) -> Column:
    """Lower case, trimmed, with underscores for hyphens and white space; null for null and blank."""
    return F.nullif(F.regexp_replace(F.lower(F.trim(F.regexp_replace(source, r"\s+", " "))), r"[-\s]+", "_"), F.lit(""))


def sized(documents: DataFrame, **tokenizer: str) -> DataFrame:
    """``doc_id, source, n_tokens, h``: each document once, with its canonical source, size and hash."""
    # Copies of a document are combined by their counts, so no text is shuffled for it.
    n = tokens.count(documents, "doc_id", "text", **tokenizer).groupBy("doc_id").agg(F.max("n_tokens").alias("n_tokens"))
    named = documents.groupBy("doc_id").agg(canonical_source(F.max("source")).alias("source"))
    return named.join(n, "doc_id").select("doc_id", "source", "n_tokens", F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1 << HASH_BITS)).alias("h"))


def budgets(sums: list, targets: list, total: int | None) -> dict[str, tuple[int, int, float, int]]:
    """By source: whole copies, tokens still wanted, share, limit.  ``sums`` (source, n_tokens), ``targets`` (source, target_share, max_repeats).

    The mix is the largest that no source has to be repeated more than its limit for, or ``total`` if that is less.
    Sources without tokens are left out and the other shares scaled up.
    """
    have = {r.source: r.n_tokens for r in sums if r.n_tokens}
    used = [t for t in targets if t.source in have and (t.target_share or 0) > 0 and (t.max_repeats or 0) > 0]
    scale = sum(t.target_share for t in used)
    if not used:
        return {}
    most = min(have[t.source] * t.max_repeats * scale / t.target_share for t in used)
    size = most if total is None else min(most, total)
    out = {}
    for t in used:
        want = min(int(size * t.target_share / scale + 1e-6), have[t.source] * t.max_repeats)
        out[t.source] = (want // have[t.source], want % have[t.source], t.target_share, t.max_repeats)
    return out


def thresholds(rows: DataFrame, wanted: dict[str, int]) -> dict[str, int]:
    """Hash under which each source's documents have most nearly the wanted tokens (of two equally near sums the smaller)."""
    spark = rows.sparkSession
    # Where the boundary bucket of each source begins (all before it is in), and the tokens still wanted from it.
    low, left = dict.fromkeys(wanted, 0), dict(wanted)
    whole: dict[str, int] = {}
    for level in range(LEVELS):
        if not left:
            break
        shift = HASH_BITS - BITS * (level + 1)
        at = spark.createDataFrame([(s, low[s], n) for s, n in left.items()], "source string, low long, left long")
        inside = rows.join(F.broadcast(at), "source").where((F.col("h") >= F.col("low")) & (F.col("h") < F.col("low") + F.lit(1 << (shift + BITS))))
        sums = inside.groupBy("source", "left", F.shiftright(F.col("h") - F.col("low"), shift).alias("b")).agg(F.sum("n_tokens").alias("n"))
        run = sums.select("*", F.sum("n").over(Window.partitionBy("source").orderBy("b")).alias("upto"))
        passing = run.where(F.col("upto") > F.col("left")).groupBy("source").agg(F.min(F.struct("b", (F.col("upto") - F.col("n")).alias("before"), "upto")).alias("x"))
        found = {r.source: r.x for r in passing.collect()}
        for s in [s for s in left if s not in found]:  # all of it is wanted
            whole[s] = low[s] + (1 << (shift + BITS))
            del left[s]
        for s, x in found.items():
            low[s] += x.b << shift
            if shift == 0 and x.upto - left[s] < left[s] - x.before:  # the document at the boundary brings the sum nearer
                low[s] += 1
            left[s] -= x.before
    return {**low, **whole}


def mix(documents: DataFrame, targets: DataFrame, *, total: int | None = None, **tokenizer: str) -> tuple[DataFrame, DataFrame]:
    """The mix ``doc_id, source, n_tokens, copies`` and its report by source.

    Documents without a source that has a target are in neither; empty and null texts have 0 tokens and follow their
    hash.  The report has ``source, target_share, max_repeats, available_docs, available_tokens, mixed_tokens,
    actual_share, most_copies``; a source that has no document has zeros.
    """
    spark = documents.sparkSession
    rows = checkpoint(sized(documents, **tokenizer).join(F.broadcast(targets.select("source")), "source"))
    sums = rows.groupBy("source").agg(F.sum("n_tokens").alias("n_tokens")).collect()
    plan = budgets(sums, targets.collect(), total)
    under = thresholds(rows, {s: left for s, (_, left, _, _) in plan.items() if left})
    drawn = spark.createDataFrame([(s, full, under.get(s, 0)) for s, (full, *_) in plan.items()], "source string, full int, below long")
    copies = rows.join(F.broadcast(drawn), "source").select("doc_id", "source", "n_tokens", (F.col("full") + F.when(F.col("h") < F.col("below"), 1).otherwise(0)).alias("copies"))
    drawn_rows = copies.where(F.col("copies") > 0)
    got = copies.groupBy("source").agg(F.count("*").alias("available_docs"), F.sum("n_tokens").alias("available_tokens"), F.sum(F.col("n_tokens") * F.col("copies")).alias("mixed_tokens"), F.max("copies").alias("most_copies"))
    full = targets.join(got, "source", "left").fillna(0, ["available_docs", "available_tokens", "mixed_tokens", "most_copies"])
    every = F.lit(full.agg(F.sum("mixed_tokens")).first()[0])  # over one row a source
    report = full.select("source", "target_share", "max_repeats", "available_docs", "available_tokens", "mixed_tokens", F.coalesce(F.try_divide(F.col("mixed_tokens"), every), F.lit(0.0)).alias("actual_share"), "most_copies")
    return drawn_rows, report
