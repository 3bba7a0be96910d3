"""Ordered operators: running values over long groups, sequences, chunks of timed segments."""

from __future__ import annotations

import itertools
import operator
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import SPACE

# Fixed values of the chunk policy (seconds).
TARGET_S, LEAST_S, MOST_S, PAUSE_S = 30, 15, 60, 1.0
CLOSING = "\"'”’»)]}"
SENTENCE_END, CLAUSE_END = rf"[.!?۔؟][{CLOSING[:-2]}\]}}]*$", rf"[,;:،؛][{CLOSING[:-2]}\]}}]*$"
#: What a place to stop is worth: after a sentence, before a pause, after a clause.
AT_SENTENCE, AT_PAUSE, AT_CLAUSE = 3, 2, 1
BUFFER_WORDS, BUFFER_TAIL = 15, 8


def running(df: DataFrame, keys: list[str], order: list[str], block: Column, aggs: dict[str, tuple[str, str]]) -> DataFrame:
    """``df`` with running values before each row: name -> ('sum' | 'max', column), null or 0 at the first row.

    Groups are cut into blocks of ``block`` (monotone in ``order``); within a block a window runs, and what lies before
    the block comes from one row per block, so no group has to fit a task.
    """
    base = df.withColumn("_blk", block).repartition(*[F.col(k) for k in keys], F.col("_blk"))
    inside = Window.partitionBy(*keys, "_blk").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    fn = {"sum": F.sum, "max": F.max}
    local = base.select("*", *[fn[f](c).over(inside).alias(f"_l_{n}") for n, (f, c) in aggs.items()])
    totals = base.groupBy(*keys, "_blk").agg(*[fn[f](c).alias(f"_t_{n}") for n, (f, c) in aggs.items()])
    carried = totals.select(*keys, "_blk", *[fn[f](f"_t_{n}").over(before).alias(f"_b_{n}") for n, (f, _) in aggs.items()])
    joined = local.join(carried, [*keys, "_blk"])
    value = lambda n, f: (F.coalesce(f"_l_{n}", F.lit(0)) + F.coalesce(f"_b_{n}", F.lit(0))) if f == "sum" else F.greatest(f"_l_{n}", f"_b_{n}")
    return joined.select(*df.columns, *[value(n, f).alias(n) for n, (f, _) in aggs.items()])


def neighbours(df: DataFrame, keys: list[str], order: list[str], block: Column, *, before: dict[str, str] | None = None, after: dict[str, str] | None = None) -> DataFrame:
    """``df`` with values of the row before and after each one: name -> column, null at the ends.

    As in ``running`` a window runs within a block only; what lies over its edges comes from one row per block.  Blocks must
    be monotone in ``order``, which must be unique within ``keys``.
    """
    before, after = before or {}, after or {}
    base = df.withColumn("_blk", block).repartition(*[F.col(k) for k in keys], F.col("_blk"))
    inside = Window.partitionBy(*keys, "_blk").orderBy(*order)
    blocks = Window.partitionBy(*keys).orderBy("_blk")
    pack = lambda names: F.struct(F.lit(1).alias("_"), *[F.col(c).alias(n) for n, c in names.items()])
    local = base.select("*", F.lag(pack(before)).over(inside).alias("_lb"), F.lead(pack(after)).over(inside).alias("_la"))
    by = F.struct(*order)
    edges = base.groupBy(*keys, "_blk").agg(F.max_by(pack(before), by).alias("_last"), F.min_by(pack(after), by).alias("_first"))
    carried = edges.select(*keys, "_blk", F.lag("_last").over(blocks).alias("_eb"), F.lead("_first").over(blocks).alias("_ea"))
    joined = local.join(carried, [*keys, "_blk"])
    return joined.select(*df.columns, *[F.coalesce("_lb", "_eb")[n].alias(n) for n in before], *[F.coalesce("_la", "_ea")[n].alias(n) for n in after])


def apply_groups(df: DataFrame, keys: list[str], order: list[str], fn: Callable[[Iterator], Iterator[tuple]], schema: str) -> DataFrame:
    """``fn`` from the rows (tuples of the columns of ``df``, in ``order``) of each group to rows of ``schema``.

    Rows are partitioned by ``keys``, sorted, and go through as a stream: a group is never held as a whole unless ``fn``
    holds it.  No key may be null.
    """
    names, at = [c.split()[0] for c in schema.split(", ")], [df.columns.index(k) for k in keys]
    key = operator.itemgetter(*at)
    out_types = [f.dataType for f in df.sparkSession.createDataFrame([], schema).schema.fields]
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [to_arrow_type(t) for t in out_types]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in it for r in zip(*(c.to_pylist() for c in b.columns)))
        made = (x for _, group in itertools.groupby(rows, key) for x in fn(group))
        while part := list(itertools.islice(made, 5_000)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part), kinds)], names=names)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def _stop(starts: np.ndarray, ends: np.ndarray, marks: np.ndarray, following: float | None, whole: bool) -> int:
    """How many of the segments at hand make the chunk that begins with the first.

    ``following`` is the start of the segment after them, or None at the end of the input; ``whole``: then what fits is one chunk.
    """
    reach = np.maximum.accumulate(ends)
    length = reach - starts[0]
    fit = max(1, int(np.searchsorted(length, MOST_S, "right")))
    if fit == len(starts) and following is None and whole:
        return fit
    after = np.append(starts[1:], reach[-1] + MOST_S if following is None else following)[:fit]
    worth = np.where(marks[:fit] == AT_SENTENCE, AT_SENTENCE, np.where(after - reach[:fit] >= PAUSE_S, AT_PAUSE, marks[:fit]))
    able = np.flatnonzero(length[:fit] >= LEAST_S)
    if not len(able):
        return fit
    return 1 + int(able[np.lexsort((able, -np.abs(length[able] - TARGET_S), worth[able]))[-1]])


def chunk_stream(rows: Iterator[tuple], whole: bool = True) -> Iterator[tuple[list, float, float, str]]:
    """Chunks (seqs, start, end, text) of segments (seq, start, end, text, mark) in order of their start.

    From its first segment on, a chunk may stop after any segment that makes it LEAST_S long, best after a sentence, then
    before a pause, then after a clause, then nearest TARGET_S; it never passes MOST_S but for a single segment.  Where the
    segments run out within MOST_S they are one chunk (if ``whole``: a long pause follows otherwise).  Only the segments
    within reach of a chunk are held.
    """
    source = iter(rows)
    held: deque = deque()
    coming = next(source, None)
    while held or coming is not None:
        while coming is not None and (not held or coming[1] <= held[0][1] + MOST_S):
            held.append(coming)
            coming = next(source, None)
        starts, ends, marks = (np.array([r[i] for r in held]) for i in (1, 2, 4))
        n = _stop(starts, ends, marks, None if coming is None else coming[1], whole)
        part = [held.popleft() for _ in range(n)]
        yield [r[0] for r in part], part[0][1], max(r[2] for r in part), " ".join(r[3] for r in part if r[3])


def chunks(segments: DataFrame) -> DataFrame:
    """``recording, chunk_start, chunk_end, n_segments, seqs, text`` of segments ``recording, seq, start_s, end_s, text``.

    A pause longer than MOST_S ends a chunk whatever precedes it, so recordings are cut at such pauses first and the
    pieces are chunked side by side.  Segments with a null time or an end before the start are left out.
    """
    bare = F.regexp_replace(F.coalesce("text", F.lit("")), rf"^{SPACE}|{SPACE}$", "")
    mark = F.when(bare.rlike(SENTENCE_END), AT_SENTENCE).when(bare.rlike(CLAUSE_END), AT_CLAUSE).otherwise(0)
    ok = segments.where(F.col("start_s").isNotNull() & (F.col("end_s") >= F.col("start_s")) & F.col("recording").isNotNull()).select("recording", "seq", "start_s", "end_s", bare.alias("text"), mark.alias("mark"))
    block = F.floor(F.col("start_s") / 3600)
    reach = running(ok, ["recording"], ["start_s", "seq"], block, {"_reach": ("max", "end_s")})
    fresh = reach.withColumn("_new", F.when(F.col("start_s") - F.col("_reach") > MOST_S, 1).otherwise(0))
    marked = running(fresh, ["recording"], ["start_s", "seq"], block, {"_piece0": ("sum", "_new")}).withColumn("_piece", F.col("_piece0") + F.col("_new"))
    last = marked.groupBy("recording").agg(F.max("_piece").alias("_last"))

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        first = next(rows)
        for seqs, s, e, t in chunk_stream((r[2:] for r in itertools.chain([first], rows)), first[7]):
            yield first[0], s, e, len(seqs), seqs, t

    rows = marked.join(last, "recording").select("recording", F.col("_piece").alias("piece"), "seq", "start_s", "end_s", "text", "mark", (F.col("_piece") == F.col("_last")).alias("whole"))
    return apply_groups(rows, ["recording", "piece"], ["start_s", "seq"], run, "recording string, chunk_start double, chunk_end double, n_segments int, seqs array<int>, text string")


def word_buffers(words: DataFrame, keys: list[str], order: str, start: str, end: str, word: str) -> DataFrame:
    """Groups of BUFFER_WORDS words in order; a last group of fewer than BUFFER_TAIL joins the one before.

    ``words`` must number the words of a key from 0 without holes in ``order``.
    """
    size = words.groupBy(*keys).agg(F.count("*").alias("_n"))
    group = F.floor(F.col(order) / BUFFER_WORDS)
    tail = F.col("_n") % BUFFER_WORDS
    short = (tail > 0) & (tail < BUFFER_TAIL) & (group == F.floor(F.col("_n") / BUFFER_WORDS)) & (group > 0)
    return words.join(size, keys).withColumn("buffer", F.when(short, group - 1).otherwise(group)).groupBy(*keys, "buffer").agg(
        F.min(start).alias("start_s"), F.max(end).alias("end_s"), F.count("*").alias("n_words"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, word))), lambda x: x[word]), " ").alias("text"),
    )
