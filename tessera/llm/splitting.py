"""Oversized texts cut into pieces under a size limit at natural boundaries, with overlap.

Lexical cohesion: between any two sentences the similarity of the blocks of words before and after is computed; valleys
of this curve mark changes of topic.  Within each size window the cut is the sentence end in the deepest valley; where a
window holds no sentence end it is the last white space, and only where it holds none either, the limit itself.

Each piece tells what its end breaks: the length of the sentence and of the run without white space that it lies inside.
A sentence or run over the limit can't be in one piece, so some piece ends inside it: whether a text can be cut at
sentences, at spaces or only inside runs follows from what its pieces break.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import sentences as sent
from tessera.llm.textcodes import plain
from tessera.session import checkpoint

LIMIT, OVERLAP, BLOCK = 400, 40, 2
_WORD = re.compile(r"\w+")
_RUN = re.compile(r"\S+")


def _words(text: str) -> Counter:
    words = [w.lower() for w in _WORD.findall(plain(text))]
    dense = [w[i : i + 2] for w in words if len(w) > 1 and "⺀" <= w[0] <= "鿿" for i in range(len(w) - 1)]
    return Counter(words + dense)


def depths(parts: list[str], block: int = BLOCK) -> list[float]:
    """Depth of the similarity valley after each part but the last: how far the curve rises on both sides."""
    bags = [_words(p) for p in parts]
    curve = []
    for i in range(1, len(bags)):
        left, right = sum(bags[max(0, i - block) : i], Counter()), sum(bags[i : i + block], Counter())
        dot = sum(n * right[w] for w, n in left.items())
        norm = math.sqrt(sum(n * n for n in left.values()) * sum(n * n for n in right.values()))
        curve.append(dot / norm if norm else 0.0)
    # The top of the slope that leads up from each place, to the left and to the right.
    left, right = curve[:], curve[:]
    for i in range(1, len(curve)):
        if curve[i - 1] >= curve[i]:
            left[i] = left[i - 1]
    for i in range(len(curve) - 2, -1, -1):
        if curve[i + 1] >= curve[i]:
            right[i] = right[i + 1]
    return [a + b - 2 * v for a, b, v in zip(left, right, curve)]


def pieces(text: str, spans: list[tuple[int, int]], limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, str, int, int]]:
    """(start, end, cut, sentence, run) of pieces of at most ``limit`` code points; each starts ``overlap`` before the last one's end.

    Together the pieces hold every code point.  ``cut`` tells what the end is: sentence, space, inside, or end;
    ``sentence`` and ``run`` are the lengths of the sentence and the run without white space that it breaks, 0 for none.
    """
    n = len(text)
    deep = depths([text[s:e] for s, e in spans]) + [0.0]
    begins, stops, ends = [s for s, _ in spans], [e for _, e in spans], []
    for e in stops:
        while e < n and text[e].isspace():
            e += 1
        ends.append(e)
    runs = [m.span() for m in _RUN.finditer(text)]
    run_begins = [a for a, _ in runs]

    def broken(parts: list[tuple[int, int]], firsts: list[int], at: int) -> int:
        i = bisect_right(firsts, at) - 1
        return parts[i][1] - parts[i][0] if i >= 0 and parts[i][0] < at < parts[i][1] else 0

    out, start = [], 0
    while n - start > limit:
        low, high = start + overlap + 1, start + limit
        near = range(bisect_left(ends, low), bisect_right(ends, high))
        if near:
            cut, kind = ends[max(near, key=lambda i: (deep[i], i))], "sentence"
        else:
            cut = next((i + 1 for i in range(high - 1, low - 2, -1) if text[i].isspace()), 0)
            kind = "space" if cut else "inside"
            cut = cut or high
        out.append((start, cut, kind, broken(spans, begins, cut), broken(runs, run_begins, cut)))
        start = cut - overlap
    out.append((start, n, "end", 0, 0))
    return out


def text_cuts(pieces_: DataFrame, key: str, limit: int = LIMIT) -> DataFrame:
    """``key, cut``: where each text can be cut, from what the ends of its pieces break: ``sentence`` if no sentence over the
    limit, else ``space`` if no run without white space over it, else ``inside``."""
    worst = pieces_.groupBy(key).agg(F.max("in_sentence").alias("_s"), F.max("in_run").alias("_r"))
    return worst.select(key, F.when(F.col("_s") <= limit, "sentence").when(F.col("_r") <= limit, "space").otherwise("inside").alias("cut"))


SCHEMA = "piece_no int, start_pos int, end_pos int, piece string, piece_cut string, in_sentence int, in_run int, start_at double"


def split_oversized(segments: DataFrame, key: str, text: str, start: str, end: str, documents: DataFrame, *, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Pieces of the texts of ``segments`` with more than ``limit`` code points.

    ``key, piece_no, start_pos, end_pos, piece, piece_cut, in_sentence, in_run, start_at``: positions in the stored text;
    ``start_at`` lies between the bounds in proportion to the position (the bound that exists where the other is null,
    NaN or not after it; null without bounds).  Repeated keys count once; null and short texts give no row.  ``documents`` (text, lang) train the language model that sentence statistics are kept by.
    """
    from tessera.llm import langid

    matrix = langid.train(documents, "text", "lang")
    tagged = checkpoint(sent.with_language(segments, key, text, matrix, start, end))
    model = sent.train(tagged, "_text", "lang")
    shared = tagged.sparkSession.sparkContext.broadcast(model)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            cols: list[list] = [[] for _ in range(9)]
            for k, t, lang, s0, e0 in zip(*(b.column(i).to_pylist() for i in range(5))):
                spans = sent.split(t, lang or "", shared.value)
                s0 = None if s0 is None or s0 != s0 else s0
                e0 = None if e0 is None or e0 != e0 else e0
                base = e0 if s0 is None else s0
                width = e0 - s0 if s0 is not None and e0 is not None and e0 > s0 else 0.0
                for j, (a, z, how, s_len, r_len) in enumerate(pieces(t, spans, limit, overlap)):
                    for c, v in zip(cols, (k, j, a, z, t[a:z], how, s_len, r_len, None if base is None else base + width * a / len(t))):
                        c.append(v)
            kinds = (b.schema.field(0).type, pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=[key, *[c.split()[0] for c in SCHEMA.split(", ")]])

    src = tagged.where(F.char_length("_text") > limit).select(key, "_text", "lang", F.col(start).cast("double").alias("_s"), F.col(end).cast("double").alias("_e"))
    return src.mapInArrow(run, f"`{key}` {src.schema[key].dataType.simpleString()}, {SCHEMA}")
