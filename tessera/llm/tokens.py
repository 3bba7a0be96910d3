"""Token ids of a whole corpus by a public byte-level BPE tokenizer.

Texts are cut into pre-tokens with their positions.  A pre-token that is itself in the vocabulary (a table of fixed size)
has its id at once; of the others each block of documents sends every distinct one out once.  Their distinct words are
shuffled and each is encoded once; the ids are joined back to the blocks, where the documents are put together by
position.  A word of more rows than a share of all is joined by broadcast, of which there can only be a bounded number,
so no task meets all rows of a word that makes up a third of the corpus.

Null and empty texts have an empty list of ids.  Strings that look like special tokens are ordinary text.
"""

from __future__ import annotations

import base64
import functools
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import checkpoint

FOLDER = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
NAME = "byte_bpe_50k.tiktoken"
#: Split pattern of the vocabulary (fixed value, as its publisher gives it).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters of text that one block of documents holds at most, but for a longer single document.
BLOCK_CHARS = 1 << 19
#: A word in more blocks than this, and than this share of all rows, is joined by broadcast: at most 1 / HOT_SHARE words.
HOT_ROWS, HOT_SHARE = 20_000, 1e-3


@functools.cache
def _ranks(raw: bytes) -> dict[bytes, int]:
    """Ids by bytes from the content of a vocabulary file."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line)}


@functools.cache
def _encoder(raw: bytes):
    import tiktoken

    return tiktoken.Encoding("whole", pat_str=r"(?s).+", mergeable_ranks=_ranks(raw), special_tokens={})


@functools.cache
def _known(raw: bytes) -> dict[str, int]:
    """The vocabulary's entries that are text."""
    out = {}
    for word, rank in _ranks(raw).items():
        try:
            out[word.decode()] = rank
        except UnicodeDecodeError:
            pass
    return out


@functools.cache
def _splitter():
    import regex

    return regex.compile(PATTERN)


class _Codes(dict):
    """Codes of words: vocabulary ids, then numbers from ``first`` on for new words in the order met."""

    def __init__(self, known: dict[str, int], first: int) -> None:
        super().__init__(known)
        self.first, self.new = first, []

    def __missing__(self, word: str) -> int:
        code = self[word] = self.first + len(self.new)
        self.new.append(word)
        return code


def _cut(it: Iterator[pa.RecordBatch], vocabulary: Broadcast) -> Iterator[pa.RecordBatch]:
    """Blocks: a row for each distinct word outside the vocabulary, and a row with the codes in order, the documents and where each begins."""
    split = _splitter().findall
    known = _known(vocabulary.value)
    first = max(_ranks(vocabulary.value).values()) + 1
    part = TaskContext.get().partitionId() if TaskContext.get() else 0
    number = 0
    docs: list = []
    begin: list[int] = []
    words: list[str] = []
    size = 0

    def flush() -> pa.RecordBatch:
        nonlocal number, size
        codes = _Codes(known, first)
        seq = np.fromiter(map(codes.__getitem__, words), np.int32, len(words))
        if first + len(codes.new) <= 1 << 16:
            seq = seq.astype(np.uint16)
        n = len(codes.new)
        rows = pa.RecordBatch.from_arrays(
            [
                pa.array([(part << 32) | number] * (n + 1), pa.int64()), pa.array([*range(n), None], pa.int32()), pa.array([*codes.new, None], pa.string()),
                pa.array([None] * n + [seq.tobytes()], pa.binary()), pa.array([None] * n + [docs], pa.list_(pa.int64())), pa.array([None] * n + [[*begin, len(words)]], pa.list_(pa.int32())),
            ],
            names=["block", "k", "word", "seq", "docs", "begin"],
        )
        docs.clear(), begin.clear(), words.clear()
        number, size = number + 1, 0
        return rows

    for b in it:
        for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            docs.append(key)
            begin.append(len(words))
            if text:
                words.extend(split(text))
                size += len(text)
            if size >= BLOCK_CHARS or len(docs) >= 20_000:
                yield flush()
    if docs:
        yield flush()


def _encode(it: Iterator[pa.RecordBatch], vocabulary: Broadcast, lengths: bool) -> Iterator[pa.RecordBatch]:
    """Distinct words to their ids, or to the number of these."""
    encode = _encoder(vocabulary.value).encode_ordinary
    for b in it:
        ids = map(encode, b.column(0).to_pylist())
        out = [np.array([len(x)] if lengths else x, np.int32).tobytes() for x in ids]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary())], names=["word", "n", "ids"])


def _assemble(t: pa.Table, first: int, lengths: bool) -> pa.Table:
    """Documents of one block from its codes and the ids of its words outside the vocabulary."""
    k = t.column("k").to_numpy(zero_copy_only=False)
    at = int(np.flatnonzero(np.isnan(k))[0]) if k.dtype.kind == "f" else int(np.flatnonzero(k == None)[0])  # noqa: E711
    begin = np.array(t.column("begin")[at].as_py(), np.int64)
    raw = t.column("seq")[at].as_py()
    seq = np.frombuffer(raw, np.uint16 if len(raw) == 2 * begin[-1] else np.int32).astype(np.int64)
    keys = pa.array(t.column("docs")[at].as_py(), pa.int64())
    ids = [np.frombuffer(x, np.int32) for x in (*t.column("ids").to_pylist()[:at], *t.column("ids").to_pylist()[at + 1 :])]
    order = np.argsort(np.delete(k, at).astype(np.int64))
    ids = [ids[i] for i in order]
    # Ids that each code stands for.
    width = np.ones(first + len(ids), np.int64)
    width[first:] = [int(x[0]) for x in ids] if lengths else [len(x) for x in ids]
    ends = np.concatenate(([0], np.cumsum(width[seq])))
    bounds = ends[begin]
    if lengths:
        return pa.table({"key": keys, "n": pa.array(np.diff(bounds), pa.int64())})
    flat = np.empty(int(ends[-1]), np.int32)
    known = seq < first
    flat[ends[:-1][known]] = seq[known]
    new = np.flatnonzero(~known)
    if len(new):
        joined, begins = np.concatenate(ids), np.cumsum(width[first:]) - width[first:]
        word = seq[new] - first
        n = width[first:][word]
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        flat[np.repeat(ends[new], n) + within] = joined[np.repeat(begins[word], n) + within]
    return pa.table({"key": keys, "ids": pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(flat))})


def _vocabulary(spark: SparkSession, folder: str, name: str) -> Broadcast:
    """The vocabulary file (of fixed size, under 1 MB), sent to the executors, who needn't have it."""
    with open(f"{folder}/{name}", "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def _run(df: DataFrame, key: str, text: str, lengths: bool, folder: str, name: str) -> DataFrame:
    shared = _vocabulary(df.sparkSession, folder, name)
    first = max(_ranks(shared.value).values()) + 1
    cut = checkpoint(df.select(F.col(key).cast("bigint").alias("k"), F.col(text).alias("t")).mapInArrow(lambda it: _cut(it, shared), "block bigint, k int, word string, seq binary, docs array<bigint>, begin array<int>"))
    rows = cut.where(F.col("k").isNotNull()).select("block", "k", "word")
    distinct = rows.groupBy("word").agg(F.count("*").alias("n"))
    encoded = checkpoint(distinct.mapInArrow(lambda it: _encode(it, shared, lengths), "word string, n bigint, ids binary"))
    total = encoded.agg(F.sum("n")).first()[0] or 0
    is_hot = F.col("n") > max(HOT_ROWS, HOT_SHARE * total)
    joined = rows.join(encoded.where(~is_hot).select("word", "ids"), "word").select("block", "k", "ids")
    if total > HOT_ROWS:
        joined = joined.unionByName(rows.join(F.broadcast(encoded.where(is_hot).select("word", "ids")), "word").select("block", "k", "ids"))
    blocks = cut.where(F.col("k").isNull()).select("block", "k", F.lit(None).cast("binary").alias("ids"), "seq", "docs", "begin")
    both = joined.unionByName(blocks, allowMissingColumns=True)
    kind = "key bigint, n bigint" if lengths else "key bigint, ids array<int>"
    return both.groupBy("block").applyInArrow(lambda t: _assemble(t, first, lengths), kind).withColumnRenamed("key", key)


def encode(df: DataFrame, key: str, text: str, *, folder: str = FOLDER, name: str = NAME) -> DataFrame:
    """``key, ids`` for every row of ``df`` (integer ``key``); repeated rows give repeated rows, other columns are dropped."""
    return _run(df, key, text, False, folder, name)


def count(df: DataFrame, key: str, text: str, *, folder: str = FOLDER, name: str = NAME) -> DataFrame:
    """``key, n_tokens`` for every row of ``df``."""
    return _run(df, key, text, True, folder, name).withColumnRenamed("n", "n_tokens")


def decode(df: DataFrame, key: str, ids: str, *, folder: str = FOLDER, name: str = NAME) -> DataFrame:
    """``key, text`` from lists of ids: ids joined with the table of token bytes (of fixed size) and put together by position.

    Unknown ids and bytes that are no UTF-8 become the replacement character; null lists give null, empty ones ''.
    Repeated rows count once; keys must otherwise be unique.
    """
    with open(f"{folder}/{name}", "rb") as f:
        ranks = _ranks(f.read())
    table = df.sparkSession.createDataFrame([(i, raw.hex()) for raw, i in ranks.items()], "_id int, _bytes string")
    src = df.select(F.col(key).alias("_key"), F.col(ids).alias("_ids")).distinct()
    tokens = src.select("_key", F.posexplode("_ids").alias("_at", "_id")).join(F.broadcast(table), "_id", "left")
    parts = F.array_sort(F.collect_list(F.struct("_at", F.coalesce("_bytes", F.lit("ff")).alias("b"))))
    texts = tokens.groupBy("_key").agg(F.array_join(F.transform(parts, lambda x: x["b"]), "").alias("_hex"))
    said = texts.select(F.col("_key").alias(key), F.expr("make_valid_utf8(cast(unhex(_hex) as string))").alias("text"))
    silent = src.where(F.col("_ids").isNull() | (F.size("_ids") == 0)).select(F.col("_key").alias(key), F.when(F.col("_ids").isNotNull(), "").alias("text"))
    return said.unionByName(silent)
