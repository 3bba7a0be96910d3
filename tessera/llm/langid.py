"""Language of texts and of the stretches of mixed texts.

Multinomial naive Bayes over hashed character 1- to 3-grams.  The log-probability matrix (a few MB, of fixed size
whatever the corpus) is broadcast; batches of texts are scored in numpy: all grams of a batch are hashed at once and
the rows of the matrix are added up per stretch with one ``reduceat``.

A stretch is a run of text up to a sentence mark or line break.  Stretches are first scored alone; the shares that
follow for each text are the prior of a second scoring, so that a short stretch of names follows its surroundings.

Training takes a bounded, hash-chosen sample of labelled documents (``max_docs`` of each language); a second pass over it
replaces each label by the prediction for each stretch, which removes wrong labels and splits mixed documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.textcodes import base_letters, code_points, letters, plain

# Languages of the project and their names, three-letter codes.
LANGUAGES = ("en", "ur", "ar", "fa", "tr", "id", "hi", "zh", "th")
NAMES = {
    "english": "en", "eng": "en", "en": "en",
    "urdu": "ur", "urd": "ur", "ur": "ur",
    "arabic": "ar", "ara": "ar", "ar": "ar",
    "persian": "fa", "farsi": "fa", "fas": "fa", "per": "fa", "fa": "fa",
    "turkish": "tr", "tur": "tr", "tr": "tr",
    "indonesian": "id", "ind": "id", "id": "id", "in": "id",
    "hindi": "hi", "hin": "hi", "hi": "hi",
    "chinese": "zh", "zho": "zh", "chi": "zh", "zh": "zh", "mandarin": "zh",
    "thai": "th", "tha": "th", "th": "th",
}
#: Scripts with one language each in LANGUAGES, as code-point ranges: they give that language a prior.
OWN_SCRIPT = {"hi": (0x900, 0x980), "zh": (0x4E00, 0xA000), "th": (0xE00, 0xE80)}
#: A language written in a second script has a class for it, named language-Script, which counts as the language.
CLASSES = (*LANGUAGES, "ur-Latn")
CLASS_LANG = np.array([LANGUAGES.index(c[:2]) for c in CLASSES])
K, PAD = len(CLASSES), 12
BUCKETS, ORDERS = 1 << 15, 3
TERMS = np.array([ord(c) for c in ".!?۔؟।…"], np.uint32)
CLOSERS = np.array([0x22, 0x29, 0xBB, 0x201D], np.uint32)
TERMS_ALONE = np.array([ord(c) for c in "。！？"], np.uint32)
CHUNK = 150_000


def label_code(label: Column) -> Column:
    """Two-letter code that a label names in any usual notation; null where it names none."""
    names = F.create_map(*[F.lit(x) for kv in NAMES.items() for x in kv])
    return F.try_element_at(names, F.regexp_extract(F.lower(F.trim(label)), r"^([a-z]+)", 1))


@dataclass
class Scored:
    """Stretches of a batch: text they are in, first and last position in the plain text, letters, class scores."""

    text: np.ndarray
    start: np.ndarray
    end: np.ndarray
    letters: np.ndarray
    loglik: np.ndarray
    grams: tuple[np.ndarray, np.ndarray, np.ndarray]


def stretches(texts: list[str], matrix: np.ndarray | None) -> Scored:
    """Cut plain texts into stretches and score them; without a matrix only the grams (bucket, stretch) are given."""
    lower = [t.lower() for t in texts]
    if any(len(a) != len(b) for a, b in zip(lower, texts)):  # positions must stay
        lower = ["".join(c.lower() if len(c.lower()) == 1 else c for c in t) for t in texts]
    a = code_points("\n".join(lower) + "\n\n")
    n = len(a) - 1
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    begin = np.concatenate(([0], np.cumsum(lens + 1)))[:-1]
    isl = letters()[np.minimum(a, 0x3FFFF)]
    before, before2 = np.append([10], a[:-1]), np.append([10, 10], a[:-2])
    # A stretch ends at a line break, at a mark of a dense script, and at a space after a mark, a closing sign between.
    ended = np.isin(before, TERMS) | (np.isin(before, CLOSERS) & np.isin(before2, TERMS))
    cut = (a == 10) | ((a == 32) & ended) | np.isin(a, TERMS_ALONE)
    stretch = np.concatenate(([0], np.cumsum(cut)))[:-1]
    at = np.flatnonzero(isl[:n])
    if not len(at):
        none = np.zeros(0, np.int64)
        return Scored(none, none, none, none, np.zeros((0, K), np.float32), (np.zeros((0, 3), np.int64), none, a[:0]))
    x = np.where(isl == 1, a, 32).astype(np.uint64)
    prev = np.append(np.uint64(32), x[:-1])[at]
    here, after = x[at], x[at + 1]
    m1, m2, m3 = np.uint64(0x9E3779B1), np.uint64(0x85EBCA77), np.uint64(0xC2B2AE3D)
    g1 = ((here * m1) >> np.uint64(7)) & np.uint64(BUCKETS - 1)
    g2 = ((here * m2 + after * m3) >> np.uint64(9)) & np.uint64(BUCKETS - 1)
    g3 = ((prev * m1 + here * m3 + after * m2) >> np.uint64(11)) & np.uint64(BUCKETS - 1)
    grams = np.empty((len(at), 3), np.int64)
    grams[:, 0], grams[:, 1], grams[:, 2] = g1, g2 + BUCKETS, g3 + 2 * BUCKETS
    of = stretch[at]
    own, first = np.unique(of, return_index=True)
    last = np.append(first[1:], len(at)) - 1
    loglik = np.zeros((len(own), K), np.float32)
    if matrix is not None:
        rows = matrix[grams[:, 0]]
        rows += matrix[grams[:, 1]]
        rows += matrix[grams[:, 2]]
        loglik = np.add.reduceat(rows, first, axis=0)[:, :K] / ORDERS
    text = np.searchsorted(begin, at[first], "right") - 1
    n_letters = np.add.reduceat(base_letters()[np.minimum(a[at], 0x3FFFF)].astype(np.int64), first)
    return Scored(text, at[first] - begin[text], at[last] + 1 - begin[text], n_letters, loglik, (grams, np.searchsorted(own, of), a[at]))


def posteriors(s: Scored, n_texts: int) -> np.ndarray:
    """Class probabilities of stretches after the second scoring."""

    def soft(z: np.ndarray) -> np.ndarray:
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    if not len(s.text):
        return np.zeros((0, K))
    z = s.loglik.astype(np.float64)
    p = soft(z)
    mix = np.zeros((n_texts, K))
    np.add.at(mix, s.text, p * s.letters[:, None])
    mix = (mix + 1.0) / (mix.sum(axis=1, keepdims=True) + K)
    return soft(z + np.log(mix[s.text]))


def shares(texts: list[str], matrix: np.ndarray) -> np.ndarray:
    """Letters of each text by language (rows: texts, columns: LANGUAGES), and the mean probability of the choice."""
    out = np.zeros((len(texts), len(LANGUAGES) + 1))
    at, size = 0, 0
    for i, t in enumerate([*texts, None]):
        if t is None or size > CHUNK:
            part = texts[at:i]
            s = stretches(part, matrix)
            p = posteriors(s, len(part))
            if len(p):
                lang = np.zeros((len(p), len(LANGUAGES)))
                np.add.at(lang.T, CLASS_LANG, p.T)
                best = lang.argmax(axis=1)
                np.add.at(out, (at + s.text, best), s.letters)
                np.add.at(out, (at + s.text, len(LANGUAGES)), s.letters * lang[np.arange(len(p)), best])
            at, size = i, 0
        if t is not None:
            size += len(t) + 1
    total = out[:, :-1].sum(axis=1)
    out[:, -1] = np.divide(out[:, -1], total, out=np.zeros(len(texts)), where=total > 0)
    return out


def _matrix(counts: np.ndarray) -> np.ndarray:
    """Log probabilities (3 * BUCKETS, PAD) from counts (K, 3 * BUCKETS); every class weighs the same, so an unseen gram favours none."""
    out = np.zeros((ORDERS * BUCKETS, PAD), np.float32)
    for o in range(ORDERS):
        part = counts[:, o * BUCKETS : (o + 1) * BUCKETS].astype(np.float64)
        total = part.sum(axis=1, keepdims=True)
        p = np.divide(part, total, out=np.zeros_like(part), where=total > 0)
        weight = 20_000.0
        out[o * BUCKETS : (o + 1) * BUCKETS, :K] = np.log((p * weight + 0.1) / (weight + 0.1 * BUCKETS)).T
    return out


def _own_script_counts() -> np.ndarray:
    counts = np.zeros((K, ORDERS * BUCKETS), np.float32)
    for lang, (lo, hi) in OWN_SCRIPT.items():
        s = stretches([" ".join(map(chr, range(lo, hi)))], None)
        np.add.at(counts[CLASSES.index(lang)], s.grams[0][:, 0], 1.0)
    return counts


def _counts(rows: Iterator[pa.RecordBatch], matrix: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    counts = np.zeros((K, ORDERS * BUCKETS), np.float32)
    for batch in rows:
        rest = [(plain(t), LANGUAGES.index(c)) for t, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
        while rest:
            size, n = 0, 0
            while n < len(rest) and size <= CHUNK:  # a part of the batch, as in ``shares``
                size, n = size + len(rest[n][0]), n + 1
            part, rest = rest[:n], rest[n:]
            _count_part([t for t, _ in part], np.array([c for _, c in part], np.int64), matrix, counts)
    yield pa.RecordBatch.from_pydict({"c": [zlib.compress(counts.tobytes(), 1)]})


def _count_part(texts: list[str], labels: np.ndarray, matrix: np.ndarray | None, counts: np.ndarray) -> None:
    latin, arabic = CLASSES.index("ur-Latn"), CLASSES.index("ur")
    s = stretches(texts, matrix)
    if not len(s.text):
        return
    grams, of, chars = s.grams
    if matrix is None:
        cls = labels[s.text]
        is_latin = np.bincount(of, (chars < 0x250), len(s.text)) > 0.5 * np.bincount(of, minlength=len(s.text))
        cls = np.where((cls == arabic) & is_latin, latin, cls)
    else:
        cls = posteriors(s, len(texts)).argmax(axis=1)
    flat = cls[of][:, None] * (ORDERS * BUCKETS) + grams
    counts += np.bincount(flat.ravel(), minlength=counts.size).reshape(counts.shape)


def train(labelled: DataFrame, text: str, label: str, *, max_docs: int = 1_000, passes: int = 2) -> np.ndarray:
    """Log-probability matrix from documents and their labels in any notation.

    At most about ``max_docs`` labelled documents of each language are read into the model: those whose text hash lies
    under the language's threshold, so the sample doesn't depend on the order of rows, and a rare language keeps its
    share.  Repeated texts count once; null and blank texts and unknown labels are left out.  With no labelled row the
    model knows only the languages that own a script.
    """
    rows = labelled.select(F.col(text).alias("t"), label_code(F.col(label)).alias("l")).where(F.col("l").isNotNull() & (F.trim("t") != "")).withColumn("h", F.xxhash64("t"))
    # Distinct labelled texts of each language, counted by their hashes.
    counts = {r.l: r.n for r in rows.select("l", "h").distinct().groupBy("l").agg(F.count("*").alias("n")).collect()}
    whole = 1 << 40
    under = F.create_map(*[x for lang, n in counts.items() for x in (F.lit(lang), F.lit(int(whole * min(1.0, max_docs / n))).cast("bigint"))]) if counts else F.lit(None).cast("map<string, bigint>")
    sample = rows.where(F.pmod("h", F.lit(whole).cast("bigint")) < under[F.col("l")]).select("t", "l").distinct().repartition(6).persist()
    base = _own_script_counts()
    matrix = None
    for _ in range(passes):
        found = sample.mapInArrow(lambda it, m=matrix: _counts(it, m), "c binary").collect()
        matrix = _matrix(base * 0.01 + sum(np.frombuffer(zlib.decompress(r.c), np.float32).reshape(base.shape) for r in found))
    sample.unpersist()
    return matrix


def _best(row: np.ndarray) -> tuple[str | None, float, str | None, float, int]:
    """Language, confidence, second language, its share of the letters, letters."""
    total = row[:-1].sum()
    if not total:
        return None, 0.0, None, 0.0, 0
    order = np.argsort(-row[:-1], kind="stable")
    second = float(row[order[1]] / total)
    return LANGUAGES[order[0]], float(row[-1] * row[order[0]] / total), LANGUAGES[order[1]] if second else None, second, int(total)


def best(found: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``_best`` of many rows at once, languages as their numbers, -1 for none."""
    m = found[:, :-1]
    at = np.arange(len(m))
    total = m.sum(axis=1)
    order = np.argsort(-m, axis=1, kind="stable")
    first, second = order[:, 0], order[:, 1]
    some = total > 0
    share = np.divide(m[at, second], total, out=np.zeros(len(m)), where=some)
    confidence = np.divide(found[:, -1] * m[at, first], total, out=np.zeros(len(m)), where=some)
    return np.where(some, first, -1), confidence, np.where(share > 0, second, -1), share, total.astype(np.int64)


#: Names by number; the last, -1, is null.
_NAMED = pa.array([*LANGUAGES, None], pa.string())


def named(numbers: np.ndarray) -> pa.Array:
    return _NAMED.take(pa.array(np.where(numbers < 0, len(LANGUAGES), numbers)))


SHARE_SCHEMA = "lang string, confidence double, second_lang string, second_share double, n_letters bigint"


def detect(df: DataFrame, key: str, text: str, matrix: np.ndarray, *more: str) -> DataFrame:
    """``key, lang, confidence, second_lang, second_share, n_letters`` and the columns ``more`` of every row.

    ``lang`` is the language of most letters; ``confidence`` its share times the mean probability of the stretches.
    Null, blank and letterless texts have a null language and confidence 0.  Repeated rows give repeated rows.
    """
    shared = df.sparkSession.sparkContext.broadcast(matrix)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            first, confidence, second, share, letters_ = best(shares([plain(t or "") for t in b.column(1).to_pylist()], shared.value))
            arrays = [b.column(0), named(first), pa.array(confidence), named(second), pa.array(share), pa.array(letters_), *[b.column(2 + i) for i in range(len(more))]]
            yield pa.RecordBatch.from_arrays(arrays, names=[key, "lang", "confidence", "second_lang", "second_share", "n_letters", *more])

    src = df.select(F.col(key), F.col(text).alias("_scored"), *[F.col(c) for c in more])
    kind = lambda c: src.schema[c].dataType.simpleString()
    return src.mapInArrow(run, ", ".join([f"`{key}` {kind(key)}", SHARE_SCHEMA, *[f"`{c}` {kind(c)}" for c in more]]))


def detect_stretches(df: DataFrame, key: str, text: str, matrix: np.ndarray) -> DataFrame:
    """``key, start_pos, end_pos, lang, confidence`` of each run of stretches of one language, positions in the plain form.

    Neighbouring stretches of one language are one run; its confidence is the mean over letters.  Texts without letters
    give no row.
    """
    shared = df.sparkSession.sparkContext.broadcast(matrix)

    def part(keys: list, texts: list[str]) -> list[list]:
        s = stretches(texts, shared.value) if texts else None
        if s is None or not len(s.text):
            return [[], [], [], [], []]
        p = posteriors(s, len(texts))
        lang = np.zeros((len(p), len(LANGUAGES)))
        np.add.at(lang.T, CLASS_LANG, p.T)
        best = lang.argmax(axis=1)
        first = np.flatnonzero(np.append(True, (best[1:] != best[:-1]) | (s.text[1:] != s.text[:-1])))
        last = np.append(first[1:], len(best)) - 1
        weight = np.maximum(s.letters, 1)
        conf = np.add.reduceat(lang[np.arange(len(best)), best] * weight, first) / np.add.reduceat(weight, first)
        return [[keys[i] for i in s.text[first]], s.start[first].tolist(), s.end[last].tolist(), [LANGUAGES[i] for i in best[first]], conf.tolist()]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            keys = b.column(0).to_pylist()
            texts = [plain(t or "") for t in b.column(1).to_pylist()]
            at, size = 0, 0
            for i, t in enumerate([*texts, None]):
                if t is None or size > CHUNK:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(part(keys[at:i], texts[at:i]), (b.schema.field(0).type, pa.int32(), pa.int32(), pa.string(), pa.float64()))], names=[key, "start_pos", "end_pos", "lang", "confidence"])
                    at, size = i, 0
                if t is not None:
                    size += len(t) + 1

    src = df.select(F.col(key), F.col(text).alias("_text"))
    return src.mapInArrow(run, f"`{key}` {src.schema[key].dataType.simpleString()}, start_pos int, end_pos int, lang string, confidence double")


def _item(kind: str, key: str) -> list[Column]:
    return [F.lit(kind).alias("item_kind"), F.col(key).cast("bigint").alias("item_key")]


def stretches_of_items(documents: DataFrame, segments: DataFrame, **training: int) -> DataFrame:
    """``item_kind, item_key, start_pos, end_pos, lang, confidence`` of the stretches of documents and v2 segments; a redelivered segment counts once."""
    matrix = train(documents, "text", "lang", **training)
    rows = ["start_pos", "end_pos", "lang", "confidence"]
    spoken = segments.where(F.col("version") == "v2").select("seg_key", "text").dropDuplicates(["seg_key"])
    of_doc = detect_stretches(documents, "doc_id", "text", matrix).select(*_item("document", "doc_id"), *rows)
    return of_doc.unionByName(detect_stretches(spoken, "seg_key", "text", matrix).select(*_item("segment", "seg_key"), *rows))


def languages_of_items(documents: DataFrame, questions: DataFrame, **training: int) -> DataFrame:
    """``item_kind, item_key, lang, confidence`` of every document and question; null and 0 where it has no letters."""
    matrix = train(documents, "text", "lang", **training)
    of_doc = detect(documents, "doc_id", "text", matrix).select(*_item("document", "doc_id"), "lang", "confidence")
    return of_doc.unionByName(detect(questions, "q_key", "question", matrix).select(*_item("question", "q_key"), "lang", "confidence"))


#: A text is mixed where the second language has this share of its letters.
MIXED_SHARE = 0.30


def found_items(spark: SparkSession, documents: DataFrame, questions: DataFrame, segments: DataFrame, **training: int) -> DataFrame:
    """Items with a missing or wrong label, and items in two languages: ``item_kind, item_key, found_lang``."""
    matrix = train(documents, "text", "lang", **training)
    docs = detect(documents.withColumn("_label", label_code(F.col("lang"))), "doc_id", "text", matrix, "_label")
    asked = detect(questions.withColumn("_label", label_code(F.col("question_language"))), "q_key", "question", matrix, "_label")
    spoken = detect(segments.where(F.col("version") == "v2"), "seg_key", "text", matrix)
    wrong = F.col("lang").isNotNull() & ~F.col("_label").eqNullSafe(F.col("lang"))
    mixed = F.col("second_share") >= MIXED_SHARE
    both = F.array_join(F.array_sort(F.array("lang", "second_lang")), "+")
    item = lambda kind, key, lang: F.struct(F.lit(kind).alias("item_kind"), F.col(key).cast("bigint").alias("item_key"), lang.alias("found_lang"))
    of_doc = docs.select(F.inline(F.filter(F.array(F.when(wrong, item("document", "doc_id", F.col("lang"))), F.when(mixed, item("mixed_document", "doc_id", both))), lambda x: x.isNotNull())))
    of_question = asked.where(wrong).select(F.inline(F.array(item("question", "q_key", F.col("lang")))))
    of_segment = spoken.where(mixed).select(F.inline(F.array(item("mixed_segment", "seg_key", both))))
    return of_doc.unionByName(of_question).unionByName(of_segment).distinct()
