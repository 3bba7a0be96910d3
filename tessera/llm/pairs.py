"""Broken prompt and response pairs: empty, refusing, copying, truncated and foreign-language answers.

* Languages of prompt and answer are compared by their character n-gram naive Bayes posteriors.
* Truncation: the likelihood of n-grams (the last mark; or the last word, and pairs of it with the words before it by
  distance) to stand at the end of a text against its middle, counted over the complete sentences of all answers.  An
  exact check for open brackets, quotations and citations follows.
* Refusal: naive Bayes over word n-grams; answers to unanswerable prompts against answers to answerable ones, with a
  few general phrases of refusal in each language as a prior.

All counts are kept in hashed tables of fixed size, whatever the corpus; their cells are summed by bucket.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import langid
from tessera.llm.textcodes import plain

DEFECTS = ("empty", "refusal", "copy", "truncated", "other_language")
SIZE, ENDS = 1 << 20, 1 << 22
#: Words in which a refusal is looked for at once; a longer answer is taken in windows of so many, each half over the one before.
WINDOW = 60
NEAR = 8
_THINK = re.compile(r"<think>.*?(?:</think>|$)", re.S)
#: An id of a citation has an underscore, and may have a name before it.
_ID = r"(?:\w+=)?[\w.-]*_[\w.-]*"
_CITE = re.compile(rf"[\[(（]\s*{_ID}(?:\s*[,;،；]\s*{_ID})*\s*[\])）]")
_OPEN = re.compile(r"[\[(（][^\[\]()（）]*$")
_OPEN_CITE = re.compile(r"[\[(（][^\[\]()（）\s]*[_=][^\[\]()（）]*$")
_LABEL = re.compile(r"^\W*\w{1,12}\s*[:：]\s*")
_MARKS = "\u0300-\u036f\u0610-\u061a\u064b-\u065f\u0670\u06d6-\u06dc\u0900-\u0963\u0e31\u0e34-\u0e3a\u0e47-\u0e4e\u200c"
_WORD = re.compile(rf"[⺀-鿿]|[^\W_⺀-鿿](?:[^\W_⺀-鿿]|['’](?=\w)|[{_MARKS}])*")
_FINAL = re.compile(r"[.!?۔؟।。！？…]")
_SPLIT = re.compile(r"(?<=[.!?۔؟।…])[\"»”’)\]）]*\s+|(?<=[。！？])[”」）]*|\n+")
_CLOSING = "\"»”’)]）」"
#: A quotation after the last sentence.
_QUOTED = re.compile(r"(?<=[\s.!?۔؟।。！？…])(?:«[^«»]*»|“[^“”]*”|\"[^\"]*\")$")
_PAIRS = {"(": ")", "[": "]", "（": "）", "«": "»", "“": "”", "「": "」"}

#: What the phrases below count for in the refusals' side, as the prior.
PHRASE_WEIGHT = 4
# General phrases by which answers are declined.
REFUSAL_PHRASES = (
    "I cannot answer", "I can't help with that", "unable to answer", "not enough information to answer", "no answer is given in the excerpts",
    "میں جواب نہیں دے سکتا", "جواب موجود نہیں", "کافی معلومات نہیں", "main jawab nahin de sakta", "jawab mojood nahin", "kaafi maloomat nahin",
    "لا أستطيع الإجابة", "لا يوجد جواب", "لا توجد معلومات كافية للإجابة",
    "نمی‌توانم پاسخ بدهم", "پاسخی وجود ندارد", "اطلاعات کافی برای پاسخ ندارد",
    "cevap veremiyorum", "soruyu yanıtlamak için yeterli bilgi yok", "yanıt yok",
    "saya tidak dapat menjawab", "tidak ada jawaban", "tidak cukup informasi untuk menjawab",
    "मैं उत्तर नहीं दे सकता", "पर्याप्त जानकारी नहीं", "उत्तर मौजूद नहीं",
    "我无法回答", "没有足够的信息来回答", "没有答案",
)


def body(answer: str | None) -> str:
    """The answer without thinking blocks and citations."""
    return _CITE.sub(" ", _THINK.sub(" ", plain(answer or ""))).strip()


def words(text: str) -> list[str]:
    """Lower-case words; ideographs are words of their own; numbers are one word."""
    return ["0" if w[0].isdigit() else w for w in map(str.lower, _WORD.findall(text))]


def _bare(text: str) -> str:
    return "".join(ch for ch in plain(text).lower() if ch.isalnum())


_MULT = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))
_memo: dict[str, int] = {}


def _hashes(ws: list[str]) -> np.ndarray:
    """64-bit hashes of words; those of short words are remembered."""
    out = []
    for w in ws:
        h = _memo.get(w)
        if h is None:
            raw = w.encode("utf-8", "replace")
            h = zlib.crc32(raw) << 32 | zlib.adler32(raw[::-1])
            if len(_memo) < 500_000:
                _memo[w] = h
        out.append(h)
    return np.array(out, np.uint64)


def _mix(a: np.ndarray, b: np.ndarray | int, salt: int) -> np.ndarray:
    x = a * _MULT[0] + np.uint64(salt * int(_MULT[2]) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(29))) + b * _MULT[1]
    x = (x ^ (x >> np.uint64(32))) * _MULT[0]
    return x >> np.uint64(24)


def _grams(h: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the 1- to 3-grams of word hashes, and the text that each is of."""
    zero = np.uint64(0)
    keys, owner = [_mix(h, zero, 1)], [of]
    for d in (1, 2):
        if len(h) > d:
            same = of[d:] == of[:-d]
            mid = h[1 : len(h) - 1] if d == 2 else zero
            keys.append(_mix(h[:-d] + mid * _MULT[2], h[d:], 1 + d)[same])
            owner.append(of[d:][same])
    return (np.concatenate(keys) & np.uint64(SIZE - 1)).astype(np.int64), np.concatenate(owner)


def _distance(d: int) -> int:
    return d if d < 3 else 3 if d < 5 else 4


def _end_keys(h: np.ndarray, of: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(position, bucket) arrays: each word alone (two hashes), then with the word at each distance before it."""
    at = np.arange(len(h))
    zero = np.uint64(0)
    out = [(at, _mix(h, zero, 11)), (at, _mix(h, zero, 12))]
    for d in range(1, NEAR + 1):
        if len(h) > d:
            same = np.flatnonzero(of[d:] == of[:-d])
            out.append((same + d, _mix(h[same], h[same + d], 20 + _distance(d))))
    return [(p, (k & np.uint64(ENDS - 1)).astype(np.int64)) for p, k in out]


def complete_sentences(text: str) -> Iterator[tuple[list[str], str, list[str]]]:
    """Words of the sentences of a body that end in a mark, that mark, and the marks inside."""
    for part in _SPLIT.split(text):
        part = (part or "").strip().rstrip(_CLOSING)
        if part and _FINAL.match(part[-1]):
            ws = words(part)
            if len(ws) > 1:
                yield ws, part[-1], _FINAL.findall(part[:-1])


def windows(ws: list[str]) -> list[list[str]]:
    return [ws] if len(ws) <= WINDOW else [ws[i : i + WINDOW] for i in range(0, len(ws) - WINDOW // 2, WINDOW // 2)]


@dataclass
class Model:
    ends: np.ndarray  # ENDS x 2: at the end, before the end
    refusal: np.ndarray  # SIZE log ratios


def _flat(parts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    return _hashes([w for p in parts for w in p]), np.repeat(np.arange(len(parts)), [len(p) for p in parts])


def _mark_keys(marks: list[str]) -> np.ndarray:
    return (_mix(_hashes(marks), np.uint64(0), 13) & np.uint64(ENDS - 1)).astype(np.int64)


def _count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nonzero cells of the tables: bucket (ends, then refusals, then one for the answers) and the counts of its two sides."""
    cells = np.zeros((2, ENDS + SIZE + 1), np.int64)
    for b in it:
        sides: tuple[list, list] = ([], [])
        sents: list[list[str]] = []
        marks: tuple[list, list] = ([], [])
        for answer, answerable in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            text = body(answer)
            ws = words(text)
            if not ws:
                continue
            for sentence, mark, inside in complete_sentences(text):
                sents.append(sentence)
                marks[0].append(mark)
                marks[1].extend(inside)
            if answerable is not None:
                sides[0 if answerable is False else 1].append(ws)
        for i, parts in enumerate(sides):
            cells[i, -1] += len(parts)
            if parts:
                np.add.at(cells[i], ENDS + _grams(*_flat(parts))[0], 1)
        for i, found in enumerate(marks):
            if found:
                np.add.at(cells[i], _mark_keys(found), 1)
        if sents:
            h, of = _flat(sents)
            last = np.append(of[1:] != of[:-1], True)
            for at, key in _end_keys(h, of):
                for side, mask in ((0, last[at]), (1, ~last[at])):
                    np.add.at(cells[side], key[mask], 1)
    at = np.flatnonzero(cells.any(axis=0))
    for i in range(0, len(at), 100_000):
        part = at[i : i + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(cells[0, part]), pa.array(cells[1, part])], names=["at", "a", "b"])


def _packed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cells as compressed bytes, for the way to the driver."""
    for b in it:
        cols = [c.to_numpy().astype(t).tobytes() for c, t in zip(b.columns, (np.int32, np.int64, np.int64))]
        yield pa.RecordBatch.from_pydict({"raw": [zlib.compress(b"".join(cols), 1)], "n": [b.num_rows]})


def train(reviews: DataFrame, answer: str, answerable: str) -> Model:
    """Counts over every row.  A task's table has at most ENDS + SIZE cells and so has their sum, which goes to the driver."""
    tasks = 4 * reviews.sparkSession.sparkContext.defaultParallelism  # each with a table, whatever the rows
    cells = reviews.select(F.col(answer), F.col(answerable)).coalesce(tasks).mapInArrow(_count, "at int, a bigint, b bigint").groupBy("at").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    sums = np.zeros((2, ENDS + SIZE + 1))
    for r in cells.mapInArrow(_packed, "raw binary, n bigint").toLocalIterator():
        raw = zlib.decompress(r.raw)
        at = np.frombuffer(raw, np.int32, r.n)
        sums[:, at] = np.frombuffer(raw, np.int64, 2 * r.n, 4 * r.n).reshape(2, r.n)
    ends, (no, yes), n = sums[:, :ENDS].astype(np.float32), sums[:, ENDS : ENDS + SIZE], sums[:, -1]
    share = (n + 1) / (n.sum() + 2)
    prior = np.bincount(_grams(*_flat([words(plain(p)) for p in REFUSAL_PHRASES]))[0], minlength=SIZE)
    no = no + PHRASE_WEIGHT * prior
    weight = 3.0
    ratio = np.log((no + weight * share[0]) / share[0]) - np.log((yes + weight * share[1]) / share[1])
    return Model(ends.T.copy(), ratio.astype(np.float32))


def end_score(model: Model, ws: list[str], mark: str | None = None) -> float:
    """Log odds that the last mark, or without one the last word, stands at an end rather than inside a sentence."""
    if mark:
        e, m = model.ends[_mark_keys([mark])[0]]
        return float(np.log((e + 1) / (m + 0.5)))
    if not ws:
        return 0.0
    ws = ws[-(NEAR + 1) :]
    last = len(ws) - 1
    keys = [int(k[at == last][0]) for at, k in _end_keys(_hashes(ws), np.zeros(len(ws), np.int64)) if (at == last).any()]
    e, m = np.minimum(model.ends[keys[0]], model.ends[keys[1]])
    if e + m == 0:
        return -3.0
    p = (e + 0.5) / (e + m + 1)
    base = float(np.log(p / (1 - p)))
    score = base
    for h in keys[2:]:
        a, b = model.ends[h]
        if a + b:
            score += float(np.log((a + 2 * p) / (b + 2 * (1 - p)))) - base
    return score


def refusal_scores(model: Model, texts: list[list[str]]) -> np.ndarray:
    """Mean log ratio of the grams of each list of words; 0 for empty lists."""
    out = np.zeros(len(texts))
    if any(texts):
        key, of = _grams(*_flat(texts))
        n = np.bincount(of, minlength=len(texts))
        out = np.bincount(of, model.refusal[key], len(texts)) / np.maximum(n, 1)
    return out


def is_truncated(model: Model, answer: str, text: str) -> bool:
    """Breaks off inside a sentence or word, by the likelihood of its end; or, by an exact check, inside a citation, bracket or quotation.

    A missing final mark alone is no break.
    """
    tail = _QUOTED.sub("", text.rstrip(" *_>#`")).rstrip(" *_>#`")
    last = [p for p in _SPLIT.split(tail) if p and p.strip()]
    final = tail.rstrip(_CLOSING)[-1:]
    if end_score(model, words(last[-1]) if last else [], final if _FINAL.match(final) else None) < 0:
        return True
    if _OPEN.search(_THINK.sub(" ", plain(answer)).strip()):
        return True
    stack: list[str] = []
    for ch in tail:
        if ch in _PAIRS:
            stack.append(_PAIRS[ch])
        elif stack and ch == stack[-1]:
            stack.pop()
    return bool(stack) or tail.count('"') % 2 == 1


def defect(model: Model, question: str | None, answer: str | None, answerable: bool | None, langs: tuple[str | None, str | None], refusal: float) -> str | None:
    text = body(answer)
    shown = _OPEN_CITE.sub("", text)
    bare = _bare(shown)
    if not bare:
        return "empty"
    asked = _bare(question or "")
    forms = (bare, _bare(_LABEL.sub("", shown, count=1)))
    if asked and any(s and len(s) % len(asked) == 0 and s == asked * (len(s) // len(asked)) for s in forms):
        return "copy"
    if refusal > REFUSAL_AT:
        return "refusal" if answerable else None
    if is_truncated(model, answer or "", text):
        return "truncated"
    if langs[0] and langs[1] and langs[0] != langs[1]:
        return "other_language"
    return None


REFUSAL_AT = 0.9


def defects(reviews: DataFrame, key: str, question: str, answer: str, answerable: str, documents: DataFrame) -> DataFrame:
    """``key, defect`` of each pair with a defect: the first of DEFECTS that applies.

    Refusals where ``answerable`` isn't true are no defect of any kind.  Null questions can't be copied nor differ in
    language; repeated keys count once; an empty table gives no row.  ``documents`` (text, lang) train the languages.
    """
    one = reviews.select(F.col(key), F.col(question).alias("_q"), F.col(answer).alias("_a"), F.col(answerable).cast("boolean").alias("_ok")).dropDuplicates([key])
    matrix = langid.train(documents, "text", "lang")
    model = train(one, "_a", "_ok")
    spark = reviews.sparkSession
    shared = spark.sparkContext.broadcast((matrix, model))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix, model = shared.value
        for b in it:
            keys, qs, answers, oks = (b.column(i).to_pylist() for i in range(4))
            lang = langid.named(langid.best(langid.shares([plain(q or "") for q in qs], matrix))[0]).to_pylist()
            said = langid.named(langid.best(langid.shares([body(a) for a in answers], matrix))[0]).to_pylist()
            told = [windows(words(_LABEL.sub("", body(a), count=1))) for a in answers]
            of = np.repeat(np.arange(len(told)), [len(x) for x in told])
            scores = np.full(len(told), -np.inf)
            np.maximum.at(scores, of, np.asarray(refusal_scores(model, [w for x in told for w in x]), np.float64))
            found = [defect(model, q, a, ok, (l1, l2), float(r)) for q, a, ok, l1, l2, r in zip(qs, answers, oks, lang, said, scores)]
            hit = [i for i, x in enumerate(found) if x]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(hit, pa.int32())), pa.array([found[i] for i in hit], pa.string())], names=[key, "defect"])

    return one.mapInArrow(run, f"`{key}` {one.schema[key].dataType.simpleString()}, defect string")
