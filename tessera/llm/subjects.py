"""Subject areas of documents by class-association rules.

Transactions are the sentences of labelled documents: their telling words plus the document's subject.  Parallel
frequent-pattern growth mines the sets of words that tell a subject: every transaction gives, for each of its words, the
more frequent words before it; equal ones are combined, and the patterns that end in a word are grown from its own part.
A pattern isn't grown further where no longer rule could be surer by GAIN, nor by a word that all of its transactions
hold: such rules would be redundant.  Support alone bounds the rest.  Rules that a shorter rule makes redundant are pruned,
and every sentence of the corpus is scored by the evidence of all rules that match it, calibrated on the labelled sentences.

Words are told apart by language, and a word tells a subject by comparison with the subjects of its language, so that a
language with few labels doesn't take all its words for one subject.  Labels are sparse, so the rules found first name
the subject of documents they are sure of, and the rules are mined again over these.  The classifier is fitted on at most
MAX_DOCS documents of each language, chosen by hash; its size is bounded by that, and every document is scored.

A document has each subject of which at least a quarter of its sentences speak, of those that speak of any.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import langid
from tessera.llm.pairs import _CLOSING, _WORD
from tessera.llm.textcodes import plain
from tessera.session import checkpoint

MIN_COUNT, MIN_SUPPORT, MIN_CONFIDENCE = 3, 2e-5, 0.35
#: How much surer than each of its parts a longer rule must be.
GAIN = 0.02
#: A telling word has this share of its occurrences in one subject, and this many times the subject's own share.
TELLING_SHARE, TELLING_LIFT = 0.35, 1.8
SHARE = 0.25
#: Documents of each language that the classifier is fitted on, labelled ones and named ones each.
MAX_DOCS = 4_000

#: What parts the sentences and the words of a text once it is cut up.
SENTENCE, WORD = "\x1e", "\x1f"
_ENDS = frozenset(".!?۔؟।…。！？\n")
_TOKEN = re.compile(rf"[.!?۔؟।…][{re.escape(_CLOSING)}]*(?=\s)|[。！？\n]|{_WORD.pattern}")


def cut_up(text: str) -> str:
    """The distinct words of each sentence of a plain text, as one string; of ideographs the pairs of neighbours; no numbers."""
    out, words, before = [], {}, ""
    for token in _TOKEN.findall(text.lower()):
        ch = token[0]
        if ch in _ENDS:
            if words:
                out.append(WORD.join(words))
                words = {}
            before = ""
        elif "⺀" <= ch <= "鿿":
            if before:
                words[before + token] = None
            before = token
        else:
            before = ""
            if len(token) > 1 and not ch.isdigit():
                words[token] = None
    if words:
        out.append(WORD.join(words))
    return SENTENCE.join(out)


def sentences_of(cut: str) -> list[list[str]]:
    return [x.split(WORD) for x in cut.split(SENTENCE)] if cut else []


@dataclass
class Rules:
    """Codes of the telling words by language (the most frequent first); rules by their codes (sorted): confidence of each
    subject; calibration by tenth of evidence."""

    by_words: dict[tuple[int, ...], dict[str, float]] = field(default_factory=dict)
    telling: dict[str, dict[str, int]] = field(default_factory=dict)
    calibration: list[float] = field(default_factory=lambda: [i / 10 for i in range(11)])
    _by_last: dict[int, list] = field(default_factory=dict, repr=False)
    _memo: dict[tuple[int, ...], tuple] = field(default_factory=dict, repr=False)

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_by_last": {}, "_memo": {}}

    def known(self, sentence: list[str], lang: str | None) -> tuple[int, ...]:
        code = self.telling.get(lang or "")
        return tuple(sorted(code[w] for w in sentence if w in code)) if code else ()

    def evidence(self, got: tuple[int, ...]) -> tuple[str | None, float]:
        """Subject with most evidence and that evidence: noisy-or over all rules that match, as a share of all subjects'."""
        found = self._memo.get(got)
        if found is None:
            if len(self._memo) > 200_000:
                self._memo.clear()
            found = self._memo[got] = self._weigh(got)
        return found

    def _weigh(self, got: tuple[int, ...]) -> tuple[str | None, float]:
        if not self._by_last and self.by_words:
            for a in self.by_words:
                self._by_last.setdefault(a[-1], []).append(a)
        there = set(got)
        match = [a for w in got for a in self._by_last.get(w, ()) if len(a) == 1 or there.issuperset(a)]
        against: dict[str, float] = {}
        used: set[int] = set()
        for n in sorted({len(a) for a in match}, reverse=True):
            level = [a for a in match if len(a) == n and not used.issuperset(a)]
            for a in sorted(level):
                for c, p in self.by_words[a].items():
                    against[c] = against.get(c, 1.0) * (1 - min(p, 0.99))
            used.update(*level)  # a shorter rule counts only where no longer one holds its words
        if not against:
            return None, 0.0
        best = min(against, key=lambda c: (against[c], c))
        odds = {c: (1 - q) / max(q, 1e-9) for c, q in against.items()}
        return best, odds[best] / (sum(odds.values()) + 0.25)

    def subject(self, sentence: list[str], lang: str | None) -> str | None:
        c, e = self.evidence(self.known(sentence, lang))
        return c if c is not None and self.calibration[min(10, int(e * 10))] >= 0.5 else None


def _slices(it: Iterator[pa.RecordBatch], rows: int = 1_000) -> Iterator[pa.RecordBatch]:
    """Smaller batches, so that a worker holds the words of few documents at once."""
    for b in it:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def _label(rules: Rules, sents: list[list[str]], lang: str | None) -> str | None:
    """The subject of a document that the rules are sure of."""
    n = Counter(c for s in sents if (c := rules.subject(s, lang)))
    if not n:
        return None
    (c, k), total = n.most_common(1)[0], sum(n.values())
    return c if k >= 2 and k >= 0.6 * total else None


def named_by(docs: DataFrame, rules: Rules) -> DataFrame:
    """``text, lang, subject`` of the documents whose subject the rules are sure of."""
    shared = docs.sparkSession.sparkContext.broadcast(rules)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(it):
            found = [_label(shared.value, sentences_of(t), lang) for t, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            at = pa.array([i for i, c in enumerate(found) if c], pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array([c for c in found if c], pa.string())], names=["text", "lang", "subject"])

    return docs.select("text", "lang").mapInArrow(run, "text string, lang string, subject string")


def _word_counts(docs: DataFrame) -> DataFrame:
    """``lang, word, subject, n``: sentences that hold each word, by the subject of their document; the word '' has all sentences."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[tuple, Counter] = defaultdict(Counter)

        def flush() -> pa.RecordBatch:
            rows = [(lang, w, c, k) for (lang, c), words in n.items() for w, k in words.items()]
            n.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(list(zip(*rows)) or [()] * 4, (pa.string(), pa.string(), pa.string(), pa.int64()))], names=["lang", "word", "subject", "n"])

        for b in _slices(it):
            for text, lang, subject in zip(*(b.column(i).to_pylist() for i in range(3))):
                if text:
                    own = n[lang or "", subject]
                    own.update(text.replace(SENTENCE, WORD).split(WORD))
                    own[""] += text.count(SENTENCE) + 1
            if sum(map(len, n.values())) > 100_000:
                yield flush()
        yield flush()

    return docs.select("text", "lang", "subject").mapInArrow(run, "lang string, word string, subject string, n bigint").groupBy("lang", "word", "subject").agg(F.sum("n").alias("n"))


def _telling(counts: DataFrame) -> dict[str, dict[str, int]]:
    """Codes of the words that tell a subject; their number is at most the mean words of a sentence over MIN_SUPPORT."""
    counts = checkpoint(counts)
    sums = counts.where("word = ''")
    whole = sums.groupBy("lang").agg(F.sum("n").alias("whole"))
    prior = F.broadcast(sums.groupBy("lang").agg(F.map_from_entries(F.collect_list(F.struct("subject", "n"))).alias("prior")).join(whole, "lang"))  # a row a language
    total = sums.agg(F.sum("n")).first()[0]
    if not total:
        return {}
    floor = max(MIN_COUNT, math.ceil(MIN_SUPPORT * total))
    by = counts.where("word <> ''").groupBy("lang", "word").agg(F.sum("n").alias("all"), F.max(F.struct("n", "subject")).alias("top")).where(F.col("all") >= floor)
    by = by.join(prior, "lang").withColumn("share", F.col("prior")[F.col("top.subject")] / F.col("whole"))
    p = (F.col("top.n") + 2 * F.col("share")) / (F.col("all") + 2)
    told = by.where((p >= TELLING_SHARE) & (p / F.col("share") >= TELLING_LIFT)).select("lang", "word", "all").collect()
    out: dict[str, dict[str, int]] = defaultdict(dict)
    for code, r in enumerate(sorted(told, key=lambda r: (-r["all"], r.lang, r.word))):
        out[r.lang][r.word] = code
    return dict(out)


def _parts(docs: DataFrame, telling) -> DataFrame:
    """``item, before, subject, n``: for each word of each transaction the more frequent ones before it; equal ones combined."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([k[0][-1] for k in n], pa.int32()), pa.array([k[0][:-1] for k in n], pa.list_(pa.int32())), pa.array([k[1] for k in n], pa.string()), pa.array(list(n.values()), pa.int64())], names=["item", "before", "subject", "n"])
            n.clear()
            return out

        for b in _slices(it):
            for text, lang, subject in zip(*(b.column(i).to_pylist() for i in range(3))):
                for s in sentences_of(text):
                    got = telling.value.known(s, lang)
                    n.update((got[:j], subject) for j in range(1, len(got) + 1))
            if len(n) > 100_000:
                yield flush()
        yield flush()

    return docs.select("text", "lang", "subject").mapInArrow(run, "item int, before array<int>, subject string, n bigint").groupBy("item", "before", "subject").agg(F.sum("n").alias("n"))


def grow(item: int, rows: list[tuple[tuple[int, ...], str, int]], least: int) -> list[tuple[tuple[int, ...], str, int, int]]:
    """(words, subject, sentences of the subject, all sentences) of the patterns that end in ``item`` and tell a subject.

    ``rows`` are (words before, subject, sentences).
    """
    out = []
    todo = [((item,), rows)]
    while todo:
        pattern, held = todo.pop()
        by: Counter = Counter()
        for _, c, n in held:
            by[c] += n
        total = sum(by.values())
        often = [c for c, n in by.items() if n >= least]
        out += [(pattern, c, by[c], total) for c in often if by[c] >= MIN_CONFIDENCE * total]
        if all(_confidence(by[c], total) > 1 - GAIN for c in often):
            continue
        with_word: dict[int, Counter] = defaultdict(Counter)
        for before, c, n in held:
            for w in before:
                with_word[w][c] += n
        for w, n in with_word.items():
            if max(n.values()) >= least and sum(n.values()) < total:
                fewer: Counter = Counter()
                for before, c, k in held:
                    if w in before:
                        fewer[before[: before.index(w)], c] += k
                todo.append(((w, *pattern), [(a, c, k) for (a, c), k in fewer.items()]))
    return out


def _confidence(n: int, all_: int) -> float:
    return (n + 0.2) / (all_ + 1.0)


def patterns(parts: DataFrame, least: int) -> DataFrame:
    """``words, subject, n, all`` of all patterns, grown side by side for the words they end in."""

    def run(t: pa.Table) -> pa.Table:
        by: dict[int, list] = defaultdict(list)
        for item, before, c, n in zip(*(t.column(x).to_pylist() for x in ("item", "before", "subject", "n"))):
            by[item].append((tuple(before), c, n))
        got = [x for item, rows in by.items() for x in grow(item, rows, least)]
        return pa.table([pa.array(c, k) for c, k in zip(list(zip(*got)) or [()] * 4, (pa.list_(pa.int32()), pa.string(), pa.int64(), pa.int64()))], names=["words", "subject", "n", "all"])

    groups = 4 * int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return parts.withColumn("_g", F.pmod(F.xxhash64("item"), F.lit(groups))).groupBy("_g").applyInArrow(lambda t: run(t.drop_columns(["_g"])), "words array<int>, subject string, n bigint, all bigint")


def mine(docs: DataFrame) -> Rules:
    """Rules from the sentences of ``docs`` (text cut up, lang, subject; none null but lang)."""
    telling = _telling(_word_counts(docs))
    out = Rules(telling=telling)
    if not telling:
        return out
    parts = checkpoint(_parts(docs, docs.sparkSession.sparkContext.broadcast(out)))
    n = parts.where(F.size("before") == 0).agg(F.sum("n")).first()[0]  # every transaction has one first word
    if not n:
        return out
    raw: dict[tuple[int, ...], dict[str, float]] = {}
    for r in patterns(parts, max(MIN_COUNT, math.ceil(MIN_SUPPORT * n))).toLocalIterator():
        raw.setdefault(tuple(r.words), {})[r.subject] = _confidence(r.n, r["all"])
    out.by_words = pruned(raw)
    return out


def pruned(raw: dict[tuple[int, ...], dict[str, float]]) -> dict[tuple[int, ...], dict[str, float]]:
    """Rules surer by GAIN than every rule of a part of their words."""
    kept: dict[tuple[int, ...], dict[str, float]] = {}
    best: dict[tuple[int, ...], dict[str, float]] = {}  # the surest of a set of words and its parts
    for a in sorted(raw, key=len):
        parts: dict[str, float] = {}
        for x in combinations(a, len(a) - 1):
            for c, p in best.get(x, raw.get(x, {})).items():
                parts[c] = max(p, parts.get(c, 0.0))
        own = {c: p for c, p in raw[a].items() if parts.get(c, 0.0) < p - GAIN}
        if own:
            kept[a] = own
        best[a] = {c: max(parts.get(c, 0.0), raw[a].get(c, 0.0)) for c in parts.keys() | raw[a].keys()}
    return kept


def calibrate(rules: Rules, labelled: DataFrame) -> None:
    """Share of labelled sentences whose best subject is the document's, by tenth of evidence, made monotone.

    A document's label is the subject of most of its sentences only, so the shares are scaled to 1 at the top.
    """
    shared = labelled.sparkSession.sparkContext.broadcast(rules)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()
        for b in _slices(it):
            for text, lang, subject in zip(*(b.column(i).to_pylist() for i in range(3))):
                for s in sentences_of(text):
                    c, e = shared.value.evidence(shared.value.known(s, lang))
                    if c is not None:
                        n[min(10, int(e * 10)), c == subject] += 1
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in n], pa.int32()), pa.array([k[1] for k in n], pa.bool_()), pa.array(list(n.values()), pa.int64())], names=["bin", "hit", "n"])

    got: Counter = Counter()
    for r in labelled.select("text", "lang", "subject").mapInArrow(run, "bin int, hit boolean, n bigint").groupBy("bin", "hit").agg(F.sum("n").alias("n")).collect():
        got[r.bin, r.hit] = r.n
    shares, level = [], 0.0
    for i in range(11):
        hit, all_ = got[i, True], got[i, True] + got[i, False]
        level = max(level, (hit + 0.1 * i) / (all_ + 1))
        shares.append(level)
    top = max(shares)
    rules.calibration = [x / top for x in shares] if top else shares


def with_languages(documents: DataFrame) -> DataFrame:
    """``doc_id, text, lang``: the language found by the letters of each text, and the text cut up."""
    matrix = langid.train(documents, "text", "lang")
    shared = documents.sparkSession.sparkContext.broadcast(matrix)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(it):
            texts = [plain(t or "") for t in b.column(1).to_pylist()]
            langs = langid.named(langid.best(langid.shares(texts, shared.value))[0])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(map(cut_up, texts)), pa.string()), langs], names=["doc_id", "text", "lang"])

    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, text string, lang string")


def fitted_on(docs: DataFrame, max_docs: int) -> DataFrame:
    """At most about ``max_docs`` documents of each language: those whose hash lies under the language's threshold."""
    counts = {r.lang or "": r.n for r in docs.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return docs
    whole = 1 << 40
    under = F.create_map(*[x for lang, n in counts.items() for x in (F.lit(lang), F.lit(int(whole * min(1.0, max_docs / n))).cast("bigint"))])
    return docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(whole).cast("bigint")) < under[F.coalesce("lang", F.lit(""))])


def subject_rules(docs: DataFrame, labels: DataFrame, passes: int = 2, max_docs: int = MAX_DOCS) -> Rules:
    """Rules of the corpus ``docs`` (doc_id, text cut up, lang): first from labelled documents, then ``passes`` times from
    documents whose subject those name surely; at most ``max_docs`` of a language each.

    Repeated labels of a document count once; of different ones the most frequent, then the last by name.
    """
    one = labels.where(F.col("subject").isNotNull()).groupBy("doc_id", "subject").agg(F.countDistinct("annotator").alias("n")).groupBy("doc_id").agg(F.max(F.struct("n", "subject"))["subject"].alias("subject"))
    labelled = checkpoint(fitted_on(docs.join(one, "doc_id"), max_docs).select("text", "lang", "subject"))
    rules = mine(labelled)
    calibrate(rules, labelled)
    some = fitted_on(docs, max_docs)
    for _ in range(passes):
        again = mine(checkpoint(named_by(some, rules))) if rules.by_words else rules
        if not again.by_words:  # no document could be named
            break
        rules = again
        calibrate(rules, labelled)
    return rules


def found_subjects(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, subject``: each subject of at least SHARE of the sentences that speak of any.

    Null and blank texts, and texts no sentence of which a rule matches, have none; repeated documents count once.
    """
    docs = checkpoint(with_languages(documents.where(F.trim("text") != "")))
    shared = documents.sparkSession.sparkContext.broadcast(subject_rules(docs, labels))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(it):
            keys, out = [], []
            for k, text, lang in zip(*(b.column(i).to_pylist() for i in range(3))):
                n = Counter(c for s in sentences_of(text) if (c := shared.value.subject(s, lang)))
                total = sum(n.values())
                for c, x in n.items():
                    if x >= SHARE * total:
                        keys.append(k)
                        out.append(c)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(out, pa.string())], names=["doc_id", "subject"])

    return docs.mapInArrow(run, "doc_id bigint, subject string").distinct()
