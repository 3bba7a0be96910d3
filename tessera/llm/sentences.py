"""Sentence boundaries across languages and scripts.

Unsupervised, per language: the corpus is counted once (one row per language and word type), and log-likelihood ratios
over these counts tell

* abbreviations: types whose mark is followed by more text on the line more often than chance; types with inner marks
  that seldom come without their last one,
* collocations: a number, initial or dotted type and the word after its mark, no starter, that come together more often
  than the word comes elsewhere, and more often than it begins sentences,
* sentence starters: types that follow a certain sentence end more often than chance.

The ratios are computed side by side; only types that pass reach the driver, and a relative support bounds their number.  Each mark is
then classified with these statistics and its context: quotations and brackets, list numbers, decimals, ordinals,
ellipses, scripts without spaces, and scripts that part sentences by a space.
"""

from __future__ import annotations

import functools
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import langid
from tessera.llm.textcodes import INVISIBLE, plain
from tessera.session import checkpoint

# Marks that can end a sentence, by how sure they are; brackets and quotation marks.
PERIODS = ".۔．"
SURE = "!?؟।！？。｡॥"
ELLIPSIS = "…"
OPEN_TO_CLOSE = {"«": "»", "“": "”", "(": ")", "（": "）", "[": "]", "「": "」", "『": "』", "‹": "›", "{": "}"}
CLOSERS = frozenset("»”)）]」』›}\"'’")
BRACKETS = frozenset("(（[{")
_MARK = re.compile(r"[" + re.escape(PERIODS + SURE + ELLIPSIS) + r"]+")
_EVENT = re.compile(r"[" + re.escape(PERIODS + SURE + ELLIPSIS + "".join(OPEN_TO_CLOSE) + "".join(OPEN_TO_CLOSE.values()) + '"') + r"\n\r  ]|[฀-๿]\s+(?=\S)|\S\s+(?=[฀-๿])")
_WORD = re.compile(r"\S+")
_BREAK = re.compile("[\n\r\u2028\u2029]")
_STRIP = "«“(（[「『‹{\"'‘»”)）]」』›}’,،؛;:"
_NUMBER = re.compile(r"^[\d٠-٩۰-۹]+(?:[.,٫۔][\d٠-٩۰-۹]+)*$")
#: Characters of tokens that tell more than a word.
_SPECIAL = frozenset(PERIODS + SURE + ELLIPSIS + '"').union(OPEN_TO_CLOSE, OPEN_TO_CLOSE.values())
_CLOSING = "".join(CLOSERS)
MIN_COUNT, MIN_STARTS = 2, 3
#: Significance that the ratios of collocations and starters must pass (0.5 % for one degree of freedom), and the scores of abbreviations.
SIGNIFICANT, INSIDE_SCORE, DOTTED_SCORE = 7.88, 5.0, 0.3
#: Share of the marks (or of the sentence beginnings) of its language that a learned type has at least; so at most 1 / SUPPORT types of a kind are kept.
SUPPORT = 1e-5
#: Parts the two types of a pair.
PAIR = "\x1f"


@functools.lru_cache(1 << 17)
def word_type(token: str) -> str:
    """A token without quotation marks and its final mark, in lower case; numbers are one type."""
    t = token.strip(_STRIP).rstrip(PERIODS).strip(_STRIP).lower()
    return "##" if _NUMBER.match(t) else t


@dataclass
class Model:
    """Learned types by language: abbreviations, sentence starters, and collocations (pairs joined by PAIR)."""

    abbreviations: dict[str, frozenset[str]] = field(default_factory=dict)
    starters: dict[str, frozenset[str]] = field(default_factory=dict)
    collocations: dict[str, frozenset[str]] = field(default_factory=dict)
    _of: dict[str, tuple] = field(default_factory=dict, repr=False)

    def of(self, lang: str) -> tuple[frozenset[str], frozenset[str], frozenset[str]]:
        """The three kinds for a language, or for the languages of a mix."""
        got = self._of.get(lang)
        if got is None:
            got = self._of[lang] = tuple(frozenset().union(*(kind.get(x, ()) for x in lang.split("+"))) for kind in (self.abbreviations, self.starters, self.collocations))
        return got


#: Kinds of counts: w word, p with a period inside a line, e with one at its end, s after a sure end, c before lower case or a number, f first of a pair, k pair.
KINDS = "wpescfk"


def count_text(text: str, into: dict[str, Counter]) -> None:
    """Adds the counts of one text by kind."""
    starts = into["s"]
    for line in text.splitlines():
        tokens = line.split()
        kinds = list(map(word_type, tokens))
        into["w"].update(filter(None, kinds))
        sure = False
        depth = 0  # marks inside a quotation or bracket tell nothing of the sentence around it
        for i, (tok, kind) in enumerate(zip(tokens, kinds)):
            if _SPECIAL.isdisjoint(tok):
                if kind:
                    if sure and not depth:
                        starts[kind] += 1
                    sure = False
                continue
            quotes = tok.count('"')
            depth += sum(map(tok.count, OPEN_TO_CLOSE)) + (quotes if not depth else 0)
            quoted = depth > 0
            depth = max(0, depth - sum(map(tok.count, OPEN_TO_CLOSE.values())) - (quotes if quotes == 2 or depth and tok[:1] != '"' else 0))
            if not kind:
                continue
            if quoted:
                sure = False
                continue
            if sure:
                starts[kind] += 1
            bare = tok.rstrip(_CLOSING)
            sure = bool(bare) and bare[-1] in SURE and not kind[:1].isdigit()
            if not bare or bare[-1] not in PERIODS or bare.endswith(("..", "…")):
                continue
            if i + 1 == len(tokens):
                if kind != "##":
                    into["e"][kind] += 1
                continue
            if kinds[i + 1] and tokens[i + 1][0].isalnum() and (kind == "##" or "." in kind or len(kind) == 1):
                into["f"][kind] += 1
                into["k"][kind + PAIR + kinds[i + 1]] += 1
            if kind != "##":
                into["p"][kind] += 1
                nxt = tokens[i + 1].lstrip(_STRIP)[:1]
                if nxt.isdigit() or nxt.islower():
                    into["c"][kind] += 1


def _count_batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    into: dict[str, dict[str, Counter]] = defaultdict(lambda: defaultdict(Counter))

    def flush() -> pa.RecordBatch:
        rows = [(lang, kind, word, n) for lang, kinds in into.items() for kind, words in kinds.items() for word, n in words.items()]
        into.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 4, (pa.string(), pa.string(), pa.string(), pa.int64()))], names=["lang", "kind", "word", "n"])

    for b in it:
        for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if text:
                count_text(plain(text), into[(lang or "").split("+")[0]])
        if sum(len(words) for kinds in into.values() for words in kinds.values()) > 200_000:
            yield flush()
    yield flush()


def _ratio(k1: np.ndarray, n1: np.ndarray, k2: np.ndarray, n2: np.ndarray) -> np.ndarray:
    """Log-likelihood ratios that k1 of n1 and k2 of n2 have one rate; signed: positive where the first rate is higher; 0 without rows."""
    with np.errstate(all="ignore"):

        def ll(k: np.ndarray, n: np.ndarray, p: np.ndarray) -> np.ndarray:
            return np.where(k > 0, k * np.log(p), 0.0) + np.where(n - k > 0, (n - k) * np.log1p(-p), 0.0)

        p, p1, p2 = (k1 + k2) / (n1 + n2), k1 / n1, k2 / n2
        value = 2 * (ll(k1, n1, p1) + ll(k2, n2, p2) - ll(k1, n1, p) - ll(k2, n2, p))
        return np.where((n1 <= 0) | (n2 <= 0) | (p <= 0) | (p >= 1), 0.0, np.where(p1 > p2, value, -value))


def _telling_types(words: list[str], n: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Which word types are abbreviations, and which are starters; ``n`` has their counts and those of their language (all_*)."""
    letters = np.array([sum(map(str.isalpha, w)) for w in words], float)
    dots = np.array([w.count(".") for w in words], float)
    marked, marks, all_words = n["p"] + n["e"], n["all_p"] + n["all_e"], n["all_w"]
    inside = _ratio(n["p"], marked, n["all_p"] - n["p"], marks - marked)
    with_mark = _ratio(marked, n["w"], marks - marked, all_words - n["w"])
    follow = n["c"] / np.maximum(n["p"], 1)
    # The mark stays inside a line more often than those of other words, the word seldom comes without it, and what
    # follows is often a number or lower case.
    score = inside * np.exp(-np.maximum(0, letters - 2) / 3) + np.where(follow > 0.5, 10 * follow, 0.0)
    plain_one = (n["p"] >= np.maximum(MIN_COUNT, SUPPORT * n["all_p"])) & (score > INSIDE_SCORE) & (n["p"] > 0.9 * marked)
    dotted = (dots > 0) & (marked >= np.maximum(1, SUPPORT * marks)) & (with_mark * np.exp(-letters) * (dots + 1) > DOTTED_SCORE)
    one_type = np.array([PAIR not in w for w in words], bool)
    abbreviation = one_type & (marked > 0) & (letters > 0) & (with_mark > 0) & (marked >= 0.5 * n["w"]) & (plain_one | dotted)
    begins = _ratio(n["s"], n["all_s"], n["w"] - n["s"], np.maximum(1, all_words - n["all_s"]))
    starter = (n["s"] >= np.maximum(MIN_STARTS, SUPPORT * n["all_s"])) & np.array([w != "##" for w in words], bool) & (begins > SIGNIFICANT)
    return abbreviation, starter


def _held_pairs(words: list[str], n: dict[str, np.ndarray]) -> tuple[np.ndarray]:
    """Which pairs hold together: more than the second word, which is no starter, comes elsewhere, and than it begins sentences."""
    starts = _ratio(n["sb"], n["all_s"], n["wb"] - n["sb"], np.maximum(1, n["all_w"] - n["all_s"]))
    elsewhere = _ratio(n["k"], n["fa"], n["wb"] - n["k"], n["all_w"] - n["fa"])
    beginning = _ratio(n["k"], n["fa"], n["sb"], n["all_s"])
    return ((n["k"] >= np.maximum(MIN_COUNT, SUPPORT * n["all_f"])) & (elsewhere > SIGNIFICANT) & (beginning > SIGNIFICANT) & (starts <= SIGNIFICANT),)


def _passing(rows: DataFrame, rule, kinds: str) -> DataFrame:
    """``kind, lang, word`` of the rows (lang, word, counts) that pass each part of a rule."""
    names = rows.columns[2:]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            if not b.num_rows:
                continue
            counts = {c: b.column(2 + i).to_numpy(zero_copy_only=False).astype(float) for i, c in enumerate(names)}
            for kind, hit in zip(kinds, rule(b.column(1).to_pylist(), counts)):
                at = pa.array(np.flatnonzero(hit), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([kind] * len(at), pa.string()), b.column(0).take(at), b.column(1).take(at)], names=["kind", "lang", "word"])

    return rows.mapInArrow(run, "kind string, lang string, word string")


def train(texts: DataFrame, text: str, lang: str) -> Model:
    """Model from the counts over every row of ``texts``; the corpus is read and counted once.

    Only the types that pass the thresholds reach the driver: at most 1 / SUPPORT of each kind in a language.
    """
    rows = texts.select(F.col(text).alias("t"), F.col(lang).alias("l")).mapInArrow(_count_batches, "lang string, kind string, word string, n bigint")
    counts = checkpoint(rows.groupBy("lang", "word").agg(*[F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).alias(k) for k in KINDS]))
    totals = F.broadcast(counts.groupBy("lang").agg(*[F.sum(k).alias(f"all_{k}") for k in KINDS]))  # a row a language
    n = F.col
    types = counts.where((n("p") + n("e") > 0) | (n("s") >= MIN_STARTS)).join(totals, "lang").select("lang", "word", *KINDS, *[f"all_{k}" for k in KINDS])

    pairs = counts.where(n("k") >= MIN_COUNT).select("lang", F.substring_index("word", PAIR, 1).alias("a"), F.substring_index("word", PAIR, -1).alias("b"), "word", "k")
    first = counts.where(n("f") > 0).select("lang", n("word").alias("a"), n("f").alias("fa"))
    second = counts.where(n("w") > 0).select("lang", n("word").alias("b"), n("w").alias("wb"), n("s").alias("sb"))
    held = pairs.join(first, ["lang", "a"]).join(second, ["lang", "b"]).join(totals, "lang").select("lang", "word", "k", "fa", "wb", "sb", "all_w", "all_s", "all_f")

    found: dict[str, dict[str, set]] = {k: defaultdict(set) for k in "ask"}
    for r in _passing(types, _telling_types, "as").unionByName(_passing(held, _held_pairs, "k")).collect():
        found[r.kind][r.lang].add(r.word)
    return Model(*({lang: frozenset(x) for lang, x in found[k].items()} for k in "ask"))


def _is_thai(ch: str) -> bool:
    return "฀" <= ch <= "๿"


def split(text: str, lang: str, model: Model) -> list[tuple[int, int]]:
    """Sentences of a stored text as (start, end) in code points; white space around them is outside.

    Null, empty and blank texts have none.  Invisible characters count as part of the sentence they stand in.
    """
    if not text or not text.strip():
        return []
    if text.isascii():
        t, where = text, None
    else:
        keep = [i for i, ch in enumerate(text) if ord(ch) not in INVISIBLE]
        where = keep if len(keep) < len(text) else None
        t = "".join(text[i] for i in keep) if where is not None else text
    abbr, starters, pairs = model.of(lang)
    last_quote = t.rfind('"', 0, _line_end(t, 0))
    out: list[int] = []
    n = len(t)
    start = 0
    stack: list[tuple[str, int]] = []
    pos = 0
    while pos < n:
        m = _EVENT.search(t, pos)
        if m is None:
            break
        i = m.start()
        ch = t[i]
        if ch in "\n\r  ":
            if t[start:i].strip():
                out.append(i)
            start, pos = i + 1, i + 1
            last_quote = t.rfind('"', pos, _line_end(t, pos))
            stack.clear()
            continue
        if m.end() - i > 1 and (_is_thai(ch) or (m.end() < n and _is_thai(t[m.end()]))) and t[i + 1].isspace():
            # A script that parts sentences by a space; numbers belong to the clause around them.
            a, b = ch, t[m.end()]
            gap = t[i + 1 : m.end()]
            if "\n" in gap or "\r" in gap:
                pos = i + 1
                continue
            if not stack and not a.isdigit() and not b.isdigit() and (_is_thai(a) or a.isalnum() or a in PERIODS + SURE) and (_is_thai(b) or b.isalnum()):
                out.append(i + 1)
                start = m.end()
            pos = i + 1 if ch not in PERIODS + SURE + ELLIPSIS else m.end()
            continue
        if m.end() - i > 1 and ch not in PERIODS + SURE + ELLIPSIS and ch not in OPEN_TO_CLOSE and ch not in CLOSERS:
            pos = i + 1
            continue
        if ch in OPEN_TO_CLOSE:
            stack.append((OPEN_TO_CLOSE[ch], i))
            pos = i + 1
            continue
        if ch == '"' and not (stack and stack[-1][0] == '"'):
            if i == 0 or not t[i - 1].isalnum() or last_quote > i:
                stack.append(('"', i))
            pos = i + 1
            continue
        if ch in CLOSERS:
            pos = i + 1
            at = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == ch), None)
            if at is None:
                continue
            opened = stack[at][1]
            del stack[at:]
            if stack:
                continue
            inner = t[opened + 1 : i].rstrip()
            if not inner or inner[-1] not in PERIODS + SURE + ELLIPSIS:
                continue
            nxt = _next(t, i + 1)
            led = not t[start:opened].strip()  # nothing of the sentence stands before it
            if nxt is None:
                continue
            if t[opened] in BRACKETS:
                done = led or (t[nxt].isupper() and nxt > i + 1 and word_type(inner.split()[-1] if inner.split() else "") not in abbr)
                if not led and t[nxt] in PERIODS + SURE + ",،":
                    done = False
            elif led:
                done = t[nxt].isupper() or t[nxt] in OPEN_TO_CLOSE and t[nxt] not in BRACKETS
            else:
                done = not t[nxt].islower() and t[nxt] not in PERIODS + SURE + ",،，;:؛"
            if done and (nxt > i + 1 or _dense(t[i - 1]) or _dense(t[nxt])):
                out.append(i + 1)
                start = nxt
            continue
        # A mark, or a run of them.
        run = _MARK.match(t, i).end()
        end = run
        while end < n and t[end] in CLOSERS and not (t[end] == '"' and not (stack and stack[-1][0] == '"')) and not any(t[end] == x for x, _ in stack):
            end += 1
        pos = run
        if stack:
            continue
        nxt = _next(t, end)
        if nxt is None:  # the line or the text ends here
            pos = end
            continue
        spaced = nxt > end
        last = t[run - 1]
        after = _WORD.match(t, nxt)[0]
        if ELLIPSIS in t[i:run] or (run - i >= 2 and set(t[i:run]) <= set(PERIODS)):
            done = spaced and (t[nxt].isupper() or (not t[nxt].islower() and word_type(after) in starters and not _dense(t[nxt])))
            if t[nxt] in OPEN_TO_CLOSE:
                done = spaced
        elif last in SURE or t[i] in SURE:
            done = spaced or _dense(last) or t[nxt].isalpha() or t[nxt] in OPEN_TO_CLOSE
        else:
            at = i  # the token before the mark
            while at > start and not t[at - 1].isspace():
                at -= 1
            first = start  # where the words of the sentence begin
            while first < at and (t[first].isspace() or t[first] in _STRIP):
                first += 1
            done = _period(t, i, nxt, spaced, t[at:i], after, first >= at, abbr, starters, pairs)
        if done:
            out.append(end)
            start = nxt
            pos = max(pos, end)
    tail = len(t.rstrip())
    if t[start:].strip():
        out.append(tail)
    spans: list[tuple[int, int]] = []
    prev = 0
    for e in out:
        while e > prev and t[e - 1].isspace():
            e -= 1
        b = prev
        while b < e and t[b].isspace():
            b += 1
        if e > b:
            spans.append((b, e))
            prev = e
    if where is None:
        return spans
    hidden = len(text)
    out2 = []
    for b, e in spans:
        stop = where[e - 1] + 1
        while stop < hidden and ord(text[stop]) in INVISIBLE and not (e < len(t) and not t[e].isspace()):
            stop += 1
        out2.append((where[b], stop))
    return out2


def _next(t: str, i: int) -> int | None:
    """The next character that is no white space on the same line."""
    n = len(t)
    while i < n:
        if t[i] in "\n\r  ":
            return None
        if not t[i].isspace():
            return i
        i += 1
    return None


def _dense(ch: str) -> bool:
    """Characters of scripts and marks that take no space after a sentence."""
    return "⺀" <= ch <= "鿿" or "＀" <= ch <= "｠" or "぀" <= ch <= "ヿ"


def _line_end(t: str, i: int) -> int:
    m = _BREAK.search(t, i)
    return m.start() if m else len(t)


def _period(t: str, i: int, nxt: int, spaced: bool, token: str, after: str, leads: bool, abbr: frozenset, starters: frozenset, pairs: frozenset) -> bool:
    """Whether a period ends the sentence; ``leads``: its token is the first of it."""
    kind = word_type(token)
    head = after.lstrip(_STRIP)[:1] or after[:1]
    if not spaced:
        if not token or t[nxt].isdigit() or kind == "##" or not t[nxt].isalpha():
            return bool(token) and t[nxt] in "«“\"(" and not kind in abbr
        if t[nxt].isascii() and t[nxt].isalpha():
            # A missing space: lower case before, a capitalized word after, no abbreviation or address.
            rest = after[1:2]
            return t[i - 1].islower() and t[nxt].isupper() and (rest.islower() or not rest) and kind not in abbr and "." not in after.rstrip(PERIODS) and "/" not in after and "@" not in token
        return t[i - 1].isalpha() and kind not in abbr and "." not in kind and not _is_thai(t[i - 1]) and len(kind) > 1
    if kind == "##" and leads:
        return False  # a list number
    if token and after[0].isalnum() and kind + PAIR + word_type(after) in pairs:
        return False
    if kind == "##":
        return not head.islower()  # else an ordinal
    if not token:
        return True
    if kind in abbr:
        if head.isdigit():
            return False
        if "." in kind or "." in token:  # times of day and the like may also end a sentence
            return word_type(after) in starters and not head.islower() and len(kind.replace(".", "")) <= 4 and not _initials(token)
        return False
    if _initials(token) and head.isupper():
        return False
    return not head.islower()


def _initials(token: str) -> bool:
    parts = [x for x in token.strip(_STRIP).split(".") if x]
    return bool(parts) and all(len(x) == 1 and x.isupper() for x in parts)


#: A second language with this share of a text's letters adds its statistics.
SECOND_SHARE = 0.1


def with_language(segments: DataFrame, key: str, text: str, matrix: np.ndarray, *more: str) -> DataFrame:
    """``key, _text, lang`` and ``more``; one row per key (copies agree); ``lang`` names two languages joined by + in a mix."""
    one = segments.select(key, text, *more).dropDuplicates([key]).withColumn("_text", F.col(text))
    lang = F.when(F.col("second_share") >= SECOND_SHARE, F.concat_ws("+", "lang", "second_lang")).otherwise(F.col("lang"))
    return langid.detect(one, key, text, matrix, "_text", *more).select(key, "_text", lang.alias("lang"), *more)


def sentences(tagged: DataFrame, key: str, model: Model) -> DataFrame:
    """``key, sentence_no, start_pos, end_pos`` of every sentence of ``tagged`` (``key, _text, lang``).

    Null, empty and blank texts give no row.
    """
    shared = tagged.sparkSession.sparkContext.broadcast(model)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            keys, no, starts, ends = [], [], [], []
            for k, t, lang in zip(*(b.column(i).to_pylist() for i in range(3))):
                for j, (s, e) in enumerate(split(t or "", lang or "", shared.value)):
                    keys.append(k)
                    no.append(j)
                    starts.append(s)
                    ends.append(e)
            yield pa.RecordBatch.from_arrays([pa.array(keys, b.schema.field(0).type), *[pa.array(x, pa.int32()) for x in (no, starts, ends)]], names=[key, "sentence_no", "start_pos", "end_pos"])

    src = tagged.select(key, "_text", "lang")
    return src.mapInArrow(run, f"`{key}` {src.schema[key].dataType.simpleString()}, sentence_no int, start_pos int, end_pos int")
