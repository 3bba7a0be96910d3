"""Text expressions: column expressions where Spark has the parts, pandas UDFs for Unicode forms and alignments."""

from __future__ import annotations

import difflib
import functools
import re
import unicodedata
from collections import Counter
from decimal import ROUND_HALF_EVEN, Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Marks dropped, letters folded and punctuation blanked before texts are matched.
MATCH_MARKS = r"[ؐ-ًؚ-ٰٟۖ-ۭࣔ-ࣣ࣡-ࣿ]"
MARKS = r"[ؐ-ًؚ-ٰٟۖ-ۭ]"
TATWEEL = "ـ"
MATCH_LETTERS = {"ٱ": "ا", "آ": "ا", "أ": "ا", "إ": "ا", "ة": "ه", "ی": "ي", "ک": "ك"}
MATCH_PUNCTUATION = ".,!?;:\"'()[]{}«»،؛؟۔"
EQUIVALENT = {"ی": "ي", "ک": "ك", "ٱ": "ا", "ـ": ""}
RELAXED = EQUIVALENT | {"ى": "ي", "أ": "ا", "إ": "ا", "ء": "", "ؤ": "و", "ئ": "ي", "ہ": "ه"}
PROFILES = {  # name: drop marks, letter rules, part punctuation from words
    "with_diacritics": (False, {}, False), "without_diacritics": (True, {}, False),
    "equivalent_with_diacritics": (False, EQUIVALENT, False), "equivalent_without_diacritics": (True, EQUIVALENT, False),
    "relaxed_with_diacritics": (False, RELAXED, True), "relaxed_without_diacritics": (True, RELAXED, True),
}
USAGE = {"quotation": "Quotation", "translation": "Translation", "paraphrase": "Paraphrase", "explicit paraphrase": "Paraphrase"}
EXTENT = {"complete": "CompleteCitation", "partial": "PartialCitation"}
COLLECTION_ALIASES = {"AD": "SD", "IBNMAJAH": "IM", "TIRMIDHI": "JT", "BUKHARI": "SB", "MUSLIM": "SM", "NASAI": "SN", "ABUDAWUD": "SD"}
COLLECTIONS = ("SB", "JT", "SM", "IM", "SD", "SN")
CHAR_RATIO, WORD_RATIO = (0.90, 1.10), (1.00, 1.15)

#: White space as Unicode has it; Java's own \s is ASCII.
SPACE = r"(?U)\s+"


def _udf(kind: str):
    """A pandas UDF made at its first use, so that the module needs no session to be imported."""

    def wrap(fn):
        @functools.cache
        def made():
            return F.pandas_udf(fn, kind)

        return functools.wraps(fn)(lambda *cols: made()(*cols))

    return wrap


@_udf("string")
def nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else t if t.isascii() else unicodedata.normalize("NFKC", t))


def squeeze(c: Column) -> Column:
    """White space collapsed to single spaces, none at the ends."""
    return F.trim(F.regexp_replace(c, SPACE, " "))


def for_matching(text: Column) -> Column:
    """Form that texts are matched in: compatibility form, no marks, folded letters, no punctuation; '' for null."""
    bare = F.regexp_replace(F.regexp_replace(nfkc(F.coalesce(text, F.lit(""))), MATCH_MARKS, ""), TATWEEL, "")
    folded = F.translate(bare, "".join(MATCH_LETTERS), "".join(MATCH_LETTERS.values()))
    return squeeze(F.translate(folded, MATCH_PUNCTUATION, " " * len(MATCH_PUNCTUATION)))


def latin_form(text: Column) -> Column:
    """Lower-case ASCII letters and digits, single spaces; '' for null."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9 ]", " "), " +", " "))


def strip_marks(text: Column) -> Column:
    return F.regexp_replace(text, MARKS, "")


def words(text: Column) -> Column:
    """Array of words parted by any white space; empty for null and blank."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def edit_score(a: Column, b: Column) -> Column:
    """1 - distance / longer length; 1 where both are empty."""
    n = F.greatest(F.char_length(a), F.char_length(b))
    return F.when(n == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / n)


def token_f1(a: Column, b: Column) -> Column:
    """F1 of two arrays as multisets; 1 where both are empty, 0 where one is."""
    count = lambda xs, x: F.size(F.filter(xs, lambda y: y == x))
    both = F.aggregate(F.array_distinct(a), F.lit(0), lambda n, x: n + F.least(count(a, x), count(b, x)))
    total = F.size(a) + F.size(b)
    return F.when(total == 0, 1.0).otherwise(2 * both / total)


def correction_accepted(original: Column, corrected: Column) -> Column:
    """Whether a correction keeps within the character and word ratios; an empty original counts as one unit."""
    chars = F.char_length(strip_marks(corrected)) / F.greatest(F.char_length(strip_marks(original)), F.lit(1))
    n = F.size(words(corrected)) / F.greatest(F.size(words(original)), F.lit(1))
    return (squeeze(corrected) != "") & chars.between(*CHAR_RATIO) & n.between(*WORD_RATIO)


def slug(text: Column) -> Column:
    """Runs of other than letters and digits as one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(text, r"[^\p{L}\p{N}]+", "_"), "^_+|_+$", "")


def iri_part(text: Column) -> Column:
    return F.regexp_replace(text, "[^A-Za-z0-9_.-]", "_")


def verse_key(sura: Column, aya: Column) -> Column:
    """CHsss_Vvvv of two numbers in text; null where one is no single number."""
    s, a = F.expr(f"try_cast({_sql(sura)} as int)"), F.expr(f"try_cast({_sql(aya)} as int)")
    return F.when(s.isNotNull() & a.isNotNull(), F.format_string("CH%03d_V%03d", s, a))


def _sql(c: Column) -> str:
    return c._jc.toString() if hasattr(c, "_jc") else str(c)


def verse_key_of(sura: str, aya: str) -> Column:
    """``verse_key`` of two named columns."""
    s, a = F.col(sura).try_cast("int"), F.col(aya).try_cast("int")
    return F.when(s.isNotNull() & a.isNotNull(), F.format_string("CH%03d_V%03d", s, a))


def verse_numbers(aya: Column) -> Column:
    """Array of the numbers that '3' or '3-5' stands for; empty where it is neither or runs backwards."""
    lo = F.try_to_number(F.regexp_extract(aya, r"^\s*(\d+)", 1), F.lit("999999")).cast("int")
    hi = F.try_to_number(F.regexp_extract(aya, r"^\s*\d+\s*-\s*(\d+)\s*$", 1), F.lit("999999")).cast("int")
    single = F.regexp_like(aya, F.lit(r"^\s*\d+\s*$"))
    none = F.array().cast("array<int>")
    return F.when(single, F.array(lo)).when(hi >= lo, F.sequence(lo, hi)).otherwise(none)


def seconds_of(clock: Column) -> Column:
    """Seconds of 'MM:SS' or 'H:MM:SS'; null where the text is neither."""
    p = F.split(clock, ":")
    n = lambda i: F.try_element_at(p, F.lit(i)).cast("int")
    ok = F.regexp_like(clock, F.lit(r"^\d+:\d{1,2}(:\d{1,2})?$"))
    return F.when(ok & (F.size(p) == 2), n(1) * 60 + n(2)).when(ok, n(1) * 3600 + n(2) * 60 + n(3))


def collection_id(reference: Column) -> Column:
    """Prefix_0000 of a reference such as 'AD_12', aliases resolved; null where the collection is unknown."""
    prefix = F.regexp_extract(reference, r"^([A-Za-z]+)_(\d+)$", 1)
    number = F.regexp_extract(reference, r"^([A-Za-z]+)_(\d+)$", 2)
    alias = F.create_map(*[F.lit(x) for kv in COLLECTION_ALIASES.items() for x in kv])
    name = F.coalesce(F.try_element_at(alias, F.upper(prefix)), F.upper(prefix))
    return F.when(name.isin(*COLLECTIONS), F.concat(name, F.lit("_"), F.lpad(number, 4, "0")))


def controlled(value: Column, names: dict[str, str]) -> Column:
    """Name of a controlled value, whatever its case and spacing; null where it is none."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), F.lower(F.trim(value)))


def recording_name(source: Column) -> Column:
    """Name of a recording from its file or address: the last part without its extension, other than letters, digits, dots and dashes
    as underscores; 'recording' where nothing remains."""
    remote = source.rlike("(?i)^https?://")
    path = F.when(remote, F.try_url_decode(F.regexp_replace(F.regexp_replace(source, r"(?i)^https?://[^/]*|[?#].*$", ""), r"\+", "%2B"))).otherwise(source)
    stem = F.regexp_replace(F.regexp_extract(path, "([^/]*)/*$", 1), r"(?<=[^.])\.[^.]*$", "")
    bare = F.regexp_replace(F.regexp_replace(stem, r"(?U)[^\w.-]+", "_"), "^[._]+|[._]+$", "")
    return F.coalesce(F.nullif(bare, F.lit("")), F.lit("recording"))


def checked(value: Column, names: dict[str, str]) -> Column:
    """Name of a controlled value as ``controlled`` gives it; a value that isn't null and isn't known raises an error."""
    name = controlled(value, names)
    return F.when(value.isNotNull() & name.isNull(), F.raise_error(F.concat(F.lit("unknown value: "), value)).cast("string")).otherwise(name)


def local_name(iri: Column) -> Column:
    return F.regexp_extract(iri, "[^#/]*$", 0)


def json_reply(text: Column) -> Column:
    """The JSON object of a model's reply: as it is, else without thinking, code fence, or what is around the braces."""
    plain = F.regexp_replace(text, r"(?s)<think>.*?</think>", "")
    fenced = F.regexp_extract(plain, r"(?s)```(?:json)?\s*(.*?)```", 1)
    braced = F.regexp_extract(plain, r"(?s)\{.*\}", 0)
    valid = lambda c: F.when(F.try_parse_json(F.nullif(F.trim(c), F.lit(""))).isNotNull(), F.trim(c))
    return F.coalesce(valid(text), valid(plain), valid(fenced), valid(braced))


def script_counts(text: Column) -> dict[str, Column]:
    """Letters of the scripts told apart."""
    n = lambda p: F.regexp_count(F.coalesce(text, F.lit("")), F.lit(p))
    return {"arabic": n(r"[ؠ-يٮ-ۓەۺ-ۼ]"), "devanagari": n(r"[ऄ-ह]"), "latin": n("[A-Za-z]")}


def dominant_script(text: Column) -> Column:
    """Script of most letters; a tie with Latin goes to the other, other ties to the first by name; null without any."""
    n = script_counts(text)
    best = F.array_max(F.array(F.struct(n["arabic"].alias("n"), F.lit(2).alias("o"), F.lit("arabic").alias("s")), F.struct(n["devanagari"].alias("n"), F.lit(1).alias("o"), F.lit("devanagari").alias("s")), F.struct(n["latin"].alias("n"), F.lit(0).alias("o"), F.lit("latin").alias("s"))))
    return F.when(best["n"] > 0, best["s"])


@_udf("double")
def half_even(x: pd.Series, digits: pd.Series) -> pd.Series:
    """Rounding of the exact binary value, ties to even, as Python's round has it."""
    return pd.Series([None if v != v or v is None else float(Decimal(v).quantize(Decimal(1).scaleb(-int(d)), ROUND_HALF_EVEN)) for v, d in zip(x, digits)])


@_udf("double")
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratio of matching blocks of two texts in lower case; it depends on the order of the two."""
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x.lower(), y.lower()).ratio() for x, y in zip(a, b)])


def is_arabic_mark(ch: str) -> bool:
    return unicodedata.category(ch)[0] == "M" and "ARABIC" in unicodedata.name(ch, "")


#: Blocks of presentation forms, whose letters are brought to their plain ones.
FORMS = (*range(0xFB50, 0xFE00), *range(0xFE70, 0xFEFD))


@functools.cache
def profile_tables(profile: str) -> tuple[dict[int, str], dict[int, None]]:
    """What letters become in a profile, and the marks it drops."""
    drop, rules, _ = PROFILES[profile]
    letters = {c: unicodedata.normalize("NFKC", chr(c)) for c in FORMS if unicodedata.normalize("NFKC", chr(c)) != chr(c)} if rules else {}
    folded = {c: "".join(rules.get(x, x) for x in unicodedata.normalize("NFC", t)) for c, t in letters.items()}
    marks = dict.fromkeys(c for c in range(0x600, 0x1EF00) if is_arabic_mark(chr(c))) if drop else {}
    return {ord(k): v for k, v in rules.items()} | folded, marks


_PUNCTUATED = re.compile(r"(?<=\S)([۔،؟!.,?])")


def _in_profile(text: str, profile: str) -> str:
    letters, marks = profile_tables(profile)
    t = unicodedata.normalize("NFC", text)
    if letters:
        t = unicodedata.normalize("NFC", t.translate(letters))
    if PROFILES[profile][2]:
        t = _PUNCTUATED.sub(r" \1", t)
    return " ".join((t.translate(marks) if marks else t).split())


def in_profile(text: Column, profile: str) -> Column:
    """A text in one of the evaluation profiles."""
    return F.pandas_udf(lambda s: s.map(lambda t: None if t is None else _in_profile(t, profile)), "string")(text)


def as_letters(a: list, b: list) -> tuple[str, str]:
    """Two lists as strings with one letter for each distinct item, so that distances of strings are those of the lists."""
    number: dict = {}
    code = lambda x: (k := number.setdefault(x, len(number)) + 0x20) + (0x800 if k >= 0xD800 else 0)
    return "".join(chr(code(x)) for x in a), "".join(chr(code(x)) for x in b)


def middles(a: str, b: str) -> tuple[str, str]:
    """Two strings without what both begin and end with; their distance stays the same."""
    if a == b:
        return "", ""
    lead = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    a, b = a[lead:], b[lead:]
    tail = next((i for i, (x, y) in enumerate(zip(a[::-1], b[::-1])) if x != y), min(len(a), len(b)))
    return (a[: len(a) - tail], b[: len(b) - tail])


def in_profiles(ref: Column, hyp: Column, profiles: tuple[str, ...] = tuple(PROFILES)) -> Column:
    """Array of what has to be compared of both texts, ``ref, hyp``, with the profiles and units that it is the same for, and the
    number of units of the first text in each; null for empty.

    Units are characters (cer) and words (wer, a letter for each); common ends are cut off.
    """

    def run(refs: pd.Series, hyps: pd.Series) -> pd.Series:
        out = []
        for r, h in zip(refs, hyps):
            same: dict[tuple[str, str], list[dict]] = {}
            forms: dict[tuple[str, str], tuple] = {}
            for profile in profiles:
                a, b = _in_profile(r or "", profile), _in_profile(h or "", profile)
                if (a, b) not in forms:
                    ws = a.split()
                    forms[a, b] = (middles(a, b), middles(*as_letters(ws, b.split())), len(a), len(ws))
                chars, words_, n, m = forms[a, b]
                same.setdefault(chars, []).append({"profile": profile, "unit": "cer", "n": n})
                same.setdefault(words_, []).append({"profile": profile, "unit": "wer", "n": m})
            out.append([{"ref": a, "hyp": b, "of": of} for (a, b), of in same.items()])
        return pd.Series(out)

    run.__annotations__ = {"refs": pd.Series, "hyps": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "array<struct<ref: string, hyp: string, of: array<struct<profile: string, unit: string, n: int>>>>")(ref, hyp)


def distance(a: Column, b: Column) -> Column:
    """Levenshtein distance; near texts, however long, are told in bands of growing width."""
    n, m = F.char_length(a), F.char_length(b)
    near = F.nullif(F.levenshtein(a, b, 512), F.lit(-1))  # only texts that are longer can be further apart
    return F.when(a == b, 0).when((n == 0) | (m == 0), n + m).when(F.greatest(n, m) <= 512, F.levenshtein(a, b)).otherwise(F.coalesce(near, F.levenshtein(a, b)))


def n_edits(a: list, b: list) -> int:
    """Least number of edits between two lists, by bits: a step for each item of ``b`` on words as long as ``a``."""
    if not a or not b:
        return len(a) + len(b)
    places: dict = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    whole, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, n = whole, 0, len(a)
    for x in b:
        eq = places.get(x, 0)
        vertical = eq | down
        across = (((eq & up) + up) ^ up) | eq
        more, less = down | (whole & ~(across | up)), up & across
        n += bool(more & top) - bool(less & top)
        more, less = (more << 1 | 1) & whole, (less << 1) & whole
        up, down = less | (whole & ~(vertical | more)), more & vertical
    return n


def align(ref: list, hyp: list) -> list[tuple[str, int, int]]:
    """Edits that turn ``ref`` into ``hyp``: (substitution | deletion | insertion, position in ref, position in hyp).

    A least number of edits; walking back from the ends a match or substitution is preferred, then a deletion.  Only the
    band that the number of edits leaves is filled.
    """
    lead = 0
    while lead < min(len(ref), len(hyp)) and ref[lead] == hyp[lead]:
        lead += 1
    tail = 0
    while tail < min(len(ref), len(hyp)) - lead and ref[-1 - tail] == hyp[-1 - tail]:
        tail += 1
    a, b = ref[lead : len(ref) - tail], hyp[lead : len(hyp) - tail]
    k = n_edits(a, b)
    far = len(a) + len(b) + 1
    # Row i holds the costs at j from i - k to i + k.
    rows = [[j if j >= 0 else far for j in range(-k, min(k, len(b)) + 1)]]
    for i, x in enumerate(a, 1):
        last, row = rows[-1], []
        for at in range(2 * k + 1):
            j = i - k + at
            if j < 0 or j > len(b):
                row.append(far)
                continue
            best = last[at] + (x != b[j - 1]) if j and at < len(last) else far
            if at + 1 < len(last):
                best = min(best, last[at + 1] + 1)
            if at and j:
                best = min(best, row[-1] + 1)
            row.append(best)
        rows.append(row)

    def cost(i: int, j: int) -> int:
        at = j - i + k
        return rows[i][at] if i >= 0 and j >= 0 and 0 <= at < len(rows[i]) else far

    out, i, j = [], len(a), len(b)
    while i or j:
        if i and j and cost(i, j) == cost(i - 1, j - 1) + (a[i - 1] != b[j - 1]):
            if a[i - 1] != b[j - 1]:
                out.append(("substitution", lead + i - 1, lead + j - 1))
            i, j = i - 1, j - 1
        elif i and cost(i, j) == cost(i - 1, j) + 1:
            out.append(("deletion", lead + i - 1, lead + j))
            i -= 1
        else:
            out.append(("insertion", lead + i, lead + j - 1))
            j -= 1
    return out[::-1]


@_udf("struct<substitutions: int, deletions: int, insertions: int, units: int>")
def word_edits(ref: pd.Series, hyp: pd.Series) -> pd.DataFrame:
    rows = []
    for r, h in zip(ref, hyp):
        a, b = (r or "").split(), (h or "").split()
        n = Counter(k for k, _, _ in align(a, b))
        rows.append((n["substitution"], n["deletion"], n["insertion"], len(a)))
    return pd.DataFrame(rows, columns=["substitutions", "deletions", "insertions", "units"])


@_udf("array<struct<kind: string, at: int, ref_word: string, hyp_word: string, before: string, after: string>>")
def word_differences(ref: pd.Series, hyp: pd.Series) -> pd.Series:
    """Rows of the edits between two texts, with up to five words of the first text before and after."""
    out = []
    for r, h in zip(ref, hyp):
        a, b = (r or "").split(), (h or "").split()
        out.append([{"kind": k, "at": i, "ref_word": None if k == "insertion" else a[i], "hyp_word": None if k == "deletion" else b[j], "before": " ".join(a[max(0, i - 5) : i]), "after": " ".join(a[i + (k != "insertion") :][:5])} for k, i, j in align(a, b)])
    return pd.Series(out)
