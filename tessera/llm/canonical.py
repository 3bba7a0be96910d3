"""One consistent form of texts that look the same.

Texts are exploded to positioned code points.  A broadcast table (built from the Unicode database, so of fixed size)
gives the decomposition of each code point, its combining class, and the form that look-alike letters, digits and spaces
are brought to; invisible characters are dropped.  The strings are rebuilt by position; combining marks are ordered by
class within their sequence and recomposed with a second broadcast table of pairs, in time linear in the text.

A text none of whose code points is in the tables is its own form and isn't exploded.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.textcodes import INVISIBLE

# Letters and digits of like shape, each brought to the first of its pair.
LOOK_ALIKE = {
    # Cyrillic and Greek letters to Latin
    "а": "a", "с": "c", "е": "e", "һ": "h", "і": "i", "ј": "j", "о": "o", "р": "p", "ѕ": "s", "х": "x", "у": "y",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P",
    "Ѕ": "S", "Т": "T", "Х": "X", "У": "Y", "ο": "o", "ν": "v", "ι": "i", "α": "a", "ρ": "p",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P",
    "Τ": "T", "Υ": "Y", "Χ": "X",
    "ԁ": "d", "ԛ": "q", "ԝ": "w", "ѵ": "v", "ӏ": "l", "Ӏ": "I", "ү": "y", "Ү": "Y", "Ԍ": "G", "Ԛ": "Q", "Ԝ": "W",
    # Armenian and Cherokee letters to Latin
    "օ": "o", "հ": "h", "յ": "j", "ց": "g", "զ": "q", "ո": "n", "ս": "u", "Օ": "O", "Տ": "S", "Լ": "L",
    "Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭰ": "D", "Ꭼ": "E", "Ꮐ": "G", "Ꮋ": "H", "Ꭻ": "J", "Ꮶ": "K", "Ꮮ": "L", "Ꮇ": "M", "Ꮲ": "P", "Ꮪ": "S", "Ꭲ": "T",
    "Ꮩ": "V", "Ꮃ": "W", "Ꮓ": "Z", "Ꭱ": "R",
    # Arabic letters with like joined forms
    "ي": "ی", "ك": "ک", "ه": "ہ", "ە": "ہ",
}
#: Compatibility decompositions that keep the look: mathematical letters, width, joining forms, ligatures, spaces, radicals.
KEPT_TAGS = ("<font>", "<wide>", "<narrow>", "<initial>", "<medial>", "<final>", "<isolated>", "<noBreak>", "<compat>", "<vertical>", "<small>")


def _decompose(ch: str) -> str:
    """Full canonical decomposition with the compatibility forms of KEPT_TAGS."""
    d = unicodedata.decomposition(ch)
    if 0xAC00 <= ord(ch) < 0xD7A4:
        return unicodedata.normalize("NFD", ch)
    if not d:
        return ch
    parts = d.split()
    if parts[0].startswith("<"):
        if parts[0] not in KEPT_TAGS:
            return ch
        parts = parts[1:]
    return "".join(_decompose(chr(int(x, 16))) for x in parts)


@functools.cache
def mapping() -> tuple[tuple[str, str, int], ...]:
    """(code point, what it becomes, class of what it becomes if it is a mark) for all that changes or combines."""
    digits = {chr(0x6F0 + i): chr(0x660 + i) for i in (0, 1, 2, 3, 7, 8, 9)}  # Arabic digits; 4, 5 and 6 differ in shape
    alike = LOOK_ALIKE | digits
    rows = []
    for c in range(0x30000):
        ch = chr(c)
        if 0xD800 <= c < 0xE000:
            continue
        if c in INVISIBLE:
            rows.append((ch, "", 0))
            continue
        cat = unicodedata.category(ch)
        if cat == "Zs":
            to = " "
        elif cat in ("Cn", "Co"):
            continue
        else:
            to = "".join(alike.get(x, x) for x in _decompose(ch))
        ccc = unicodedata.combining(ch)
        if to != ch or ccc:
            rows.append((ch, to, ccc))
    return tuple(rows)


@functools.cache
def compositions() -> dict[str, str]:
    """Pairs (after look-alikes) that compose, as two-character strings, to the composed character; Hangul by its rule."""
    alike = LOOK_ALIKE
    out: dict[str, str] = {}
    for c in range(0x30000):
        if 0xD800 <= c < 0xE000:
            continue
        ch = chr(c)
        d = unicodedata.decomposition(ch)
        if d and not d.startswith("<") and " " in d and unicodedata.normalize("NFC", ch) == ch:
            pair = "".join(alike.get(chr(int(x, 16)), chr(int(x, 16))) for x in d.split())
            out.setdefault(pair, ch)
    for k in range(19 * 21):  # leading consonant and vowel
        syllable = chr(0xAC00 + 28 * k)
        out[chr(0x1100 + k // 21) + chr(0x1161 + k % 21)] = syllable
        for t in range(1, 28):
            out[syllable + chr(0x11A7 + t)] = chr(0xAC00 + 28 * k + t)
    return out


@functools.cache
def _seconds() -> frozenset[str]:
    return frozenset(pair[1] for pair in compositions())


def _class_table(spark: SparkSession) -> DataFrame:
    """``cp, parts``: what each code point that changes or combines becomes; ``m`` is the class of a mark, 0 where a starter may
    compose with the one before it, -1 of others."""
    seconds = _seconds()
    of = lambda x: unicodedata.combining(x) or (0 if x in seconds else -1)
    rows = [(ch, [(x, of(x)) for x in to]) for ch, to, _ in mapping()]
    return spark.createDataFrame(rows + [(x, [(x, of(x))]) for x in sorted(seconds - {r[0] for r in rows})], "cp string, parts array<struct<c: string, m: int>>")


def composed(text: str, marks: list[tuple[int, int]], table: dict[str, str]) -> str:
    """``text`` with its marks ordered by class within each sequence and composed; ``marks`` are the (place, class) of all of
    its characters that combine, in order of places."""
    cs = list(text)
    k, n = 0, len(marks)
    while k < n:
        at, cls = marks[k]
        if cls == 0:  # a starter: composes with the starter right before it
            base = at - 1
            while base >= 0 and cs[base] == "":
                base -= 1
            made = table.get(cs[base] + cs[at]) if base >= 0 else None
            if made is not None and (base == at - 1 or all(x == "" for x in cs[base + 1 : at])):
                cs[base], cs[at] = made, ""
            k += 1
            continue
        end = k
        while end < n and marks[end][1] > 0 and marks[end][0] == at + end - k:
            end += 1
        run = sorted(range(k, end), key=lambda i: marks[i][1])  # stable: marks of one class keep their order
        ordered = [(cs[marks[i][0]], marks[i][1]) for i in run]
        base, last, rest = at - 1, 0, []
        for ch, c in ordered:
            made = table.get(cs[base] + ch) if base >= 0 and cs[base] and last < c else None
            if made is not None:
                cs[base] = made
            else:
                rest.append(ch)
                last = c
        for i in range(end - k):
            cs[at + i] = rest[i] if i < len(rest) else ""
        k = end
    return "".join(cs)


#: A text without any of these is its own form: outside ASCII and the unified ideographs everything may be in the tables.
_ACTIVE = r"[\x{80}-\x{4DFF}\x{A000}-\x{10FFFF}]"


def canonical(df: DataFrame, key: list[str], text: str, out: str = "canonical", *, by: list[str] | None = None) -> DataFrame:
    """``key..., out`` for every row of ``df``; ``key`` must be unique.  ``by`` (part of ``key``) partitions the work.

    Null texts stay null, empty texts empty; a text of invisible characters alone becomes empty.  Other columns are dropped.
    """
    spark = df.sparkSession
    src = df.select(*key, F.col(text).alias("_t"))
    active = F.col("_t").rlike(_ACTIVE)
    still = src.where(F.col("_t").isNull() | ~active).select(*key, F.col("_t").alias(out))
    moved = src.where(active).repartition(*(by or key))
    points = moved.select(*key, F.posexplode(F.split("_t", "")).alias("pos", "cp"))
    itself = F.array(F.struct(F.col("cp").alias("c"), F.lit(-1).alias("m")))
    parts = points.join(F.broadcast(_class_table(spark)), "cp", "left").select(*key, F.struct("pos", F.coalesce("parts", itself).alias("parts")).alias("p"))
    whole = parts.groupBy(*key).agg(F.flatten(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["parts"])).alias("cs"))
    marks = F.filter(F.transform("cs", lambda x, i: F.struct(i.alias("at"), x["m"].alias("m"))), lambda x: x["m"] >= 0)
    plain = whole.select(*key, F.array_join(F.transform("cs", lambda x: x["c"]), "").alias("_s"), marks.alias("_m"))
    shared = spark.sparkContext.broadcast(compositions())

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for b in it:
            found = [composed(t, [(x["at"], x["m"]) for x in m], table) if m else t for t, m in zip(b.column(len(key)).to_pylist(), b.column(len(key) + 1).to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(key)], pa.array(found, pa.string())], names=[*key, out])

    kinds = ", ".join(f"`{k}` {plain.schema[k].dataType.simpleString()}" for k in key)
    return plain.mapInArrow(run, f"{kinds}, `{out}` string").unionByName(still)


def same_look(pairs: DataFrame, key: list[str], one: str, other: str) -> DataFrame:
    """``key`` of the rows whose texts ``one`` and ``other`` differ but have one canonical form; repeated rows once."""
    differing = pairs.where(F.col(one) != F.col(other)).select(*key, F.col(one).alias("_a"), F.col(other).alias("_b")).distinct()
    sides = differing.select(*key, F.xxhash64("_a", "_b").alias("_pair"), F.explode(F.array(F.struct(F.lit(0).alias("_side"), F.col("_a").alias("_t0")), F.struct(F.lit(1).alias("_side"), F.col("_b").alias("_t0")))).alias("_s"))
    rows = sides.select(*key, "_pair", F.col("_s._side").alias("_side"), F.col("_s._t0").alias("_t0"))
    forms = canonical(rows, [*key, "_pair", "_side"], "_t0", "_form", by=[*key, "_pair"])
    return forms.groupBy(*key, "_pair").agg(F.min("_form").alias("_lo"), F.max("_form").alias("_hi")).where(F.col("_lo") == F.col("_hi")).select(*key).distinct()


def found_pairs(segments: DataFrame, entities: DataFrame) -> DataFrame:
    """``item_kind, item_key``: v3 segments that look as their v2 text, ayah and dua entities that look as their canonical text.

    A version of a segment is one (recording, seq); should it have rows that differ, the greatest is taken.
    """
    # Both versions of a segment meet in one grouping, which also takes redelivered rows once.
    is_3, there = F.col("version") == "v3", F.col("text").isNotNull() & F.col("recording").isNotNull() & F.col("seq").isNotNull()
    both = segments.where(F.col("version").isin("v2", "v3") & there).groupBy("recording", "seq").agg(
        F.max(F.when(is_3, F.struct(F.col("seg_key").cast("bigint").alias("item_key"), "text"))).alias("_3"), F.max(F.when(~is_3, F.col("text"))).alias("other"),
    )
    of_segment = both.where(F.col("_3").isNotNull() & F.col("other").isNotNull()).select(F.lit("segment").alias("item_kind"), "_3.item_key", F.col("_3.text").alias("one"), "other")
    of_entity = entities.where(F.col("etype").isin("ayah", "dua")).select(F.lit("entity").alias("item_kind"), F.col("entity_id").cast("bigint").alias("item_key"), F.col("text").alias("one"), F.col("canonical_text").alias("other"))
    return same_look(of_segment.unionByName(of_entity), ["item_kind", "item_key"], "one", "other")


def forms(segments: DataFrame, entities: DataFrame) -> DataFrame:
    """``item_kind, item_key, form`` of every segment text, entity text and canonical text of an entity; null for null.

    Kinds are ``segment``, ``entity_text`` and ``entity_canonical_text``; redelivered rows count once.
    """
    of = lambda df, kind, key, text: df.select(F.lit(kind).alias("item_kind"), F.col(key).cast("bigint").alias("item_key"), F.col(text).alias("_text"))
    s = segments.select("seg_key", "text").dropDuplicates(["seg_key"])
    e = entities.select("entity_id", "text", "canonical_text").dropDuplicates(["entity_id"])
    items = of(s, "segment", "seg_key", "text").unionByName(of(e, "entity_text", "entity_id", "text")).unionByName(of(e, "entity_canonical_text", "entity_id", "canonical_text"))
    return canonical(items, ["item_kind", "item_key"], "_text", "form").select("item_kind", "item_key", "form")
