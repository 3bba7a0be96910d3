"""Agreement of what was found with what is wanted, by occurrence and by entity, with pooled rates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COUNTS = ("found", "wanted", "found_entities", "wanted_entities", "entity_matched", "matched", "retained", "corrected", "rejected", "added")


def counts(found: DataFrame, wanted: DataFrame, group: list[str], entity: list[str], at: str, text: str, order: str) -> DataFrame:
    """``group...`` and COUNTS of two tables of items (``group``, ``entity`` keys, ``at``, ``text``, ``order``).

    Occurrences are pairs of entity and ``at``; equal ones are one, and the last by ``order`` gives its text.  ``found`` and
    ``wanted`` count all items; ``retained`` are matched occurrences of one text but for white space at its ends.  Null keys
    are values of their own.
    """
    side = lambda df, w: df.select(*group, *entity, F.col(at).alias("_at"), F.struct(order, F.trim(F.coalesce(text, F.lit(""))).alias("t")).alias("_x"), F.lit(w).alias("_w"))
    both = side(found, 0).unionByName(side(wanted, 1))
    of = lambda w, c: F.when(F.col("_w") == w, c)
    keys = both.groupBy(*group, *entity, "_at").agg(F.count(of(0, F.lit(1))).alias("nf"), F.count(of(1, F.lit(1))).alias("nw"), F.max(of(0, F.col("_x")))["t"].alias("tf"), F.max(of(1, F.col("_x")))["t"].alias("tw"))
    both_sides, only_f, only_w = (F.col("nf") > 0) & (F.col("nw") > 0), (F.col("nw") == 0), (F.col("nf") == 0)
    ents = keys.groupBy(*group, *entity).agg(
        F.sum("nf").alias("found"), F.sum("nw").alias("wanted"), F.count_if(both_sides).alias("matched"), F.count_if(both_sides & F.col("tf").eqNullSafe(F.col("tw"))).alias("retained"), F.count_if(only_f).alias("rejected"), F.count_if(only_w).alias("added"),
    )
    has = lambda c: F.count_if(F.col(c) > 0)
    total = ents.groupBy(*group).agg(
        F.sum("found").alias("found"), F.sum("wanted").alias("wanted"), has("found").alias("found_entities"), has("wanted").alias("wanted_entities"), F.count_if((F.col("found") > 0) & (F.col("wanted") > 0)).alias("entity_matched"),
        *[F.sum(c).alias(c) for c in ("matched", "retained", "rejected", "added")],
    )
    return total.select(*group, *[(F.col("matched") - F.col("retained")).alias(c) if c == "corrected" else F.col(c) for c in COUNTS])


def _f1(p: Column, r: Column) -> Column:
    return F.when((p > 0) & (r > 0), 2 * p * r / (p + r))


def rates(df: DataFrame, digits: int = 6) -> DataFrame:
    """The counts with precision, recall and F1 by occurrence and by entity, and the shares kept, corrected, rejected and left out.

    Precision and recall are of sets; the shares are of all items.  Empty denominators give null.
    """
    c = F.col
    p, r = F.try_divide(c("matched"), c("matched") + c("rejected")), F.try_divide(c("matched"), c("matched") + c("added"))
    ep, er = F.try_divide(c("entity_matched"), c("found_entities")), F.try_divide(c("entity_matched"), c("wanted_entities"))
    new = {
        "occurrence_precision": p, "occurrence_recall": r, "occurrence_f1": _f1(p, r), "entity_precision": ep, "entity_recall": er, "entity_f1": _f1(ep, er),
        "retention": F.try_divide(c("retained"), c("found")), "correction": F.try_divide(c("corrected"), c("found")), "rejection": F.try_divide(c("rejected"), c("found")), "omission": F.try_divide(c("added"), c("wanted")),
    }
    return df.select(*df.columns, *[F.round(v, digits).alias(k) for k, v in new.items()])


def pooled(df: DataFrame, by: list[str], over: str, label: str = "ALL") -> DataFrame:
    """Sums of the counts by ``by`` and ``over``, and over all of ``over`` under ``label``."""
    sums = df.groupingSets([[*by, over], by], *by, over).agg(*[F.sum(c).alias(c) for c in COUNTS], F.grouping(over).alias("_all"))
    return sums.select(*by, F.when(F.col("_all") == 1, label).otherwise(F.col(over)).alias(over), *COUNTS)


def ranks(gold: Column, retrieved: Column) -> Column:
    """Place (from 1) of the first of an array of ids that is in ``gold``; null where none is."""
    at = F.filter(F.transform(retrieved, lambda x, i: F.when(F.array_contains(gold, x), i + 1)), lambda x: x.isNotNull())
    return F.array_min(at)


def retrieval_metrics(gold: Column, initial: Column, reranked: Column, sent: Column) -> Column:
    """Struct of hits, ranks of the first gold id, and precision and recall of what was sent; nulls where there is no gold."""
    some, g = F.size(gold) > 0, F.array_distinct(gold)
    sent_ids = F.array_distinct(sent)
    both = F.size(F.array_intersect(g, sent_ids))
    return F.struct(
        F.when(some, F.arrays_overlap(g, initial)).alias("initial_hit"), F.when(some, ranks(g, initial)).alias("initial_rank"), F.when(some, F.arrays_overlap(g, reranked)).alias("reranked_hit"), F.when(some, ranks(g, reranked)).alias("reranked_rank"),
        F.when(some, both > 0).alias("sent_hit"), F.when(some, F.try_divide(both, F.size(sent_ids))).alias("sent_precision"), F.when(some, F.try_divide(both, F.size(g))).alias("sent_recall"),
    )


def citation_metrics(gold: Column, answer: Column, sent: Column) -> Column:
    """Struct of the sent ids that an answer's text holds, and their precision and recall; nulls where there is no gold."""
    some, g = F.size(gold) > 0, F.array_distinct(gold)
    cited = F.array_sort(F.filter(F.array_distinct(sent), lambda x: F.coalesce(F.contains(answer, x), F.lit(False))))
    both = F.size(F.array_intersect(cited, g))
    return F.struct(cited.alias("cited"), F.when(some, F.try_divide(both, F.size(cited))).alias("precision"), F.when(some, F.try_divide(both, F.size(g))).alias("recall"), (F.size(cited) == 0).alias("no_citation"))


def mean_reciprocal(rank: Column) -> Column:
    """Mean of 1 / rank, 0 where there is none."""
    return F.avg(F.coalesce(F.try_divide(F.lit(1), rank), F.lit(0.0)))


def named_slices(df: DataFrame, sets: list[list[str]], columns: list[str], aggs: list[Column]) -> DataFrame:
    """Aggregates over several grouping sets in one pass, '*' for the columns that a set leaves out."""
    out = df.groupingSets(sets, *columns).agg(*aggs, *[F.grouping(c).alias(f"_{c}") for c in columns])
    return reduce(lambda d, c: d.withColumn(c, F.when(F.col(f"_{c}") == 1, "*").otherwise(F.col(c))).drop(f"_{c}"), columns, out)
