"""A knowledge graph as triples: construction by rules, node merge, reviewed decisions and relations, statistics.

Triples are ``s, p, o, kind`` with kind ``iri`` or ``literal``; a graph is a set of them.  Terms of the own namespace NS are
written without it.  ``Triples`` keeps a graph by property, so that a pattern with a known property reads only what makes it.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NS = "https://tessera.example/ns#"
TYPE = "rdf:type"


class Triples:
    """A graph by property (classes apart): tables ``s, o, kind``, each a set once read."""

    def __init__(self, rules: list[tuple[DataFrame | Callable[[], DataFrame], Column, list[tuple[str, Column | str, str]]]]) -> None:
        self._rules = rules
        self._made: dict[int, DataFrame] = {}

    @staticmethod
    def of_table(table: DataFrame) -> Triples:
        """A graph that is one table ``s, p, o, kind``."""
        return _Table(table)

    @staticmethod
    def of_rules(rules: list[tuple[DataFrame | Callable[[], DataFrame], Column, list[tuple[str, Column | str, str]]]]) -> Triples:
        """Rules (rows, subject, [(property, object, kind)]); a class is given as plain text.  Null subjects and objects give no triple.

        Rows may be a function that makes them, called once and only if a pattern needs them.
        """
        return Triples(rules)

    def _rows(self, i: int) -> DataFrame:
        rows = self._rules[i][0]
        if not callable(rows):
            return rows
        if i not in self._made:
            self._made[i] = rows()
        return self._made[i]

    def of(self, p: str, o: str | None = None) -> DataFrame:
        """``s, p, o, kind`` of a property (of one class, for the type property)."""
        some = []
        for i, (_, subject, facts) in enumerate(self._rules):
            for q, value, kind in facts:
                if q == p and (o is None or not isinstance(value, str) or value == o):
                    o_ = F.lit(value) if isinstance(value, str) else value.cast("string")
                    some.append(self._rows(i).select(subject.alias("s"), F.lit(q).alias("p"), o_.alias("o"), F.lit(kind).alias("kind")).where(F.col("s").isNotNull() & F.col("o").isNotNull()))
        if not some:
            first = next((rows for rows, _, _ in self._rules if not callable(rows)), None)
            some = [(self._rows(0) if first is None else first).where(F.lit(False)).select(*[F.lit("").alias(c) for c in ("s", "p", "o", "kind")])]
        return union(*some)

    def all(self) -> DataFrame:
        """The whole set, every rule's rows read once."""
        return union(*[triples(self._rows(i), subject, [(p, F.lit(o) if isinstance(o, str) else o, kind) for p, o, kind in facts]) for i, (_, subject, facts) in enumerate(self._rules)])


class _Table(Triples):
    def __init__(self, table: DataFrame) -> None:
        self.table = table

    def of(self, p: str, o: str | None = None) -> DataFrame:
        rows = self.table.where(F.col("p") == p)
        return rows if o is None else rows.where(F.col("o") == o)

    def all(self) -> DataFrame:
        return self.table


def triples(rows: DataFrame, subject: Column, rules: list[tuple[str, Column, str]]) -> DataFrame:
    """Triples of every row: (property, object, kind) rules; rules with a null object give none."""
    facts = F.array(*[F.struct(F.lit(p).alias("p"), o.cast("string").alias("o"), F.lit(k).alias("kind")) for p, o, k in rules])
    return rows.select(subject.alias("s"), F.explode(facts).alias("f")).select("s", "f.p", "f.o", "f.kind").where(F.col("s").isNotNull() & F.col("o").isNotNull())


def union(*graphs: DataFrame) -> DataFrame:
    """Union as sets."""
    out = graphs[0]
    for g in graphs[1:]:
        out = out.unionByName(g)
    return out.distinct()


def merge_nodes(graph: DataFrame, same: DataFrame, label: str = "altLabel", name: str = "name") -> DataFrame:
    """``graph`` with each node ``drop`` of ``same`` (drop, keep) merged into ``keep``: edges to it lead to ``keep``, its own
    are gone, and its names become alternative labels.  Chains of merges must be resolved beforehand."""
    to = same.select(F.col("drop").alias("_d"), F.col("keep").alias("_k"))
    redirected = graph.join(to, F.col("o") == F.col("_d"), "left").select("s", "p", F.coalesce("_k", "o").alias("o"), "kind")
    kept = redirected.join(to, F.col("s") == F.col("_d"), "left_anti")
    names = graph.where(F.col("p") == name).join(to, F.col("s") == F.col("_d")).select(F.col("_k").alias("s"), F.lit(label).alias("p"), "o", "kind")
    return union(kept, names)


def statistics(graph: DataFrame) -> DataFrame:
    """``metric, name, n``: triples, individuals, instances by class, and uses by property."""
    whole = graph.agg(F.count("*").alias("triples"), F.count_distinct(F.when(F.col("p") == TYPE, F.col("s"))).alias("individuals"))
    flat = whole.select(F.explode(F.array(F.struct(F.lit("triples").alias("metric"), F.lit("").alias("name"), F.col("triples").alias("n")), F.struct(F.lit("individuals").alias("metric"), F.lit("").alias("name"), F.col("individuals").alias("n")))).alias("x")).select("x.*")
    by_class = graph.where(F.col("p") == TYPE).groupBy(F.col("o").alias("name")).agg(F.count("*").alias("n")).select(F.lit("class").alias("metric"), "name", "n")
    by_property = graph.groupBy(F.col("p").alias("name")).agg(F.count("*").alias("n")).select(F.lit("property").alias("metric"), "name", "n")
    return flat.unionByName(by_class).unionByName(by_property)


def typed_links(graph: Triples, p: str, *, subject: str | None = None, obj: str | None = None, prefix: str | None = None) -> int:
    """Triples of a property whose subject or object is of a class, or whose object begins with a prefix."""
    rows = graph.of(p)
    for column, cls in (("s", subject), ("o", obj)):
        if cls is not None:
            rows = rows.join(graph.of(TYPE, cls).select(F.col("s").alias(column)), column, "left_semi")
    return rows.where(F.startswith("o", F.lit(prefix))).count() if prefix else rows.count()


def link_statistics(graph: Triples, links: list[tuple[str, str, str | None, str | None, str | None]]) -> DataFrame:
    """``metric, n`` of links (name, property, class of the subject, class of the object, prefix of the object), in one plan."""
    out = []
    for name, p, subject, obj, prefix in links:
        rows = graph.of(p)
        for column, cls in (("s", subject), ("o", obj)):
            if cls is not None:
                rows = rows.join(graph.of(TYPE, cls).select(F.col("s").alias(column)), column, "left_semi")
        rows = rows.where(F.startswith("o", F.lit(prefix))) if prefix else rows
        out.append(rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("metric"), "n"))
    return reduce(DataFrame.unionByName, out)


def value_counts(graph: Triples, p: str) -> DataFrame:
    """``name, n``: uses of each object of a property, the most used first."""
    return graph.of(p).groupBy(F.col("o").alias("name")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name")


def resolved(same: DataFrame, rounds: int = 20) -> DataFrame:
    """``drop, keep`` with chains followed to their end; a node merged into several keeps the least."""
    pairs = same.where(F.col("drop") != F.col("keep")).groupBy("drop").agg(F.min("keep").alias("keep"))
    for _ in range(rounds):
        nxt = pairs.select(F.col("drop").alias("keep"), F.col("keep").alias("_next"))
        longer = pairs.join(nxt, "keep", "left").select("drop", F.coalesce("_next", "keep").alias("keep"), F.col("_next").isNotNull().alias("_moved")).where(F.col("drop") != F.col("keep"))
        if longer.where("_moved").isEmpty():
            break
        pairs = longer.select("drop", "keep")
    return pairs


def applied(graph: DataFrame, proposals: DataFrame, related: str = "skos:related", name: str = "name") -> DataFrame:
    """``graph`` after reviewed proposals ``a, b, status`` on nodes: of an accepted pair ``b`` is merged into ``a``; a pair rejected
    but related is linked both ways; others change nothing."""
    merged = merge_nodes(graph, resolved(proposals.where(F.col("status") == "accepted").select(F.col("b").alias("drop"), F.col("a").alias("keep"))), name=name)
    return union(merged, relations(proposals.where(F.col("status") == "related").select("a", "b"), related))


def relations(pairs: DataFrame, p: str) -> DataFrame:
    """Triples of a symmetric relation between the nodes ``a, b``, both ways."""
    both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return both.select(F.col("a").alias("s"), F.lit(p).alias("p"), F.col("b").alias("o"), F.lit("iri").alias("kind")).distinct()


def inverse(graph: Triples, p: str, q: str) -> DataFrame:
    """Triples of the inverse ``q`` of a property."""
    return graph.of(p).where(F.col("kind") == "iri").select(F.col("o").alias("s"), F.lit(q).alias("p"), F.col("s").alias("o"), "kind")
