"""Turtle files: a reader of whole files (small ones, such as ontologies and exported graphs) and a writer."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.sparql import Parser, Term


class Turtle(Parser):
    """Triples (subject, property, object, kind of the object) of a document; IRIs in full.

    Prefixes, ``a``, lists of properties and objects, language and type marks, nested unnamed nodes ``[ .. ]`` and named ones
    ``_:x`` are read; anything else is an error.
    """

    def __init__(self, text: str) -> None:
        long = re.compile(r'"""(.*?)"""', re.S)
        quoted = long.sub(lambda m: '"' + re.sub(r'(?<!\\\\)"', r'\\"', m[1]).replace("\n", "\\n") + '"', text)
        marked = re.sub(r"@(prefix|base)\b", r"\1", quoted)
        super().__init__(re.sub(r"\[", " ( ", re.sub(r"\]", " ) ", marked)) if "[" in marked and not re.search(r"[()]", re.sub(r'"(?:[^"\\\\]|\\\\.)*"|<[^>]*>', "", marked)) else marked)
        self.unnamed = 0

    def triples_of(self) -> Iterator[tuple[str, str, str, str]]:
        while self.rest:
            if self.kind() == "word" and self.peek() in ("PREFIX", "BASE"):
                self.take()
                name = self.take()
                if not name.endswith(":"):
                    raise ValueError("a base IRI isn't supported")
                self.prefixes[name[:-1]] = self.take()[1:-1]
                self.maybe(".")
                continue
            node, inside = self.node()
            yield from inside
            if self.peek() != ".":
                yield from self.properties(node)
            self.take(".")

    def node(self) -> tuple[str, list]:
        """A subject or object that is no literal, and the triples of it if it is unnamed."""
        if self.maybe("("):
            self.unnamed += 1
            name = f"_:b{self.unnamed}"
            inside = [] if self.peek() == ")" else list(self.properties(name))
            self.take(")")
            return name, inside
        return self.full(self.iri()), []

    @staticmethod
    def full(t: Term) -> str:
        return t.value

    def properties(self, subject: str) -> Iterator[tuple[str, str, str, str]]:
        while True:
            p = "rdf:type" if self.kind() == "word" and self.take("A") else self.full(self.iri())
            while True:
                if self.kind() in ("string", "number") or self.kind() == "word":
                    t = Term("literal", self.take().lower()) if self.kind() == "word" else self.term()
                    yield subject, p, t.value, "literal"
                else:
                    o, inside = self.node()
                    yield subject, p, o, "iri"
                    yield from inside
                if not self.maybe(","):
                    break
            while self.maybe(";"):
                pass
            if self.peek() in (".", ")"):
                return


def read_turtle(spark: SparkSession, path: str) -> DataFrame:
    """``s, p, o, kind`` of the Turtle files under ``path``, each read as a whole; a broken file is an error."""
    files = spark.read.text(path, wholetext=True)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            rows = [t for text in b.column(0).to_pylist() for t in Turtle(text).triples_of()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (zip(*rows) if rows else [()] * 4)], names=["s", "p", "o", "kind"])

    return files.mapInArrow(run, "s string, p string, o string, kind string").distinct()


def turtle_lines(graph: DataFrame, base: str) -> DataFrame:
    """One line for each subject: its properties and objects in order; own terms are written with the empty prefix ``base``."""
    esc = F.col("o")
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        esc = F.replace(esc, F.lit(a), F.lit(b))
    named = lambda c: F.when(c == "rdf:type", F.lit("a")).when(c.rlike("^[a-z]+://"), F.concat(F.lit("<"), c, F.lit(">"))).otherwise(F.concat(F.lit(f"<{base}"), c, F.lit(">")))
    value: Column = F.when(F.col("kind") == "iri", named(F.col("o"))).otherwise(F.concat(F.lit('"'), esc, F.lit('"')))
    facts = F.array_sort(F.collect_list(F.concat(named(F.col("p")), F.lit(" "), value)))
    return graph.groupBy("s").agg(facts.alias("facts")).select(F.concat(named(F.col("s")), F.lit(" "), F.array_join("facts", " ; "), F.lit(" .")).alias("value"))


def write_turtle(graph: DataFrame, path: str, base: str) -> None:
    turtle_lines(graph, base).write.mode("overwrite").text(path)
