import pytest

from tessera.operators import graph as G
from tessera.operators import sparql as S

ROWS = [("r1", "rdf:type", "Rec", "iri"), ("r2", "rdf:type", "Rec", "iri"), ("r1", "id", "A", "literal"), ("r2", "id", "B", "literal"), ("r1", "speaker", "s1", "iri"), ("s1", "name", "Sel", "literal"), ("x", "in", "r1", "iri"), ("y", "in", "r1", "iri"), ("z", "in", "r2", "iri"), ("x", "at", "10.5", "literal"), ("y", "at", "9.25", "literal"), ("x", "link", "http://a/1", "iri"), ("x", "link", "http://b/1", "iri")]


@pytest.fixture(scope="module")
def graph(spark):
    return spark.createDataFrame(ROWS, "s string, p string, o string, kind string")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_patterns_paths_optional(graph):
    assert rows(S.select(graph, "SELECT ?x ?i WHERE { ?x :in/:id ?i }")) == [("x", "A"), ("y", "A"), ("z", "B")]
    assert rows(S.select(graph, "SELECT ?i ?x WHERE { ?r :id ?i ; ^:in ?x . }")) == [("A", "x"), ("A", "y"), ("B", "z")]
    nested = "SELECT DISTINCT ?i ?n ?s WHERE { ?x :in ?r . ?r :id ?i . OPTIONAL { ?r :speaker ?s . OPTIONAL { ?s :name ?n } } }"
    assert rows(S.select(graph, nested)) == [("A", "Sel", "s1"), ("B", None, None)]
    assert rows(S.select(graph, "PREFIX e: <https://tessera.example/ns#> SELECT * WHERE { ?r a e:Rec ; e:id ?i , ?j . }")) == [("A", "A", "r1"), ("B", "B", "r2")]
    assert rows(S.select(graph, "SELECT ?p WHERE { ?x ?p ?r . ?r :id 'B' }")) == [("in",)]


def test_groups_having_order_limit_ask(graph):
    q = "SELECT ?i (COUNT(DISTINCT ?x) AS ?n) WHERE { ?x :in ?r . ?r :id ?i . } GROUP BY ?i HAVING (COUNT(DISTINCT ?x) > 1) ORDER BY DESC(?n) LIMIT 5"
    assert rows(S.select(graph, q)) == [("A", 2)]
    assert rows(S.select(graph, "SELECT (GROUP_CONCAT(DISTINCT ?x; separator=', ') AS ?l) ?r WHERE { ?x :in ?r } GROUP BY ?r")) == [("x, y", "r1"), ("z", "r2")]
    assert S.select(graph, 'ASK { ?r :id "A" }').first().answer and not S.select(graph, 'ASK { ?r :id "Q" }').first().answer
    assert [r.x for r in S.select(graph, "SELECT ?x WHERE { ?x :at ?t } ORDER BY ?t").collect()] == ["y", "x"]
    assert [r.x for r in S.select(graph, "SELECT ?x WHERE { ?x :in ?r } ORDER BY DESC(?x) LIMIT 1 OFFSET 1").collect()] == ["y"]
    r = S.select(graph, "SELECT (MIN(?t) AS ?lo) (MAX(?t) AS ?hi) (SUM(?t) AS ?sum) (AVG(?t) AS ?avg) (COUNT(*) AS ?n) WHERE { ?x :at ?t }").first()
    assert tuple(r) == ("9.25", "10.5", 19.75, 9.875, 2)
    some, n = S.page(graph, "SELECT ?x WHERE { ?x :in ?r }", 2)
    assert some.count() == 2 and n == 3


@pytest.mark.parametrize(
    ("cond", "want"),
    [
        ("STRSTARTS(STR(?u), STR(b:))", [("http://b/1",)]), ('STRSTARTS(?u, "http://a")', [("http://a/1",)]), ("(?t > 10) ", [("http://a/1",), ("http://b/1",)]), ("(?t < 10)", []), ("(?t = 10.50 && CONTAINS(?u, '/a/'))", [("http://a/1",)]),
        ("(!BOUND(?t) || REGEX(?u, 'b/[0-9]$'))", [("http://b/1",)]), ("(STRLEN(?u) + 1 >= 11)", [("http://a/1",), ("http://b/1",)]), ("(?u != <http://a/1>)", [("http://b/1",)]), ('CONTAINS("} FILTER (", "}")', [("http://a/1",), ("http://b/1",)]),
    ],
)
def test_filters(graph, cond, want):
    assert rows(S.select(graph, f"PREFIX b: <http://b/> SELECT ?u WHERE {{ ?x :link ?u ; :at ?t . FILTER {cond} }}")) == want


def test_bind_and_kinds(graph):
    assert rows(S.select(graph, "SELECT ?i ?c WHERE { ?r :id ?i . BIND(CONCAT(?i, '-', LCASE(?i)) AS ?c) }")) == [("A", "A-a"), ("B", "B-b")]
    assert rows(S.select(graph, "SELECT ?r WHERE { ?r :id :A }")) == []  # an IRI is no literal


@pytest.mark.parametrize("bad", [
    "DELETE { ?s ?p ?o } WHERE { }", "SELECT ?x WHERE { { ?x a ?y } UNION { ?y a ?x } }", "SELECT ?x WHERE { ?x a ?y . ?q :in ?z }", "SELECT ?x WHERE { ?x e:in ?y }", "SELECT ?x WHERE { ?x a ?y FILTER (UNKNOWN(?y)) }", "SELECT ?x WHERE { ?x a ?y",
    "SELECT ?x WHERE { ?x a ?y FILTER (?q > 3) }", "SELECT ?q WHERE { ?x a ?y }", "SELECT ?x (COUNT(?y) AS ?n) WHERE { ?x a ?y }", "SELECT ?x WHERE { MINUS { ?x a ?y } }", "SELECT ?x WHERE { ?x a ?y } trailing", "SELECT ?x WHERE { ?x :in+ ?y }", "SELECT ?x WHERE { ?x a ?y FILTER STRSTARTS(?x) }",
])
def test_refused(graph, bad):
    with pytest.raises(ValueError):
        S.select(graph, bad)


def test_merge_union_statistics(spark, graph):
    same = spark.createDataFrame([("s1", "s2")], "drop string, keep string")
    merged = {tuple(r)[:3] for r in G.merge_nodes(graph, same).collect()}
    assert ("r1", "speaker", "s2") in merged and ("s2", "altLabel", "Sel") in merged and not any(t[0] == "s1" for t in merged)
    assert G.union(graph, graph).count() == len(ROWS)
    stats = {(r.metric, r.name): r.n for r in G.statistics(graph).collect()}
    assert stats["triples", ""] == len(ROWS) and stats["individuals", ""] == 2 and stats["class", "Rec"] == 2 and stats["property", "in"] == 3


def test_rules_decisions_inverse(spark):
    from pyspark.sql import functions as F

    t = spark.createDataFrame([("a", "x", 1), ("b", None, 2), ("a", "x", 3)], "k string, v string, n int")
    g = G.Triples.of_rules([(t, F.col("k"), [(G.TYPE, "Thing", "iri"), ("v", F.col("v"), "literal"), ("to", F.concat(F.lit("n"), F.col("n").cast("string")), "iri")])])
    assert rows(g.all().select("s", "p", "o")) == [("a", "rdf:type", "Thing"), ("a", "to", "n1"), ("a", "to", "n3"), ("a", "v", "x"), ("b", "rdf:type", "Thing"), ("b", "to", "n2")]
    assert g.of("absent").count() == 0 and g.of(G.TYPE, "Other").count() == 0
    assert rows(S.select(g, "SELECT ?x WHERE { ?x a :Thing ; :v 'x' }")) == [("a",)]
    assert rows(G.inverse(g, "to", "from").select("s", "o"))[0] == ("n1", "a")
    assert G.typed_links(g, "to", subject="Thing", prefix="n") == 3 and rows(G.value_counts(g, "v")) == [("x", 1)]
    chain = spark.createDataFrame([("c", "b"), ("b", "a"), ("q", "q")], "drop string, keep string")
    assert rows(G.resolved(chain).select("drop", "keep")) == [("b", "a"), ("c", "a")]
    table = spark.createDataFrame([("a", "name", "A", "literal"), ("b", "name", "B", "literal"), ("z", "about", "b", "iri"), ("c", "name", "C", "literal")], "s string, p string, o string, kind string")
    done = {tuple(r)[:3] for r in G.applied(table, spark.createDataFrame([("a", "b", "accepted"), ("a", "c", "related"), ("c", "z", "rejected")], "a string, b string, status string")).collect()}
    assert done == {("a", "name", "A"), ("a", "altLabel", "B"), ("z", "about", "a"), ("c", "name", "C"), ("a", "skos:related", "c"), ("c", "skos:related", "a")}
