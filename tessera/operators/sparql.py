"""A subset of SPARQL 1.1 over triples: a tokenizer, a recursive parser to a small algebra, and its translation to DataFrames.

Whatever isn't understood raises ValueError; no part of a query is passed over.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.graph import NS, TYPE, Triples

PREFIXES = {"": NS, "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#"}

_TOKEN = re.compile(
    r"""(?P<skip>\s+|\#[^\n]*)|(?P<iri><[^<>"{}|^`\\\s]*>)|(?P<string>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')|(?P<var>[?$]\w+)
    |(?P<number>[+-]?\d+(?:\.\d+)?)|(?P<name>(?:[A-Za-z][\w-]*)?:(?:[\w][\w.-]*[\w-]|\w)?)|(?P<word>[A-Za-z_]\w*)|(?P<mark>\^\^|&&|\|\||!=|<=|>=|[{}().,;/^*=<>!+-]|@[A-Za-z-]+)""",
    re.X,
)
_ESCAPES = {"\\n": "\n", "\\t": "\t", "\\r": "\r", '\\"': '"', "\\'": "'", "\\\\": "\\"}


@dataclass(frozen=True)
class Term:
    """A variable (kind var), an IRI or a literal; numbers are literals with ``number`` set."""

    kind: str
    value: str
    number: bool = False


@dataclass
class Group:
    """Parts of a group in order: ('triple', s, path, o), ('optional', group), ('filter', expression), ('bind', expression, name)."""

    parts: list[tuple] = field(default_factory=list)


@dataclass
class Query:
    form: str
    distinct: bool
    columns: list[tuple[str, tuple | None]]
    where: Group
    group_by: list[str]
    having: list[tuple]
    order_by: list[tuple[tuple, bool]]
    limit: int | None
    offset: int


AGGREGATES = ("COUNT", "SUM", "MIN", "MAX", "AVG", "GROUP_CONCAT")
#: Functions with the number of their arguments.
FUNCTIONS = {"STR": 1, "STRSTARTS": 2, "STRENDS": 2, "CONTAINS": 2, "LCASE": 1, "UCASE": 1, "STRLEN": 1, "BOUND": 1, "REGEX": 2, "ABS": 1, "COALESCE": None, "CONCAT": None, "IF": 3}


def tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if m is None:
            raise ValueError(f"unexpected character {text[at]!r}")
        if m.lastgroup != "skip":
            out.append((m.lastgroup, m[0]))
        at = m.end()
    return out


class Parser:
    def __init__(self, text: str) -> None:
        self.rest = tokens(text)[::-1]
        self.prefixes = dict(PREFIXES)

    def peek(self) -> str:
        """The next token; words in upper case."""
        if not self.rest:
            return ""
        kind, text = self.rest[-1]
        return text.upper() if kind == "word" else text

    def take(self, *wanted: str) -> str:
        got = self.peek()
        if not got or wanted and got not in wanted:
            raise ValueError(f"expected {' or '.join(wanted) or 'more'}, found {got or 'the end'}")
        return self.rest.pop()[1] if not wanted else (self.rest.pop(), got)[1]

    def kind(self) -> str:
        return self.rest[-1][0] if self.rest else ""

    def maybe(self, *wanted: str) -> bool:
        if self.peek() in wanted and self.kind() not in ("string",):
            self.rest.pop()
            return True
        return False

    # -- terms --
    def iri(self) -> Term:
        kind, text = self.kind(), self.take()
        if kind == "iri":
            full = text[1:-1]
        elif kind == "name":
            prefix, local = text.split(":", 1)
            if prefix not in self.prefixes:
                raise ValueError(f"prefix {prefix}: isn't declared")
            full = self.prefixes[prefix] + local
        else:
            raise ValueError(f"expected an IRI, found {text}")
        if full == self.prefixes["rdf"] + "type":
            return Term("iri", TYPE)
        return Term("iri", full[len(NS) :] if full.startswith(NS) and len(full) > len(NS) else full)

    def term(self) -> Term:
        kind = self.kind()
        if kind == "var":
            return Term("var", self.take()[1:])
        if kind == "number":
            return Term("literal", self.take(), True)
        if kind == "string":
            raw = self.take()[1:-1]
            value = re.sub(r"\\.", lambda m: _ESCAPES.get(m[0], m[0]), raw)
            if self.kind() == "mark" and self.peek().startswith("@"):
                self.take()
            elif self.maybe("^^"):
                self.iri()
            return Term("literal", value)
        return self.iri()

    # -- patterns --
    def group(self) -> Group:
        self.take("{")
        out = Group()
        while not self.maybe("}"):
            word = self.peek() if self.kind() == "word" else ""
            if word == "OPTIONAL":
                self.take()
                out.parts.append(("optional", self.group()))
            elif word == "FILTER":
                self.take()
                out.parts.append(("filter", self.constraint()))
            elif word == "BIND":
                self.take(), self.take("(")
                e = self.expression()
                self.take("AS")
                out.parts.append(("bind", e, self.variable()))
                self.take(")")
            elif self.peek() == "{":
                out.parts.extend(self.group().parts)
            elif word:
                raise ValueError(f"{word} is outside the supported subset")
            else:
                self.triples(out)
            self.maybe(".")
        return out

    def triples(self, out: Group) -> None:
        s = self.term()
        while True:
            path = self.path()
            while True:
                out.parts.append(("triple", s, path, self.term()))
                if not self.maybe(","):
                    break
            if not self.maybe(";"):
                return
            if self.peek() in (".", "}"):
                return

    def path(self) -> list[tuple[Term, bool]]:
        """Steps (property or variable, backwards)."""
        if self.kind() == "var":
            return [(self.term(), False)]
        steps = []
        while True:
            back = self.maybe("^")
            steps.append((Term("iri", TYPE), back) if self.kind() == "word" and self.take("A") else (self.iri(), back))
            if not self.maybe("/"):
                return steps

    def variable(self) -> str:
        if self.kind() != "var":
            raise ValueError(f"expected a variable, found {self.peek()}")
        return self.take()[1:]

    # -- expressions: nested tuples (operator, arguments...) or ('term', Term) --
    def constraint(self) -> tuple:
        return self.primary()

    def expression(self) -> tuple:
        return self.chain(("||",), lambda: self.chain(("&&",), self.comparison))

    def chain(self, ops: tuple[str, ...], below: Callable[[], tuple]) -> tuple:
        left = below()
        while self.kind() == "mark" and self.peek() in ops:
            left = (self.take(), left, below())
        return left

    def comparison(self) -> tuple:
        left = self.chain(("+", "-"), self.primary)
        if self.kind() == "mark" and self.peek() in ("=", "!=", "<", ">", "<=", ">="):
            return (self.take(), left, self.chain(("+", "-"), self.primary))
        return left

    def primary(self) -> tuple:
        if self.maybe("!"):
            return ("!", self.primary())
        if self.maybe("("):
            e = self.expression()
            self.take(")")
            return e
        if self.kind() != "word":
            # A prefix alone, as in STR(tafsir:), is the IRI of its namespace.
            return ("term", self.term())
        name = self.take().upper()
        if name in ("TRUE", "FALSE"):
            return ("bool", name == "TRUE")
        self.take("(")
        if name in AGGREGATES:
            distinct = self.maybe("DISTINCT")
            of = None if self.maybe("*") else self.expression()
            if of is None and name != "COUNT":
                raise ValueError(f"{name}(*) isn't known")
            separator = " "
            if name == "GROUP_CONCAT" and self.maybe(";"):
                self.take("SEPARATOR"), self.take("=")
                separator = self.term().value
            self.take(")")
            return ("aggregate", name, distinct, of, separator)
        if name not in FUNCTIONS:
            raise ValueError(f"{name} is outside the supported subset")
        args = [self.expression()]
        while self.maybe(","):
            args.append(self.expression())
        self.take(")")
        if FUNCTIONS[name] is not None and len(args) != FUNCTIONS[name]:
            raise ValueError(f"{name} takes {FUNCTIONS[name]} arguments")
        return (name, *args)

    # -- the whole --
    def query(self) -> Query:
        while self.kind() == "word" and self.peek() == "PREFIX":
            self.take()
            name = self.take()
            if not name.endswith(":") or self.kind() != "iri":
                raise ValueError("PREFIX takes a name with a colon and an IRI")
            self.prefixes[name[:-1]] = self.take()[1:-1]
        form = self.peek() if self.kind() == "word" else ""
        if form not in ("SELECT", "ASK"):
            raise ValueError("only SELECT and ASK queries are supported")
        self.take()
        distinct, columns = False, []
        if form == "SELECT":
            distinct = self.maybe("DISTINCT")
            while self.kind() == "var" or self.peek() in ("(", "*"):
                if self.maybe("*"):
                    columns.append(("*", None))
                elif self.maybe("("):
                    e = self.expression()
                    self.take("AS")
                    columns.append((self.variable(), e))
                    self.take(")")
                else:
                    columns.append((self.variable(), None))
            if not columns:
                raise ValueError("nothing is selected")
        self.maybe("WHERE")
        where = self.group()
        group_by, having, order_by, limit, offset = [], [], [], None, 0
        while self.rest:
            word = self.take().upper()
            if word == "GROUP":
                self.take("BY")
                while self.kind() == "var":
                    group_by.append(self.variable())
            elif word == "HAVING":
                having.append(self.primary())
            elif word == "ORDER":
                self.take("BY")
                while self.kind() == "var" or self.peek() in ("ASC", "DESC", "("):
                    down = self.peek() == "DESC"
                    if self.peek() in ("ASC", "DESC"):
                        self.take()
                    order_by.append((self.primary(), down))
            elif word in ("LIMIT", "OFFSET") and self.kind() == "number":
                n = int(self.take())
                limit, offset = (n, offset) if word == "LIMIT" else (limit, n)
            else:
                raise ValueError(f"{word} is outside the supported subset")
        return Query(form, distinct, columns, where, group_by, having, order_by, limit, offset)


def parse(text: str) -> Query:
    return Parser(text).query()


# -- translation --
def _number(c: Column) -> Column:
    return c.try_cast("double")


def compiled(e: tuple, aggregates: dict[tuple, Column] | None = None) -> tuple[Column, str]:
    """Column of an expression and what it is: str, num or bool."""
    op, *args = e
    if op == "term":
        t = args[0]
        return (F.col(f"`{t.value}`") if t.kind == "var" else F.lit(t.value)), "num" if t.number else "str"
    if op == "bool":
        return F.lit(args[0]), "bool"
    if op == "aggregate":
        if aggregates is None:
            raise ValueError("an aggregate can't stand here")
        return aggregates[e], "str" if args[0] in ("GROUP_CONCAT", "MIN", "MAX") else "num"
    cols = [compiled(a, aggregates) for a in args]
    text = lambda i: cols[i][0].cast("string")
    num = lambda i: _number(cols[i][0]) if cols[i][1] == "str" or args[i][0] == "term" else cols[i][0]
    if op in ("&&", "||", "!"):
        if any(k != "bool" for _, k in cols):
            raise ValueError(f"{op} takes conditions")
        return (~cols[0][0] if op == "!" else cols[0][0] & cols[1][0] if op == "&&" else cols[0][0] | cols[1][0]), "bool"
    if op in ("=", "!=", "<", ">", "<=", ">="):
        compare = {"=": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b}[op]
        if "num" in (cols[0][1], cols[1][1]):
            return compare(num(0), num(1)), "bool"
        both = F.coalesce(compare(_number(text(0)), _number(text(1))), compare(text(0), text(1)))
        return (compare(text(0), text(1)) if op in ("=", "!=") else both), "bool"
    if op in ("+", "-"):
        return (num(0) + num(1) if op == "+" else num(0) - num(1)), "num"
    if op == "BOUND":
        return cols[0][0].isNotNull(), "bool"
    if op == "STRSTARTS":
        return F.startswith(text(0), text(1)), "bool"
    if op == "STRENDS":
        return F.endswith(text(0), text(1)), "bool"
    if op == "CONTAINS":
        return F.contains(text(0), text(1)), "bool"
    if op == "REGEX":
        return F.regexp_like(text(0), text(1)), "bool"
    if op == "IF":
        return F.when(cols[0][0], cols[1][0]).otherwise(cols[2][0]), cols[1][1]
    one = {"STR": lambda: text(0), "LCASE": lambda: F.lower(text(0)), "UCASE": lambda: F.upper(text(0)), "COALESCE": lambda: F.coalesce(*[c for c, _ in cols]), "CONCAT": lambda: F.concat(*[text(i) for i in range(len(cols))])}
    if op in one:
        return one[op](), "str"
    return (F.char_length(text(0)) if op == "STRLEN" else F.abs(num(0))), "num"


def variables(e: tuple) -> set[str]:
    if e[0] == "term":
        return {e[1].value} if e[1].kind == "var" else set()
    return set().union(*(variables(a) for a in e[1:] if isinstance(a, tuple)), set())


def found_aggregates(e: tuple | None) -> list[tuple]:
    if not e or e[0] in ("term", "bool"):
        return []
    return [e] if e[0] == "aggregate" else [x for a in e[1:] if isinstance(a, tuple) for x in found_aggregates(a)]


class Evaluator:
    """Solutions of groups over a graph; ``loose`` are variables that an OPTIONAL may have left unbound."""

    def __init__(self, graph: Triples) -> None:
        self.graph, self.fresh = graph, 0

    def pattern(self, s: Term, p: Term, back: bool, o: Term) -> tuple[DataFrame, set[str]]:
        if back:
            s, o = o, s
        rows = self.graph.of(p.value, o.value if p.value == TYPE and o.kind == "iri" else None) if p.kind == "iri" else self.graph.all()
        names: dict[str, str] = {}
        for column, t in (("s", s), ("p", p), ("o", o)):
            if t.kind == "var":
                if t.value in names:
                    rows = rows.where(F.col(column) == F.col(names[t.value]))
                else:
                    names[t.value] = column
            elif column != "p":
                rows = rows.where(F.col(column) == t.value)
                if column == "o":
                    rows = rows.where(F.col("kind") == t.kind)
        return rows.select(*[F.col(c).alias(v) for v, c in names.items()]), set(names)

    def basic(self, triples: list[tuple]) -> list[tuple[Term, Term, bool, Term]]:
        """Paths taken apart into single steps."""
        out = []
        for _, s, path, o in triples:
            for step, back in path[:-1]:
                self.fresh += 1
                middle = Term("var", f"_path{self.fresh}")
                out.append((s, step, back, middle))
                s = middle
            out.append((s, *path[-1], o))
        return out

    def solve(self, group: Group, out: DataFrame | None = None, bound: frozenset = frozenset(), loose: frozenset = frozenset()) -> tuple[DataFrame, frozenset, frozenset]:
        todo: list[tuple] = []
        filters: list[tuple] = []

        def join_basic() -> None:
            nonlocal out, bound
            steps = self.basic(todo)
            todo.clear()
            while steps:
                # The next step shares a variable with what is bound, so no product arises.
                has = lambda t: {x.value for x in (t[0], t[1], t[3]) if x.kind == "var"}
                k = next((i for i, t in enumerate(steps) if has(t) & bound), None) if out is not None else 0
                if k is None:
                    k = next((i for i, t in enumerate(steps) if not has(t)), None)
                    if k is None:
                        raise ValueError("patterns that share no variable with the others aren't supported")
                rows, names = self.pattern(*steps.pop(k))
                shared = sorted(names & bound)
                if set(shared) & loose:
                    raise ValueError("a variable that may be unbound can't be joined")
                if not names:
                    there = rows.limit(1).select(F.lit(1).alias("_there"))
                    out = there if out is None else out.join(F.broadcast(there), how="left_semi")
                else:
                    out = rows if out is None else out.join(rows, shared)
                bound |= names

        for part in group.parts:
            if part[0] == "triple":
                todo.append(part)
                continue
            if part[0] == "filter":
                filters.append(part[1])
                continue
            join_basic()
            if out is None:
                raise ValueError("a group must begin with a pattern")
            if part[0] == "bind":
                if part[2] in bound:
                    raise ValueError(f"?{part[2]} is bound already")
                out = out.withColumn(part[2], compiled(part[1])[0].cast("string"))
                bound |= {part[2]}
                loose |= {part[2]} if variables(part[1]) & loose else frozenset()
            else:
                extra, names, also = Evaluator.solve(self, part[1])
                shared = sorted(names & bound)
                if not shared:
                    raise ValueError("an OPTIONAL that shares no variable with what precedes isn't supported")
                if set(shared) & (loose | also):
                    raise ValueError("a variable that may be unbound can't be joined")
                out = out.join(extra, shared, "left")
                loose |= (names - bound) | also
                bound |= names
        join_basic()
        if out is None:
            raise ValueError("an empty group isn't supported")
        for e in filters:  # a filter holds for its whole group
            if not variables(e) <= bound:
                raise ValueError("a FILTER uses a variable that its group doesn't bind")
            cond, kind = compiled(e)
            if kind != "bool":
                raise ValueError("a FILTER takes a condition")
            out = out.where(cond)
        return out, bound, loose


def _aggregate(e: tuple) -> Column:
    _, name, distinct, of, separator = e
    if of is None:
        return F.count("*")
    c, kind = compiled(of)
    n = _number(c) if kind == "str" else c
    text = c.cast("string")
    return {
        "COUNT": lambda: F.count_distinct(c) if distinct else F.count(c), "SUM": lambda: F.sum_distinct(n) if distinct else F.sum(n), "AVG": lambda: F.avg(n),
        "MIN": lambda: F.min(F.struct(_number(text).alias("n"), text.alias("t")))["t"], "MAX": lambda: F.max(F.struct(_number(text).alias("n"), text.alias("t")))["t"],
        "GROUP_CONCAT": lambda: F.array_join(F.array_sort(F.collect_set(text) if distinct else F.collect_list(text)), separator),
    }[name]()


def select(graph: Triples | DataFrame, query: str) -> DataFrame:
    """The solutions of a SELECT query, a column (string; counts and sums are numbers) for each variable; ASK gives one row ``answer``.

    Supported: basic patterns with ``;``, ``,`` and paths of ``/`` and ``^``; nested OPTIONAL; FILTER with comparisons,
    logic and the functions in FUNCTIONS; BIND; DISTINCT; GROUP BY, HAVING, aggregates; ORDER BY (numbers before texts,
    by value), LIMIT and OFFSET.  Ties are put in order of the columns.  GROUP_CONCAT is in order of its texts.
    """
    q = parse(query)
    rows, bound, _ = Evaluator(graph if isinstance(graph, Triples) else Triples.of_table(graph)).solve(q.where)
    if q.form == "ASK":
        return rows.agg((F.count("*") > 0).alias("answer"))
    columns = [(v, None) for v in sorted(x for x in bound if not x.startswith("_path"))] if q.columns == [("*", None)] else q.columns
    used = [a for e in [*(e for _, e in columns), *q.having, *(e for e, _ in q.order_by)] for a in found_aggregates(e)]
    plain = {v for v, e in columns if e is None}
    if not plain | set().union(*(variables(e) for _, e in columns if e is not None), set()) <= bound:
        raise ValueError("a variable that isn't bound is selected")
    aggregates = None
    if used or q.group_by:
        if not plain <= set(q.group_by):
            raise ValueError("a variable outside GROUP BY is selected")
        aggregates = {a: F.col(f"_agg{i}") for i, a in enumerate(dict.fromkeys(used))}
        rows = rows.groupBy(*q.group_by).agg(*[_aggregate(a).alias(f"_agg{i}") for i, a in enumerate(aggregates)] or [F.count("*").alias("_n")])
        for e in q.having:
            rows = rows.where(compiled(e, aggregates)[0])
    elif q.having:
        raise ValueError("HAVING without groups")
    for v, e in columns:
        if e is not None:
            rows = rows.withColumn(v, compiled(e, aggregates)[0])
    names = [v for v, _ in columns]
    keys = []
    for e, down in q.order_by:
        c, kind = compiled(e, aggregates)
        if e[0] == "term" and e[1].kind == "var":
            kind = "str" if rows.schema[e[1].value].dataType.simpleString() == "string" else "num"
        for k in [_number(c.cast("string")), c] if kind == "str" else [c]:  # texts that are numbers by their value
            keys.append(k.desc_nulls_last() if down else k.asc_nulls_last())
    if q.distinct:
        if not set().union(*(variables(e) for e, _ in q.order_by), set()) <= set(names):
            raise ValueError("DISTINCT rows are ordered by what isn't selected")
        rows = rows.select(*names).distinct()
    if q.order_by or q.limit is not None or q.offset:
        rows = rows.orderBy(*keys, *[F.col(f"`{n}`").asc_nulls_first() for n in names])
    out = rows.select(*names)
    if q.offset:
        out = out.offset(q.offset)
    return out if q.limit is None else out.limit(q.limit)


def page(graph: Triples | DataFrame, query: str, cap: int = 500) -> tuple[DataFrame, int]:
    """The first ``cap`` rows of a query's result, and the number of all its rows."""
    rows = select(graph, query)
    return rows.limit(cap), rows.count()
