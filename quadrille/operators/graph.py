"""Graph and Dataset handles: build, match, query and update sets of triples.

A handle is a Python object over a lazy source; changing it replaces the source. Every
change is planned in full before the handle moves, so a failing one leaves it untouched.
After some changes the triples are written once, so plans do not grow with their number.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import values as V
from ..functions.builtins import Scope
from ..namespaces import Namespaces
from ..plans.algebra import Evaluator
from ..plans.solutions import Solutions, hidden
from ..plans.syntax import Group, Param, Query, Update, parse_expression, parse_query, parse_triples, parse_update
from ..sources.mapping import Mapping, Table
from ..sources.shared import settle
from ..sources.triples import SCHEMA, TripleTable, equals
from ..terms import ANY, Blank, Iri, Variable, node, term_of
from .bindings import as_solutions
from .template import Template, instantiate

#: Changes after which a graph's triples are written down.
SETTLE_AFTER = 8


class Match:
    """Lazy solutions of a pattern; iterable, truthy if there is one."""

    def __init__(self, graph: Graph, text: str, ns: Namespaces, bindings=None, params: dict | None = None):
        self.graph, self.text, self.ns, self.bindings, self.params = graph, text, ns, bindings, params or {}
        self.triples = parse_triples(text, ns)
        seen = [t.name for x in self.triples for t in x if isinstance(t, Variable)]
        self.names = list(dict.fromkeys(seen))

    def __call__(self, graph: Graph | None = None, bindings=None) -> Match:
        return Match(graph or self.graph, self.text, self.ns, bindings if bindings is not None else self.bindings, self.params)

    def solutions(self) -> Solutions:
        """All solutions; blank nodes of the pattern are hidden variables, initial bindings are included."""
        spark = self.graph.spark
        found = Evaluator(spark, self.graph.source, params=self.params).basic(self.triples)
        if self.bindings is not None:
            given = as_solutions(spark, self.bindings)
            given = replace(given, maybe=frozenset(n for n in given.maybe if n in given.specs))
            found = found.join(given)
        return found

    def projected(self) -> Solutions:
        """The pattern's variables in order of first appearance."""
        sols = self.solutions()
        extra = [n for n in sols.names if n not in self.names and not hidden(n)]
        return sols.project([*self.names, *extra])

    def frame(self, **casts: str) -> DataFrame:
        return self.projected().frame(**casts)

    def where(self, expression: str, **params) -> Solutions:
        """Solutions that an expression is true of."""
        sols = self.projected()
        e = parse_expression(expression, self.ns)
        return sols.where(Scope(sols.values(), {**self.params, **params}).truth(e))

    def distinct(self) -> DataFrame:
        return self.projected().distinct().frame()

    def count(self) -> int:
        return self.solutions().df.count()

    def __bool__(self) -> bool:
        return not self.solutions().df.isEmpty()

    def __len__(self):
        raise TypeError("a match is lazy; use count()")

    def _rows(self, limit: int | None = None) -> list:
        df = self.projected().terms()
        out = []
        for row in (df.limit(limit) if limit else df).collect():
            terms = [term_of(c) for c in row]
            out.append(terms[0] if len(terms) == 1 else tuple(terms) if not self.names else dict(zip(df.columns, terms, strict=True)))
        return out

    def __iter__(self):
        return iter(self._rows())

    def first(self, default=None):
        found = self._rows(1)
        return found[0] if found else default

    def one(self):
        found = self._rows(2)
        if len(found) != 1:
            raise ValueError("expected one solution, found " + ("none" if not found else "more"))
        return found[0]


class Result:
    """A query's result: rows (``frame``, ``terms``), a truth value, or a ``graph``."""

    def __init__(self, form: str, solutions: Solutions | None = None, graph: Graph | None = None):
        self.form, self.solutions, self.graph = form, solutions, graph

    def frame(self, **casts: str) -> DataFrame:
        if self.form == "ASK":
            return self.ask_frame()
        return self.graph.triples() if self.graph is not None else self.solutions.frame(**casts)

    def ask_frame(self, name: str = "result") -> DataFrame:
        """One row with the truth value."""
        return self.solutions.df.select(F.lit(1).alias("x")).limit(1).agg((F.count("x") > 0).alias(name))

    def __bool__(self) -> bool:
        if self.graph is not None:
            return bool(self.graph)
        return not self.solutions.df.isEmpty()

    def __iter__(self):
        names = self.solutions.visible()
        return iter([dict(zip(names, map(term_of, row), strict=True)) for row in self.solutions.terms().collect()])


class Prepared:
    """A parsed query, run on any graph with any parameters."""

    def __init__(self, text: str, ns: Namespaces | None = None, **params):
        self.text, self.ns, self.params = text, ns or Namespaces(), params
        self.query: Query = parse_query(text, self.ns)

    def __call__(self, graph, bindings=None, **params) -> Result:
        return run_query(graph, self.query, bindings, {**self.params, **params})


def run_query(graph, q: Query, bindings=None, params: dict | None = None) -> Result:
    """Evaluate a query over a Graph or Dataset."""
    spark = graph.spark
    default, named = graph.scopes()
    if q.sources:
        ids = lambda flag: [t.value for n, t in q.sources if n == flag]
        known = {**named, **({graph.identifier: default} if getattr(graph, "identifier", None) else {})}
        missing = [i for i in ids(False) + ids(True) if i not in known]
        if missing:
            raise ValueError(f"no graph <{missing[0]}>: FROM reads registered graphs only")
        merged = None
        for i in ids(False):
            rows = known[i].triples()
            merged = rows if merged is None else merged.unionAll(rows)
        default = TripleTable(merged) if merged is not None else default.empty()
        named = {i: known[i] for i in ids(True)}
    ev = Evaluator(spark, default, named, params)
    outer = as_solutions(spark, bindings) if bindings is not None else None
    if q.form == "SELECT":
        return Result("SELECT", ev.select(q, outer))
    sols = ev.select(replace(q, project=None, distinct=False), outer) if q.where.elements or outer is not None else Solutions.unit(spark)
    if q.form == "ASK":
        return Result("ASK", sols)
    if q.form == "CONSTRUCT":
        return Result("CONSTRUCT", graph=Graph(spark, TripleTable(instantiate(q.template, sols, params))))
    return Result("DESCRIBE", graph=Graph(spark, describe(ev, default, q, sols, params)))


def describe(ev: Evaluator, source, q: Query, sols: Solutions, params: dict | None) -> TripleTable:
    """Triples of each resource, and those of the blank nodes they lead to."""
    names = [t.name for t in q.describe if isinstance(t, Variable)] or ([] if q.describe else sols.visible())
    found = None
    for term in [t for t in q.describe if not isinstance(t, Variable)]:
        one = ev.spark.range(1).select(V.const(node((params or {})[term.name]) if isinstance(term, Param) else term).term().alias("s"))
        found = one if found is None else found.unionAll(one)
    for n in names:
        one = sols.df.select(sols.value(n).term().alias("s")).where("s.k < 2")
        found = one if found is None else found.unionAll(one)
    rows = source.triples()
    new = settle(found.distinct(), "described")
    every = new
    out = None
    while not new.isEmpty():
        part = settle(rows.join(new, "s", "left_semi").select("s", "p", "o"), "described")
        out = part if out is None else out.unionAll(part)
        blanks = part.where("o.k = 1").select(F.col("o").alias("s")).distinct()
        new = settle(blanks.join(every, "s", "left_anti"), "described")
        every = every.unionAll(new)
    return TripleTable(out if out is not None else source.empty().triples())


class Graph:
    """A set of triples with an optional name and prefixes."""

    def __init__(self, spark: SparkSession, source, identifier: str | None = None, ns: Namespaces | None = None):
        self.spark, self.source, self.identifier, self.ns = spark, source, identifier, ns or Namespaces()
        self._changes = 0

    # -- making
    @classmethod
    def empty(cls, spark: SparkSession, identifier: str | None = None, ns: Namespaces | None = None) -> Graph:
        return cls(spark, TripleTable(spark.createDataFrame([], SCHEMA), True), identifier, ns)

    @classmethod
    def from_triples(cls, df: DataFrame, identifier: str | None = None, ns: Namespaces | None = None, distinct: bool = False) -> Graph:
        return cls(df.sparkSession, TripleTable(df.select("s", "p", "o"), distinct), identifier, ns)

    @classmethod
    def from_terms(cls, spark: SparkSession, triples, ns: Namespaces | None = None) -> Graph:
        return cls(spark, TripleTable.of_terms(spark, triples), None, ns)

    @classmethod
    def from_tables(cls, tables: list[Table], ns: Namespaces | None = None) -> Graph:
        """A virtual graph: queries read the tables."""
        source = Mapping(tables)
        return cls(source.spark, source, None, ns)

    @classmethod
    def parse(cls, spark: SparkSession, turtle: str, ns: Namespaces | None = None) -> Graph:
        """Turtle text, parsed on the driver."""
        from ..sources.rdf_text import read_turtle

        triples, found = read_turtle(turtle, ns or Namespaces())
        return cls.from_terms(spark, triples, found)

    # -- prefixes
    def designate(self, ns: Namespaces) -> Graph:
        """Add prefixes; the graph's own entries win."""
        self.ns = self.ns.merged(ns)
        return self

    def bind(self, prefix: str, iri: str, override: bool = True) -> Graph:
        self.ns = self.ns.bind(prefix, iri, override)
        return self

    # -- reading
    def scopes(self):
        return self.source, ({self.identifier: self.source} if self.identifier else {})

    def triples(self) -> DataFrame:
        """Distinct triples."""
        rows = self.source.triples()
        return rows if isinstance(self.source, TripleTable) else rows.distinct()

    def count(self) -> int:
        return self.triples().count()

    __len__ = count

    def __bool__(self) -> bool:
        return not self.source.triples().isEmpty()

    def __iter__(self):
        return iter([tuple(map(term_of, r)) for r in self.triples().collect()])

    def __contains__(self, triple) -> bool:
        pattern = [Variable(f"__any{i}") if t is None or t is ANY else t for i, t in enumerate(triple)]
        return not self.source.match([tuple(pattern)]).df.isEmpty()

    def match(self, text: str, ns: Namespaces | None = None, bindings=None, **params) -> Match:
        return Match(self, text, ns or self.ns, bindings, params)

    def query(self, text: str, ns: Namespaces | None = None, bindings=None, **params) -> Result:
        """SPARQL; parameters are bound as terms, bindings are joined to the solutions."""
        return run_query(self, parse_query(text, ns or self.ns), bindings, params)

    def values(self, s=ANY, p=ANY, o=ANY) -> DataFrame:
        """Triples with the given terms."""
        rows = self.triples()
        for name, term in (("s", s), ("p", p), ("o", o)):
            rows = rows if term is ANY else rows.where(equals(F.col(name), node(term)))
        return rows

    def subjects(self, p=ANY, o=ANY) -> DataFrame:
        return self.values(ANY, p, o).select("s").distinct()

    def objects(self, s=ANY, p=ANY) -> DataFrame:
        return self.values(s, p, ANY).select("o").distinct()

    def value(self, s=ANY, p=ANY, default=None):
        found = self.objects(s, p).take(1)
        return term_of(found[0][0]) if found else default

    # -- algebra
    def _with(self, df: DataFrame, distinct: bool = False) -> Graph:
        return Graph(self.spark, TripleTable(df, distinct), None, self.ns)

    def __add__(self, other: Graph) -> Graph:
        return self._with(self.source.triples().unionAll(other.source.triples()))

    def __radd__(self, other) -> Graph:
        return self if other == 0 else other + self

    def __sub__(self, other: Graph) -> Graph:
        return self._with(without(self.triples(), other.triples()), True)

    def __mul__(self, other: Graph) -> Graph:
        return self._with(self.triples().join(other.triples(), ["s", "p", "o"], "left_semi"), True)

    def __iadd__(self, other: Graph) -> Graph:
        return self._change(self.source.triples().unionAll(other.source.triples()))

    def __isub__(self, other: Graph) -> Graph:
        return self._change(without(self.triples(), other.triples()), True)

    def _change(self, df: DataFrame, distinct: bool = False) -> Graph:
        self._changes += 1
        if self._changes >= SETTLE_AFTER:
            df, distinct, self._changes = settle(df if distinct else df.distinct(), "graph"), True, 0
        self.source = TripleTable(df, distinct)
        return self

    # -- writing
    def add(self, template, bindings=None, **params) -> Graph:
        """Add a template's triples, for every row of ``bindings``; triples with an unbound term are left out."""
        made = template if isinstance(template, Template) else Template(template, self.ns)
        if bindings is None and made.variables:
            raise ValueError(f"no bindings for ?{made.variables[0]}")
        df = made.instantiate(bindings if bindings is not None else {}, self.spark, **params)
        return self._change(self.source.triples().unionAll(df))

    def remove(self, text: str, bindings=None, **params) -> Graph:
        """Remove what a pattern matches.

        One triple: each variable, blank node and ANY is a wildcard of its own. Several with
        variables: the pattern's solutions give the triples to remove. Several without: each.
        """
        triples = parse_triples(text, self.ns)
        rows = self.triples()
        given = as_solutions(self.spark, bindings) if bindings is not None else None
        wild = lambda t: isinstance(t, Variable | Blank) or (isinstance(t, Param) and params.get(t.name) is ANY)
        if len(triples) == 1 and given is None:
            cond = F.lit(True)
            scope = Scope({}, params)
            for name, term in zip("spo", triples[0], strict=True):
                cond = cond if wild(term) else cond & F.coalesce(F.col(name) == scope.value(term).term(), F.lit(False))
            return self._change(rows.where(~cond), True)
        if not any(wild(t) for x in triples for t in x):
            gone = instantiate(triples, given if given is not None else Solutions.unit(self.spark), params)
            return self._change(without(rows, gone), True)
        # Wildcards and blank nodes become variables, so that what they matched can be removed.
        count = iter(range(10**6))
        labels: dict = {}

        def named(t):
            if isinstance(t, Blank):
                return labels.setdefault(t.label, Variable(f"__gone{next(count)}"))
            return Variable(f"__gone{next(count)}") if not isinstance(t, Variable) and wild(t) else t

        pattern = [tuple(named(t) for t in x) for x in triples]
        found = Evaluator(self.spark, self.source, params=params).basic(pattern)
        found = found.join(given) if given is not None else found
        return self._change(without(rows, instantiate(pattern, found, params)), True)

    def update(self, text: str, ns: Namespaces | None = None, **params) -> Graph:
        """SPARQL update on this graph."""
        data = Dataset(self.spark, self, {})
        data.update(text, ns or self.ns, **params)
        if data.default.source is not self.source:
            self._change(data.default.triples(), True)
        return self

    # -- files
    def save(self, path: str, files_per_predicate: bool = True) -> None:
        """Parquet, with a folder per predicate, so that patterns read the folders they name."""
        rows = self.triples().withColumn("p_key", F.col("p.v"))
        writer = rows.write.mode("overwrite")
        (writer.partitionBy("p_key") if files_per_predicate else writer).parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str, ns: Namespaces | None = None) -> Graph:
        return cls(spark, Stored(spark.read.parquet(path)), None, ns)

    def write_ntriples(self, path: str) -> None:
        from ..sources.rdf_text import ntriples

        ntriples(self.triples()).write.mode("overwrite").text(path)

    @classmethod
    def read_ntriples(cls, spark: SparkSession, path: str, ns: Namespaces | None = None) -> Graph:
        from ..sources.rdf_text import read_ntriples

        return cls(spark, TripleTable(read_ntriples(spark, path)), None, ns)

    def turtle(self) -> str:
        """Turtle text with the graph's prefixes; collects the graph."""
        from ..sources.rdf_text import write_turtle

        return write_turtle(list(self), self.ns)

    def print(self) -> None:
        print(self.turtle())


class Stored(TripleTable):
    """Triples of ``Graph.save``: a constant predicate prunes folders."""

    def __init__(self, df: DataFrame):
        super().__init__(df, True)

    def triples(self) -> DataFrame:
        return self.df.select("s", "p", "o")

    def pattern(self, s, p, o) -> Solutions:
        whole = self.df
        try:
            if isinstance(p, Iri) and "p_key" in whole.columns:
                self.df = whole.where(F.col("p_key") == p.value)
            return super().pattern(s, p, o)
        finally:
            self.df = whole


def without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    return rows.join(gone.select("s", "p", "o").distinct(), ["s", "p", "o"], "left_anti")


class Dataset:
    """A default graph and named graphs."""

    def __init__(self, spark: SparkSession, default: Graph | None = None, named: dict[str, Graph] | None = None):
        self.spark = spark
        self.default = default or Graph.empty(spark)
        self.named = dict(named or {})
        self.ns = self.default.ns
        self.identifier = None

    def scopes(self):
        return self.default.source, {k: g.source for k, g in self.named.items()}

    def query(self, text: str, ns: Namespaces | None = None, bindings=None, **params) -> Result:
        return run_query(self, parse_query(text, ns or self.ns), bindings, params)

    def quads(self) -> DataFrame:
        """g (NULL: the default graph), s, p, o."""
        out = self.default.triples().select(F.lit(None).cast("string").alias("g"), "s", "p", "o")
        for name, graph in self.named.items():
            out = out.unionAll(graph.triples().select(F.lit(name).alias("g"), "s", "p", "o"))
        return out

    def update(self, text: str, ns: Namespaces | None = None, **params) -> Dataset:
        """Each operation sees the data as the one before left it, and its own WHERE before it changes any."""
        for u in parse_update(text, ns or self.ns):
            self._run(u, params)
        return self

    def _targets(self, which) -> list[str | None]:
        if which == "DEFAULT":
            return [None]
        if which == "NAMED":
            return list(self.named)
        return [None, *self.named] if which == "ALL" else [which.value]

    def _get(self, name: str | None) -> Graph:
        if name is None:
            return self.default
        return self.named.get(name) or Graph.empty(self.spark, name)

    def _put(self, name: str | None, graph: Graph) -> None:
        if name is None:
            self.default = graph
        else:
            self.named[name] = graph

    def _run(self, u: Update, params: dict) -> None:
        if u.kind in ("CLEAR", "DROP"):
            for name in self._targets(u.args[0]):
                if name is not None and u.kind == "DROP":
                    self.named.pop(name, None)
                else:
                    self._put(name, Graph.empty(self.spark, name, self.ns))
        elif u.kind == "CREATE":
            self.named.setdefault(u.args[0].value, Graph.empty(self.spark, u.args[0].value))
        elif u.kind in ("COPY", "MOVE", "ADD"):
            source, target = (self._targets(a)[0] for a in u.args)
            if source == target:
                return
            moved = self._get(source).triples()
            rows = self._get(target).triples().unionAll(moved) if u.kind == "ADD" else moved
            self._put(target, Graph.from_triples(rows, target, self.ns))
            if u.kind == "MOVE":
                self._run(Update("DROP", args=(u.args[0] if source is not None else "DEFAULT",)), params)
        else:
            self._modify(u, params)

    def _modify(self, u: Update, params: dict) -> None:
        default, named = self.scopes()
        if u.with_graph is not None:
            default = self._get(u.with_graph.value).source
        if u.using:
            rows = [self._get(t.value).triples() for n, t in u.using if not n]
            merged = None
            for r in rows:
                merged = r if merged is None else merged.unionAll(r)
            default = TripleTable(merged) if merged is not None else default.empty()
            named = {t.value: self._get(t.value).source for n, t in u.using if n}
        ev = Evaluator(self.spark, default, named, params)
        sols = ev.group(u.where if u.where is not None else Group(()))
        if u.where is not None and len(u.delete) + len(u.insert) > 1:
            sols = replace(sols, df=settle(sols.df, "where")) if sols.names else sols
        by_graph: dict = {}
        for side, quads in (("delete", u.delete), ("insert", u.insert)):
            for g, *triple in quads:
                by_graph.setdefault(g, {"delete": [], "insert": []})[side].append(tuple(triple))
        changed: dict = {}
        for g, sides in by_graph.items():
            target = g if g is not None else u.with_graph
            if isinstance(target, Param):
                target = node(params[target.name])
            for name, part in self._addressed(target, sols):
                rows, distinct = changed.get(name) or (self._get(name).triples(), True)
                if sides["delete"]:
                    # Blank nodes of a delete pattern are wildcards bound by the WHERE; data has none.
                    rows = without(rows, instantiate(sides["delete"], part, params))
                if sides["insert"]:
                    rows, distinct = rows.unionAll(instantiate(sides["insert"], part, params)), False
                changed[name] = rows, distinct
        for name, (rows, distinct) in changed.items():
            self._put(name, Graph.from_triples(rows, name, self.ns, distinct))

    def _addressed(self, target, sols: Solutions) -> list[tuple[str | None, Solutions]]:
        """The graphs that a template names, each with the solutions that name it."""
        if not isinstance(target, Variable):
            return [(target.value if target is not None else None, sols)]
        if target.name not in sols.specs:
            return []
        label = sols.value(target.name).text()
        # Handles of named graphs live on the driver, so their names may be read here.
        found = [r[0] for r in sols.df.select(label.alias("g")).distinct().collect()]
        return [(name, sols.where(label == name)) for name in found if name is not None]


def evaluate(text: str, mapping: dict | None = None, ns: Namespaces | None = None, spark: SparkSession | None = None, **params):
    """The term of an expression for one mapping; ValueError for a SPARQL error."""
    spark = spark or SparkSession.active()
    sols = as_solutions(spark, mapping or {})
    value = Scope(sols.values(), params).value(parse_expression(text, ns or Namespaces()))
    found = term_of(sols.df.select(value.term().alias("t")).first()["t"])
    if found is None:
        raise ValueError(f"SPARQL error in {text}")
    return found


def column(text: str, bindings, ns: Namespaces | None = None, **params) -> tuple[DataFrame, Column]:
    """(rows, native column or TERM) of an expression over bindings; NULL for an error."""
    sols = as_solutions(getattr(bindings, "sparkSession", None) or SparkSession.active(), bindings)
    value = Scope(sols.values(), params).value(parse_expression(text, ns or Namespaces()))
    return sols.df, value.col if value.kind in ("any", "lit") else value.text()


