"""Templates: triples with variables, instantiated for every row in one projection."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import values as V
from ..functions.builtins import Scope
from ..functions.values import Spec, Val
from ..namespaces import Namespaces
from ..plans.solutions import Solutions
from ..plans.syntax import Call, Param, parse_triples
from ..sources.shared import settle
from ..terms import ANY, BLANK, IRI, Blank, Variable
from .bindings import as_solutions

ROW = "__row"
#: Functions without arguments that give another value at each call.
_ANEW = {"RAND", "UUID", "STRUUID", "BNODE"}


def _parts(term):
    yield term
    if isinstance(term, Call):
        for a in term.args:
            yield from _parts(a)


def _key(term):
    """What makes two places of a template one computation: equal terms, unless they give another value each time."""
    fresh = any(isinstance(t, Call) and t.name in _ANEW and not t.args for t in _parts(term))
    return id(term) if fresh else term


def instantiate(triples, sols: Solutions, params: dict | None = None) -> DataFrame:
    """[s, p, o] of the triples for each solution, as a bag; one with an unbound term is left out.

    Equal terms of a template are computed once per row (those that call RAND or UUID: each). Blank nodes are new for each row:
    their labels need a fixed row number, so the rows are written down first.
    """
    params = params or {}
    blanks = sorted({t.label for x in triples for e in x for t in _parts(e) if isinstance(t, Blank)})
    nonce = uuid.uuid4().hex[:12]
    if blanks:
        if sols.df.isStreaming:
            raise ValueError("a stream's rows have no number; key its blank nodes on values: _:{?id}")
        numbered = sols.df.select("*", F.monotonically_increasing_id().alias(ROW))
        sols = replace(sols, df=settle(numbered, "rows"))

    def blank(b: Blank) -> Val:
        if not b.label.startswith("__") and not blanks:
            return V.const(b)
        return Val(Spec("blank"), F.concat(F.lit(f"b{nonce}_"), F.col(ROW).cast("string"), F.lit(f"_{blanks.index(b.label)}")))

    scope = Scope(sols.values(), params, None, blank)
    terms: dict = {}
    for triple in triples:
        for place, term in zip("spo", triple, strict=True):
            if isinstance(term, Param) and params.get(term.name) is ANY:
                raise TypeError("ANY cannot be written")
            terms.setdefault((_key(term), place), term)
    columns, names = [], {}
    for (key, place), term in terms.items():
        value = scope.value(term)
        col = value.term()
        if place == "s" and value.kind == "lit" or place == "p" and value.kind in ("lit", "blank"):
            raise ValueError(f"a {'literal' if value.kind == 'lit' else 'blank node'} cannot be a {'subject' if place == 's' else 'predicate'}")
        if value.kind == "any" and place != "o":
            col = F.when(col["k"] <= (BLANK if place == "s" else IRI), col)
        names[key, place] = f"__t{len(columns)}"
        columns.append(col.alias(names[key, place]))
    computed = sols.df.select(*columns)
    made = [F.struct(*(F.col(names[_key(t), place]).alias(place) for place, t in zip("spo", triple, strict=True))) for triple in triples]
    if not made:
        raise ValueError("the template has no triples")
    rows = computed.select(F.inline(F.array(*made))) if len(made) > 1 else computed.select(made[0].alias("t")).select("t.*")
    return rows.where(F.col("s").isNotNull() & F.col("p").isNotNull() & F.col("o").isNotNull())


class Template:
    """Triples with variables. Call it with bindings to get a graph."""

    def __init__(self, text: str, ns: Namespaces | None = None, **params):
        self.ns = ns or Namespaces()
        self.triples = parse_triples(text, self.ns)
        self.params = params

    @property
    def variables(self) -> list[str]:
        seen = [t.name for x in self.triples for e in x for t in _parts(e) if isinstance(t, Variable)]
        return list(dict.fromkeys(seen))

    def instantiate(self, bindings, spark: SparkSession | None = None, **params) -> DataFrame:
        """[s, p, o] for bindings in any form; works on streams too."""
        spark = spark or getattr(bindings, "sparkSession", None) or getattr(getattr(bindings, "df", None), "sparkSession", None) or SparkSession.active()
        return instantiate(self.triples, as_solutions(spark, bindings), {**self.params, **params})

    def __call__(self, bindings, spark: SparkSession | None = None, **params):
        from .graph import Graph

        df = self.instantiate(bindings, spark, **params)
        return Graph.from_triples(df, ns=self.ns)



