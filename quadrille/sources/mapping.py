"""Tables as a virtual graph: patterns become scans of the tables, and no triple is made.

Each table gives one subject per row (an IRI or blank node of a constant and a key), a
class, and one predicate per mapped column. Patterns about one subject that one table
answers are one scan of the columns they name. Joins between tables compare keys, since
IRIs of one template are equal when their keys are, and IRIs of different templates never.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import values as V
from ..functions.values import Spec, Val
from ..plans.solutions import Solutions
from ..terms import BLANK, IRI, TYPE, Iri, Variable, term_column
from .triples import TripleTable


@dataclass(frozen=True)
class Property:
    """An object: a literal of a column, or (with ``prefix``) an IRI of it; ``lang`` names a tag or a column of tags."""

    column: Column | str
    prefix: str | None = None
    datatype: str | None = None
    lang: str | Column | None = None


@dataclass(frozen=True)
class Table:
    """``key`` is the subject's column; ``unique`` says that no two rows share it.

    ``row_key`` says that rows with equal keys are equal in all columns (a key made of the
    whole row): then too one scan answers all patterns of a subject, followed by a distinct.
    """

    name: str
    df: DataFrame
    prefix: str
    key: Column | str
    cls: str | None
    properties: dict[str, Property] = field(default_factory=dict)
    blank: bool = False
    unique: bool = True
    row_key: bool = False


def _column(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


class Mapping:
    """The virtual graph of some tables."""

    def __init__(self, tables: list[Table]):
        self.tables = tables
        self.spark = tables[0].df.sparkSession

    def empty(self) -> TripleTable:
        return TripleTable.of_terms(self.spark, [])

    # -- values of a table's rows
    def subject(self, t: Table) -> Val:
        return Val(Spec("blank" if t.blank else "iri", prefix=t.prefix), _column(t.key))

    def object(self, t: Table, predicate: str) -> Val:
        if predicate == TYPE:
            return V.const(Iri(t.cls))
        p = t.properties[predicate]
        col = _column(p.column)
        if p.prefix is not None:
            return V.iri(col, p.prefix)
        kind = t.df.select(col.alias("x")).schema["x"].dataType
        value = V.of_column(col, kind)
        if isinstance(p.lang, Column):
            return Val(V.ANY_SPEC, term_column(2, value.text(), None, p.lang))
        if p.lang:
            return V.literal(value.col, None, p.lang)
        if p.datatype:
            native = V.NATIVE.get(p.datatype)
            return V.literal(col.try_cast(native) if native else value.text(), p.datatype)
        return value

    def predicates(self, t: Table) -> list[str]:
        return ([TYPE] if t.cls else []) + list(t.properties)

    def answers(self, t: Table, s, p: str, o) -> bool:
        """Whether rows of the table can match the pattern."""
        if p not in self.predicates(t):
            return False
        if isinstance(s, Iri) and (t.blank or not s.value.startswith(t.prefix)):
            return False
        if not isinstance(s, Iri | Variable):
            return False
        if p == TYPE and isinstance(o, Iri) and o.value != t.cls:
            return False
        return True

    # -- matching
    def match(self, patterns: list) -> Solutions:
        from ..plans.algebra import joined

        open_, stars, single = [], {}, []
        for s, p, o in patterns:
            if not isinstance(p, Iri):
                open_.append((s, p, o))
                continue
            stars.setdefault(s, []).append((p.value, o))
        parts: list[tuple[int, Solutions]] = []
        for s, pairs in stars.items():
            able = [t for t in self.tables if all(self.answers(t, s, p, o) for p, o in pairs)]
            alone = [[t for t in self.tables if self.answers(t, s, p, o)] for p, o in pairs]
            owners = {id(t): t for ts in alone for t in ts if ts}
            if len(able) == 1 and (able[0].unique or able[0].row_key) and all(len(ts) == 1 or p == TYPE or self.separate(ts) for ts, (p, _) in zip(alone, pairs, strict=True)):
                parts.append((self.weight(s, pairs), self.star(able[0], s, pairs)))
            elif len(able) > 1 and all(t.unique for t in able) and self.separate(list(owners.values())):
                found = None
                for t in able:
                    one = self.star(t, s, pairs)
                    found = one if found is None else found.union(one)
                parts.append((self.weight(s, pairs), found))
            else:
                single += [(s, p, o) for p, o in pairs]
        for s, p, o in single:
            found = None
            for t in self.tables:
                if self.answers(t, s, p, o):
                    one = self.star(t, s, [(p, o)])
                    found = one if found is None else found.union(one)
            parts.append((self.weight(s, [(p, o)]), found if found is not None else self.nothing(s, o)))
        if open_:
            rows = TripleTable(self.triples(), True)
            parts += [(1, rows.pattern(*x)) for x in open_]
        parts.sort(key=lambda x: x[0])
        return joined([x for _, x in parts], self.spark)

    def separate(self, tables: list[Table]) -> bool:
        """No IRI is a subject of two of the tables."""
        starts = [t.prefix for t in tables]
        return all(not a.startswith(b) for i, a in enumerate(starts) for j, b in enumerate(starts) if i != j)

    def weight(self, s, pairs) -> int:
        return -(4 * (not isinstance(s, Variable)) + sum(not isinstance(o, Variable) and p != TYPE for p, o in pairs))

    def nothing(self, *terms) -> Solutions:
        names = [t.name for t in terms if isinstance(t, Variable)]
        return Solutions.of(self.spark.range(0), {n: V.unbound() for n in names})

    def star(self, t: Table, s, pairs) -> Solutions:
        """One scan for all the pairs of predicate and object."""
        df, values = t.df, {}
        key = self.subject(t)
        if isinstance(s, Variable):
            values[s.name] = key
            df = df.where(key.col.isNotNull())
        else:
            rest = s.value[len(t.prefix) :]
            kind = t.df.select(key.col.alias("x")).schema["x"].dataType.simpleString()
            df = df.where(key.col == F.lit(rest).try_cast(kind) if kind != "string" else key.col == rest)
            df = df.where(key.text() == s.value) if kind != "string" else df
        for p, o in pairs:
            value = self.object(t, p)
            if isinstance(o, Variable):
                if o.name in values:
                    df = df.where(V.same_term(values[o.name], value))
                else:
                    values[o.name] = value
                    df = df.where(value.col.isNotNull()) if value.const is None else df
            elif p != TYPE:
                df = df.where(self.holds(value, o))
        found = Solutions.of(df, values)
        return found if t.unique else found.distinct()

    def holds(self, value: Val, term) -> Column:
        """The value is this term, as a test of the column itself where that is the same."""
        want = V.const(term)
        if value.kind == "iri" and want.kind == "iri":
            if not term.value.startswith(value.spec.prefix):
                return F.lit(False)
            return value.col.cast("string") == term.value[len(value.spec.prefix) :] if value.spec.prefix else value.col == term.value
        if value.kind == "lit" and want.kind == "lit" and value.spec == want.spec:
            exact = value.spec.dt is None or (value.spec.rank == 0 and term.lexical == str(int(term.lexical)))
            return value.col == want.col if exact else (value.col == want.col) & (value.text() == term.lexical)
        return F.lit(False) if "any" not in (value.kind, want.kind) else value.term() == want.term()

    # -- all triples
    def triples(self) -> DataFrame:
        """Union of one select per predicate; each has a constant predicate, so filters on it leave one branch."""
        found = None
        for t in self.tables:
            subject = self.subject(t)
            for p in self.predicates(t):
                value = self.object(t, p)
                one = t.df.where(subject.col.isNotNull() & value.col.isNotNull()).select(
                    term_column(BLANK if t.blank else IRI, subject.text()).alias("s"), term_column(IRI, p).alias("p"), value.term().alias("o")
                )
                one = one if t.unique else one.distinct()
                found = one if found is None else found.unionAll(one)
        return found
