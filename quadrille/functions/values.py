"""Compiled values: a column and what is known of its RDF terms before any row is read.

Where the datatype is known, the column is native (bigint, decimal, double, boolean,
timestamp, date or string) and expressions run on it directly. An IRI known to start with
a constant is the constant and a key column, so equal IRIs are equal keys. Only values of
unknown kind (``any``) carry the TERM struct and are told apart row by row.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..terms import (
    BLANK,
    BOOLEAN,
    DATE,
    DATETIME,
    DECIMAL,
    DOUBLE,
    FLOAT,
    INTEGER,
    INTEGER_TYPES,
    IRI,
    LITERAL,
    STRING,
    Blank,
    Iri,
    Literal,
    Term,
    term_column,
    term_literal,
)

DEC = "decimal(38,12)"
#: Operands of products and quotients, so that the result keeps its fraction.
DEC_OPERAND = "decimal(22,8)"
RANKS = dict.fromkeys(INTEGER_TYPES, 0) | {DECIMAL: 1, FLOAT: 2, DOUBLE: 3}
RANK_TYPE = (INTEGER, DECIMAL, FLOAT, DOUBLE)
NATIVE = dict.fromkeys(INTEGER_TYPES, "bigint") | {DECIMAL: DEC, FLOAT: "double", DOUBLE: "double", BOOLEAN: "boolean", DATETIME: "timestamp_ntz", DATE: "date"}


@dataclass(frozen=True)
class Spec:
    """What is known of a value: kind is iri, blank, lit or any."""

    kind: str
    dt: str | None = None
    lang: str | None = None
    prefix: str = ""

    @property
    def rank(self) -> int | None:
        return RANKS.get(self.dt) if self.kind == "lit" else None

    @property
    def plain(self) -> bool:
        return self.kind == "lit" and self.dt in (None, STRING) and self.lang is None


ANY_SPEC = Spec("any")


@dataclass(frozen=True)
class Val:
    """A value of an expression or variable; ``const`` is its term if it is constant."""

    spec: Spec
    col: Column
    const: Term | None = None

    @property
    def kind(self) -> str:
        return self.spec.kind

    def text(self) -> Column:
        """The IRI, label or lexical form."""
        if self.const is not None:
            return F.lit(self.const.value if isinstance(self.const, Iri) else self.const.label if isinstance(self.const, Blank) else self.const.lexical)
        if self.kind == "any":
            return self.col["v"]
        if self.kind in ("iri", "blank"):
            return F.concat(F.lit(self.spec.prefix), self.col.cast("string")) if self.spec.prefix else self.col.cast("string")
        return lexical(self.col, self.spec.dt)

    def term(self) -> Column:
        """The TERM column."""
        if self.kind == "any":
            return self.col
        if self.const is not None:
            return term_literal(self.const)
        kind = {"iri": IRI, "blank": BLANK, "lit": LITERAL}[self.kind]
        return term_column(kind, self.text(), None if self.spec.dt == STRING else self.spec.dt, self.spec.lang)

    def as_any(self) -> Val:
        return self if self.kind == "any" else Val(ANY_SPEC, self.term())

    def widen(self) -> Val:
        """An IRI or blank node without its constant start set apart."""
        return Val(replace(self.spec, prefix=""), self.text()) if self.spec.prefix else self


def lexical(col: Column, dt: str | None) -> Column:
    """Lexical form of a native value."""
    if dt == DECIMAL:
        text = F.regexp_replace(col.cast(DEC).cast("string"), r"0+$", "")
        return F.when(text.endswith("."), F.concat(text, F.lit("0"))).otherwise(text)
    if dt == DATETIME:
        return F.replace(col.cast("timestamp_ntz").cast("string"), F.lit(" "), F.lit("T"))
    return col.cast("string")


def literal(col: Column, dt: str | None = None, lang: str | None = None) -> Val:
    return Val(Spec("lit", None if dt == STRING else dt, lang), col)


def iri(col: Column, prefix: str = "") -> Val:
    return Val(Spec("iri", prefix=prefix), col)


def unbound() -> Val:
    return Val(ANY_SPEC, F.lit(None).cast("struct<k:tinyint,v:string,dt:string,lang:string>"))


def const(term: Term) -> Val:
    """The value of a constant term; ill-typed numbers stay dynamic and are errors where used."""
    if isinstance(term, Iri):
        return Val(Spec("iri"), F.lit(term.value), term)
    if isinstance(term, Blank):
        return Val(Spec("blank"), F.lit(term.label), term)
    native = NATIVE.get(term.datatype)
    if native is None or term.lang:
        return Val(Spec("lit", term.datatype, term.lang), F.lit(term.lexical), term)
    if not _valid(term):
        return Val(ANY_SPEC, term_literal(term), None)
    return Val(Spec("lit", term.datatype), F.lit(term.lexical).cast(native), term)


def _valid(term: Literal) -> bool:
    text = term.lexical.strip()
    if term.datatype in INTEGER_TYPES:
        return bool(re.fullmatch(r"[+-]?\d{1,18}", text))
    if term.datatype == DECIMAL:
        return bool(re.fullmatch(r"[+-]?(\d{1,25}(\.\d{0,12})?|\.\d{1,12})", text))
    if term.datatype in (FLOAT, DOUBLE):
        return bool(re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|[+-]?INF|NaN", text))
    if term.datatype == BOOLEAN:
        return text in ("true", "false", "0", "1")
    if term.datatype == DATE:
        return bool(re.fullmatch(r"\d{4}-\d\d-\d\d", text))
    return bool(re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d{1,6})?", text))


def of_column(col: Column, kind: T.DataType) -> Val:
    """The value of a table's column: its type says the datatype."""
    if isinstance(kind, T.StringType):
        return literal(col)
    if isinstance(kind, T.BooleanType):
        return literal(col, BOOLEAN)
    if isinstance(kind, T.IntegralType):
        return literal(col.cast("bigint"), INTEGER)
    if isinstance(kind, T.DecimalType):
        return literal(col.cast(DEC), DECIMAL)
    if isinstance(kind, T.DoubleType | T.FloatType):
        return literal(col.cast("double"), DOUBLE)
    if isinstance(kind, T.DateType):
        return literal(col, DATE)
    if isinstance(kind, T.TimestampType | T.TimestampNTZType):
        return literal(col.cast("timestamp_ntz"), DATETIME)
    if isinstance(kind, T.StructType) and [f.name for f in kind.fields] == ["k", "v", "dt", "lang"]:
        return Val(ANY_SPEC, col)
    raise TypeError(f"no RDF term for a column of type {kind.simpleString()}")


def same_spec(values: list[Val]) -> tuple[Spec, list[Column]]:
    """One spec that covers all the values, and their columns under it."""
    first = values[0].spec
    if all(v.spec == first for v in values) and first.kind != "any" and not first.prefix:
        return first, [v.col for v in values]
    if all(v.spec == first for v in values):
        return first, [v.col for v in values]
    if all(v.kind in ("iri",) for v in values) or all(v.kind == "blank" for v in values):
        return Spec(first.kind), [v.text() for v in values]
    return ANY_SPEC, [v.term() for v in values]


# -- numbers -------------------------------------------------------------------


def rank_of(v: Val):
    """Static rank (int), or a column that is NULL where the value is no valid number, or None for never."""
    if v.kind == "lit":
        return v.spec.rank
    if v.kind != "any":
        return None
    dt, ok = v.col["dt"], v.col["v"].try_cast("double").isNotNull()
    rank = F.when(dt.isin(*INTEGER_TYPES), 0).when(dt == DECIMAL, 1).when(dt == FLOAT, 2).when(dt == DOUBLE, 3)
    return F.when(ok, rank)


def as_number(v: Val, rank: int, operand: bool = False) -> Column:
    """The value as a native number of that rank."""
    kind = "bigint" if rank == 0 else (DEC_OPERAND if operand else DEC) if rank == 1 else "double"
    source = v.col["v"] if v.kind == "any" else v.col
    return source.try_cast(kind)


_DO = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply, "/": F.try_divide}


def _at_rank(op: str, a: Val, b: Val, rank: int) -> tuple[Column, int]:
    if op == "/" and rank == 0:
        rank = 1
    operand = op in "*/"
    found = _DO[op](as_number(a, rank, operand), as_number(b, rank, operand))
    return (found.try_cast(DEC) if rank == 1 else found), rank


def arithmetic(op: str, a: Val, b: Val) -> Val:
    """Promotion integer < decimal < float < double on the operands; integer quotients are decimals."""
    ra, rb = rank_of(a), rank_of(b)
    if ra is None or rb is None:
        return unbound()
    if isinstance(ra, int) and isinstance(rb, int):
        found, rank = _at_rank(op, a, b, max(ra, rb))
        return literal(found, RANK_TYPE[max(rank, max(ra, rb))])
    known = lambda r: F.lit(r) if isinstance(r, int) else r
    top = F.when(known(ra).isNotNull() & known(rb).isNotNull(), F.greatest(known(ra), known(rb)))
    out = None
    for rank in range(4):
        found, got = _at_rank(op, a, b, rank)
        term = term_column(LITERAL, lexical(found, RANK_TYPE[got]), RANK_TYPE[max(got, rank)])
        out = F.when(top == rank, term) if out is None else out.when(top == rank, term)
    return Val(ANY_SPEC, out)


def numeric_map(v: Val, fn) -> Val:
    """A function of one number that keeps its type."""
    rank = rank_of(v)
    if rank is None:
        return unbound()
    if isinstance(rank, int):
        return literal(fn(as_number(v, rank), rank), RANK_TYPE[rank])
    out = None
    for r in range(4):
        term = term_column(LITERAL, lexical(fn(as_number(v, r), r), RANK_TYPE[r]), RANK_TYPE[r])
        out = F.when(rank == r, term) if out is None else out.when(rank == r, term)
    return Val(ANY_SPEC, out)


# -- comparison ------------------------------------------------------------------

_CMP = {
    "=": lambda x, y: x == y,
    "<": lambda x, y: x < y,
    ">": lambda x, y: x > y,
    "<=": lambda x, y: x <= y,
    ">=": lambda x, y: x >= y,
}
NULL_BOOL = lambda: F.lit(None).cast("boolean")


def compare(op: str, a: Val, b: Val) -> Column:
    """Boolean, NULL for an error. ``=`` of different terms that are not both literals is false."""
    if op == "!=":
        return ~compare("=", a, b)
    do = _CMP[op]
    if a.kind != "any" and b.kind != "any":
        if a.kind != b.kind:
            both = a.col.isNotNull() & b.col.isNotNull()
            return F.when(both, F.lit(False)) if op == "=" else NULL_BOOL()
        if a.kind != "lit":
            if op != "=":
                return NULL_BOOL()
            return a.col == b.col if a.spec == b.spec and a.const is None and b.const is None else a.text() == b.text()
        ra, rb = a.spec.rank, b.spec.rank
        if ra is not None and rb is not None:
            rank = max(ra, rb)
            return do(as_number(a, rank), as_number(b, rank))
        if a.spec == b.spec and (a.spec.plain or a.spec.lang or a.spec.dt in (BOOLEAN, DATETIME, DATE)):
            return do(a.col, b.col)
        if op == "=" and a.spec == b.spec:  # a datatype without an order: the same term, or not known to differ
            return F.when(a.col == b.col, F.lit(True))
        if op == "=" and a.spec.lang != b.spec.lang:  # a language tag is part of the term
            return F.when(a.col.isNotNull() & b.col.isNotNull(), F.lit(False)) if (a.spec.lang and b.spec.lang) else NULL_BOOL()
        return NULL_BOOL()
    x, y = a.term(), b.term()
    num = [F.lit(r) if isinstance(r, int) else r if r is not None else F.lit(None).cast("int") for r in (rank_of(a), rank_of(b))]
    both_num = num[0].isNotNull() & num[1].isNotNull()
    rough = (num[0] >= 2) | (num[1] >= 2)
    lits = (x["k"] == LITERAL) & (y["k"] == LITERAL)
    plain = lambda t: t["dt"].isNull() & t["lang"].isNull()
    same_dt = lambda kind: (x["dt"] == kind) & (y["dt"] == kind)
    cast = lambda kind: do(x["v"].try_cast(kind), y["v"].try_cast(kind))
    out = (
        F.when(both_num & rough, do(x["v"].try_cast("double"), y["v"].try_cast("double")))
        .when(both_num, do(x["v"].try_cast(DEC), y["v"].try_cast(DEC)))
        .when(lits & plain(x) & plain(y), do(x["v"], y["v"]))
        .when(lits & same_dt(BOOLEAN), cast("boolean"))
        .when(lits & same_dt(DATETIME), cast("timestamp_ntz"))
        .when(lits & same_dt(DATE), cast("date"))
    )
    if op != "=":
        return out.when(lits & (F.lower(x["lang"]) == F.lower(y["lang"])), do(x["v"], y["v"]))
    return out.when(x == y, F.lit(True)).when(lits & x["lang"].isNotNull() & y["lang"].isNotNull(), F.lit(False)).when(lits, NULL_BOOL()).when(x.isNotNull() & y.isNotNull(), F.lit(False))


def same_term(a: Val, b: Val) -> Column:
    if a.spec == b.spec and a.const is None and b.const is None:
        return a.col == b.col
    return a.term() == b.term()


def effective_boolean(v: Val) -> Column:
    """SPARQL's boolean value of a term; NULL for an error."""
    if v.kind == "lit":
        if v.spec.dt == BOOLEAN:
            return v.col
        if v.spec.rank is not None:
            number = as_number(v, v.spec.rank)
            return (number != 0) & ~F.isnan(number) if v.spec.rank >= 2 else number != 0
        return F.length(v.col) > 0 if v.spec.plain or v.spec.lang else NULL_BOOL()
    if v.kind != "any":
        return NULL_BOOL()
    c, number = v.col, v.col["v"].try_cast("double")
    return (
        F.when(c["dt"] == BOOLEAN, c["v"].try_cast("boolean"))
        .when(rank_of(v).isNotNull(), (number != 0) & ~F.isnan(number))
        .when((c["k"] == LITERAL) & c["dt"].isNull(), F.length(c["v"]) > 0)
    )


def boolean(col: Column) -> Val:
    return literal(col, BOOLEAN)


def order_keys(v: Val) -> list[Column]:
    """Columns that sort like SPARQL: unbound, blank nodes, IRIs, literals by value."""
    if v.kind == "lit":
        return [v.col]
    if v.kind in ("iri", "blank"):
        return [v.text()]
    c = v.col
    group = F.when(c["k"] == BLANK, 0).when(c["k"] == IRI, 1).when(c["k"] == LITERAL, 2)
    number = F.when(rank_of(v).isNotNull(), c["v"].try_cast("double"))
    return [group, number, c["v"], c["dt"], c["lang"]]
