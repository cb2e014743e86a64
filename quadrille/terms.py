"""RDF terms: host-side values, and the struct that stands for a term in a DataFrame.

``TERM`` is struct<k, v, dt, lang>; k is 0 for an IRI, 1 for a blank node and 2 for a
literal. A plain string has neither dt nor lang, a tagged one has lang only. Struct
equality is then RDF term identity. NULL is an unbound variable.
"""

from __future__ import annotations

import datetime
import decimal
import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

TERM = T.StructType(
    [
        T.StructField("k", T.ByteType()),
        T.StructField("v", T.StringType()),
        T.StructField("dt", T.StringType()),
        T.StructField("lang", T.StringType()),
    ]
)
TERM_DDL = "struct<k:tinyint,v:string,dt:string,lang:string>"
IRI, BLANK, LITERAL = 0, 1, 2

XSD = "http://www.w3.org/2001/XMLSchema#"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
STRING, BOOLEAN, INTEGER, DECIMAL = XSD + "string", XSD + "boolean", XSD + "integer", XSD + "decimal"
FLOAT, DOUBLE, DATETIME, DATE, LANGSTRING = XSD + "float", XSD + "double", XSD + "dateTime", XSD + "date", RDF + "langString"
TYPE, FIRST, REST, NIL = RDF + "type", RDF + "first", RDF + "rest", RDF + "nil"

# The datatypes derived from xsd:integer.
INTEGER_TYPES = tuple(
    XSD + n
    for n in (
        "integer int long short byte nonNegativeInteger positiveInteger negativeInteger nonPositiveInteger "
        "unsignedLong unsignedInt unsignedShort unsignedByte"
    ).split()
)


@dataclass(frozen=True)
class Iri:
    value: str

    def n3(self) -> str:
        return f"<{self.value}>"

    def __str__(self) -> str:
        return self.value


@dataclass(frozen=True)
class Blank:
    label: str

    def n3(self) -> str:
        return f"_:{self.label}"


@dataclass(frozen=True)
class Variable:
    name: str

    def n3(self) -> str:
        return f"?{self.name}"


@dataclass(frozen=True)
class Literal:
    lexical: str
    datatype: str | None = None
    lang: str | None = None

    def __post_init__(self):
        if self.datatype == STRING:
            object.__setattr__(self, "datatype", None)

    def n3(self) -> str:
        text = f'"{escape(self.lexical)}"'
        return f"{text}@{self.lang}" if self.lang else f"{text}^^<{self.datatype}>" if self.datatype else text


class _Any:
    """The wildcard of patterns: matches, is not projected, and each use is its own."""

    def __repr__(self) -> str:
        return "ANY"


ANY = _Any()
Term = Iri | Blank | Literal

# The escapes of N-Triples.
ESCAPES = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}


def escape(text: str) -> str:
    return "".join(ESCAPES.get(c, c) for c in text)


def unescape(text: str) -> str:
    """Undo the string escapes of Turtle and SPARQL."""
    back = {v[1]: k for k, v in ESCAPES.items()} | {"'": "'"}

    def one(m: re.Match) -> str:
        code = m[1]
        return chr(int(code[1:], 16)) if code[0] in "uU" else back[code]

    return re.sub(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|[tbnrf\"'\\])", one, text) if "\\" in text else text


def literal_of(value) -> Literal:
    """Literal for a Python value, with the datatype that its type implies."""
    if isinstance(value, bool):
        return Literal("true" if value else "false", BOOLEAN)
    if isinstance(value, int):
        return Literal(str(value), INTEGER)
    if isinstance(value, float):
        return Literal(repr(value), DOUBLE)
    if isinstance(value, decimal.Decimal):
        return Literal(format(value, "f"), DECIMAL)
    if isinstance(value, datetime.datetime):
        return Literal(value.isoformat(), DATETIME)
    if isinstance(value, datetime.date):
        return Literal(value.isoformat(), DATE)
    if isinstance(value, str):
        return Literal(value)
    raise TypeError(f"no RDF term for a value of type {type(value).__name__}")


def node(value) -> Term:
    """A term for a Python value: terms pass through, None is an error."""
    if value is None:
        raise TypeError("None is not an RDF term; use ANY for a wildcard")
    return value if isinstance(value, Iri | Blank | Literal | Variable) else literal_of(value)


def langtag(value) -> str:
    """A language tag from a value; None is an error."""
    if value is None:
        raise TypeError("None is not a language tag")
    return str(value)


def dtype(value) -> str:
    """A datatype IRI from a value; text is read as an IRI, None is an error."""
    if value is None:
        raise TypeError("None is not a datatype")
    return value.value if isinstance(value, Iri) else str(value)


def term_column(k, v, dt=None, lang=None) -> Column:
    """A TERM column; NULL where ``v`` is NULL."""
    text = lambda x: x if isinstance(x, Column) else F.lit(x).cast("string")
    kind = k if isinstance(k, Column) else F.lit(k)
    made = F.struct(kind.cast("tinyint").alias("k"), text(v).alias("v"), text(dt).alias("dt"), text(lang).alias("lang"))
    return F.when(text(v).isNotNull(), made) if isinstance(v, Column) else made


def term_literal(term: Term) -> Column:
    """The constant TERM column of a term."""
    if isinstance(term, Iri):
        return term_column(IRI, term.value)
    if isinstance(term, Blank):
        return term_column(BLANK, term.label)
    return term_column(LITERAL, term.lexical, term.datatype, term.lang)


def term_row(term: Term | None):
    """The tuple that makes a TERM cell of ``createDataFrame``."""
    if term is None:
        return None
    if isinstance(term, Iri):
        return (IRI, term.value, None, None)
    if isinstance(term, Blank):
        return (BLANK, term.label, None, None)
    return (LITERAL, term.lexical, term.datatype, term.lang)


def term_of(cell) -> Term | None:
    """The term of a TERM cell."""
    if cell is None:
        return None
    if cell["k"] == IRI:
        return Iri(cell["v"])
    return Blank(cell["v"]) if cell["k"] == BLANK else Literal(cell["v"], cell["dt"], cell["lang"])


def double_form(x: float) -> str:
    """Lexical form of a double as the engine's columns write it: 0.001 to 10^7 plain, others with an exponent."""
    if x != x or x in (float("inf"), float("-inf")):
        return "NaN" if x != x else "Infinity" if x > 0 else "-Infinity"
    if x == 0 or 1e-3 <= abs(x) < 1e7:
        text = format(decimal.Decimal(repr(x)), "f")
        return text if "." in text else text + ".0"
    sign, digits, shift = decimal.Decimal(repr(x)).normalize().as_tuple()
    tail = "".join(map(str, digits[1:])) or "0"
    return f"{'-' * sign}{digits[0]}.{tail}E{shift + len(digits) - 1}"


def key_form(term: Term) -> str:
    """What a term adds to the identity of a keyed blank node: its N-Triples form."""
    if isinstance(term, Literal) and term.datatype == DOUBLE:
        try:
            return Literal(double_form(float(term.lexical)), DOUBLE).n3()
        except ValueError:
            pass
    if isinstance(term, Literal) and term.datatype == DECIMAL:
        whole, _, rest = term.lexical.partition(".")
        return Literal(f"{whole}.{rest.rstrip('0') or '0'}", DECIMAL).n3()
    return term.n3()


def blank_label(value) -> str:
    """Label of the blank node that a value, or a tuple of values, keys; a blank node keys itself.

    Columns make the same labels: ``k`` and the start of the SHA-256 digest of the N-Triples
    forms, which end where they say, one after the other.
    """
    import hashlib

    terms = [node(x) for x in (value if isinstance(value, tuple) else (value,))]
    if len(terms) == 1 and isinstance(terms[0], Blank):
        return terms[0].label
    return "k" + hashlib.sha256(" ".join(map(key_form, terms)).encode()).hexdigest()[:40]
