"""Rules that turn host values and columns into terms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import types as T

from ..functions import values as V
from ..functions.builtins import form_of
from ..functions.values import Val
from ..terms import Iri, Literal, Term, dtype, literal_of, node

_stack: list[Coercion] = []

#: The Python type whose rules a column type follows.
_PYTHON = (
    (T.StringType, str),
    (T.BooleanType, bool),
    (T.IntegralType, int),
    (T.DecimalType, __import__("decimal").Decimal),
    (T.FractionalType, float),
    (T.TimestampType, __import__("datetime").datetime),
    (T.TimestampNTZType, __import__("datetime").datetime),
    (T.DateType, __import__("datetime").date),
)


class Coercion:
    """Rules by field name or Python type; the innermost policy and, in it, the field come first.

    A rule is a datatype (an Iri), the classes ``Iri`` or ``Literal``, or a function: of a
    host value to a term, or of a Column to a Column or Val.
    """

    def __init__(self, rules: dict[str | type, object]):
        for key in rules:
            if not isinstance(key, str | type):
                raise TypeError("rules are keyed by field name or type")
        self.rules = dict(rules)

    def __enter__(self) -> Coercion:
        _stack.append(self)
        return self

    def __exit__(self, *_) -> None:
        _stack.remove(self)

    install = __enter__

    def rule(self, field: str | None, kind: type):
        if field in self.rules:
            return self.rules[field]
        return next((self.rules[t] for t in kind.__mro__ if t in self.rules), None)


def find_rule(field: str | None, kind: type, policy: Coercion | None = None):
    for p in [*([policy] if policy else []), *reversed(_stack)]:
        found = p.rule(field, kind)
        if found is not None:
            return found
    return None


def to_node(value, field: str | None = None, policy: Coercion | None = None) -> Term:
    """A term for a host value, by the rules in force."""
    if value is None:
        return node(value)
    rule = None if isinstance(value, Iri | Literal) else find_rule(field, type(value), policy)
    if rule is None:
        return node(value)
    text = str(value) if not isinstance(value, bool) else str(value).lower()
    if rule is Iri:
        return Iri(text)
    if rule is Literal:
        return literal_of(value)
    if isinstance(rule, Iri):
        return Literal(text, dtype(rule))
    if isinstance(rule, Callable):
        return node(rule(value))
    raise TypeError(f"not a rule: {rule!r}")


def to_value(col: Column, kind: T.DataType, field: str | None = None, policy: Coercion | None = None) -> Val:
    """A compiled value for a column, by the rules in force."""
    python = next((p for s, p in _PYTHON if isinstance(kind, s)), object)
    rule = find_rule(field, python, policy)
    plain = V.of_column(col, kind)
    if rule is None or rule is Literal:
        return plain
    if rule is Iri:
        return V.iri(form_of(plain))
    if isinstance(rule, Iri):
        native = V.NATIVE.get(rule.value)
        return V.literal(col.try_cast(native) if native else plain.text(), rule.value)
    made = rule(col)
    return made if isinstance(made, Val) else V.literal(made)
