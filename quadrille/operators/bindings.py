"""Bindings: solution mappings from tables and host values."""

from __future__ import annotations

from collections.abc import Mapping as HostMapping
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import values as V
from ..functions.values import Val
from ..plans.solutions import Solutions, quoted
from ..terms import TERM, Variable, term_row
from .coercion import Coercion, to_node, to_value


class Bindings:
    """One row per mapping; each column is a variable, NULL is unbound.

    ``raw(name)`` is the source column, ``value(name)`` the term made of it.
    """

    def __init__(self, df: DataFrame, values: dict[str, Val]):
        self.df, self._values = df, values

    @classmethod
    def from_df(cls, df: DataFrame, coercion: Coercion | None = None) -> Bindings:
        """All columns whose type has terms."""
        return cls(df, {f.name: to_value(F.col(quoted(f.name)), f.dataType, f.name, coercion) for f in df.schema.fields})

    @classmethod
    def from_rows(cls, spark: SparkSession, rows, coercion: Coercion | None = None) -> Bindings:
        """Mappings, named tuples, data classes or single ones of them."""
        tables = [_as_dict(r) for r in ([rows] if _is_mapping(rows) else rows)]
        names = list(dict.fromkeys(k for t in tables for k in t))
        cells = [tuple(None if t.get(n) is None else term_row(to_node(t[n], n, coercion)) for n in names) for t in tables]
        schema = ", ".join(f"{quoted(n)} {TERM.simpleString()}" for n in names) or "x int"
        return cls.from_df(spark.createDataFrame(cells, schema).select(*map(quoted, names)))

    @property
    def names(self) -> list[str]:
        return list(self._values)

    def raw(self, name: str) -> Column:
        return F.col(quoted(name))

    def value(self, name: str) -> Val:
        return self._values[name]

    def where(self, condition: Column) -> Bindings:
        """Rows that pass a guard on raw columns."""
        return Bindings(self.df.where(condition), self._values)

    def set(self, name: str, value) -> Bindings:
        """Another variable, or another value of one: a Column, Val or host value."""
        if isinstance(value, Column):
            df = self.df.withColumn(name, value)
            return Bindings(df, {**self._values, name: to_value(F.col(quoted(name)), df.schema[name].dataType, name)})
        val = value if isinstance(value, Val) else V.unbound() if value is None else V.const(to_node(value, name))
        return Bindings(self.df, {**self._values, name: val})

    def drop(self, name: str) -> Bindings:
        return Bindings(self.df, {n: v for n, v in self._values.items() if n != name})

    def solutions(self) -> Solutions:
        """Any column may hold NULL."""
        return Solutions.of(self.df, self._values, set(self._values))


def _is_mapping(x) -> bool:
    return isinstance(x, HostMapping) or hasattr(x, "_fields") or hasattr(x, "_asdict") or hasattr(x, "asDict")


def _as_dict(row) -> dict:
    if hasattr(row, "asDict"):
        found = row.asDict()
    elif isinstance(row, HostMapping) or hasattr(row, "items"):
        found = dict(row.items())
    elif hasattr(row, "_asdict"):
        found = row._asdict()
    elif hasattr(row, "_fields"):
        found = dict(zip(row._fields, row, strict=True))
    else:
        raise TypeError(f"not a mapping: {type(row).__name__}")
    return {k.name if isinstance(k, Variable) else str(k): v for k, v in found.items()}


def as_solutions(spark: SparkSession, given) -> Solutions:
    """Solutions of bindings in any of their forms."""
    if isinstance(given, Solutions):
        return given
    if isinstance(given, Bindings):
        return given.solutions()
    if isinstance(given, DataFrame):
        return Bindings.from_df(given).solutions()
    if _is_mapping(given):  # one mapping: constants, and no column for what is unbound
        known = {k: V.const(to_node(v, k)) for k, v in _as_dict(given).items() if v is not None}
        return replace(Solutions.of(spark.range(1), known), maybe=frozenset())
    return Bindings.from_rows(spark, given).solutions()
