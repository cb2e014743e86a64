"""A graph held as rows: DataFrame[s, p, o] of TERM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import values as V
from ..functions.values import ANY_SPEC, Val
from ..plans.solutions import Solutions
from ..terms import TERM, TERM_DDL, Blank, Iri, Variable, term_row

SCHEMA = f"s {TERM_DDL}, p {TERM_DDL}, o {TERM_DDL}"


def equals(col: Column, term) -> Column:
    """The column is this term; tests on the fields reach a Parquet scan as filters."""
    row = term_row(term)
    if isinstance(term, Iri | Blank):
        return (col["k"] == row[0]) & (col["v"] == row[1])
    out = (col["k"] == row[0]) & (col["v"] == row[1])
    for field, value in (("dt", row[2]), ("lang", row[3])):
        out = out & (col[field].isNull() if value is None else col[field] == value)
    return out


def weight(pattern) -> int:
    """Patterns with more constants come first; a constant object says more than a subject or predicate."""
    s, p, o = (not isinstance(x, Variable) for x in pattern)
    return -(4 * s + 3 * o + 2 * p)


def ordered(patterns: list) -> list:
    """Most selective first, then always one that shares a variable with those before it."""
    rest, out, seen = sorted(patterns, key=weight), [], set()
    names = lambda x: {t.name for t in x if isinstance(t, Variable)}
    while rest:
        pick = next((x for x in rest if names(x) & seen), rest[0])
        rest.remove(pick)
        out.append(pick)
        seen |= names(pick)
    return out


class TripleTable:
    """A set of triples; ``distinct`` says that the rows are one already."""

    def __init__(self, df: DataFrame, distinct: bool = False):
        self.df = df if distinct else df.distinct()
        self.spark = df.sparkSession

    @classmethod
    def of_terms(cls, spark: SparkSession, triples) -> TripleTable:
        return cls(spark.createDataFrame([tuple(term_row(t) for t in x) for x in triples], SCHEMA))

    def empty(self) -> TripleTable:
        return TripleTable(self.spark.createDataFrame([], SCHEMA), True)

    def triples(self) -> DataFrame:
        return self.df

    def pattern(self, s, p, o) -> Solutions:
        df, values = self.df, {}
        for name, term in (("s", s), ("p", p), ("o", o)):
            col = F.col(name)
            if not isinstance(term, Variable):
                df = df.where(equals(col, term))
            elif term.name in values:
                df = df.where(values[term.name].term() == col)
            else:
                values[term.name] = V.iri(col["v"]) if name == "p" else Val(ANY_SPEC, col)
        return Solutions.of(df, values)

    def match(self, patterns: list) -> Solutions:
        from ..plans.algebra import joined

        return joined([self.pattern(*x) for x in ordered(patterns)], self.spark)
