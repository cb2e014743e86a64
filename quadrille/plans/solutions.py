"""Solution sequences: a DataFrame with a column per variable, and what is known of each."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import values as V
from ..functions.values import ANY_SPEC, Spec, Val


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def hidden(name: str) -> bool:
    """Blank nodes of patterns, wildcards and path steps: joined, but not projected."""
    return name.startswith("__")


@dataclass(frozen=True)
class Solutions:
    """``maybe`` holds the variables that can be unbound (NULL)."""

    df: DataFrame
    specs: dict[str, Spec]
    maybe: frozenset[str] = frozenset()

    @classmethod
    def unit(cls, spark: SparkSession) -> Solutions:
        """One solution without variables."""
        return cls(spark.range(1).select(), {})

    @classmethod
    def of(cls, df: DataFrame, values: dict[str, Val], maybe=frozenset()) -> Solutions:
        """Project ``values``, which read from ``df``."""
        return cls(df.select(*(v.col.alias(n) for n, v in values.items())), {n: v.spec for n, v in values.items()}, frozenset(maybe))

    @property
    def names(self) -> list[str]:
        return list(self.specs)

    def value(self, name: str) -> Val:
        return Val(self.specs[name], F.col(quoted(name)))

    def values(self) -> dict[str, Val]:
        return {n: self.value(n) for n in self.specs}

    def where(self, condition: Column) -> Solutions:
        return replace(self, df=self.df.where(condition))

    def extend(self, name: str, value: Val, maybe: bool = True) -> Solutions:
        """One more variable."""
        return Solutions(self.df.select("*", value.col.alias(name)), {**self.specs, name: value.spec}, self.maybe | ({name} if maybe else set()))

    def project(self, names: list[str]) -> Solutions:
        """These variables only; those that do not occur are unbound."""
        values = {n: self.value(n) if n in self.specs else V.unbound() for n in names}
        return Solutions.of(self.df, values, {n for n in names if n in self.maybe or n not in self.specs})

    def visible(self) -> list[str]:
        return [n for n in self.specs if not hidden(n)]

    def distinct(self) -> Solutions:
        return replace(self, df=self.df.distinct())

    def shared(self, other: Solutions) -> list[str]:
        return [n for n in self.specs if n in other.specs]

    # -- joins
    def aligned(self, other: Solutions, names: list[str]) -> tuple[Solutions, Solutions] | None:
        """Both sides with equal representations of the shared variables; None if no term can be on both."""
        left, right = self.values(), other.values()
        types = dict(self.df.dtypes), dict(other.df.dtypes)
        for n in names:
            a, b = left[n], right[n]
            open_ended = n in self.maybe or n in other.maybe
            if a.spec == b.spec and types[0][n] == types[1][n]:
                continue
            if "any" not in (a.kind, b.kind) and not open_ended:
                if a.kind != b.kind:
                    return None
                if a.kind == "lit" and (a.spec.dt, a.spec.lang) != (b.spec.dt, b.spec.lang):
                    return None
                if a.kind != "lit" and not (a.spec.prefix.startswith(b.spec.prefix) or b.spec.prefix.startswith(a.spec.prefix)):
                    return None
            spec, (left_col, right_col) = V.same_spec([a, b])
            if a.spec == b.spec:  # one prefix, keys of different types
                spec, left_col, right_col = replace(spec, prefix=""), a.text(), b.text()
            left[n], right[n] = Val(spec, left_col), Val(spec, right_col)
        return Solutions.of(self.df, left, self.maybe), Solutions.of(other.df, right, other.maybe)

    def join(self, other: Solutions, how: str = "inner", condition=None) -> Solutions:
        """Compatible pairs. ``condition`` (a function of the joined values) belongs to a left join's own condition."""
        if how == "inner" and condition is None:
            if not self.specs and not other.specs:
                return Solutions(self.df.crossJoin(other.df), {})
        names = self.shared(other)
        if how in ("inner", "left") and condition is None:
            found = self._by_parts(other, names, how)
            if found is not None:
                return found
        pair = self.aligned(other, names)
        if pair is None:
            specs = {**other.specs, **self.specs}
            if how == "inner":
                return Solutions(self.df.sparkSession.createDataFrame([], ", ".join(f"{quoted(n)} {V_DDL}" for n in specs) or "x int").select(*map(quoted, specs)), dict.fromkeys(specs, ANY_SPEC))
            extra = {n: Val(s, F.lit(None).cast(dict(other.df.dtypes)[n])) for n, s in other.specs.items() if n not in self.specs}
            return Solutions.of(self.df, {**self.values(), **extra}, self.maybe | set(extra))
        left, right = pair
        moved = {n: f"__r_{n}" for n in names}
        right_df = right.df.select(*(F.col(quoted(n)).alias(moved.get(n, n)) for n in right.specs))
        tests = []
        for n in names:
            x, y = F.col(quoted(n)), F.col(quoted(moved[n]))
            test = x == y
            if n in left.maybe:
                test = test | x.isNull()
            if n in right.maybe:
                test = test | y.isNull()
            tests.append(test)
        both = {n: left.value(n) for n in left.specs} | {n: right.value(n) for n in right.specs if n not in left.specs}
        for n in names:
            if n in left.maybe and how in ("inner", "left"):
                both[n] = Val(left.specs[n], F.coalesce(F.col(quoted(n)), F.col(quoted(moved[n]))))
        if condition is not None:
            # The condition sees the joined values; outside a join, coalesced columns would be new ones.
            tests.append(condition(both))
        on = None
        for test in tests:
            on = test if on is None else on & test
        if how == "inner" and on is None:
            joined = left.df.crossJoin(right_df)
        else:
            joined = left.df.join(right_df, on if on is not None else F.lit(True), how)
        if how in ("left_semi", "left_anti"):
            return replace(left, df=joined)
        maybe = {n for n in left.maybe if n not in right.specs or n in right.maybe or how == "left"}
        maybe |= {n for n in right.specs if n not in left.specs and (how == "left" or n in right.maybe)}
        return Solutions.of(joined, both, maybe)

    def parted(self, name: str) -> tuple[Solutions, Solutions]:
        """The solutions that bind a variable, and those that do not."""
        col = F.col(quoted(name))
        return replace(self.where(col.isNotNull()), maybe=self.maybe - {name}), self.where(col.isNull())

    def without(self, name: str) -> Solutions:
        return self.project([n for n in self.specs if n != name])

    def _by_parts(self, other: Solutions, names: list[str], how: str) -> Solutions | None:
        """A join none of whose shared variables is surely bound, as equi-joins where one is bound; None if there is no such part."""
        open_ended = [n for n in names if n in self.maybe or n in other.maybe]
        if len(open_ended) < len(names) or len(names) > 3 or not names:
            return None
        if how == "left":
            name = next((n for n in names if n not in other.maybe), None)
            if name is None:
                return None
            bound, unbound = self.parted(name)
            return bound.join(other, how).union(unbound.without(name).join(other, how))
        name = names[0]
        parts = []
        sides = [x.parted(name) if name in x.maybe else (x, None) for x in (self, other)]
        (a, a_none), (b, b_none) = sides
        parts.append(a.join(b))
        if a_none is not None:
            parts.append(a_none.without(name).join(other))
        if b_none is not None:
            parts.append(a.join(b_none.without(name)))
        found = parts[0]
        for part in parts[1:]:
            found = found.union(part)
        return found.project([*self.specs, *(n for n in other.specs if n not in self.specs)])

    def union(self, other: Solutions) -> Solutions:
        """Both sequences; variables of one side only are unbound in the other."""
        names = [*self.specs, *(n for n in other.specs if n not in self.specs)]
        left, right = {}, {}
        for n in names:
            a = self.value(n) if n in self.specs else None
            b = other.value(n) if n in other.specs else None
            if a is None or b is None:
                known, kind = (a, dict(self.df.dtypes)) if a is not None else (b, dict(other.df.dtypes))
                empty = Val(known.spec, F.lit(None).cast(kind[n]))
                a, b = (a, empty) if a is not None else (empty, b)
            elif a.spec != b.spec or dict(self.df.dtypes)[n] != dict(other.df.dtypes)[n]:
                spec, (x, y) = V.same_spec([a, b])
                if a.spec == b.spec:
                    spec, x, y = (replace(spec, prefix=""), a.text(), b.text()) if a.kind != "lit" else (ANY_SPEC, a.term(), b.term())
                a, b = Val(spec, x), Val(spec, y)
            left[n], right[n] = a, b
        maybe = self.maybe | other.maybe | {n for n in names if n not in self.specs or n not in other.specs}
        one, two = Solutions.of(self.df, left), Solutions.of(other.df, right)
        return Solutions(one.df.unionAll(two.df), one.specs, frozenset(maybe))

    # -- what callers read
    def frame(self, **casts: str) -> DataFrame:
        """Plain columns: IRIs and labels as text, typed literals as native values, the rest as TERM.

        ``casts`` reads the lexical forms of a variable as a type: ``frame(v="double")``.
        """
        out = []
        for n in self.visible():
            v = self.value(n)
            if n in casts:
                col = v.col.cast(casts[n]) if v.kind == "lit" else v.text().try_cast(casts[n])
            else:
                col = v.col if v.kind in ("any", "lit") else v.text()
            out.append(col.alias(n))
        return self.df.select(*out)

    def terms(self) -> DataFrame:
        """TERM columns of all visible variables."""
        return self.df.select(*(self.value(n).term().alias(n) for n in self.visible()))


V_DDL = "struct<k:tinyint,v:string,dt:string,lang:string>"
