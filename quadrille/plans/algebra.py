"""SPARQL queries and patterns to DataFrames.

Groups are evaluated in written order as SPARQL's algebra asks: adjacent triples form one
basic pattern, OPTIONAL is a left join with its filters in the join's condition, EXISTS
is a semi join, MINUS an anti join over pairs that share a bound variable, filters of a
group come last. Joins, their order and their methods are Catalyst's; patterns are only
put so that each is connected to one before it where that is possible.
"""

from __future__ import annotations

from dataclasses import fields, is_dataclass, replace

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..functions import values as V
from ..functions.builtins import Scope, string_of
from ..functions.values import ANY_SPEC, DEC, Spec, Val
from ..terms import ANY, DECIMAL, DOUBLE, INTEGER, LITERAL, TERM, Blank, Iri, Literal, Variable, node, term_column, term_row
from .solutions import Solutions, hidden, quoted
from .syntax import Aggregate, Call, Exists, Group, Param, Path, Query


def variables_of(e) -> set[str]:
    """Names of the variables in an expression."""
    if isinstance(e, Variable):
        return {e.name}
    if isinstance(e, Call):
        return set().union(*map(variables_of, e.args)) if e.args else set()
    if isinstance(e, Aggregate):
        return variables_of(e.arg)
    return set()


def mentioned(x) -> set[str]:
    """Names of all variables in a group or an element of one, but for subqueries: their own scope hides the outer one."""
    if isinstance(x, Variable):
        return {x.name}
    if isinstance(x, tuple | list):
        return set() if x and x[0] == "subquery" else set().union(*map(mentioned, x)) if x else set()
    if is_dataclass(x):
        return set().union(*(mentioned(getattr(x, f.name)) for f in fields(x)))
    return set()


def needed(expressions) -> set[str]:
    """The variables that expressions read; a test inside them reads all that its group mentions."""
    out = set()
    for e in expressions:
        for x in _walk(e):
            out |= mentioned(x.group) if isinstance(x, Exists) else {x.name} if isinstance(x, Variable) else set()
    return out


def read_within(group: Group) -> set[str]:
    """What filters and BINDs of a group read, those of the groups inside it too."""
    out = set()
    for kind, *args in group.elements:
        if kind == "filter":
            out |= needed(args)
        elif kind == "bind":
            out |= needed(args[1:])
        elif kind != "subquery":
            inner = [y for x in args for y in (x if isinstance(x, tuple | list) else [x]) if isinstance(y, Group)]
            out |= set().union(*map(read_within, inner)) if inner else set()
    return out


def _walk(e):
    """The expression and all parts of it."""
    yield e
    if isinstance(e, Call):
        for a in e.args:
            yield from _walk(a)
    elif isinstance(e, Aggregate):
        yield from _walk(e.arg)


def conjuncts(e) -> list:
    return [x for a in e.args for x in conjuncts(a)] if isinstance(e, Call) and e.name == "&&" else [e]


class Evaluator:
    """Evaluates patterns over a dataset: a default graph and named ones.

    A graph is anything with ``match(patterns) -> Solutions``, ``triples() -> DataFrame`` and
    ``links(predicate) -> Solutions`` of the hidden variables __s and __o.
    """

    def __init__(self, spark: SparkSession, default, named: dict | None = None, params: dict | None = None):
        self.spark, self.default, self.named, self.params = spark, default, named or {}, params or {}
        self.graph = default
        self.count = 0
        #: Inside EXISTS: the outer solutions, if the tested group's expressions read some of their variables.
        self.around: Solutions | None = None

    def fresh(self, label: str = "v") -> str:
        self.count += 1
        return f"__{label}{self.count}"

    def scope(self, sols: Solutions, special: dict | None = None) -> Scope:
        return Scope(sols.values(), self.params, special)

    # -- terms of patterns
    def slot(self, term, blanks: dict):
        """A pattern's term: a constant, or a Variable (blank nodes and wildcards get hidden ones)."""
        if isinstance(term, Param):
            given = self.params.get(term.name, KeyError)
            if given is KeyError:
                raise KeyError(f"no value for {{{{{term.name}}}}}")
            if given is ANY:
                return Variable(self.fresh("any"))
            return given if isinstance(given, Path) else node(given)
        if isinstance(term, Blank):
            if term.label not in blanks:
                blanks[term.label] = Variable(self.fresh("blank"))
            return blanks[term.label]
        if isinstance(term, Call):
            if variables_of(term):
                raise ValueError("an expression over variables cannot stand in a pattern; use BIND or FILTER")
            value = Scope({}, self.params).value(term)
            if value.const is None:
                raise ValueError("a computed term of a pattern must be constant")
            return value.const
        return term

    # -- basic patterns
    def basic(self, triples, bound: Solutions | None = None) -> Solutions:
        """Join of triple patterns and paths."""
        blanks: dict = {}
        plain, paths = [], []
        for s, p, o in triples:
            s, o = self.slot(s, blanks), self.slot(o, blanks)
            p = p if isinstance(p, Path) else self.slot(p, blanks)
            if isinstance(p, Path):
                self.path(s, p, o, plain, paths)
            else:
                plain.append((s, p, o))
        parts = [self.graph.match(plain)] if plain else []
        parts += [self.closed(*x) for x in paths]
        return joined(parts, self.spark)

    def path(self, s, path: Path, o, plain: list, rest: list) -> None:
        """Sequences and inverses become triples; what does not is kept for ``closed``."""
        if path.op == "link":
            link = path.parts[0]
            plain.append((s, self.slot(link, {}), o))
        elif path.op == "inv":
            self.path(o, path.parts[0], s, plain, rest)
        elif path.op == "seq":
            at = s
            for i, part in enumerate(path.parts):
                to = o if i + 1 == len(path.parts) else Variable(self.fresh("step"))
                self.path(at, part, to, plain, rest)
                at = to
        else:
            rest.append((s, path, o))

    def closed(self, s, path: Path, o) -> Solutions:
        """Solutions of a path that is not a chain of triples, for its two ends."""
        from ..operators.paths import closure

        ends = []
        for end in (s, o):
            ends.append(end.name if isinstance(end, Variable) else None)
        start, stop = self.fresh("from"), self.fresh("to")
        if path.op == "alt":
            found = None
            for part in path.parts:
                one = self.pairs(part, start, stop)
                found = one if found is None else found.union(one)
            found = replace(found, maybe=frozenset())
        elif path.op == "not":
            found = self.negated(path, start, stop)
        else:
            found = closure(self, path, start, stop, s if not isinstance(s, Variable) else None, o if not isinstance(o, Variable) else None)
        for name, end in ((start, s), (stop, o)):
            if not isinstance(end, Variable):
                found = found.where(V.same_term(found.value(name), V.const(end)))
        if isinstance(s, Variable) and isinstance(o, Variable) and s.name == o.name:
            found = found.where(V.same_term(found.value(start), found.value(stop)))
            return Solutions.of(found.df, {s.name: found.value(start)})
        keep = {e.name: found.value(n) for n, e in ((start, s), (stop, o)) if isinstance(e, Variable)}
        return Solutions.of(found.df, keep)

    def pairs(self, path: Path, start: str, stop: str) -> Solutions:
        """(start, stop) of one path, as a bag."""
        found = self.basic([(Variable(start), path, Variable(stop))])
        return found.project([start, stop])

    def negated(self, path: Path, start: str, stop: str) -> Solutions:
        link = self.fresh("link")
        found = None
        for inverse in (False, True):
            names = [self.slot(n, {}) for n, back in path.parts if back == inverse]
            if not names and (inverse or any(not back for _, back in path.parts)):
                continue
            ends = (stop, start) if inverse else (start, stop)
            one = self.graph.match([(Variable(ends[0]), Variable(link), Variable(ends[1]))])
            for name in names:
                one = one.where(~V.same_term(one.value(link), V.const(name)))
            one = one.project([start, stop])
            found = one if found is None else found.union(one)
        return replace(found, maybe=frozenset())

    # -- groups
    def group(self, group: Group, outer: Solutions | None = None) -> Solutions:
        """Solutions of a group; ``outer`` is where initial bindings come from."""
        sols = outer
        filters = []
        for element in group.elements:
            kind, *args = element
            if kind == "filter":
                filters.append(args[0])
            elif kind == "optional":
                sols = self.optional(sols, args[0])
            elif kind == "minus":
                sols = self.minus(sols, self.group(args[0]))
            elif kind == "bind":
                name, e = args
                base = sols if sols is not None else Solutions.unit(self.spark)
                if name in base.specs:
                    raise ValueError(f"BIND of ?{name}, which is bound already")
                base = self.with_outer(base, [e])
                base, special = self.tests(base, [e])
                sols = self.dropped(base.extend(name, self.scope(base, special).value(e)), special)
            else:
                sols = self.and_(sols, self.element(kind, args))
        sols = sols if sols is not None else Solutions.unit(self.spark)
        sols = self.with_outer(sols, filters)
        for e in filters:
            sols = self.filter(sols, e)
        return sols

    def with_outer(self, sols: Solutions, expressions: list) -> Solutions:
        """Inside EXISTS: outer variables that ``expressions`` read join the group's solutions first."""
        if self.around is None:
            return sols
        missing = [n for n in sorted(needed(expressions)) if n in self.around.specs and n not in sols.specs]
        if not missing:
            return sols
        return sols.join(self.around.project([*missing, *sols.shared(self.around)]).distinct())

    def and_(self, a: Solutions | None, b: Solutions) -> Solutions:
        return b if a is None else a.join(b)

    def element(self, kind: str, args: list) -> Solutions:
        if kind == "triples":
            return self.basic(args[0])
        if kind == "group":
            return self.group(args[0])
        if kind == "union":
            found = None
            for option in args[0]:
                one = self.group(option)
                found = one if found is None else found.union(one)
            return found
        if kind == "subquery":
            around, self.around = self.around, None
            try:
                return self.select(args[0])
            finally:
                self.around = around
        if kind == "values":
            return self.table(*args)
        if kind == "graph":
            return self.in_graph(*args)
        raise ValueError(kind)

    def in_graph(self, name, group: Group) -> Solutions:
        name = self.slot(name, {})
        outer = self.graph
        try:
            if not isinstance(name, Variable):
                self.graph = self.named.get(name.value) or self.default.empty()
                return self.group(group)
            found = None
            for label, graph in self.named.items():
                self.graph = graph
                inside = self.group(group)
                tag = V.const(Iri(label))
                if name.name in inside.specs:
                    one = inside.where(V.same_term(inside.value(name.name), tag))
                else:
                    one = inside.extend(name.name, Val(Spec("iri"), tag.col), maybe=False)
                found = one if found is None else found.union(one)
            return found if found is not None else Solutions.of(self.spark.range(0), {name.name: V.unbound()})
        finally:
            self.graph = outer

    def table(self, names, rows) -> Solutions:
        """VALUES: as large as the query's text, so it is broadcast."""
        given = [[None if t is None else self.slot(t, {}) for t in row] for row in rows]
        columns = list(zip(*given, strict=True)) if given else [()] * len(names)
        schema = ", ".join(f"{quoted(n)} {TERM.simpleString()}" for n in names)
        df = self.spark.createDataFrame([tuple(term_row(t) for t in row) for row in given], schema)
        values, maybe = {}, set()
        for n, column in zip(names, columns, strict=True):
            known = [t for t in column if t is not None]
            if len(known) < len(column):
                maybe.add(n)
            cell = F.col(quoted(n))
            kinds = {V.const(t).spec for t in known}
            if known and all(isinstance(t, Iri) for t in known):
                values[n] = V.iri(cell["v"])
            elif len(kinds) == 1 and known[0] and isinstance(known[0], Literal) and (spec := kinds.pop()).kind == "lit":
                canonical = all(str(t.lexical) == _canonical(t) for t in known)
                values[n] = Val(spec, cell["v"].cast(V.NATIVE.get(spec.dt, "string"))) if canonical else Val(ANY_SPEC, cell)
            else:
                values[n] = Val(ANY_SPEC, cell)
        found = Solutions.of(df, values, maybe)
        return replace(found, df=F.broadcast(found.df))

    def optional(self, sols: Solutions | None, group: Group) -> Solutions:
        base = sols if sols is not None else Solutions.unit(self.spark)
        inner = [e for e in group.elements if e[0] != "filter"]
        filters = [e[1] for e in group.elements if e[0] == "filter"]
        outside = [f for f in filters if any(isinstance(x, Exists) for x in _walk(f))]
        right = self.group(Group((*inner, *(("filter", f) for f in outside))))
        tests = [f for f in filters if f not in outside]
        base = self.with_outer(base, tests)
        if not tests:
            return base.join(right, "left")

        def condition(values: dict[str, Val]) -> Column:
            scope = Scope(values, self.params)
            out = F.lit(True)
            for f in tests:
                out = out & F.coalesce(scope.truth(f), F.lit(False))
            return out

        return base.join(right, "left", condition)

    def minus(self, sols: Solutions | None, right: Solutions) -> Solutions:
        base = sols if sols is not None else Solutions.unit(self.spark)
        names = [n for n in base.shared(right) if not hidden(n)]
        if not names:
            return base
        right = right.project(names).distinct()
        if not any(n in base.maybe or n in right.maybe for n in names):
            return base.join(right, "left_anti")
        split = next((n for n in names if n in base.maybe and n not in right.maybe), None)
        if split is not None and all(n in base.maybe or n in right.maybe for n in names):
            # Where the variable is bound it is a key; where not, the others decide.
            bound, unbound = base.parted(split)
            rest = unbound if len(names) == 1 else self.minus(unbound, right.project([n for n in names if n != split]))
            return self.minus(bound, right).union(rest)

        def one_bound(values) -> Column:
            out = F.lit(False)
            for n in names:
                out = out | (F.col(quoted(n)).isNotNull() & F.col(quoted(f"__r_{n}")).isNotNull())
            return out

        return base.join(right, "left_anti", one_bound)

    def filter(self, sols: Solutions, e) -> Solutions:
        for part in conjuncts(e):
            if isinstance(part, Exists):
                right = self.exists(sols, part)
                how = "left_anti" if part.negated else "left_semi"
                sols = sols.join(right, how)
            else:
                base, special = self.tests(sols, [part])
                sols = self.dropped(base.where(self.scope(base, special).truth(part)), special)
        return sols

    def exists(self, sols: Solutions, e: Exists) -> Solutions:
        """The solutions of the tested group, cut to what they share with ``sols``.

        Filters and BINDs at any depth of the group see the outer variables that they read: the
        distinct outer values of those are joined into the group that reads them, on the variables
        that it shares with ``sols``.
        """
        names = sols.visible() if read_within(e.group) & set(sols.specs) else []
        around, self.around = self.around, sols.project(names).distinct() if names else None
        try:
            # What the outer test itself sees stays visible in here.
            if around is not None and self.around is not None:
                self.around = self.around if set(around.specs) <= set(self.around.specs) else self.around.join(around)
            elif self.around is None:
                self.around = around
            right = self.group(e.group)
        finally:
            self.around = around
        shared = sols.shared(right)
        return right.project(shared).distinct() if shared else replace(right.project([]), df=right.df.limit(1).select())

    def tests(self, sols: Solutions, expressions: list) -> tuple[Solutions, dict]:
        """EXISTS inside larger expressions: a marker column per test, by left join."""
        special: dict = {}
        for e in expressions:
            for x in _walk(e):
                if isinstance(x, Exists) and x not in special:
                    mark = self.fresh("exists")
                    right = self.exists(sols, x)
                    marked = right.extend(mark, V.boolean(F.lit(True)), maybe=False)
                    sols = sols.join(marked, "left")
                    here = F.col(quoted(mark)).isNotNull()
                    special[x] = V.boolean(~here if x.negated else here)
        return sols, special

    def dropped(self, sols: Solutions, special: dict) -> Solutions:
        if not special:
            return sols
        return sols.project([n for n in sols.names if not n.startswith("__exists")])

    # -- queries
    def select(self, q: Query, outer: Solutions | None = None) -> Solutions:
        sols = self.group(q.where, outer)  # initial bindings are in place for the filters too
        if q.values is not None:
            sols = sols.join(self.table(*q.values))
        return self.finished(q, sols)

    def finished(self, q: Query, sols: Solutions) -> Solutions:
        """Grouping, projection and the rest of the modifiers."""
        wanted = q.project
        aggregates = [x for e in [*(e for _, e in wanted or ()), *q.having, *(e for e, _ in q.order_by)] if e is not None for x in _walk(e) if isinstance(x, Aggregate)]
        special: dict = {}
        if q.group_by or aggregates:
            sols, special = self.grouped(q, sols, list(dict.fromkeys(aggregates)))
            for e in q.having:
                sols = sols.where(self.scope(sols, special).truth(e))
        if wanted is None:
            names = sols.visible()
        else:
            names = [n for n, _ in wanted]
            for n, e in wanted:
                if e is not None:
                    sols, tests = self.tests(sols, [e])
                    sols = sols.extend(n, self.scope(sols, {**special, **tests}).value(e))
                    special[Variable(n)] = sols.value(n)
        if q.distinct and not q.order_by:
            sols = sols.project(names).distinct()
        keys = []
        for e, up in q.order_by:
            for key in V.order_keys(self.scope(sols, special).value(e)):
                keys.append(key.asc_nulls_first() if up else key.desc_nulls_last())
        if q.distinct and keys:
            # Keys that are no functions of what is projected: the least of a group counts, the greatest where it descends.
            each = [V.order_keys(self.scope(sols, special).value(e)) for e, _ in q.order_by]
            ups = [up for (_, up), columns in zip(q.order_by, each, strict=True) for _ in columns]
            columns = [c for part in each for c in part]
            held = sols.df.select(*(F.col(quoted(n)) for n in names if n in sols.specs), *(c.alias(f"__order{i}") for i, c in enumerate(columns)))
            least = [(F.min if up else F.max)(f"__order{i}").alias(f"__order{i}") for i, up in enumerate(ups)]
            present = [n for n in names if n in sols.specs]
            sols = Solutions(held.groupBy(*map(quoted, present)).agg(*least), {n: sols.specs[n] for n in present}, sols.maybe & set(present))
            keys = [F.col(f"__order{i}").asc_nulls_first() if up else F.col(f"__order{i}").desc_nulls_last() for i, up in enumerate(ups)]
        if keys:
            sols = replace(sols, df=sols.df.orderBy(*keys))
        if q.offset:
            sols = replace(sols, df=sols.df.offset(q.offset))
        if q.limit is not None:
            sols = replace(sols, df=sols.df.limit(q.limit))
        return sols.project(names)

    def grouped(self, q: Query, sols: Solutions, aggregates: list[Aggregate]) -> tuple[Solutions, dict]:
        """One row per group, with a hidden column per aggregate."""
        scope = self.scope(sols)
        keys, special = {}, {}
        for name, e in q.group_by:
            label = name or self.fresh("key")
            keys[label] = scope.value(e)
            special[e] = label
        made = {self.fresh("agg"): (a, self.aggregate(a, scope)) for a in aggregates}
        columns = [f.alias(n) for n, (_, (f, _)) in made.items()] or [F.count(F.lit(1)).alias("__rows")]
        inputs = sols.df.select("*", *(v.col.alias(f"__key_{n}") for n, v in keys.items()))
        rows = inputs.groupBy(*(f"`__key_{n}`" for n in keys)).agg(*columns)
        values = {n: Val(v.spec, F.col(f"`__key_{n}`")) for n, v in keys.items()}
        values |= {n: Val(spec, finish(F.col(n))) for n, (_, (_, (spec, finish))) in made.items()}
        certain = {label for (name, e), label in zip(q.group_by, keys, strict=True) if isinstance(e, Variable) and e.name in sols.specs and e.name not in sols.maybe}
        counts = {n for n, (a, _) in made.items() if a.name == "COUNT"}
        found = Solutions.of(rows, values, (set(keys) | set(made)) - certain - counts)
        table = {a: found.value(n) for n, (a, _) in made.items()}
        table |= {e: found.value(label) for e, label in special.items()}
        return found, table

    def aggregate(self, a: Aggregate, scope: Scope):
        """(aggregate column, (spec, finishing function))."""
        same = lambda c: c
        integer = (Spec("lit", INTEGER), same)
        if a.name == "COUNT":
            if a.arg is None:
                if not a.distinct:
                    return F.count(F.lit(1)), integer
                visible = [v.col for n, v in scope.variables.items() if not hidden(n)]
                return F.count_distinct(F.struct(*visible)), integer
            col = scope.value(a.arg).col
            return (F.count_distinct(col) if a.distinct else F.count(col)), integer
        v = scope.value(a.arg)
        if a.name == "SAMPLE":
            return F.any_value(v.col, F.lit(True)), (v.spec, same)
        if a.name in ("MIN", "MAX"):
            best = F.min if a.name == "MIN" else F.max
            if v.kind != "any":
                return best(v.col), (v.spec, same)
            key = F.when(v.col.isNotNull(), F.struct(*(k.alias(f"o{i}") for i, k in enumerate(V.order_keys(v))), v.col.alias("t")))
            return best(key), (ANY_SPEC, lambda c: c["t"])
        if a.name == "GROUP_CONCAT":
            text = v.text() if v.kind == "any" else string_of(v) if v.kind == "lit" and (v.spec.plain or v.spec.lang) else v.text()
            found = F.array_sort(F.collect_set(text) if a.distinct else F.collect_list(text))
            return found, (Spec("lit"), lambda c: F.array_join(c, a.separator))
        rank = V.rank_of(v)
        if rank is None:
            return F.max(F.lit(None).cast("int")), (ANY_SPEC, lambda c: V.unbound().col)
        fn = (F.sum_distinct if a.distinct else F.sum) if a.name == "SUM" else None
        if isinstance(rank, int):
            number = V.as_number(v, rank)
            if a.name == "SUM":
                dt = V.RANK_TYPE[rank]
                return F.coalesce(fn(number), F.lit(0).cast(V.NATIVE[dt])), (Spec("lit", dt), lambda c: c.cast(V.NATIVE[dt]))
            if rank >= 2:
                return F.coalesce(_avg(number, a.distinct), F.lit(0.0)), (Spec("lit", DOUBLE), same)
            exact = number.cast(V.DEC_OPERAND)
            return F.coalesce(_avg(exact, a.distinct), F.lit(0)).cast(DEC), (Spec("lit", DECIMAL), same)
        # Datatypes told row by row: sums in both kinds, and the highest rank says which holds.
        bad = F.max(F.when(v.col.isNotNull() & rank.isNull(), 1).otherwise(0))
        exact = F.when(rank <= 1, v.col["v"].try_cast(DEC if a.name == "SUM" else V.DEC_OPERAND))
        rough = F.when(rank.isNotNull(), v.col["v"].try_cast("double"))
        total = (lambda c: fn(c)) if a.name == "SUM" else (lambda c: _avg(c, a.distinct))
        both = F.struct(bad.alias("bad"), F.max(rank).alias("r"), total(exact).alias("x"), total(rough).alias("d"))

        def finish(c: Column) -> Column:
            x = c["x"].cast(DEC)
            empty = term_column(LITERAL, F.lit("0"), INTEGER)
            whole = F.lit(0) if a.name == "SUM" else F.lit(-1)
            out = F.when(c["bad"] == 1, V.unbound().col).when(c["r"].isNull(), empty)
            out = out.when(c["r"] == whole, term_column(LITERAL, x.cast("bigint").cast("string"), INTEGER))
            out = out.when(c["r"] <= 1, term_column(LITERAL, V.lexical(x, DECIMAL), DECIMAL))
            return out.otherwise(term_column(LITERAL, c["d"].cast("string"), DOUBLE))

        return both, (ANY_SPEC, finish)


def _avg(col: Column, distinct: bool) -> Column:
    return F.try_divide(F.sum_distinct(col), F.count_distinct(col)) if distinct else F.avg(col)


def _canonical(t: Literal) -> str:
    if t.datatype == INTEGER:
        return str(int(t.lexical))
    return t.lexical if t.datatype in (None,) or t.datatype not in V.NATIVE else ""


def joined(parts: list[Solutions], spark: SparkSession) -> Solutions:
    """Join all, each with one that shares a variable where there is one."""
    if not parts:
        return Solutions.unit(spark)
    found, rest = parts[0], list(parts[1:])
    while rest:
        pick = next((r for r in rest if found.shared(r)), rest[0])
        rest.remove(pick)
        found = found.join(pick)
    return found
