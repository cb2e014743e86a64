"""SPARQL functions over compiled values, and the compiler of expressions.

An error is NULL. Functions on strings keep the language tag of their first argument.
"""

from __future__ import annotations

import re
from dataclasses import replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..terms import BLANK, BOOLEAN, DATE, DATETIME, DECIMAL, DOUBLE, FLOAT, INTEGER, INTEGER_TYPES, IRI, LANGSTRING, LITERAL, STRING, Blank, Iri, Literal, Variable, key_form, node, term_column
from . import values as V
from .values import ANY_SPEC, Spec, Val

#: Least and most arguments (None: any number) of every function.
ARITY: dict[str, tuple[int, int | None]] = {
    **dict.fromkeys("STR LANG DATATYPE IRI ABS CEIL FLOOR ROUND STRLEN UCASE LCASE ENCODE_FOR_URI ENCODE_FOR_IRI BOUND".split(), (1, 1)),
    **dict.fromkeys("YEAR MONTH DAY HOURS MINUTES SECONDS TIMEZONE TZ MD5 SHA1 SHA256 SHA384 SHA512".split(), (1, 1)),
    **dict.fromkeys("ISIRI ISBLANK ISLITERAL ISNUMERIC".split(), (1, 1)),
    **dict.fromkeys("LANGMATCHES CONTAINS STRSTARTS STRENDS STRBEFORE STRAFTER STRLANG STRDT SAMETERM".split(), (2, 2)),
    **dict.fromkeys("RAND NOW UUID STRUUID".split(), (0, 0)),
    "BNODE": (0, 1),
    "SUBSTR": (2, 3),
    "REGEX": (2, 3),
    "REPLACE": (3, 4),
    "IF": (3, 3),
    "COALESCE": (0, None),
    "CONCAT": (0, None),
}


def string_of(v: Val) -> Column:
    """Text of a string literal (plain or tagged); NULL for anything else."""
    if v.kind == "lit":
        return v.col if v.spec.plain or v.spec.lang else F.lit(None).cast("string")
    if v.kind == "any":
        return F.when((v.col["k"] == LITERAL) & v.col["dt"].isNull(), v.col["v"])
    return F.lit(None).cast("string")


def form_of(v: Val) -> Column:
    """STR: IRI or lexical form; NULL for a blank node."""
    if v.kind == "blank":
        return F.lit(None).cast("string")
    return F.when(v.col["k"] != BLANK, v.col["v"]) if v.kind == "any" else v.text()


def tagged(v: Val, col: Column) -> Val:
    """A string result with the language tag of ``v``."""
    if v.kind == "any":
        lang = v.col["lang"]
        return Val(ANY_SPEC, F.when(col.isNotNull(), F.struct(F.lit(LITERAL).cast("tinyint").alias("k"), col.alias("v"), F.lit(None).cast("string").alias("dt"), lang.alias("lang"))))
    return V.literal(col, None, v.spec.lang)


def is_literal(v: Val) -> Column:
    return v.col["k"] == LITERAL if v.kind == "any" else F.when(v.col.isNotNull(), F.lit(v.kind == "lit"))


def _kind_test(v: Val, kind: str, code: int) -> Val:
    return V.boolean(v.col["k"] == code if v.kind == "any" else F.when(v.col.isNotNull(), F.lit(v.kind == kind)))


def encode_iri(text: Column) -> Column:
    """Percent-encode all ASCII but letters, digits and -._~ ; other characters stay."""
    one = lambda c: F.when(c.rlike(r"[A-Za-z0-9\-._~]|[^\x00-\x7F]"), c).otherwise(F.concat(F.lit("%"), F.lpad(F.hex(F.ascii(c)), 2, "0")))
    return F.when(text.rlike(r"^(?:[A-Za-z0-9\-._~]|[^\x00-\x7F])*$"), text).otherwise(F.array_join(F.transform(F.split(text, ""), one), ""))


def encode_uri(text: Column) -> Column:
    """As ``encode_iri``, with the bytes of other characters encoded too (SPARQL's ENCODE_FOR_URI)."""
    hexed = lambda c: F.regexp_replace(F.hex(F.encode(c, "UTF-8")), "(..)", "%$1")
    one = lambda c: F.when(c.rlike(r"[A-Za-z0-9\-._~]"), c).otherwise(hexed(c))
    return F.when(text.rlike(r"^[A-Za-z0-9\-._~]*$"), text).otherwise(F.array_join(F.transform(F.split(text, ""), one), ""))


def _flags(v: Val | None) -> str:
    if v is None:
        return ""
    if not isinstance(v.const, Literal):
        raise TypeError("regular expression flags must be constant")
    return "".join(f for f in dict.fromkeys(v.const.lexical) if f in "imsx")


def _pattern(v: Val, flags: str) -> Column:
    """The pattern with its flags; word classes are Unicode's."""
    return F.concat(F.lit(f"(?U{flags})"), string_of(v))


def _substr(args: list[Val]) -> Val:
    """XPath's substring: characters at positions from round(start), before round(start) + round(length)."""
    text, start = string_of(args[0]), F.floor(_double(args[1]) + 0.5)
    begin = F.greatest(start, F.lit(1)).cast("int")
    if len(args) == 2:
        return tagged(args[0], F.substring(text, begin, F.lit(2**31 - 1)))
    stop = start + F.floor(_double(args[2]) + 0.5)
    return tagged(args[0], F.when(start.isNotNull() & stop.isNotNull(), F.substring(text, begin, F.greatest(stop - begin, F.lit(0)).cast("int"))))


def _double(v: Val) -> Column:
    rank = V.rank_of(v)
    if rank is None:
        return F.lit(None).cast("double")
    number = V.as_number(v, 3)
    return number if isinstance(rank, int) else F.when(rank.isNotNull(), number)


def _before(args: list[Val]) -> Val:
    text, mark = string_of(args[0]), string_of(args[1])
    at = F.locate_col(mark, text) if hasattr(F, "locate_col") else F.position(mark, text)
    return tagged(args[0], F.when(at > 0, F.substring(text, F.lit(1), at - 1)).when(at == 0, F.lit("")))


def _after(args: list[Val]) -> Val:
    text, mark = string_of(args[0]), string_of(args[1])
    at = F.position(mark, text)
    return tagged(args[0], F.when(F.length(mark) == 0, text).when(at > 0, F.substring(text, at + F.length(mark), F.lit(2**31 - 1))).when(at == 0, F.lit("")))


def _datatype(v: Val) -> Val:
    if v.kind == "lit":
        kind = LANGSTRING if v.spec.lang else v.spec.dt or STRING
        return V.iri(F.when(v.col.isNotNull(), F.lit(kind)))
    if v.kind == "any":
        c = v.col
        return V.iri(F.when(c["k"] == LITERAL, F.coalesce(c["dt"], F.when(c["lang"].isNotNull(), F.lit(LANGSTRING)).otherwise(F.lit(STRING)))))
    return V.iri(F.lit(None).cast("string"))


def _lang(v: Val) -> Val:
    if v.kind == "lit":
        return V.literal(F.when(v.col.isNotNull(), F.lit(v.spec.lang or "")))
    return V.literal(F.when(v.col["k"] == LITERAL, F.coalesce(v.col["lang"], F.lit("")))) if v.kind == "any" else V.literal(F.lit(None).cast("string"))


def _isnumeric(v: Val) -> Val:
    rank = V.rank_of(v)
    present = v.col.isNotNull()
    if isinstance(rank, Column):
        return V.boolean(F.when(present, rank.isNotNull()))
    return V.boolean(F.when(present, F.lit(rank is not None)))


def _strdt(text: Val, kind: Val) -> Val:
    """A literal of that datatype; native where the datatype is constant and the form valid for all rows to be cast."""
    plain = F.when(string_of(text).isNotNull() & (F.lit(text.spec.plain) if text.kind == "lit" else text.col["lang"].isNull()), string_of(text))
    if isinstance(kind.const, Iri) and isinstance(text.const, Literal):
        return V.const(Literal(text.const.lexical, kind.const.value))
    return Val(ANY_SPEC, F.when(plain.isNotNull() & is_iri(kind), term_column(LITERAL, plain, F.nullif(form_of(kind), F.lit(STRING)))))


def is_iri(v: Val) -> Column:
    return v.col["k"] == IRI if v.kind == "any" else F.lit(v.kind == "iri")


def _strlang(text: Val, tag: Val) -> Val:
    lang = string_of(tag)
    ok = F.lit(text.spec.plain) if text.kind == "lit" else (text.col["k"] == LITERAL) & text.col["dt"].isNull() & text.col["lang"].isNull() if text.kind == "any" else F.lit(False)
    if text.kind == "lit" and isinstance(tag.const, Literal) and tag.const.lexical:
        return V.literal(string_of(text) if text.spec.plain else F.lit(None).cast("string"), None, tag.const.lexical)
    return Val(ANY_SPEC, F.when(ok & (F.length(lang) > 0), term_column(LITERAL, string_of(text), None, lang)))


def make_iri(v: Val, base: str | None) -> Val:
    """IRI(x): an IRI as it is; text is resolved against the base if it has no scheme."""
    text = form_of(v) if v.kind != "any" else F.when((v.col["k"] == IRI) | (v.col["dt"].isNull() & (v.col["k"] == LITERAL)), v.col["v"])
    if v.kind == "lit" and not v.spec.plain:
        text = F.lit(None).cast("string")
    if v.kind == "iri":
        return v
    return V.iri(resolve(text, base))


def resolve(text: Column, base: str | None) -> Column:
    """Relative references against a constant base: fragments, queries, absolute and sibling paths."""
    if not base:
        return text
    root = re.match(r"[A-Za-z][\w+.-]*://[^/?#]*", base)
    root_text = root[0] if root else base
    bare = base.split("#")[0]
    folder = bare.split("?")[0]
    folder = folder[: folder.rfind("/") + 1] if len(folder) > len(root_text) else folder + "/"
    return (
        F.when(text.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), text)
        .when(text == "", F.lit(bare))
        .when(text.startswith("#"), F.concat(F.lit(bare), text))
        .when(text.startswith("?"), F.concat(F.lit(bare.split("?")[0]), text))
        .when(text.startswith("//"), F.concat(F.lit(base.split(":")[0] + ":"), text))
        .when(text.startswith("/"), F.concat(F.lit(root_text), text))
        .otherwise(F.concat(F.lit(folder), text))
    )


def _time(v: Val) -> Column:
    """The local date and time of an xsd:dateTime or xsd:date."""
    if v.kind == "lit":
        return v.col.cast("timestamp_ntz") if v.spec.dt in (DATETIME, DATE) else F.lit(None).cast("timestamp_ntz")
    if v.kind != "any":
        return F.lit(None).cast("timestamp_ntz")
    return F.when(v.col["dt"].isin(DATETIME, DATE), F.regexp_replace(v.col["v"], r"(Z|[+-]\d\d:\d\d)$", "").try_cast("timestamp_ntz"))


def _zone(v: Val) -> Column:
    if v.kind != "any":
        return F.when(_time(v).isNotNull(), F.lit(""))
    return F.when(_time(v).isNotNull(), F.regexp_extract(v.col["v"], r"(Z|[+-]\d\d:\d\d)$", 1))


def _timezone(v: Val) -> Val:
    zone = _zone(v)
    hours = F.regexp_replace(F.substring(zone, 2, 2), "^0", "")
    minutes = F.regexp_replace(F.substring(zone, 5, 2), "^0", "")
    sign = F.when(zone.startswith("-"), F.lit("-")).otherwise(F.lit(""))
    text = F.concat(sign, F.lit("PT"), F.when(hours != "0", F.concat(hours, F.lit("H"))).otherwise(F.lit("")), F.when(minutes != "0", F.concat(minutes, F.lit("M"))).otherwise(F.lit("")))
    zero = zone.isin("Z", "+00:00", "-00:00")
    return V.literal(F.when(zero, F.lit("PT0S")).when(F.length(zone) > 0, text), "http://www.w3.org/2001/XMLSchema#dayTimeDuration")


def _round(x: Column, rank: int) -> Column:
    """Halves go up."""
    if rank == 0:
        return x
    return F.floor(x + F.lit("0.5").cast(V.DEC)).cast(V.DEC) if rank == 1 else F.when(F.isnan(x) | (F.abs(x) >= 2.0**52), x).otherwise(F.floor(x + 0.5).cast("double"))


def _whole(fn):
    return lambda x, rank: x if rank == 0 else fn(x).cast(V.DEC) if rank == 1 else F.when(F.isnan(x) | (F.abs(x) >= 2.0**52), x).otherwise(fn(x).cast("double"))


def keyed_blank(args: list[Val]) -> Val:
    """The blank node that values key, with the label of ``terms.blank_label``."""
    from ..sources.rdf_text import n3

    if len(args) == 1 and args[0].kind == "blank":
        return args[0]
    forms = [F.lit(key_form(a.const)) if a.const is not None else n3(a.term()) for a in args]
    whole = forms[0]
    for form in forms[1:]:
        whole = F.concat(whole, F.lit(" "), form)
    label = F.concat(F.lit("k"), F.substring(F.sha2(whole, 256), 1, 40))
    if len(args) == 1 and args[0].kind == "any":
        term = args[0].term()
        label = F.when(term["k"] == BLANK, term["v"]).otherwise(label)
    return Val(Spec("blank"), label)


def cast(v: Val, target: str) -> Val:
    """xsd:…(x)."""
    text = form_of(v)
    if target == STRING:
        return V.literal(text)
    if target == BOOLEAN:
        rank = V.rank_of(v)
        number = None if rank is None else V.as_number(v, 3) != 0
        as_text = F.when(text.isin("true", "1"), F.lit(True)).when(text.isin("false", "0"), F.lit(False))
        return V.boolean(F.coalesce(number, as_text) if number is not None else as_text)
    if target in INTEGER_TYPES:
        if v.kind == "lit" and v.spec.dt == BOOLEAN:
            return V.literal(v.col.cast("bigint"), target)
        return V.literal(F.coalesce(F.trim(text).try_cast("bigint"), F.trim(text).try_cast("double").try_cast("bigint")) if V.rank_of(v) is not None else F.trim(text).try_cast("bigint"), target)
    if target in (DECIMAL, DOUBLE, FLOAT):
        source = v.col.cast("int") if v.kind == "lit" and v.spec.dt == BOOLEAN else F.trim(text)
        return V.literal(source.try_cast(V.NATIVE[target]), target)
    if target in (DATETIME, DATE):
        return V.literal(F.regexp_replace(text, r"(Z|[+-]\d\d:\d\d)$", "").try_cast(V.NATIVE[target]), target)
    raise ValueError(f"unknown function <{target}>")


def blended(options: list[tuple[Column | None, Val]]) -> Val:
    """CASE over values: the first whose condition holds (None: whatever is left)."""
    spec, cols = V.same_spec([v for _, v in options])
    out = None
    for (condition, _), col in zip(options, cols, strict=True):
        if condition is None:
            out = col if out is None else out.otherwise(col)
        else:
            out = F.when(condition, col) if out is None else out.when(condition, col)
    return Val(spec, out)


def coalesced(values: list[Val]) -> Val:
    known = [v for v in values if not (v.kind == "any" and v.const is None and v is None)]
    spec, cols = V.same_spec(known)
    return Val(spec, F.coalesce(*cols))


def _text(fn):
    return lambda a: tagged(a[0], fn(string_of(a[0])))


def _test(fn):
    return lambda a: V.boolean(fn(string_of(a[0]), string_of(a[1])))


def _number(fn, dt=INTEGER):
    return lambda a: V.literal(fn(_time(a[0])).cast(V.NATIVE[dt]), dt)


FUNCTIONS = {
    "STR": lambda a: V.literal(form_of(a[0])),
    "LANG": lambda a: _lang(a[0]),
    "DATATYPE": lambda a: _datatype(a[0]),
    "STRLANG": lambda a: _strlang(*a),
    "STRDT": lambda a: _strdt(*a),
    "strdt": lambda a: _strdt(*a),
    "CONCAT": lambda a: V.literal(F.concat(*(string_of(x) for x in a)) if a else F.lit("")),
    "UCASE": _text(F.upper),
    "LCASE": _text(F.lower),
    "STRLEN": lambda a: V.literal(F.length(string_of(a[0])).cast("bigint"), INTEGER),
    "SUBSTR": _substr,
    "STRSTARTS": _test(lambda x, y: F.startswith(x, y)),
    "STRENDS": _test(lambda x, y: F.endswith(x, y)),
    "CONTAINS": _test(lambda x, y: F.contains(x, y)),
    "STRBEFORE": _before,
    "STRAFTER": _after,
    "REGEX": lambda a: V.boolean(F.rlike(string_of(a[0]), _pattern(a[1], _flags(a[2] if len(a) > 2 else None)))),
    "REPLACE": lambda a: tagged(a[0], F.regexp_replace(string_of(a[0]), _pattern(a[1], _flags(a[3] if len(a) > 3 else None)), string_of(a[2]))),
    "ENCODE_FOR_IRI": lambda a: V.literal(encode_iri(string_of(a[0]))),
    "ENCODE_FOR_URI": lambda a: V.literal(encode_uri(string_of(a[0]))),
    "ABS": lambda a: V.numeric_map(a[0], lambda x, r: F.abs(x)),
    "CEIL": lambda a: V.numeric_map(a[0], _whole(F.ceil)),
    "FLOOR": lambda a: V.numeric_map(a[0], _whole(F.floor)),
    "ROUND": lambda a: V.numeric_map(a[0], _round),
    "SAMETERM": lambda a: V.boolean(V.same_term(*a)),
    "ISIRI": lambda a: _kind_test(a[0], "iri", IRI),
    "ISBLANK": lambda a: _kind_test(a[0], "blank", BLANK),
    "ISLITERAL": lambda a: _kind_test(a[0], "lit", LITERAL),
    "ISNUMERIC": lambda a: _isnumeric(a[0]),
    "LANGMATCHES": lambda a: V.boolean(
        F.when(string_of(a[1]) == "*", F.length(string_of(a[0])) > 0).otherwise(
            (F.lower(string_of(a[0])) == F.lower(string_of(a[1]))) | F.startswith(F.lower(string_of(a[0])), F.concat(F.lower(string_of(a[1])), F.lit("-")))
        )
    ),
    "YEAR": _number(F.year),
    "MONTH": _number(F.month),
    "DAY": _number(F.dayofmonth),
    "HOURS": _number(F.hour),
    "MINUTES": _number(F.minute),
    "SECONDS": _number(lambda t: F.date_format(t, "ss.SSSSSS"), DECIMAL),
    "TZ": lambda a: V.literal(_zone(a[0])),
    "TIMEZONE": lambda a: _timezone(a[0]),
    "MD5": _text(F.md5),
    "SHA1": _text(F.sha1),
    "SHA256": _text(lambda x: F.sha2(x, 256)),
    "SHA384": _text(lambda x: F.sha2(x, 384)),
    "SHA512": _text(lambda x: F.sha2(x, 512)),
    "RAND": lambda a: V.literal(F.rand(), DOUBLE),
    "NOW": lambda a: V.literal(F.current_timestamp().cast("timestamp_ntz"), DATETIME),
    "UUID": lambda a: V.iri(F.expr("uuid()"), "urn:uuid:"),
    "STRUUID": lambda a: V.literal(F.expr("uuid()")),
    "BNODE": lambda a: Val(Spec("blank"), string_of(a[0]) if a else F.concat(F.lit("u"), F.replace(F.expr("uuid()"), F.lit("-"), F.lit("")))),
    "keyed_blank": keyed_blank,
}


class Scope:
    """What an expression may refer to: variables, parameters, aggregates, EXISTS tests and the blank labels of a row."""

    def __init__(self, variables: dict[str, Val], params: dict | None = None, special: dict | None = None, blank=None):
        self.variables, self.params, self.special, self.blank = variables, params or {}, special or {}, blank

    def value(self, e) -> Val:
        """Compile an expression or term."""
        from ..plans.syntax import Call, Param

        if e in self.special if not isinstance(e, Val) else False:
            return self.special[e]
        if isinstance(e, Variable):
            return self.variables.get(e.name) or V.unbound()
        if isinstance(e, Param):
            return self.param(e)
        if isinstance(e, Blank) and self.blank is not None:
            return self.blank(e)
        if isinstance(e, Iri | Literal | Blank):
            return V.const(e)
        if isinstance(e, Call):
            return self.call(e)
        raise TypeError(f"cannot stand here: {e!r}")

    def param(self, e) -> Val:
        """A host value: a Column or value as it is, a function called anew each time, else a term."""
        if e.name not in self.params:
            raise KeyError(f"no value for {{{{{e.name}}}}}")
        given = self.params[e.name]
        if callable(given) and not isinstance(given, Column):
            given = given()
        if isinstance(given, Val):
            return given
        return V.literal(given) if isinstance(given, Column) else V.const(node(given))

    def formatted(self, e, conversion: str | None, spec: str | None) -> Val:
        """A parameter as text: host values by Python's rules, columns by the printf form of the same."""
        given = self.params.get(e.name)
        if given is None:
            raise TypeError(f"no value to format for {{{{{e.name}}}}}")
        if isinstance(given, Column | Val):
            col = given.col if isinstance(given, Val) else given
            if conversion or not re.fullmatch(r"0?\d*d|\.\d+f|[xX]", spec or ""):
                raise ValueError(f"a column cannot be formatted as {spec!r}")
            return V.literal(F.format_string(f"%{spec}", col))
        given = {"r": repr, "s": str, "a": ascii, None: lambda x: x}[conversion](given)
        return V.const(Literal(format(given, spec or "")))

    def truth(self, e) -> Column:
        return V.effective_boolean(self.value(e))

    def call(self, e) -> Val:
        name, args = e.name, e.args
        if name in ("&&", "||"):
            x, y = self.truth(args[0]), self.truth(args[1])
            return V.boolean(x & y if name == "&&" else x | y)
        if name == "!":
            return V.boolean(~self.truth(args[0]))
        if name == "IF":
            test = self.truth(args[0])
            return blended([(test, self.value(args[1])), (~test, self.value(args[2]))])
        if name == "BOUND":
            return V.boolean(self.value(args[0]).col.isNotNull())
        if name == "COALESCE":
            return coalesced([self.value(a) for a in args]) if args else V.unbound()
        if name in ("iri_encoded", "iri_plain"):
            return self.iri(e)
        if name == "format":
            return self.formatted(args[0], *e.extra)
        found = [self.value(a) for a in args]
        if name == "expression":
            return found[0]
        if name in "+-*/":
            return V.arithmetic(name, *found)
        if name == "neg":
            return V.numeric_map(found[0], lambda x, r: F.try_subtract(F.lit(0).cast(V.NATIVE[V.RANK_TYPE[r]]), x).cast(V.NATIVE[V.RANK_TYPE[r]]))
        if name == "pos":
            return V.numeric_map(found[0], lambda x, r: x)
        if name in ("=", "!=", "<", ">", "<=", ">="):
            return V.boolean(V.compare(name, *found))
        if name == "IN":
            out = F.lit(False)
            for other in found[1:]:
                out = out | V.compare("=", found[0], other)
            return V.boolean(out)
        if name == "cast":
            return cast(found[0], e.extra[0])
        if name == "IRI":
            return make_iri(found[0], e.extra[0])
        if name not in FUNCTIONS:
            raise ValueError(f"unknown function {name}")
        return FUNCTIONS[name](found)

    def iri(self, e) -> Val:
        """Parts joined to an IRI; the constant start is kept apart."""
        encode = encode_iri if e.name == "iri_encoded" else lambda x: x
        parts = [p if isinstance(p, str) else self.value(p) for p in e.args]
        merged: list = []
        for p in parts:
            if isinstance(p, Val) and p.const is not None:
                p = p.const.value if isinstance(p.const, Iri) else p.const.lexical
                if e.name == "iri_encoded":
                    merged.append(("x", encode(F.lit(p))))
                    continue
            if isinstance(p, str) and merged and isinstance(merged[-1], str):
                merged[-1] += p
            elif not isinstance(p, str) or p:
                merged.append(p)
        base = e.extra[0]
        absolute = bool(merged) and isinstance(merged[0], str) and re.match(r"[A-Za-z][\w+.-]*:", merged[0])

        def column(p) -> Column:
            if isinstance(p, str):
                return F.lit(p)
            if isinstance(p, tuple):
                return p[1]
            text = form_of(p)
            numeric = p.kind == "lit" and p.spec.rank == 0
            return text if numeric else encode(text)

        if len(merged) == 1 and isinstance(merged[0], str):
            return V.const(Iri(merged[0]))
        if absolute or not base:
            if merged and isinstance(merged[0], str):
                rest = merged[1:]
                if len(rest) == 1 and isinstance(rest[0], Val) and rest[0].kind == "lit" and rest[0].spec.rank == 0:
                    return V.iri(rest[0].col, merged[0])
                return V.iri(F.concat(*map(column, rest)), merged[0])
            return V.iri(F.concat(*map(column, merged)) if merged else F.lit(""))
        return V.iri(resolve(F.concat(*map(column, merged)), base))


def renamed(v: Val, name: str) -> Val:
    """The same value read from a column of that name."""
    return Val(replace(v.spec), F.col(f"`{name}`"))
