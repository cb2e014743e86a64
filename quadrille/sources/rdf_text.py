"""N-Triples as distributed text, Turtle on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..namespaces import Namespaces
from ..plans.syntax import Parser
from ..terms import ESCAPES, FIRST, NIL, REST, TYPE, Blank, Iri, Literal, Term, term_column

_NODE = r"(?:<([^<>\"{}|^`\\\x00-\x20]*(?:\\u[0-9A-Fa-f]{4}[^<>\"{}|^`\\\x00-\x20]*)*)>|_:([^\s<\"]+))"
_LINE = (
    r"^[ \t]*" + _NODE + r"[ \t]*<([^>]*)>[ \t]*(?:" + _NODE[3:-1] + r"|\"((?:[^\"\\\n\r]|\\.)*)\"(?:\^\^<([^>]*)>|@([A-Za-z]+(?:-[A-Za-z0-9]+)*))?)[ \t]*\.[ \t]*(?:#.*)?$"
)


def n3(term: Column) -> Column:
    """N-Triples form of a TERM column."""
    text = term["v"]
    for plain, written in ESCAPES.items():
        text = F.replace(text, F.lit(plain), F.lit(written))
    quoted = F.concat(F.lit('"'), text, F.lit('"'))
    tail = F.when(term["lang"].isNotNull(), F.concat(F.lit("@"), term["lang"])).when(term["dt"].isNotNull(), F.concat(F.lit("^^<"), term["dt"], F.lit(">"))).otherwise(F.lit(""))
    return F.when(term["k"] == 0, F.concat(F.lit("<"), term["v"], F.lit(">"))).when(term["k"] == 1, F.concat(F.lit("_:"), term["v"])).otherwise(F.concat(quoted, tail))


def ntriples(triples: DataFrame) -> DataFrame:
    """One line per triple."""
    return triples.select(F.concat_ws(" ", n3(F.col("s")), n3(F.col("p")), n3(F.col("o")), F.lit(".")).alias("value"))


def unescaped(text: Column) -> Column:
    """Undo string escapes: JSON has those of N-Triples but for the eight-digit one and the apostrophe."""
    wide = F.transform(
        F.split(text, r"(?=\\U[0-9A-Fa-f]{8})"),
        lambda x: F.when(
            x.rlike(r"^\\U[0-9A-Fa-f]{8}"),
            F.concat(F.decode(F.unhex(F.substring(x, 3, 8)), "UTF-32"), F.substring(x, F.lit(11), F.length(x))),
        ).otherwise(x),
    )
    narrow = F.when(F.contains(text, F.lit("\\U")), F.array_join(wide, "")).otherwise(text)
    json = F.concat(F.lit('["'), F.replace(F.replace(narrow, F.lit("\\'"), F.lit("'")), F.lit("\t"), F.lit("\\t")), F.lit('"]'))
    return F.when(F.contains(text, F.lit("\\")), F.get(F.from_json(json, "array<string>"), F.lit(0))).otherwise(text)


def parse_lines(lines: DataFrame) -> DataFrame:
    """[s, p, o] of N-Triples lines (column value); a line that is no triple, comment or blank raises."""
    part = lambda i: F.regexp_extract("value", _LINE, i)
    rows = lines.where(~F.col("value").rlike(r"^[ \t]*(#.*)?$"))
    bad = F.when(~F.col("value").rlike(_LINE), F.raise_error(F.concat(F.lit("not an N-Triples line: "), F.col("value"))).cast("string"))
    cut = rows.select(bad.alias("bad"), *(part(i).alias(f"g{i}") for i in range(1, 9)), F.col("value").rlike(r"^[ \t]*<").alias("s_iri"))
    filled = lambda c: F.nullif(F.col(c), F.lit(""))
    subject = F.when(F.col("s_iri"), term_column(0, unescaped(F.col("g1")))).otherwise(term_column(1, F.col("g2")))
    literal = term_column(2, unescaped(F.col("g6")), F.nullif(filled("g7"), F.lit("http://www.w3.org/2001/XMLSchema#string")), filled("g8"))
    value = F.when(F.col("g4") != "", term_column(0, unescaped(F.col("g4")))).when(F.col("g5") != "", term_column(1, F.col("g5"))).otherwise(literal)
    return cut.where(F.col("bad").isNull()).select(subject.alias("s"), term_column(0, unescaped(F.col("g3"))).alias("p"), value.alias("o"))


def read_ntriples(spark: SparkSession, path: str) -> DataFrame:
    return parse_lines(spark.read.text(path))


def read_turtle(text: str, ns: Namespaces) -> tuple[list[tuple], Namespaces]:
    """Triples and prefixes of Turtle text."""
    parser = Parser(text, ns)
    out: list = []
    while parser.t.kind != "end":
        at = parser.t
        directive = at.text.lower().lstrip("@") if at.kind in ("lang", "name") else ""
        if directive in ("prefix", "base") and (at.kind == "lang" or at.text.upper() in ("PREFIX", "BASE")):
            parser.next()
            if directive == "prefix":
                name = parser.next().text[:-1]
                parser.ns = parser.ns.bind(name, parser.iri().value)
            else:
                parser.ns = parser.ns.with_base(parser.iri().value)
            parser.op(".")
            continue
        found = parser.triples(stop=(), paths=False)
        if not found:
            parser.fail(f"unexpected {parser.t.text!r}")
        out += found
    return out, parser.ns


def write_turtle(triples: list[tuple], ns: Namespaces) -> str:
    """Turtle text: subjects and predicates grouped, lists of single use written as ( )."""

    def short(t: Term) -> str:
        if isinstance(t, Iri):
            return "a" if t.value == TYPE else ns.shorten(t.value) or t.n3()
        if isinstance(t, Literal) and t.datatype and (name := ns.shorten(t.datatype)):
            return Literal(t.lexical).n3() + "^^" + name
        return t.n3()

    by_subject: dict = {}
    for s, p, o in sorted(triples, key=lambda x: tuple(t.n3() for t in x)):
        by_subject.setdefault(s, {}).setdefault(p, []).append(o)
    uses: dict = {}
    for _, _, o in triples:
        uses[o] = uses.get(o, 0) + 1

    def items(head) -> list | None:
        """Members of a list whose cells are used once and hold nothing else."""
        out, seen = [], set()
        while head != Iri(NIL):
            cell = by_subject.get(head)
            if not isinstance(head, Blank) or head in seen or uses.get(head) != 1 or not cell or set(cell) != {Iri(FIRST), Iri(REST)} or any(len(v) != 1 for v in cell.values()):
                return None
            seen.add(head)
            out.append(head)
            head = cell[Iri(REST)][0]
        return out

    inlined: set = set()
    for cells in (items(o) for _, p, o in triples if p != Iri(REST) and isinstance(o, Blank)):
        inlined |= set(cells or ())

    def written(t) -> str:
        cells = items(t) if t in inlined else None
        return "(" + " ".join(written(by_subject[c][Iri(FIRST)][0]) for c in cells) + ")" if cells else short(t) if t != Iri(TYPE) else t.n3()

    used = "".join(short(t) + " " + (t.datatype or "" if isinstance(t, Literal) else "") for x in triples for t in x)
    head = [f"@prefix {p}: <{n}> ." for p, n in sorted(ns.prefixes.items()) if f"{p}:" in used]
    body = []
    for s, preds in by_subject.items():
        if s in inlined:
            continue
        lines = [f"{short(p)} " + ", ".join(written(o) for o in objects) for p, objects in preds.items()]
        body.append((short(s) if s != Iri(TYPE) else s.n3()) + " " + " ;\n    ".join(lines) + " .")
    return "\n".join(head + ([""] if head else []) + body) + "\n"
