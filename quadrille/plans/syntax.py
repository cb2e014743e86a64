"""One tokenizer and parser for patterns, expressions and SPARQL 1.1.

Values from the host are named parameters, written ``{{name}}``: they stand where a term
may stand, and are bound as terms, never as text. Templates also take the computed terms
``e<http://x/{?id}>`` (each hole percent-encoded), ``e{ expression }``, ``ex:{?id}``
(no encoding) and ``_:{expression}`` (a blank node keyed on the value).
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import lru_cache

from ..namespaces import Namespaces
from ..terms import BOOLEAN, DECIMAL, DOUBLE, FIRST, INTEGER, NIL, REST, TYPE, Blank, Iri, Literal, Variable, unescape


class SyntaxProblem(ValueError):
    """A text that does not parse, with the line and column of the fault."""

    def __init__(self, message: str, text: str, at: int):
        self.line = text.count("\n", 0, at) + 1
        self.column = at - (text.rfind("\n", 0, at) + 1) + 1
        super().__init__(f"{message} (line {self.line}, column {self.column})")


@dataclass(frozen=True)
class Param:
    """A value that the caller supplies."""

    name: str


@dataclass(frozen=True)
class Call:
    """A function, operator or computed term over arguments."""

    name: str
    args: tuple
    extra: tuple = ()


@dataclass(frozen=True)
class Aggregate:
    name: str
    arg: object
    distinct: bool = False
    separator: str = " "


@dataclass(frozen=True)
class Exists:
    group: Group
    negated: bool


@dataclass(frozen=True)
class Path:
    """op: link, inv, seq, alt, ?, *, + or not."""

    op: str
    parts: tuple


@dataclass(frozen=True)
class Group:
    """Elements in written order; each is a tuple whose first item names it."""

    elements: tuple


@dataclass(frozen=True)
class Query:
    form: str
    where: Group
    project: tuple | None = None  # of (name, expression or None); None: all
    template: tuple = ()
    describe: tuple = ()
    distinct: bool = False
    group_by: tuple = ()  # of (name or None, expression)
    having: tuple = ()
    order_by: tuple = ()  # of (expression, ascending)
    limit: int | None = None
    offset: int | None = None
    values: tuple | None = None
    sources: tuple = ()  # of (named, term)


@dataclass(frozen=True)
class Update:
    kind: str
    delete: tuple = ()
    insert: tuple = ()
    where: Group | None = None
    args: tuple = ()
    with_graph: object = None
    using: tuple = ()


@dataclass
class Token:
    kind: str
    text: str
    at: int
    tight: bool = field(default=False)  # no white space before


_TOKENS = re.compile(
    r"""(?P<ws>(?:\s+|\#[^\n]*)+)
  |(?P<param>\{\{\s*[A-Za-z_]\w*\s*\}\})
  |(?P<ehole>e<(?:[^<>{}\s"]|\{[^{}]*\})*>)
  |(?P<fhole>f<(?:[^<>{}\s"]|\{\{\s*\w+\s*(?:![rsa])?(?::[^{}<>]*)?\}\})*>)
  |(?P<ebrace>e\{)
  |(?P<bbrace>_:\{)
  |(?P<iri><[^<>"{}|^`\\\x00-\x20]*>)
  |(?P<str>\"{3}(?:(?:\"|\"\")?(?:[^\"\\]|\\.))*\"{3}|'{3}(?:(?:'|'')?(?:[^'\\]|\\.))*'{3}|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')
  |(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
  |(?P<blank>_:[A-Za-z0-9_](?:[\w.-]*[\w-])?)
  |(?P<var>[?$][A-Za-z0-9_]\w*)
  |(?P<pbrace>[A-Za-z][\w-]*:\{)
  |(?P<pname>(?:[A-Za-z](?:[\w.-]*[\w-])?)?:(?:(?:[\w:%]|\\[_~.\-!$&'()*+,;=/?\#@%])(?:(?:[\w.:%-]|\\[_~.\-!$&'()*+,;=/?\#@%])*(?:[\w:%-]|\\[_~.\-!$&'()*+,;=/?\#@%]))?)?)
  |(?P<num>(?:[0-9]+\.[0-9]*|\.[0-9]+|[0-9]+)[eE][+-]?[0-9]+|[0-9]*\.[0-9]+|[0-9]+)
  |(?P<name>[A-Za-z_]\w*)
  |(?P<op>\^\^|&&|\|\||!=|<=|>=|[=<>!+\-*/|^(){}\[\],;.?])""",
    re.X | re.S,
)

_AGGREGATES = {"COUNT", "SUM", "MIN", "MAX", "AVG", "SAMPLE", "GROUP_CONCAT"}


def tokenize(text: str) -> list[Token]:
    out, at, tight = [], 0, False
    while at < len(text):
        m = _TOKENS.match(text, at)
        if not m:
            raise SyntaxProblem(f"unexpected character {text[at]!r}", text, at)
        if m.lastgroup != "ws":
            if m.lastgroup == "num" and m.end() < len(text) and (text[m.end()].isalpha() or text[m.end()] == "_"):
                raise SyntaxProblem(f"bad number {m[0] + text[m.end()]!r}", text, at)
            out.append(Token(m.lastgroup, m[0], at, tight))
        tight = m.lastgroup != "ws"
        at = m.end()
    out.append(Token("end", "", len(text)))
    return out


class Parser:
    """Recursive descent over the tokens of one text."""

    def __init__(self, text: str, ns: Namespaces):
        self.text, self.ns = text, ns
        self.tokens, self.i = tokenize(text), 0
        self.hidden = 0

    # -- tokens
    @property
    def t(self) -> Token:
        return self.tokens[self.i]

    def fail(self, message: str, token: Token | None = None):
        raise SyntaxProblem(message, self.text, (token or self.t).at)

    def next(self) -> Token:
        token = self.t
        self.i += 1
        return token

    def is_op(self, *ops: str) -> bool:
        return self.t.kind == "op" and self.t.text in ops

    def op(self, *ops: str) -> bool:
        if self.is_op(*ops):
            self.i += 1
            return True
        return False

    def need(self, op: str) -> None:
        if not self.op(op):
            self.fail(f"expected {op!r}, found {self.t.text or 'the end'!r}")

    def is_word(self, *words: str) -> bool:
        return self.t.kind == "name" and self.t.text.upper() in words

    def word(self, *words: str) -> bool:
        if self.is_word(*words):
            self.i += 1
            return True
        return False

    def need_word(self, word: str) -> None:
        if not self.word(word):
            self.fail(f"expected {word}, found {self.t.text or 'the end'!r}")

    def end(self) -> None:
        if self.t.kind != "end":
            self.fail(f"unexpected {self.t.text!r}")

    def fresh(self) -> Variable:
        self.hidden += 1
        return Variable(f"__h{self.hidden}")

    # -- terms
    def pname(self, token: Token) -> Iri:
        prefix, local = token.text.split(":", 1)
        local = re.sub(r"\\(.)", r"\1", local)
        try:
            return Iri(self.ns.expand(prefix, local))
        except KeyError:
            self.fail(f"unknown prefix {prefix!r}", token)

    def iri(self) -> Iri | Param:
        token = self.next()
        if token.kind == "iri":
            return Iri(self.ns.resolve(unescape(token.text[1:-1])))
        if token.kind == "pname":
            return self.pname(token)
        if token.kind == "param":
            return Param(token.text[2:-2].strip())
        if token.kind == "fhole":
            return self.holes(token)
        self.fail(f"expected an IRI, found {token.text or 'the end'!r}", token)

    def holes(self, token: Token) -> Call:
        """e<…{expr}…> or f<…{{name}}…>: the parts of a computed IRI. Parameters may have a conversion and a format: {{n:03d}}."""
        body, parts = token.text[2:-1], []
        pattern = r"\{\{\s*(\w+)\s*(?:!([rsa]))?(?::([^{}]*))?\}\}" if token.kind == "fhole" else r"\{([^{}]*)\}"
        last = 0
        for m in re.finditer(pattern, body):
            parts.append(body[last : m.start()])
            if token.kind == "ehole":
                parts.append(Parser(m[1], self.ns).whole_expression())
            else:
                parts.append(Call("format", (Param(m[1]),), (m[2], m[3])) if m[2] or m[3] else Param(m[1]))
            last = m.end()
        parts.append(body[last:])
        return Call("iri_encoded" if token.kind == "ehole" else "iri_plain", tuple(parts), (self.ns.base,))

    def string(self) -> str:
        token = self.next()
        if token.kind != "str":
            self.fail(f"expected a string, found {token.text!r}", token)
        quote = 3 if token.text[:3] in ('"""', "'''") and len(token.text) >= 6 else 1
        return unescape(token.text[quote:-quote])

    def literal(self):
        text = self.string()
        if self.t.kind == "lang":
            return Literal(text, None, self.next().text[1:])
        if self.op("^^"):
            kind = self.iri()
            return Call("strdt", (Literal(text), kind)) if not isinstance(kind, Iri) else Literal(text, kind.value)
        return Literal(text)

    def number(self, sign: str = "") -> Literal:
        text = self.next().text
        kind = DOUBLE if "e" in text.lower() else DECIMAL if "." in text else INTEGER
        return Literal(sign + text, kind)

    def maybe_term(self):
        """A term that needs no triples of its own, or None."""
        t = self.t
        if t.kind == "var":
            return Variable(self.next().text[1:])
        if t.kind in ("iri", "pname", "param", "fhole"):
            return self.iri()
        if t.kind == "ehole":
            return self.holes(self.next())
        if t.kind == "ebrace":
            self.next()
            found = self.expression()
            self.need("}")
            return Call("expression", (found,))
        if t.kind == "bbrace":
            self.next()
            found = [self.expression()]
            while self.op(","):
                found.append(self.expression())
            self.need("}")
            return Call("keyed_blank", tuple(found))
        if t.kind == "pbrace":
            prefix = self.next().text[:-2]
            found = self.expression()
            self.need("}")
            if prefix not in self.ns.prefixes:
                self.fail(f"unknown prefix {prefix!r}", t)
            return Call("iri_plain", (self.ns.prefixes[prefix], found), (None,))
        if t.kind == "str":
            return self.literal()
        if t.kind == "num":
            return self.number()
        if t.kind == "op" and t.text in "+-" and self.tokens[self.i + 1].kind == "num":
            return self.number(self.next().text.replace("+", ""))
        if t.kind == "name" and t.text in ("true", "false", "True", "False"):
            return Literal(self.next().text.lower(), BOOLEAN)
        if t.kind == "blank":
            return Blank(self.next().text[2:])
        return None

    # -- triples
    def triples(self, stop: tuple[str, ...] = ("}",), paths: bool = True) -> tuple:
        """Triples up to a token that cannot go on; outer triples come before those nested in them."""
        out: list = []
        while True:
            if self.t.kind == "end" or self.is_op(*stop) or not self.starts_triples():
                return tuple(out)
            later: list = []
            bare = self.is_op("[")
            subject = self.node(later)
            if bare and later and (self.is_op(".", *stop) or self.t.kind == "end" or not self.starts_verb()):
                out += later
            else:
                self.properties(subject, out, later, paths)
            if not self.op("."):
                return tuple(out)

    def starts_triples(self) -> bool:
        t = self.t
        return t.kind in ("var", "iri", "pname", "param", "fhole", "ehole", "ebrace", "bbrace", "pbrace", "str", "num", "blank") or (
            t.kind == "op" and t.text in ("[", "(") or t.kind == "name" and t.text in ("true", "false") or t.kind == "op" and t.text in "+-"
        )

    def starts_verb(self) -> bool:
        return self.t.kind in ("var", "iri", "pname", "param", "fhole", "ehole", "ebrace", "pbrace") or self.is_op("^", "!", "(") or self.t.text == "a"

    def properties(self, subject, out: list, later: list, paths: bool) -> None:
        while True:
            verb = self.verb(paths)
            while True:
                nested: list = []
                value = self.node(nested)
                out.append((subject, verb, value))
                out += later
                later.clear()
                out += nested
                if not self.op(","):
                    break
            if not self.op(";"):
                return
            while self.op(";"):
                pass
            if not self.starts_verb():
                return

    def node(self, out: list):
        """A term; what it needs besides goes to ``out``."""
        if self.op("["):
            subject = Blank(f"__b{self._count()}")
            if not self.is_op("]"):
                self.properties(subject, out, [], True)
            self.need("]")
            return subject
        if self.op("("):
            cells = []
            while not self.is_op(")"):
                nested: list = []
                cells.append((self.node(nested), nested))
            self.need(")")
            if not cells:
                return Iri(NIL)
            heads = [Blank(f"__b{self._count()}") for _ in cells]
            for i, (item, nested) in enumerate(cells):
                out.append((heads[i], Iri(FIRST), item))
                out += nested
                out.append((heads[i], Iri(REST), heads[i + 1] if i + 1 < len(heads) else Iri(NIL)))
            return heads[0]
        found = self.maybe_term()
        if found is None:
            self.fail(f"expected a term, found {self.t.text or 'the end'!r}")
        return found

    def _count(self) -> int:
        self.hidden += 1
        return self.hidden

    def verb(self, paths: bool):
        if self.t.kind == "name" and self.t.text == "a":
            self.next()
            simple = Iri(TYPE)
            if not paths or not self.is_op("/", "|", "*", "+", "?"):
                return simple
            self.i -= 1
        if self.t.kind in ("var", "param", "fhole", "ehole", "ebrace", "pbrace"):
            found = self.maybe_term()
            return found
        if not paths:
            return self.iri()
        path = self.path()
        return path.parts[0] if path.op == "link" else path

    # -- property paths
    def path(self) -> Path:
        parts = [self.path_sequence()]
        while self.op("|"):
            parts.append(self.path_sequence())
        return parts[0] if len(parts) == 1 else Path("alt", tuple(parts))

    def path_sequence(self) -> Path:
        parts = [self.path_step()]
        while self.op("/"):
            parts.append(self.path_step())
        return parts[0] if len(parts) == 1 else Path("seq", tuple(parts))

    def path_step(self) -> Path:
        if self.op("^"):
            return Path("inv", (self.path_element(),))
        return self.path_element()

    def path_element(self) -> Path:
        if self.op("("):
            found = self.path()
            self.need(")")
        elif self.op("!"):
            items = []
            if self.op("("):
                while not self.is_op(")"):
                    items.append(self.path_negated())
                    if not self.op("|"):
                        break
                self.need(")")
            else:
                items.append(self.path_negated())
            found = Path("not", tuple(items))
        else:
            found = Path("link", (Iri(TYPE),)) if self.t.text == "a" and self.next() else Path("link", (self.iri(),))
        while self.is_op("?", "*", "+"):
            found = Path(self.next().text, (found,))
        return found

    def path_negated(self):
        inverse = self.op("^")
        name = Iri(TYPE) if self.t.text == "a" and self.next() else self.iri()
        return (name, inverse)

    # -- expressions
    def whole_expression(self):
        found = self.expression()
        self.end()
        return found

    def expression(self):
        found = self.either()
        if self.word("IF"):  # value if condition else other
            condition = self.either()
            self.need_word("ELSE")
            return Call("IF", (condition, found, self.expression()))
        return found

    def either(self):
        found = self.both()
        while self.op("||"):
            found = Call("||", (found, self.both()))
        return found

    def both(self):
        found = self.relation()
        while self.op("&&"):
            found = Call("&&", (found, self.relation()))
        return found

    def relation(self):
        found = self.sum()
        if self.is_op("=", "!=", "<", ">", "<=", ">="):
            return Call(self.next().text, (found, self.sum()))
        negated = self.is_word("NOT") and self.tokens[self.i + 1].text.upper() == "IN" and bool(self.next())
        if self.word("IN"):
            self.need("(")
            items = []
            while not self.is_op(")"):
                items.append(self.expression())
                if not self.op(","):
                    break
            self.need(")")
            inside = Call("IN", (found, *items))
            return Call("!", (inside,)) if negated else inside
        return found

    def sum(self):
        found = self.product()
        while self.is_op("+", "-"):
            found = Call(self.next().text, (found, self.product()))
        return found

    def product(self):
        found = self.unary()
        while self.is_op("*", "/"):
            found = Call(self.next().text, (found, self.unary()))
        return found

    def unary(self):
        if self.op("!"):
            return Call("!", (self.unary(),))
        if self.op("-"):
            return Call("neg", (self.unary(),))
        if self.op("+"):
            return Call("pos", (self.unary(),))
        return self.primary()

    def primary(self):
        if self.op("("):
            found = self.expression()
            self.need(")")
            return found
        if self.is_word("EXISTS"):
            self.next()
            return Exists(self.group(), False)
        if self.is_word("NOT") and self.tokens[self.i + 1].text.upper() == "EXISTS":
            self.i += 2
            return Exists(self.group(), True)
        t = self.t
        if t.kind == "name" and t.text.lower() not in ("true", "false"):
            return self.call()
        found = self.maybe_term()
        if found is None:
            self.fail(f"expected an expression, found {t.text or 'the end'!r}")
        if isinstance(found, Blank):
            self.fail("a blank node cannot stand in an expression", t)
        if isinstance(found, Iri) and self.is_op("(") and self.t.tight:  # a cast
            return Call("cast", (*self.arguments(),), (found.value,))
        return found

    def arguments(self) -> list:
        self.need("(")
        out = []
        while not self.is_op(")"):
            out.append(self.expression())
            if not self.op(","):
                break
        self.need(")")
        return out

    def call(self):
        token = self.next()
        name = token.text.upper()
        if name in _AGGREGATES:
            self.need("(")
            distinct = self.word("DISTINCT")
            arg = None if name == "COUNT" and self.op("*") else self.expression()
            separator = " "
            if self.op(";"):
                self.need_word("SEPARATOR")
                self.need("=")
                separator = self.string()
            self.need(")")
            return Aggregate(name, arg, distinct, separator)
        if not self.is_op("("):
            self.fail(f"unknown name {token.text!r}", token)
        args = self.arguments()
        if name == "BOUND" and not (len(args) == 1 and isinstance(args[0], Variable)):
            self.fail("BOUND takes a variable", token)
        name = {"URI": "IRI", "ISURI": "ISIRI"}.get(name, name)
        from ..functions.builtins import ARITY

        if name not in ARITY:
            self.fail(f"unknown function {token.text}", token)
        low, high = ARITY[name]
        if not low <= len(args) <= (high if high is not None else len(args)):
            self.fail(f"{name} takes {low}{'' if high == low else f' to {high}' if high else ' or more'} arguments, not {len(args)}", token)
        return Call(name, tuple(args), (self.ns.base,) if name == "IRI" else ())

    # -- group patterns
    def group(self) -> Group:
        self.need("{")
        out: list = []
        if self.is_word("SELECT"):
            out.append(("subquery", self.select(inner=True)))
            self.need("}")
            return Group(tuple(out))
        while not self.is_op("}"):
            if self.t.kind == "end":
                self.fail("expected '}'")
            if self.word("OPTIONAL"):
                out.append(("optional", self.group()))
            elif self.word("MINUS"):
                out.append(("minus", self.group()))
            elif self.word("FILTER"):
                out.append(("filter", self.constraint()))
            elif self.word("BIND"):
                self.need("(")
                value = self.expression()
                self.need_word("AS")
                out.append(("bind", self.variable(), value))
                self.need(")")
            elif self.word("VALUES"):
                out.append(("values", *self.values()))
            elif self.word("GRAPH"):
                name = self.maybe_term()
                out.append(("graph", name, self.group()))
            elif self.word("SERVICE"):
                self.fail("SERVICE needs a network and is not available")
            elif self.is_op("{"):
                options = [self.group()]
                while self.word("UNION"):
                    options.append(self.group())
                out.append(("union", tuple(options)) if len(options) > 1 else ("group", options[0]))
            else:
                found = self.triples(stop=("}", "{"))
                if not found:
                    self.fail(f"unexpected {self.t.text!r}")
                if out and out[-1][0] == "triples":
                    out[-1] = ("triples", out[-1][1] + found)
                else:
                    out.append(("triples", found))
            self.op(".")
        self.need("}")
        return Group(tuple(out))

    def constraint(self):
        if self.is_op("("):
            self.next()
            found = self.expression()
            self.need(")")
            return found
        return self.primary()

    def variable(self) -> str:
        if self.t.kind != "var":
            self.fail(f"expected a variable, found {self.t.text!r}")
        return self.next().text[1:]

    def values(self) -> tuple:
        names, rows = [], []
        single = not self.is_op("(")
        if single:
            names.append(self.variable())
        else:
            self.need("(")
            while not self.is_op(")"):
                names.append(self.variable())
            self.need(")")
        self.need("{")
        while not self.is_op("}"):
            if not single:
                self.need("(")
            row = []
            for _ in names:
                if self.word("UNDEF"):
                    row.append(None)
                else:
                    row.append(self.maybe_term())
                    if row[-1] is None:
                        self.fail(f"expected a term, found {self.t.text!r}")
            if not single:
                self.need(")")
            rows.append(tuple(row))
        self.need("}")
        return tuple(names), tuple(rows)

    # -- queries
    def prologue(self) -> None:
        while True:
            if self.word("PREFIX"):
                token = self.next()
                if token.kind != "pname" or not token.text.endswith(":"):
                    self.fail("expected a prefix", token)
                self.ns = self.ns.bind(token.text[:-1], self.iri().value)
            elif self.word("BASE"):
                self.ns = self.ns.with_base(self.iri().value)
            else:
                return

    def query(self) -> Query:
        self.prologue()
        if self.is_word("SELECT"):
            found = self.select()
        elif self.word("ASK"):
            sources = self.sources()
            found = Query("ASK", self.where(), sources=sources)
        elif self.word("CONSTRUCT"):
            found = self.construct()
        elif self.word("DESCRIBE"):
            found = self.describe()
        else:
            self.fail(f"expected SELECT, ASK, CONSTRUCT or DESCRIBE, found {self.t.text!r}")
        self.end()
        return found

    def sources(self) -> tuple:
        out = []
        while self.word("FROM"):
            named = self.word("NAMED")
            out.append((named, self.iri()))
        return tuple(out)

    def where(self) -> Group:
        self.word("WHERE")
        return self.group()

    def select(self, inner: bool = False) -> Query:
        self.need_word("SELECT")
        distinct = self.word("DISTINCT", "REDUCED")
        project: list | None = []
        if self.op("*"):
            project = None
        else:
            while True:
                if self.t.kind == "var":
                    project.append((self.variable(), None))
                elif self.is_op("("):
                    self.next()
                    value = self.expression()
                    self.need_word("AS")
                    project.append((self.variable(), value))
                    self.need(")")
                else:
                    break
            if not project:
                self.fail("SELECT needs variables or *")
        sources = () if inner else self.sources()
        where = self.where()
        return Query("SELECT", where, None if project is None else tuple(project), distinct=distinct, sources=sources, **self.modifiers())

    def modifiers(self) -> dict:
        out: dict = {}
        if self.word("GROUP"):
            self.need_word("BY")
            keys = []
            while True:
                if self.t.kind == "var":
                    name = self.variable()
                    keys.append((name, Variable(name)))
                elif self.op("("):
                    value, name = self.expression(), None
                    if self.word("AS"):
                        name = self.variable()
                    self.need(")")
                    keys.append((name, value))
                elif self.t.kind == "name" and self.tokens[self.i + 1].text == "(" and not self.is_word("HAVING", "ORDER", "LIMIT", "OFFSET", "VALUES"):
                    keys.append((None, self.call()))
                else:
                    break
            out["group_by"] = tuple(keys)
        if self.word("HAVING"):
            having = []
            while self.is_op("(") or (self.t.kind == "name" and not self.is_word("ORDER", "LIMIT", "OFFSET", "VALUES")):
                having.append(self.constraint())
            out["having"] = tuple(having)
        if self.word("ORDER"):
            self.need_word("BY")
            keys = []
            while True:
                if self.is_word("ASC", "DESC"):
                    up = self.next().text.upper() == "ASC"
                    keys.append((self.constraint(), up))
                elif self.t.kind == "var" or self.is_op("(") or (self.t.kind == "name" and not self.is_word("LIMIT", "OFFSET", "VALUES")):
                    keys.append((self.constraint(), True))
                else:
                    break
            out["order_by"] = tuple(keys)
        while self.is_word("LIMIT", "OFFSET"):
            which = self.next().text.lower()
            if self.t.kind != "num":
                self.fail("expected a number")
            out[which] = int(self.next().text)
        if self.word("VALUES"):
            out["values"] = self.values()
        return out

    def construct(self) -> Query:
        if self.is_op("{"):
            self.next()
            template = self.triples(paths=False)
            self.need("}")
            sources = self.sources()
            where = self.where()
        else:
            sources = self.sources()
            self.need_word("WHERE")
            where = self.group()
            template = tuple(t for e in where.elements if e[0] == "triples" for t in e[1])
        return Query("CONSTRUCT", where, template=template, sources=sources, **self.modifiers())

    def describe(self) -> Query:
        targets = []
        star = self.op("*")
        while not star and (self.t.kind in ("var", "iri", "pname", "param")):
            targets.append(self.maybe_term())
        sources = self.sources()
        where = self.where() if self.is_word("WHERE") or self.is_op("{") else Group(())
        return Query("DESCRIBE", where, describe=tuple(targets), sources=sources, **self.modifiers())

    # -- updates
    def updates(self) -> tuple[Update, ...]:
        out = []
        while True:
            self.prologue()
            if self.t.kind == "end":
                return tuple(out)
            out.append(self.update())
            if not self.op(";"):
                self.end()
                return tuple(out)

    def quads(self) -> tuple:
        """Triples with an optional GRAPH: (graph or None, s, p, o)."""
        self.need("{")
        out: list = []
        while not self.is_op("}"):
            if self.word("GRAPH"):
                name = self.maybe_term()
                self.need("{")
                out += [(name, *t) for t in self.triples(paths=False)]
                self.need("}")
            else:
                found = self.triples(paths=False)
                if not found:
                    self.fail(f"unexpected {self.t.text!r}")
                out += [(None, *t) for t in found]
            self.op(".")
        self.need("}")
        return tuple(out)

    def update(self) -> Update:
        if self.word("LOAD"):
            self.fail("LOAD needs a network and is not available")
        for kind in ("CLEAR", "DROP", "CREATE"):
            if self.word(kind):
                self.word("SILENT")
                return Update(kind, args=(self.graph_target(),))
        for kind in ("COPY", "MOVE", "ADD"):
            if self.word(kind):
                self.word("SILENT")
                first = self.graph_target()
                self.need_word("TO")
                return Update(kind, args=(first, self.graph_target()))
        with_graph = self.iri() if self.word("WITH") else None
        if self.word("INSERT"):
            if self.word("DATA"):
                return Update("MODIFY", insert=self.quads())
            return self.modify((), self.quads(), with_graph)
        self.need_word("DELETE")
        if self.word("DATA"):
            return Update("MODIFY", delete=self.quads())
        if self.word("WHERE"):
            found = self.quads()
            elements = []
            for g, *t in found:
                elements.append(("triples", (tuple(t),)) if g is None else ("graph", g, Group((("triples", (tuple(t),)),))))
            if all(e[0] == "triples" for e in elements):
                elements = [("triples", tuple(t for e in elements for t in e[1]))]
            return Update("MODIFY", delete=found, where=Group(tuple(elements)), with_graph=with_graph)
        gone = self.quads()
        made = self.quads() if self.word("INSERT") else ()
        return self.modify(gone, made, with_graph)

    def modify(self, delete, insert, with_graph) -> Update:
        using = []
        while self.word("USING"):
            named = self.word("NAMED")
            using.append((named, self.iri()))
        self.need_word("WHERE")
        return Update("MODIFY", delete, insert, self.group(), with_graph=with_graph, using=tuple(using))

    def graph_target(self):
        if self.word("DEFAULT", "NAMED", "ALL"):
            return self.tokens[self.i - 1].text.upper()
        self.word("GRAPH")
        return self.iri()


@lru_cache(maxsize=64)
def parse_query(text: str, ns: Namespaces) -> Query:
    return Parser(text, ns).query()


@lru_cache(maxsize=64)
def parse_update(text: str, ns: Namespaces) -> tuple[Update, ...]:
    return Parser(text, ns).updates()


@lru_cache(maxsize=64)
def parse_triples(text: str, ns: Namespaces) -> tuple:
    """The triples of a template or pattern."""
    parser = Parser(text, ns)
    found = parser.triples(stop=())
    parser.end()
    return found


@lru_cache(maxsize=64)
def parse_path(text: str, ns: Namespaces) -> Path:
    """A property path, to be given as a parameter in a predicate's place."""
    parser = Parser(text, ns)
    found = parser.path()
    parser.end()
    return found


@lru_cache(maxsize=256)
def parse_expression(text: str, ns: Namespaces):
    return Parser(text, ns).whole_expression()
