"""Secret scan: an inverted index of trigrams narrows the rules to candidates, regexes verify them.

Each rule's regex is read once on the driver and turned into a Boolean query over
trigrams that any match must hold (conjunctions within a literal, disjunctions over
alternatives). One pass over the texts, lower-cased, writes the posting lists of the
trigrams that some query names: a row (trigram, text) for each text that holds it. The
lists are intersected and united by bit operations over the postings of a text, which gives
the texts that satisfy each rule's query; only there its regex runs. A rule without a
mandatory trigram (a run of hex digits) scans every text.

A text is known by 128 bits of its content: copies share their postings, and the table of
candidates meets the documents in one join.

Defined results: a null text is empty and has no spans; positions are code points, end
exclusive; repeated rows each get their spans; extra columns of any name are ignored by
``scan`` and kept by ``redact``; an empty table gives an empty result.
"""

from __future__ import annotations

import re._parser as sre
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, materialise, packed, unpacked

MASK = "[REDACTED]"
MASK_BITS = 60
#: Bytes of a text that are cut into trigrams at a time.
BLOCK = 1 << 16


@dataclass(frozen=True)
class Secret:
    """Matches of ``regex``, leftmost and not overlapping; those whose ``group`` is shorter than ``least`` are dropped."""

    kind: str
    regex: str
    group: int = 0
    least: int = 0


#: The three kinds that every report counts, in the order of ties.
BASE = (
    Secret(
        "assign",
        r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        group=2,
        least=8,
    ),
    Secret("access", r"AKIA[A-Z0-9]+", least=16),
    # Each run of 32 or more is a whole maximal run, so this equals [0-9a-f]+ cut to 32 characters.
    Secret("hex", r"[0-9a-f]{32,}", least=32),
)
#: Formats that services publish for their credentials; spans of these come on top.
EXTRA = (
    Secret("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Secret("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Secret("google", r"AIza[A-Za-z0-9_-]{35}"),
    Secret("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Secret("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Secret("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
RULES = BASE + EXTRA

# --- Boolean trigram queries -------------------------------------------------
# A query is True (no demand), a trigram, or a tuple ("and", ...) or ("or", ...).


def _both(kind: str, parts: list) -> object:
    """Conjunction or disjunction with True absorbed and duplicates gone."""
    if kind == "or" and any(p is True for p in parts):
        return True
    flat = []
    for p in parts:
        for q in p[1:] if isinstance(p, tuple) and p[0] == kind else (p,):
            if q is not True and q not in flat:
                flat.append(q)
    if kind == "or":  # an alternative that demands all that another does, and more, adds nothing
        sets = [set(q[1:]) if isinstance(q, tuple) and q[0] == "and" else {q} for q in flat]
        flat = [q for q, s in zip(flat, sets, strict=True) if not any(t < s for t in sets)]
    return True if not flat else flat[0] if len(flat) == 1 else (kind, *flat)


def _grams(word: str) -> object:
    return _both("and", [word[i : i + 3] for i in range(len(word) - 2)])


def _literals(items, most: int = 32) -> tuple[list[str] | None, object]:
    """All strings that a parsed sequence can match (None: not a short list) and what else it demands."""
    exact, demand, whole = [""], [], True

    def close(then: list[str]) -> None:
        """The literal run so far ends; another one begins."""
        nonlocal exact, whole
        demand.append(_both("or", [_grams(x) for x in exact]))
        exact, whole = then, False

    for op, arg in items:
        name = str(op)
        options: list[str] | None = None
        if name == "LITERAL":
            options = [chr(arg).lower()]
        elif name == "IN" and all(str(k) == "LITERAL" for k, _ in arg):
            options = sorted({chr(v).lower() for _, v in arg})
        elif name == "SUBPATTERN":
            options, inner = _literals(arg[3], most)
            demand.append(inner)
        elif name == "BRANCH":
            found = [_literals(b, most) for b in arg[1]]
            if all(x is not None for x, _ in found):
                options = sorted({s for x, _ in found for s in x})
                demand.append(_both("or", [d for _, d in found]))
            else:
                demand.append(_both("or", [_both("and", [d, _both("or", [_grams(s) for s in x]) if x else True]) for x, d in found]))
        elif name == "MAX_REPEAT" and arg[:2] == (0, 1):
            inner, _ = _literals(arg[2], most)
            options = ["", *inner] if inner else None
        elif name == "MAX_REPEAT" and arg[0] == arg[1]:
            inner, extra = _literals(list(arg[2]) * int(arg[0]), most) if arg[0] <= 8 else (None, True)
            options = inner
            demand.append(extra)
        elif name == "MAX_REPEAT" and arg[0] >= 1:  # once at least
            inner, extra = _literals(arg[2], most)
            demand += [extra, _both("or", [_grams(x) for x in inner]) if inner else True]
        if options is not None and len(exact) * len(options) <= most:
            exact = [a + b for a in exact for b in options]
        else:
            close(options if options is not None and len(options) <= most else [""])
    if not whole:
        close([""])
    return (exact if whole else None), _both("and", demand)


def trigram_query(regex: str) -> object:
    """What the lower-cased text of any match holds: True, a trigram, or ("and"|"or", ...)."""
    exact, demand = _literals(sre.parse(regex))
    return _both("and", [demand, _both("or", [_grams(x) for x in exact]) if exact else True])


def _trigrams(query: object) -> list[str]:
    if isinstance(query, tuple):
        return [t for q in query[1:] for t in _trigrams(q)]
    return [] if query is True else [query]


def _content(text: Column) -> tuple[Column, Column]:
    """128 bits that stand for a text."""
    return F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2")


class TrigramIndex:
    """Posting lists for the trigrams that ``rules`` ask for, and the texts that satisfy a rule's query."""

    def __init__(self, rules=RULES):
        self.rules = rules
        self.queries = {r.kind: trigram_query(r.regex) for r in rules}
        self.terms = list(dict.fromkeys(t for q in self.queries.values() for t in _trigrams(q)))

    def postings(self, documents: DataFrame) -> DataFrame:
        """gram, h1, h2: one row for each trigram of ``terms`` and each different text that holds it."""
        text = F.coalesce("text", F.lit(""))
        octets = documents.select(*_content(text), F.lower(text).cast("binary").alias("b")).where(F.octet_length("b") > 2)
        at = F.explode(F.sequence(F.lit(0), F.octet_length("b") - 3, F.lit(BLOCK)))
        blocks = octets.select("h1", "h2", "b", at.alias("at")).select("h1", "h2", F.substring(F.col("b"), F.col("at") + 1, F.lit(BLOCK + 2)).alias("part"))
        each = blocks.select("h1", "h2", "part", F.explode(F.sequence(F.lit(1), F.octet_length("part") - 2)).alias("i"))
        # The trigrams of the terms are ASCII: in UTF-8 their bytes stand for nothing else.
        grams = each.select("h1", "h2", F.substring(F.col("part"), F.col("i"), F.lit(3)).cast("string").alias("gram"))
        return grams.where(F.col("gram").isin(self.terms)).groupBy("gram", "h1", "h2").agg(F.lit(1).alias("one")).drop("one")

    def candidates(self, postings: DataFrame) -> DataFrame:
        """h1, h2, and ``passed``: bit i is set if the text satisfies the query of rule i. Texts that satisfy none have no row."""
        place = F.array_position(F.array(*map(F.lit, self.terms)), F.col("gram")).cast("int") - 1
        masks = []
        for name, low in zip(self._columns, range(0, len(self.terms), MASK_BITS), strict=True):
            bits = [1 << (i - low) if low <= i < low + MASK_BITS else 0 for i in range(len(self.terms))]
            masks.append(F.bit_or(F.get(F.array(*(F.lit(x).cast("long") for x in bits)), place)).alias(name))
        held = postings.groupBy("h1", "h2").agg(*masks)
        passed = F.lit(0).cast("long")
        for i, rule in enumerate(self.rules):
            query = self.queries[rule.kind]
            if query is not True:
                passed = passed.bitwiseOR(F.when(self._holds(query), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")))
        return held.select("h1", "h2", passed.alias("passed")).where("passed <> 0")

    def find(self, documents: DataFrame) -> DataFrame:
        """The candidates of ``documents``, by postings written to the shared folder."""
        if not self.terms:
            return documents.sparkSession.createDataFrame([], "h1 long, h2 long, passed long")
        postings, _ = materialise(self.postings(documents), "postings")
        return self.candidates(postings)

    def spans(self, text: Column, passed: Column) -> list[Column]:
        """For each rule the spans in ``text``, sought only where ``passed`` says so; rules without a query always."""
        none = F.array().cast(SPAN)
        out = []
        for i, rule in enumerate(self.rules):
            tested = F.rlike(text, F.lit(rule.regex))
            if self.queries[rule.kind] is not True:
                tested = (F.coalesce(passed, F.lit(0)).bitwiseAND(F.lit(1 << i).cast("long")) != 0) & tested
            out.append(F.when(tested, _spans(text, rule, i)).otherwise(none))
        return out

    @property
    def _columns(self) -> list[str]:
        return [f"_postings{i}" for i in range(-(-len(self.terms) // MASK_BITS))]

    def _holds(self, query: object) -> Column:
        """The query as a condition on the masks of a text."""
        if isinstance(query, tuple) and query[0] == "or":
            cond = F.lit(False)
            for q in query[1:]:
                cond = cond | self._holds(q)
            return cond
        terms = query[1:] if isinstance(query, tuple) else (query,)
        cond = F.lit(True)
        wanted = [0] * len(self._columns)
        for q in terms:
            if isinstance(q, tuple):
                cond = cond & self._holds(q)
            else:
                i = self.terms.index(q)
                wanted[i // MASK_BITS] |= 1 << (i % MASK_BITS)
        for name, bits in zip(self._columns, wanted, strict=True):
            if bits:
                cond = cond & (F.col(name).bitwiseAND(F.lit(bits).cast("long")) == bits)
        return cond


# --- Verification -------------------------------------------------------------

SPAN = "array<struct<start:long,nth:int,stop:long>>"


def _spans(text: Column, rule: Secret, nth: int) -> Column:
    """Spans of a rule. What lies between the matches gives their positions."""

    def walk(parts: Column) -> Column:
        found, gaps, tested = parts["m"], parts["g"], parts["t"]
        start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(SPAN).alias("out"))

        def step(acc: Column, i: Column) -> Column:
            begin = acc["at"] + F.length(F.get(gaps, i))
            stop = begin + F.length(F.get(found, i))
            one = F.array(F.struct(begin.alias("start"), F.lit(nth).alias("nth"), stop.alias("stop")))
            kept = F.when(F.length(F.get(tested, i)) >= rule.least, F.concat(acc["out"], one)).otherwise(acc["out"])
            return F.struct(stop.alias("at"), kept.alias("out"))

        each = F.sequence(F.lit(0), F.size(found) - 1)
        return F.when(F.size(found) > 0, F.aggregate(each, start, step)["out"]).otherwise(F.array().cast(SPAN))

    pattern = F.lit(rule.regex)
    parts = F.struct(
        F.regexp_extract_all(text, pattern, F.lit(0)).alias("m"),
        F.split(text, rule.regex, -1).alias("g"),
        F.regexp_extract_all(text, pattern, F.lit(rule.group)).alias("t"),
    )
    return let(parts, walk)


def scan(documents: DataFrame, rules=RULES) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans: one row per row of ``documents``."""
    index = TrigramIndex(rules)
    text = F.coalesce(F.col("text"), F.lit(""))
    work = documents.select("doc_id", *_content(text), text.alias("_text")).join(index.find(documents).hint("merge"), ["h1", "h2"], "left")
    found = work.select("doc_id", *(c.alias(r.kind) for r, c in zip(rules, index.spans(F.col("_text"), F.col("passed")), strict=True)))
    names = F.array(*(F.lit(r.kind) for r in rules))

    def report(spans: Column) -> Column:
        written = lambda s: F.concat_ws(":", F.get(names, s["nth"]), s["start"].cast("string"), s["stop"].cast("string"))
        return F.array_join(F.transform(F.sort_array(spans), written), ",")

    count = lambda kind: F.size(kind).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *(count(r.kind) for r in BASE),
        F.sha2(report(F.concat(*(r.kind for r in BASE))), 256).alias("base_sha256"),
        report(F.concat(*(r.kind for r in rules))).alias("spans"),
    )


def _united(spans: Column) -> Column:
    """The spans of all rules in order, overlapping ones united."""
    none = F.array().cast("array<struct<start:long,stop:long>>")

    def step(acc: Column, s: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)
        wider = F.struct(last["start"].alias("start"), F.greatest(last["stop"], s["stop"]).alias("stop"))
        own = F.struct(s["start"].alias("start"), s["stop"].alias("stop"))
        overlaps = (F.size(acc) > 0) & (s["start"] < last["stop"])
        return F.when(overlaps, F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(wider))).otherwise(F.concat(acc, F.array(own)))

    return F.aggregate(F.sort_array(spans), none, step)


def _masked(text: Column, spans: Column) -> Column:
    """The text with each span replaced by ``MASK``; what lies between spans stays."""

    def rebuild(parts: Column) -> Column:
        piece = lambda begin, length: F.substring(text, (begin + 1).cast("int"), length.cast("int"))
        begins = lambda i: F.coalesce(F.get(parts, i - 1)["stop"], F.lit(0).cast("long"))
        shown = F.transform(parts, lambda s, i: F.concat(piece(begins(i), s["start"] - begins(i)), F.lit(MASK)))
        end = begins(F.size(parts))
        return F.concat(F.array_join(shown, ""), piece(end, F.length(text) - end))

    return let(spans, rebuild)


def redact(documents: DataFrame, rules=RULES) -> DataFrame:
    """``documents`` with every secret of its texts masked; null texts stay null, other columns as they are.

    The spans are those of ``scan``, on the text as it was; overlapping ones are one mask.
    """
    index = TrigramIndex(rules)
    text = F.col("_row.text")
    rows = packed(documents).select("_row", *_content(F.coalesce(text, F.lit(""))))
    work = rows.join(index.find(documents).hint("merge"), ["h1", "h2"], "left")
    found = work.select("_row", F.concat(*index.spans(text, F.col("passed"))).alias("_found"))
    clean = F.when(F.size("_found") > 0, _masked(text, _united(F.col("_found")))).otherwise(text)
    return found.select(*unpacked(documents, text=clean))
