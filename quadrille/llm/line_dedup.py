"""Fuzzy line dedup by MinHash, in DataFrame operations only.

A line is trimmed and lower-cased, and is the set of its character shingles: the five
characters from every offset (a shorter line is one shingle). An inserted or deleted
character changes the shingles that hold it and no others, in spaced and unspaced text.

Equal lines are one row before anything is cut into shingles. Candidates come from MinHash
bands over wider shingles of nine bytes of UTF-8, also at every offset, since short ones are
shared by chance: twelve bands of three minima. Every shingle is hashed; the minima of a
long line are taken over those whose hash falls below a limit that leaves about ``SAMPLE``
of them, the same ones in any line that holds them. Lines of so few different shingles that
the limit leaves almost none get minima of both widths over all of them too, and lines of up
to ``SHORT`` characters minima over their five-character shingles, in bands of their own.
Where many members of a bucket meet, marks, bits that a line's five-character shingles set, rule
pairs out that cannot reach the threshold, and no others, before they are rows. The exact Jaccard similarity of the five-character sets of both whole lines decides, and
connected components of the confirmed pairs are found by distributed label passing. Of each
component one line stays: the first one of its smallest doc_id.

No broadcast is hinted: Catalyst broadcasts a side only below its own threshold.

Defined results: blank lines stay; a null text stays null; an emptied document stays as a
row with an empty text; rows that repeat a doc_id are one document, so what stays in one
stays in all; null ids come first; an empty table gives an empty one; extra columns of any
name are kept as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .banding import elect, linked
from .common import broadcast_if_small, discard, let, materialise, packed, release, unpacked

THRESHOLD = 0.8
SHINGLE, WIDE, SHORT = 5, 9, 40
BANDS, ROWS = 12, 3
#: Shingles that a line's minima are taken over, about; below so many different ones the line gets minima over all, too.
SAMPLE, FEWEST = 32, 8
#: Longs of a line's mark, and of these gathered at a time.
WORDS, PART = 48, 8
#: Pairs up to which only the lines that they name are sent to be compared.
PAIRS = 1 << 16
NO_ID = -(2**63)
SPACES = "\t\r\x0b\f"


def normalised(line: Column) -> Column:
    """A lower-cased line without white space at its ends."""
    bare = F.trim(line)
    edge = F.lit(False)
    for c in SPACES:
        edge = edge | F.startswith(bare, F.lit(c)) | F.endswith(bare, F.lit(c))
    return F.when(edge, F.btrim(bare, F.lit(" " + SPACES))).otherwise(bare)


def _offsets(octets: Column, width: Column | int) -> Column:
    """Where the shingles of a line begin in its UTF-32 bytes, from 1."""
    return F.sequence(F.lit(1), F.greatest(F.lit(1), octets - 4 * width + 1), F.lit(4))


def shingles(line: Column) -> Column:
    """Distinct hashes of the five-character shingles of a normalised line."""
    hashed = lambda b: F.transform(_offsets(F.octet_length(b), SHINGLE), lambda i: F.xxhash64(F.substring(b, i, F.lit(4 * SHINGLE))))
    return F.array_distinct(let(F.encode(line, "UTF-32"), hashed))


def similar(pairs: DataFrame, threshold: float) -> DataFrame:
    """(a, b) of the pairs (a, b, a_line, b_line) whose shingles reach the threshold.

    The sets pass through a generator: else they would be made as often as the condition names them.
    """
    sets = F.struct(shingles(F.col("a_line")).alias("a"), shingles(F.col("b_line")).alias("b"))
    m, n = F.size("sets.a"), F.size("sets.b")
    # common >= threshold * (all - common)
    enough = F.size(F.array_intersect("sets.a", "sets.b")) >= F.lit(threshold / (1 + threshold)) * (m + n) - 1e-9
    near = (F.least(m, n) >= (threshold - 1e-9) * F.greatest(m, n)) & enough
    return pairs.select("a", "b", F.explode(F.array(sets)).alias("sets")).where(near).select("a", "b")


def _lines(documents: DataFrame) -> DataFrame:
    """One row per line that is not blank: doc, w1, w2 (the document's own key), pos, line, h1, h2."""
    text = F.coalesce("text", F.lit(""))
    rows = documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), text.alias("text"))
    # The keys first: beside the generator a whole text would be hashed for each of its lines.
    whole = rows.select("doc", "text", *_whole(F.col("doc"), F.col("text")))
    keyed = whole.select("doc", "w1", "w2", F.posexplode(F.split(F.lower("text"), "\n")).alias("pos", "line"))
    lines = keyed.select("doc", "w1", "w2", "pos", normalised(F.col("line")).alias("line")).where("line <> ''")
    return lines.select("*", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))


def _whole(doc: Column, text: Column) -> tuple[Column, Column]:
    """128 bits that stand for a document."""
    return F.xxhash64(doc, text).alias("w1"), F.xxhash64(F.lit(1), doc, text).alias("w2")


def _distinct(lines: DataFrame, *more: Column) -> DataFrame:
    """One row per distinct line: h1, h2, line, how often it occurs, its smallest doc, and what ``more`` aggregates.

    Dealt by (h1, h2), so that ``_signed`` finds a line's shingles where the line is.
    """
    return lines.groupBy("h1", "h2").agg(F.min("line").alias("line"), F.count("*").alias("n"), F.min("doc").alias("doc"), *more)


def _signed(nodes: DataFrame, sample: int | None = SAMPLE, kind: int = 0) -> DataFrame:
    """id, h1, h2, n, doc, width, keys (of the bands, null without minima) and found (bits that its different shingles below the limit set, of 64) of every line.

    One row per line, and a second one of the other width for short lines, or for all with a
    ``kind`` above 0; no limit where ``sample`` is none. Wide shingles are nine bytes of UTF-8,
    the others five characters.
    """
    both, wide = F.array(F.lit(WIDE), F.lit(SHINGLE)), F.array(F.lit(WIDE))
    widths = both if kind else F.when(F.length("line") <= SHORT, both).otherwise(wide)
    own = ("h1", "h2", "id")
    kinds = nodes.select(*own, F.col("n").alias("times"), "doc", "line", F.explode(widths).alias("width"))
    is_wide = F.col("width") == WIDE
    octets = F.when(is_wide, F.col("line").cast("binary")).otherwise(F.encode("line", "UTF-32"))
    step, span = F.when(is_wide, 1).otherwise(4), F.when(is_wide, WIDE).otherwise(4 * SHINGLE)
    cut = kinds.select(*own, "times", "doc", "width", octets.alias("b"), step.alias("step"), span.alias("span"))
    last = F.greatest(F.octet_length("b") - F.col("span") + 1, F.lit(1))
    each = cut.select("*", (F.floor((last - 1) / F.col("step")) + 1).alias("n"), F.explode(F.sequence(F.lit(1), last, F.col("step"))).alias("i"))
    hashed = each.select(*own, "times", "doc", "width", "n", "i", F.xxhash64(F.substring(F.col("b"), F.col("i"), F.col("span"))).alias("s"))
    if sample is None:  # such lines hold few different shingles, each many times
        hashed = hashed.groupBy(*own, "width", "s").agg(F.min("times").alias("times"), F.min("doc").alias("doc"))
    else:  # the upper 31 bits, as a share of all, below sample / n; the first row stands for the line
        below = F.shiftrightunsigned("s", 33) * F.col("n") < sample << 31
        hashed = hashed.where(below | (F.col("i") == 1)).withColumn("s", F.when(below, F.col("s")))
    # Each hash function is a one-to-one map of the hashes: a shift, that no two of a band share, and a mask.
    maps = []
    for i in range(BANDS * ROWS):
        mask = (i + 1) * 0x9E3779B97F4A7C15 % 2**64
        by, m = 32 + 7 * i % 23, F.lit(mask - 2**64 if mask >= 2**63 else mask)
        moved = lambda x, by=by: x.bitwiseXOR(F.shiftleft(x, by))  # noqa: E731  one to one, as by is 32 or more
        maps.append(lambda x, moved=moved, m=m: moved(x).bitwiseXOR(m))
    minima = (F.min(to(F.col("s"))).alias(f"m{i}") for i, to in enumerate(maps))
    # One long tells few different shingles from many; the minima themselves are dear to count.
    bits = F.bit_or(F.expr("shiftleft(1L, cast(s & 63 AS int))")).alias("bits")
    least = hashed.groupBy(*own, "width").agg(F.min("times").alias("n"), F.min("doc").alias("doc"), bits, *minima)
    keys = F.array(*(F.xxhash64(F.col("width") + 100 * kind, F.lit(b), *(f"m{b * ROWS + r}" for r in range(ROWS))) for b in range(BANDS)))
    found = F.coalesce(F.bit_count("bits"), F.lit(0))
    return least.select(*own, "n", "doc", "width", F.when(F.col("m0").isNotNull(), keys).alias("keys"), found.alias("found"))


def _marks(texts: DataFrame) -> DataFrame:
    """id, line, size (different five-character shingles) and w0, w1 ... (``64 * WORDS`` bits that they set) of every line.

    The lines are dealt by id first: what their many shingles give is gathered where the line is,
    ``PART`` longs at a time.
    """
    dealt = texts.repartition("id")
    each = dealt.select("id", F.encode("line", "UTF-32").alias("b")).select("id", "b", F.explode(_offsets(F.octet_length("b"), SHINGLE)).alias("i"))
    hashed = each.select("id", F.xxhash64(F.substring(F.col("b"), F.col("i"), F.lit(4 * SHINGLE))).alias("s"))
    placed = hashed.select("id", F.pmod(F.shiftrightunsigned("s", 6), F.lit(WORDS)).alias("word"), F.expr("shiftleft(1L, cast(s & 63 AS int))").alias("bit"))
    where = lambda column, k, value: F.when(F.col(column) == k, F.col(value)).otherwise(F.lit(0).cast("long"))
    part = placed.select("id", F.floor(F.col("word") / PART).alias("part"), (F.col("word") % PART).alias("nth"), "bit")
    bits = part.groupBy("id", "part").agg(*(F.bit_or(where("nth", k, "bit")).alias(f"v{k}") for k in range(PART)))
    words = (F.bit_or(where("part", k // PART, f"v{k % PART}")).alias(f"w{k}") for k in range(WORDS))
    return dealt.select("id", "line", F.size(shingles(F.col("line"))).alias("size")).join(bits.groupBy("id").agg(*words), "id")


def possible(x: str, y: str, threshold: float) -> Column:
    """False only for lines whose similarity is below the threshold, by columns of ``_marks`` with these prefixes.

    A bit that one line alone sets is a shingle of its own at least; the similarity of sets of
    sizes m and n that differ in d shingles is (m + n - d) / (m + n + d).
    """
    m, n = F.col(f"{x}size"), F.col(f"{y}size")
    most = (m + n) * F.lit((1 - threshold) / (1 + threshold)) + 1e-6
    apart = [F.bit_count(F.col(f"{x}w{k}").bitwiseXOR(F.col(f"{y}w{k}"))) for k in range(WORDS)]
    some = sum(apart[1 : WORDS // 2], apart[0])
    close = (some <= most) & (sum(apart[WORDS // 2 :], some) <= most)
    # The lambda keeps a join on this out of whole-stage code: its one method would be too large for the JVM to compile.
    return (F.least(m, n) >= (threshold - 1e-9) * F.greatest(m, n)) & close & F.exists(F.array(m), lambda v: v >= 0)


def duplicate_lines(documents: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, list[str]]:
    """(h1, h2, root, doc) of every distinct line that occurs twice or has a near copy; doc: its component's smallest."""
    lines, at_lines = _written(documents)
    found, paths = _repeated(lines, threshold)
    discard(documents.sparkSession, at_lines)
    return found, paths


def _written(documents: DataFrame) -> tuple[DataFrame, str]:
    """The rows of ``_lines``, each with a number ``at``, written once."""
    return materialise(_lines(documents).select("*", F.monotonically_increasing_id().alias("at")), "lines")


def _repeated(lines: DataFrame, threshold: float) -> tuple[DataFrame, list[str]]:
    """What ``duplicate_lines`` gives, from written lines; a distinct line's id is the smallest ``at`` of its rows."""
    spark = lines.sparkSession
    signed, at_signed = materialise(_signed(_distinct(lines, F.min("at").alias("id"))), "signed")
    release(spark)
    nodes = signed.where(F.col("width") == WIDE).drop("width", "keys", "found")
    # Repetitive lines: few shingles were below the limit, or none.
    few = signed.where((F.col("width") == WIDE) & (F.col("found") < FEWEST)).drop("width", "keys", "found")
    chosen = lines.select("line", F.col("at").alias("id")).join(broadcast_if_small(few, few.count(), 64), "id")
    again = _signed(chosen, None, 1)
    keyed = signed.select("id", "keys").unionByName(again.select("id", "keys"))
    first = elect(keyed.where("keys IS NOT NULL").select(F.explode("keys").alias("key"), "id"))
    release(spark)

    ids = first.pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    # The lines travel, not their sets: eight bytes a shingle would be many times the text.
    texts, at_texts = materialise(ids.join(lines.select(F.col("at").alias("id"), "line"), "id"), "texts")
    release(spark)

    def confirm(pairs: DataFrame) -> DataFrame:
        held = texts
        if pairs.count() <= PAIRS:
            held = texts.join(F.broadcast(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()), "id", "left_semi")
        left, right = (held.select(F.col("id").alias(i), F.col("line").alias(f"{i}_line")) for i in "ab")
        return similar(pairs.join(left, "a").join(right, "b"), threshold)

    # Marks cost more than a comparison or two: only lines that meet many others get them.
    marks = lambda ids: _marks(texts.join(ids, "id")).drop("line")
    table, at_table = linked(first, confirm, marks, lambda x, y: possible(x, y, threshold))
    for path in (*first.paths, at_texts):
        discard(spark, path)

    rooted = nodes.join(table, "id", "left").where("n > 1 OR root IS NOT NULL")
    rooted, at_rooted = materialise(rooted.select("h1", "h2", "doc", F.coalesce("root", "id").alias("root")), "rooted")
    smallest, at_smallest = materialise(rooted.groupBy("root").agg(F.min("doc").alias("doc")), "smallest")
    found, at_found = materialise(rooted.drop("doc").join(smallest, "root"), "repeated")
    for path in (at_signed, *at_table, at_rooted, at_smallest):
        discard(spark, path)
    release(spark)
    return found, [at_found]


def cut_positions(documents: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, list[str]]:
    """(w1, w2, cut): for each document that loses lines, their positions; and the paths to discard."""
    spark = documents.sparkSession
    lines, at_lines = _written(documents)
    repeated, at_repeated = _repeated(lines, threshold)
    rows = lines.select("doc", "w1", "w2", "pos", "h1", "h2").join(repeated.withColumnRenamed("doc", "keeper"), ["h1", "h2"])
    hits, at_hits = materialise(rows.select("doc", "w1", "w2", "pos", "root", "keeper"), "hits")
    discard(spark, at_lines)
    stays = hits.where("doc = keeper").groupBy("root").agg(F.min("pos").alias("first"))
    marked = hits.join(stays, "root").where("NOT (doc = keeper AND pos = first)")
    cuts, at_cuts = materialise(marked.groupBy("w1", "w2").agg(F.collect_set("pos").alias("cut")), "cuts")
    for path in (*at_repeated, at_hits):
        discard(spark, path)
    release(spark)
    return cuts, [at_cuts]


def dedup_lines(documents: DataFrame, threshold: float = THRESHOLD, counts: bool = False) -> DataFrame:
    """The rows of ``documents`` with repeated lines taken out of their texts; with ``counts`` also n_lines and n_cut."""
    cuts, _ = cut_positions(documents, threshold)
    doc = F.coalesce(F.col("_row.doc_id").cast("long"), F.lit(NO_ID))
    keyed = packed(documents).select("_row", *_whole(doc, F.coalesce(F.col("_row.text"), F.lit(""))))
    # The cuts grow with the documents: a plan that broadcasts them would only hold for small tables.
    found = keyed.join(cuts.hint("merge"), ["w1", "w2"], "left")
    lines = F.split(F.col("_row.text"), "\n")
    parts = found.select("_row", "cut", lines.alias("_lines"))
    kept = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), "cut")
    text = F.when(F.col("cut").isNull(), F.col("_row.text")).otherwise(F.array_join(F.transform(kept, lambda i: F.get(F.col("_lines"), i)), "\n"))
    added = (F.greatest(F.size("_lines"), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size("cut"), F.lit(0)).cast("long").alias("n_cut"))
    return parts.select(*unpacked(documents, text=text), *(added if counts else ()))
