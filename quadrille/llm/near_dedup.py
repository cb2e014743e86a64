"""Near-duplicate documents by DartMinHash over weighted five-word shingles.

A document is a weighted set: its five-word shingles with their counts. The weight axis of
an element is cut into regions of doubling height, at each of which a fixed random process,
seeded by the element's hash, throws darts in order of rank; the darts below an element's
weight are the document's own, and two documents share a dart where both cover it. Only darts below a rank limit
are thrown, set so that about k ln k + 2 k fall into the document whatever its length.
Each dart belongs to one of k coordinates, and the earliest dart of each coordinate is
the signature: two signatures agree at a coordinate with the probability of the weighted
Jaccard similarity. Should a coordinate stay empty, the limit is doubled.

Sixteen bands of four coordinates make candidates (over 0.999 of the pairs at 0.8), the
exact weighted similarity of both whole texts decides, and the classes are the connected
components of what it confirms. A bucket's members first meet its one or two leaders. What is
left of a bucket in several components is compared too: pair by pair where few are left, else
those outside the largest component meet all in blocks of ``BLOCK`` texts, each block one task
that returns no more links than join its components. So every pair of a bucket was compared or
its ends are in one component, and no pairs of a large bucket travel. Exact copies are one node from the start.

Defined results: a text of one to four words is one shingle; a text without words (null,
empty, blank) is a class of its own, named by its id, so it is never a duplicate of
another document; repeated rows get one class; a class is
named by its smallest doc_id (null if it has none); extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .banding import Election, components, elect
from .common import broadcast_if_small, discard, materialise, packed, unpacked

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 16, 4
TABLE_ENTRIES, LONG_WORD = 1_000_000, 64
#: Distinct shingles of texts whose darts are thrown in one go.
TOGETHER = 1 << 15
#: Left members of a bucket up to which its pairs are verified one by one; members of a block beyond.
FEW, BLOCK = 8, 1024
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_ODD, _S33 = np.uint64(0x9E3779B97F4A7C15), np.uint64(33)


def _mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of MurmurHash3: every bit of the input moves every bit of the output."""
    x = (x ^ (x >> _S33)) * _M1
    x = (x ^ (x >> _S33)) * _M2
    return x ^ (x >> _S33)


class Shingler:
    """Hashes of five-word shingles; words seen before cost a lookup each."""

    def __init__(self):
        self.table: dict[str, int] = {}

    def _word(self, word: str) -> int:
        got = xxhash.xxh64_intdigest(word)
        if len(word) <= LONG_WORD:
            self.table[word] = got
        return got

    def shingles(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Distinct shingle hashes, ascending, and their counts."""
        if len(self.table) > TABLE_ENTRIES:
            self.table.clear()
        known, fresh, words = self.table.get, self._word, text.split()
        hashes = np.array([known(w) or fresh(w) for w in words], dtype=np.uint64)
        if not len(hashes):
            return hashes, np.empty(0, np.int64)
        width = min(SHINGLE, len(hashes))
        rolled = np.full(len(hashes) - width + 1, np.uint64(width))
        for k in range(width):
            rolled = _mix(rolled * _ODD + hashes[k : len(hashes) - width + 1 + k])
        return np.unique(rolled, return_counts=True)


def dart_signature(elements: np.ndarray, weights: np.ndarray, k: int = BANDS * ROWS) -> np.ndarray:
    """The k earliest darts of a weighted set (weights above 0, not all need be whole)."""
    return dart_signatures([(elements, weights)], k)[0]


def dart_signatures(sets: list[tuple[np.ndarray, np.ndarray]], k: int = BANDS * ROWS) -> np.ndarray:
    """A row for each weighted set, none of them empty: its k earliest darts.

    The weight axis is cut into regions 0 to 1, 1 to 2, 2 to 4, 4 to 8 and so on. Darts come
    in each region that a weight reaches at a rate of the region's height, so the darts thrown
    are at most about twice those that land, whatever the weights. All sets are thrown at together.
    """
    elements, weights = np.concatenate([e for e, _ in sets]), np.concatenate([w for _, w in sets])
    owners = np.repeat(np.arange(len(sets)), [len(e) for e, _ in sets])
    reached = 1 + np.ceil(np.log2(np.maximum(weights, 1))).astype(np.int64)
    nth = np.arange(int(reached.sum())) - np.repeat(np.cumsum(reached) - reached, reached)
    cells = _mix(np.repeat(elements, reached) + nth.astype(np.uint64) * _ODD)
    height = np.where(nth == 0, 1.0, 2.0 ** (nth - 1))
    room = np.repeat(weights, reached) - np.where(nth == 0, 0.0, height)  # what the weight covers, from the region's edge
    limit = (k * np.log(k) + 2 * k) / np.bincount(owners, weights, len(sets))
    owners = np.repeat(owners, reached)
    signatures = np.empty((len(sets), k), np.uint64)
    while len(cells):
        state, at, own, space, rate = cells, np.zeros(len(cells)), owners, room, height
        darts, ranks, whose = [], [], []
        while len(state):
            state = _mix(state + _ODD)
            at = at - np.log((state >> np.uint64(11)).astype(np.float64) * 2.0**-53 + 2.0**-54) / rate
            near = at <= limit[own]
            state, at, own, space, rate = state[near], at[near], own[near], space[near], rate[near]
            dart = _mix(state ^ _M1)
            hit = (_mix(dart) >> np.uint64(11)).astype(np.float64) * 2.0**-53 * rate < space  # a dart above the weight does not land
            darts.append(dart[hit])
            ranks.append(at[hit])
            whose.append(own[hit])
        dart, whose = np.concatenate(darts), np.concatenate(whose)
        order = np.argsort(np.concatenate(ranks), kind="stable")
        dart, whose = dart[order], whose[order]
        found, first = np.unique(whose * k + ((dart >> np.uint64(32)) % np.uint64(k)).astype(np.int64), return_index=True)
        full = np.bincount(found // k, minlength=len(sets)) == k
        chosen = full[found // k]
        signatures[found[chosen] // k, found[chosen] % k] = dart[first[chosen]]
        limit = limit * 2
        again = ~full[owners]
        cells, owners, room, height = cells[again], owners[again], room[again], height[again]
    return signatures


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """One signed 64-bit key per band of each signature."""
    parts = signatures.reshape(-1, BANDS, ROWS)
    keys = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), parts.shape[:2])
    for r in range(ROWS):
        keys = _mix(keys * _ODD + parts[:, :, r])
    return keys.view(np.int64)


def text_keys(shingler: Shingler, texts: list[str]) -> list[list[int] | None]:
    """The band keys of each text, null without words; ``TOGETHER`` elements or one longer text at a time."""
    keys: list = [None] * len(texts)
    places, sets, held = [], [], 0
    for i, text in enumerate([*texts, None]):
        weighted = None if text is None else shingler.shingles(text)
        size = 0 if weighted is None else len(weighted[0])
        if sets and (text is None or held + size > TOGETHER):
            for place, row in zip(places, band_keys(dart_signatures(sets)).tolist(), strict=True):
                keys[place] = row
            places, sets, held = [], [], 0
        if size:
            places.append(i)
            sets.append(weighted)
            held += size
    return keys


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two shingle sets."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][i], b[1][j]).sum())
    either = int(a[1].sum() + b[1].sum()) - both
    return both / either if either else 0.0


def _hash_columns(text) -> list:
    """128 bits that stand for a text."""
    return [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2")]


def _signed(documents: DataFrame) -> DataFrame:
    """doc_id, h1, h2, bands (null without words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in batches:
            bands = text_keys(shingler, batch.column(3).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "h1", "h2", "bands"])

    text = F.coalesce("text", F.lit(""))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), *_hash_columns(text), text.alias("text"))
    return rows.mapInArrow(run, "doc_id long, h1 long, h2 long, bands array<long>")


def _verify(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs whose whole texts reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        kept: dict[int, tuple] = {}
        for batch in batches:
            ids = [batch.column(i).to_pylist() for i in range(2)]
            texts = [batch.column(i).to_pylist() for i in (2, 3)]
            out = []
            for a, b, x, y in zip(*ids, *texts, strict=True):
                if len(kept) > 64:
                    kept.clear()
                for i, t in ((a, x), (b, y)):
                    if i not in kept:
                        kept[i] = shingler.shingles(t)
                out.append(similarity(kept[a], kept[b]) >= threshold - 1e-12)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(out, pa.bool_()))

    left = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
    return both.mapInArrow(run, "a long, b long")


def block_links(ids: list, roots: list, texts: list, others: list, threshold: float) -> list[tuple[int, int]]:
    """Links that join the components (roots) of a block: each row of ``others`` (its place) against all rows, by exact weighted similarity."""
    shingler = Shingler()
    sets = [shingler.shingles(t) for t in texts]
    totals = np.array([int(w.sum()) for _, w in sets])
    grams = np.concatenate([e for e, _ in sets])
    order = np.argsort(grams, kind="stable")
    grams, owners = grams[order], np.repeat(np.arange(len(sets)), [len(e) for e, _ in sets])[order]
    counts = np.concatenate([w for _, w in sets])[order]
    parent = {r: r for r in roots}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    found = []
    for i in others:
        elements, weights = sets[i]
        begin, end = np.searchsorted(grams, elements), np.searchsorted(grams, elements, side="right")
        n = end - begin
        at = np.arange(int(n.sum())) + np.repeat(begin - (np.cumsum(n) - n), n)
        both = np.bincount(owners[at], np.minimum(counts[at], np.repeat(weights, n)), len(sets))
        for j in np.flatnonzero(both >= (threshold - 1e-12) * (totals + totals[i] - both)):
            x, y = find(roots[i]), find(roots[j])
            if x != y:
                parent[max(x, y)] = min(x, y)
                found.append((min(ids[i], ids[j]), max(ids[i], ids[j])))
    return found


def _compare(threshold: float):
    def run(group: pa.Table) -> pa.Table:
        rows = group.to_pydict()
        found = block_links(rows["id"], rows["root"], rows["text"], [i for i, first in enumerate(rows["first"]) if first], threshold)
        return pa.table([pa.array(c, pa.int64()) for c in (zip(*found, strict=True) if found else ([], []))], names=["a", "b"])

    return run


def _linked(first: Election, texts: DataFrame, threshold: float) -> tuple[DataFrame, list[str]]:
    """(id, root) of the components over all pairs of bucket members that reach the threshold."""
    table, at_table = components(_verify(first.pairs, texts, threshold))
    # The leaders have met all members of their buckets.
    others = first.shared.where("n > 3").join(first.leaders, "key").where("NOT array_contains(leaders, id)").select("key", "id")
    rooted, at_rooted = materialise(others.join(table, "id", "left").select("key", "id", F.coalesce("root", "id").alias("root")), "rooted")
    sizes = rooted.groupBy("key").agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
    members, at_members = materialise(rooted.join(sizes.select("key", "n"), "key"), "members")
    discard(first.shared.sparkSession, at_rooted)
    if not members.isEmpty():
        a, b = (members.where(F.col("n") <= FEW).select("key", F.col("id").alias(x), F.col("root").alias(f"root_{x}")) for x in "ab")
        pairs = a.join(b, "key").where("a < b AND root_a <> root_b").select("a", "b").distinct()
        single = _verify(pairs.join(first.pairs, ["a", "b"], "left_anti"), texts, threshold)

        large = members.where(F.col("n") > FEW)
        counted = large.groupBy("key", "root").agg(F.count("*").alias("c"))
        most = counted.groupBy("key").agg(F.max(F.struct("c", "root")).alias("most"), F.sum("c").alias("all"))
        largest = most.select("key", F.col("most.root").alias("largest"), F.ceil((F.col("all") - F.col("most.c")) / BLOCK).cast("int").alias("fronts"), F.ceil(F.col("all") / BLOCK).cast("int").alias("backs"))
        placed = large.join(largest, "key").join(texts, "id")
        each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        dealt = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
        left = placed.where("root <> largest").select("key", "id", "root", "text", F.lit(True).alias("first"), dealt("fronts").alias("front"), each("backs").alias("back"))
        right = placed.select("key", "id", "root", "text", F.lit(False).alias("first"), each("fronts").alias("front"), dealt("backs").alias("back"))
        block = left.unionByName(right)
        blocks = block.groupBy("key", "front", "back").applyInArrow(_compare(threshold), "a long, b long")

        edges, at_edges = materialise(single.unionByName(blocks), "edges")
        if not edges.isEmpty():
            known = table.select(F.col("id").alias("a"), F.col("root").alias("b"))
            wider, at_wider = components(known.unionByName(edges))
            for path in at_table:
                discard(first.shared.sparkSession, path)
            table, at_table = wider, at_wider
        discard(first.shared.sparkSession, at_edges)
    discard(first.shared.sparkSession, at_members)
    return table, at_table


def _classed(documents: DataFrame, threshold: float) -> DataFrame:
    """doc_id, h1, h2, blank (no words), root (null if blank) and class_id of every row of ``documents``."""
    spark = documents.sparkSession
    signed, at_signed = materialise(_signed(documents), "signed")
    contents = signed.where("bands IS NOT NULL").groupBy("h1", "h2").agg(F.min("doc_id").alias("first"))
    nodes, at_nodes = materialise(contents.select("h1", "h2", "first", F.monotonically_increasing_id().alias("id")), "nodes")
    # Copies have the same keys: a bucket's rows are made distinct before they meet.
    keyed = signed.where("bands IS NOT NULL").select("h1", "h2", F.explode("bands").alias("key")).distinct()
    first = elect(keyed.join(nodes, ["h1", "h2"]).select("key", "id"))

    wanted = first.pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(nodes, "id").select("id", "h1", "h2")
    wanted, at_wanted = materialise(wanted, "wanted")
    text = F.coalesce("text", F.lit(""))
    rows = documents.select(*_hash_columns(text), text.alias("text"))
    held = rows.join(broadcast_if_small(wanted, wanted.count(), 48), ["h1", "h2"]).groupBy("id").agg(F.first("text").alias("text"))
    texts, at_texts = materialise(held, "texts")
    table, at_table = _linked(first, texts, threshold)
    for path in (*first.paths, at_wanted, at_texts):
        discard(spark, path)

    rooted = nodes.join(table, "id", "left").select("h1", "h2", "first", F.coalesce("root", "id").alias("root"))
    named = rooted.groupBy("root").agg(F.min("first").alias("class_id"))
    by_content, _ = materialise(rooted.join(named, "root").select("h1", "h2", "root", "class_id"), "classes")
    discard(spark, at_nodes)
    for path in at_table:
        discard(spark, path)
    own = signed.select("doc_id", "h1", "h2", F.col("bands").isNull().alias("blank"))
    return own.join(by_content, ["h1", "h2"], "left")


def classes(documents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id and class_id (smallest doc_id of the class): one row per row of ``documents``."""
    return _classed(documents, threshold).select("doc_id", F.when(F.col("blank"), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"))


def keep_one(documents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Of each class the rows of its smallest doc_id (ids before null) and of one text of that id.

    Rows equal in id and text are one document and stay together; texts without words all stay.
    """
    spark = documents.sparkSession
    members, at_members = materialise(_classed(documents, threshold).where("NOT blank").select("root", "doc_id", "h1", "h2").distinct(), "members")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h1", "h2")
    first = members.groupBy("root").agg(F.min(place).alias("first"))
    others = members.join(first, "root").where(~place.eqNullSafe(F.col("first")))
    gone, _ = materialise(others.select(F.col("doc_id").alias("g0"), F.col("h1").alias("g1"), F.col("h2").alias("g2")), "gone")
    discard(spark, at_members)
    placed = packed(documents).select("_row", F.col("_row.doc_id").cast("long").alias("_id"), *_hash_columns(F.coalesce("_row.text", F.lit(""))))
    same = F.col("h1").eqNullSafe(F.col("g1")) & F.col("h2").eqNullSafe(F.col("g2")) & F.col("_id").eqNullSafe(F.col("g0"))
    kept = placed.join(broadcast_if_small(gone, gone.count(), 48), same, "left_anti")
    return kept.select(*unpacked(documents))
