"""Exact top-k inner-product search by vector-approximation files.

Two files are written once. The exact file holds the vectors; the approximation file holds
for each the codes of its cells, a byte per component: every dimension is cut into
``CELLS`` cells of equal width between its least and greatest value over the whole table.

Queries are dealt into blocks of at most about ``QUERY_BYTES``. For each block the approximation
file is scanned where it lies: a code gives a lower and an upper bound of a score, and a row
is a candidate of a query while its upper bound reaches the kth lower bound seen so far. No
vector is sent anywhere for that. Then, for all blocks at once, the exact vectors of the
candidates are read in the order of their bounds: first the ``FIRST`` k best of each query,
then those whose upper bound still reaches the kth score found; nothing beyond can be in the
result. So what is shuffled is the candidates and the exact file twice, whatever the number
of blocks.

Of rows with one and the same vector only the k + 1 smallest ids can be in a result, so a
vector that very many rows share costs no more than those.

Defined results: vectors without id, null, or with null or non-finite components take no
part; a query is compared with candidates of its own length; a repeated query id is
answered once, for its smallest vector, and no row of its id is a candidate; repeated
candidates each count; scores beyond 64 bits are held at the ends of the range; vectors with
components beyond ``LARGE`` have no bounds and are always read; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialise

SCALE, CELLS, FIRST = 256, 256, 2
QUERY_BYTES, SCAN_ROWS, SCAN_QUERIES = 16 << 20, 4096, 1024
LARGE = 1e15
_EDGES, _CODES = "dims int, pos int, low double, high double", "rid long, vec_id long, dims int, large boolean, codes binary"
_FOUND = "query_id long, rid long, lower double, upper double"


def _lists(column) -> list[np.ndarray]:
    """The vectors of an Arrow list column."""
    flat, offsets = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    offsets = offsets - offsets[0]
    return [flat[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def _by_length(column) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, places, matrix of floor(SCALE * x)) of a batch of vectors."""
    rows = _lists(column)
    lengths = np.array([len(r) for r in rows], dtype=np.int64)
    for d in np.unique(lengths):
        at = np.flatnonzero(lengths == d)
        with np.errstate(over="ignore"):
            yield int(d), at, np.floor(SCALE * np.array([rows[i] for i in at], dtype=np.float64).reshape(len(at), d))


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Least and greatest value of each dimension, once per task."""
    seen: dict[int, tuple] = {}
    for batch in batches:
        for d, _, values in _by_length(batch.column(0)):
            held = values[(np.abs(values) <= LARGE).all(axis=1)]
            if d and len(held):
                low, high = held.min(axis=0), held.max(axis=0)
                if d in seen:
                    low, high = np.minimum(low, seen[d][0]), np.maximum(high, seen[d][1])
                seen[d] = low, high
    for d, (low, high) in seen.items():
        yield pa.RecordBatch.from_arrays([pa.array([d] * d, pa.int32()), pa.array(range(d), pa.int32()), pa.array(low), pa.array(high)], names=["dims", "pos", "low", "high"])


def cells_of(values: np.ndarray, low: np.ndarray, width: np.ndarray) -> np.ndarray:
    """The codes of rows of values."""
    return np.floor((values - low) / width).astype(np.uint8)


def _coded(edges: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes: list = [b""] * batch.num_rows
            large = np.zeros(batch.num_rows, bool)
            for d, at, values in _by_length(batch.column(2)):
                large[at] = (np.abs(values) > LARGE).any(axis=1)
                if d in edges:
                    made = cells_of(np.where(large[at][:, None], edges[d][0], values), *edges[d])
                    for i, code in zip(at, made, strict=True):
                        codes[i] = code.tobytes()
            dims = pa.array([len(x) for x in _lists(batch.column(2))], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), dims, pa.array(large), pa.array(codes, pa.binary())], names=["rid", "vec_id", "dims", "large", "codes"])

    return run


class Bounds:
    """Bounds of the scores of a block of queries of one length, and the kth lower bound seen so far of each."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, low: np.ndarray, width: np.ndarray, k: int):
        self.ids, self.k, self.width = ids, k, width.astype(np.float32)
        self.large = (np.abs(queries) > LARGE).any(axis=1)
        q = np.where(self.large[:, None], 0, queries)
        self.scaled = (q * width).astype(np.float32)
        self.base = q @ low
        # Rounding of the 32-bit product, on the safe side.
        slack = (np.abs(q) * (np.abs(low) + CELLS * width)).sum(axis=1) * (len(low) + 8) * 2.0**-23 + 1
        self.above = np.maximum(q, 0) @ (width - 1) + slack
        self.below = np.minimum(q, 0) @ (width - 1) - slack
        self.best = np.full((len(ids), k), -np.inf)

    def scan(self, vec_ids: np.ndarray, large: np.ndarray, codes: np.ndarray):
        """(query place, row place, lower, upper) of the candidates among some rows."""
        sums = (self.scaled @ codes.astype(np.float32).T).astype(np.float64) + self.base[:, None]
        lower, upper = sums + self.below[:, None], sums + self.above[:, None]
        lower[:, large], upper[:, large] = -np.inf, np.inf
        lower[self.large], upper[self.large] = -np.inf, np.inf
        own = self.ids[:, None] == vec_ids[None, :]
        lower[own], upper[own] = -np.inf, np.nan
        most = lower if lower.shape[1] <= self.k else np.partition(lower, lower.shape[1] - self.k, axis=1)[:, -self.k :]
        self.best = -np.sort(-np.concatenate([self.best, most], axis=1), axis=1)[:, : self.k]
        q, v = np.nonzero(upper >= self.best[:, -1:])
        return q, v, lower[q, v], upper[q, v]


def _scan(block, k: int):
    """Candidates of a broadcast block of queries: {dims: (ids, queries, low, width)}."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list[Bounds]] = {}
        for d, (ids, queries, low, width) in block.value.items():
            parts[d] = [Bounds(ids[i : i + SCAN_QUERIES], queries[i : i + SCAN_QUERIES], low, width, k) for i in range(0, len(ids), SCAN_QUERIES)]
        for whole in batches:
            for start in range(0, whole.num_rows, SCAN_ROWS):
                batch = whole.slice(start, SCAN_ROWS)
                rid, vec, dims, large = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
                for d in np.unique(dims):
                    at = np.flatnonzero(dims == d)
                    codes = np.frombuffer(b"".join(batch.column(4).take(pa.array(at)).to_pylist()), np.uint8)
                    codes = codes.reshape(len(at), -1) if len(codes) else np.zeros((len(at), d), np.uint8)
                    for bounds in parts.get(int(d), ()):
                        q, v, lower, upper = bounds.scan(vec[at], large[at], codes)
                        yield pa.RecordBatch.from_arrays([pa.array(bounds.ids[q]), pa.array(rid[at][v]), pa.array(lower), pa.array(upper)], names=["query_id", "rid", "lower", "upper"])

    return run


def whole_number(x: float) -> int:
    """floor(SCALE * x), where that product may be beyond all floats."""
    return math.floor(SCALE * x) if math.isfinite(SCALE * x) else SCALE * int(x)


def _scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """query_id, vec_id and the exact score of pairs of vectors."""
    least, most = -(2**63), 2**63 - 1
    for batch in batches:
        scores = np.zeros(batch.num_rows, dtype=object)
        left = {d: (at, x) for d, at, x in _by_length(batch.column(2))}
        for d, at, y in _by_length(batch.column(3)):
            x = left[d][1]
            small = (np.abs(x).max(axis=1, initial=0) * np.abs(y).max(axis=1, initial=0) * d) < 2**52
            scores[at] = np.einsum("ij,ij->i", np.where(small[:, None], x, 0), np.where(small[:, None], y, 0)).astype(np.int64)
            for i in at[~small]:
                pairs = zip(batch.column(2)[i].as_py(), batch.column(3)[i].as_py(), strict=True)
                scores[i] = max(least, min(most, sum(whole_number(a) * whole_number(b) for a, b in pairs)))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([int(s) for s in scores], pa.int64())], names=["query_id", "vec_id", "score"])


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding and dims of the rows that take part."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", fine)).select("*", F.size("embedding").alias("dims"))


def _first(n: int, key, *order: Column) -> Column:
    return F.row_number().over(Window.partitionBy(*key).orderBy(*order)) <= n


def _blocks(asked: DataFrame, edges: dict) -> Iterator[dict]:
    """Blocks of queries for a broadcast, each of at most about QUERY_BYTES."""
    total = asked.agg(F.coalesce(F.sum(F.col("dims") + 1), F.lit(0))).first()[0] * 8
    n = max(1, math.ceil(total / QUERY_BYTES))
    for b in range(n):
        found: dict[int, tuple[list, list]] = {}
        for row in asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(n)) == b).toLocalIterator():
            ids, vectors = found.setdefault(row.dims, ([], []))
            ids.append(row.vec_id)
            vectors.append([float(whole_number(x)) if abs(x) < 1e300 else math.copysign(1e302, x) for x in row.embedding])
        none = np.zeros(0), np.ones(0)
        yield {d: (np.array(ids, np.int64), np.array(v, np.float64).reshape(len(ids), d), *edges.get(d, none if not d else (np.zeros(d), np.ones(d)))) for d, (ids, v) in found.items()}


def candidates(vectors: DataFrame, queries: DataFrame, k: int) -> tuple[DataFrame, DataFrame, DataFrame, list[str]]:
    """The exact file, the queries, each query's candidate rows with their bounds, and the paths to discard."""
    spark = vectors.sparkSession
    same = F.xxhash64("embedding"), F.xxhash64(F.lit(1), "embedding")
    hashed = usable(vectors).select("*", same[0].alias("g1"), same[1].alias("g2"))
    few = hashed.select("*", _first(k + 1, ("g1", "g2"), F.col("vec_id")).alias("_first")).where("_first")
    exact, at_exact = materialise(few.select(F.monotonically_increasing_id().alias("rid"), "vec_id", "embedding"), "exact")
    ranges = exact.select("embedding").mapInArrow(_ranges, _EDGES).groupBy("dims", "pos").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    edges: dict = {}
    for row in ranges.orderBy("dims", "pos").toLocalIterator():  # as many rows as the vectors have components
        edges.setdefault(row.dims, ([], []))[0].append(row.low)
        edges[row.dims][1].append(max(1, math.ceil((row.high - row.low + 1) / CELLS)))
    edges = {d: (np.array(low), np.array(width, np.float64)) for d, (low, width) in edges.items()}
    codes, at_codes = materialise(exact.select("rid", "vec_id", "embedding").mapInArrow(_coded(edges), _CODES), "codes")
    asked, at_asked = materialise(usable(queries).groupBy("vec_id").agg(F.min("embedding").alias("embedding")).select("*", F.size("embedding").alias("dims")), "asked")
    found, paths = None, [at_exact, at_codes, at_asked]
    for block in _blocks(asked, edges):
        sent = spark.sparkContext.broadcast(block)
        one, path = materialise(codes.mapInArrow(_scan(sent, k), _FOUND), "candidates")
        sent.unpersist()
        found, paths = one if found is None else found.unionByName(one), [*paths, path]
    bar = found.select("*", _first(k, ("query_id",), F.desc("lower")).alias("_first")).where("_first").groupBy("query_id").agg(F.count("*").alias("n"), F.min("lower").alias("bar"))
    kept = found.join(bar, "query_id").where(f"n < {k} OR upper >= bar").select("query_id", "rid", "lower", "upper")
    return exact, asked, kept, paths


def score(pairs: DataFrame, exact: DataFrame, asked: DataFrame) -> DataFrame:
    """query_id, vec_id and exact score of (query_id, rid)."""
    named = asked.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    both = pairs.join(exact, "rid").join(named, "query_id").select("query_id", "vec_id", "query", "embedding")
    return both.mapInArrow(_scores, "query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best of ``vectors`` for each row of ``queries``."""
    spark = vectors.sparkSession
    exact, asked, kept, paths = candidates(vectors, queries, k)
    ranked, at_ranked = materialise(kept.select("*", _first(FIRST * k, ("query_id",), F.desc("upper"), F.col("rid")).alias("first")), "ranked")
    one, at_one = materialise(score(ranked.where("first").select("query_id", "rid"), exact, asked), "scores")
    bar = one.select("*", _first(k, ("query_id",), F.desc("score"), F.col("vec_id")).alias("_first")).where("_first").groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("bar"))
    open_ended = ranked.where("NOT first").join(bar, "query_id").where(f"n < {k} OR upper >= bar").select("query_id", "rid")
    two, at_two = materialise(score(open_ended, exact, asked), "scores")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    for path in (*paths, at_ranked):
        discard(spark, path)
    placed = one.unionByName(two).select("*", F.row_number().over(order).alias("rank")).where(F.col("rank") <= k)
    return placed.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
