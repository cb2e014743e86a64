import math

import numpy as np
import pytest

from quadrille.llm import quality_model, topk_search


def brute(rows, k, wanted):
    fine = [(i, v) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    ints = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in fine]
    out = []
    for q in sorted({i for i, _ in ints if wanted(i)}):
        query = min(v for i, v in ints if i == q)
        scored = sorted((-sum(a * b for a, b in zip(query, v, strict=True)), i) for i, v in ints if i != q and len(v) == len(query))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return out


def search(spark, rows, k=5, wanted="vec_id % 3 = 0"):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    return sorted(map(tuple, topk_search.top_k(df, df.where(wanted), k).collect()))


def test_against_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[7][1]) for i in range(9)]  # ties
    rows += [(2000, None), (2001, [float("nan")] * 8), (2002, [float("inf")] * 8), (2003, [None] + [0.0] * 7), (None, [0.0] * 8), (3, rows[3][1])]
    assert search(spark, rows) == brute(rows, 5, lambda i: i % 3 == 0)


def test_few_vectors_and_lengths(spark):
    rows = [(0, [1.0, 2.0]), (1, [0.5, 0.5]), (3, [1.0]), (6, []), (9, [])]
    assert search(spark, rows) == brute(rows, 5, lambda i: i % 3 == 0)
    assert search(spark, rows[:1]) == [] and search(spark, []) == []


def test_huge_components_stay_exact(spark):
    rows = [(i, [float(2**20 + i), -float(i), 3.0]) for i in range(12)]
    assert search(spark, rows) == brute(rows, 5, lambda i: i % 3 == 0)


def test_few_exact_reads(spark, monkeypatch):
    """The bounds leave most vectors unread, and the result is exact, over several blocks of queries too."""
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=32) / 8).tolist()) for i in range(1500)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    queries = df.where("vec_id % 50 = 0")
    monkeypatch.setattr(topk_search, "QUERY_BYTES", 33 * 8 * 8)
    _, asked, kept, paths = topk_search.candidates(df, queries, 5)
    assert asked.count() == 30 and len([p for p in paths if "/candidates-" in p]) == 4
    assert kept.count() < 0.03 * 30 * 1500
    assert sorted(map(tuple, topk_search.top_k(df, queries, 5).collect())) == brute(rows, 5, lambda i: i % 50 == 0)


def test_bounds_hold():
    rng = np.random.default_rng(5)
    values = np.floor(256 * rng.normal(size=(300, 16)) * 2.0 ** rng.integers(-3, 9, size=16))
    low, width = values.min(axis=0), np.maximum(1, np.ceil((np.ptp(values, axis=0) + 1) / topk_search.CELLS))
    codes = topk_search.cells_of(values, low, width)
    bounds = topk_search.Bounds(np.arange(20), values[:20], low, width, 300)
    q, v, lower, upper = bounds.scan(np.arange(300), np.zeros(300, bool), codes)
    scores = np.einsum("ij,ij->i", values[q], values[v])
    assert len(q) == 20 * 299 and (lower <= scores).all() and (scores <= upper).all()


def test_one_vector_in_many_rows_and_other_columns(spark):
    rows = [(i, [1.0, 1.0]) for i in range(300)] + [(1000, [2.0, 0.5]), (1002, [-1.0, 3.0])]
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "vec_id long, embedding array<float>, rid int, `a.b` int, rank int")
    asked = df.where("vec_id IN (0, 1002)")
    assert topk_search.candidates(df, asked, 2)[0].count() == 5
    assert sorted(map(tuple, topk_search.top_k(df, asked, 2).collect())) == brute(rows, 2, lambda i: i in (0, 1002))


# -- quality


@pytest.fixture(scope="module")
def scored(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    return quality_model.classify(docs, labels).join(labels, "doc_id").select("doc_id", "held_out", "score", "predicted", "quality").collect()


def test_held_out_accuracy(scored):
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in scored)
    held = [r for r in scored if r.held_out]
    assert len(held) > 500 and all(0 <= r.score <= 1 for r in held)
    for label in (0, 1):
        own = [r for r in held if r.quality == label]
        assert sum(r.predicted == label for r in own) > 0.93 * len(own)


def test_scores_do_not_see_held_out_labels(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    held = "crc32(cast(cast(doc_id AS string) AS binary)) % 5 = 0"
    flipped = labels.selectExpr("doc_id", f"IF({held}, 1 - quality, quality) AS quality")
    a, b = ({r.doc_id: r.score for r in quality_model.classify(docs, x).collect()} for x in (labels, flipped))
    assert a == b


def test_odd_rows_and_no_labels(spark, odd, none):
    labels = spark.createDataFrame([(5, 1), (5, 0), (7, None), (None, 1), (9, 3)], "doc_id long, quality int")
    got = quality_model.classify(odd, labels).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in quality_model.classify(odd, labels.limit(0)).collect()} == {0.5}
    assert quality_model.classify(none, labels).count() == 0


def test_whole_texts_are_read(spark):
    rows = [(i, ("good " if i % 2 else "bad ") * 50) for i in range(60)] + [(1001, "filler " * 3000 + "good " * 9000), (1002, "filler " * 3000 + "bad " * 9000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    got = {r.doc_id: r.score for r in quality_model.classify(docs, labels).collect()}
    assert got[1001] > 0.5 > got[1002]


def test_scorer_is_the_mean_and_softmax(spark):
    """The per-word table against the plain formula: learned vectors averaged over all features, then softmax."""
    rng = np.random.default_rng(3)
    bags = [(y, *quality_model.bag(t)) for y, t in [(1, "some good words here"), (0, "bad bad words"), (1, "good é text"), (0, "")]]
    logits, bias = quality_model.train([(y, i.astype(np.int64), c.astype(np.float64)) for y, i, c in bags])
    scorer = quality_model.Scorer(logits, bias)
    words = [f"w{i}" for i in range(50)] + ["é", "good", "bad"]
    for n in (1, 3, 40, 400, 0):
        text = " ".join(words[i] for i in rng.integers(0, len(words), n))
        ids, counts = quality_model.bag(text)
        mean = (logits[ids] * counts).sum() / counts.sum() if len(ids) else 0.0
        both = np.exp([0.0, mean + bias])
        assert math.isclose(scorer.score(text), both[1] / both.sum(), rel_tol=1e-6)
    small = quality_model.TABLE_ENTRIES
    try:
        quality_model.TABLE_ENTRIES = 3
        again = quality_model.Scorer(logits, bias)
        assert [again.score(t) for t in ("a b c d e f", "good words", "a b c d e f")] == [scorer.score(t) for t in ("a b c d e f", "good words", "a b c d e f")]
    finally:
        quality_model.TABLE_ENTRIES = small
