import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrille.llm import banding, line_dedup, near_dedup, queries


def find(parent, x):
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def test_components(spark):
    rnd = random.Random(8)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)] + [(5, 5)]
    parent = {x: x for e in edges for x in e}
    for a, b in edges:
        x, y = find(parent, a), find(parent, b)
        parent[max(x, y)] = min(x, y)
    table, _ = banding.components(spark.createDataFrame(edges, "a long, b long"))
    got = {r.id: r.root for r in table.collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: find(parent, x) for x in linked}
    empty, _ = banding.components(spark.createDataFrame([], "a long, b long"))
    assert empty.count() == 0


def test_leaders_keep_pairs_linear(spark):
    members = spark.createDataFrame([("hot", i) for i in range(2000)] + [("b", 1), ("b", 2), ("c", 9)], "key string, id long").selectExpr("xxhash64(key) AS key", "id")
    pairs, _ = banding.candidate_pairs(members)
    rows = pairs.collect()
    assert len(rows) <= 4 * 2000 and (1, 2) in {tuple(r) for r in rows} and all(r.a < r.b for r in rows)
    assert {x for r in rows for x in r} == set(range(2000))


def test_all_pairs_of_a_bucket_count(spark):
    """A ring of near neighbours without a centre, and a bucket where nothing matches: linked as by all pairs."""
    ring, apart = 1100, 50
    members = [("ring", i * 7 % ring) for i in range(ring)] + [("apart", 5000 + i) for i in range(apart)] + [("three", 9000 + i) for i in range(3)]
    first = banding.elect(spark.createDataFrame(members, "key string, id long").selectExpr("xxhash64(key) AS key", "id"))
    confirmed = f"a < {ring} AND (b - a = 1 OR b - a = {ring - 1}) OR a = 9001 AND b = 9002"
    table, _ = banding.linked(first, lambda pairs: pairs.where(confirmed))
    roots = {r.id: r.root for r in table.collect()}
    assert roots == {i: 0 for i in range(ring)} | {9001: 9001, 9002: 9001}


def test_large_buckets_make_rows_only_for_possible_pairs(spark):
    """A bucket of 400 with five copies each of 80 things: no pair of two things reaches what verifies."""
    n, kinds = 400, 80
    first = banding.elect(spark.createDataFrame([(7, i) for i in range(n)], "key long, id long"))
    marks = spark.range(n).selectExpr("id", f"id % {kinds} AS kind")
    seen = []

    def confirm(pairs):
        rows = pairs.collect()
        seen.append(len(rows))
        return pairs.where(f"a % {kinds} = b % {kinds}")

    table, _ = banding.linked(first, confirm, marks, lambda x, y: F.col(f"{x}kind") == F.col(f"{y}kind"))
    roots = {r.id: r.root for r in table.collect()}
    assert roots == {i: i % kinds for i in range(n)} and sum(seen) <= 2 * n + n * (n // kinds)


def test_both_sides_of_a_meeting_are_dealt_beforehand(spark, monkeypatch):
    """A join whose sides Spark deals itself is split, on large keys, into the parts of one side times those of the other."""
    plans, written = [], banding.materialise

    def noted(df, label):
        if label == "pairs":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return written(df, label)

    first = banding.elect(spark.createDataFrame([(7, i) for i in range(600)], "key long, id long"))
    monkeypatch.setattr(banding, "materialise", noted)
    monkeypatch.setattr(banding, "BLOCK", 100)
    table, _ = banding.linked(first, lambda pairs: pairs.where("a + 300 = b"))
    assert {r.id: r.root for r in table.collect()} == {i: i % 300 for i in range(600)}
    assert len(plans) == 2 and all(plan.count("REPARTITION_BY_COL") >= 2 for plan in plans)


# -- documents


def weights(text):
    words = text.split()
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else Counter()


def likeness(a, b):
    both = sum((a & b).values())
    either = sum(a.values()) + sum(b.values()) - both
    return both / either if either else 0.0


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(6)
    for share, heavy in ((0.5, 1), (0.8, 1), (0.7, 9), (0.6, 2.5)):
        agree = []
        for _ in range(40):
            elements = rng.integers(0, 2**63, 300).astype(np.uint64)
            w = np.where(np.arange(300) % 7 == 0, heavy, 1.0)
            n = int(300 * share)
            a = near_dedup.dart_signature(elements, w, 64)
            keep = np.arange(300) < n
            b = near_dedup.dart_signature(np.where(keep, elements, rng.integers(0, 2**63, 300).astype(np.uint64)), w, 64)
            agree.append((a == b).mean())
        true = w[:n].sum() / (2 * w.sum() - w[:n].sum())
        assert abs(np.mean(agree) - true) < 0.05


def edited(rnd, words, n):
    out = list(words)
    for _ in range(n):
        out[rnd.randrange(len(out))] = f"w{rnd.randrange(10**6)}"
    return " ".join(out)


@pytest.fixture(scope="module")
def corpus():
    rnd = random.Random(11)
    texts = []
    for g in range(12):
        base = [f"g{g}x{rnd.randrange(5000)}" for _ in range(rnd.randint(60, 400))]
        texts += [" ".join(base)] * rnd.randint(1, 3)
        texts += [edited(rnd, base, rnd.randint(1, max(1, len(base) // 60))) for _ in range(rnd.randint(0, 12))]
        texts += [edited(rnd, base, len(base) // 2)]
    texts += ["a b c", "a b c", "a b d", "", "", None, "   "]
    rnd.shuffle(texts)
    return list(enumerate(texts))


def test_classes_against_brute_force(spark, corpus):
    sets = {i: weights(t or "") for i, t in corpus}
    parent = {i: i for i in sets}
    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and likeness(sets[i], sets[j]) >= 0.8:
                x, y = find(parent, i), find(parent, j)
                parent[max(x, y)] = min(x, y)
    df = spark.createDataFrame(corpus, "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in near_dedup.classes(df).collect()}
    assert got == {i: find(parent, i) for i in sets}
    kept = near_dedup.keep_one(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == set(got.values())


def test_one_large_group_of_near_copies(spark):
    rnd = random.Random(2)
    base = [f"x{i}" for i in range(200)]
    rows = [(i, edited(rnd, base, 2)) for i in range(600)] + [(10_000 + i, " ".join(base)) for i in range(300)]
    got = near_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string")).select("class_id").distinct().collect()
    assert [r.class_id for r in got] == [0]


def test_family_without_a_centre(spark):
    """1100 texts of one base that is not among them: 149 of their 604450 pairs reach the threshold."""
    rnd = random.Random(31)
    base = [f"b{i}" for i in range(204)]
    texts = []
    for _ in range(1100):
        words = list(base)
        for at in rnd.sample(range(204), 4):
            words[at] = f"e{rnd.randrange(10**9)}"
        texts.append(" ".join(words))
    # All shingles of a text differ; an edited shingle has a random word and is no other text's.
    common = {g: k for k, g in enumerate(weights(" ".join(base)))}
    own = np.zeros((1100, len(common)), np.float32)
    for i, text in enumerate(texts):
        own[i, [common[g] for g in weights(text) if g in common]] = 1
    both = own @ own.T
    parent = {i: i for i in range(1100)}
    for i, j in np.argwhere(np.triu(both >= 0.8 * (400 - both), 1)):
        x, y = find(parent, int(i)), find(parent, int(j))
        parent[max(x, y)] = min(x, y)
    want = {i: find(parent, i) for i in range(1100)}
    got = {r.doc_id: r.class_id for r in near_dedup.classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == want


def test_odd_documents(odd, none):
    got = near_dedup.classes(odd).collect()
    assert len(got) == odd.count() and Counter(r.class_id for r in got)[5] == 2
    assert near_dedup.classes(none).count() == 0 and near_dedup.keep_one(odd).count() == odd.count()


def test_one_row_of_each_class_stays(spark):
    """An id with two texts of which one is a copy, and copies without ids."""
    a, b, c = (" ".join(f"{k}{i}" for i in range(100)) for k in "abc")
    rows = [(1, a), (2, a), (2, b), (3, b), (None, c), (None, c + " more"), (None, b), (None, "")]
    kept = near_dedup.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = Counter((r.doc_id, "c" if r.text.startswith("c") else r.text) for r in kept)
    assert got == {(1, a): 1, (2, b): 1, (None, "c"): 1, (None, ""): 1}


# -- lines


def every_shingle(line):
    return frozenset(line[i : i + 5] for i in range(max(1, len(line) - 4)))


def lines_by_brute_force(rows):
    where, parent = {}, {}
    for doc, text in rows:
        for pos, line in enumerate((text or "").split("\n")):
            line = line.strip(" \t\r\x0b\f").lower()
            if line:
                where.setdefault(line, []).append((doc, pos))
    sets = {x: every_shingle(x) for x in where}
    parent = {x: x for x in where}
    names = list(where)
    for i, a in enumerate(names):
        for b in names[:i]:
            both = len(sets[a] & sets[b])
            if both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(parent, a), find(parent, b)
                parent[x] = y
    groups = {}
    for x, at in where.items():
        groups.setdefault(find(parent, x), []).extend(at)
    cut = {p for at in groups.values() for p in sorted(at)[1:]}
    return {doc: None if text is None else "\n".join(x for p, x in enumerate(text.split("\n")) if (doc, p) not in cut) for doc, text in rows}


def test_lines_against_brute_force(spark):
    rnd = random.Random(4)
    pool = [" ".join(f"w{rnd.randrange(400)}" for _ in range(rnd.randint(6, 60))) for _ in range(60)]
    rows = []
    for i in range(60):
        lines = []
        for _ in range(rnd.randint(0, 9)):
            line = rnd.choice(pool).split()
            if rnd.random() < 0.4:
                line[rnd.randrange(len(line))] = "edit"
            lines.append(rnd.choice(["", "  "]) + " ".join(line).title() if rnd.random() < 0.3 else " ".join(line))
            if rnd.random() < 0.3:
                lines.append(rnd.choice(["", "short line", "} // end"]))
        rows.append((i, "\n".join(lines)))
    rows.append((99, None))
    df = spark.createDataFrame([(*r, 3) for r in rows], "doc_id long, text string, n_lines int")
    out = line_dedup.dedup_lines(df)
    assert out.columns == df.columns
    assert {r.doc_id: r.text for r in out.collect()} == lines_by_brute_force(rows)


def test_marks_hide_no_copy(spark):
    """Every pair that reaches the threshold is possible, by lines of all lengths; of those far from it few are."""
    rnd = random.Random(17)
    lines = ["ab", "abcde", "é" * 50]
    for length in (8, 30, 200, 900, 4000):
        base = [rnd.choice("abcdefghij klmnö中") for _ in range(length)]
        for edits in (0, 1, 2, length // 60, length // 45, length // 20, length // 5):
            line = list(base)
            for at in rnd.sample(range(length), edits):
                line[at] = rnd.choice("xyz")
            lines.append("".join(line))
    lines = sorted(set(lines))
    marks = line_dedup._marks(spark.createDataFrame(list(enumerate(lines)), "id long, line string"))
    x, y = (marks.select(*(F.col(c).alias(f"{p}_{c}") for c in marks.columns if c != "line")) for p in "xy")
    got = {tuple(r) for r in x.join(y, line_dedup.possible("x_", "y_", 0.8)).select("x_id", "y_id").collect()}
    far = 0
    for i, a in enumerate(lines):
        for j, b in enumerate(lines):
            a_set, b_set = every_shingle(a), every_shingle(b)
            likely = len(a_set & b_set) / len(a_set | b_set)
            assert likely < 0.8 or (i, j) in got
            far += likely < 0.4 and (i, j) in got
    assert far <= len(lines)


def test_lines_run_without_python(spark, documents):
    nodes = line_dedup._distinct(line_dedup._lines(documents)).selectExpr("*", "monotonically_increasing_id() AS id")
    plan = line_dedup._signed(nodes)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_odd_lines(odd, none):
    out = {r.doc_id: r.text for r in line_dedup.dedup_lines(odd).collect()}
    assert out[1] is None and out[2] == "" and out[5] == "same text here, twice in the table"
    assert line_dedup.dedup_lines(none).count() == 0


def test_near_copies_of_a_line(spark):
    line = "all work and no play makes jack a dull boy, " * 4
    rows = [(1, line + "end"), (2, line + "End"), (3, line.replace("jack", "jill", 1) + "end"), (4, "something else that is long enough to count")]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == rows[0][1] and got[2] == "" and got[4] == rows[3][1]


def test_one_character_more_in_unspaced_text(spark):
    rnd = random.Random(5)
    letters = "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(400))
    han = "".join(chr(0x4E00 + rnd.randrange(3000)) for _ in range(300))
    prose = "the quick brown fox jumps over the lazy dog while seven wizards boil their magic potions"
    rows = [(1, letters), (2, "x" + letters), (3, han), (4, han[:150] + "x" + han[150:]), (5, prose), (6, prose.replace("lazy", "lozy"))]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: letters, 2: "", 3: han, 4: "", 5: prose, 6: ""}


def test_short_lines_repeat_exactly(spark, tmp_path):
    rows = [(1, "Read more\n\nLes.\nRead mare"), (2, " read more \n\nnew\nLes."), (3, "更多\nabc"), (4, "更多\nabd")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.text, r.n_cut) for r in queries.op5_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {1: (rows[0][1], 0), 2: ("\nnew", 2), 3: (rows[2][1], 0), 4: ("abd", 1)}
    kept = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == {k: v for k, (v, _) in got.items()}


def test_recall_of_edited_lines(spark):
    """Pairs of a line and its edits that reach 0.8 by all five-character shingles, of any length: at least 0.95 in one class."""
    rnd = random.Random(12)
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    lines = sorted({x.strip().lower() for t in texts if t for x in t.split("\n")} - {""})
    chosen = [x for x in rnd.sample(lines, 1500) if len(x) < 3000]
    letters = "abcdefghijklmnopqrstuvwxyz "
    pairs = []
    for x in chosen:
        y = list(x)
        for _ in range(rnd.choice((1, 1, 2, max(1, len(x) // 60)))):
            at, kind = rnd.randrange(len(y)), rnd.randrange(3)
            y[at : at + (kind > 0)] = [rnd.choice(letters)] if kind < 2 else []
            y = y or ["a"]
        y = "".join(y).strip()
        a, b = every_shingle(x), every_shingle(y)
        if y and y != x and len(a & b) >= 0.8 * len(a | b):
            pairs.append((x, y))
    assert len(pairs) > 800
    docs = spark.createDataFrame([(i, "\n".join(p)) for i, p in enumerate(pairs)], "doc_id long, text string").repartition(4)
    found, _ = line_dedup.duplicate_lines(docs)
    roots = {r.line: r.root for r in line_dedup._distinct(line_dedup._lines(docs)).join(found, ["h1", "h2"]).select("line", "root").collect()}
    caught = sum(a in roots and roots[a] == roots.get(b) for a, b in pairs)
    print("recall", caught / len(pairs), len(pairs))
    assert caught >= 0.95 * len(pairs)


def test_repetitive_lines(spark):
    """Lines of few different shingles: any limit may leave none of them."""
    rows = [(i, "=-" * n + tail) for i, (n, tail) in enumerate([(40, ""), (400, ""), (1000, "="), (900, "a line after it")])]
    rows += [(10 + i, c * n) for i, (c, n) in enumerate([("_", 30), ("_", 3000), ("ab", 700), ("ba", 500), ("abcdefghijk", 300), ("cdefghijkab", 200)])]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i for i, t in got.items() if t} == {0, 3, 10, 12, 14}


def test_first_pairs_need_no_marks(spark, monkeypatch):
    """Marks are made for lines that meet in what is left of a bucket, not for each line of a pair."""
    marked, marks = [], line_dedup._marks

    def counted(texts):
        marked.append(texts.count())
        return marks(texts)

    monkeypatch.setattr(line_dedup, "_marks", counted)
    rnd = random.Random(6)
    words = lambda n: " ".join(f"w{rnd.randrange(10**6)}" for _ in range(n))
    pairs = [words(40) for _ in range(30)]
    family = words(60).split()  # each member differs from the next in one word, from most others in many
    rows = [(i, f"{x}\n{x} end") for i, x in enumerate(pairs)]
    for i in range(40):
        family[i] = f"v{i}"
        rows.append((100 + i, " ".join(family)))
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == lines_by_brute_force(rows)
    assert sum(marked) <= 40


def test_texts_are_hashed_once(spark):
    """The key of a document is made before its lines are: not once for each line."""
    lines = line_dedup._lines(spark.createDataFrame([(1, "a\nb")], "doc_id long, text string"))
    plan = lines._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("Generate")]
    assert "AS w1" not in above and "AS w1" in plan


def test_repetitive_lines_are_found_few(spark):
    """Different shingles are told by bits: few for repetitive lines and none below the limit, many for others."""
    rnd = random.Random(3)
    lines = ["=-" * 400, "_" * 3000, "word " * 2000] + [" ".join(f"w{rnd.randrange(10**6)}" for _ in range(40)) for _ in range(20)]
    nodes = spark.createDataFrame([(i, i, 1, 1, i, x) for i, x in enumerate(lines)], "h1 long, h2 long, n long, doc long, id long, line string")
    found = {r.id: r.found for r in line_dedup._signed(nodes).where("width = 9").collect()}
    assert all(found[i] < line_dedup.FEWEST for i in range(3)) and all(found[i] >= line_dedup.FEWEST for i in range(3, 23))
    keys = line_dedup._signed(nodes.where("id < 3"), None, 1).select("keys").collect()
    assert len(keys) == 6 and all(len(r[0]) == 12 for r in keys)


def test_columns_of_any_name(spark):
    rows = [(1, "a line that stays\nand one more", 5, "x", 6, 7), (2, "a line that stays", 5, "y", 6, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, `a.b` int, _row string, line int, `c``d` int")
    for got in (line_dedup.dedup_lines(df), near_dedup.keep_one(df)):
        assert got.columns == df.columns and got.count() == 2
    assert {r.doc_id: r.text for r in line_dedup.dedup_lines(df).collect()} == {1: rows[0][1], 2: ""}
