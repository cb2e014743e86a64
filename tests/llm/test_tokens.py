import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quadrille.llm import bpe, packing, token_rollup
from quadrille.llm.queries import BYTE_BPE, WORD_BPE, op6_token_rollup


@pytest.fixture(scope="module")
def vocab():
    return bpe.Vocabulary(BYTE_BPE)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BYTE_BPE)


def ids(data):
    return np.frombuffer(data, dtype="<u4").astype(np.int64)


PARTS = [" ", "  ", "\n", "\n\n", "\t", "a", "the", "ing", "'s", "'ll", "É", "é", "中文", "😀", "12", "½", "....", "---", "<|endoftext|>", "\x1c", "\x85", "\xa0", "aaaa", "_", "S"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=25).map("".join) | st.text(max_size=40))
def test_encoding_is_the_librarys(vocab, library, text):
    got = ids(vocab.encode(text))
    assert got.tolist() == library.encode(text, add_special_tokens=False).ids
    assert vocab.decode(got).decode("utf-8", "replace") == library.decode(got.tolist(), skip_special_tokens=False)


def test_encoder_gives_what_the_merges_give(vocab):
    def by_merging(piece):
        parts = [vocab.id_of[bytes([b])] for b in piece]
        while True:
            found = [(vocab.rank[p][0], i) for i, p in enumerate(zip(parts, parts[1:], strict=False)) if p in vocab.rank]
            if not found:
                return parts
            i = min(found)[1]
            parts[i : i + 2] = [vocab.rank[parts[i], parts[i + 1]][1]]

    rnd = random.Random(5)
    for _ in range(3000):
        piece = "".join(rnd.choice("aabbcdeeeiinrstth  .é") for _ in range(rnd.randint(1, 24))).encode()
        assert vocab.encode_piece(piece) == by_merging(piece)


def test_long_pieces_take_linear_time(vocab):
    import time

    took = []
    for n in (20_000, 80_000):
        began = time.perf_counter()
        vocab.encode_piece(("abcab" * n)[:n].encode())
        took.append(time.perf_counter() - began)
    assert took[1] < 12 * took[0] + 0.2


def test_digests(spark, documents, odd, none, library):
    for df in (documents.limit(60), odd):
        texts = df.select("doc_id", "text").collect()
        got = sorted(map(tuple, bpe.encode_documents(df, BYTE_BPE).collect()), key=str)
        want = []
        for r in texts:
            e = library.encode(r.text or "", add_special_tokens=False).ids
            decoded = library.decode(e, skip_special_tokens=False)
            want.append((r.doc_id, len(e), hashlib.sha256(np.array(e, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
        assert got == sorted(want, key=str)
    assert bpe.encode_documents(none, BYTE_BPE).count() == 0


# -- packing


def test_words_are_the_librarys():
    encoder = packing.WordEncoder(WORD_BPE)
    rnd = random.Random(3)
    letters = [*" \n\tabcé0.,!'<|>ÀΣσİẞſ中😀\x1c\x85́", "'s", "'LL", "<|endoftext|>", "<|startoftext|>", "The"]
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 30))) for _ in range(3000)]
    for text, got in zip(texts, encoder.encode_batch(texts), strict=True):
        assert ids(got).tolist() == encoder.library.encode(text, add_special_tokens=False).ids


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 2048), max_size=80))
def test_windows_hold_every_piece_once(sizes):
    parts = packing.pack_pieces(sizes)
    assert sorted(i for p in parts for i in p) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in p) <= 2048 for p in parts)


def test_differencing_is_even():
    rnd = random.Random(1)
    sizes = [rnd.randint(1, 512) for _ in range(400)]
    sums = [sum(sizes[i] for i in p) for p in packing.difference(sizes, 40)]
    assert len(sums) == 40 and max(sums) - min(sums) < 40
    assert packing.difference([], 3) == []


def test_pieces_cover_documents(spark, documents, odd, none):
    library = Tokenizer.from_file(WORD_BPE)
    for df in (documents.limit(150), odd.where("doc_id <> 5 OR doc_id IS NULL")):
        pieces = packing.pack_documents(df, WORD_BPE).collect()
        by_doc, by_window = {}, {}
        for p in pieces:
            by_doc.setdefault(p.doc_id, []).append(p)
            by_window.setdefault(p.sequence_id, []).append(p)
        for r in df.collect():
            e = [*library.encode(r.text or "", add_special_tokens=False).ids, 1]
            at = 0
            for p in sorted(by_doc[r.doc_id], key=lambda p: p.start):
                assert p.start == at and p.doc_tokens == len(e)
                assert p.ids_crc32 == zlib.crc32(np.array(e[at : at + p.length], "<u4").tobytes())
                at += p.length
            assert at == len(e)
        for window in by_window.values():
            at = 0
            for p in sorted(window, key=lambda p: p["offset"]):
                assert p["offset"] == at
                at += p.length
            assert at <= 2048
    assert packing.pack_documents(none, WORD_BPE).count() == 0


def test_little_padding(spark):
    pieces = packing.pack_documents(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), WORD_BPE)
    row = pieces.selectExpr("sum(length) AS n", "count(DISTINCT sequence_id) AS w").first()
    assert row.n / (row.w * 2048) > 0.97


# -- rollups


def changes(spark, rows):
    return spark.createDataFrame(rows, "change string, source string, lang string, tokenizer string, n_tokens long, old_tokens long")


def totals(rollup):
    return {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens) for r in rollup.totals().collect()}


def test_rollup_batches(spark, tmp_path):
    r = token_rollup.TokenRollup(spark, f"file://{tmp_path}/state")
    assert totals(r) == {}
    first = changes(spark, [("insert", "a", "en", "t1", 5, None), ("insert", "a", "en", "t1", 7, None), ("insert", None, "fr", "t1", None, None)])
    assert r.commit(0, first) and not r.commit(0, first)
    assert totals(r) == {("a", "en", "t1"): (2, 12), (None, "fr", "t1"): (1, 0)}
    assert r.commit(1, changes(spark, [("revise", "a", "en", "t1", 9, 7), ("delete", None, "fr", "t1", 0, None)]))
    assert totals(r) == {("a", "en", "t1"): (2, 14)}
    r.compact()
    assert totals(r) == {("a", "en", "t1"): (2, 14)} and not r.commit(1, first)
    assert r.commit(3, first) and r.commit(2, changes(spark, []))
    r.compact()
    again = token_rollup.TokenRollup(spark, f"file://{tmp_path}/state")
    assert totals(again) == {("a", "en", "t1"): (4, 26), (None, "fr", "t1"): (1, 0)}


def test_a_broken_batch_is_written_over(spark, tmp_path):
    r = token_rollup.TokenRollup(spark, str(tmp_path / "s"))
    (tmp_path / "s" / "batch=0").mkdir(parents=True)
    (tmp_path / "s" / "batch=0" / "part-0.parquet").write_bytes(b"half")
    assert totals(r) == {}
    assert r.commit(0, changes(spark, [("insert", "a", "en", "t", 1, None)]))
    assert totals(r) == {("a", "en", "t"): (1, 1)}
    with pytest.raises(Exception, match="unknown change"):
        r.commit(1, changes(spark, [("upsert", "a", "en", "t", 1, None)]))
    assert totals(r) == {("a", "en", "t"): (1, 1)}


def test_rollup_query(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    want = {}
    for d in docs:
        for kind, n in (("words@1", len(d.text.split())), ("byte_bpe_50k@1", len(library.encode(d.text, add_special_tokens=False).ids))):
            if kind != "words@1" or n:
                a, b = want.get((d.source, d.lang, kind), (0, 0))
                want[d.source, d.lang, kind] = (a + 1, b + n)
    got = {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens) for r in op6_token_rollup(spark, "/root/testdata/sf0.001").collect()}
    assert got == want


def test_paths():
    assert public_tokenizers.path("byte_bpe_50k.json") == BYTE_BPE
