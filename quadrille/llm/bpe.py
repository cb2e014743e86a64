"""Byte-level BPE by backtracking, and decoding by an offset table.

Encoding. An Aho-Corasick automaton over the vocabulary's byte strings lists all tokens
in a piece of text in one pass; from that the longest token at each position follows.
The encoder walks left to right with the longest token, and accepts it if the pair
(previous token, token) is *compatible*: merging the two tokens' bytes by the merge
ranks would keep the border between them. If no shorter token fits either, the position
is marked dead and the previous token is shortened. Each position dies once at most, so
the time is linear, and the result is what the merges give.

Texts are split into pieces first, as the vocabulary's file asks; pieces repeat, so each
Python worker keeps a bounded table of encoded pieces.

Decoding. All tokens' bytes lie end to end in one array; an offset table says where each
starts, and a batch of ids is decoded by one gather.

Defined results: a null text is empty and has no ids; the special token's own string in
a text is that token; repeated rows are encoded each; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from struct import pack

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries that a worker's table of pieces holds before it starts anew, and the longest piece kept.
TABLE_ENTRIES, TABLE_PIECE = 800_000, 48
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_RUN = re.compile(r"\s\s|\s\Z")


def byte_letters() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file, and that byte.

    Visible Latin-1 characters stand for themselves; the other bytes, in order, for U+0100 on.
    """
    plain = [b for b in range(256) if unicodedata.category(chr(b))[0] in "LNPS" and b != 0xAD]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens, merges, the automaton and the decode table of one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte_of = byte_letters()
        raw = {i: bytes(byte_of[c] for c in t) for t, i in spec["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = raw | {i: s.encode() for s, i in self.special.items()}
        ids = {b: i for i, b in raw.items()}
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for r, (a, b) in enumerate(spec["model"]["merges"]):
            x, y = (ids[bytes(byte_of[c] for c in t)] for t in (a, b))
            merged = ids[raw[x] + raw[y]]
            self.rank[x, y] = (r, merged)
            self.parts.setdefault(merged, (r, x, y))
        self.fits: dict[int, bool] = {}
        # Only tokens that their own merges produce can stand in a result.
        real = {i: b for i, b in raw.items() if len(b) == 1 or i in self.parts}
        self.auto = ahocorasick.Automaton()
        for i, b in real.items():
            self.auto.add_word(b.decode("latin-1"), (len(b), i))
        self.auto.make_automaton()
        self.id_of = {b: i for i, b in real.items()}
        self.shorter: dict[int, int] = {}
        for i, b in real.items():
            cut = next((self.id_of[b[:n]] for n in range(len(b) - 1, 0, -1) if b[:n] in self.id_of), -1)
            self.shorter[i] = cut
        size = max(self.bytes_of) + 1
        self.length = [len(self.bytes_of.get(i, b"")) for i in range(size)]
        self.offsets = np.concatenate([[0], np.cumsum(np.array(self.length, dtype=np.int64))])
        self.blob = np.frombuffer(b"".join(self.bytes_of.get(i, b"") for i in range(size)), dtype=np.uint8)
        self.table: dict[str, bytes] = {}
        self.spaced: dict[str, bytes] = {}
        self.split = regex.compile(PIECES).findall
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None

    def compatible(self, left: int, right: int) -> bool:
        """Whether BPE over the bytes of ``left`` + ``right`` ends with a border between them.

        Undo the merges of both sides from the latest: a pair that the merges would join
        before the later of its two sides is complete crosses the border.
        """
        a, b, at, ok = left, right, len(self.rank), True
        while True:
            found = self.rank.get((a, b))
            if found is not None and found[0] < at:
                ok = False
                break
            ra, rb = self.parts.get(a, (-1,))[0], self.parts.get(b, (-1,))[0]
            if ra < 0 and rb < 0:
                break
            if ra > rb:  # the left side was completed last: before that, its right part stood at the border
                at, a = ra, self.parts[a][2]
            else:  # the right side was; a pair of the same rank at the border lies further left and merges first
                at, b = rb + 1, self.parts[b][1]
        if len(self.fits) > 2_000_000:
            self.fits.clear()
        self.fits[left << 20 | right] = ok
        return ok

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one piece."""
        if piece in self.id_of:  # a whole token is its own encoding: its merges all lie within
            whole = self.id_of[piece]
            return [whole]
        longest: list[int] = [-1] * len(piece)
        for end, (n, token) in self.auto.iter(piece.decode("latin-1")):
            longest[end - n + 1] = token  # later ends are longer
        lengths, dead, out, starts, at = self.length, bytearray(len(piece) + 1), [], [], 0
        fits, compatible, shorter, size = self.fits, self.compatible, self.shorter, len(piece)
        token, last = longest[0], -1
        while at < size:
            while token >= 0:
                end = at + lengths[token]
                if not dead[end]:
                    ok = True if last < 0 else fits.get(last << 20 | token)
                    if ok or (ok is None and compatible(last, token)):
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                starts.append(at)
                at, last = end, token
                token = longest[at] if at < size else -1
            else:
                dead[at] = 1
                token, at = out.pop(), starts.pop()
                last = out[-1] if out else -1
        return out

    def _ids(self, piece: str) -> bytes:
        ids = self.encode_piece(piece.encode())
        return pack(f"<{len(ids)}I", *ids)

    def _lookup(self, piece: str) -> bytes:
        got = self.table.get(piece)
        if got is None:
            got = self._ids(piece)
            if len(piece) <= TABLE_PIECE:
                if len(self.table) >= TABLE_ENTRIES:
                    self.table.clear()
                self.table[piece] = got
        return got

    def _word(self, word: str) -> bytes:
        """Ids of a word after one space."""
        pieces = self.split(" " + word)
        got = self._ids(pieces[0]) if len(pieces) == 1 else b"".join(map(self._lookup, pieces))
        if len(word) <= TABLE_PIECE:
            if len(self.spaced) >= TABLE_ENTRIES:
                self.spaced.clear()
            self.spaced[word] = got
        return got

    def _plain(self, text: str) -> bytes:
        """Ids of a text without special tokens."""
        if _RUN.search(text):
            return b"".join(map(self._lookup, self.split(text)))
        # No two white spaces in a row: each single space starts a piece, as does each line end.
        out, spaced, known, lookup = [], self._word, self.spaced.get, self._lookup
        for nth, line in enumerate(text.split("\n")):
            first, *rest = line.split(" ")
            if nth:
                out.append(lookup("\n"))
            if first:
                out.extend(map(lookup, self.split(first)))
            out.extend([known(w) or spaced(w) for w in rest])
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        if self.cut is None or not any(s in text for s in self.special):
            return self._plain(text)
        parts = self.cut.split(text)
        return b"".join(np.array([self.special[p]], dtype="<u4").tobytes() if i % 2 else self._plain(p) for i, p in enumerate(parts))

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of the ids: one gather from the blob of all tokens."""
        first, length = self.offsets[ids], self.offsets[ids + 1] - self.offsets[ids]
        ends = np.cumsum(length)
        total = int(ends[-1]) if len(ends) else 0
        index = np.arange(total, dtype=np.int64) + np.repeat(first - (ends - length), length)
        return self.blob[index].tobytes()


_loaded: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """One per Python worker and file."""
    if path not in _loaded:
        _loaded[path] = Vocabulary(path)
    return _loaded[path]


def encode_documents(documents: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row: one map over the scan, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            n, ids_hash, text_hash = [], [], []
            for text in batch.column(1).to_pylist():
                ids = vocab.encode(text or "")
                n.append(len(ids) // 4)
                ids_hash.append(hashlib.sha256(ids).hexdigest())
                decoded = vocab.decode(np.frombuffer(ids, dtype="<u4").astype(np.int64))
                text_hash.append(hashlib.sha256(decoded.decode("utf-8", "replace").encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def count_tokens(documents: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """``keys`` and n_tokens of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            n = [len(vocab.encode(t or "")) // 4 for t in batch.column(len(keys)).to_pylist()]
            columns = [batch.column(i) for i in range(len(keys))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n, pa.int64())], names=[*keys, "n_tokens"])

    rows = documents.select(*keys, F.col("text"))
    fields = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    return rows.mapInArrow(run, f"{fields}, n_tokens long")
