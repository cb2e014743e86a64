"""Packing documents into fixed windows by multiway differencing.

Each document is its ids and one end mark. Pieces of a whole window stand alone; what is
left of each document, cut to a quarter window, is packed some hundred windows at a time: every piece starts as a
partial partition (one window with it, the others empty), and the two partial partitions
with the largest imbalance are merged so that the fullest windows of one meet the
emptiest of the other (Karmarkar and Karp), until one partition with nearly equal windows
is left. Where a window exceeds the capacity, the same pieces are differenced again
over one window more.

The work is a map over the scan: no shuffle, and a task holds one group of pieces at
most. A sequence's number is its task's number and a counter, so a task that is run anew
gives the same numbers.

Defined results: a null or empty text is the end mark alone; repeated rows are packed
each; extra columns are ignored; an empty table gives no pieces.
"""

from __future__ import annotations

import heapq
import itertools
import os
import re
import zlib
from collections.abc import Iterator
from struct import pack

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import byte_letters

CAPACITY, END_ID = 2048, 1
#: Windows that are packed together.
GROUP_WINDOWS = 128
#: What is left of a document after its whole windows is cut to this length, so that windows come out even.
CUT = 512
TABLE_ENTRIES, TABLE_WORD = 800_000, 48
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


#: Words of printable ASCII and precomposed Latin letters, which no normal form changes.
_SIMPLE = re.compile("[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]+")
#: The file's pattern on such words, lower-cased.
_TOKEN = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u017f]+|[0-9]|[^a-z0-9\u00df-\u00f6\u00f8-\u017f]+")


class WordEncoder:
    """Ids of whole texts by the tokenizers library, through bounded tables of words.

    The vocabulary's file drops white space and splits there, so a text's ids are those
    of its space-separated words one after the other. A new word in plain Latin letters
    is split as the file says and each part goes to the library's model; any other new
    word goes through the whole library.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.letters = [c for c, _ in sorted(byte_letters().items(), key=lambda x: x[1])]
        self.table: dict[str, bytes] = {}
        self.tokens: dict[str, bytes] = {}

    def _token(self, token: str) -> bytes:
        got = self.tokens.get(token)
        if got is None:
            text = token if token.isascii() else "".join([self.letters[b] for b in token.encode()])
            ids = [t.id for t in self.model.tokenize(text)]
            got = self.tokens[token] = pack(f"<{len(ids)}I", *ids)
        return got

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        for table in (self.table, self.tokens):
            if len(table) > TABLE_ENTRIES:
                table.clear()
        table, token, simple, tokens = self.table, self._token, _SIMPLE.fullmatch, _TOKEN.findall
        split = [t.replace("\n", " ").split(" ") for t in texts]
        seldom, long_words = [], []
        for word in {w for words in split for w in words if w not in table}:
            if simple(word) and "<|" not in word:
                table[word] = b"".join([token(t) for t in tokens(word.lower())])
            else:
                seldom.append(word)
            if len(word) > TABLE_WORD:
                long_words.append(word)
        for at in range(0, len(seldom), 4096):
            part = seldom[at : at + 4096]
            for word, got in zip(part, self.library.encode_batch_fast(part, add_special_tokens=False), strict=True):
                table[word] = pack(f"<{len(got.ids)}I", *got.ids)
        out = [b"".join(map(table.__getitem__, words)) for words in split]
        for word in long_words:
            del table[word]
        return out


def difference(sizes: list[int], windows: int) -> list[list[int]]:
    """Indices of ``sizes`` in ``windows`` parts of nearly equal sums.

    A partial partition keeps only its windows that hold something; the rest are empty.
    """
    count = itertools.count()
    # imbalance, tie, [(sum, members)] sorted by sum, descending; empty windows are left out
    heap = [(-size, next(count), [(size, (i, None))]) for i, size in enumerate(sizes)]
    heapq.heapify(heap)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        if len(a) + len(b) <= windows:
            merged = a + b
        else:  # the fullest of one meet the emptiest of the other, which are empty where there is room
            over = len(a) + len(b) - windows
            low_a, low_b = a[len(a) - over :], b[len(b) - over :]
            merged = a[: len(a) - over] + b[: len(b) - over]
            merged += [(x + y, (m, n)) for (x, m), (y, n) in zip(low_a, reversed(low_b), strict=True)]
        merged.sort(key=lambda w: -w[0])
        low = merged[-1][0] if len(merged) == windows else 0
        heapq.heappush(heap, (low - merged[0][0], next(count), merged))
    parts = []
    for _, members in heap[0][2] if heap else []:
        found, todo = [], [members]
        while todo:
            node = todo.pop()
            if node is None:
                continue
            if isinstance(node, int):
                found.append(node)
            else:
                todo.extend(node)
        parts.append(sorted(found))
    return parts


def pack_pieces(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Windows (lists of indices) that hold all pieces, none above ``capacity``."""
    windows = max(1, -(-sum(sizes) // capacity))
    while True:
        parts = difference(sizes, windows)
        if all(sum(sizes[i] for i in part) <= capacity for part in parts):
            return parts
        windows += 1


def pack_documents(documents: DataFrame, path: str, capacity: int = CAPACITY, group_windows: int = GROUP_WINDOWS, cut: int = CUT) -> DataFrame:
    """One row per piece: where it comes from and where it lies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder(path)
        first = TaskContext.get().partitionId() << 36
        sequences = itertools.count(first)
        held: list[tuple] = []  # doc_id, start, length, crc32, doc_tokens
        held_tokens = 0
        done: list[tuple] = []

        def flush() -> None:
            nonlocal held_tokens
            for part in pack_pieces([p[2] for p in held], capacity) if held else []:
                number, at = next(sequences), 0
                for i in part:
                    done.append((*held[i], number, at))
                    at += held[i][2]
            held.clear()
            held_tokens = 0

        def emit() -> pa.RecordBatch:
            columns = list(zip(*done, strict=True)) if done else [[]] * 7
            done.clear()
            names = [c.split()[0] for c in SCHEMA.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

        end = END_ID.to_bytes(4, "little")
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for doc, ids in zip(batch.column(0).to_pylist(), encoder.encode_batch(texts), strict=True):
                ids += end
                total = len(ids) // 4
                whole = total - total % capacity
                for start in (*range(0, whole, capacity), *range(whole, total, cut)):
                    size = capacity if start < whole else min(cut, total - start)
                    piece = ids[start * 4 : (start + size) * 4]
                    row = (doc, start, size, zlib.crc32(piece), total)
                    if size == capacity:
                        done.append((*row, next(sequences), 0))
                    else:
                        held.append(row)
                        held_tokens += size
                        if held_tokens >= capacity * group_windows:
                            flush()
            yield emit()
        flush()
        yield emit()

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, SCHEMA)
