"""Token counts of a byte-level BPE tokenizer, without making any identifiers.

A text is cut into pieces by the tokenizer's pattern. A piece is a linked list of byte
symbols and a heap of its adjacent pairs that can be merged: the pair of lowest rank
(the leftmost of equal ones) is popped and merged until none is left; the
piece's tokens are its initial symbols less its merges. Counts of short pieces are
kept in a bounded store of the worker process.

Defined results: null and empty texts have no tokens and no bytes; a special token's
string in a text counts as one token, as the library has it by default; repeated
rows and null ids are counted like others; texts of any length are counted whole.
"""

from __future__ import annotations

import json
from heapq import heapify, heappop, heappush

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 1024
KEPT = 250_000      # pieces in each of two generations of the store
LONGEST_KEPT = 64   # characters of a piece that is kept

# The byte-level pre-tokenizer's pattern.
PIECES = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


def _byte_symbols() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself
    if it is visible in Latin-1, else the next free one from 256 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in visible]
    return [chr(b) if b in visible else chr(256 + hidden.index(b)) for b in range(256)]


class PairMerger:
    """Ranks of a tokenizer's merges, and the merging of one piece."""

    def __init__(self, vocabulary: dict[str, int], merges: list):
        self.start = [vocabulary[s] for s in _byte_symbols()]
        self.merges: dict[int, tuple[int, int]] = {}  # pair -> rank, merged symbol
        for rank, pair in enumerate(merges):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            key = vocabulary[a] << 32 | vocabulary[b]
            self.merges.setdefault(key, (rank, vocabulary[a + b]))

    def count(self, piece: bytes) -> int:
        symbols = [self.start[b] for b in piece]
        n = left = len(symbols)
        merges = self.merges
        after = list(range(1, n + 1))   # linked list: the next live place, n at the end
        before = list(range(-1, n - 1))
        live: list = [None] * n         # the merge that waits at a place
        heap = []
        for i in range(n - 1):
            m = merges.get(symbols[i] << 32 | symbols[i + 1])
            if m is not None:
                live[i] = m
                heap.append((m[0], i))
        heapify(heap)
        while heap:
            rank, i = heappop(heap)
            m = live[i]
            if m is None or m[0] != rank:
                continue  # one of the two was merged meanwhile
            j = after[i]
            symbols[i], live[i], live[j] = m[1], None, None
            k = after[i] = after[j]
            left -= 1
            if k < n:
                before[k] = i
                m = merges.get(symbols[i] << 32 | symbols[k])
                if m is not None:
                    live[i] = m
                    heappush(heap, (m[0], i))
            h = before[i]
            if h >= 0:
                m = live[h] = merges.get(symbols[h] << 32 | symbols[i])
                if m is not None:
                    heappush(heap, (m[0], h))
        return left


class Counter(dict):
    """Piece -> tokens; counts what it does not hold."""

    def __init__(self, path: str):
        super().__init__()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["model"]["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["normalizer"]:
            raise ValueError("a byte-level BPE tokenizer is wanted")
        self.merger = PairMerger(spec["model"]["vocab"], spec["model"]["merges"])
        self.older: dict[str, int] = {}
        marks = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, marks))) if marks else None

    def __missing__(self, piece: str) -> int:
        n = self.older.get(piece)
        if n is None:
            n = self.merger.count(piece.encode())
        if len(piece) <= LONGEST_KEPT:
            if len(self) >= KEPT:
                self.older = dict(self)
                self.clear()
            self[piece] = n
        return n

    def count(self, text: str) -> int:
        parts = self.special.split(text) if self.special else [text]
        return len(parts) - 1 + sum(sum(map(self.__getitem__, PIECES.findall(p))) for p in parts)


_COUNTERS: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """One counter a worker process and file."""
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path)
    return _COUNTERS[path]


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
                 limit: int = LIMIT) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row, by the tokenizer file ``path``."""
    kept = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches):
        own = counter(path)
        for batch in batches:
            texts = pc.fill_null(batch.column("text"), "")
            counts = pa.array([own.count(x.as_py()) for x in texts], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pc.binary_length(texts).cast(pa.int64()), counts,
                 pc.greater(counts, limit)], names=["id", "n_bytes", "n_tokens", "over_limit"])

    kind = kept.schema["id"].dataType.simpleString()
    return kept.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean")
