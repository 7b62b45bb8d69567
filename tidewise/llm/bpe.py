"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over the last ``WINDOW`` bytes cuts texts into chunks of about
``CHUNK`` bytes wherever the hash has a fixed pattern, so equal passages give equal
chunks in whatever document and at whatever place they stand. A task encodes
each distinct chunk once and keeps it in a bounded store; within chunks, the words
between blanks are encoded once each.

A cut may fall anywhere in a word, so a chunk's first and last word are not final.
Each join is repaired: the two broken words are put together and encoded, along with
the next whole word on either side, and the window is widened, word by word, until
its outer words have exactly the ids that their chunks gave them.

Blank and line feed separate words in every tokenizer whose normaliser or
pre-tokenizer removes white space; ``check`` compares a task's first texts with
the library's own result, so another kind of tokenizer raises an error.

Defined results: null and empty texts give no ids and the empty text; repeated
rows and null ids are encoded like others; strings of special tokens in a text are
treated as the library does by default; texts of any length are encoded whole.
"""

from __future__ import annotations

import os
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewise.llm import hashing as H

WINDOW = 16
CHUNK = 1024           # bytes, about; a power of two
KEPT_CHUNKS = 10_000   # in a task's store
KEPT_WORDS = 320_000   # in each of two generations; the older one goes first
LONGEST_KEPT = 64      # characters of a word that is kept
JOINED = 200           # new words in one call of the library
EDGE = 8               # whole words at either end of a chunk that a window may take in
CHECKED_TEXTS = 2      # of a task's first batch, compared with the library's result

_ROLL = H.mix64(np.arange(256, dtype=np.uint64) + np.uint64(0x51ED))


def chunk_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Chunk boundaries (all text boundaries included) of UTF-8 texts laid end to
    end; never within a character."""
    if len(data) <= WINDOW:
        return np.unique(offsets)
    forward, backward = H._powers(len(data) + 1)
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_ROLL[data] * forward[:len(data)])])
        rolled = H.mix64((sums[WINDOW:] - sums[:-WINDOW]) * backward[:len(data) - WINDOW + 1])
    cuts = np.flatnonzero((rolled & np.uint64(CHUNK - 1)) == 0) + WINDOW
    cuts = cuts[cuts < len(data)]
    cuts = cuts[(data[cuts] & 0xC0) != 0x80]
    # a window that reaches back into the text before would depend on it
    text = np.searchsorted(offsets, cuts, side="right") - 1
    return np.unique(np.concatenate([offsets, cuts[cuts - offsets[text] >= WINDOW]]))


class Encoder:
    """Encodes texts with one tokenizer file; keeps words and chunks between calls."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        self.pieces: list[str] = [""] * (max(vocabulary.values(), default=-1) + 1)
        for piece, i in vocabulary.items():
            self.pieces[i] = piece
        self.spelled: pa.Array | None = None
        self.words: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}
        self.chunks: dict[bytes, tuple[str, bytes, list[str], list[str], str] | str] = {}
        self.checked = False

    def _encode(self, texts: list[str]) -> list[bytes]:
        got = self.library.encode_batch(texts, add_special_tokens=False)
        return [array("i", e.ids).tobytes() for e in got]

    def _encode_words(self, words: list[str]) -> list[bytes]:
        """The ids of words without blanks: many are joined by blanks for one call of the
        library, and told apart again by where their tokens begin."""
        out: list[bytes] = []
        groups = [words[i:i + JOINED] for i in range(0, len(words), JOINED)]
        got = self.library.encode_batch([" ".join(g) for g in groups], add_special_tokens=False)
        for group, e in zip(groups, got):
            starts = np.cumsum([0, *(len(w) + 1 for w in group)])
            begins = np.array(e.offsets, np.int64).reshape(-1, 2)[:, 0]
            bounds = np.searchsorted(begins, starts).tolist()
            raw = array("i", e.ids).tobytes()
            out += [raw[4 * a:4 * b] for a, b in zip(bounds[:-1], bounds[1:])]
        return out

    def _learn(self, words) -> dict[str, bytes]:
        """The ids of words, all of which are then kept (long ones: returned only)."""
        known, older = self.words, self.older
        words = set(words)
        new = words.difference(known)
        if len(known) + len(new) > KEPT_WORDS:
            self.older, self.words = known, {"": b""}
            known, older = self.words, self.older
            new = words
        unknown = list(new.difference(older))
        again = new.difference(unknown)
        known.update(zip(again, map(older.__getitem__, again)))
        known.update(zip(unknown, self._encode_words(unknown)))
        return {w: known.pop(w) for w in unknown if len(w) > LONGEST_KEPT}

    def _ids(self, words: list[str], long: dict[str, bytes]) -> list[bytes]:
        known = self.words
        if not long:
            return list(map(known.__getitem__, words))
        return [known[w] if w in known else long[w] for w in words]

    def _read_chunks(self, blocks: list[bytes]) -> list:
        """Of each chunk: its text if it has no blank, else its first broken word, the
        inner words' ids, the first and the last ``EDGE`` of them, and its last broken word."""
        if len(self.chunks) > KEPT_CHUNKS:
            self.chunks = {}
        new = {b: b.decode().replace("\n", " ").split(" ") for b in dict.fromkeys(blocks)
               if b not in self.chunks}
        long = self._learn(chain.from_iterable(parts[1:-1] for parts in new.values()))
        for block, parts in new.items():
            inner = list(filter(None, parts[1:-1]))
            self.chunks[block] = parts[0] if len(parts) == 1 else (
                parts[0], b"".join(self._ids(inner, long)), inner[:EDGE], inner[-EDGE:], parts[-1])
        return [self.chunks[b] for b in blocks]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """The ids of each text, as the bytes of 32-bit integers."""
        bounds = chunk_starts(data, offsets)
        raw = data.tobytes()
        starts, ends = bounds[:-1].tolist(), bounds[1:].tolist()
        read = self._read_chunks([raw[a:b] for a, b in zip(starts, ends)])
        first = np.searchsorted(bounds, offsets).tolist()
        texts, joins = [], []
        for a, b in zip(first[:-1], first[1:]):
            parts, broken, left = [], "", []
            for chunk in read[a:b]:
                if isinstance(chunk, str):
                    broken += chunk
                    continue
                head, ids, opening, closing, tail = chunk
                parts += [(left, broken + head, opening), ids]
                broken, left = tail, closing
            parts.append((left, broken, []))
            joins += parts[0::2]
            texts.append(parts)
        fixed = iter(self._repaired(joins))
        return [b"".join(next(fixed) if isinstance(p, tuple) else p for p in parts) for parts in texts]

    def _repaired(self, joins: list[tuple[list[str], str, list[str]]]) -> list[bytes]:
        """The ids of the broken words between chunks, agreed with their surroundings."""
        long = self._learn([word for _, word, _ in joins])
        out = self._ids([word for _, word, _ in joins], long)
        open_, width = [i for i, (left, w, right) in enumerate(joins) if w and (left or right)], 1
        while open_:
            around = [(joins[i][0][-width:], joins[i][2][:width]) for i in open_]
            windows = [" ".join([*a, joins[i][1], *b]) for i, (a, b) in zip(open_, around)]
            seen = {w: None for w in windows}
            for w, ids in zip(seen, self._encode(list(seen))):
                seen[w] = ids
            wider = []
            for i, (a, b), w in zip(open_, around, windows):
                before, after = b"".join(self._whole(a)), b"".join(self._whole(b))
                ids = seen[w]
                if ids.startswith(before) and ids.endswith(after) and len(ids) >= len(before) + len(after):
                    out[i] = ids[len(before):len(ids) - len(after)]
                elif width >= max(len(joins[i][0]), len(joins[i][2])):
                    raise ValueError("blanks do not separate words in this tokenizer")
                else:
                    wider.append(i)
            open_, width = wider, width + 1
        return out

    def _whole(self, words: list[str]) -> list[bytes]:
        known = self.words
        return [known[w] if w in known else self._encode([w])[0] for w in words]

    def check(self, data: np.ndarray, offsets: np.ndarray, got: list[bytes]) -> None:
        for i in range(0 if self.checked else min(CHECKED_TEXTS, len(got))):
            text = data[offsets[i]:offsets[i + 1]].tobytes().decode()
            if self._encode([text])[0] != got[i]:
                raise ValueError("blanks do not separate words in this tokenizer")
        self.checked = True

    def decode(self, ids: np.ndarray) -> str:
        """As the library's decode without a decoder, special tokens kept."""
        return " ".join(map(self.pieces.__getitem__, ids.tolist()))

    def decode_all(self, ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
        """``decode`` of texts whose ids stand end to end, text i's at ``bounds[i]:bounds[i + 1]``."""
        if self.spelled is None:  # each piece with a blank behind it, then each as it is
            self.spelled = pa.array([p + " " for p in self.pieces] + self.pieces, pa.large_string())
        ids = ids.astype(np.int64)
        ids[bounds[1:][np.diff(bounds) > 0] - 1] += len(self.pieces)  # the last of each text
        spelled = self.spelled.take(pa.array(ids))
        ends = np.frombuffer(spelled.buffers()[1], np.int64, len(ids) + 1)[bounds].astype(np.int32)
        return pa.StringArray.from_buffers(len(bounds) - 1, pa.py_buffer(ends), spelled.buffers()[2])


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder a worker process and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _encoded(batch: pa.RecordBatch, column: str, own: Encoder) -> Iterator[tuple[int, int, list[bytes]]]:
    data, offsets = H.utf8(batch.column(column))
    for a, b in H.chunks(offsets):
        part, at = data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]
        got = own.encode(part, at)
        own.check(part, at, got)
        yield a, b, got


def encoded(docs: DataFrame, path: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",),
            decode: bool = True) -> DataFrame:
    """The kept columns, ``ids`` (array of int) and, if asked for, ``decoded``."""
    inputs = docs.select(*[F.col(c) for c in keep], F.col(text_col).alias("__text"))
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in inputs.schema.fields[:-1]]
    names = [*keep, "ids", *["decoded"] * decode]

    def run(batches):
        own = encoder(path)
        for batch in batches:
            for a, b, got in _encoded(batch, "__text", own):
                some = batch.slice(a, b - a)
                lengths = np.array([0, *map(len, got)]).cumsum() // 4
                flat = np.frombuffer(b"".join(got), np.int32)
                ids = pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), pa.array(flat))
                columns = [some.column(i) for i in range(len(keep))] + [ids]
                if decode:
                    columns.append(own.decode_all(flat, lengths))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return inputs.mapInArrow(run, ", ".join([*kinds, "ids array<int>", *["decoded string"] * decode]))
