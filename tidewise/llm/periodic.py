"""Periodic runs of words: passages that repeat a block of words over and over.

A run is a stretch of consecutive words with smallest period q (words q apart are the
same) and a length of at least max(SHORTEST, REPEATS * q) that no neighbouring word
extends. Found by recursive frequency splitting:

1. A word of such a run stands in it at least REPEATS times. Words that occur less often
   within the current segment (at first: the text) split it, and pieces shorter than
   SHORTEST words go; the counts of what is left are smaller, so this is
   repeated until nothing changes. All texts of a batch are split together, each round
   looking at the words that are left only.
2. Surviving segments are scanned lag by lag: where words equal those q further on for
   long enough, there is a run. Only lags that can have one are scanned: with
   a window of w words, q <= w <= 2 q (or w = 16 for q < 8), a run holds at least one window
   whose next equal one is exactly q further on, as its block is no repetition itself. Window
   numbers are exact; they are made by doubling, so n words cost about n log(n) steps.

Words are compared by 64-bit hashes; the words of every run found are then
compared themselves, and a text whose hashes collide is done again with exact numbers.

Defined results: null and empty texts, and texts of separators alone, have no words
and no runs, and collapse to the empty text; repeated rows and null ids are
handled like others; texts of any length are searched whole. Only the id and text
columns (and, if given, the plant's) are read, so other columns may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewise.llm import hashing as H

SHORTEST = 24
REPEATS = 3
WINDOW = 16  # words of the shortest window; its lags leave room for it in SHORTEST words
JOINED = 1 << 14  # words joined at once

SCHEMA = ("n_words long, runs array<struct<start:long,length:long,period:long>>, "
          "kept array<struct<start:long,end:long>>, collapsed_sha256 string")
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of each word of some texts laid end to end, and the offsets of each
    text's words."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~H.SEPARATORS[data]
    begins, ends = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    begins[edges] |= inside[1:-1][edges]
    ends[edges - 1] |= inside[1:-1][edges - 1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


def split_segments(words: np.ndarray, at: np.ndarray, shortest: int = SHORTEST,
                   repeats: int = REPEATS) -> list[tuple[int, int]]:
    """Stretches of words in which, counted within the stretch, every word occurs at least
    ``repeats`` times; each lies in one text ``words[at[i]:at[i + 1]]``."""
    sizes = np.diff(at)
    place = np.flatnonzero(np.repeat(sizes >= shortest, sizes))
    segment = np.repeat(np.arange(len(sizes)), sizes)[place]
    value = words[place]
    while len(place):
        order = np.lexsort((value, segment))
        v, s = value[order], segment[order]
        new = np.concatenate([[True], (v[1:] != v[:-1]) | (s[1:] != s[:-1])])
        group = np.cumsum(new) - 1
        stays = np.empty(len(place), bool)
        stays[order] = np.bincount(group)[group] >= repeats
        kept, parts = place[stays], segment[stays]
        if not len(kept):
            return []
        # a piece ends where a word is missing or a segment ends
        cut = np.concatenate([[True], (kept[1:] != kept[:-1] + 1) | (parts[1:] != parts[:-1])])
        piece = np.cumsum(cut) - 1
        length = np.bincount(piece)
        long = length[piece] >= shortest
        if long.all() and len(kept) == len(place):
            first = np.flatnonzero(cut)
            return [(int(place[i]), int(place[i]) + int(n)) for i, n in zip(first, length)]
        place, segment = kept[long], piece[long]
        value = words[place]
    return []


def _numbered(pairs: np.ndarray) -> np.ndarray:
    return np.unique(pairs, return_inverse=True)[1].astype(np.int64)


def _windows(words: np.ndarray, largest: int) -> Iterator[tuple[int, np.ndarray]]:
    """(w, the number of the window of w words that begins at each place) for w = 16, 32, ..."""
    number, w = _numbered(words), 1
    while w < WINDOW or w < 2 * largest:
        if len(number) <= w:
            return
        number = _numbered(number[:-w] * (number.max() + 1) + number[w:])
        w *= 2
        if w >= WINDOW:
            yield w, number
        if number.max() + 1 == len(number):  # no window occurs twice
            return


def _lags(words: np.ndarray, shortest: int, repeats: int) -> list[int]:
    """Lags at which a run is possible: enough windows follow each other whose next equal
    ones are that far on."""
    largest, found = len(words) // repeats, set()
    low = 1
    for w, number in _windows(words, largest):
        order = np.argsort(number, kind="stable")
        same = number[order][1:] == number[order][:-1]
        ahead = np.zeros(len(number), np.int64)
        ahead[order[:-1][same]] = (order[1:] - order[:-1])[same]
        ahead[(ahead < low) | (ahead > min(w, largest))] = 0
        cut = np.flatnonzero(np.concatenate([[True], ahead[1:] != ahead[:-1]]))
        q, n = ahead[cut], np.diff(np.append(cut, len(ahead)))
        good = (q > 0) & (n >= np.maximum(shortest, repeats * q) - q - w + 1)
        found.update(q[good].tolist())
        low = w + 1
        if low > largest:
            break
    return sorted(found)


def lag_scan(words: np.ndarray, shortest: int = SHORTEST, repeats: int = REPEATS) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of one segment."""
    runs: dict[tuple[int, int], int] = {}
    for q in _lags(words, shortest, repeats):
        same = np.concatenate([[False], words[q:] == words[:-q], [False]])
        turn = np.flatnonzero(same[1:] != same[:-1])
        begin, end = turn[0::2], turn[1::2] + q
        long = end - begin >= max(shortest, repeats * q)
        for a, b in zip(begin[long].tolist(), end[long].tolist()):
            # a stretch with a smaller period was found at that lag, with the same bounds
            runs.setdefault((a, b - a), q)
    return [(a, n, q) for (a, n), q in runs.items()]


def periodic_runs(words: np.ndarray, at: np.ndarray, shortest: int = SHORTEST, repeats: int = REPEATS
                  ) -> dict[int, list[tuple[int, int, int]]]:
    """Text number -> its runs by start, then period (places counted within the text)."""
    out: dict[int, list[tuple[int, int, int]]] = {}
    for a, b in split_segments(words, at, shortest, repeats):
        if runs := lag_scan(words[a:b], shortest, repeats):
            text = int(np.searchsorted(at, a, side="right")) - 1
            out.setdefault(text, []).extend((int(a - at[text]) + s, n, q) for s, n, q in runs)
    return {text: sorted(runs, key=lambda r: (r[0], r[2])) for text, runs in out.items()}


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Mask of the words that no run holds after its first period."""
    edge = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return np.cumsum(edge[:-1]) == 0


def best_run(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of the greatest length/period; ties: the smallest start, then period."""
    best = None
    for r in sorted(runs, key=lambda r: (r[0], r[2])):
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    return best


def cyclic(n: int, seed: int) -> np.ndarray:
    """Places of the words of a text with a planted repetition, by a number ``seed``."""
    index = np.arange(n)
    a = seed % n
    p = 1 + (n - a) // (3 + seed % 8)
    index[a:] = a + (index[a:] - a) % p
    return index


class _Text:
    """The words of one text that has a repetition, by their bytes."""

    def __init__(self, raw: memoryview, starts: np.ndarray, ends: np.ndarray, index: np.ndarray):
        self.raw, self.index = raw, index
        self.starts, self.ends = starts, ends

    def word(self, i: int) -> bytes:
        j = self.index[i]
        return bytes(self.raw[self.starts[j]:self.ends[j]])

    def true(self, runs) -> bool:
        """Whether the words of each run repeat indeed."""
        size = (self.ends - self.starts)[self.index]
        for start, length, period in runs:
            a = np.arange(start, start + length - period)
            if (size[a] != size[a + period]).any():
                return False
            if any(self.word(i) != self.word(i + period) for i in a.tolist()
                   if self.index[i] != self.index[i + period]):
                return False
        return True

    def exact(self) -> np.ndarray:
        numbers: dict[bytes, int] = {}
        return np.array([numbers.setdefault(self.word(i), len(numbers)) for i in range(len(self.index))], np.int64)

    def digest(self, keep: np.ndarray) -> str:
        places, sha = np.flatnonzero(keep).tolist(), hashlib.sha256()
        for i in range(0, len(places), JOINED):
            sha.update((b" " if i else b"") + b" ".join(map(self.word, places[i:i + JOINED])))
        return sha.hexdigest()


def _joined_digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: np.ndarray) -> list[str]:
    """Digest of each text's words joined by single spaces."""
    keep = np.zeros(len(data) + 1, np.int8)
    keep[starts] += 1
    keep[ends] -= 1
    keep = np.cumsum(keep[:-1], dtype=np.int8).astype(bool)
    inner = np.ones(len(starts), bool)
    inner[at[1:][np.diff(at) > 0] - 1] = False  # a text's last word has no space behind it
    gaps = ends[inner]
    keep[gaps] = True
    text = data.copy()
    text[gaps] = 0x20
    count = np.concatenate([[0], np.cumsum(keep)])
    text = memoryview(text[keep])
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        part = text[count[starts[a]]:count[ends[b - 1]]] if b > a else b""
        out.append(hashlib.sha256(part).hexdigest())
    return out


def _searched(data, offsets, seeds, shortest, repeats):
    """Of each text: number of words, runs, kept stretches (null: all words), digest."""
    starts, ends, at = word_spans(data, offsets)
    hashes = H.span_hashes(data, starts, ends)
    sizes = np.diff(at)
    index = {i: cyclic(int(sizes[i]), seed) for i, seed in seeds if sizes[i]}
    words = hashes.copy()
    for i, places in index.items():
        words[at[i]:at[i + 1]] = hashes[at[i]:at[i + 1]][places]
    found = periodic_runs(words, at, shortest, repeats)
    digests, kept = _joined_digests(data, starts, ends, at), {}
    raw = memoryview(data)
    for i in sorted(found.keys() | index.keys()):
        n = int(sizes[i])
        text = _Text(raw, starts[at[i]:at[i + 1]], ends[at[i]:at[i + 1]], index.get(i, np.arange(n)))
        if not text.true(found.get(i, [])):
            found[i] = periodic_runs(text.exact(), np.array([0, n]), shortest, repeats).get(0, [])
        keep = kept_words(n, found.get(i, []))
        digests[i] = text.digest(keep)
        turn = np.flatnonzero(np.diff(np.concatenate([[0], keep.astype(np.int8), [0]])))
        kept[i] = list(zip(turn[0::2].tolist(), turn[1::2].tolist()))
    return sizes, found, kept, digests


def collapsed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", plant: Column | None = None,
              shortest: int = SHORTEST, repeats: int = REPEATS) -> DataFrame:
    """(id, n_words, runs, kept, collapsed_sha256) of every row: its runs by start, then period;
    the stretches [start, end) of words that stay when each run keeps its first period
    only; and the digest of these words joined by single spaces.

    ``plant``: a column of long; where it is not null the text is first given a
    repetition by ``cyclic``, to try the search."""
    if shortest < WINDOW + WINDOW // 2 or repeats < 3:
        raise ValueError("runs of at least 24 words and three repetitions are searched")
    seed = F.lit(None).cast("long") if plant is None else plant.cast("long")
    kept = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), seed.alias("seed"))

    def run(batches):
        for batch in batches:
            data, offsets = H.utf8(batch.column("text"))
            planted = batch.column("seed").to_pylist()
            for a, b in H.chunks(offsets):
                part, at = data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]
                seeds = [(i, s) for i, s in enumerate(planted[a:b]) if s is not None]
                sizes, found, spans, digests = _searched(part, at, seeds, shortest, repeats)
                spans = [spans.get(i, [(0, n)] if n else []) for i, n in enumerate(sizes.tolist())]
                yield pa.RecordBatch.from_arrays([
                    batch.column("id")[a:b], pa.array(sizes, pa.int64()),
                    pa.array([found.get(i, []) for i in range(b - a)], pa.list_(RUN)),
                    pa.array(spans, pa.list_(SPAN)), pa.array(digests, pa.string())],
                    names=["id", "n_words", "runs", "kept", "collapsed_sha256"])

    return kept.mapInArrow(run, f"id {kept.schema['id'].dataType.simpleString()}, {SCHEMA}")
