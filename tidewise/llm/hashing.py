"""Vectorised word and shingle hashing over Arrow text columns.

Everything works on the UTF-8 bytes of whole texts, a quarter megabyte or so at a time,
without building Python strings.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
CHUNK_BYTES = 1 << 18
_GOLDEN = U(0x9E3779B97F4A7C15)
_BASE = 0x5851F42D4C957F2D  # odd, so it has an inverse modulo 2**64
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)

SEPARATORS = np.zeros(256, bool)
SEPARATORS[[0x20, *range(0x09, 0x0E)]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words (splitmix finaliser)."""
    with np.errstate(over="ignore"):
        x = (np.asarray(x, U) + _GOLDEN).astype(U)
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


_BYTE_VALUE = mix64(np.arange(256, dtype=U))
_LOWER_VALUE = _BYTE_VALUE.copy()
_LOWER_VALUE[ord("A"):ord("Z") + 1] = _BYTE_VALUE[ord("a"):ord("z") + 1]
_POWERS = np.ones(1, U)
_INVERSES = np.ones(1, U)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POWERS, _INVERSES
    if len(_POWERS) < n:
        size = max(n, CHUNK_BYTES * 2)
        step = np.full(size, _BASE, U)
        back = np.full(size, _BASE_INVERSE, U)
        step[0] = back[0] = 1
        _POWERS, _INVERSES = np.cumprod(step), np.cumprod(back)
    return _POWERS, _INVERSES


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, row offsets) of a text column; null counts as the empty text."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:][:len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` bytes; one longer text makes its own range."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + size, side="right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray,
                values: np.ndarray = _BYTE_VALUE) -> np.ndarray:
    """64-bit hash of each byte span data[start:end] (ends after starts)."""
    if not len(starts):
        return np.zeros(0, U)
    forward, backward = _powers(len(data) + 1)
    with np.errstate(over="ignore"):
        sums = np.empty(len(data) + 1, U)
        sums[0] = 0
        np.cumsum(values[data] * forward[:len(data)], out=sums[1:])
        return mix64((sums[ends] - sums[starts]) * backward[starts]
                     + (ends - starts).astype(U) * _GOLDEN)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words ``[^\\x20\\x09-\\x0D]+`` (A-Z lower-cased) of some
    texts, and the offsets of each text's words."""
    gap = np.ones(len(data) + 1, bool)
    gap[:-1] = SEPARATORS[data]
    begins = ~gap[:-1]
    before = np.ones(len(data), bool)
    before[1:] = gap[:-2] if len(data) else before[1:]
    cut = offsets[:-1][offsets[:-1] < len(data)]
    before[cut] = True
    starts = np.flatnonzero(begins & before)
    after = gap[1:].copy()
    after[offsets[1:][offsets[1:] > 0] - 1] = True
    ends = np.flatnonzero(begins & after) + 1
    return span_hashes(data, starts, ends, _LOWER_VALUE), np.searchsorted(starts, offsets)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = 5
                 ) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, and their offsets.

    A shingle is ``width`` consecutive words; a text with fewer words has its
    whole sequence as one shingle; one without words has none."""
    words, at = word_hashes(data, offsets)
    counts = np.diff(at)
    with np.errstate(over="ignore"):
        factors = mix64(np.arange(1, width + 1, dtype=U)) | U(1)
        total = np.zeros(len(words), U)
        for j in range(min(width, len(words))):
            total[:len(words) - j] += words[j:] * factors[j]
        hashes = mix64(total)
        sizes = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
        out_at = np.concatenate([[0], np.cumsum(sizes)])
        index = np.arange(out_at[-1]) + np.repeat(at[:-1] - out_at[:-1], sizes)
        out = hashes[index]
        for d in np.flatnonzero((counts > 0) & (counts < width)):
            w = words[at[d]:at[d + 1]]
            out[out_at[d]] = mix64(np.sum(w * factors[:len(w)], dtype=U)
                                   + U(len(w)) * U(0xD6E8FEB86659FD93))
    for a, b in zip(out_at[:-1].tolist(), out_at[1:].tolist()):
        if b - a > 1:
            out[a:b].sort()
    keep = np.ones(len(out), bool)
    keep[1:] = out[1:] != out[:-1]
    keep[out_at[:-1][sizes > 0]] = True
    kept = np.concatenate([[0], np.cumsum(keep)])
    return out[keep], kept[out_at]


def set_fingerprints(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Order-free 64-bit hash of each set (as signed integers, for Spark)."""
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, U), np.cumsum(mix64(hashes ^ U(0x5DEECE66D)))])
        return mix64((sums[at[1:]] - sums[at[:-1]]) + np.diff(at).astype(U)).view(np.int64)
