"""PartEnum signatures for exact Jaccard joins (Arasu, Ganti and Kaushik, 2006).

Sets are put into bands of similar size. Two sets r and s with Jaccard
similarity of at least ``num/den`` differ in at most
(den - num) (|r| + |s|) / (den + num) elements. Within a band the domain of
features is partitioned by hash into n1 parts, each part into n2 cells; the
signature items of a set are, for each part, its elements in every subset of
n2 - k2 cells. At most k differing elements kill a bounded number of items
(``dead``), so two similar sets agree on all other items.

Each set therefore emits only its ``dead + 1`` strongest items, in an order that
depends on an item's content alone (more elements first, then its hash): the
strongest item on which both sets agree is preceded, in either set, by dead
items only, so both emit it. Empty and nearly empty items, which
unrelated sets would share, come last and are hardly ever emitted.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

from tidewise.llm.hashing import mix64

U = np.uint64
BAND_RATIO = 1.3
MIN_ELEMENTS = 2  # wanted in the weakest emitted item


@dataclass(frozen=True)
class Band:
    number: int
    low: int
    high: int
    n1: int
    n2: int
    k2: int

    @property
    def subsets(self) -> int:
        return math.comb(self.n2, self.k2)

    @property
    def items(self) -> int:
        return self.n1 * self.subsets

    def dead(self, differing: int) -> int:
        """The most items that so many differing elements can kill (they kill
        most when spread evenly over the parts, as each further one in a part
        kills fewer)."""
        keep = self.n2 - self.k2
        killed = [self.subsets - math.comb(max(0, self.n2 - h), keep) for h in range(self.n2 + 1)]
        each, more = divmod(differing, self.n1)
        if each > self.k2:
            return self.items
        return (self.n1 - more) * killed[each] + more * killed[min(each + 1, self.n2)]


def _weakest(band: Band, size: int, emitted: int) -> float:
    """Elements expected in the weakest of so many emitted items of a set: a
    quantile of the Poisson law of an item's elements."""
    mean = size * (band.n2 - band.k2) / (band.n1 * band.n2)
    share, total, i, term = 1 - emitted / band.items, 0.0, 0, math.exp(-mean)
    while total + term < share and i < 10_000:
        total, i = total + term, i + 1
        term *= mean / i
    return i


@dataclass(frozen=True)
class Bands:
    """The bands of a threshold num/den; made on demand, for sets of any size."""
    num: int = 4
    den: int = 5
    min_elements: int = MIN_ELEMENTS

    def differing(self, a: int, b: int) -> int:
        return (self.den - self.num) * (a + b) // (self.den + self.num)

    def largest_partner(self, a: int) -> int:
        return a * self.den // self.num

    @lru_cache(maxsize=None)  # noqa: B019
    def band(self, number: int) -> Band:
        low = 1 if number == 0 else self.band(number - 1).high + 1
        high = max(low, math.floor(low * BAND_RATIO))
        k = self.differing(high, high)
        if k == 0:
            return Band(number, low, high, 1, 1, 0)
        best, best_rank = None, None
        # subsets of two or more cells are enumerated wherever two elements can differ
        for k2 in range(1 if k >= 2 else 0, min(k, 4) + 1):
            for n2 in range(k2 + 2 if k2 else 1, k2 + 5 if k2 else 2):
                for margin in (1.0, 1.1, 1.25, 1.5):
                    n1 = max(1, math.ceil((k + 1) / (k2 + 1) * margin))
                    b = Band(number, low, high, n1, n2, k2)
                    emitted = b.dead(k) + 1
                    if emitted > b.items or emitted > max(80, high):
                        continue
                    at_low = b.dead(self.differing(low, min(self.largest_partner(low), high))) + 1
                    strong = min(self.min_elements, _weakest(b, low, at_low))
                    rank = (-strong, emitted)
                    if best_rank is None or rank < best_rank:
                        best, best_rank = b, rank
        return best

    @lru_cache(maxsize=None)  # noqa: B019
    def of(self, size: int) -> tuple[tuple[Band, int], ...]:
        """(band, items to emit) of a set of so many elements: its own band and
        those of its larger partners."""
        largest, out, number = self.largest_partner(size), [], 0
        while self.band(number).high < size:
            number += 1
        while self.band(number).low <= largest:
            b = self.band(number)
            out.append((b, min(b.items, b.dead(self.differing(size, min(largest, b.high))) + 1)))
            number += 1
        return tuple(out)


@lru_cache(maxsize=None)
def _subset_matrix(n2: int, k2: int) -> np.ndarray:
    m = np.zeros((n2, math.comb(n2, k2)), U)
    for j, left in enumerate(itertools.combinations(range(n2), n2 - k2)):
        m[list(left), j] = 1
    return m


def signatures(elements: np.ndarray, at: np.ndarray, bands: Bands
               ) -> tuple[np.ndarray, np.ndarray]:
    """64-bit signatures of many sets, and the number of the set each is from.
    Set i holds the distinct 64-bit hashes elements[at[i]:at[i + 1]]."""
    sizes = np.diff(at)
    members: dict[Band, list[tuple[int, int]]] = {}
    for i, size in enumerate(sizes.tolist()):
        if size:
            for band, emit in bands.of(size):
                members.setdefault(band, []).append((i, emit))
    place, value = mix64(elements ^ U(0xA0761D6478BD642F)), mix64(elements)
    out, owner = [np.zeros(0, U)], [np.zeros(0, np.int64)]
    for band, rows in members.items():
        sets, emits = np.array(rows).T
        for a in range(0, len(sets), max(1, (1 << 20) // band.high)):
            some = slice(a, a + max(1, (1 << 20) // band.high))
            s, which = _band_items(place, value, at, sizes, band, sets[some], emits[some])
            out.append(s)
            owner.append(which)
    return np.concatenate(out), np.concatenate(owner)


def _band_items(place, value, at, sizes, band: Band, sets, emits):
    """The emitted items of some sets within one band."""
    n = sizes[sets]
    row = np.repeat(np.arange(len(sets)), n)
    index = np.arange(len(row)) + np.repeat(at[sets] - (np.cumsum(n) - n), n)
    x = place[index]
    with np.errstate(over="ignore"):
        cell = ((x >> U(32)) * U(band.n1)) >> U(32)
        if band.n2 > 1:
            cell = cell * U(band.n2) + (((x & U(0xFFFFFFFF)) * U(band.n2)) >> U(32))
        n_cells = band.n1 * band.n2
        cell = row * n_cells + cell.astype(np.int64)
        order = np.argsort(cell, kind="stable")
        bound = np.searchsorted(cell[order], np.arange(len(sets) * n_cells + 1))
        sums = np.concatenate([np.zeros(1, U), np.cumsum(value[index][order])])
        sums = (sums[bound[1:]] - sums[bound[:-1]]).reshape(len(sets), n_cells)
        counts = np.diff(bound).astype(U).reshape(len(sets), n_cells)
        if band.n2 > 1:
            m = _subset_matrix(band.n2, band.k2)
            sums = (sums.reshape(-1, band.n2) @ m).reshape(len(sets), -1)
            counts = (counts.reshape(-1, band.n2) @ m).reshape(len(sets), -1)
        key = mix64(np.arange(band.items, dtype=U) + U(band.number) * U(0xE7037ED1A0B428DB))
        item = mix64(sums ^ key)
        # strength first, so that sorting the items sorts them by strength
        item = (item >> U(8)) | ((U(255) - np.minimum(counts, U(255))) << U(56))
    item.sort(axis=1)
    chosen = np.arange(band.items) < emits[:, None]
    return item[chosen], np.broadcast_to(sets[:, None], item.shape)[chosen]
