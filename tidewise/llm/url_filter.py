"""URL filters: all glob rules of a list simulated at once over each canonical URL.

A URL's canonical form is its host (A-Z lower-cased), a boundary symbol that no text
holds, and its path. A glob is a host glob and, from its first "/" on, a path glob: ``*`` is
any run of characters, ``?`` one character, a backslash makes the next one
plain. Neither crosses the boundary, and a glob must match host and path whole.

The globs are laid side by side in one Shift-And automaton of several 64-bit words. Each
glob has a start bit and one bit for each symbol; ``enter[c]`` has the bits that
symbol c may shift into, ``stay[c]`` those that keep standing on it (a ``*`` behind
them, or the further bytes of a ``?``). One step of all globs is
``D = (D << 1) & enter[c] | D & stay[c]``, the carry going from word to word.
Many URLs are simulated in step, one column of symbols at a time; very long ones
one by one, on integers of all words.

Of the globs that match, the one of the highest tier wins, then the longest, then the
first of the list. Defined results: a null URL, an empty one and one without ``://``
has an empty host and path and is judged like others; repeated rows and null ids are
kept; URLs of any length are judged whole. Only the id and URL columns are read.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewise.llm import hashing as H

BOUNDARY = 256        # the symbol between host and path; bytes are 0 to 255
SYMBOLS = 257
LANES = 8192          # URLs simulated in step, at most
LONG = 4096           # symbols of a URL that is simulated on its own
HIT_CELLS = 1 << 22   # of the (URL, glob) table of one step
U = np.uint64


@dataclass(frozen=True)
class Rule:
    """A glob with its verdict; ``name`` is what a judged URL shows (null: not shown).
    ``tier`` goes before ``length``, which is by default the glob's plain characters."""
    glob: str
    verdict: str
    name: str | None = None
    tier: int = 0
    length: int | None = None

    @property
    def rank(self) -> tuple[int, int]:
        length = self.length
        if length is None:
            length = sum(kind == "char" for kind, _ in _tokens(self.glob))
        return self.tier, length


def site_rules(verdict: str, site: str, tier: int = 1) -> list[Rule]:
    """``host/path``: that host and all its subdomains, paths that begin so."""
    return [Rule(glob, verdict, site, tier, len(site)) for glob in (_plain(site) + "*", "*." + _plain(site) + "*")]


def _plain(text: str) -> str:
    return "".join("\\" + c if c in "*?\\" else c for c in text)


def _tokens(glob: str) -> list[tuple[str, str]]:
    """(kind, character): char, any, run, and the boundary before the path's "/"."""
    out, chars, in_path = [], iter(glob), False
    for c in chars:
        if c == "/" and not in_path:
            out.append(("boundary", ""))
            in_path = True
        if c == "\\":
            out.append(("char", next(chars, "\\")))
        else:
            out.append(("run", "") if c == "*" else ("any", "") if c == "?" else ("char", c))
    if not in_path:  # a host alone: any path
        out += [("boundary", ""), ("run", "")]
    return out


class ShiftAnd:
    """The automaton of a list of globs."""

    def __init__(self, globs: list[str]):
        self.enter, self.stay = [0] * SYMBOLS, [0] * SYMBOLS
        self.start, self.ends, bit = 0, [], 0
        for glob in globs:
            self.start |= 1 << bit
            in_host = True
            for kind, c in _tokens(glob):
                if kind == "run":
                    for b in range(256):
                        self.stay[b] |= 1 << bit
                    continue
                if kind == "char":
                    if in_host and c in string.ascii_uppercase:
                        c = c.lower()
                    for b in c.encode():
                        bit += 1
                        self.enter[b] |= 1 << bit
                    continue
                bit += 1
                if kind == "boundary":
                    self.enter[BOUNDARY] |= 1 << bit
                    in_host = False
                else:  # one character: a first byte, then its further ones
                    for b in range(256):
                        into = self.stay if 0x80 <= b < 0xC0 else self.enter
                        into[b] |= 1 << bit
            self.ends.append(bit)
            bit += 1
        self.words = max(1, -(-bit // 64))
        self._enter, self._stay = map(self._packed, (self.enter, self.stay))
        self._start = self._packed([self.start])[0]

    def _packed(self, masks: list[int]) -> np.ndarray:
        return np.array([[m >> 64 * w & (1 << 64) - 1 for w in range(self.words)] for m in masks], U)

    def run(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The last states of each URL ``symbols[at[i]:at[i + 1]]``, as rows of words."""
        sizes = np.diff(at)
        states = np.empty((len(sizes), self.words), U)
        long = np.flatnonzero(sizes > LONG)
        for i in long.tolist():
            states[i] = self._packed([self._one(symbols[at[i]:at[i + 1]])])[0]
        short = np.flatnonzero(sizes <= LONG)
        short = short[np.argsort(-sizes[short], kind="stable")]
        for a in range(0, len(short), LANES):
            rows = short[a:a + LANES]
            states[rows] = self._in_step(symbols, at[rows], sizes[rows])
        return states

    def _in_step(self, symbols: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Of URLs ordered from the longest to the shortest."""
        d = np.tile(self._start, (len(begin), 1))
        for t, live in enumerate(np.searchsorted(-sizes, -np.arange(sizes.max(initial=0)), side="left").tolist()):
            c = symbols[begin[:live] + t]
            now = d[:live]
            moved = now << U(1)
            moved[:, 1:] |= now[:, :-1] >> U(63)
            d[:live] = moved & self._enter[c] | now & self._stay[c]
        return d

    def _one(self, symbols: np.ndarray) -> int:
        d, enter, stay = self.start, self.enter, self.stay
        for c in symbols.tolist():
            d = d << 1 & enter[c] | d & stay[c]
        return d

    def first_hit(self, states: np.ndarray, order: list[int]) -> np.ndarray:
        """The first glob of ``order`` that each URL matches, -1 if none."""
        found = np.full(len(states), -1, np.int64)
        if not order:
            return found
        ends = np.array(self.ends)[order]
        word, shift = ends >> 6, (ends & 63).astype(U)
        step = max(64, HIT_CELLS // len(order))
        for a in range(0, len(states), step):
            hit = (states[a:a + step][:, word] >> shift & U(1)).astype(bool)
            found[a:a + step] = np.where(hit.any(axis=1), np.array(order)[hit.argmax(axis=1)], -1)
        return found


def canonical_symbols(hosts: pa.Array, paths: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Symbols and offsets of host, boundary, path of each row."""
    (h, h_at), (p, p_at) = H.utf8(hosts), H.utf8(paths)
    at = h_at + p_at + np.arange(len(h_at))
    symbols = np.full(at[-1], BOUNDARY, np.int16)
    rows = np.arange(len(h_at) - 1)
    h_row, p_row = np.repeat(rows, np.diff(h_at)), np.repeat(rows, np.diff(p_at))
    symbols[np.arange(len(h)) + p_at[h_row] + h_row] = h
    symbols[np.arange(len(p)) + h_at[p_row + 1] + p_row + 1] = p
    return symbols, at


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path: the host goes from the first "://" to the next "/", "?", "#" or the
    end; the path on to the next "?", "#" or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url)))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)
    return (F.coalesce(host, F.lit("")),
            F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit("")))


def judged(pages: DataFrame, rules: list[Rule], default: str = "allow", id_col: str = "page_id",
           url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, glob, verdict) of every row: the winning rule's name, glob
    and verdict, or nulls and the default."""
    automaton = ShiftAnd([r.glob for r in rules])
    order = sorted(range(len(rules)), key=lambda i: rules[i].rank, reverse=True)  # stable: ties by place
    shown = [pa.array([*column, last], pa.string()) for column, last in (
        ([r.name for r in rules], None), ([r.glob for r in rules], None), ([r.verdict for r in rules], default))]

    def run(batches):
        for batch in batches:
            symbols, at = canonical_symbols(batch.column("host"), batch.column("path"))
            won = automaton.first_hit(automaton.run(symbols, at), order)
            won = pa.array(np.where(won < 0, len(rules), won))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(s.take(won) for s in shown)],
                                             names=["id", "host", "path", "rule", "glob", "verdict"])

    host, path = url_parts(F.col("url"))
    kept = (pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
            .select("id", host.alias("host"), path.alias("path")))
    kind = kept.schema["id"].dataType.simpleString()
    return kept.mapInArrow(run, f"id {kind}, host string, path string, rule string, glob string, verdict string")
