"""Secret scans: all rules in one pass over the bytes of a text.

The rules' expressions are compiled into one minimal deterministic automaton
(``automaton.py``). Texts are cut at bytes that send every state back to the
start, so no match crosses a cut, into pieces of about ``PIECE`` bytes; all pieces
of a batch are run through the transition array in step, one byte of each at a
time. Only pieces in which a rule was accepted are walked again, with that rule's
own anchored automata, for the leftmost, longest, non-overlapping spans.

Defined results: null and empty texts have no spans; offsets count code points,
ends are exclusive; texts of any length are scanned whole; repeated rows and null
ids are scanned like others. ``redacted`` keeps all columns and their order.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewise.llm import hashing as H
from tidewise.llm.automaton import Automaton, compile_rules

PIECE = 512
SCAN_BYTES = 1 << 22  # scanned in step


@dataclass(frozen=True)
class Rule:
    """A secret is ``head``, then as many bytes of the class ``tail`` as there are.
    The leftmost such match is taken; if its tail has fewer than ``least`` bytes, it
    is dropped, and the search goes on behind it."""
    kind: str
    head: str
    tail: str
    least: int
    either_case: bool = False
    base: bool = True


# The base rules.
BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""",
         "[A-Za-z0-9+/_.=-]", 8, either_case=True),
    Rule("access", "AKIA", "[A-Z0-9]", 12),
    Rule("hex", "", "[0-9a-f]", 32),
)
# Public token formats that the base rules do not name.
MORE_RULES = (
    Rule("forge", "gh[pousr]_", "[A-Za-z0-9]", 36, base=False),
    Rule("chat", "xox[abprs]-", "[A-Za-z0-9-]", 24, base=False),
    Rule("pem", "-----BEGIN (RSA |EC |DSA |OPENSSH )?PRIVATE KEY", "-", 5, base=False),
)
RULES = BASE_RULES + MORE_RULES


@lru_cache(maxsize=8)
def _combined(rules: tuple[Rule, ...]) -> Automaton:
    # A head and one byte of its tail are enough to look closer: counting the
    # tails of several rules at once would multiply their states.
    return compile_rules([(r.head + r.tail + ("" if r.head else f"{{{r.least}}}"), r.either_case)
                          for r in rules], True)


@lru_cache(maxsize=64)
def _anchored(rule: Rule) -> tuple[Automaton, np.ndarray]:
    """The head's automaton, and which bytes belong to the tail."""
    tail = compile_rules([(rule.tail, rule.either_case)], False)
    return (compile_rules([(rule.head, rule.either_case)], False),
            tail.accepts[tail.moves[:256]] > 0)


def _pieces(data: np.ndarray, offsets: np.ndarray, resets: np.ndarray) -> np.ndarray:
    """Starts of the pieces (and the end of all): every text's start, and the
    position behind the first reset byte at or after each ``PIECE`` bytes."""
    wanted = np.concatenate([np.arange(a + PIECE, b, PIECE) for a, b in zip(offsets[:-1], offsets[1:])
                             if b - a > PIECE] or [np.zeros(0, np.int64)])
    at = np.flatnonzero(resets[data])
    place = np.searchsorted(at, wanted)
    cuts = at[place[place < len(at)]] + 1
    # a reset byte beyond the text's end only repeats a boundary or adds one
    return np.unique(np.concatenate([offsets, cuts]))


def _run(a: Automaton, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The rules accepted anywhere in each piece; all pieces go in step."""
    order = np.argsort(starts - ends, kind="stable")  # longest first
    begin, length = starts[order], (ends - starts)[order]
    state = np.zeros(len(order), np.int32)
    seen = np.zeros(len(order), a.accepts.dtype)
    shrinking = np.searchsorted(-length, -np.arange(length[0] if len(length) else 0), side="left")
    for step, live in enumerate(shrinking.tolist()):
        now = a.moves[state[:live] * 256 + data[begin[:live] + step]]
        state[:live] = now
        hit = a.accepts[now]
        if hit.any():
            seen[:live] |= hit
    out = np.empty_like(seen)
    out[order] = seen
    return out


def _spans(rule: Rule, piece: bytes) -> Iterator[tuple[int, int]]:
    head, tail = _anchored(rule)
    moves, accepts = head.moves, head.accepts
    firsts = np.flatnonzero(moves[:256] != head.dead) if not accepts[0] else np.flatnonzero(tail)
    bytes_ = np.frombuffer(piece, np.uint8)
    i, n = 0, len(piece)
    for start in np.flatnonzero(np.isin(bytes_, firsts)).tolist():
        if start < i:
            continue
        state, j, end = 0, start, start if accepts[0] else -1
        while j < n:
            state = int(moves[state * 256 + piece[j]])
            if state == head.dead:
                break
            j += 1
            if accepts[state]:
                end = j
        if end < 0:
            continue
        stop = end
        while stop < n and tail[piece[stop]]:
            stop += 1
        if stop > end:
            if stop - end >= rule.least:
                yield start, stop
            i = stop


def scan(data: np.ndarray, offsets: np.ndarray, rules: tuple[Rule, ...] = RULES
         ) -> dict[int, list[tuple[int, int, str]]]:
    """Of UTF-8 texts laid end to end: text number -> (start, end, kind) spans in
    bytes, by start, then by the order of the rules. Texts without any are absent."""
    a = _combined(rules)
    bounds = _pieces(data, offsets, a.resets)
    starts, ends = bounds[:-1], bounds[1:]
    seen = _run(a, data, starts, ends)
    out: dict[int, list] = {}
    hits = np.flatnonzero(seen)
    owners = np.searchsorted(offsets, starts[hits], side="right") - 1
    for k, doc in zip(hits.tolist(), owners.tolist()):
        piece = data[starts[k]:ends[k]].tobytes()
        base = int(starts[k] - offsets[doc])
        for i, rule in enumerate(rules):
            if seen[k] >> i & 1:
                out.setdefault(doc, []).extend((base + x, i, base + y) for x, y in _spans(rule, piece))
    return {d: [(x, y, rules[i].kind) for x, i, y in sorted(v)] for d, v in sorted(out.items()) if v}


def _documents(batch: pa.RecordBatch, column: str, rules) -> Iterator[tuple[int, int, dict, np.ndarray, np.ndarray]]:
    data, offsets = H.utf8(batch.column(column))
    for a, b in H.chunks(offsets, SCAN_BYTES):
        part, at = data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]
        yield a, b, scan(part, at, rules), part, at


def _code_points(text: bytes, spans):
    """Byte offsets to code-point offsets."""
    before = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
    return [(int(before[x]), int(before[y]), kind) for x, y, kind in spans]


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(id, spans array<struct<start, end, kind>>) of every row, in code points."""
    def run(batches):
        for batch in batches:
            for a, b, found, part, at in _documents(batch, "text", rules):
                rows = [[{"start": x, "end": y, "kind": k} for x, y, k in
                         _code_points(part[at[i]:at[i + 1]].tobytes(), found[i])]
                        if i in found else [] for i in range(b - a)]
                spans = pa.array(rows, pa.list_(pa.struct(
                    [("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())])))
                yield pa.RecordBatch.from_arrays([batch.column("id")[a:b], spans], names=["id", "spans"])

    kept = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = kept.schema["id"].dataType.simpleString()
    return kept.mapInArrow(run, f"id {kind}, spans array<struct<start:bigint,end:bigint,kind:string>>")


def redacted(docs: DataFrame, text_col: str = "text", count_col: str | None = "n_chars",
             rules: tuple[Rule, ...] = RULES, mark: str = "[{kind}]") -> DataFrame:
    """``docs`` with every secret's bytes replaced by a mark (overlapping spans
    are merged under the first one's kind); the column of code-point
    counts, if there is one, is set anew for changed texts."""
    schema: T.StructType = docs.schema

    def run(batches):
        for batch in batches:
            for a, b, found, part, at in _documents(batch, text_col, rules):
                some = batch.slice(a, b - a)
                if found:
                    columns = {f.name: some.column(i) for i, f in enumerate(some.schema)}
                    texts = columns[text_col].to_pylist()
                    counts = columns[count_col].to_pylist() if count_col in columns else None
                    for i, spans in found.items():
                        texts[i] = _marked(part[at[i]:at[i + 1]].tobytes(), spans, mark).decode()
                        if counts is not None:
                            counts[i] = len(texts[i])
                    columns[text_col] = pa.array(texts, some.schema.field(text_col).type)
                    if counts is not None:
                        columns[count_col] = pa.array(counts, some.schema.field(count_col).type)
                    some = pa.RecordBatch.from_arrays(list(columns.values()), schema=some.schema)
                yield some

    return docs.mapInArrow(run, schema)


def _marked(text: bytes, spans, mark: str) -> bytes:
    out, at = [], 0
    for x, y, kind in spans:
        if x >= at:
            out += [text[at:x], mark.format(kind=kind).encode()]
        at = max(at, y)
    return b"".join([*out, text[at:]])


