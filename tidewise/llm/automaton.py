"""Deterministic byte automata for several regular expressions at once.

Expressions (literals, classes, groups, alternation, ``? * + {m,n}``) become one
nondeterministic automaton; subset construction makes it deterministic and
partition refinement minimises it. The result is one transition array, indexed
by state * 256 + byte, and one array of accepted rules (a bit set) by state.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np

_PARSE = re._parser.parse  # noqa: SLF001  (the standard library's expression parser)


@dataclass(frozen=True)
class Automaton:
    """State 0 is the start. ``accepts[s]`` has bit i set if rule i is matched by
    the bytes read so far. ``dead`` is the state without a way on, or -1."""
    moves: np.ndarray
    accepts: np.ndarray
    dead: int

    @property
    def resets(self) -> np.ndarray:
        """Bytes that lead from every state to the start."""
        return (self.moves.reshape(-1, 256) == 0).all(axis=0)


class _Nfa:
    def __init__(self):
        self.empty: list[list[int]] = []
        self.on: list[list[tuple[frozenset, int]]] = []

    def state(self) -> int:
        self.empty.append([])
        self.on.append([])
        return len(self.on) - 1

    def add(self, items, at: int, either_case: bool) -> int:
        """Append parsed items behind state ``at``; returns the last state."""
        for op, arg in items:
            name = str(op)
            if name in ("LITERAL", "IN", "NOT_LITERAL", "ANY"):
                end = self.state()
                self.on[at].append((_bytes(name, arg, either_case), end))
                at = end
            elif name == "SUBPATTERN":
                at = self.add(arg[-1], at, either_case)
            elif name == "BRANCH":
                end = self.state()
                for branch in arg[1]:
                    self.empty[self.add(branch, at, either_case)].append(end)
                at = end
            elif name == "MAX_REPEAT":
                low, high, body = arg
                for _ in range(low):
                    at = self.add(body, at, either_case)
                if high == re._constants.MAXREPEAT:  # noqa: SLF001
                    loop = self.state()
                    self.empty[at].append(loop)
                    self.empty[self.add(body, loop, either_case)].append(loop)
                    at = loop
                else:
                    end = self.state()
                    self.empty[at].append(end)
                    for _ in range(high - low):
                        at = self.add(body, at, either_case)
                        self.empty[at].append(end)
                    at = end
            else:
                raise ValueError(f"unsupported in a rule: {name}")
        return at

    def closure(self, states) -> frozenset:
        seen, todo = set(states), list(states)
        while todo:
            for t in self.empty[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)


def _bytes(name: str, arg, either_case: bool) -> frozenset:
    if name == "ANY":
        return frozenset(range(256)) - {10}
    if name in ("LITERAL", "NOT_LITERAL"):
        out = {arg}
    else:
        out = set()
        for op, x in arg:
            out |= {x} if str(op) == "LITERAL" else set(range(x[0], x[1] + 1)) if str(op) == "RANGE" else set()
    if any(x > 127 for x in out):
        raise ValueError("rules are over ASCII")
    if either_case:
        out |= {ord(chr(x).swapcase()) for x in out if chr(x).isalpha()}
    negated = name == "NOT_LITERAL" or name == "IN" and str(arg[0][0]) == "NEGATE"
    return frozenset(range(256)) - out if negated else frozenset(out)


def compile_rules(rules: list[tuple[str, bool]], anywhere: bool) -> Automaton:
    """Of (expression, letters in either case) rules. With ``anywhere``, a match may
    begin at any byte (the start state is re-entered); otherwise at the first."""
    nfa = _Nfa()
    start, finals = nfa.state(), {}
    for i, (pattern, either_case) in enumerate(rules):
        first = nfa.state()
        nfa.empty[start].append(first)
        finals[nfa.add(_PARSE(pattern), first, either_case)] = i
    begin = nfa.closure([start])
    numbers, todo, moves, accepts = {begin: 0}, [begin], [], []
    while todo:
        subset = todo.pop(0)
        accepts.append(sum({1 << finals[s] for s in subset if s in finals}))
        row = []
        targets: dict[frozenset, int] = {}
        for byte in range(256):
            to = frozenset(t for s in subset for on, t in nfa.on[s] if byte in on)
            if to not in targets:
                closed = nfa.closure(to | {start} if anywhere else to)
                if closed not in numbers:
                    numbers[closed] = len(numbers)
                    todo.append(closed)
                targets[to] = numbers[closed]
            row.append(targets[to])
        moves.append(row)
    return _minimised(np.array(moves), np.array(accepts))


def _minimised(moves: np.ndarray, accepts: np.ndarray) -> Automaton:
    """States are equal until their rules, or the classes of their successors, differ."""
    _, group = np.unique(accepts, return_inverse=True)
    while True:
        _, finer = np.unique(np.column_stack([group, group[moves]]), axis=0, return_inverse=True)
        if finer.max() == group.max():
            break
        group = finer
    # number the classes by their first state, so that the start stays 0
    first = np.array([np.flatnonzero(group == g)[0] for g in range(group.max() + 1)])
    order = np.argsort(first)
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    table = rank[group[moves[first[order]]]]
    final = accepts[first[order]]
    dead = [s for s in range(len(table)) if final[s] == 0 and (table[s] == s).all()]
    return Automaton(table.astype(np.int32).ravel(), final, dead[0] if dead else -1)
