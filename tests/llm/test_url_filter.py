import random
import re

import numpy as np
import pytest

from tidewise.llm.url_filter import LONG, Rule, ShiftAnd, judged, site_rules

GLOBS = ["*.org/*", "a?.net/*", "ads.*/x*y", "*/*.exe", "*casino*", "x.com/", "*/é?/*", "\\*.net/\\?*", "*/a*b*a", "ab.c/abab"]


def brute(glob, host, path):
    def regex(g):
        out, chars = "", iter(g)
        for c in chars:
            out += re.escape(next(chars)) if c == "\\" else ".*" if c == "*" else "." if c == "?" else re.escape(c)
        return re.compile(out, re.S)
    h, slash, p = glob.partition("/")
    return bool(regex(h).fullmatch(host) and regex(slash + p if slash else "*").fullmatch(path))


def cases(n=1500):
    rng = random.Random(3)
    out = [("", ""), ("x.org", ""), ("evil.com", "/x.org/y"), ("*.net", "/?"), ("ab.c", "/abab")]
    for _ in range(n):
        out.append(("".join(rng.choice("ab.xénoetcrgads") for _ in range(rng.randrange(9)))
                    + rng.choice(["", ".org", ".net", "casino", "x.com"]),
                    "".join(rng.choice("/ab.exéy?*") for _ in range(rng.randrange(12)))
                    + rng.choice(["", ".exe", "/éé/"])))
    return out


@pytest.mark.parametrize("copies", [1, 12])  # of the list: one word, many words
def test_automaton_matches_each_glob_alone(copies):
    rows = cases()
    globs = GLOBS * copies
    automaton = ShiftAnd(globs)
    assert copies == 1 or automaton.words > 10
    symbols, at = [], [0]
    for host, path in rows:
        symbols += [*host.encode(), 256, *path.encode()]
        at.append(len(symbols))
    states = automaton.run(np.array(symbols, np.int16), np.array(at))
    for k, glob in enumerate(globs):
        hit = automaton.first_hit(states, [k]) == k
        assert hit.tolist() == [brute(glob, *r) for r in rows], glob


def test_rows_ranks_and_odd_urls(frame):
    rules = [Rule("*.b.org/*", "block"), *site_rules("allow", "org/"), *site_rules("block", "b.org/x"),
             *site_rules("allow", "c_d.org/x*"), Rule("*/*long", "block", "long")]
    rows = [(1, "http://A.B.org/x?y=://"), (2, "b.org/x"), (3, None), (4, ""), (5, "ftp://q.b.org"), (6, "s://b.org/X"),
            (7, "s://xb.org/x"), (7, "s://xb.org/x"), (None, "s://org/#a"), (8, "s://z/" + "a" * 3 * LONG + "long"),
            (9, "s://z/" + "a" * 3 * LONG + "long#no"), (10, "s://u@a.org:80/x"), (11, "s://c_d.org/x*1"),
            (12, "s://c_d.org/xy"), (13, "s://É.org/é")]
    docs = frame([(u, i, 0, "h", "r") for i, u in rows], "url string, page_id long, id int, host string, rule string")
    got = {}
    for r in judged(docs, rules).collect():
        got.setdefault(r.id, []).append((r.host, r.path[:4], r.rule, r.verdict))
    assert got == {
        1: [("a.b.org", "/x", "b.org/x", "block")], 2: [("", "", None, "allow")], 3: [("", "", None, "allow")],
        4: [("", "", None, "allow")], 5: [("q.b.org", "", None, "allow")], 6: [("b.org", "/X", "org/", "allow")],
        7: [("xb.org", "/x", "org/", "allow")] * 2, None: [("org", "/", "org/", "allow")],
        8: [("z", "/aaa", "long", "block")], 9: [("z", "/aaa", "long", "block")],
        10: [("u@a.org:80", "/x", None, "allow")], 11: [("c_d.org", "/x*1", "c_d.org/x*", "allow")],
        12: [("c_d.org", "/xy", "org/", "allow")], 13: [("É.org", "/é", "org/", "allow")]}
    assert judged(docs.limit(0), rules).collect() == []
    assert {r.verdict for r in judged(docs, []).collect()} == {"allow"}
