"""Plain Python versions of what the operators compute, for small fixtures."""

import math
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.ASCII)


def words(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(text or "")]


def shingles(text, width=5):
    w = words(text)
    if len(w) < width:
        return {tuple(w)} if w else set()
    return {tuple(w[i:i + width]) for i in range(len(w) - width + 1)}


def groups(n, links):
    """The least reachable index of each of n."""
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def near_groups(ids, texts, num=4, den=5):
    sets = [shingles(t) for t in texts]
    links = [(i, j) for i in range(len(sets)) for j in range(i)
             if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j])]
    roots = groups(len(sets), links)
    least = {}
    for i, r in zip(ids, roots):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    return [(i, len(s), least.get(r, i)) for i, s, r in zip(ids, sets, roots)]


def base_spans(text):
    rules = [("assign", ASSIGN, lambda m: len(m[2]) >= 8),
             ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16),
             ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 32)]
    found = [(m.start(), i, m.end(), kind) for i, (kind, rule, good) in enumerate(rules)
             for m in rule.finditer(text or "") if good(m)]
    return [(a, b, kind) for a, _, b, kind in sorted(found)]


def backoff(texts, alpha=0.4, least=2):
    """(words, back-offs, log score) of each text."""
    lists = [words(t) for t in texts]
    one, two = Counter(), Counter()
    for w in lists:
        one.update(w)
        two.update(zip([None, *w[:-1]], w))
    total, one[None] = sum(one.values()), sum(map(bool, lists))
    out = []
    for w in lists:
        score, missed = 0.0, 0
        for v, x in zip([None, *w[:-1]], w):
            if two[v, x] >= least:
                score += math.log(two[v, x] / one[v])
            else:
                score += math.log(alpha * one[x] / total)
                missed += 1
        out.append((len(w), missed, score))
    return out
