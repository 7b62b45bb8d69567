"""Brute-force reference implementations used to check the Spark plans on
small hand-made frames (plain Python over lists of rows)."""

from __future__ import annotations

import datetime as dt
from collections import defaultdict


def daily(start: str, n: int, skip: set[int] = frozenset()) -> list[dt.datetime]:
    d0 = dt.datetime.fromisoformat(start)
    return [d0 + dt.timedelta(days=i) for i in range(n) if i not in skip]


def folds_bruteforce(times, n_folds, n_pred):
    """Expanding folds over sorted distinct times: list of (train set, test set)."""
    ts = sorted(set(times))
    n = len(ts)
    if n - n_folds * n_pred <= 0:
        raise ValueError("too few times")
    out = []
    for k in range(n_folds):
        start = n - (n_folds - k) * n_pred
        out.append((set(ts[:start]), set(ts[start:start + n_pred])))
    return out


def lag_bruteforce(rows, h):
    """rows: (id, t, y) -> {(id, t): y h rows earlier in the id's time order}."""
    by = defaultdict(list)
    for i, t, y in rows:
        by[i].append((t, y))
    out = {}
    for i, seq in by.items():
        seq.sort()
        for j, (t, _) in enumerate(seq):
            out[(i, t)] = seq[j - h][1] if j >= h else None
    return out


# Published dates (UTC) of new and full moons.
NEW_MOONS = ("2000-01-06", "2005-10-03", "2010-07-11", "2015-03-20", "2017-08-21", "2020-06-21")
FULL_MOONS = ("2000-01-21", "2005-10-17", "2010-07-26", "2015-09-28", "2018-01-31", "2020-11-30")


def backtest_last_bruteforce(rows, n_pred, group, n_folds):
    """rows: (id, segment, t, y). Per (fold, segment): (n, mse) of the Last
    forecaster over each horizon's day group after the fold's end of training."""
    folds = folds_bruteforce([r[2] for r in rows], n_folds, n_pred)
    horizons = range(group, n_pred + 1, group)
    lags = {h: lag_bruteforce([(r[0], r[2], r[3]) for r in rows], h) for h in horizons}
    acc = defaultdict(list)
    for k, (train, _test) in enumerate(folds):
        end = max(train)
        for h in horizons:
            lo = end + dt.timedelta(days=h - group + 1)
            hi = end + dt.timedelta(days=h)
            for i, seg, t, y in rows:
                if lo <= t <= hi:
                    p = lags[h][(i, t)]
                    p = 0.0 if p is None else p
                    acc[(k, seg)].append((p - y) ** 2)
    return {key: (len(v), sum(v) / len(v)) for key, v in acc.items()}
