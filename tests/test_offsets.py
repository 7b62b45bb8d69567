import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from helpers import daily, folds_bruteforce, lag_bruteforce
from tidewise import Roles
from tidewise.functions.frequency import infer_unit, step_histogram
from tidewise.functions.offsets import offset_function, shift_time
from tidewise.plans import backtest as bt

ROLES = Roles(id="id", time="date", target="y", segment="seg")
SCHEMA = "id string, seg string, date timestamp_ntz, y double"


def months(n, skip=()):
    return [dt.datetime(2015 + i // 12, 1 + i % 12, 1) for i in range(n) if i not in skip]


def plus(t, n):
    i = t.year * 12 + t.month - 1 + n
    return dt.datetime(i // 12, 1 + i % 12, t.day)


def rows_of(times_by_id):
    rng = random.Random(1)
    return [(i, f"s{int(i[1:]) % 2}", t, float(rng.randrange(50))) for i, times in times_by_id.items() for t in times]


def brute(rows, n_pred, group, n_folds, bounds):
    """(fold, segment) -> errors of Last over every time group that holds a row."""
    folds = folds_bruteforce([r[2] for r in rows], n_folds, n_pred)
    out = {}
    for k, (train, _) in enumerate(folds):
        for h in range(group, n_pred + 1, group):
            lags = lag_bruteforce([(r[0], r[2], r[3]) for r in rows], h)
            begin, end = bounds(max(train), h)
            for i, s, t, y in rows:
                if begin <= t <= end:
                    out.setdefault((k, s), []).append(((lags[i, t] or 0.0) - y) ** 2)
    return {key: (len(v), pytest.approx(sum(v) / len(v))) for key, v in out.items()}


@pytest.mark.parametrize("unit", ["month", "auto"])
def test_monthly_backtest(frame, unit):
    rows = rows_of({"i0": months(40), "i1": months(40, {3, 11}), "i2": months(40, {20, 38})})
    got = {(r.fold, r.segment): (r.n, r.mse) for r in bt.backtest_last(frame(rows, SCHEMA), ROLES, 6, 3, 3, unit).collect()}
    assert got == brute(rows, 6, 3, 3, lambda end, h: (plus(end, h - 2), plus(end, h)))


def test_own_offsets_may_overlap(frame):
    rows = rows_of({"i0": daily("2022-01-01", 60), "i1": daily("2022-01-01", 60, {5, 50})})

    def wide(t, n):  # a group ends where the next one already runs
        return F.when(n % 3 == 0, shift_time(t, n + 2)).otherwise(shift_time(t, n))
    days = lambda k: dt.timedelta(days=k)
    got = {(r.fold, r.segment): (r.n, r.mse) for r in bt.backtest_scores(bt.backtest_predictions(
        frame(rows, SCHEMA), ROLES, 6, 3, 2, unit=wide).withColumn("beyond", F.lit(False)), ["fold", "segment"], ROLES).collect()}
    assert got == brute(rows, 6, 3, 2, lambda end, h: (end + days(h - 2), end + days(h + 2)))


def test_steps_come_from_the_data(frame):
    weekly = [dt.datetime(2020, 1, 6) + dt.timedelta(weeks=k) for k in range(30)]
    rows = rows_of({"i0": weekly, "i1": weekly[:3] + weekly[20:], "i2": [weekly[0], weekly[0] + dt.timedelta(days=1)]})
    df = frame(rows, SCHEMA)
    assert {r.frequency: r.n for r in step_histogram(df, ROLES).collect()} == {"week": 40, "quarter": 1, "day": 1}
    assert infer_unit(df, ROLES) == infer_unit(df, ROLES, spread=True) == "week"
    assert infer_unit(frame(rows_of({"i0": [weekly[0], weekly[1], weekly[1] + dt.timedelta(days=1)]}), SCHEMA), ROLES) == "day"
    with pytest.raises(ValueError, match="two rows"):
        infer_unit(frame(rows[:1], SCHEMA), ROLES)


def test_unknown_units_raise(frame):
    with pytest.raises(ValueError, match="fortnight"):
        offset_function("fortnight")
    assert offset_function(shift_time) is shift_time
