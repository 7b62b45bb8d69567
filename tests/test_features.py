import datetime as dt
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from helpers import FULL_MOONS, NEW_MOONS, daily, lag_bruteforce
from tidewise import Roles
from tidewise.functions.calendar import ALL_FEATURES, add_time_features
from tidewise.functions.frequency import infer_frequency
from tidewise.operators.lags import add_lags, horizon_grid, lead_target, ranged_shift

ROLES = Roles(id="id", time="date", target="y")
SCHEMA = "id string, date timestamp_ntz, y double"


def test_lags_short_and_gap_series(frame):
    rows = [("short", t, float(i)) for i, t in enumerate(daily("2020-01-01", 3))]
    rows += [("gap", t, float(i)) for i, t in enumerate(daily("2020-01-01", 12, {3, 4}))]
    rows.append((None, dt.datetime(2020, 1, 1), 5.0))
    df = frame(rows, SCHEMA)
    got = {(r["id"], r["date"]): r for r in add_lags(df, ROLES, [2, 5]).collect()}
    for h in (2, 5):
        want = lag_bruteforce(rows, h)
        for k, v in want.items():
            assert got[k][f"last_{h}"] == v
    assert got[(None, dt.datetime(2020, 1, 1))]["last_2"] is None
    # all lags share one exchange and one sort
    plan = add_lags(df, ROLES, [1, 2, 3])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_grid_and_lead(frame):
    rows = [("a", t, float(i)) for i, t in enumerate(daily("2020-01-01", 10))]
    df = frame(rows, SCHEMA)
    g = horizon_grid(df, ROLES, [1, 3])
    assert g.count() == 20
    assert {r["predict_horizon"] for r in g.collect()} == {1, 3}
    lead = {r["date"]: r["target"] for r in lead_target(df, ROLES, 2).collect()}
    assert lead[dt.datetime(2020, 1, 1)] == 2.0 and lead[dt.datetime(2020, 1, 10)] is None


def test_calendar_features_and_moon(frame):
    rng = random.Random(3)
    base = dt.datetime(1985, 1, 1)
    ts = [base + dt.timedelta(seconds=rng.randrange(0, 55 * 365 * 86400),
                              microseconds=rng.randrange(0, 10**6)) for _ in range(400)]
    ts += [dt.datetime(2000, 12, 31, 23, 59, 59), dt.datetime(2001, 1, 1)]
    df = frame([(t,) for t in ts], "date timestamp_ntz")
    got = add_time_features(df, "date", ALL_FEATURES).collect()
    for r in got:
        t = r["date"]
        assert 0 <= r["moon"] <= 7
        assert r["dayofweek"] == t.weekday()
        assert r["weekend"] == int(t.weekday() >= 5)
        assert r["week"] == t.isocalendar()[1]
        assert r["weekmonth"] == -(-t.day // 7)
        assert r["quarter"] == (t.month - 1) // 3 + 1
        assert r["microsecond"] == t.microsecond and r["nanosecond"] == 0
        assert (r["year"], r["month"], r["day"], r["hour"], r["minute"], r["second"]) == \
               (t.year, t.month, t.day, t.hour, t.minute, t.second)


def test_frequency_ladder(frame):
    def freq(step, n=3):
        t0 = dt.datetime(2020, 1, 1)
        rows = [("a", t0 + i * step, 1.0) for i in range(n)]
        return infer_frequency(frame(rows, SCHEMA), ROLES).collect()[0]["frequency"]
    assert freq(dt.timedelta(microseconds=1)) == "microsecond"
    assert freq(dt.timedelta(days=1)) == "day"
    assert freq(dt.timedelta(days=7)) == "week"
    assert freq(dt.timedelta(days=28)) == "month"
    assert freq(dt.timedelta(days=90)) == "quarter"
    assert freq(dt.timedelta(days=365)) == "year"
    assert freq(dt.timedelta(days=1), n=1) == "nanosecond"  # single-row series: no step


def test_features_stay_in_codegen(frame):
    df = frame([(dt.datetime(2020, 1, 1),)], "date timestamp_ntz")
    plan = add_time_features(df, "date", ALL_FEATURES)._jdf.queryExecution() \
        .executedPlan().toString()
    assert "PythonUDF" not in plan and "BatchEvalPython" not in plan


def ranged_rows():
    rng = random.Random(5)
    rows = []
    for i, n in (("hot", 400), ("small", 7), ("mid", 60), (None, 30), ("tiny", 1)):
        for t in daily("2020-01-01", n, {d for d in range(n) if rng.random() < 0.2}):
            rows.append((i, t, float(rng.randrange(100)) if rng.random() < 0.9 else None))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("partitions", [1, 4, 60])  # 60: hot rows in many partitions of fewer rows than the largest shift
@pytest.mark.parametrize("ahead", [False, True])
def test_shift_over_range_partitions_equals_plain_window(frame, partitions, ahead):
    df = frame(ranged_rows(), SCHEMA).withColumn("_kind", F.lit("own"))
    shifts = {"a": 1, "b": 3, "c": 17}
    w = Window.partitionBy("id").orderBy("date")
    plain = df.withColumns({c: (F.lead if ahead else F.lag)("y", h).over(w) for c, h in shifts.items()})
    got = ranged_shift(df, ROLES, shifts, "y", ahead, partitions)
    assert got.columns == plain.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, plain.collect()), key=str)


def test_shift_in_small_batches(spark, frame):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        df = frame(ranged_rows(), SCHEMA)
        plain = sorted(map(tuple, add_lags(df, ROLES, [1, 7]).collect()), key=str)
        assert sorted(map(tuple, add_lags(df, ROLES, [1, 7], spread=True).collect()), key=str) == plain
        lead = sorted(map(tuple, lead_target(df, ROLES, 2).collect()), key=str)
        assert sorted(map(tuple, lead_target(df, ROLES, 2, spread=True).collect()), key=str) == lead
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_ranged_frequency_equals_plain(frame):
    rows = [("a", t, 1.0) for t in daily("2020-01-01", 50, {3, 9, 10})]
    rows += [("b", dt.datetime(2020, 1, 1) + dt.timedelta(hours=30 * i), 1.0) for i in range(40)]
    df = frame(rows, SCHEMA)
    plain = infer_frequency(df, ROLES).collect()[0]
    assert tuple(plain) == tuple(infer_frequency(df, ROLES, spread=True).collect()[0]) == (86_400_000_000, "day")


def test_shift_of_an_empty_panel(frame):
    assert add_lags(frame([], SCHEMA), ROLES, [2], spread=True).collect() == []


def test_moon_on_published_dates(frame):
    for dates, phase in ((NEW_MOONS, 0), (FULL_MOONS, 4)):
        df = frame([(dt.datetime.fromisoformat(d + "T12:00:00"),) for d in dates], "date timestamp_ntz")
        assert {r["moon"] for r in add_time_features(df, "date", ALL_FEATURES).collect()} == {phase}
