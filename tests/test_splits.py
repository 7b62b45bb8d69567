import datetime as dt

from helpers import daily
from tidewise.operators.splits import (group_split_role, split_role, time_group_split,
                                       time_split, with_role)

SCHEMA = "id string, date timestamp_ntz, y double"


def test_split_bounds(frame):
    rows = [("a", t, 1.0) for t in daily("2020-01-01", 10)]
    df = frame(rows, SCHEMA)
    train, test = time_split(df, "date", "2020-01-04 00:00:00", "2020-01-07 00:00:00")
    assert [r["date"].day for r in train.orderBy("date").collect()] == [1, 2, 3, 4]
    assert [r["date"].day for r in test.orderBy("date").collect()] == [5, 6, 7]
    roles = {r["date"].day: r["role"] for r in
             with_role(df, split_role("date", "2020-01-04 00:00:00",
                                      "2020-01-07 00:00:00")).collect()}
    assert roles == {1: "train", 2: "train", 3: "train", 4: "train",
                     5: "test", 6: "test", 7: "test"}


def test_group_split_closed_bounds(frame):
    rows = [("a", t, 1.0) for t in daily("2020-01-01", 10)]
    df = frame(rows, SCHEMA)
    train, test = time_group_split(df, "date", "2020-01-03 00:00:00",
                                   "2020-01-05 00:00:00", "2020-01-07 00:00:00")
    assert [r["date"].day for r in train.orderBy("date").collect()] == [1, 2, 3]
    assert [r["date"].day for r in test.orderBy("date").collect()] == [5, 6, 7]
    # a time in both ranges is a training time in the one-frame form
    both = with_role(df, group_split_role("date", "2020-01-05 00:00:00",
                                          "2020-01-04 00:00:00", "2020-01-06 00:00:00"))
    got = {r["date"].day: r["role"] for r in both.collect()}
    assert got[5] == "train" and got[6] == "test" and 7 not in got
    assert dt.datetime(2020, 1, 8) not in {r["date"] for r in both.collect()}
