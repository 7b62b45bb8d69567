"""Nothing is lost, cut or re-typed: labels, segments, ties, user columns."""

import math

import pytest
from helpers import daily

from tidewise import Roles
from tidewise.operators import forest as fr
from tidewise.operators import prepare as pp
from tidewise.operators import profile as pf
from tidewise.operators.lags import add_lags
from tidewise.operators.metrics import score_predictions
from tidewise.plans import backtest as bt
from tidewise.plans import runs
from tidewise.plans import tracking as tk
from tidewise.plans import train as tr
from tidewise.sources import fixtures as fx

SF = "/root/testdata/sf0.001"
SMALL = [{"n_trees": 2, "feature_subset": "all", "min_samples_split": 2, "max_depth": 3}]


def test_wide_table_holds_all_rows(spark):
    long = pp.wide_to_long(fx.sales_wide(spark, SF))
    total = spark.read.parquet(SF + "/lineitem.parquet").agg({"l_quantity": "sum"}).first()[0]
    assert long.agg({"Quantity": "sum"}).first()[0] == total


def test_day_labels_stay_whole(frame):
    cal = frame([("d_1000", "2020-01-01"), ("d_10000", "2021-01-01")], "d string, date string")
    rows = {r.d: r.date.year for r in pp.calendar_clean(cal).collect()}
    assert rows == {"d_1000": 2020, "d_10000": 2021}


def test_winner_of_tiny_scores(frame):
    rows = [(f"i{k}", "s", t, 1e-5 * (k + (j % 3))) for k in range(4)
            for j, t in enumerate(daily("2022-01-01", 40))]
    df = frame(rows, "id string, seg string, date timestamp_ntz, y double")
    roles = Roles(id="id", time="date", target="y", segment="seg")
    scores = tr.baseline_scores(df, roles, 4, 4, 2)
    res = {r.model: r.average_mse for r in tr.cv_results(scores, 2).collect()}
    best = tr.best_models(tr.cv_results(scores, 2)).first()
    assert best.model == min(res, key=res.get) and 0 < best.average_mse < 1e-9


def panel_rows(segments):
    return [(f"i{k}", segments[k % len(segments)], t, float((j * (k + 1)) % 7), float(j), k)
            for k in range(2 * len(segments)) for j, t in enumerate(daily("2022-01-01", 30))]


def test_segment_labels_survive_a_run(frame, tmp_path, monkeypatch):
    labels = ["1", "01", None, "a/b=c", ""]
    df = frame(panel_rows(labels), "id string, seg string, date timestamp_ntz, y double, x double, fold int")
    roles = Roles(id="id", time="date", target="y", segment="seg")
    monkeypatch.setattr(fr, "sample_candidates", lambda *a, **k: SMALL)
    store = str(tmp_path / "store")
    run_id = runs.train_run(df, roles, store, 4, 4, n_folds=2, baselines=())
    best = tk.read_best(df.sparkSession, store, run_id).collect()
    assert sorted(r.segment for r in best) == sorted(["1", "01", "(none)", "a/b=c", ""])
    out = runs.backtest_run(df, store, run_id, n_folds=2)["predictions"].collect()
    assert len(out) == 2 * 4 * 2 * len(labels)  # folds x steps x series
    assert len({(r.id, r.date) for r in out}) == len(out)
    assert all(not math.isnan(r.prediction) for r in out)


def test_user_columns_with_internal_names_are_features(frame):
    df = frame(panel_rows(["s"]), "id string, segment string, date timestamp_ntz, y double, x double, fold int")
    roles = Roles(id="id", time="date", target="y")
    folded = tr.cv_frame(df, roles, [4], 2, 4)
    feats = tr.forest_features(tr.horizon_frame(folded, [4], 4), roles)
    assert sorted(feats) == ["last", "own_fold", "own_segment", "x"]
    with pytest.raises(ValueError):
        Roles(id="fold", time="date", target="y").protected(df)


def test_lag_follows_the_series_over_segments(frame):
    t = daily("2022-01-01", 4)
    df = frame([("a", "p" if i < 2 else "q", t[i], float(i)) for i in range(4)],
               "id string, seg string, date timestamp_ntz, y double")
    got = {r.date: r.last_1 for r in add_lags(df, Roles("id", "date", "y", "seg"), [1]).collect()}
    assert [got[x] for x in t] == [None, 0.0, 1.0, 2.0]


def test_nan_is_missing_and_booleans_are_no_features(frame):
    nan = float("nan")
    df = frame([("a", 1.0, nan, True), ("b", 2.0, 4.0, False), ("c", nan, 8.0, True), ("d", None, 6.0, None)],
               "id string, u double, v double, b boolean")
    assert {r[0]: r[1] for r in pf.column_medians(df, ["u", "v"]).collect()} == {"u": 1.5, "v": 6.0}
    roles = Roles(id="id", time="t", target="y")
    assert pf.numeric_categorical(df, roles, booleans=False)[0] == ["u", "v"]
    assert pf.numeric_categorical(df, roles)[0] == ["u", "v", "b"]


def test_median_of_many_ties_narrows(frame):
    df = frame([(float(i // 7),) for i in range(700)], "x double")
    assert pf.column_medians(df, ["x"], task_values=3, buckets=2).first()["median"] == 49.5


def test_score_predictions_against_truth(frame):
    preds = frame([("a", 1, 2.0), ("a", 2, 5.0)], "id string, t int, prediction double")
    truth = frame([("a", 1, 1.0), ("a", 2, 3.0), ("b", 1, 0.0)], "id string, t int, y double")
    r = score_predictions(preds, truth, ["id", "t"]).first()
    assert (r.n, r.mse) == (2, 2.5)
    with pytest.raises(Exception, match="missing values"):
        score_predictions(preds, truth.limit(0), ["id", "t"]).collect()


def test_grid_function_adds_features(frame):
    df = frame(panel_rows(["s", "t"]), "id string, seg string, date timestamp_ntz, y double, x double, k int")
    roles = Roles(id="id", time="date", target="y", segment="seg")
    seen = []

    def grid_fn(grid, horizon):
        seen.append(horizon)
        return grid.withColumn("twice", grid["last"] * horizon)

    scores = tr.forest_scores(df, roles, 4, 2, 1, SMALL, grid_fn=grid_fn)
    assert scores.count() == 4 and sorted(set(seen)) == [2, 4]
    preds = bt.forest_backtest_predictions(df, roles, 4, 2, 1, {("s", 2): SMALL[0]}, grid_fn=grid_fn)
    assert preds.count() == 2 * 2


def test_offsets_by_months(frame):
    import datetime as dt

    from tidewise.functions.offsets import shift_time
    df = frame([(dt.datetime(2020, 1, 31),)], "t timestamp_ntz")
    got = df.select(shift_time(df["t"], 1, "month"), shift_time(df["t"], 1, "quarter"),
                    shift_time(df["t"], -1, "year")).first()
    assert list(got) == [dt.datetime(2020, 2, 29), dt.datetime(2020, 4, 30), dt.datetime(2019, 1, 31)]


def test_calendar_gap_leaves_nulls(frame):
    long = frame([("i", "d_1", 1.0), ("i", "d_2", 2.0)], "id string, d string, Quantity double")
    cal = frame([("d_1", "2020-01-01")], "d string, date string")
    got = {r.d: r.date for r in pp.join_calendar(long, pp.calendar_clean(cal)).collect()}
    assert got["d_2"] is None and got["d_1"].year == 2020
