import random

import pytest
from helpers import daily
from tidewise import Roles
from tidewise.operators import forest as fr
from pyspark.sql import functions as F

from tidewise.plans import backtest as bt
from tidewise.plans import runs, tracking as tk
from tidewise.plans import train as tr

ROLES = Roles(id="id", time="date", target="y", segment="seg")
SCHEMA = "id string, seg string, date timestamp_ntz, y double, x double"


def test_train_then_backtest_through_store(frame, tmp_path, monkeypatch):
    rng = random.Random(9)
    rows = [(f"id{i}", f"s{i % 2}", t, float(rng.randrange(0, 20)), rng.random())
            for i in range(4) for t in daily("2022-01-01", 50)]
    df = frame(rows, SCHEMA)
    small = [{"n_trees": 3, "feature_subset": "all", "min_samples_split": 2, "max_depth": 3}]
    monkeypatch.setattr(fr, "sample_candidates", lambda *a, **k: small)
    store = str(tmp_path / "store")
    run_id = runs.train_run(df, ROLES, store, 6, 3, n_folds=2, baselines=("Last",),
                            with_forest=True)
    spark = df.sparkSession
    run = tk.best_run(spark, store)
    assert run["run_id"] == run_id and run["column_segment_groupby"] == "seg"
    cands = tk.read_candidates(spark, store, run_id).collect()
    # 2 segments x 2 horizons x (Last + 1 forest candidate)
    assert len(cands) == 8
    forest = [c for c in cands if c["model"] == "RandomForest"]
    assert all(c["params"]["max_depth"] == "3" for c in forest)  # own params, not the winner's
    best = tk.read_best(spark, store, run_id).collect()
    assert len(best) == 4
    assert all(c["tags"]["n_grid_features"] == "6" for c in cands)  # five columns and the lag
    forests = {(b["segment"], int(b["predict_horizon"])) for b in best if b["model"] == "RandomForest"}
    assert forests
    _, nodes = tk.load_forests(spark, store, run_id)
    assert {(r.segment, r.predict_horizon) for r in nodes.select("segment", "predict_horizon").distinct().collect()} == forests
    assert nodes.select("tree").distinct().count() == 3 and nodes.agg(F.max("level")).first()[0] <= 3
    ahead = runs.forecast_run(df, store).collect()
    assert len(ahead) == sum(100 for _ in forests)  # each segment has two series of 50 days
    assert all(0 <= r.prediction < 20 for r in ahead)
    with pytest.raises(ValueError, match="other features"):
        runs.forecast_run(df.drop("x"), store)
    out = runs.backtest_run(df, store)
    report = {r.fold: r for r in out["report"].collect()}
    assert sorted(report, key=str) == [0, 1, 2, None] and all(r.train_mse > 0 for r in report.values())
    scores = out["fold_scores"].collect()
    assert sorted(r["fold"] for r in scores) == [0, 1, 2]  # backtest periods default to 3
    assert all(r["n"] > 0 and r["mse"] is not None for r in scores)
    n_pred_rows = out["predictions"].count()
    assert n_pred_rows == sum(r["n"] for r in scores)


def test_runs_are_seen_whole(frame, tmp_path, monkeypatch):
    from concurrent.futures import ThreadPoolExecutor
    rows = [(f"id{i}", f"s{i % 2}", t, float((i + j) % 5), 0.0) for i in range(2) for j, t in enumerate(daily("2022-01-01", 30))]
    df, store = frame(rows, SCHEMA), str(tmp_path / "store")
    args = dict(n_pred=4, group=2, n_folds=2, baselines=("Last", "Mean"), with_forest=False)
    with pytest.raises(LookupError):
        tk.best_run(df.sparkSession, store)
    with monkeypatch.context() as m:
        m.setattr(tk, "new_run_id", lambda: "killed")
        m.setattr(tk, "record_best", lambda *a: (_ for _ in ()).throw(RuntimeError("dies")))
        with pytest.raises(RuntimeError, match="dies"):
            runs.train_run(df, ROLES, store, **args)
    with pytest.raises(LookupError):
        tk.best_run(df.sparkSession, store)
    with pytest.raises(LookupError):
        tk.read_candidates(df.sparkSession, store, "killed")
    with ThreadPoolExecutor(2) as ex:
        both = list(ex.map(lambda _: runs.train_run(df, ROLES, store, **args), range(2)))
    assert {r.run_id for r in tk.read_runs(df.sparkSession, store).collect()} == set(both) and len(set(both)) == 2
    for run_id in both:
        assert tk.read_candidates(df.sparkSession, store, run_id).count() == 8
        assert tk.read_best(df.sparkSession, store, run_id).count() == 4


class Middle:
    """Half of the segment's training mean: a project's own forecaster."""
    name, params = "Middle", {"share": 1.0}

    def fit_predict(self, train, test, roles):
        model = ["segment", "predict_horizon", "fold"]
        return test.join(train.groupBy(*model).agg(F.avg(roles.target).alias("prediction")), model, "left")


def test_own_forecaster_through_train_and_backtest(frame):
    rng = random.Random(4)
    rows = [(f"id{i}", f"s{i % 2}", t, float(10 * (i % 2) + rng.randrange(3)), 0.0)
            for i in range(4) for t in daily("2022-01-01", 40)]
    df = frame(rows, SCHEMA)
    out = tr.train(df, ROLES, 4, 2, 2, baselines=("Mean",), with_forest=False, models=[Middle()])
    scores = {(r.segment, r.predict_horizon, r.fold, r.model): r.mse for r in out["scores"].collect()}
    assert len(scores) == 2 * 2 * 2 * 2
    for (s, h, k, m), mse in scores.items():  # the same forecast as the built-in mean
        assert abs(mse - scores[s, h, k, "Mean"]) < 1e-9
    winners = out["best_models"].filter("model = 'Mean'").withColumn("model", F.lit("Middle"))
    mine = bt.backtest(df, ROLES, 4, 2, 2, winners, models=[Middle()])["predictions"].collect()
    plain = bt.backtest_predictions(df, ROLES, 4, 2, 2, ("Mean",)).collect()
    key = lambda r: (r.fold, r.predict_horizon, r.id, r.date, round(r.prediction, 9))
    won = {(r.segment, r.predict_horizon) for r in winners.collect()}
    assert sorted(map(key, mine)) == sorted(key(r) for r in plain if (r.segment, r.predict_horizon) in won)
    assert len(mine) > 0


def plan_size(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("\n")


def test_plan_of_a_forecaster_does_not_grow(frame, monkeypatch):
    rows = [("a", "s", t, float(j % 5), 0.0) for j, t in enumerate(daily("2022-01-01", 60))]
    df, sizes = frame(rows, SCHEMA), []

    class Sized(Middle):
        def fit_predict(self, train, test, roles):
            out = super().fit_predict(train, test, roles)
            sizes.append(plan_size(out))
            return out
    for group in (12, 1):  # one horizon, twelve horizons
        tr.train(df, ROLES, 12, group, 2, baselines=(), with_forest=False, models=[Sized()])
    assert len(sizes) == 2 and sizes[0] == sizes[1]
