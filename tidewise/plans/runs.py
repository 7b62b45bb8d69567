"""Train then backtest through the run store, as the reference's two commands do."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewise.plans import backtest as bt
from tidewise.plans import tracking as tk
from tidewise.plans import train as tr
from tidewise.roles import Roles


def train_run(df: DataFrame, roles: Roles, store: str, n_pred: int, group: int,
              n_folds: int = 3, baselines: tuple[str, ...] = ("Last",),
              with_forest: bool = True, project: str = "panel", validate: bool = True, spread: bool = False,
              grid_fn=None, models: list = (), save_models: bool = True) -> str:
    """Train, record candidates, winners and the run; return the run id.

    With ``validate`` the panel's keys are checked first (one aggregate job):
    a null id, a null time or a repeated (id, time) raises. With ``save_models``, each
    winning forest is fitted on its segment's whole data and stored with the run.
    """
    from tidewise.operators.horizons import check_grouping
    from tidewise.sources.panel import validate_panel
    group = check_grouping(n_pred, group)
    if validate:
        validate_panel(df, roles)
    out = tr.train(df, roles, n_pred, group, n_folds, baselines, with_forest,
                   project=project, by_segment=True, spread=spread, grid_fn=grid_fn, models=models)
    run_id = tk.new_run_id()
    spark = df.sparkSession
    # cv_results is reused three times: keep it once in the shared checkpoint
    # folder instead of re-running the forest fits' union each time.
    from tidewise.session import checkpoint
    results = checkpoint(out["cv_results"])
    tk.record_candidates(results, store, run_id, n_folds, len(df.columns) + 1)
    best = tr.best_models(results, project)
    tk.record_best(best, store, run_id)
    if save_models:
        _save_winners(df, roles, store, run_id, n_pred, group, best, spread, grid_fn)
    # last: from now on the run is seen
    tk.record_run(spark, tr.train_summary(best), store, run_id, roles, n_pred, group, n_folds)
    return run_id


def _save_winners(df, roles, store, run_id, n_pred, group, best, spread, grid_fn) -> None:
    """The winning forests, grown together on the whole panel."""
    from tidewise.plans import grove as gv
    winners = best.filter(F.col("model") == tr.FOREST).select("segment", "predict_horizon", "params")
    if not winners.isEmpty():
        tk.save_forests(*gv.fitted(df, roles, n_pred, group, winners, spread, grid_fn), store, run_id)


def forecast_run(df: DataFrame, store: str, run_id: str | None = None, spread: bool = False,
                 grid_fn=None) -> DataFrame:
    """(segment, predict_horizon, id, time, prediction): the stored winning forests of a run (the best run
    if none is given) applied to the rows of a panel."""
    from tidewise.plans import grove as gv
    spark = df.sparkSession
    run = tk.best_run(spark, store, run_id)
    plans, nodes = tk.load_forests(spark, store, run["run_id"])
    return gv.predicted(df, tk.roles_of(run), int(run["number_predictions"]), int(run["n_predictions_groupby"]),
                        plans, nodes, spread, grid_fn)


def backtest_run(df: DataFrame, store: str, run_id: str | None = None, n_folds: int = 3,
                 unit="day", validate: bool = True, spread: bool = False,
                 grid_fn=None, models: list = ()) -> dict[str, DataFrame]:
    """Backtest the winners of a stored run (the best run if none is given)."""
    from tidewise.sources.panel import validate_panel
    spark = df.sparkSession
    run = tk.best_run(spark, store, run_id)
    roles = tk.roles_of(run)
    if validate:
        validate_panel(df, roles)
    winners = tk.read_best(spark, store, run["run_id"])
    return bt.backtest(df, roles, int(run["number_predictions"]),
                       int(run["n_predictions_groupby"]), n_folds, winners, unit,
                       spread, grid_fn=grid_fn, models=models)
