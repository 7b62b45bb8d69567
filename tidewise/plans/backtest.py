"""Backtest: for each expanding fold over the whole panel, refit the chosen
model of every (segment, horizon) on the data up to the fold's end of
training and forecast its own time group of the next N steps.

Horizon h with group size g forecasts the steps end_train + (h-g+1) ...
end_train + h (in ``unit``s, days by default; calendar months, the panel's own step or a
project's own offsets as well). The bounds of all time groups are one small array, in which
each row finds its folds and horizons, so the grid is never copied once per horizon.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewise.functions.frequency import infer_unit
from tidewise.functions.offsets import offset_function
from tidewise.operators.baselines import BASELINES, fold_mean_tables, mean_keys
from tidewise.operators.folds import fold_arrays
from tidewise.operators.horizons import check_grouping, horizon_list
from tidewise.operators.lags import add_lags, lag_name
from tidewise.operators.metrics import guard_missing, sq_err
from tidewise.roles import Roles


AUTO = "auto"


def step_offset(df: DataFrame, roles: Roles, unit, spread: bool = False):
    """The offset function of ``unit``: a unit's name, ``auto`` for the panel's most frequent step,
    or a project's own function (time column, number of steps) -> time column."""
    return offset_function(infer_unit(df, roles, spread) if unit == AUTO else unit)


def _group_arrays(df: DataFrame, roles: Roles, n_pred: int, group: int, n_folds: int, unit) -> DataFrame:
    """One row: ``end_train`` by fold, and ``groups``, the (fold, predict_horizon, begin_test, end_test,
    last_test) of every time group, where last_test is the end of the fold's test set."""
    ahead = step_offset(df, roles, unit)
    fa = fold_arrays(df, roles, n_folds, n_pred, by_segment=False)
    groups = []
    for k in range(n_folds):
        end = F.element_at("end_train", k + 1)
        for h in horizon_list(n_pred, group):
            groups.append(F.struct(
                F.lit(k).cast("bigint").alias("fold"), F.lit(h).cast("bigint").alias("predict_horizon"),
                ahead(end, F.lit(h - group + 1)).alias("begin_test"), ahead(end, F.lit(h)).alias("end_test"),
                F.element_at("end_test", k + 1).alias("last_test")))
    return fa.select("end_train", F.array(*groups).alias("groups"))


def time_group_bounds(df: DataFrame, roles: Roles, n_pred: int, group: int, n_folds: int, unit="day") -> DataFrame:
    """(fold, predict_horizon, begin_test, end_test): the steps h-g+1 to h after each fold's end of
    training, as times. ``unit``: see ``step_offset``."""
    group = check_grouping(n_pred, group)
    return _group_arrays(df, roles, n_pred, group, n_folds, unit).select(F.inline("groups")).drop("last_test")


def backtest_frame(df: DataFrame, roles: Roles, n_pred: int, group: int, n_folds: int,
                   unit="day", spread: bool = False) -> DataFrame:
    """Panel + ``segment`` + lags, with per-row fold tags:

    - ``train_from``: first fold whose training set (t <= end_train) holds the row;
    - ``tests``: the (fold, predict_horizon, beyond) of each time group that holds the row
      (groups may overlap if the offsets say so); ``beyond`` marks a time past the fold's
      test set, for which the reference has no truth.
    """
    group = check_grouping(n_pred, group)
    horizons = horizon_list(n_pred, group)
    s = roles.with_segment(df)
    # All bounds (folds x horizons) arrive once per row as a column, so the subquery
    # runs once however many expressions read it.
    bounds = _group_arrays(s, roles, n_pred, group, n_folds, unit).select(F.struct("*")).scalar()
    lagged = add_lags(s, roles, horizons, spread).withColumn("_bounds", bounds)
    b, t = F.col("_bounds"), F.col(roles.time)
    train_from = None
    for k in range(n_folds):
        c = t <= F.element_at(b.getField("end_train"), k + 1)
        train_from = F.when(c, F.lit(k)) if train_from is None else train_from.when(c, F.lit(k))
    mine = F.transform(
        F.filter(b.getField("groups"), lambda g: (t >= g["begin_test"]) & (t <= g["end_test"])),
        lambda g: F.struct(g["fold"].alias("fold"), g["predict_horizon"].alias("predict_horizon"),
                           (t > g["last_test"]).alias("beyond")))
    return lagged.withColumns({"train_from": train_from.cast("bigint"), "tests": mine}).drop("_bounds")


def backtest_tests(frame: DataFrame) -> DataFrame:
    """One row per (panel row, fold) in a fold's time group.

    ``inline_outer`` then a filter, rather than ``inline``: for an inner
    generator Spark infers a size filter and pushes it below the projection
    that reads the fold bounds, copying the bounds subquery into it.
    """
    return (frame.select("*", F.inline_outer("tests")).filter(F.col("fold").isNotNull())
            .drop("tests", "train_from"))


def last_backtest_prediction(horizons: list[int], group: int) -> Column:
    lags = F.array(*[F.col(lag_name(h)) for h in horizons])
    idx = (F.col("predict_horizon") / F.lit(group)).cast("int")
    return F.coalesce(F.element_at(lags, idx), F.lit(0.0))


def backtest_predictions(df: DataFrame, roles: Roles, n_pred: int, group: int, n_folds: int,
                         models: tuple[str, ...] = ("Last",), unit="day",
                         spread: bool = False, materialize: bool = False) -> DataFrame:
    """(model, fold, predict_horizon, segment, id, time, y, prediction, beyond).

    The fold means of Mean / MeanTS (pre-aggregated from the training rows)
    are joined onto the test rows once; ``inline`` then emits one row per
    model, so several models cost one pass over the test rows, not a union.
    """
    group = check_grouping(n_pred, group)
    horizons = horizon_list(n_pred, group)
    frame = backtest_frame(df, roles, n_pred, group, n_folds, unit, spread)
    if materialize:  # expensive panel lineage: write the tagged grid once
        from tidewise.session import checkpoint
        frame = checkpoint(frame)
    tests = backtest_tests(frame)
    for model, means in fold_mean_tables(frame, roles, models, n_folds).items():
        keys = mean_keys(model, roles)
        tests = tests.join(means.withColumnRenamed("prediction", f"_p_{model}"),
                           keys + ["fold"], "left")
    per_model = F.array(*[F.struct(
        F.lit(m).alias("model"),
        (last_backtest_prediction(horizons, group) if m == "Last"
         else F.col(f"_p_{m}")).alias("prediction")) for m in models])
    cols = ["fold", "predict_horizon", "segment", roles.id, roles.time, roles.target, "beyond"]
    out = tests.select(*cols, F.inline(per_model))
    return out.select("model", *cols, "prediction")


def backtest_scores(preds: DataFrame, keys: list[str], roles: Roles) -> DataFrame:
    """(keys..., n, mse); a prediction without truth is an error."""
    y, p = F.col(roles.target), F.col("prediction")
    a = preds.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(sq_err(p, y)).alias("_mse"),
        F.count_if(F.col("beyond") | y.isNull() | p.isNull()).alias("_missing"))
    return a.select(*keys, "n", guard_missing(F.col("_missing"), F.col("_mse")).alias("mse"))


def backtest_last(df: DataFrame, roles: Roles, n_pred: int, group: int, n_folds: int,
                  unit="day", spread: bool = False) -> DataFrame:
    """(fold, segment, n, mse) of the Last forecaster: one job, no loop."""
    preds = backtest_predictions(df, roles, n_pred, group, n_folds, ("Last",), unit,
                                 spread)
    return backtest_scores(preds, ["fold", "segment"], roles)


# --------------------------------------------------------------------------
# Refitting chosen models
# --------------------------------------------------------------------------
def forest_backtest_predictions(df: DataFrame, roles: Roles, n_pred: int, group: int,
                                n_folds: int, params_by_model: dict[tuple[str, int], dict],
                                unit="day", spread: bool = False, grid_fn=None) -> DataFrame:
    """Refit the forest of each (segment, horizon) in ``params_by_model`` on
    the rows up to each fold's end of training and predict its time group."""
    import json

    from tidewise.plans.grove import grove_backtest
    jobs = df.sparkSession.createDataFrame(
        [(s, int(h), json.dumps(p, sort_keys=True)) for (s, h), p in params_by_model.items()],
        "segment string, predict_horizon bigint, params string")
    return grove_backtest(df, roles, n_pred, group, n_folds, jobs, unit, spread, grid_fn)[0]


def backtest(df: DataFrame, roles: Roles, n_pred: int, group: int, n_folds: int,
             winners: DataFrame, unit="day", spread: bool = False, grid_fn=None,
             models: list = ()) -> dict[str, DataFrame]:
    """Backtest the chosen model of each (segment, horizon).

    ``winners``: ``best_models`` rows (segment, predict_horizon, model, params).
    Baseline winners are predicted in one job and kept by a semi join on the
    winners; forest winners are refitted together (``plans.grove``). Returns ``predictions``,
    ``fold_scores`` (per fold over all segments and horizons, as the
    reference reports them), ``train_scores`` (the winners' errors on their own training
    rows, per fold) and ``report`` (both, and their means over the folds). A project's
    own forecasters have no training errors: they give no predictions of training rows.
    """
    group = check_grouping(n_pred, group)
    keys = ["segment", "predict_horizon", "model"]
    w = winners.select("segment", F.col("predict_horizon").cast("bigint").alias("predict_horizon"), "model", "params")
    own = {m.name: m for m in models}
    # model names, bounded by the models that exist
    chosen = sorted(r[0] for r in w.select("model").distinct().collect())
    base_models = [m for m in chosen if m in BASELINES and m not in own]
    parts, sums = [], []
    if used := [own[m] for m in chosen if m in own]:
        from tidewise.plans.custom import forecaster_predictions
        parts += [forecaster_predictions(df, roles, n_pred, group, n_folds, m, winners, unit, spread,
                                         grid_fn) for m in used]
    if base_models:
        p = backtest_predictions(df, roles, n_pred, group, n_folds, tuple(base_models), unit,
                                 spread)
        t = baseline_train_sums(df, roles, n_pred, group, n_folds, tuple(base_models), unit, spread)
        parts.append(p.join(w.select(*keys), keys, "left_semi"))
        sums.append(t.join(w.select(*keys), keys, "left_semi"))
    if "RandomForest" in chosen and "RandomForest" not in own:
        from tidewise.plans.grove import grove_backtest
        p, t = grove_backtest(df, roles, n_pred, group, n_folds, w.filter(F.col("model") == "RandomForest"), unit,
                              spread, grid_fn)
        parts.append(p)
        sums.append(t.withColumn("model", F.lit("RandomForest")).withColumn("missing", F.lit(0).cast("bigint")))
    preds = reduce(DataFrame.unionByName, parts)
    scores = backtest_scores(preds, ["fold"], roles)
    out = {"predictions": preds, "fold_scores": scores}
    if sums:
        train = reduce(DataFrame.unionByName, sums).groupBy("fold").agg(
            F.sum("n").alias("n"), F.sum("sse").alias("_sse"), F.sum("missing").alias("_missing"))
        out["train_scores"] = train.select("fold", "n", guard_missing(
            F.col("_missing"), F.col("_sse") / F.col("n")).alias("mse"))
        out["report"] = _with_means(scores.join(out["train_scores"].select(
            "fold", F.col("mse").alias("train_mse")), "fold", "left"), [])
    return out


# --------------------------------------------------------------------------
# Training-set errors of the backtest
# --------------------------------------------------------------------------
def baseline_train_scores(df: DataFrame, roles: Roles, n_pred: int, group: int, n_folds: int,
                          models: tuple[str, ...] = ("Last",),
                          spread: bool = False) -> DataFrame:
    """(model, fold, n, mse) of each baseline on its own training rows
    (t <= end_train of the fold), over every horizon, as the backtest reports
    next to the test error. The truth is taken per fold."""
    sums = baseline_train_sums(df, roles, n_pred, group, n_folds, models, spread=spread)
    a = sums.groupBy("model", "fold").agg(F.sum("n").alias("n"), F.sum("sse").alias("_sse"),
                                          F.sum("missing").alias("_missing"))
    return a.select("model", "fold", "n", guard_missing(F.col("_missing"), F.col("_sse") / F.col("n")).alias("mse"))


def baseline_train_sums(df: DataFrame, roles: Roles, n_pred: int, group: int, n_folds: int,
                        models: tuple[str, ...] = ("Last",), unit="day",
                        spread: bool = False) -> DataFrame:
    """(model, segment, predict_horizon, fold, n, sse, missing) of each baseline on its own
    training rows.

    One aggregate over the panel: rows are summed per (segment, id, first
    fold holding them). Training sets are nested, so the sums accumulate over
    folds instead of copying rows. For the mean models the squared error is
    expanded, sum (m - y)^2 = sum y^2 - 2 m sum y + n m^2, so a fold's mean is
    applied to sums taken before it is known; the segment mean comes from a
    small per-(segment, fold) aggregate of the per-series sums.
    """
    group = check_grouping(n_pred, group)
    horizons = horizon_list(n_pred, group)
    frame = backtest_frame(df, roles, n_pred, group, n_folds, unit, spread=spread).filter(
        F.col("train_from").isNotNull())
    y = F.col(roles.target)
    lasts = [f"_sse_{h}" for h in horizons]
    sums = ("_c", "_cy", "_sy", "_syy", "_miss", *lasts)
    part = frame.groupBy("segment", roles.id, "train_from").agg(
        F.count(F.lit(1)).alias("_c"), F.count(y).alias("_cy"), F.sum(y).alias("_sy"),
        F.sum(y * y).alias("_syy"), F.count_if(y.isNull()).alias("_miss"),
        *[F.sum(sq_err(F.coalesce(F.col(lag_name(h)), F.lit(0.0)), y)).alias(c) for h, c in zip(horizons, lasts)])
    folds = F.sequence(F.col("train_from"), F.lit(n_folds - 1).cast("bigint"))
    cum = (part.select("segment", roles.id, F.explode(folds).alias("fold"), *sums)
           .groupBy("segment", roles.id, "fold").agg(*[F.sum(c).alias(c) for c in sums]))
    # segment sums as a small (segments x folds) relation joined back: a
    # window over (segment, fold) would put every series of a large segment
    # in one task
    seg = cum.groupBy("segment", "fold").agg(F.sum("_sy").alias("_seg_sy"),
                                             F.sum("_cy").alias("_seg_cy"))
    cum = cum.join(seg, ["segment", "fold"])

    def expanded(m):
        return F.col("_syy") - F.lit(2.0) * m * F.col("_sy") + m * m * F.col("_cy")

    means = {"MeanTS": F.try_divide(F.col("_sy"), F.col("_cy").cast("double")),
             "Mean": F.try_divide(F.col("_seg_sy"), F.col("_seg_cy").cast("double"))}
    per_fold = cum.groupBy("segment", "fold").agg(
        *[F.sum(c).alias(c) for c in ("_c", "_miss", *lasts)],
        *[F.sum(expanded(m)).alias(f"_sse_{name}") for name, m in means.items()],
        *[F.sum(F.when(m.isNull(), F.col("_c")).otherwise(0)).alias(f"_nopred_{name}") for name, m in means.items()])
    cells = []
    for model in models:
        for h, last in zip(horizons, lasts):
            sse, miss = (F.col(last), F.col("_miss")) if model == "Last" else (
                F.col(f"_sse_{model}"), F.col("_miss") + F.col(f"_nopred_{model}"))
            cells.append(F.struct(F.lit(model).alias("model"), F.lit(h).cast("bigint").alias("predict_horizon"),
                                  sse.alias("sse"), miss.alias("missing")))
    rows = per_fold.select("segment", "fold", F.col("_c").alias("n"), F.inline(F.array(*cells)))
    return rows.select("model", "segment", "predict_horizon", "fold", "n", "sse", "missing")


def _with_means(folds: DataFrame, keys: list[str]) -> DataFrame:
    """The fold rows, and for each key their means (fold and n null)."""
    means = folds.groupBy(*keys).agg(F.avg("mse").alias("mse"), F.avg("train_mse").alias("train_mse"))
    none = F.lit(None).cast("bigint")
    return folds.unionByName(means.select(*keys, none.alias("fold"), none.alias("n"), "mse", "train_mse"))


def backtest_report(predictions: DataFrame, train_scores: DataFrame, roles: Roles) -> DataFrame:
    """(model, fold, n, mse, train_mse) of each fold, and each model's mean over the folds
    (fold and n null)."""
    test = backtest_scores(predictions, ["model", "fold"], roles)
    train = train_scores.select("model", "fold", F.col("mse").alias("train_mse"))
    return _with_means(test.join(train, ["model", "fold"], "left"), ["model"])
