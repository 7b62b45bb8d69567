"""Training: cross-validate every model per (segment, horizon) on expanding
folds, keep the best, and summarize.

Baselines for all segments, horizons and folds are scored in one Spark job
with no driver loop; the forests of all candidates are grown by ``tidewise.plans.grove``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewise.operators.baselines import (BASELINES, fold_mean_tables, last_prediction, mean_keys,
                                          mean_predictions)
from tidewise.operators.folds import with_folds
from tidewise.operators.horizons import check_grouping, horizon_list
from tidewise.operators.lags import add_lags
from tidewise.operators.metrics import fold_summary, guard_missing, sq_err
from tidewise.roles import INTERNAL, Roles

SCORE_KEYS = ["segment", "predict_horizon", "model", "candidate"]


def cv_frame(df: DataFrame, roles: Roles, horizons: list[int], n_folds: int, n_pred: int,
             by_segment: bool = True, spread: bool = False) -> DataFrame:
    """Panel + ``segment`` + one lag per horizon + fold tags.

    Folds are computed per segment when ``by_segment`` (each segment's model
    sees its own distinct times), else over the whole panel.
    """
    s = roles.with_segment(df)
    lagged = add_lags(s, roles, horizons, spread)
    # The fold tags are a small relation over the (segment, time) columns;
    # each consumer of this frame (test rows, training sums) recomputes them
    # from a column-pruned scan, which is cheaper than writing them out at
    # small scale. Pass a materialized ``roles_by_time`` to ``with_folds``
    # when the panel's lineage is expensive.
    return with_folds(lagged, roles, n_folds, n_pred, by_segment)


def last_cv_scores(folded: DataFrame, roles: Roles, horizons: list[int]) -> DataFrame:
    """(segment, predict_horizon, fold, n, mse) of the Last model.

    Each horizon's model is scored on the whole N-step test window of a fold.
    All horizons are scored by one aggregate over the test rows; only the
    small aggregate is turned into one row per horizon.
    """
    y = F.col(roles.target)
    test = folded.filter(F.col("test_fold").isNotNull())
    aggs = [F.count(F.lit(1)).alias("n"), F.count_if(y.isNull()).alias("_missing")]
    aggs += [F.avg(sq_err(last_prediction(h), y)).alias(f"_m{h}") for h in horizons]
    a = test.groupBy("segment", F.col("test_fold").alias("fold")).agg(*aggs)
    per_h = F.array(*[F.struct(F.lit(h).cast("bigint").alias("predict_horizon"),
                               F.col(f"_m{h}").alias("_mse")) for h in horizons])
    rows = a.select("segment", "fold", "n", "_missing", F.inline(per_h))
    return rows.select("segment", "predict_horizon", "fold", "n",
                       guard_missing(F.col("_missing"), F.col("_mse")).alias("mse"))


def baseline_scores(df: DataFrame, roles: Roles, n_pred: int, group: int, n_folds: int,
                    models: tuple[str, ...] = BASELINES, by_segment: bool = True,
                    spread: bool = False, materialize: bool = False) -> DataFrame:
    """(segment, predict_horizon, model, candidate, fold, n, mse) per baseline.

    All baselines are scored in ONE aggregate over the test rows: the fold
    means of Mean / MeanTS are joined onto the test rows (small relations,
    pre-aggregated from the training rows), then a single ``groupBy(segment,
    fold)`` computes every (model, horizon) score. Mean and MeanTS do not read
    the lag, so their score is the same for every horizon.
    """
    horizons = horizon_list(n_pred, check_grouping(n_pred, group))
    folded = cv_frame(df, roles, horizons, n_folds, n_pred, by_segment, spread)
    if materialize:
        # for an expensive panel lineage: write the tagged grid once to the
        # shared checkpoint folder; test rows and training sums then read it
        from tidewise.session import checkpoint
        folded = checkpoint(folded)
    test = (folded.filter(F.col("test_fold").isNotNull())
            .withColumnRenamed("test_fold", "fold"))
    # training means: one pre-aggregation of the training rows (no window, no
    # lag: Catalyst prunes them from this branch), joined as small relations
    for model, means in fold_mean_tables(folded, roles, models, n_folds).items():
        keys = mean_keys(model, roles)
        test = test.join(means.withColumnRenamed("prediction", f"_p_{model}"),
                         keys + ["fold"], "left")
    y = F.col(roles.target)
    aggs = [F.count(F.lit(1)).alias("n"), F.count_if(y.isNull()).alias("_ymiss")]
    cells = []
    for model in models:
        if model == "Last":
            for h in horizons:
                aggs.append(F.avg(sq_err(last_prediction(h), y)).alias(f"_m_Last_{h}"))
                cells.append((model, h, f"_m_Last_{h}", None))
        else:
            p = F.col(f"_p_{model}")
            aggs.append(F.avg(sq_err(p, y)).alias(f"_m_{model}"))
            aggs.append(F.count_if(p.isNull()).alias(f"_pmiss_{model}"))
            cells += [(model, h, f"_m_{model}", f"_pmiss_{model}") for h in horizons]
    a = test.groupBy("segment", "fold").agg(*aggs)
    per_cell = F.array(*[F.struct(
        F.lit(h).cast("bigint").alias("predict_horizon"), F.lit(m).alias("model"),
        F.col(score).alias("_mse"),
        (F.col("_ymiss") + (F.col(miss) if miss else F.lit(0))).alias("_missing"))
        for m, h, score, miss in cells])
    rows = a.select("segment", "fold", "n", F.inline(per_cell))
    return rows.select("segment", "predict_horizon", "model",
                       F.lit(0).cast("bigint").alias("candidate"), "fold", "n",
                       guard_missing(F.col("_missing"), F.col("_mse")).alias("mse"))


def cv_results(scores: DataFrame, n_folds: int) -> DataFrame:
    """One record per (segment, horizon, model, candidate): fold mean, population
    std and each fold's score."""
    return fold_summary(scores, SCORE_KEYS, n_folds)


def best_models(results: DataFrame, project: str = "panel") -> DataFrame:
    """The candidate with the least mean score per (segment, horizon).

    NaN or null scores never win; ties go to the first model name, then the
    first candidate, so the choice is deterministic.
    """
    s = F.col("average_mse")
    w = Window.partitionBy("segment", "predict_horizon").orderBy(s, "model", "candidate")
    ranked = (results.filter(s.isNotNull() & ~F.isnan(s))
              .withColumn("_rank", F.row_number().over(w)))
    params = ["params"] if "params" in results.columns else []
    return ranked.filter(F.col("_rank") == 1).select(
        "segment", "predict_horizon", "model", "candidate", "average_mse",
        F.concat_ws("_", F.lit(project), "segment",
                    F.col("predict_horizon").cast("string")).alias("model_key"), *params)


def train_summary(best: DataFrame) -> DataFrame:
    """The run's score: mean over the winners of their mean CV score."""
    return best.agg(F.count(F.lit(1)).alias("n_models"),
                    F.avg("average_mse").alias("average_cv_mse"))


def last_cv_predictions(df: DataFrame, roles: Roles, n_pred: int, group: int, n_folds: int,
                        by_segment: bool = True, spread: bool = False) -> DataFrame:
    """Test-row predictions of Last for every horizon:
    (segment, predict_horizon, fold, id, time, y, prediction)."""
    horizons = horizon_list(n_pred, check_grouping(n_pred, group))
    folded = cv_frame(df, roles, horizons, n_folds, n_pred, by_segment, spread)
    test = folded.filter(F.col("test_fold").isNotNull())
    pairs = F.array(*[F.struct(F.lit(h).cast("bigint").alias("predict_horizon"),
                               last_prediction(h).alias("prediction")) for h in horizons])
    return test.select("segment", F.col("test_fold").alias("fold"), roles.id, roles.time,
                       roles.target, F.inline(pairs))


def mean_cv_predictions(df: DataFrame, roles: Roles, model: str, n_folds: int, n_pred: int,
                        by_segment: bool = True) -> DataFrame:
    """Test-row predictions of Mean / MeanTS: (segment, fold, id, time, y, prediction)."""
    folded = cv_frame(df, roles, [], n_folds, n_pred, by_segment)
    test = (folded.filter(F.col("test_fold").isNotNull())
            .select("segment", roles.id, roles.time, roles.target,
                    F.col("test_fold").alias("fold")))
    return mean_predictions(test, folded, roles, model, n_folds)


# --------------------------------------------------------------------------
# Forest search
# --------------------------------------------------------------------------
FOREST = "RandomForest"


def horizon_frame(folded: DataFrame, horizons: list[int], h: int) -> DataFrame:
    """The grid of one horizon: its lag becomes ``last``, other lags go."""
    from tidewise.operators.lags import lag_name
    return folded.withColumn("last", F.col(lag_name(h))).drop(*[lag_name(x) for x in horizons])


def forest_features(frame: DataFrame, roles: Roles) -> list[str]:
    """All columns but the roles and those that the plans add. A user's columns never
    have such a name: ``Roles.protected`` has renamed them."""
    from tidewise.operators.forest import feature_columns
    exclude = INTERNAL - {"last"}
    if roles.segment == "segment":
        exclude -= {"segment"}  # the configured column is a feature
    return feature_columns(frame, roles, sorted(exclude))


def forest_scores(df: DataFrame, roles: Roles, n_pred: int, group: int, n_folds: int,
                  candidates: list[dict] | None = None, by_segment: bool = True,
                  spread: bool = False, grid_fn=None) -> DataFrame:
    """(segment, predict_horizon, model, candidate, fold, n, mse, params) of a
    random search over forest parameters, scored on the expanding folds.

    ``grid_fn(frame, horizon)``: a project's own features for one horizon, a
    DataFrame in and out with the same rows. The forests of all segments, horizons,
    folds and candidates grow together (``plans.grove``).
    """
    from tidewise.operators import forest as fr
    from tidewise.plans.grove import grove_scores
    return grove_scores(df, roles, n_pred, group, n_folds, candidates or fr.sample_candidates(), by_segment,
                        spread, grid_fn)


def train(df: DataFrame, roles: Roles, n_pred: int, group: int, n_folds: int,
          baselines: tuple[str, ...] = ("Last",), with_forest: bool = True,
          candidates: list[dict] | None = None, project: str = "panel",
          by_segment: bool = True, spread: bool = False, grid_fn=None,
          models: list = ()) -> dict[str, DataFrame]:
    """Score every model, keep the best per (segment, horizon), summarize. ``models``:
    a project's own forecasters (``plans.custom``).

    Returns ``scores`` (per fold), ``cv_results`` (per candidate, with the
    candidate's own parameters), ``best_models`` and ``summary``.
    """
    group = check_grouping(n_pred, group)
    parts = []
    if baselines:
        b = baseline_scores(df, roles, n_pred, group, n_folds, baselines, by_segment, spread)
        parts.append(b.withColumn("params", F.lit("{}")))
    if with_forest:
        parts.append(forest_scores(df, roles, n_pred, group, n_folds, candidates, by_segment, spread, grid_fn))
    if models:
        from tidewise.plans.custom import forecaster_scores
        parts.append(forecaster_scores(df, roles, n_pred, group, n_folds, list(models), by_segment,
                                       spread, grid_fn))
    scores = parts[0]
    for p in parts[1:]:
        scores = scores.unionByName(p)
    results = cv_results(scores, n_folds)
    best = best_models(results, project)
    return {"scores": scores, "cv_results": results, "best_models": best,
            "summary": train_summary(best)}
