"""Baseline forecasters: Last (the lag feature), Mean (per segment) and
MeanTS (per series), fitted for every fold at once.

A training set of fold k is every time up to end_train_k, so the training
sets are nested. Instead of copying rows once per fold, rows are tagged with
the first fold whose training set holds them (``train_from``), summed per
(key, train_from), and the few partial sums are accumulated across folds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewise.operators.lags import lag_name
from tidewise.roles import Roles

BASELINES = ("Last", "Mean", "MeanTS")


def last_prediction(horizon: int) -> Column:
    """Last forecaster: the horizon's lag, 0 when there is none."""
    return F.coalesce(F.col(lag_name(horizon)), F.lit(0.0))


def fold_means(folded: DataFrame, roles: Roles, keys: list[str], n_folds: int) -> DataFrame:
    """(keys..., fold, prediction): mean target over each fold's training rows.

    ``folded`` carries ``train_from``. Nulls in the target are skipped; a key
    with no training value gets a null mean.
    """
    y = F.col(roles.target)
    part = (folded.filter(F.col("train_from").isNotNull())
            .groupBy(*keys, "train_from")
            .agg(F.sum(y).alias("_s"), F.count(y).alias("_c")))
    per_fold = part.select(*keys, "_s", "_c", F.explode(
        F.sequence(F.col("train_from"), F.lit(n_folds - 1).cast("bigint"))).alias("fold"))
    return per_fold.groupBy(*keys, "fold").agg(
        F.try_divide(F.sum("_s"), F.sum("_c").cast("double")).alias("prediction"))


def mean_keys(model: str, roles: Roles) -> list[str]:
    if model == "Mean":
        return ["segment"]
    if model == "MeanTS":
        return ["segment", roles.id]
    raise ValueError(f"not a mean model: {model!r}")


def mean_predictions(test: DataFrame, folded: DataFrame, roles: Roles, model: str,
                     n_folds: int) -> DataFrame:
    """Attach a Mean / MeanTS prediction to test rows (``fold`` column).

    Left join: a series never seen in training keeps a null prediction, which
    scoring then reports as an error.
    """
    keys = mean_keys(model, roles)
    means = fold_means(folded, roles, keys, n_folds)
    return test.join(means, keys + ["fold"], "left")


def fold_mean_tables(folded: DataFrame, roles: Roles, models, n_folds: int) -> dict:
    """Fold means of every requested mean model from ONE aggregate.

    Per-series partial sums by (segment, id, first training fold) feed both
    MeanTS (per series) and Mean (summed per segment), so the training rows
    are read once however many mean models are scored.
    """
    wanted = [m for m in models if m in ("Mean", "MeanTS")]
    if not wanted:
        return {}
    per_series = fold_means_parts(folded, roles, ["segment", roles.id], n_folds)
    out = {}
    if "MeanTS" in wanted:
        out["MeanTS"] = per_series.select(
            "segment", roles.id, "fold",
            F.try_divide(F.col("_s"), F.col("_c").cast("double")).alias("prediction"))
    if "Mean" in wanted:
        out["Mean"] = per_series.groupBy("segment", "fold").agg(
            F.try_divide(F.sum("_s"), F.sum("_c").cast("double")).alias("prediction"))
    return out


def fold_means_parts(folded: DataFrame, roles: Roles, keys: list[str], n_folds: int) -> DataFrame:
    """(keys..., fold, _s, _c): target sum and count over each fold's training rows."""
    y = F.col(roles.target)
    part = (folded.filter(F.col("train_from").isNotNull())
            .groupBy(*keys, "train_from")
            .agg(F.sum(y).alias("_s"), F.count(y).alias("_c")))
    per_fold = part.select(*keys, "_s", "_c", F.explode(
        F.sequence(F.col("train_from"), F.lit(n_folds - 1).cast("bigint"))).alias("fold"))
    return per_fold.groupBy(*keys, "fold").agg(F.sum("_s").alias("_s"), F.sum("_c").alias("_c"))
