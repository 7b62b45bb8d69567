"""Scores: mean squared error per group, fold summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Digits of the scores in the registered queries; the library itself never
# rounds, as winners are picked on raw scores.
SCORE_DIGITS = 6


def sq_err(prediction: Column, truth: Column) -> Column:
    d = prediction - truth
    return d * d


def mse(df: DataFrame, keys: list[str], prediction: str = "prediction",
        truth: str = "y") -> DataFrame:
    """(keys..., n, mse) with the reference's rule that a missing prediction or
    a missing truth is an error, not a skipped row (``avg`` alone would skip)."""
    p, y = F.col(prediction), F.col(truth)
    agg = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(sq_err(p, y)).alias("_mse"),
        F.count_if(p.isNull() | y.isNull()).alias("_missing"),
    )
    return agg.select(*keys, "n", guard_missing(F.col("_missing"), F.col("_mse")).alias("mse"))


def guard_missing(missing: Column, value: Column) -> Column:
    return F.when(missing > 0, F.raise_error(F.concat(
        F.lit("mean squared error over missing values: "), missing.cast("string"),
        F.lit(" rows without prediction or truth")))).otherwise(value)


def round_score(c: Column) -> Column:
    return F.round(c, SCORE_DIGITS)


def fold_summary(scores: DataFrame, keys: list[str], n_folds: int,
                 score: str = "mse") -> DataFrame:
    """Per candidate: mean and population std of fold scores, plus one column
    per fold (``split{k}_test_score``)."""
    s = F.col(score)
    splits = [F.max(F.when(F.col("fold") == k, s)).alias(f"split{k}_test_score")
              for k in range(n_folds)]
    more = [F.first("params").alias("params")] if "params" in scores.columns else []
    return scores.groupBy(*keys).agg(
        F.avg(s).alias("average_mse"), F.stddev_pop(s).alias("std_mse"), *splits, *more)


def rounded(df: DataFrame) -> DataFrame:
    """Score columns (``*mse``, ``*score``) rounded for a report."""
    return df.withColumns({c: round_score(F.col(c)) for c in df.columns
                           if c.endswith(("mse", "_score"))})


def score_predictions(predictions: DataFrame, truth: DataFrame, keys: list[str],
                      truth_col: str = "y", by: list[str] | tuple = ()) -> DataFrame:
    """(by..., n, mse) of a prediction table against a truth table: a left join on
    ``keys`` (id and time); a prediction without truth, or no prediction, is an error."""
    t = truth.select(*keys, F.col(truth_col).alias("truth"))
    return mse(predictions.drop("truth").join(t, list(keys), "left"), list(by), truth="truth")
