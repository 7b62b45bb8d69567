"""Expanding time folds as relations.

Fold k of K over the sorted distinct times t_0 < ... < t_{n-1} tests the N
times at positions [n-(K-k)N, n-(K-k)N+N) and trains on every earlier time. So
only the latest K*N+1 distinct times decide the folds: they are found with a
per-segment top-k (Spark applies the limit before the shuffle), never by
ordering the whole panel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewise.roles import Roles


def _fold_segment(roles: Roles, by_segment: bool) -> Column:
    return roles.segment_col() if by_segment else F.lit("all")


def latest_times(df: DataFrame, roles: Roles, count: int, by_segment: bool = False) -> DataFrame:
    """(fold_segment, times): the ``count`` latest distinct times, newest first."""
    dt = df.select(_fold_segment(roles, by_segment).alias("fold_segment"),
                   F.col(roles.time).alias("t")).distinct()
    if by_segment:
        # per-segment top-k: Spark keeps k rows per segment in each task
        # before the shuffle (partial WindowGroupLimit)
        w = Window.partitionBy("fold_segment").orderBy(F.desc("t"))
        top = dt.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= count)
    else:
        # one group: a global top-k (each task keeps its k newest times)
        top = dt.orderBy(F.desc("t")).limit(count)
    return top.groupBy("fold_segment").agg(
        F.sort_array(F.collect_list("t"), asc=False).alias("times"))


def _bound(times: Column, index: int) -> Column:
    return F.element_at(times, index + 1)


def fold_arrays(df: DataFrame, roles: Roles, n_folds: int, n_pred: int,
                by_segment: bool = False) -> DataFrame:
    """(fold_segment, end_train, test_start, end_test): arrays of length K.

    Raises at run time if a segment has no more than K*N distinct times, the
    case where the first fold would have no training time.
    """
    k, n = n_folds, n_pred
    need = k * n + 1
    lt = latest_times(df, roles, need, by_segment)
    times = F.col("times")
    short = F.size(times) < need
    err = F.raise_error(F.concat(
        F.lit(f"{k} folds of {n} times need more than {k * n} distinct times; segment "),
        F.col("fold_segment"), F.lit(" has "), F.size(times).cast("string")))

    def arr(idx_of_fold):
        return F.when(short, err).otherwise(
            F.array(*[_bound(times, idx_of_fold(f)) for f in range(k)]))

    return lt.select(
        "fold_segment",
        arr(lambda f: (k - f) * n).alias("end_train"),
        arr(lambda f: (k - f) * n - 1).alias("test_start"),
        arr(lambda f: (k - f - 1) * n).alias("end_test"),
    )


def fold_bounds(df: DataFrame, roles: Roles, n_folds: int, n_pred: int,
                by_segment: bool = False) -> DataFrame:
    """(fold_segment, fold, end_train, test_start, end_test), K rows per segment."""
    fa = fold_arrays(df, roles, n_folds, n_pred, by_segment)
    z = F.arrays_zip(F.sequence(F.lit(0), F.lit(n_folds - 1)).alias("fold"),
                     F.col("end_train").alias("end_train"),
                     F.col("test_start").alias("test_start"),
                     F.col("end_test").alias("end_test"))
    return fa.select("fold_segment", F.inline(z)).withColumn(
        "fold", F.col("fold").cast("bigint"))


def _first_true(conds: list[Column]) -> Column:
    expr = None
    for i, c in enumerate(conds):
        expr = F.when(c, F.lit(i)) if expr is None else expr.when(c, F.lit(i))
    return expr.cast("bigint")


def roles_by_time(df: DataFrame, roles: Roles, n_folds: int, n_pred: int,
                  by_segment: bool = False) -> DataFrame:
    """(fold_segment, time, test_fold, train_from) for every distinct time.

    ``test_fold``: the fold whose test window holds the time (or null).
    ``train_from``: the first fold whose training set holds it; it is in the
    training set of every later fold too (or null: in no training set).
    The relation has one row per distinct (segment, time); joining it back on
    both keys spreads even a very large segment over many tasks.
    """
    fa = fold_arrays(df, roles, n_folds, n_pred, by_segment)
    dt = df.select(_fold_segment(roles, by_segment).alias("fold_segment"),
                   F.col(roles.time).alias(roles.time)).distinct()
    if by_segment:
        j = dt.join(fa, "fold_segment")  # equi-join on the segment
        bounds = {name: F.col(name) for name in ("end_train", "test_start", "end_test")}
    else:
        # one set of bounds for the whole panel: a scalar subquery (K-element
        # arrays), no join
        j = dt.withColumn("_b", fa.select(
            F.struct("end_train", "test_start", "end_test")).scalar())
        bounds = {name: F.col("_b").getField(name)
                  for name in ("end_train", "test_start", "end_test")}
    t = F.col(roles.time)

    def at(name, f):
        return F.element_at(bounds[name], f + 1)

    test_fold = _first_true([(t >= at("test_start", f)) & (t <= at("end_test", f))
                             for f in range(n_folds)])
    train_from = _first_true([t <= at("end_train", f) for f in range(n_folds)])
    return j.select("fold_segment", roles.time, test_fold.alias("test_fold"),
                    train_from.alias("train_from"))


def with_folds(df: DataFrame, roles: Roles, n_folds: int, n_pred: int,
               by_segment: bool = False, tags: DataFrame | None = None) -> DataFrame:
    """Attach ``test_fold`` and ``train_from`` to every panel row.

    ``tags``: a precomputed ``roles_by_time`` relation (e.g. materialized once
    when several plans read the same panel).
    """
    rt = tags if tags is not None else roles_by_time(df, roles, n_folds, n_pred, by_segment)
    keyed = df.withColumn("fold_segment", _fold_segment(roles, by_segment))
    return keyed.join(rt, ["fold_segment", roles.time]).drop("fold_segment")


def time_folds(df: DataFrame, roles: Roles, n_folds: int, n_pred: int,
               by_segment: bool = False) -> DataFrame:
    """(fold_segment, fold, time, role) for the distinct times of each fold."""
    rt = roles_by_time(df, roles, n_folds, n_pred, by_segment)
    folds = F.sequence(F.lit(0), F.lit(n_folds - 1))
    per_fold = rt.select(
        "fold_segment", roles.time, "test_fold", "train_from",
        F.explode(folds).alias("fold"))
    role = (F.when(F.col("test_fold") == F.col("fold"), F.lit("test"))
            .when(F.col("train_from") <= F.col("fold"), F.lit("train")))
    return per_fold.select(
        "fold_segment", F.col("fold").cast("bigint").alias("fold"), roles.time,
        role.alias("role")).filter(F.col("role").isNotNull())


def fold_rows(df: DataFrame, roles: Roles, n_folds: int, n_pred: int,
              by_segment: bool = False) -> DataFrame:
    """Panel rows of each fold's test set, with their fold."""
    return (with_folds(df, roles, n_folds, n_pred, by_segment)
            .filter(F.col("test_fold").isNotNull())
            .withColumnRenamed("test_fold", "fold")
            .drop("train_from"))
