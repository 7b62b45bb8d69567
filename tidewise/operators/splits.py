"""Train/test splits on time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _ts(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v).cast("timestamp_ntz")


def split_role(time_col: str, end_train, end_test) -> Column:
    """'train' for t <= end_train; 'test' for end_train < t <= end_test."""
    t = F.col(time_col)
    return (F.when(t <= _ts(end_train), F.lit("train"))
            .when(t <= _ts(end_test), F.lit("test")))


def time_split(df: DataFrame, time_col: str, end_train, end_test) -> tuple[DataFrame, DataFrame]:
    t = F.col(time_col)
    train = df.filter(t <= _ts(end_train))
    test = df.filter((t > _ts(end_train)) & (t <= _ts(end_test)))
    return train, test


def group_split_role(time_col: str, end_train, begin_test, end_test) -> Column:
    """'train' for t <= end_train; 'test' for begin_test <= t <= end_test
    (both closed). A time in both ranges counts as train."""
    t = F.col(time_col)
    return (F.when(t <= _ts(end_train), F.lit("train"))
            .when(t.between(_ts(begin_test), _ts(end_test)), F.lit("test")))


def time_group_split(df: DataFrame, time_col: str, end_train, begin_test,
                     end_test) -> tuple[DataFrame, DataFrame]:
    t = F.col(time_col)
    train = df.filter(t <= _ts(end_train))
    test = df.filter(t.between(_ts(begin_test), _ts(end_test)))
    return train, test


def with_role(df: DataFrame, role: Column) -> DataFrame:
    """Both sides of a split in one frame: rows in neither side are dropped."""
    return df.withColumn("role", role).filter(F.col("role").isNotNull())
