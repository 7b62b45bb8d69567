"""Sampling frequency of a panel from its smallest step between observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewise.roles import Roles

_US = 1
_MS = 1_000 * _US
_S = 1_000 * _MS
_MIN = 60 * _S
_H = 60 * _MIN
_D = 24 * _H

# Frequency labels and the smallest step (in microseconds) that
# earns each label, from the largest down. A missing, zero or negative step
# falls through to the default label.
FREQUENCY_LADDER = (
    ("year", 365 * _D),
    ("quarter", 90 * _D),
    ("month", 28 * _D),
    ("week", 7 * _D),
    ("day", _D),
    ("hour", _H),
    ("minute", _MIN),
    ("second", _S),
    ("millisecond", _MS),
    ("microsecond", _US),
)
DEFAULT_FREQUENCY = "nanosecond"


def step_micros(roles: Roles) -> Column:
    """Time since the previous observation of the same series, in microseconds."""
    w = Window.partitionBy(*roles.series_partition()).orderBy(F.col(roles.time))
    t = F.col(roles.time)
    return F.timestamp_diff("MICROSECOND", F.lag(t, 1).over(w), t)


def frequency_label(step: Column) -> Column:
    expr = None
    for label, threshold in FREQUENCY_LADDER:
        cond = step >= F.lit(threshold)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit(DEFAULT_FREQUENCY))


def _steps(df: DataFrame, roles: Roles, spread: bool) -> DataFrame:
    """The step before each row of a series (null for its first row)."""
    if not spread:
        return df.select(step_micros(roles).alias("step"))
    from tidewise.operators.lags import ranged_shift
    prev = ranged_shift(df, roles, {"_prev": 1}, roles.time)
    return prev.select(F.timestamp_diff("MICROSECOND", F.col("_prev"), F.col(roles.time)).alias("step"))


def step_histogram(df: DataFrame, roles: Roles, spread: bool = False) -> DataFrame:
    """(frequency, n): how many steps between neighbouring rows of a series have each label."""
    return (_steps(df, roles, spread).filter("step is not null")
            .groupBy(frequency_label(F.col("step")).alias("frequency")).agg(F.count("*").alias("n")))


def infer_unit(df: DataFrame, roles: Roles, spread: bool = False) -> str:
    """The most frequent step of a panel, the shorter one on ties: the unit of its horizons and
    offsets. One aggregate job; one row for each label reaches the driver."""
    order = [label for label, _ in FREQUENCY_LADDER] + [DEFAULT_FREQUENCY]
    found = {r["frequency"]: r["n"] for r in step_histogram(df, roles, spread).collect()}
    if not found:
        raise ValueError("no series has two rows: the step of the panel is not known")
    return max(found, key=lambda label: (found[label], order.index(label)))


def infer_frequency(df: DataFrame, roles: Roles, spread: bool = False) -> DataFrame:
    """One row: the minimum step over all series and its frequency label.

    ``spread``: find each row's previous time over range partitions, for
    panels where one series may be too large for one task.
    """
    steps = _steps(df, roles, spread)
    return steps.agg(F.min("step").alias("min_step_us")).select(
        "min_step_us", frequency_label(F.col("min_step_us")).alias("frequency"))
