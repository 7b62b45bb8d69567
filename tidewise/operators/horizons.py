"""Forecast horizons and their time groups."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewise.roles import Roles


def check_grouping(n_pred: int, group: int) -> int:
    """Return the horizon group size; if it does not divide ``n_pred`` there is
    no time grouping and the group becomes ``n_pred`` (with a warning)."""
    if n_pred <= 0 or group <= 0:
        raise ValueError("number of predictions and group size must be positive")
    if n_pred % group != 0:
        warnings.warn(f"{n_pred} predictions are not a multiple of groups of {group}; "
                      f"using one group of {n_pred}", stacklevel=2)
        return n_pred
    return group


def horizon_list(n_pred: int, group: int) -> list[int]:
    """The last step of each group: ``[g, 2g, ..., N]``."""
    group = check_grouping(n_pred, group)
    return list(range(group, n_pred + 1, group))


def segment_horizons(df: DataFrame, roles: Roles, n_pred: int, group: int,
                     project: str = "panel") -> DataFrame:
    """One row per model to train: (segment, predict_horizon, model_key).

    The segments come from the data (a distinct aggregate); the horizons are a
    literal array exploded on each segment row, so nothing is joined.
    """
    hs = horizon_list(n_pred, group)
    segs = df.select(roles.segment_col().alias("segment")).distinct()
    out = segs.select(
        "segment",
        F.explode(F.array(*[F.lit(h).cast("bigint") for h in hs])).alias("predict_horizon"))
    return out.withColumn(
        "model_key", F.concat_ws("_", F.lit(project), "segment",
                                 F.col("predict_horizon").cast("string")))
