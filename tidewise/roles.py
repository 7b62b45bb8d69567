"""Column roles of a panel: which column is the series id, the time, the target
and (optionally) the segment used to split model fitting."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Name of the segment column every segment-keyed output carries.
SEGMENT = "segment"
# Segment label used when no segment column is configured, and of rows without one.
ALL_SEGMENTS = "all"
NULL_SEGMENT = "(none)"
# Names of the columns that the plans add to a panel.
INTERNAL = frozenset(("segment", "fold", "fold_segment", "test_fold", "train_from", "tests",
                      "beyond", "predict_horizon", "last", "model", "prediction", "features"))


@dataclass(frozen=True)
class Roles:
    id: str = "id"
    time: str = "date"
    target: str = "y"
    segment: str | None = None

    @property
    def keys(self) -> list[str]:
        return [self.id, self.time]

    def segment_col(self) -> Column:
        """The segment as a string column: the literal "all" without a segment
        role, and a label of its own for rows whose segment is null."""
        if self.segment is None:
            return F.lit(ALL_SEGMENTS)
        return F.coalesce(F.col(self.segment).cast("string"), F.lit(NULL_SEGMENT))

    def series_partition(self) -> list[Column]:
        """Window partitioning for per-series work: the id alone, so a series
        that changes its segment keeps its history."""
        return [F.col(self.id)]

    def role_columns(self) -> list[str]:
        return [self.id, self.time, self.target]

    def with_segment(self, df: DataFrame) -> DataFrame:
        """The panel with the canonical ``segment`` column (string). A user's own
        column with the name of a column that the plans add is kept as ``own_<name>``."""
        return self.protected(df).withColumn(SEGMENT, self.segment_col())

    def protected(self, df: DataFrame) -> DataFrame:
        roles = set(self.role_columns())
        if clash := sorted(c for c in roles if c in INTERNAL or c.startswith("_")):
            raise ValueError(f"role columns must not be named {clash}")
        taken, names = set(df.columns), {}
        for c in df.columns:
            if c not in roles | {self.segment} and (c in INTERNAL or re.fullmatch(r"last_\d+", c)):
                new = f"own_{c}"
                while new in taken:
                    new = "own_" + new
                taken.add(new)
                names[c] = new
        return df.withColumnsRenamed(names)
