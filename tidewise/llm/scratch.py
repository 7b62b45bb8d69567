"""Intermediate tables of the operators: Parquet in the shared folder that the
session names in ``spark.checkpoint.dir``. Reading a written table back cuts the
lineage, and the files survive the loss of any executor."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tidewise.session import write_scratch


def saved(df: DataFrame, name: str) -> DataFrame:
    return write_scratch(df, name)
