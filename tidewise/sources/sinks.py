"""Sinks and build-if-absent tables."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidewise.session import write_folders

MANIFEST_SCHEMA = "version string, committed_at timestamp, content string"


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None,
                  mode: str = "overwrite") -> str:
    if partition_by:
        write_folders(df, path, partition_by, mode)
    else:
        df.write.mode(mode).parquet(path)
    return path


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """CSV with a header and no index column (the reference's base file)."""
    df.write.mode(mode).option("header", True).csv(path)
    return path


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    df.write.mode(mode).json(path)
    return path


def write_grid(grid: DataFrame, path: str, mode: str = "overwrite") -> str:
    """All horizons of a lag grid in one dataset, one folder per horizon, so a
    reader filtering on ``predict_horizon`` only lists that folder."""
    return write_parquet(grid, path, partition_by=["predict_horizon"], mode=mode)


def publish(df: DataFrame, name: str, mode: str = "overwrite") -> DataFrame:
    """Store a result as a catalog table and return a scan of it."""
    df.write.mode(mode).saveAsTable(name)
    return df.sparkSession.table(name)


def table_or_build(spark: SparkSession, name: str,
                   build: Callable[[], DataFrame]) -> DataFrame:
    """Return table ``name`` if the catalog has it, else build and store it."""
    if spark.catalog.tableExists(name):
        return spark.table(name)
    return publish(build(), name)


# --------------------------------------------------------------------------
# Versions that appear whole or not at all
# --------------------------------------------------------------------------
def commit(spark: SparkSession, root: str, version: str, content: str) -> None:
    """Makes a version visible: one manifest row in a folder of its own, so that no two
    writers share a folder, moved into place by the writer's last step."""
    row = spark.range(1).coalesce(1).select(F.lit(version).alias("version"), F.current_timestamp().alias("committed_at"),
                                            F.lit(content).alias("content"))
    row.write.mode("error").parquet(f"{root.rstrip('/')}/manifest/{version}")


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """The committed versions of a folder; none if there is no folder."""
    try:
        return spark.read.schema(MANIFEST_SCHEMA).parquet(f"{root.rstrip('/')}/manifest/*")
    except AnalysisException:  # the path does not exist yet
        return spark.createDataFrame([], MANIFEST_SCHEMA)


def publish_files(df: DataFrame, root: str) -> str:
    """Writes a new version of a table below ``root`` and commits it; returns its name. Readers see
    the version before until then, and a writer that dies leaves files that no one reads."""
    version = uuid.uuid4().hex
    df.write.mode("error").parquet(f"{root.rstrip('/')}/data/{version}")
    commit(df.sparkSession, root, version, df.schema.json())
    return version


def published(spark: SparkSession, root: str, version: str | None = None) -> DataFrame:
    """A committed version of a table (the newest if none is given), with the schema it was written with."""
    known = manifest(spark, root)
    if version is not None:
        known = known.filter(F.col("version") == version)
    rows = known.orderBy(F.desc("committed_at"), "version").limit(1).collect()
    if not rows:
        raise LookupError(f"no committed version of {root}")
    schema = StructType.fromJson(json.loads(rows[0]["content"]))
    return spark.read.schema(schema).parquet(f"{root.rstrip('/')}/data/{rows[0]['version']}")
