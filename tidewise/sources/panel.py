"""Loading a panel ("base") table and checking its keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StringType, StructType, TimestampType

from tidewise.roles import Roles


class PanelKeyError(ValueError):
    """Raised when (id, time) is not a unique, non-null key of a panel."""


def normalize_panel(df: DataFrame, roles: Roles) -> DataFrame:
    """Time to ``timestamp_ntz`` and target to double; other columns untouched."""
    dtype = df.schema[roles.time].dataType
    t = F.col(roles.time)
    if isinstance(dtype, StringType):
        t = F.to_timestamp_ntz(t)
    elif isinstance(dtype, (DateType, TimestampType)):
        t = t.cast("timestamp_ntz")
    return df.withColumns({roles.time: t, roles.target: F.col(roles.target).cast("double")})


def load_base(spark: SparkSession, path: str, roles: Roles, fmt: str = "parquet",
              schema: StructType | str | None = None) -> DataFrame:
    """Read a base table (CSV with header, or Parquet) and normalize its roles.

    Give ``schema`` for CSV at scale: without it Spark infers the types, which
    costs a full extra pass over the files.
    """
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True)
        if schema is None:
            reader = reader.option("inferSchema", True)
        df = reader.csv(path)
    elif fmt == "parquet":
        df = reader.parquet(path)
    else:
        raise ValueError(f"unsupported format {fmt!r}")
    return normalize_panel(df, roles)


def key_violations(df: DataFrame, roles: Roles) -> DataFrame:
    """Keys that break the panel contract: null id, null time, or a repeated
    (id, time). A distributed aggregate; partial counts combine map-side."""
    idc, tc = F.col(roles.id), F.col(roles.time)
    return (
        df.groupBy(idc, tc)
        .agg(F.count(F.lit(1)).alias("rows"))
        .filter(idc.isNull() | tc.isNull() | (F.col("rows") > 1))
    )


def validate_panel(df: DataFrame, roles: Roles) -> DataFrame:
    """Raise ``PanelKeyError`` if the panel has a null or repeated key.

    Runs one aggregate job and brings back at most one offending key.
    """
    bad = key_violations(df, roles).limit(1).collect()
    if bad:
        r = bad[0]
        raise PanelKeyError(
            f"panel key violated at {roles.id}={r[0]!r}, {roles.time}={r[1]!r} "
            f"({r[2]} rows); ids and times must be non-null and unique together")
    return df
