"""Loading the raw retail tables (wide sales, prices, calendar) from CSV files.

Files of one table may differ in the order of their columns, and wide files in their day
columns: each file is read by its own header. Files with the same header are read
together, so a plan has one scan for each kind of header. Types are declared, nothing
is inferred. A record that does not fit (a cell that is no number, too few or too many
cells) raises when it is read; ``rejected`` lists such records instead.
"""

from __future__ import annotations

import csv
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewise.operators.prepare import DAY_COLUMN, SALES_KEYS
from tidewise.plans.base_table import base_table

# The columns of the price and calendar files.
PRICES = T.StructType([
    T.StructField("store_id", T.StringType()), T.StructField("item_id", T.StringType()),
    T.StructField("wm_yr_wk", T.LongType()), T.StructField("sell_price", T.DoubleType())])
CALENDAR_TYPES = {"wm_yr_wk": T.LongType(), "wday": T.IntegerType(), "month": T.IntegerType(),
                  "year": T.LongType(), "snap_CA": T.IntegerType(), "snap_TX": T.IntegerType(),
                  "snap_WI": T.IntegerType()}
BAD = "_bad_record"
SOURCE = "_source_file"


def file_headers(spark: SparkSession, path: str) -> dict[tuple[str, ...], list[str]]:
    """Header -> the files that have it. Headers are the first lines of the files; one row for
    each file reaches the driver, as its name does for any reader. Empty files have none."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"),
                                         F.col("_metadata.file_block_start").alias("start"))
    # the part of a file that begins at 0 is read by one task, in the file's order
    first = lines.filter("start = 0").groupBy("file").agg(F.first("value").alias("header"))
    out: dict[tuple[str, ...], list[str]] = {}
    for r in sorted(first.collect()):
        names = next(csv.reader([r["header"].lstrip("﻿")]), [])
        if len(set(names)) < len(names):
            raise ValueError(f"{r['file']} names a column twice: {names}")
        out.setdefault(tuple(names), []).append(r["file"])
    return out


def _read(spark: SparkSession, path: str, type_of, wanted: list[str] | None = None) -> DataFrame:
    """All files of a path by their own headers, with the record that did not fit, if any, and
    its file. ``type_of(name)``: a column's type; ``wanted``: columns that every file must have."""
    headers = file_headers(spark, path)
    if not headers:
        raise ValueError(f"no header in {path}")
    parts = []
    for names, files in headers.items():
        if missing := [c for c in wanted or [] if c not in names]:
            raise ValueError(f"{files[0]} has no columns {missing}")
        schema = T.StructType([T.StructField(c, type_of(c)) for c in names] + [T.StructField(BAD, T.StringType())])
        df = (spark.read.schema(schema).option("header", True).option("enforceSchema", False)
              .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BAD).option("columnPruning", False)
              .csv(files))
        parts.append(df.withColumn(SOURCE, F.col("_metadata.file_path")))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in (BAD, SOURCE)]


def _is_sound(df: DataFrame):
    """Whether a record fits. Spark converts only the cells that a query uses, so all are used here:
    a number of set bits is never negative."""
    return F.col(BAD).isNull() & (F.bit_count(F.xxhash64(*_columns(df))) >= 0)


def _sound(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns; a record that did not fit raises."""
    error = F.raise_error(F.concat(F.lit("record does not fit: "), F.col(BAD), F.lit(" in "), F.col(SOURCE)))
    kind = df.select(F.struct(*columns)).schema[0].dataType
    return df.select(F.when(_is_sound(df), F.struct(*columns)).otherwise(error.cast(kind)).alias("row")).select("row.*")


def _sales(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, lambda c: T.DoubleType() if DAY_COLUMN.match(c) else T.StringType(), list(SALES_KEYS))


def _prices(spark: SparkSession, path: str) -> DataFrame:
    types = {f.name: f.dataType for f in PRICES.fields}
    return _read(spark, path, lambda c: types.get(c, T.StringType()), PRICES.names)


def _calendar(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, lambda c: CALENDAR_TYPES.get(c, T.StringType()))


def load_sales(spark: SparkSession, path: str) -> DataFrame:
    """The wide sales table: keys as text, one double column per day (``d_<n>``). A day that
    a file does not have is null in its rows."""
    df = _sales(spark, path)
    days = sorted((c for c in _columns(df) if DAY_COLUMN.match(c)), key=lambda c: int(c[2:]))
    return _sound(df, [c for c in _columns(df) if c not in days] + days)


def load_prices(spark: SparkSession, path: str) -> DataFrame:
    return _sound(_prices(spark, path), PRICES.names)


def load_calendar(spark: SparkSession, path: str) -> DataFrame:
    """Calendar rows; the date stays text until ``calendar_clean`` parses it."""
    df = _calendar(spark, path)
    return _sound(df, _columns(df))


def rejected(spark: SparkSession, path: str, table: str) -> DataFrame:
    """(file, record) of the records of a ``sales``, ``prices`` or ``calendar`` path that do not fit."""
    df = {"sales": _sales, "prices": _prices, "calendar": _calendar}[table](spark, path)
    return df.filter(~_is_sound(df)).select(F.col(SOURCE).alias("file"), F.col(BAD).alias("record"))


def accepted_prices(spark: SparkSession, path: str) -> DataFrame:
    """The price records that fit, without those that ``rejected`` lists."""
    df = _prices(spark, path)
    return df.filter(_is_sound(df)).select(*PRICES.names)


def base_table_from_files(spark: SparkSession, sales: str, calendar: str, prices: str,
                          sample: dict | None = None) -> DataFrame:
    """``base_table`` of three CSV paths."""
    return base_table(load_sales(spark, sales), load_calendar(spark, calendar),
                      load_prices(spark, prices), sample=sample)
