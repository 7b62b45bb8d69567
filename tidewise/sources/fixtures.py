"""Forecasting inputs derived from the driver's TPC-H-like tables.

Each builder is a lazy plan over the whole of ``lineitem`` (and ``part``), so
its work grows with the data. The shapes follow the reference's inputs: a long
panel, a wide sales table with one column per period, a calendar dimension and
a price dimension.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewise.roles import Roles
from tidewise.sources.tables import read_table

# Roles of the ``series`` panel.
SERIES_ROLES = Roles(id="id", time="date", target="y", segment="segment")

# Fixed values of the wide-sales fixture: one period column per ship year of
# lineitem (1995 is d_1), so every row is in the wide table.
FIRST_YEAR = 1995
WIDE_PERIODS = 7
N_STORES = 5
# Fixed values of the panel: every fifth supplier is counted as one (a series
# with a fifth of all rows); series are dealt to three segments.
HOT_EVERY = 5
N_SEGMENTS = 3


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily quantity per supplier, with gaps on days without shipments. The
    number of series and rows grows with the scale factor; one series is hot."""
    li = read_table(spark, sf_dir, "lineitem")
    k = F.col("l_suppkey")
    key = F.when(k % HOT_EVERY == 0, F.lit(0)).otherwise(k).cast("bigint")
    return (
        li.groupBy(F.concat(F.lit("s"), key.cast("string")).alias("id"),
                   F.concat(F.lit("g"), (key % N_SEGMENTS).cast("string")).alias("segment"),
                   F.col("l_shipdate").alias("date"))
        .agg(F.sum("l_quantity").alias("y"))
    )


def period_series(spark: SparkSession, sf_dir: str, period: str) -> DataFrame:
    """Quantity per supplier and calendar ``period`` (week, month, quarter), dated by its first day."""
    s = series(spark, sf_dir)
    start = F.date_trunc(period, F.col("date").cast("timestamp_ntz")).cast("timestamp_ntz")
    return s.groupBy("id", "segment", start.alias("date")).agg(F.sum("y").alias("y"))


def flag_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily quantity per (return flag, line status): 6 series, 3 segments. The
    forest queries fit on it: their cost is the fits, not the rows."""
    li = read_table(spark, sf_dir, "lineitem")
    return (
        li.groupBy(
            F.concat_ws("_", "l_returnflag", "l_linestatus").alias("id"),
            F.col("l_returnflag").alias("segment"),
            F.col("l_shipdate").alias("date"),
        )
        .agg(F.sum("l_quantity").alias("y"))
    )


def _brand_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    # part is a dimension of lineitem; Spark/AQE pick the join strategy from
    # its size at run time, no hint needed.
    return (
        li.join(part, li.l_partkey == part.p_partkey)
        .withColumn("store_id", (F.col("l_suppkey") % N_STORES).cast("string"))
        .withColumn("item_id", F.col("p_brand"))
    )


def _brand_number() -> F.Column:
    return F.expr("cast(substr(p_brand, 7) as int)")


def sales_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (brand, store), one quantity column per ship year."""
    bs = _brand_store(spark, sf_dir)
    year = F.year("l_shipdate")
    periods = [
        F.sum(F.when(year == FIRST_YEAR + i, F.col("l_quantity"))).alias(f"d_{i + 1}")
        for i in range(WIDE_PERIODS)
    ]
    store = F.col("store_id")
    return (
        bs.groupBy(
            F.concat_ws("_", "item_id", "store_id").alias("id"),
            "item_id",
            F.concat(F.lit("DEPT_"), (_brand_number() % 3).cast("string")).alias("dept_id"),
            F.concat(F.lit("CAT_"), (_brand_number() % 2).cast("string")).alias("cat_id"),
            "store_id",
            F.when(store.isin("0", "1"), "CA").when(store.isin("2", "3"), "TX")
            .otherwise("WI").alias("state_id"),
        )
        .agg(*periods)
    )


def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw calendar rows (date as text) for all ship years present."""
    li = read_table(spark, sf_dir, "lineitem")
    years = li.select(F.year("l_shipdate").alias("year")).distinct()
    return years.select(
        F.concat(F.lit("d_"), (F.col("year") - FIRST_YEAR + 1).cast("string")).alias("d"),
        F.concat(F.col("year").cast("string"), F.lit("-01-01")).alias("date"),
        F.col("year").cast("bigint").alias("wm_yr_wk"),
        F.col("year").cast("bigint").alias("year"),
        (F.col("year") == FIRST_YEAR).cast("int").alias("snap_CA"),
        (F.col("year") == FIRST_YEAR + 1).cast("int").alias("snap_TX"),
        (F.col("year") == FIRST_YEAR + 2).cast("int").alias("snap_WI"),
    )


def sell_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Highest extended price per (brand, store, ship year)."""
    bs = _brand_store(spark, sf_dir)
    return bs.groupBy(
        "item_id", "store_id", F.year("l_shipdate").cast("bigint").alias("wm_yr_wk")
    ).agg(F.max("l_extendedprice").alias("sell_price"))
