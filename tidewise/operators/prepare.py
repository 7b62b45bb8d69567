"""Building a base table from raw retail-style tables: calendar cleaning,
wide-to-long reshape, dimension joins, a state-dependent flag and sampling."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The calendar columns dropped once the joins are done, and the
# group columns of the wide sales table.
CALENDAR_DROP = ("d", "weekday", "year", "wm_yr_wk", "event_name_1", "event_name_2",
                 "event_type_1", "event_type_2")
SALES_KEYS = ("id", "item_id", "dept_id", "cat_id", "store_id", "state_id")
DAY_COLUMN = re.compile(r"d_\d+$")


def calendar_clean(cal: DataFrame, date_format: str = "yyyy-MM-dd") -> DataFrame:
    """Parse the date text; the day label stays whole."""
    return cal.withColumn("date", F.to_timestamp_ntz(F.col("date"), F.lit(date_format)))


def day_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if DAY_COLUMN.match(c)]


def wide_to_long(sales: DataFrame, keys: tuple[str, ...] | list[str] = SALES_KEYS,
                 var: str = "d", value: str = "Quantity") -> DataFrame:
    """One row per (series, day column); empty cells stay as null rows.

    ``unpivot`` is a narrow Expand: no shuffle, and it widens every day column
    to double so mixed int/float columns line up.
    """
    days = day_columns(sales)
    if not days:
        raise ValueError("no day columns (d_<n>) to unpivot")
    wide = sales.select(*keys, *[F.col(c).cast("double").alias(c) for c in days])
    return wide.unpivot(list(keys), days, var, value)


def join_calendar(long: DataFrame, cal: DataFrame, on: str = "d") -> DataFrame:
    """Left join the cleaned calendar. Calendar columns are taken by name, so a
    calendar column with a name already in the sales table cannot collide."""
    extra = [c for c in cal.columns if c != on and c not in long.columns]
    return long.join(cal.select(on, *extra), on, "left")


def join_prices(df: DataFrame, prices: DataFrame,
                keys: tuple[str, ...] = ("item_id", "store_id", "wm_yr_wk")) -> DataFrame:
    """Left join prices on (item, store, week); no match leaves a null price."""
    return df.join(prices.select(*keys, "sell_price"), list(keys), "left")


def drop_calendar_columns(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in CALENDAR_DROP if c in df.columns])


def conditional_flag(df: DataFrame, state_col: str = "state_id", name: str = "snap",
                     by_state: tuple[tuple[str, str], ...] = (("CA", "snap_CA"),
                                                             ("TX", "snap_TX")),
                     default: str = "snap_WI") -> DataFrame:
    """``snap`` = the flag of the row's state (the last one for other states);
    the per-state flags are then dropped."""
    s = F.col(state_col)
    expr = None
    for state, col in by_state:
        expr = (F.when(s == state, F.col(col)) if expr is None
                else expr.when(s == state, F.col(col)))
    expr = expr.otherwise(F.col(default))
    drop = [c for _, c in by_state] + [default]
    return df.withColumn(name, expr).drop(*drop)


def sample_filter(df: DataFrame, state: str, stores: list[str], dept: str, date_from: str,
                  date_to: str, items: list[str], time_col: str = "date") -> DataFrame:
    """Equality, membership and half-open date predicates; all are simple
    comparisons on stored columns, so they reach the Parquet scan."""
    t = F.col(time_col)
    return df.filter(
        (F.col("state_id") == state) & F.col("store_id").isin(stores)
        & (F.col("dept_id") == dept)
        & (t >= F.lit(date_from).cast("timestamp_ntz")) & (t < F.lit(date_to).cast("timestamp_ntz"))
        & F.col("item_id").isin(items))
