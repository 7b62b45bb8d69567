"""Calendar features of a timestamp column, as Spark column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the moon-phase rule: the epoch, the lunation count at the
# epoch and the lunations per day (phase 0 = new moon, 4 = full moon).
MOON_EPOCH = "2001-01-01 00:00:00"
MOON_LUNATIONS_AT_EPOCH = 0.20439731
MOON_LUNATIONS_PER_DAY = 0.03386319269

# Every feature this module knows, and the subset kept in a base table.
ALL_FEATURES = ("year", "quarter", "month", "week", "weekmonth", "dayofweek", "weekend",
                "day", "moon", "hour", "minute", "second", "microsecond", "nanosecond")
BASE_FEATURES = ("day", "weekend", "moon", "dayofweek", "week", "weekmonth", "month",
                 "quarter", "year")

_MICROS_PER_SECOND = 1_000_000


def _micros_since(epoch: str, t: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", F.lit(epoch).cast("timestamp_ntz"),
                           t.cast("timestamp_ntz"))


def moon_phase(t: Column) -> Column:
    """Moon phase 0-7 from whole seconds since the epoch (floor, also before it)."""
    seconds = F.floor(_micros_since(MOON_EPOCH, t) / F.lit(float(_MICROS_PER_SECOND)))
    lunations = F.lit(MOON_LUNATIONS_AT_EPOCH) + (
        seconds.cast("double") / F.lit(86400.0)) * F.lit(MOON_LUNATIONS_PER_DAY)
    # '%' keeps the dividend's sign, as the decimal rule does for dates before
    # the epoch; '& 7' then folds negative indexes into 0-7.
    return (F.floor((lunations % F.lit(1.0)) * F.lit(8.0) + F.lit(0.5))).bitwiseAND(F.lit(7))


def feature(name: str, t: Column) -> Column:
    """One calendar feature as a bigint column (null for a null time)."""
    if name == "year":
        c = F.year(t)
    elif name == "quarter":
        c = F.quarter(t)
    elif name == "month":
        c = F.month(t)
    elif name == "week":
        c = F.weekofyear(t)  # ISO-8601 week
    elif name == "weekmonth":
        c = F.ceil(F.dayofmonth(t) / F.lit(7.0))
    elif name == "dayofweek":
        c = F.weekday(t)  # Monday = 0
    elif name == "weekend":
        c = (F.weekday(t) >= 5).cast("int")
    elif name == "day":
        c = F.dayofmonth(t)
    elif name == "moon":
        c = moon_phase(t)
    elif name == "hour":
        c = F.hour(t)
    elif name == "minute":
        c = F.minute(t)
    elif name == "second":
        c = F.second(t)
    elif name == "microsecond":
        c = F.pmod(_micros_since("1970-01-01 00:00:00", t), F.lit(_MICROS_PER_SECOND))
    elif name == "nanosecond":
        # Spark keeps microseconds; the sub-microsecond part is always zero.
        c = F.when(t.isNotNull(), F.lit(0))
    else:
        raise ValueError(f"unknown calendar feature {name!r}")
    return c.cast("bigint")


def add_time_features(df: DataFrame, time_col: str,
                      features: tuple[str, ...] | list[str] = BASE_FEATURES) -> DataFrame:
    """Add calendar features computed on each row.

    A narrow projection: no join back from distinct times, no shuffle.
    """
    t = F.col(time_col)
    return df.withColumns({name: feature(name, t) for name in features})
