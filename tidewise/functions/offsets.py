"""Calendar offsets: n forecast steps as a time interval."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_UNITS = {"week": ("days", 7), "day": ("days", 1), "hour": ("hours", 1),
          "minute": ("mins", 1), "second": ("secs", 1)}
_MONTHS = {"year": 12, "quarter": 3, "month": 1}


def offset(n, unit: str = "day") -> Column:
    """``n`` steps of ``unit`` as an interval (of months for month, quarter and year, else
    of days and time); ``n`` may be a column."""
    n = n if isinstance(n, Column) else F.lit(int(n))
    if unit in _MONTHS:
        return F.make_ym_interval(F.lit(0), (n * F.lit(_MONTHS[unit])).cast("int"))
    if unit not in _UNITS:
        raise ValueError(f"unsupported offset unit {unit!r}")
    field, mult = _UNITS[unit]
    return F.make_dt_interval(**{field: n * F.lit(mult)})


def shift_time(t: Column, n, unit: str = "day") -> Column:
    """``t + n steps``; defaults to days as the reference's offset does."""
    return t + offset(n, unit)


UNITS = (*_MONTHS, *_UNITS)


def offset_function(unit):
    """A function of a time and a number of steps that gives the time so many steps on: of a
    unit's name, or a project's own function of two columns, which is returned as it is."""
    if callable(unit):
        return unit
    if unit not in UNITS:
        raise ValueError(f"unsupported offset unit {unit!r}")
    return lambda t, n: shift_time(t, n, unit)
