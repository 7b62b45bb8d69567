"""The base table: reshape, join, flag and calendar features in one lazy plan.

``read -> unpivot -> left join calendar -> left join prices -> drop -> flag ->
[sample] -> calendar features``. Spark decides the join strategies from the
dimension sizes at run time (adaptive execution); nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from tidewise.functions.calendar import BASE_FEATURES, add_time_features
from tidewise.operators import prepare as pp


def base_table(sales: DataFrame, cal: DataFrame, prices: DataFrame, time_col: str = "date",
               sample: dict | None = None) -> DataFrame:
    long = pp.wide_to_long(sales)
    joined = pp.join_prices(pp.join_calendar(long, pp.calendar_clean(cal)), prices)
    flagged = pp.conditional_flag(pp.drop_calendar_columns(joined))
    if sample is not None:
        flagged = pp.sample_filter(flagged, time_col=time_col, **sample)
    return add_time_features(flagged, time_col, BASE_FEATURES)
