"""tidewise: panel time-series forecasting expressed as Spark DataFrame plans.

Every public function takes DataFrames (plus plain parameters) and returns a
DataFrame, so a whole train or backtest run stays one set of lazy Spark plans
that Catalyst can prune, push down and re-plan at run time.
"""

from tidewise.roles import Roles

__all__ = ["Roles"]
