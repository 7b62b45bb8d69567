"""Plan properties of registered queries: built-in expressions only, pruned
scans, pushed filters."""

import re

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def _plan(spark, name):
    df = entry.queries()[name](spark, SF)
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_python_in_relational_queries(spark):
    for name in ("backtest_last", "cv_results", "base_table", "calendar_features",
                 "impute_categorical", "lag_feature", "time_group_bounds_month"):
        plan = _plan(spark, name)
        assert not re.search(r"BatchEvalPython|ArrowEvalPython|PythonUDF", plan), name


def test_scans_read_only_needed_columns(spark):
    plan = _plan(spark, "calendar_features")
    schemas = re.findall(r"ReadSchema: (struct<[^>]*>)", plan)
    assert schemas and all(s == "struct<event_id:bigint,ts:timestamp_ntz>" for s in schemas)
    plan = _plan(spark, "backtest_last")
    for s in re.findall(r"ReadSchema: (struct<[^>]*>)", plan):
        assert "l_orderkey" not in s and "l_extendedprice" not in s


def test_no_cross_joins(spark):
    for name in ("backtest_last", "fold_rows", "time_folds", "cv_results",
                 "union_predictions", "forest_forecast"):
        plan = _plan(spark, name)
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
