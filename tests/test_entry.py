import re

import __spark_entry__ as entry


def test_entry_smoke(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert df.columns == ["fold", "segment", "n", "mse"]
    assert len(rows) > 0


def test_every_query_is_registered_with_oracle_or_rows_only():
    qs, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(qs)
    rows_only = {q for q in set(qs) - set(sql) if q != "pipeline" and not re.match(r"op\d+_", q)}
    assert rows_only == {"forest_forecast", "forest_search", "backtest_forest"}


def test_small_queries_run(spark):
    qs = entry.queries()
    for name in ("base_table", "calendar_features", "cv_results", "union_predictions"):
        assert qs[name](spark, "/root/testdata/sf0.001").count() > 0
