import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidewise import Roles
from tidewise.operators.lags import horizon_grid
from tidewise.sources import sinks
from tidewise.sources.panel import PanelKeyError, load_base, validate_panel

ROLES = Roles(id="id", time="date", target="y")
SCHEMA = "id string, date timestamp_ntz, y double"


def test_key_checks(frame):
    t = dt.datetime(2020, 1, 1)
    validate_panel(frame([("a", t, 1.0), ("a", t + dt.timedelta(days=1), 2.0)], SCHEMA), ROLES)
    for rows in ([("a", t, 1.0), ("a", t, 2.0)], [(None, t, 1.0)], [("a", None, 1.0)]):
        with pytest.raises(PanelKeyError):
            validate_panel(frame(rows, SCHEMA), ROLES)


def test_csv_round_trip(frame, tmp_path):
    rows = [("a", dt.datetime(2020, 1, d), float(d)) for d in range(1, 6)]
    path = sinks.write_csv(frame(rows, SCHEMA), str(tmp_path / "abt"))
    back = load_base(_spark(frame), path, ROLES, "csv")
    assert dict(back.dtypes)["date"] == "timestamp_ntz" and dict(back.dtypes)["y"] == "double"
    assert sorted(tuple(r) for r in back.collect()) == sorted(rows)


def _spark(frame):
    from pyspark.sql import SparkSession
    return SparkSession.getActiveSession()


def test_grid_sink_partitions(frame, tmp_path):
    rows = [("a", dt.datetime(2020, 1, d), float(d)) for d in range(1, 9)]
    path = sinks.write_grid(horizon_grid(frame(rows, SCHEMA), ROLES, [1, 2]), str(tmp_path / "g"))
    spark = _spark(frame)
    one = spark.read.parquet(path).filter("predict_horizon = 2")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(predict_horizon" in plan
    assert one.count() == 8


def test_table_or_build(frame):
    spark = _spark(frame)
    calls = []

    def build():
        calls.append(1)
        return frame([("a", dt.datetime(2020, 1, 1), 1.0)], SCHEMA)

    spark.sql("drop table if exists tw_test_build")
    a = sinks.table_or_build(spark, "tw_test_build", build)
    b = sinks.table_or_build(spark, "tw_test_build", build)
    assert a.count() == b.count() == 1 and len(calls) == 1
    spark.sql("drop table if exists tw_test_build")


def test_versions_appear_whole_or_not_at_all(frame, tmp_path):
    from pyspark.sql import functions as F
    spark, root = _spark(frame), str(tmp_path / "table")
    with pytest.raises(LookupError):
        sinks.published(spark, root)
    first = sinks.publish_files(frame([("a", dt.datetime(2020, 1, 1), 1.0)], SCHEMA), root)
    broken = spark.range(1000).repartition(4).select(F.when(F.col("id") == 900, F.raise_error(F.lit("dies")))
                                                     .otherwise(F.lit("x")).alias("id"))
    with pytest.raises(Exception, match="dies"):
        sinks.publish_files(broken, root)
    # files without a manifest row, and a manifest folder without its row, are not seen
    (tmp_path / "table" / "data" / "half").mkdir()
    (tmp_path / "table" / "manifest" / "half" / "_temporary").mkdir(parents=True)
    assert sinks.published(spark, root).collect() == sinks.published(spark, root, first).collect()
    # a later version may have other columns
    sinks.publish_files(frame([(1, None)], "k int, v array<int>"), root)
    assert sinks.published(spark, root).dtypes == [("k", "int"), ("v", "array<int>")]
    assert sinks.published(spark, root, first).count() == 1


def test_raw_files_by_header_and_rejects(spark, tmp_path):
    from tidewise.sources import raw
    folder = tmp_path / "prices"
    folder.mkdir()
    (folder / "a.csv").write_text("store_id,item_id,wm_yr_wk,sell_price\n1,x,7,2.5\n\"2,b\",y,8,\n")
    (folder / "b.csv").write_text("\ufeffsell_price,more,item_id,wm_yr_wk,store_id\n3.5,?,z,9,3\n")
    (folder / "empty.csv").write_text("")
    good = [("1", "x", 7, 2.5), ("2,b", "y", 8, None), ("3", "z", 9, 3.5)]
    assert sorted(map(tuple, raw.load_prices(spark, str(folder)).collect())) == good
    assert raw.rejected(spark, str(folder), "prices").count() == 0
    (folder / "c.csv").write_text("item_id,store_id,sell_price,wm_yr_wk\nv,4,abc,9\nw,5,1.5,9\nu,6,1.0\nt,7,1.0,9,9\n")
    bad = {(r.file.rsplit("/", 1)[1], r.record) for r in raw.rejected(spark, str(folder), "prices").collect()}
    assert bad == {("c.csv", "v,4,abc,9"), ("c.csv", "u,6,1.0"), ("c.csv", "t,7,1.0,9,9")}
    assert sorted(map(tuple, raw.accepted_prices(spark, str(folder)).collect())) == [*good, ("5", "w", 9, 1.5)]
    with pytest.raises(Exception, match="does not fit"):
        raw.load_prices(spark, str(folder)).collect()
    with pytest.raises(Exception, match="does not fit"):  # also if its bad cells are not asked for
        raw.load_prices(spark, str(folder)).select("store_id").collect()
    (folder / "d.csv").write_text("item_id,store_id,wm_yr_wk\nv,4,9\n")
    with pytest.raises(ValueError, match="sell_price"):
        raw.load_prices(spark, str(folder))


def test_wide_files_with_other_days(spark, tmp_path):
    from tidewise.sources import raw
    keys = "id,item_id,dept_id,cat_id,store_id,state_id"
    (tmp_path / "a.csv").write_text(f"{keys},d_1,d_10\n1,i,d,c,s,CA,1,2\n")
    (tmp_path / "b.csv").write_text(f"d_2,{keys},d_1\n5,2,i,d,c,s,TX,6.5\n")
    got = raw.load_sales(spark, str(tmp_path))
    assert got.columns == [*keys.split(","), "d_1", "d_2", "d_10"]
    assert sorted(tuple(r)[5:] for r in got.collect()) == [("CA", 1.0, None, 2.0), ("TX", 6.5, 5.0, None)]


def test_folders_are_written_without_a_sort(spark, tmp_path, monkeypatch):
    from pyspark.sql import DataFrameWriter
    from tidewise.session import OPEN_FOLDERS, write_scratch
    name, seen, plain = "spark.sql.maxConcurrentOutputFileWriters", [], DataFrameWriter.parquet
    before = spark.conf.get(name)

    def parquet(self, *args, **kw):
        seen.append(spark.conf.get(name))
        return plain(self, *args, **kw)

    monkeypatch.setattr(DataFrameWriter, "parquet", parquet)
    df = spark.range(3000).select("id", (F.col("id") % 3).alias("predict_horizon"))
    many = df.withColumn("predict_horizon", F.col("id") % (3 * OPEN_FOLDERS))  # more than are open at once
    for rows in (df, many):
        sinks.write_grid(rows, str(tmp_path / "g"))
        assert spark.read.parquet(str(tmp_path / "g")).exceptAll(
            rows.withColumn("predict_horizon", F.col("predict_horizon").cast("int"))).isEmpty()
        assert write_scratch(rows, "folders", ["predict_horizon"]).count() == 3000
    assert seen == [str(OPEN_FOLDERS)] * 4 and spark.conf.get(name) == before
