"""Registered queries over the driver's tables, and their DuckDB oracles.

Every query reads whole tables (through the fixtures in
``tidewise.sources.fixtures``) and returns a DataFrame. Parameters are those of
the reference's documented example run: 28 predictions in groups of 7 (four
horizons), 3 folds, segment = return flag.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewise.functions.calendar import ALL_FEATURES, add_time_features
from tidewise.functions.frequency import infer_frequency, step_histogram
from tidewise.functions.offsets import shift_time
from tidewise.operators import folds as fo
from tidewise.operators import foldstats as fs
from tidewise.operators import forest as fr
from tidewise.operators import prepare as pp
from tidewise.operators import profile as pf
from tidewise.operators.horizons import horizon_list, segment_horizons
from tidewise.operators.lags import add_lags, horizon_grid, lead_target
from tidewise.operators.metrics import round_score, rounded, score_predictions
from tidewise.operators.splits import group_split_role, split_role, with_role
from tidewise.plans import backtest as bt
from tidewise.plans import runs
from tidewise.plans import tracking as tk
from tidewise.plans import train as tr
from tidewise.plans import grove as gv
from tidewise.plans.backtest import backtest_scores
from tidewise.plans.base_table import base_table
from tidewise.sources import fixtures as fx
from tidewise.sources import sinks
from tidewise.session import scratch_path, write_scratch
from tidewise.sources.panel import load_base, normalize_panel
from tidewise.sources.raw import accepted_prices, base_table_from_files, load_prices, rejected
from tidewise.sources.tables import read_table

# Fixed parameters of the registered queries.
PROJECT = "tpch"
N_PRED = 28
GROUP = 7
N_FOLDS = 3
HORIZONS = horizon_list(N_PRED, GROUP)
ROLES = fx.SERIES_ROLES
SPLIT_END_TRAIN = "1999-12-31 00:00:00"
SPLIT_END_TEST = "2000-03-31 00:00:00"
GROUP_BEGIN_TEST = "2000-01-08 00:00:00"
GROUP_END_TEST = "2000-01-14 00:00:00"
SEGMENT_VALUE = "g1"

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def _series(spark, sf_dir):
    return normalize_panel(fx.series(spark, sf_dir), ROLES)


def _flag_series(spark, sf_dir):
    return normalize_panel(fx.flag_series(spark, sf_dir), ROLES)


def _panel(spark, sf_dir):
    """The panel, built from the raw table once for a query that reads it often."""
    return write_scratch(_series(spark, sf_dir), "panel")


# --------------------------------------------------------------------------
# DuckDB building blocks
# --------------------------------------------------------------------------
SERIES_CTE = """series as (
  select 's' || cast(case when l_suppkey % 5 = 0 then 0 else l_suppkey end as varchar) as id,
         'g' || cast((case when l_suppkey % 5 = 0 then 0 else l_suppkey end) % 3 as varchar) as segment,
         l_shipdate as date, sum(l_quantity) as y
  from lineitem group by 1, 2, 3)"""

LAGS_CTE = SERIES_CTE + """,
lags as (
  select id, segment, date, y,
         lag(y, 7)  over (partition by id order by date) as last_7,
         lag(y, 14) over (partition by id order by date) as last_14,
         lag(y, 21) over (partition by id order by date) as last_21,
         lag(y, 28) over (partition by id order by date) as last_28
  from series)"""

# Whole-panel folds (backtest): fold k ends training at the time ranked
# (3-k)*28 from the end (rank 0 = newest), tests ranks (2-k)*28 .. (3-k)*28-1.
GLOBAL_FOLDS_CTE = """times as (
  select date, row_number() over (order by date desc) - 1 as r
  from (select distinct date from series)),
fold_ids as (select * from (values (0), (1), (2)) as v(fold)),
gfolds as (
  select f.fold,
         max(case when t.r = (3 - f.fold) * 28 then t.date end) as end_train,
         max(case when t.r = (3 - f.fold) * 28 - 1 then t.date end) as test_start,
         max(case when t.r = (2 - f.fold) * 28 then t.date end) as end_test
  from times t, fold_ids f group by f.fold)"""

# Per-segment folds (training): ranks of distinct times within each segment.
SEGMENT_ROLES_CTE = """stimes as (
  select segment, date, row_number() over (partition by segment order by date desc) as r
  from (select distinct segment, date from series)),
fold_ids as (select * from (values (0), (1), (2)) as v(fold)),
sroles as (
  select s.segment, s.date, f.fold,
         case when s.r between (2 - f.fold) * 28 + 1 and (3 - f.fold) * 28 then 'test'
              when s.r > (3 - f.fold) * 28 then 'train' end as role
  from stimes s, fold_ids f)"""

HORIZON_UNION = " union all ".join(
    f"select segment, fold, id, date, y, {h} as predict_horizon, coalesce(last_{h}, 0) "
    f"as prediction from cvtest" for h in HORIZONS)


# --------------------------------------------------------------------------
# Sources, projections, filters
# --------------------------------------------------------------------------
@register("load_base", f"with {SERIES_CTE} select id, segment, date, y from series")
def q_load_base(spark, sf_dir):
    """The panel written as a base file (CSV) and loaded from it."""
    path = sinks.write_csv(fx.series(spark, sf_dir).select("id", "segment", "date", "y"), scratch_path(spark, "base"))
    return load_base(spark, path, ROLES, "csv", "id string, segment string, date timestamp_ntz, y double")


@register("published_panel", f"with {SERIES_CTE} select id, segment, date, y from series")
def q_published_panel(spark, sf_dir):
    """The panel published as a committed version and read through its manifest."""
    root = scratch_path(spark, "published")
    sinks.publish_files(_series(spark, sf_dir).limit(0), root)  # a version before it, which is not read
    sinks.publish_files(_series(spark, sf_dir).select("id", "segment", "date", "y"), root)
    return sinks.published(spark, root)


@register("segments", f"with {SERIES_CTE} select distinct segment from series")
def q_segments(spark, sf_dir):
    return _series(spark, sf_dir).select(ROLES.segment_col().alias("segment")).distinct()


@register("segment_filter", f"with {SERIES_CTE} select id, segment, date, y from series "
          f"where segment = '{SEGMENT_VALUE}'")
def q_segment_filter(spark, sf_dir):
    return _series(spark, sf_dir).filter(F.col("segment") == SEGMENT_VALUE)


@register("time_split", f"""with {SERIES_CTE}
select id, segment, date, y,
       case when date <= timestamp '{SPLIT_END_TRAIN}' then 'train' else 'test' end as role
from series where date <= timestamp '{SPLIT_END_TEST}'""")
def q_time_split(spark, sf_dir):
    s = _series(spark, sf_dir)
    return with_role(s, split_role("date", SPLIT_END_TRAIN, SPLIT_END_TEST))


@register("time_group_split", f"""with {SERIES_CTE}
select id, segment, date, y,
       case when date <= timestamp '{SPLIT_END_TRAIN}' then 'train' else 'test' end as role
from series where date <= timestamp '{SPLIT_END_TRAIN}'
   or date between timestamp '{GROUP_BEGIN_TEST}' and timestamp '{GROUP_END_TEST}'""")
def q_time_group_split(spark, sf_dir):
    s = _series(spark, sf_dir)
    return with_role(s, group_split_role("date", SPLIT_END_TRAIN, GROUP_BEGIN_TEST,
                                         GROUP_END_TEST))


# --------------------------------------------------------------------------
# Scalar functions
# --------------------------------------------------------------------------
_MOON_SQL = ("cast(floor(((0.20439731::double + (floor(date_diff('microsecond', "
             "timestamp '2001-01-01', ts) / 1000000) / 86400.0::double) * "
             "0.03386319269::double) % 1) * 8 + 0.5) as bigint) & 7")


@register("calendar_features", f"""select event_id, year(ts) as year, quarter(ts) as quarter,
  month(ts) as month, weekofyear(ts) as week, cast(ceil(day(ts) / 7.0) as bigint) as weekmonth,
  isodow(ts) - 1 as dayofweek, cast(isodow(ts) >= 6 as bigint) as weekend, day(ts) as day,
  {_MOON_SQL} as moon, hour(ts) as hour, minute(ts) as minute, second(ts) as second,
  microsecond(ts) % 1000000 as microsecond, cast(0 as bigint) as nanosecond
from events""")
def q_calendar_features(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events").select("event_id", "ts")
    return add_time_features(ev, "ts", ALL_FEATURES).drop("ts")


@register("infer_frequency", f"""with {SERIES_CTE},
steps as (select date_diff('microsecond', lag(date) over (partition by id order by date),
                           date) as step from series),
m as (select min(step) as min_step_us from steps)
select min_step_us, case
  when min_step_us >= 31536000000000 then 'year' when min_step_us >= 7776000000000 then 'quarter'
  when min_step_us >= 2419200000000 then 'month' when min_step_us >= 604800000000 then 'week'
  when min_step_us >= 86400000000 then 'day' when min_step_us >= 3600000000 then 'hour'
  when min_step_us >= 60000000 then 'minute' when min_step_us >= 1000000 then 'second'
  when min_step_us >= 1000 then 'millisecond' when min_step_us >= 1 then 'microsecond'
  else 'nanosecond' end as frequency
from m""")
def q_infer_frequency(spark, sf_dir):
    return infer_frequency(_series(spark, sf_dir), ROLES)


# --------------------------------------------------------------------------
# Windows, horizons, grid
# --------------------------------------------------------------------------
@register("lag_feature", f"with {LAGS_CTE} select * from lags")
def q_lag_feature(spark, sf_dir):
    return add_lags(_series(spark, sf_dir), ROLES, HORIZONS)


@register("lag_feature_chunked", f"with {LAGS_CTE} select * from lags")
def q_lag_feature_chunked(spark, sf_dir):
    """The lags over range partitions, which a series may span."""
    return add_lags(_panel(spark, sf_dir), ROLES, HORIZONS, spread=True)


LEAD_SQL = f"""with {SERIES_CTE}
select id, segment, date, y, lead(y, 7) over (partition by id order by date) as target
from series"""


@register("lead_target_ranged", LEAD_SQL)
def q_lead_target_ranged(spark, sf_dir):
    return lead_target(_panel(spark, sf_dir), ROLES, GROUP, spread=True)


@register("lead_target", LEAD_SQL)
def q_lead_target(spark, sf_dir):
    return lead_target(_series(spark, sf_dir), ROLES, GROUP)


@register("horizons", f"""with {SERIES_CTE}
select segment, cast(h as bigint) as predict_horizon, '{PROJECT}_' || segment || '_' || cast(h as varchar)
       as model_key
from (select distinct segment from series), (values (7), (14), (21), (28)) as v(h)""")
def q_horizons(spark, sf_dir):
    return segment_horizons(_series(spark, sf_dir), ROLES, N_PRED, GROUP, PROJECT)


@register("horizon_grid", f"""with {LAGS_CTE}
select id, segment, date, y, cast(7 as bigint) as predict_horizon, last_7 as last from lags
union all
select id, segment, date, y, 14, last_14 from lags union all
select id, segment, date, y, 21, last_21 from lags union all
select id, segment, date, y, 28, last_28 from lags""")
def q_horizon_grid(spark, sf_dir):
    return horizon_grid(_series(spark, sf_dir), ROLES, HORIZONS)


@register("horizon_grid_sink", f"""with {LAGS_CTE}
select id, segment, date, y, cast(14 as bigint) as predict_horizon, last_14 as last from lags""")
def q_horizon_grid_sink(spark, sf_dir):
    """One horizon of the written grid: only its folder is read."""
    path = sinks.write_grid(horizon_grid(_series(spark, sf_dir), ROLES, HORIZONS), scratch_path(spark, "grid"))
    grid = spark.read.parquet(path).filter("predict_horizon = 14")
    return grid.withColumn("predict_horizon", F.col("predict_horizon").cast("bigint"))


# --------------------------------------------------------------------------
# Folds
# --------------------------------------------------------------------------
@register("fold_bounds", f"""with {SERIES_CTE}, {GLOBAL_FOLDS_CTE}
select cast(fold as bigint) as fold, end_train, test_start, end_test from gfolds""")
def q_fold_bounds(spark, sf_dir):
    return fo.fold_bounds(_series(spark, sf_dir), ROLES, N_FOLDS, N_PRED).drop("fold_segment")


@register("time_group_bounds", f"""with {SERIES_CTE}, {GLOBAL_FOLDS_CTE}
select cast(fold as bigint) as fold, cast(h as bigint) as predict_horizon,
       end_train + to_days(h - 6) as begin_test, end_train + to_days(h) as end_test
from gfolds, (values (7), (14), (21), (28)) as v(h)""")
def q_time_group_bounds(spark, sf_dir):
    return bt.time_group_bounds(_series(spark, sf_dir), ROLES, N_PRED, GROUP, N_FOLDS)


@register("time_folds", f"""with {SERIES_CTE}, {SEGMENT_ROLES_CTE}
select segment, cast(fold as bigint) as fold, date, role from sroles where role is not null""")
def q_time_folds(spark, sf_dir):
    return fo.time_folds(_series(spark, sf_dir), ROLES, N_FOLDS, N_PRED, by_segment=True) \
        .withColumnRenamed("fold_segment", "segment")


@register("fold_rows", f"""with {SERIES_CTE}, {GLOBAL_FOLDS_CTE}
select cast(f.fold as bigint) as fold, s.id, s.segment, s.date, s.y
from series s join gfolds f on s.date between f.test_start and f.end_test""")
def q_fold_rows(spark, sf_dir):
    return fo.fold_rows(_panel(spark, sf_dir), ROLES, N_FOLDS, N_PRED)


# --------------------------------------------------------------------------
# Baselines and training
# --------------------------------------------------------------------------
CV_CTE = f"""{LAGS_CTE}, {SEGMENT_ROLES_CTE},
cvtest as (select l.*, r.fold from lags l join sroles r using (segment, date)
           where r.role = 'test'),
cvtrain as (select s.*, r.fold from series s join sroles r using (segment, date)
            where r.role = 'train')"""


@register("last_forecast", f"""with {CV_CTE}
select segment, cast(predict_horizon as bigint) as predict_horizon, cast(fold as bigint) as fold,
       id, date, y, prediction from ({HORIZON_UNION})""")
def q_last_forecast(spark, sf_dir):
    return tr.last_cv_predictions(_panel(spark, sf_dir), ROLES, N_PRED, GROUP, N_FOLDS)


@register("mean_forecast", f"""with {CV_CTE},
means as (select segment, fold, avg(y) as m from cvtrain group by 1, 2)
select t.segment, cast(t.fold as bigint) as fold, t.id, t.date, t.y, round(m.m, 6) as prediction
from cvtest t left join means m using (segment, fold)""")
def q_mean_forecast(spark, sf_dir):
    p = tr.mean_cv_predictions(_panel(spark, sf_dir), ROLES, "Mean", N_FOLDS, N_PRED)
    return p.withColumn("prediction", round_score(F.col("prediction")))


@register("mean_ts_forecast", f"""with {CV_CTE},
means as (select segment, id, fold, avg(y) as m from cvtrain group by 1, 2, 3)
select t.segment, cast(t.fold as bigint) as fold, t.id, t.date, t.y, round(m.m, 6) as prediction
from cvtest t left join means m using (segment, id, fold)""")
def q_mean_ts_forecast(spark, sf_dir):
    p = tr.mean_cv_predictions(_panel(spark, sf_dir), ROLES, "MeanTS", N_FOLDS, N_PRED)
    return p.withColumn("prediction", round_score(F.col("prediction")))


SCORES_CTE = f"""{CV_CTE},
lastp as ({HORIZON_UNION}),
m1 as (select segment, fold, avg(y) as m from cvtrain group by 1, 2),
m2 as (select segment, id, fold, avg(y) as m from cvtrain group by 1, 2, 3),
meanp as (select t.segment, t.fold, t.y, m1.m as prediction
          from cvtest t left join m1 using (segment, fold)),
meantsp as (select t.segment, t.fold, t.y, m2.m as prediction
            from cvtest t left join m2 using (segment, id, fold)),
scores as (
  select segment, predict_horizon, 'Last' as model, fold, count(*) as n,
         avg((prediction - y) * (prediction - y)) as mse
  from lastp group by segment, predict_horizon, fold
  union all
  select segment, h, 'Mean', fold, count(*), avg((prediction - y) * (prediction - y))
  from meanp, (values (7), (14), (21), (28)) as v(h) group by segment, h, fold
  union all
  select segment, h, 'MeanTS', fold, count(*), avg((prediction - y) * (prediction - y))
  from meantsp, (values (7), (14), (21), (28)) as v(h) group by segment, h, fold),
results as (
  select segment, cast(predict_horizon as bigint) as predict_horizon, model,
         cast(0 as bigint) as candidate,
         avg(mse) as average_mse, stddev_pop(mse) as std_mse,
         max(case when fold = 0 then mse end) as split0_test_score,
         max(case when fold = 1 then mse end) as split1_test_score,
         max(case when fold = 2 then mse end) as split2_test_score
  from scores group by all),
best as (
  select * from (select *, row_number() over (partition by segment, predict_horizon
                                               order by average_mse, model, candidate) as rk
                 from results where average_mse is not null and not isnan(average_mse))
  where rk = 1)"""


def _baseline_scores(spark, sf_dir):
    return tr.baseline_scores(_panel(spark, sf_dir), ROLES, N_PRED, GROUP, N_FOLDS)


@register("mse_by_fold", f"""with {SCORES_CTE}
select segment, cast(predict_horizon as bigint) as predict_horizon, cast(fold as bigint) as fold,
       n, round(mse, 6) as mse from scores where model = 'Last'""")
def q_mse_by_fold(spark, sf_dir):
    s = tr.last_cv_scores(
        tr.cv_frame(_panel(spark, sf_dir).transform(ROLES.with_segment), ROLES, HORIZONS,
                    N_FOLDS, N_PRED), ROLES, HORIZONS)
    return s.withColumn("mse", round_score(F.col("mse")))


@register("cv_results", f"""with {SCORES_CTE}
select segment, predict_horizon, model, candidate, round(average_mse, 6) as average_mse,
       round(std_mse, 6) as std_mse, round(split0_test_score, 6) as split0_test_score,
       round(split1_test_score, 6) as split1_test_score,
       round(split2_test_score, 6) as split2_test_score from results""")
def q_cv_results(spark, sf_dir):
    return rounded(tr.cv_results(_baseline_scores(spark, sf_dir), N_FOLDS))


@register("best_models", f"""with {SCORES_CTE}
select segment, predict_horizon, model, candidate, round(average_mse, 6) as average_mse,
       '{PROJECT}_' || segment || '_' || cast(predict_horizon as varchar) as model_key from best""")
def q_best_models(spark, sf_dir):
    return rounded(tr.best_models(tr.cv_results(_baseline_scores(spark, sf_dir), N_FOLDS), PROJECT))


@register("train_best", f"""with {SCORES_CTE}
select count(*) as n_models, round(avg(average_mse), 6) as average_cv_mse from best""")
def q_train_best(spark, sf_dir):
    best = tr.best_models(tr.cv_results(_baseline_scores(spark, sf_dir), N_FOLDS), PROJECT)
    return rounded(tr.train_summary(best))


def _stored_run(spark, sf_dir):
    """A run of all baselines in a store of its own."""
    store = scratch_path(spark, "store")
    run_id = runs.train_run(_panel(spark, sf_dir), ROLES, store, N_PRED, GROUP, N_FOLDS,
                            baselines=("Last", "Mean", "MeanTS"), with_forest=False, project=PROJECT)
    return store, run_id


@register("stored_winners", f"""with {SCORES_CTE}
select segment, predict_horizon, model, round(average_mse, 6) as average_mse,
       '{PROJECT}_' || segment || '_' || cast(predict_horizon as varchar) as model_key from best""")
def q_stored_winners(spark, sf_dir):
    """Winners written to the run store and read back from its best run."""
    store, _ = _stored_run(spark, sf_dir)
    run = tk.best_run(spark, store)
    return rounded(tk.read_best(spark, store, run["run_id"])).drop("candidate", "params")


@register("stored_candidates", f"""with {SCORES_CTE}
select segment, predict_horizon, model, round(average_mse, 6) as average_mse, round(std_mse, 6) as std_mse,
       round(split2_test_score, 6) as split2_test_score, cast(predict_horizon as varchar) as horizon_tag from results""")
def q_stored_candidates(spark, sf_dir):
    """Candidate records of a stored run: metrics and tags."""
    got = tk.read_candidates(spark, *_stored_run(spark, sf_dir))
    return rounded(got.select("segment", "predict_horizon", "model", *(
        F.col("metrics")[m].alias(m) for m in ("average_mse", "std_mse", "split2_test_score")),
        F.col("tags")["prediction_horizon"].alias("horizon_tag")))


@register("stored_run", f"""with {SCORES_CTE}
select {N_PRED} as number_predictions, {GROUP} as n_predictions_groupby, {N_FOLDS} as n_folds,
       'segment' as column_segment_groupby, 'y' as target, round(avg(average_mse), 6) as average_cv_mse from best""")
def q_stored_run(spark, sf_dir):
    """The run's own record: settings and overall score."""
    store, _ = _stored_run(spark, sf_dir)
    return rounded(tk.read_runs(spark, store).select("number_predictions", "n_predictions_groupby", "n_folds",
                                                     "column_segment_groupby", "target", "average_cv_mse"))


# --------------------------------------------------------------------------
# Backtest
# --------------------------------------------------------------------------
BT_CTE = f"""{LAGS_CTE}, {GLOBAL_FOLDS_CTE},
bt as (
  select l.*, f.fold, h as predict_horizon,
         coalesce(case h when 7 then last_7 when 14 then last_14 when 21 then last_21
                  else last_28 end, 0) as last_pred
  from lags l, gfolds f, (values (7), (14), (21), (28)) as v(h)
  where l.date between f.end_train + to_days(h - 6) and f.end_train + to_days(h)),
bttrain as (select s.*, f.fold from series s, gfolds f where s.date <= f.end_train),
bm1 as (select segment, fold, avg(y) as m from bttrain group by 1, 2),
bm2 as (select segment, id, fold, avg(y) as m from bttrain group by 1, 2, 3),
btpred as (
  select 'Last' as model, fold, predict_horizon, segment, id, date, y, last_pred as prediction
  from bt
  union all
  select 'Mean', fold, predict_horizon, segment, id, date, y, bm1.m
  from bt left join bm1 using (segment, fold)
  union all
  select 'MeanTS', fold, predict_horizon, segment, id, date, y, bm2.m
  from bt left join bm2 using (segment, id, fold))"""


@register("backtest_last", f"""with {BT_CTE}
select cast(fold as bigint) as fold, segment, count(*) as n,
       round(avg((prediction - y) * (prediction - y)), 6) as mse
from btpred where model = 'Last' group by fold, segment""")
def q_backtest_last(spark, sf_dir):
    return rounded(bt.backtest_last(_panel(spark, sf_dir), ROLES, N_PRED, GROUP, N_FOLDS))


@register("union_predictions", f"""with {BT_CTE}
select model, cast(fold as bigint) as fold, cast(predict_horizon as bigint) as predict_horizon,
       segment, id, date, y, round(prediction, 6) as prediction from btpred""")
def q_union_predictions(spark, sf_dir):
    p = bt.backtest_predictions(_panel(spark, sf_dir), ROLES, N_PRED, GROUP, N_FOLDS,
                                ("Last", "Mean", "MeanTS"))
    return p.drop("beyond").withColumn("prediction", round_score(F.col("prediction")))


@register("backtest_scores", f"""with {BT_CTE}
select model, cast(fold as bigint) as fold, count(*) as n,
       round(avg((prediction - y) * (prediction - y)), 6) as mse
from btpred group by model, fold""")
def q_backtest_scores(spark, sf_dir):
    p = bt.backtest_predictions(_panel(spark, sf_dir), ROLES, N_PRED, GROUP, N_FOLDS,
                                ("Last", "Mean", "MeanTS"))
    return rounded(bt.backtest_scores(p, ["model", "fold"], ROLES))


@register("prediction_scores", f"""with {BT_CTE}
select cast(fold as bigint) as fold, cast(predict_horizon as bigint) as predict_horizon, count(*) as n,
       round(avg((prediction - y) * (prediction - y)), 6) as mse
from btpred where model = 'Last' group by fold, predict_horizon""")
def q_prediction_scores(spark, sf_dir):
    """A table of predictions scored against the panel as its truth."""
    panel = _panel(spark, sf_dir)
    preds = bt.backtest_predictions(panel, ROLES, N_PRED, GROUP, N_FOLDS, ("Last",)).select(
        "fold", "predict_horizon", "id", "date", "prediction")
    return rounded(score_predictions(preds, panel, ["id", "date"], "y", ["fold", "predict_horizon"]))


# --------------------------------------------------------------------------
# Panels by week, month and quarter: steps and offsets of the calendar
# --------------------------------------------------------------------------
def _period_panel(spark, sf_dir, period):
    return write_scratch(normalize_panel(fx.period_series(spark, sf_dir, period), ROLES), "panel")


def _month_end(t, n):
    """A project's own offset: n months on, to the last day of the month."""
    return F.last_day(shift_time(t, n - F.lit(1), "month")).cast("timestamp_ntz")


# period -> steps, group, unit as given, and the SQL of n steps after a time
PERIODS = {"week": (8, 4, "auto", "{t} + to_days(7 * ({n}))"), "month": (6, 3, "auto", "{t} + to_months({n})"),
           "quarter": (4, 2, "quarter", "{t} + to_months(3 * ({n}))")}


def _period_cte(period: str, n_pred: int, group: int, step: str) -> str:
    hs = horizon_list(n_pred, group)
    lags = ", ".join(f"lag(y, {h}) over (partition by id order by date) as last_{h}" for h in hs)
    last = " ".join(f"when {h} then last_{h}" for h in hs)
    begin, end = (step.format(t="f.end_train", n=n) for n in (f"h - {group - 1}", "h"))
    return f"""{SERIES_CTE}, pseries as (select id, segment, date_trunc('{period}', date)::timestamp as date, sum(y) as y
  from series group by all),
plags as (select id, segment, date, y, {lags} from pseries),
ptimes as (select date, row_number() over (order by date desc) - 1 as r from (select distinct date from pseries)),
fold_ids as (select * from (values (0), (1), (2)) as v(fold)),
pfolds as (select f.fold, max(case when t.r = (3 - f.fold) * {n_pred} then t.date end) as end_train
           from ptimes t, fold_ids f group by f.fold),
pbounds as (select fold, h, {begin} as begin_test, {end} as end_test
            from pfolds f, (values {", ".join(f"({h})" for h in hs)}) as v(h)),
pbt as (select l.*, b.fold, b.h as predict_horizon, coalesce(case h {last} end, 0) as prediction
        from plags l join pbounds b on l.date between b.begin_test and b.end_test)"""


def _register_period(period: str) -> None:
    n_pred, group, unit, step = PERIODS[period]
    cte = _period_cte(period, n_pred, group, step)

    @register(f"time_group_bounds_{period}", f"""with {cte} select cast(fold as bigint) as fold,
      cast(h as bigint) as predict_horizon, begin_test, end_test from pbounds""")
    def q_bounds(spark, sf_dir):
        return bt.time_group_bounds(_period_panel(spark, sf_dir, period), ROLES, n_pred, group, N_FOLDS, unit)

    @register(f"backtest_{period}", f"""with {cte} select cast(fold as bigint) as fold, segment, count(*) as n,
      round(avg((prediction - y) * (prediction - y)), 6) as mse from pbt group by all""")
    def q_backtest(spark, sf_dir):
        return rounded(bt.backtest_last(_period_panel(spark, sf_dir, period), ROLES, n_pred, group, N_FOLDS, unit))


for _period in PERIODS:
    _register_period(_period)


@register("backtest_own_offset", f"""with {_period_cte("month", 6, 3, "last_day({t} + to_months({n} - 1))::timestamp")}
select cast(fold as bigint) as fold, segment, count(*) as n, round(avg((prediction - y) * (prediction - y)), 6) as mse
from pbt group by all""")
def q_backtest_own_offset(spark, sf_dir):
    return rounded(bt.backtest_last(_period_panel(spark, sf_dir, "month"), ROLES, 6, 3, N_FOLDS, _month_end))


@register("step_histogram", f"""with {SERIES_CTE}, wseries as (select id, date_trunc('week', date)::timestamp as date
  from series group by all),
steps as (select date_diff('day', lag(date) over (partition by id order by date), date) as step from wseries)
select case when step >= 365 then 'year' when step >= 90 then 'quarter' when step >= 28 then 'month' else 'week' end
  as frequency, count(*) as n from steps where step is not null group by 1""")
def q_step_histogram(spark, sf_dir):
    return step_histogram(_period_panel(spark, sf_dir, "week"), ROLES)


# --------------------------------------------------------------------------
# Base table: reshape, joins, flag, sample
# --------------------------------------------------------------------------

# Fixed values of the sample: one state, two stores, one department, two ship
# years and ten items.
SAMPLE = {
    "state": "TX", "stores": ["2", "3"], "dept": "DEPT_1",
    "date_from": "1995-01-01 00:00:00", "date_to": "1997-01-01 00:00:00",
    "items": ["Brand#1", "Brand#4", "Brand#7", "Brand#10", "Brand#13", "Brand#16",
              "Brand#19", "Brand#22", "Brand#25", "Brand#2"],
}

RAW_CTE = """sales_wide as (
  select p_brand || '_' || cast(l_suppkey % 5 as varchar) as id, p_brand as item_id,
         'DEPT_' || cast(cast(substr(p_brand, 7) as integer) % 3 as varchar) as dept_id,
         'CAT_' || cast(cast(substr(p_brand, 7) as integer) % 2 as varchar) as cat_id,
         cast(l_suppkey % 5 as varchar) as store_id,
         case when l_suppkey % 5 in (0, 1) then 'CA' when l_suppkey % 5 in (2, 3) then 'TX'
              else 'WI' end as state_id,
         sum(case when year(l_shipdate) = 1995 then l_quantity end) as d_1,
         sum(case when year(l_shipdate) = 1996 then l_quantity end) as d_2,
         sum(case when year(l_shipdate) = 1997 then l_quantity end) as d_3,
         sum(case when year(l_shipdate) = 1998 then l_quantity end) as d_4,
         sum(case when year(l_shipdate) = 1999 then l_quantity end) as d_5,
         sum(case when year(l_shipdate) = 2000 then l_quantity end) as d_6,
         sum(case when year(l_shipdate) = 2001 then l_quantity end) as d_7
  from lineitem join part on l_partkey = p_partkey group by all),
raw_calendar as (
  select 'd_' || cast(y - 1994 as varchar) as d, cast(y as varchar) || '-01-01' as date,
         cast(y as bigint) as wm_yr_wk, cast(y as bigint) as year,
         cast(y = 1995 as integer) as snap_CA, cast(y = 1996 as integer) as snap_TX,
         cast(y = 1997 as integer) as snap_WI
  from (select distinct year(l_shipdate) as y from lineitem)),
sell_prices as (
  select p_brand as item_id, cast(l_suppkey % 5 as varchar) as store_id,
         cast(year(l_shipdate) as bigint) as wm_yr_wk, max(l_extendedprice) as sell_price
  from lineitem join part on l_partkey = p_partkey group by all),
calendar as (
  select d, cast(strptime(date, '%Y-%m-%d') as timestamp) as date,
         wm_yr_wk, year, snap_CA, snap_TX, snap_WI from raw_calendar),
long as (
  select id, item_id, dept_id, cat_id, store_id, state_id, 'd_1' as d, d_1 as Quantity
  from sales_wide union all
  select id, item_id, dept_id, cat_id, store_id, state_id, 'd_2', d_2 from sales_wide union all
  select id, item_id, dept_id, cat_id, store_id, state_id, 'd_3', d_3 from sales_wide union all
  select id, item_id, dept_id, cat_id, store_id, state_id, 'd_4', d_4 from sales_wide union all
  select id, item_id, dept_id, cat_id, store_id, state_id, 'd_5', d_5 from sales_wide union all
  select id, item_id, dept_id, cat_id, store_id, state_id, 'd_6', d_6 from sales_wide union all
  select id, item_id, dept_id, cat_id, store_id, state_id, 'd_7', d_7 from sales_wide),
with_cal as (
  select l.*, c.date, c.wm_yr_wk, c.year, c.snap_CA, c.snap_TX, c.snap_WI
  from long l left join calendar c on l.d = c.d),
with_price as (
  select w.*, p.sell_price from with_cal w
  left join sell_prices p on w.item_id = p.item_id and w.store_id = p.store_id
                         and w.wm_yr_wk = p.wm_yr_wk),
flagged as (
  select id, item_id, dept_id, cat_id, store_id, state_id, Quantity, date, sell_price,
         case when state_id = 'CA' then snap_CA when state_id = 'TX' then snap_TX
              else snap_WI end as snap
  from with_price)"""

_BASE_FEATURES_SQL = """day(date) as day, cast(isodow(date) >= 6 as bigint) as weekend,
  cast(floor(((0.20439731::double + (floor(date_diff('microsecond', timestamp '2001-01-01', date)
       / 1000000) / 86400.0::double) * 0.03386319269::double) % 1) * 8 + 0.5) as bigint) & 7
       as moon,
  isodow(date) - 1 as dayofweek, weekofyear(date) as week,
  cast(ceil(day(date) / 7.0) as bigint) as weekmonth, month(date) as month,
  quarter(date) as quarter, year(date) as year"""


def _raw(spark, sf_dir):
    return (fx.sales_wide(spark, sf_dir), fx.calendar(spark, sf_dir),
            fx.sell_prices(spark, sf_dir))


@register("calendar_clean", f"with {RAW_CTE} select * from calendar")
def q_calendar_clean(spark, sf_dir):
    return pp.calendar_clean(fx.calendar(spark, sf_dir))


@register("wide_to_long", f"with {RAW_CTE} select * from long")
def q_wide_to_long(spark, sf_dir):
    return pp.wide_to_long(fx.sales_wide(spark, sf_dir))


@register("join_calendar", f"with {RAW_CTE} select * from with_cal")
def q_join_calendar(spark, sf_dir):
    sales, cal, _ = _raw(spark, sf_dir)
    return pp.join_calendar(pp.wide_to_long(sales), pp.calendar_clean(cal))


@register("join_prices", f"with {RAW_CTE} select * from with_price")
def q_join_prices(spark, sf_dir):
    sales, cal, prices = _raw(spark, sf_dir)
    return pp.join_prices(pp.join_calendar(pp.wide_to_long(sales), pp.calendar_clean(cal)),
                          prices)


@register("conditional_flag", f"with {RAW_CTE} select * from flagged")
def q_conditional_flag(spark, sf_dir):
    sales, cal, prices = _raw(spark, sf_dir)
    j = pp.join_prices(pp.join_calendar(pp.wide_to_long(sales), pp.calendar_clean(cal)), prices)
    return pp.conditional_flag(pp.drop_calendar_columns(j))


@register("base_table", f"with {RAW_CTE} select *, {_BASE_FEATURES_SQL} from flagged")
def q_base_table(spark, sf_dir):
    return base_table(*_raw(spark, sf_dir))


_SAMPLE_ITEMS_SQL = ", ".join(f"'{i}'" for i in SAMPLE["items"])


@register("base_table_from_files", f"with {RAW_CTE} select *, {_BASE_FEATURES_SQL} from flagged")
def q_base_table_from_files(spark, sf_dir):
    """The raw tables written as CSV files and loaded with their declared schemas."""
    paths = []
    for name, df in zip(("sales", "calendar", "prices"), _raw(spark, sf_dir)):
        paths.append(scratch_path(spark, name))
        df.write.option("header", True).csv(paths[-1])
    return base_table_from_files(spark, *paths)


def _mixed_price_files(spark, sf_dir, bad: str | None = None) -> str:
    """Price files of two column orders in one folder; with ``bad``, a text in place of the prices of 1999."""
    path = scratch_path(spark, "prices")
    prices = fx.sell_prices(spark, sf_dir)
    if bad:
        prices = prices.withColumn("sell_price", F.when(F.col("wm_yr_wk") == 1999, bad).otherwise(
            F.col("sell_price").cast("string")))
    early = F.col("wm_yr_wk") <= 1997
    for part, columns in ((early, ["sell_price", "wm_yr_wk", "store_id", "item_id"]),
                          (~early, ["store_id", "item_id", "wm_yr_wk", "sell_price"])):
        prices.filter(part).select(*columns).write.option("header", True).mode("append").csv(path)
    return path


@register("prices_from_mixed_files", f"with {RAW_CTE} select store_id, item_id, wm_yr_wk, sell_price from sell_prices")
def q_prices_from_mixed_files(spark, sf_dir):
    """Files of one table with different column orders, each read by its own header."""
    return load_prices(spark, _mixed_price_files(spark, sf_dir))


@register("rejected_prices", f"""with {RAW_CTE}
select store_id || ',' || item_id || ',1999,n/a' as record, true as known_file from sell_prices where wm_yr_wk = 1999""")
def q_rejected_prices(spark, sf_dir):
    """Records whose price is no number."""
    path = _mixed_price_files(spark, sf_dir, "n/a")
    return rejected(spark, path, "prices").select("record", F.col("file").endswith(".csv").alias("known_file"))


@register("accepted_prices", f"""with {RAW_CTE}
select store_id, item_id, wm_yr_wk, sell_price from sell_prices where wm_yr_wk <> 1999""")
def q_accepted_prices(spark, sf_dir):
    """The records beside the rejected ones."""
    return accepted_prices(spark, _mixed_price_files(spark, sf_dir, "n/a"))


@register("sample_filter", f"""with {RAW_CTE}
select *, {_BASE_FEATURES_SQL} from flagged
where state_id = '{SAMPLE["state"]}' and store_id in ('2', '3') and dept_id = '{SAMPLE["dept"]}'
  and date >= timestamp '{SAMPLE["date_from"]}' and date < timestamp '{SAMPLE["date_to"]}'
  and item_id in ({_SAMPLE_ITEMS_SQL})""")
def q_sample_filter(spark, sf_dir):
    return base_table(*_raw(spark, sf_dir), sample=SAMPLE)


# --------------------------------------------------------------------------
# Column profiles and imputation values
# --------------------------------------------------------------------------

PROFILE_COLUMNS = ["id", "segment", "y", "year", "month", "day", "hour", "minute", "second",
                   "microsecond", "nanosecond"]


def _featured_series(spark, sf_dir):
    return add_time_features(_series(spark, sf_dir), "date", ALL_FEATURES)


def _profile_sql() -> str:
    parts = []
    for c in PROFILE_COLUMNS:
        parts.append(
            f"select '{c}' as column_name, count({c}) as n_values, "
            f"count({c}) < count(*) as has_null, "
            f"(count({c}) = 0 or (count({c}) = count(*) and min({c}) = max({c}))) as constant "
            f"from featured")
    feats = ", ".join([f"year(date) as year, month(date) as month, day(date) as day, "
                       f"hour(date) as hour, minute(date) as minute, second(date) as second, "
                       f"microsecond(date) % 1000000 as microsecond, "
                       f"cast(0 as bigint) as nanosecond"])
    return (f"with {SERIES_CTE}, featured as (select *, {feats} from series) "
            + " union all ".join(parts))


@register("constant_columns", _profile_sql())
def q_constant_columns(spark, sf_dir):
    return pf.constant_profile(_featured_series(spark, sf_dir), PROFILE_COLUMNS)


FEATURE_KINDS = {"segment": "categorical", "weekday": "categorical", **dict.fromkeys(
    ["year", "month", "day", "hour", "minute", "second", "microsecond", "nanosecond", "working"], "numeric")}


@register("feature_types", f"""with {SERIES_CTE}, featured as (select segment, dayname(date) as weekday, year(date) as year,
  month(date) as month, day(date) as day, hour(date) as hour, minute(date) as minute, second(date) as second,
  microsecond(date) % 1000000 as microsecond, 0 as nanosecond, isodow(date) < 6 as working from series)
""" + " union all ".join(f"select '{c}' as column_name, '{k}' as kind, count({c}) as n_values, "
                         f"count(distinct {c}) as n_distinct from featured" for c, k in FEATURE_KINDS.items()))
def q_feature_types(spark, sf_dir):
    """The features beside the roles, number or category, and how many values they have."""
    s = _featured_series(spark, sf_dir).withColumns({
        "weekday": F.date_format("date", "EEEE"), "working": F.weekday("date") < 5})
    s = s.drop(*[c for c in s.columns if c not in FEATURE_KINDS and c not in ROLES.role_columns()])
    nums, cats = pf.numeric_categorical(s, ROLES)
    kinds = {c: "numeric" for c in nums} | {c: "categorical" for c in cats}
    counts = s.agg(*[F.struct(F.lit(c).alias("column_name"), F.lit(k).alias("kind"), F.count(c).alias("n_values"),
                              F.count_distinct(c).alias("n_distinct")).alias(c) for c, k in kinds.items()])
    return counts.select(F.inline(F.array(*kinds)))


NUMERIC_IMPUTE = ["Quantity", "sell_price", "snap", "day", "week"]
CATEGORICAL_IMPUTE = ["item_id", "dept_id", "cat_id", "store_id", "state_id"]


@register("impute_numeric", f"""with {RAW_CTE}, b as (select *, {_BASE_FEATURES_SQL} from flagged)
""" + " union all ".join(
    f"select '{c}' as column_name, median(cast({c} as double)) as median from b"
    for c in NUMERIC_IMPUTE))
def q_impute_numeric(spark, sf_dir):
    return pf.column_medians(base_table(*_raw(spark, sf_dir)), NUMERIC_IMPUTE)


@register("impute_categorical", f"""with {RAW_CTE},
vals as ({" union all ".join(f"select '{c}' as column_name, {c} as value from flagged"
                             for c in CATEGORICAL_IMPUTE)}),
counted as (select column_name, value, count(*) as n from vals where value is not null
            group by all)
select column_name, value as mode from (
  select *, row_number() over (partition by column_name order by n desc, value) as rk
  from counted) where rk = 1""")
def q_impute_categorical(spark, sf_dir):
    return pf.column_modes(base_table(*_raw(spark, sf_dir)), CATEGORICAL_IMPUTE)


# --------------------------------------------------------------------------
# Random forest (forests have no SQL form: reports of them do)
# --------------------------------------------------------------------------

# The parameters of the queries without a search.
FOREST_PARAMS = {"n_trees": fr.N_TREES, "feature_subset": "all", "min_samples_split": 2,
                 "max_depth": 10}
LAST_FOLD = N_FOLDS - 1


def _forest_grid(spark, sf_dir, horizon: int):
    """Whole-panel folds, calendar features and one horizon's lag."""
    s = add_time_features(_flag_series(spark, sf_dir), "date")
    folded = tr.cv_frame(s, ROLES, HORIZONS, N_FOLDS, N_PRED, by_segment=False)
    return tr.horizon_frame(folded, HORIZONS, horizon)


FLAG_LAGS_CTE = LAGS_CTE.replace(
    SERIES_CTE, """series as (
  select l_returnflag || '_' || l_linestatus as id, l_returnflag as segment,
         l_shipdate as date, sum(l_quantity) as y
  from lineitem group by 1, 2, 3)""")
# Numeric features of the one-hot query, in no special order (the vector's values
# are reported by name).
ONEHOT_NUMBERS = ["last", "year", "month", "day", "quarter", "week"]


def _onehot_sql() -> str:
    numbers = " union all ".join(
        f"select id, date, '{c}' as feature, cast(coalesce({c}, (select median({c}) from fold_train)) as double) "
        f"as value from fold_test" for c in ONEHOT_NUMBERS)
    return f"""with {FLAG_LAGS_CTE}, {GLOBAL_FOLDS_CTE},
featured as (select id, segment, date, last_7 as last, year(date) as year, month(date) as month,
  day(date) as day, quarter(date) as quarter, weekofyear(date) as week from lags),
fold_train as (select f.* from featured f, gfolds g where g.fold = 2 and f.date <= g.end_train),
fold_test as (select f.* from featured f, gfolds g where g.fold = 2 and f.date between g.test_start and g.end_test),
categories as (select distinct segment from fold_train)
{numbers}
union all select t.id, t.date, 'segment=' || c.segment, cast(t.segment = c.segment as double)
from fold_test t, categories c"""


@register("onehot_features", _onehot_sql())
def q_onehot_features(spark, sf_dir):
    """The vectors of the last fold's test rows, as one row for each named feature."""
    from pyspark.ml.functions import vector_to_array
    grid = write_scratch(_forest_grid(spark, sf_dir, GROUP), "forest-grid")
    train = grid.filter(F.col("train_from") <= LAST_FOLD)
    pre = fr.fit_preprocessing(train, ROLES, ["segment", *ONEHOT_NUMBERS])
    test = pre.transform(grid.filter(F.col("test_fold") == LAST_FOLD))
    names = fr.feature_names(pre)
    values = vector_to_array("features")
    pairs = F.array(*[F.struct(F.lit(n).alias("feature"), values[i].alias("value"))
                      for i, n in enumerate(names)])
    return test.select("id", "date", F.inline(pairs))


def _featured_panel(spark, sf_dir):
    """The growing panel with its calendar features: all segments, all series."""
    return add_time_features(_panel(spark, sf_dir), "date")


def _model_rows(spark, sf_dir):
    """The training and test rows of every segment, horizon and fold."""
    frame = tr.cv_frame(_featured_panel(spark, sf_dir), ROLES, HORIZONS, N_FOLDS, N_PRED)
    rows, names = gv.model_rows(frame, ROLES, HORIZONS)
    return write_scratch(rows, "model-rows"), names[GROUP]


def _named(df, names):
    return df.withColumn("feature", F.element_at(F.array(*map(F.lit, names)), F.col("column") + 1)).drop("column")


_FOLD_NUMBERS = ["day", "weekend", "moon", "dayofweek", "week", "weekmonth", "month", "quarter", "year"]
FOLD_VALUES_CTE = f"""{CV_CTE}, cvlags as (select l.*, r.fold, {_BASE_FEATURES_SQL}
  from lags l join sroles r using (segment, date) where r.role = 'train'),
fold_values as ({" union all ".join(
    f"select segment, {h} as predict_horizon, fold, '{c}' as feature, cast({c if c != 'last' else f'last_{h}'} as double) "
    f"as value from cvlags" for h in HORIZONS for c in [*_FOLD_NUMBERS, "last"])})"""


@register("fold_medians", f"""with {FOLD_VALUES_CTE}
select segment, cast(predict_horizon as bigint) as predict_horizon, cast(fold as bigint) as fold, feature,
       median(value) as median from fold_values where value is not null group by all""")
def q_fold_medians(spark, sf_dir):
    """The imputation values of all models, from one count of distinct values."""
    rows, (nums, _) = _model_rows(spark, sf_dir)
    stats = fs.numeric_stats(rows.filter("train_from is not null and y is not null"), N_FOLDS)
    return _named(stats.drop("edges"), nums)


@register("fold_bin_edges", f"""with {FOLD_VALUES_CTE},
counted as (select segment, predict_horizon, fold, feature, value, count(*) as n from fold_values
            where value is not null group by all),
ranked as (select *, sum(n) over (partition by segment, predict_horizon, fold, feature order by value) as upto,
                  sum(n) over (partition by segment, predict_horizon, fold, feature) as total,
                  count(*) over (partition by segment, predict_horizon, fold, feature) as kinds from counted)
select segment, cast(predict_horizon as bigint) as predict_horizon, cast(fold as bigint) as fold, feature, value as edge
from ranked where upto < total and (kinds <= 32 or upto * 32 // total > (upto - n) * 32 // total)""")
def q_fold_bin_edges(spark, sf_dir):
    """The values at which the forests of all models may cut their features."""
    rows, (nums, _) = _model_rows(spark, sf_dir)
    stats = fs.numeric_stats(rows.filter("train_from is not null and y is not null"), N_FOLDS)
    return _named(stats.drop("median"), nums).select(
        "segment", "predict_horizon", "fold", "feature", F.explode("edges").alias("edge"))


@register("fold_modes", f"""with {CV_CTE},
counted as (select segment, fold, monthname(date) as value, count(*) as n from cvtrain group by all),
ranked as (select *, row_number() over (partition by segment, fold order by n desc, value) as rk,
                  count(*) over (partition by segment, fold) as kinds from counted)
select segment, cast(h as bigint) as predict_horizon, cast(fold as bigint) as fold, value as mode, kinds as n_categories
from ranked, (values (7), (14), (21), (28)) as v(h) where rk = 1""")
def q_fold_modes(spark, sf_dir):
    """The most frequent category (month name) of every model's training rows."""
    named = _panel(spark, sf_dir).withColumn("named", F.date_format("date", "MMMM"))
    frame = tr.cv_frame(named, ROLES, HORIZONS, N_FOLDS, N_PRED)
    rows, names = gv.model_rows(frame, ROLES, HORIZONS)
    stats = fs.category_stats(rows.filter("train_from is not null and y is not null"), N_FOLDS)
    return (_named(stats, names[GROUP][1]).filter("feature = 'named'")
            .select("segment", "predict_horizon", "fold", "mode", F.size("categories").cast("long").alias("n_categories")))


def _forest_predictions(spark, sf_dir):
    rows, _ = _model_rows(spark, sf_dir)
    jobs = write_scratch(gv._all_jobs(rows, [FOREST_PARAMS]), "jobs")
    return rows, gv.grove(rows, jobs, N_FOLDS, errors=False).filter("tested")


@register("forest_forecast")
def q_forest_forecast(spark, sf_dir):
    """The forecasts of every segment, horizon and fold by one forest each."""
    _, out = _forest_predictions(spark, sf_dir)
    return out.select("segment", "predict_horizon", "fold", "id", F.col("time").alias("date"), "y", "prediction")


@register("forest_forecast_report", f"""with {CV_CTE},
bounds as (select segment, fold, count(*) as n_train from cvtrain group by all)
select segment, cast(h as bigint) as predict_horizon, cast(fold as bigint) as fold, count(*) as n, count(*) as n_in_range,
       true as varies
from cvtest join bounds using (segment, fold), (values (7), (14), (21), (28)) as v(h) group by all""")
def q_forest_forecast_report(spark, sf_dir):
    """Of each forest: its test rows, those forecast within the range of its training targets, and
    whether its forecasts differ from row to row."""
    rows, out = _forest_predictions(spark, sf_dir)
    trained = rows.filter("train_from is not null and y is not null")
    bounds = trained.select("segment", "predict_horizon", "y", F.explode(
        F.sequence("train_from", F.lit(N_FOLDS - 1).cast("bigint"))).alias("fold")).groupBy(
        "segment", "predict_horizon", "fold").agg(F.min("y").alias("low"), F.max("y").alias("high"))
    return out.join(bounds, ["segment", "predict_horizon", "fold"]).groupBy("segment", "predict_horizon", "fold").agg(
        F.count("*").alias("n"), F.count_if(F.col("prediction").between(F.col("low"), F.col("high"))).alias("n_in_range"),
        (F.count_distinct("prediction") > 1).alias("varies"))


def _search(spark, sf_dir):
    """The panel, and the scores of the reference's two models: every forest candidate and Last."""
    panel = _featured_panel(spark, sf_dir)
    return panel, tr.train(panel, ROLES, N_PRED, GROUP, N_FOLDS, baselines=("Last",), project=PROJECT)


@register("forest_search")
def q_forest_search(spark, sf_dir):
    """Search of all segments, horizons, folds and candidates."""
    panel = _featured_panel(spark, sf_dir)
    return rounded(tr.cv_results(tr.forest_scores(panel, ROLES, N_PRED, GROUP, N_FOLDS), N_FOLDS))


_CANDIDATES_SQL = ", ".join(f"({i}, '{c['feature_subset']}', {c['min_samples_split']}, {c['max_depth'] or 'null'}, '{c['criterion']}')"
                            for i, c in enumerate(fr.sample_candidates()))


@register("forest_search_report", f"""with {CV_CTE}, sizes as (select segment, count(*) as n from cvtest group by 1)
select segment, cast(h as bigint) as predict_horizon, cast(candidate as bigint) as candidate, feature_subset,
       cast(min_samples_split as bigint) as min_samples_split, cast(max_depth as bigint) as max_depth,
       criterion, cast(n as bigint) as n, true as better_than_last
from sizes, (values (7), (14), (21), (28)) as v(h),
     (values {_CANDIDATES_SQL}) as c(candidate, feature_subset, min_samples_split, max_depth, criterion)""")
def q_forest_search_report(spark, sf_dir):
    """Parameters and test rows of every candidate, and whether it beats the Last forecaster."""
    scores = write_scratch(_search(spark, sf_dir)[1]["scores"], "scores")
    means = tr.cv_results(scores, N_FOLDS)
    last = means.filter("model = 'Last'").select("segment", "predict_horizon", F.col("average_mse").alias("last_mse"))
    sizes = scores.groupBy("segment", "predict_horizon", "model", "candidate").agg(F.sum("n").alias("n"))
    p = F.from_json("params", "feature_subset string, min_samples_split bigint, max_depth bigint, criterion string")
    return (means.filter("model = 'RandomForest'").join(sizes, ["segment", "predict_horizon", "model", "candidate"])
            .join(last, ["segment", "predict_horizon"]).withColumn("p", p)
            .select("segment", "predict_horizon", "candidate", "p.feature_subset", "p.min_samples_split", "p.max_depth",
                    "p.criterion", "n", (F.col("average_mse") < F.col("last_mse")).alias("better_than_last")))


def _searched_backtest(spark, sf_dir):
    panel, out = _search(spark, sf_dir)
    winners = write_scratch(out["best_models"], "winners")
    return panel, winners, bt.backtest(panel, ROLES, N_PRED, GROUP, N_FOLDS, winners)


@register("backtest_forest")
def q_backtest_forest(spark, sf_dir):
    """Train, then backtest its winners: test and training errors of each fold and their means."""
    return rounded(_searched_backtest(spark, sf_dir)[2]["report"])


@register("backtest_forest_report", f"""with {BT_CTE},
tests as (select fold, count(*) as n from bt group by 1),
trains as (select fold, 4 * count(*) as n_train from bttrain group by 1)
select cast(fold as bigint) as fold, n, n_train, cast(12 as bigint) as n_models, cast(12 as bigint) as n_forests,
       true as better_than_last, true as fits_training_rows
from tests join trains using (fold)""")
def q_backtest_forest_report(spark, sf_dir):
    """Of train and backtest as one chain: rows, winners, and how their errors compare with those of Last."""
    panel, winners, out = _searched_backtest(spark, sf_dir)
    last = bt.backtest_scores(bt.backtest_predictions(panel, ROLES, N_PRED, GROUP, N_FOLDS, ("Last",)), ["fold"], ROLES)
    trained = bt.baseline_train_scores(panel, ROLES, N_PRED, GROUP, N_FOLDS, ("Last",))
    won = winners.agg(F.count("*").alias("n_models"), F.count_if(F.col("model") == "RandomForest").alias("n_forests"))
    report = out["report"].filter("fold is not null")
    sizes = out["train_scores"].select("fold", F.col("n").alias("n_train"))
    return (report.join(sizes, "fold").join(last.select("fold", F.col("mse").alias("last_mse")), "fold")
            .join(trained.select("fold", F.col("mse").alias("last_train")), "fold")
            .withColumn("w", won.select(F.struct("*")).scalar())
            .select("fold", "n", "n_train", "w.n_models", "w.n_forests",
                    (F.col("mse") < F.col("last_mse")).alias("better_than_last"),
                    (F.col("train_mse") < F.col("last_train")).alias("fits_training_rows")))


@register("backtest_train_scores", f"""with {BT_CTE},
trainrows as (select l.*, f.fold from lags l, gfolds f where l.date <= f.end_train),
errs as (
  select 'Last' as model, fold, y,
         ((coalesce(last_7, 0) - y) * (coalesce(last_7, 0) - y)
          + (coalesce(last_14, 0) - y) * (coalesce(last_14, 0) - y)
          + (coalesce(last_21, 0) - y) * (coalesce(last_21, 0) - y)
          + (coalesce(last_28, 0) - y) * (coalesce(last_28, 0) - y)) / 4 as e
  from trainrows
  union all
  select 'Mean', fold, y, (bm1.m - y) * (bm1.m - y) from trainrows left join bm1 using (segment, fold)
  union all
  select 'MeanTS', fold, y, (bm2.m - y) * (bm2.m - y)
  from trainrows left join bm2 using (segment, id, fold))
select model, cast(fold as bigint) as fold, count(*) * 4 as n, round(avg(e), 6) as mse
from errs group by model, fold""")
def q_backtest_train_scores(spark, sf_dir):
    return rounded(bt.baseline_train_scores(_panel(spark, sf_dir), ROLES, N_PRED, GROUP, N_FOLDS,
                                    ("Last", "Mean", "MeanTS")))


@register("backtest_report", f"""with {BT_CTE},
trainrows as (select l.*, f.fold from lags l, gfolds f where l.date <= f.end_train),
trainerr as (
  select 'Last' as model, fold,
         ((coalesce(last_7, 0) - y) * (coalesce(last_7, 0) - y)
          + (coalesce(last_14, 0) - y) * (coalesce(last_14, 0) - y)
          + (coalesce(last_21, 0) - y) * (coalesce(last_21, 0) - y)
          + (coalesce(last_28, 0) - y) * (coalesce(last_28, 0) - y)) / 4 as e
  from trainrows
  union all
  select 'Mean', fold, (bm1.m - y) * (bm1.m - y) from trainrows left join bm1 using (segment, fold)
  union all
  select 'MeanTS', fold, (bm2.m - y) * (bm2.m - y)
  from trainrows left join bm2 using (segment, id, fold)),
tr as (select model, fold, avg(e) as train_mse from trainerr group by 1, 2),
te as (select model, fold, count(*) as n, avg((prediction - y) * (prediction - y)) as mse
       from btpred group by 1, 2),
folds as (select model, cast(fold as bigint) as fold, n, mse, train_mse from te left join tr using (model, fold))
select model, fold, n, round(mse, 6) as mse, round(train_mse, 6) as train_mse from folds
union all select model, null, null, round(avg(mse), 6), round(avg(train_mse), 6) from folds group by 1""")
def q_backtest_report(spark, sf_dir):
    panel, models = _panel(spark, sf_dir), ("Last", "Mean", "MeanTS")
    preds = bt.backtest_predictions(panel, ROLES, N_PRED, GROUP, N_FOLDS, models)
    train = bt.baseline_train_scores(panel, ROLES, N_PRED, GROUP, N_FOLDS, models)
    return rounded(bt.backtest_report(preds, train, ROLES))
