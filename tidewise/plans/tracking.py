"""Run records as tables: candidate scores, chosen models and run settings.

Stands in for an experiment tracker: every run writes its tables to a folder of its own
below one store; its settings, written last, are the manifest row that makes it
visible. A run that dies half-way is never read, and runs at the same time do not meet.
"""

from __future__ import annotations

import json
import uuid

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewise.roles import Roles
from tidewise.sources import sinks

RUN_SCHEMA = ("run_id string, number_predictions int, n_predictions_groupby int, n_folds int, "
              "column_segment_groupby string, id_column string, time_column string, target string, average_cv_mse double")
BEST_SCHEMA = ("segment string, predict_horizon bigint, model string, candidate bigint, average_mse double, "
               "model_key string, params string")
CANDIDATE_SCHEMA = ("run_id string, segment string, predict_horizon bigint, model string, candidate bigint, "
                    "params map<string,string>, metrics map<string,double>, tags map<string,string>")


def _path(store: str, run_id: str, name: str) -> str:
    return f"{store.rstrip('/')}/data/{run_id}/{name}"


def new_run_id() -> str:
    return uuid.uuid4().hex


def record_candidates(cv_results: DataFrame, store: str, run_id: str, n_folds: int,
                      n_grid_features: int | None = None) -> None:
    """One record per candidate: params, metrics (average_mse,
    std_mse, split{k}_test_score; not rounded) and tags (segment, horizon, model, and
    the number of columns of a horizon's grid)."""
    metrics = F.create_map(
        F.lit("average_mse"), F.col("average_mse"), F.lit("std_mse"), F.col("std_mse"),
        *[x for k in range(n_folds) for x in (F.lit(f"split{k}_test_score"),
                                              F.col(f"split{k}_test_score"))])
    tags = F.create_map(F.lit("segment"), F.col("segment"),
                        F.lit("prediction_horizon"), F.col("predict_horizon").cast("string"),
                        F.lit("model_name"), F.col("model"),
                        F.lit("n_grid_features"), F.lit(n_grid_features).cast("string"))
    params = F.from_json(F.coalesce(F.col("params"), F.lit("{}")), "map<string,string>")
    out = cv_results.select(
        F.lit(run_id).alias("run_id"), "segment", "predict_horizon", "model", "candidate",
        params.alias("params"), metrics.alias("metrics"), tags.alias("tags"))
    out.write.mode("error").parquet(_path(store, run_id, "candidates"))


def record_best(best: DataFrame, store: str, run_id: str) -> None:
    """The chosen model per (segment, horizon), as JSON lines."""
    best.write.mode("error").json(_path(store, run_id, "best_models"))


def record_run(spark: SparkSession, summary: DataFrame, store: str, run_id: str, roles: Roles,
               n_pred: int, group: int, n_folds: int) -> None:
    """The run's settings and overall score: its manifest row, written when all else is."""
    score = summary.first()["average_cv_mse"]
    sinks.commit(spark, store, run_id, json.dumps({
        "run_id": run_id, "number_predictions": n_pred, "n_predictions_groupby": group, "n_folds": n_folds,
        "column_segment_groupby": roles.segment, "id_column": roles.id, "time_column": roles.time,
        "target": roles.target, "average_cv_mse": score}))


def read_runs(spark: SparkSession, store: str) -> DataFrame:
    """The committed runs."""
    return sinks.manifest(spark, store).select(F.from_json("content", RUN_SCHEMA).alias("run")).select("run.*")


def best_run(spark: SparkSession, store: str, run_id: str | None = None):
    """The given run, or the one with the least overall score."""
    runs = read_runs(spark, store)
    if run_id is not None:
        rows = runs.filter(F.col("run_id") == run_id).limit(1).collect()
    else:
        rows = (runs.filter(F.col("average_cv_mse").isNotNull() & ~F.isnan("average_cv_mse"))
                .orderBy("average_cv_mse", "run_id").limit(1).collect())
    if not rows:
        raise LookupError("no matching run in the store")
    return rows[0]


def read_best(spark: SparkSession, store: str, run_id: str) -> DataFrame:
    """Chosen models of one committed run."""
    best_run(spark, store, run_id)
    return spark.read.schema(BEST_SCHEMA).json(_path(store, run_id, "best_models"))


def read_candidates(spark: SparkSession, store: str, run_id: str) -> DataFrame:
    best_run(spark, store, run_id)
    return spark.read.schema(CANDIDATE_SCHEMA).parquet(_path(store, run_id, "candidates"))


def roles_of(run) -> Roles:
    return Roles(id=run["id_column"], time=run["time_column"], target=run["target"],
                 segment=run["column_segment_groupby"])


def save_forests(plans: DataFrame, nodes: DataFrame, store: str, run_id: str) -> None:
    """A run's grown forests: what their features are filled and cut with, and their nodes."""
    for name, df in (("plans", plans), ("nodes", nodes)):
        df.write.mode("error").parquet(_path(store, run_id, f"models/{name}"))


def load_forests(spark: SparkSession, store: str, run_id: str) -> tuple[DataFrame, DataFrame]:
    plans, nodes = (spark.read.parquet(_path(store, run_id, f"models/{name}")) for name in ("plans", "nodes"))
    return plans, nodes


def save_model(model: PipelineModel, path: str) -> str:
    model.write().overwrite().save(path)
    return path


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
