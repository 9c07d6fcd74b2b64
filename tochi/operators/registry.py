"""Experiment log and model registry as append-only rows and views over them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tochi.sources.log import Log

#: Columns of the logs of events and models; keys are event_id and model_key.
EVENTS = "event_id string, experiment_id bigint, status string, mae double, rmse double, mape double, event_order bigint"
MODELS = "model_key string, region string, model_id bigint, experiment_id bigint, mae double, model_path string, became_latest boolean"


def started(experiments: DataFrame) -> DataFrame:
    """The first event of each experiment (experiment_id), for the log."""
    return _event(experiments, "running", F.lit(0))


def completed(results: DataFrame) -> DataFrame:
    """The last event of experiments that ended well (experiment_id, mae, rmse, mape)."""
    return _event(results, "success", F.lit(1))


def failed(experiments: DataFrame) -> DataFrame:
    """The last event of experiments that ended otherwise; the log keeps them."""
    return _event(experiments, "failed", F.lit(1))


def _event(rows: DataFrame, status: str, order) -> DataFrame:
    have = set(rows.columns)
    errors = [(F.col(c) if c in have else F.lit(None).cast("double")).alias(c) for c in ("mae", "rmse", "mape")]
    return rows.select(F.concat_ws(":", "experiment_id", F.lit(status)).alias("event_id"), "experiment_id", F.lit(status).alias("status"), *errors, order.cast("long").alias("event_order"))


def register_models(log: Log, candidates: DataFrame) -> int:
    """Append ``candidates`` (model_key, region, model_id, mae, ...) and return the commit.

    Which of them became latest is decided at the commit, by the latest model that the log
    holds then: a model that another writer registered meanwhile has to be beaten too.
    """

    def decide(have: DataFrame, new: DataFrame) -> DataFrame:
        held = have.filter("became_latest").groupBy("region").agg(F.max_by("mae", F.struct("commit", "model_id")).alias("held")).withColumn("_known", F.lit(True))
        before = Window.partitionBy("region").orderBy("model_id").rowsBetween(Window.unboundedPreceding, -1)
        best = F.least(F.min("mae").over(before), F.col("held"))
        first = F.col("_known").isNull() & (F.row_number().over(Window.partitionBy("region").orderBy("model_id")) == 1)
        won = first | (F.col("mae") < best) | (best.isNull() & F.col("mae").isNotNull())
        return new.drop("became_latest").join(held, "region", "left").withColumn("became_latest", F.coalesce(won, F.lit(False))).drop("held", "_known")

    return log.append(candidates, decide)


def registered(models: DataFrame) -> DataFrame:
    """Rows of the log of models with is_latest, one model a region."""
    last = F.max(F.when(F.col("became_latest"), F.struct("commit", "model_id"))).over(Window.partitionBy("region"))
    return models.withColumn("is_latest", F.coalesce(F.struct("commit", "model_id") == last, F.lit(False)))


def experiment_state(events: DataFrame) -> DataFrame:
    """(experiment_id, status, mae): the last event of each; failed runs stay."""
    return events.groupBy("experiment_id").agg(F.max_by("status", "event_order").alias("status"), F.max_by("mae", "event_order").alias("mae"))


def latest_models(models: DataFrame) -> DataFrame:
    """``models`` (region, model_id, mae) with became_latest and is_latest.

    A model becomes latest if its error is strictly below all before it; a tie keeps
    the older one, and a null error is beaten by any.
    """
    before = Window.partitionBy("region").orderBy("model_id").rowsBetween(Window.unboundedPreceding, -1)
    best = F.min("mae").over(before)
    first = F.row_number().over(Window.partitionBy("region").orderBy("model_id")) == 1
    won = models.withColumn("became_latest", F.coalesce(first | (F.col("mae") < best) | (best.isNull() & F.col("mae").isNotNull()), F.lit(False)))
    top = F.max(F.when(F.col("became_latest"), F.col("model_id"))).over(Window.partitionBy("region"))
    return won.withColumn("is_latest", F.col("model_id") == top)


def publishable(models: DataFrame, policy: str = "best") -> DataFrame:
    """The (region, model_id) to publish: the latest, or by policy the newest of all."""
    if policy == "best":
        return latest_models(models).filter("is_latest").select("region", "model_id")
    if policy == "latest":
        return models.groupBy("region").agg(F.max("model_id").alias("model_id"))
    raise ValueError("policy is 'best' or 'latest'")


def current_best(models: DataFrame, experiments: DataFrame) -> DataFrame:
    """(region, model_id, mae) of the latest models, by their experiments' errors."""
    joined = models.join(experiments.select("experiment_id", "mae"), "experiment_id")
    return latest_models(joined).filter("is_latest").select("region", "model_id", "mae")


def new_feature_links(wanted: DataFrame, features: DataFrame, existing: DataFrame) -> DataFrame:
    """(experiment_id, feature_id) rows not there yet, for the wanted feature names."""
    rows = wanted.join(features, "feature_name").select("experiment_id", "feature_id").distinct()
    return rows.join(existing, ["experiment_id", "feature_id"], "left_anti")
