"""Feature providers as ML stages: fitted in order, each on the output of those before it, and saved with the model.

A provider is a Spark ML Transformer, or an Estimator whose model is one. What they fit is
kept in files, so a fitted set of providers can be written, read in another session, and
applied to requests exactly as it was to the training rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel, Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tochi.functions import exact_mean
from tochi.tables import BROADCAST_ROWS, materialized


class Columns(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """A built-in provider: its columns must be there already."""

    names = Param(Params._dummy(), "names", "columns that must be there", TypeConverters.toListString)

    def __init__(self, *names: str) -> None:
        super().__init__()
        self._setDefault(names=[])
        if names:
            self._set(names=list(names))

    @property
    def output_features(self) -> tuple[str, ...]:
        return tuple(self.getOrDefault(self.names))

    def _transform(self, df: DataFrame) -> DataFrame:
        if missing := set(self.output_features) - set(df.columns):
            raise ValueError(f"missing columns: {sorted(missing)}")
        return df


class _Mean(Params):
    """Parameters of a mean by a key."""

    key = Param(Params._dummy(), "key", "column of the key", TypeConverters.toString)
    value = Param(Params._dummy(), "value", "column that is averaged", TypeConverters.toString)
    name = Param(Params._dummy(), "name", "column of the feature", TypeConverters.toString)

    @property
    def output_features(self) -> tuple[str, ...]:
        return (self.getOrDefault(self.name),)


class GroupMean(Estimator, _Mean, DefaultParamsReadable, DefaultParamsWritable):
    """The mean of a column by a key, as a feature; unseen and null keys take the overall mean."""

    @keyword_only
    def _given(self, *, key: str = "", value: str = "", name: str = "") -> None:
        self._set(**self._input_kwargs)

    def __init__(self, key: str = "", value: str = "", name: str = "") -> None:
        super().__init__()
        self._given(key=key, value=value, name=name)

    def _fit(self, df: DataFrame) -> GroupMeanModel:
        key, value, name = (self.getOrDefault(p) for p in (self.key, self.value, self.name))
        means = materialized(df.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(exact_mean(F.col(value)).alias("mean")), "means")
        whole = df.agg(exact_mean(F.col(value))).first()[0]  # one number
        return self._copyValues(GroupMeanModel(means, whole))


class GroupMeanModel(Model, _Mean, MLReadable, MLWritable):
    """A fitted ``GroupMean``: a table (key, mean) in files, and the overall mean."""

    whole = Param(Params._dummy(), "whole", "overall mean", TypeConverters.toFloat)

    def __init__(self, means: DataFrame | None = None, whole: float | None = None) -> None:
        super().__init__()
        self.means = means
        if whole is not None:
            self._set(whole=whole)

    def _transform(self, df: DataFrame) -> DataFrame:
        key, name = self.getOrDefault(self.key), self.getOrDefault(self.name)
        means = self.means.select(F.col("key").alias("_key"), F.col("mean").alias("_mean"))
        if means.count() <= BROADCAST_ROWS:
            means = F.broadcast(means)
        whole = F.lit(self.getOrDefault(self.whole) if self.isDefined(self.whole) else None).cast("double")
        return df.join(means, F.col(key) == F.col("_key"), "left").withColumn(name, F.coalesce("_mean", whole)).drop("_key", "_mean")

    def write(self) -> MLWriter:
        return _MeanWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _MeanReader(cls)


class _MeanWriter(MLWriter):
    def __init__(self, model: GroupMeanModel) -> None:
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession)
        self.model.means.write.parquet(f"{path}/data")


class _MeanReader(MLReader):
    def __init__(self, cls: type) -> None:
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> GroupMeanModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = self.cls(self.sparkSession.read.parquet(f"{path}/data"))
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model


def built_in() -> list[Transformer]:
    """The five groups of columns that every model uses, in order."""
    return [Columns("area", "age"), Columns("station", "station_distance"), Columns("prefecture", "municipality"), Columns("room_layout", "building_type"), Columns("transaction_year")]


def fit_providers(df: DataFrame, providers: Sequence[Transformer | Estimator]) -> PipelineModel:
    """The providers fitted in order; ``write().save(path)`` keeps them, ``PipelineModel.load`` reads them."""
    return Pipeline(stages=list(providers)).fit(df)


def feature_names(fitted: PipelineModel) -> tuple[str, ...]:
    """The features of fitted providers, in order."""
    return tuple(n for stage in fitted.stages for n in stage.output_features)


def run_providers(df: DataFrame, providers: Sequence[Transformer | Estimator]) -> tuple[DataFrame, tuple[str, ...]]:
    """(features, their names) after fitting and applying each provider in order."""
    fitted = fit_providers(df, providers)
    return fitted.transform(df), feature_names(fitted)
