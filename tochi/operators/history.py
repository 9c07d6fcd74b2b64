"""Price history, its trends, and the metrics of predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tochi.functions import exact_mean, mean

TREND_POINTS = 4


def price_history(df: DataFrame) -> DataFrame:
    """(region, station, year, avg_price) over all years of cleaned transactions."""
    return df.groupBy("region", "station", F.col("transaction_year").alias("year")).agg(exact_mean(F.col("price")).alias("avg_price"))


def region_history(history: DataFrame) -> DataFrame:
    """(region, year, avg_price): the plain mean of the stations' means.

    The means are summed as whole millionths, so the order of rows does not matter.
    """
    millionths = F.floor(F.col("avg_price") * 1_000_000 + 0.5).cast("decimal(28,0)")
    return history.groupBy("region", "year").agg((F.sum(millionths).cast("double") / F.count("avg_price") / 1_000_000).alias("avg_price"))


def deltas(series: DataFrame, keys: list[str]) -> DataFrame:
    """``series`` with each point's delta to the one before and its place from the end."""
    ordered = Window.partitionBy(*keys).orderBy("year")
    return series.withColumns({"delta": F.col("avg_price") - F.lag("avg_price").over(ordered), "from_end": F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("year")))})


def trend(series: DataFrame, keys: list[str], latest: int) -> DataFrame:
    """(keys, trend): mean successive delta of the last four points up to ``latest``.

    Gaps between years are not divided out; one point has no trend.
    """
    points = deltas(series.filter(F.col("year") <= latest), keys).filter(F.col("from_end") <= TREND_POINTS)
    first, last = F.min_by("avg_price", "year"), F.max_by("avg_price", "year")
    return points.groupBy(*keys).agg(F.when(F.count("*") > 1, (last - first) / (F.count("*") - 1)).alias("trend"))


def metrics(predicted: DataFrame, by: list[str], actual: str = "price", prediction: str = "prediction", weight: str | None = None) -> DataFrame:
    """mae, rmse and mape (percent, over non-zero actuals, 0 if none) by group; a row stands for ``weight`` equal ones if that is named."""
    y, e = F.col(actual), F.col(actual) - F.col(prediction)
    return predicted.groupBy(*by).agg(
        mean(F.abs(e), weight).alias("mae"),
        F.sqrt(mean(e * e, weight)).alias("rmse"),
        F.coalesce(100 * mean(F.when(y != 0, F.abs(e / y)), weight), F.lit(0.0)).alias("mape"),
    )


def mean_model(train: DataFrame, by: str = "region", weight: str | None = None) -> DataFrame:
    """(region, prediction): the mean price, the model of last resort."""
    return train.groupBy(by).agg(exact_mean(F.col("price"), weight).alias("prediction"))
