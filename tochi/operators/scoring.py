"""Scores, price bands, trend-corrected forecasts and chart series for requests."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tochi.operators.history import region_history, trend
from tochi.schema import FORECAST_FLOOR

BASE_PRICE = 18_000_000.0
LONG_RANGE_YEARS = 10

Scorer = Callable[[DataFrame, Column], DataFrame]


def linear_score(latest: int, base: Column | None = None) -> Callable[[Column], Column]:
    """The stand-in scorer's price at a year, never under the floor."""
    start = base if base is not None else F.lit(BASE_PRICE)

    def at(year: Column) -> Column:
        x = start + 850_000 * F.col("area") - 320_000 * F.col("age") - 180_000 * F.col("station_distance") + 450_000 * (year - latest)
        return F.greatest(x, F.lit(FORECAST_FLOOR))

    return at


def band(df: DataFrame, price: str = "prediction") -> DataFrame:
    """``df`` (with area and mae) with unit_price, lower and upper."""
    p = F.col(price)
    return df.withColumns({"unit_price": F.when(F.col("area") > 0, p / F.col("area")).otherwise(F.lit(0.0)), "lower": F.greatest(F.lit(0.0), p - F.col("mae")), "upper": p + F.col("mae")})


def with_trend(requests: DataFrame, history: DataFrame, latest: int) -> DataFrame:
    """``requests`` with the station's trend, else the region's, else 0."""
    own = trend(history, ["region", "station"], latest).withColumnRenamed("trend", "_own")
    whole = trend(region_history(history), ["region"], latest).withColumnRenamed("trend", "_whole")
    out = requests.join(own, ["region", "station"], "left").join(whole, "region", "left")
    return out.withColumn("trend", F.coalesce("_own", "_whole", F.lit(0.0))).drop("_own", "_whole")


def forecast(requests: DataFrame, history: DataFrame, latest: int, score: Callable[[Column], Column]) -> DataFrame:
    """One row per request and year: the plain score up to ``latest``; beyond, one row
    for each year to the requested one, trend-corrected and floored."""
    base = with_trend(requests, history, latest)
    asked = F.col("year")
    years = F.when(asked > latest, F.sequence(F.lit(latest + 1), F.greatest(asked, F.lit(latest + 1)))).otherwise(F.array(asked))
    rows = base.withColumn("forecast_year", F.explode(years))
    ahead = F.col("forecast_year") - latest
    price = F.when(asked <= latest, score(asked)).otherwise(F.greatest(F.lit(FORECAST_FLOOR), score(F.lit(latest)) + F.col("trend") * ahead))
    rows = rows.withColumns({"prediction": price, "long_range": asked > latest + LONG_RANGE_YEARS})
    return band(rows)


def with_regional_tables(scored: DataFrame, stations: DataFrame, documents: DataFrame, history: DataFrame, latest: int) -> DataFrame:
    """Scored requests with what their region's tables say: station_id, trend, mae and the band.

    stations: the dictionary's rows of the feature station; an unknown name has id 0.
    documents: the regions' metadata. history: prices of stations by year; a station
    without a trend up to ``latest`` has none. Requests are joined to small tables only,
    which Spark broadcasts by their size.
    """
    ids = stations.select("region", F.col("value").alias("station"), F.col("id").alias("station_id"))
    errors = documents.select("region", "mae")
    out = scored.join(ids, ["region", "station"], "left").join(errors, "region", "left")
    out = out.join(trend(history, ["region", "station"], latest), ["region", "station"], "left")
    return band(out.withColumn("station_id", F.coalesce("station_id", F.lit(0))))


def missing_years(points: DataFrame, history: DataFrame) -> DataFrame:
    """The points (region, station, year, ...) whose year the history lacks."""
    return points.join(history.select("region", "station", "year"), ["region", "station", "year"], "left_anti")


def chart_series(history: DataFrame, forecasts: DataFrame, asked: DataFrame) -> DataFrame:
    """History, forecast points it lacks, and the asked point if it is still absent.

    Each of the three has region, station, year and avg_price; ``kind`` tells them apart.
    """
    actual = history.select("region", "station", "year", "avg_price", F.lit("actual").alias("kind"))
    ahead = missing_years(forecasts, actual).select("region", "station", "year", "avg_price", F.lit("forecast").alias("kind"))
    both = actual.unionByName(ahead)
    return both.unionByName(missing_years(asked, both).select("region", "station", "year", "avg_price", F.lit("forecast").alias("kind")))


def forecast_line(series: DataFrame) -> DataFrame:
    """``series`` with the last actual year and whether a point is on the forecast line."""
    last = F.max(F.when(F.col("kind") == "actual", F.col("year"))).over(Window.partitionBy("region", "station"))
    return series.withColumn("last_actual", last).withColumn("on_line", (F.col("kind") == "forecast") | (F.col("year") == F.col("last_actual")))
