"""Canonical schema of a property transaction, and the region dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

NUMERIC = ("price", "area", "age", "station_distance")
CATEGORIES = ("prefecture", "municipality", "station", "room_layout", "building_type")
REQUIRED = (*NUMERIC, *CATEGORIES, "transaction_year")
FEATURES = ("area", "age", "station_distance", "transaction_year", *CATEGORIES)

TRANSACTION = T.StructType(
    [T.StructField(c, T.DoubleType()) for c in NUMERIC]
    + [T.StructField(c, T.StringType()) for c in CATEGORIES]
    + [T.StructField("transaction_year", T.IntegerType())]
)

# Region keys, prefecture labels and codes, in region order.
REGIONS = (("tokyo", "東京都", "13"), ("saitama", "埼玉県", "11"), ("chiba", "千葉県", "12"), ("kanagawa", "神奈川県", "14"))

EARTH_RADIUS_KM = 6371.0
WALK_METRES_PER_MINUTE = 60
FORECAST_FLOOR = 1_000_000.0


def regions(spark: SparkSession) -> DataFrame:
    """(region, prefecture, code, region_order), four rows."""
    rows = [(*r, k) for k, r in enumerate(REGIONS)]
    return spark.createDataFrame(rows, "region string, prefecture string, code string, region_order int")
