"""Registered queries, one for each operator of the inventory, and their SQL."""

from __future__ import annotations

import gzip
import zipfile
from collections.abc import Callable
from functools import reduce
from urllib.parse import unquote

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tochi import functions as R
from tochi import sources
from tochi.operators import cleaning, features, forest, history, metadata, normalize, registry, scoring, stations, training
from tochi.plans import bindings as B
from tochi.schema import CATEGORIES
from tochi.sources import archives, stores
from tochi.tables import materialized

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
KEYS, START, VALIDATION, TEST = B.KEYS, B.START, B.VALIDATION, B.TEST


def query(name: str, sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


# ------------------------------------------------------------ shared views


def tx(spark: SparkSession, sf: str) -> DataFrame:
    return B.spark_view(spark, sf, B.TX)


def clean(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    """Cleaned transactions with region, price, area and ``columns`` (all if none are named).

    The joined rows are written once, so a query reads the facts once, and only the columns it needs.
    """
    rows = tx(spark, sf)
    if columns:
        rows = rows.select(*dict.fromkeys(("region", "price", "area", *columns)))
    return cleaning.remove_iqr_outliers(materialized(rows, "transactions"))


def price_history(spark: SparkSession, sf: str) -> DataFrame:
    return history.price_history(clean(spark, sf, "station", "transaction_year")).select("region", "station", "year", R.rounded(F.col("avg_price"), 2).alias("avg_price"))


def _raw(spark: SparkSession, sf: str) -> DataFrame:
    return B.spark_view(spark, sf, B.RAW)


def _csv_view(raw: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    named = {"raw_kind": "種類", "raw_price": "取引価格（総額）", "raw_area": "面積（㎡）", "raw_period": "取引時期", "raw_built": "建築年", "raw_walk": "最寄駅：距離（分）", "raw_prefecture": "都道府県名", "raw_municipality": "市区町村名", "raw_station": "最寄駅：名称", "raw_layout": "間取り", "raw_structure": "建物の構造"}
    return raw.select(*[F.col(a).alias(b) for a, b in named.items()], *keep)


def _requests(spark: SparkSession, sf: str) -> DataFrame:
    return B.spark_view(spark, sf, B.REQUESTS)


def _dictionary(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.build_category_dictionary(clean(spark, sf, *CATEGORIES))


def _experiments(spark: SparkSession, sf: str) -> DataFrame:
    """One experiment a nation: the mean model's error over its rows."""
    rows = tx(spark, sf)
    scored = rows.join(history.mean_model(rows), "region")
    errors = scored.groupBy("region", F.col("n_nationkey").alias("model_id")).agg(R.exact_mean(F.abs(F.col("price") - R.rounded(F.col("prediction"), 2))).alias("mae"))
    return errors.select("region", "model_id", R.rounded(F.col("mae"), 2).alias("mae"))


def _mean(x: str) -> str:
    return f"CAST(sum(CAST({x} AS DECIMAL(18,2))) AS DOUBLE) / count({x})"


_FENCE = "BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)"
_TX = f"WITH tx AS ({B.duck_view(B.TX)})"
_CLEAN = f"""{_TX},
b1 AS (SELECT region, quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.75) AS q3 FROM tx GROUP BY region),
t1 AS (SELECT tx.* FROM tx JOIN b1 USING (region) WHERE price {_FENCE}),
b2 AS (SELECT region, quantile_cont(area, 0.25) AS q1, quantile_cont(area, 0.75) AS q3 FROM t1 GROUP BY region),
clean AS (SELECT t1.* FROM t1 JOIN b2 USING (region) WHERE area {_FENCE})"""
_HISTORY = f"""{_CLEAN},
history AS (SELECT region, station, transaction_year AS year, {_mean('price')} AS avg_price FROM clean GROUP BY ALL)"""
_POINTS = """points AS (SELECT *, avg_price - lag(avg_price) OVER (PARTITION BY region, station ORDER BY year) AS delta,
  row_number() OVER (PARTITION BY region, station ORDER BY year DESC) AS from_end FROM history WHERE year <= 2001)"""
_TREND = f"""{_HISTORY}, {_POINTS},
trend AS (SELECT region, station, CASE WHEN count(*) > 1 THEN (arg_max(avg_price, year) - arg_min(avg_price, year)) / (count(*) - 1) END AS trend FROM points WHERE from_end <= 4 GROUP BY ALL),
rhist AS (SELECT region, year, CAST(sum(CAST(floor(avg_price * 1000000 + 0.5) AS HUGEINT)) AS DOUBLE) / count(avg_price) / 1000000 AS avg_price FROM history GROUP BY ALL),
rpoints AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY year DESC) AS from_end FROM rhist WHERE year <= 2001),
rtrend AS (SELECT region, CASE WHEN count(*) > 1 THEN (arg_max(avg_price, year) - arg_min(avg_price, year)) / (count(*) - 1) END AS rtrend FROM rpoints WHERE from_end <= 4 GROUP BY ALL)"""
_DICT = f"""{_CLEAN},
vals AS (SELECT DISTINCT region, f AS feature, v AS value FROM (
  {' UNION ALL '.join(f"SELECT region, '{c}' AS f, {c} AS v FROM clean" for c in CATEGORIES)}) WHERE v IS NOT NULL),
dict AS (SELECT *, row_number() OVER (PARTITION BY region, feature ORDER BY value) AS id FROM vals)"""
_RAW = f"WITH raw AS ({B.duck_view(B.RAW)})"
_W = "translate({x}, '０１２３４５６７８９', '0123456789')"


def _num(x: str) -> str:
    return f"CAST(nullif(regexp_extract(replace(replace({_W.format(x=x)}, ',', ''), '㎡', ''), '[0-9]+(\\.[0-9]+)?'), '') AS DOUBLE)"


def _year(x: str) -> str:
    return f"CAST(nullif(regexp_extract({_W.format(x=x)}, '[0-9]{{4}}'), '') AS INTEGER)"


def _built(x: str) -> str:
    n = f"CAST(nullif(regexp_extract({_W.format(x=x)}, '[0-9]+'), '') AS INTEGER)"
    return f"coalesce({_year(x)}, CASE WHEN starts_with({x}, '昭和') THEN {n} + 1925 WHEN starts_with({x}, '平成') THEN {n} + 1988 WHEN starts_with({x}, '令和') THEN {n} + 2018 END)"


def _walk(x: str) -> str:
    return f"CASE WHEN coalesce({x}, '') = '' THEN 0.0 WHEN contains({x}, '30分') AND contains({x}, '60分') THEN 45.0 WHEN contains({x}, '1H') OR contains({x}, '1時間') THEN 60.0 ELSE coalesce({_num(x)}, 0.0) END"


_AGE = f"CASE WHEN {_year('raw_period')} IS NOT NULL AND {_built('raw_built')} IS NOT NULL THEN CAST(greatest(0, {_year('raw_period')} - {_built('raw_built')}) AS DOUBLE) END"
_PARSED = f"""SELECT {_num('raw_price')} AS price, {_num('raw_area')} AS area, {_AGE} AS age, CAST({_walk('raw_walk')} AS DOUBLE) AS station_distance,
  raw_prefecture AS prefecture, raw_municipality AS municipality, nullif(raw_station, '') AS station,
  coalesce(nullif(raw_layout, ''), 'unknown') AS room_layout, coalesce(nullif(raw_structure, ''), 'unknown') AS building_type, {_year('raw_period')} AS transaction_year, raw_kind, {{keys}} FROM raw"""
_NORM = f"{_RAW}, parsed AS ({_PARSED.replace('{keys}', ', '.join(KEYS))}), norm AS (SELECT * FROM parsed WHERE raw_kind = '中古マンション等')"
_REQUIRED = "price, area, age, station_distance, prefecture, municipality, station, room_layout, building_type, transaction_year"
_FILLED = " AND ".join(f"{c} IS NOT NULL" for c in _REQUIRED.split(", "))

# ------------------------------------------------------------ projections and filters


def _rule(column: str, f: Callable[[Column], Column], name: str):
    return lambda spark, sf: _raw(spark, sf).groupBy(F.col(column).alias("text")).agg(F.count("*").alias("n")).withColumn(name, f(F.col("text")))


for _name, _col, _f, _sql in (
    ("n04_number", "raw_area", R.number, _num),
    ("n05_transaction_year", "raw_period", R.transaction_year, _year),
    ("n06_building_year", "raw_built", R.building_year, _built),
    ("n08_walking_minutes", "raw_walk", R.walking_minutes, _walk),
):
    query(_name, f"{_RAW} SELECT {_col} AS text, count(*) AS n, {_sql(_col)} AS value FROM raw GROUP BY ALL")(_rule(_col, _f, "value"))


@query("n01_normalize_csv", f"{_NORM} SELECT {_REQUIRED} FROM norm")
def n01(spark, sf):
    return normalize.require(normalize.normalize_csv(_csv_view(_raw(spark, sf))))


@query("n02_property_kind", f"{_RAW} SELECT raw_kind AS kind, count(*) AS n FROM raw WHERE raw_kind = '中古マンション等' GROUP BY ALL")
def n02(spark, sf):
    return _raw(spark, sf).filter(F.col("raw_kind") == normalize.WANTED_KIND).groupBy(F.col("raw_kind").alias("kind")).agg(F.count("*").alias("n"))


@query("n03_first_filled", f"{_RAW} SELECT coalesce(nullif(raw_station, ''), nullif(raw_municipality, '')) AS place, count(*) AS n FROM raw GROUP BY ALL")
def n03(spark, sf):
    return _raw(spark, sf).groupBy(R.first_filled(F.col("raw_station"), F.col("raw_municipality")).alias("place")).agg(F.count("*").alias("n"))


@query("n07_building_age", f"{_RAW} SELECT raw_period, raw_built, {_AGE} AS age, count(*) AS n FROM raw GROUP BY ALL")
def n07(spark, sf):
    age = R.building_age(R.transaction_year(F.col("raw_period")), R.building_year(F.col("raw_built")))
    return _raw(spark, sf).groupBy("raw_period", "raw_built", age.alias("age")).agg(F.count("*").alias("n"))


@query("n09_fill_unknown", f"{_NORM} SELECT room_layout, building_type, count(*) AS n FROM norm GROUP BY ALL")
def n09(spark, sf):
    return n01(spark, sf).groupBy("room_layout", "building_type").agg(F.count("*").alias("n"))


@query("n10_require_columns", f"{_NORM} SELECT price, area, CAST(NULL AS DOUBLE) AS age, station_distance, prefecture, municipality, station, room_layout, building_type, transaction_year FROM norm")
def n10(spark, sf):
    return normalize.require(n01(spark, sf).drop("age"))


@query("n11_drop_missing", f"{_NORM} SELECT {_REQUIRED} FROM norm WHERE {_FILLED}")
def n11(spark, sf):
    return normalize.drop_missing(n01(spark, sf))


@query("n11_zero_age", f"{_NORM} SELECT count(*) AS n, count_if(age = 0) AS zero FROM (SELECT * REPLACE (coalesce(age, 0.0) AS age) FROM norm) WHERE {_FILLED}")
def n11_zero(spark, sf):
    df = normalize.require(normalize.normalize_csv(_csv_view(_raw(spark, sf)), missing_building_year="zero"))
    return normalize.drop_missing(df).agg(F.count("*").alias("n"), F.count_if(F.col("age") == 0).alias("zero"))


_PREFS = "CASE r_name WHEN 'AFRICA' THEN '東京都' WHEN 'AMERICA' THEN '埼玉県' WHEN 'ASIA' THEN '千葉県' WHEN 'EUROPE' THEN '神奈川県' ELSE r_name END"


@query("n12_region_mapping", f"SELECT n_name, {_PREFS} AS prefecture, CASE r_name WHEN 'AFRICA' THEN 'tokyo' WHEN 'AMERICA' THEN 'saitama' WHEN 'ASIA' THEN 'chiba' WHEN 'EUROPE' THEN 'kanagawa' END AS region FROM nation JOIN region ON n_regionkey = r_regionkey")
def n12(spark, sf):
    return normalize.with_region(B.spark_view(spark, sf, f"SELECT n_name, {_PREFS} AS prefecture FROM {{nation}} JOIN {{region}} ON n_regionkey = r_regionkey")).select("n_name", "prefecture", "region")


_KEY = f"regexp_replace(split_part(translate({{x}}, '（）ヶヵ', '()ケカ'), '(', 1), '^{R.WHITE}+|{R.WHITE}+$', '', 'g')"


@query("n13_station_key", f"WITH feed AS ({B.duck_view(B.FEED)}) SELECT name, {_KEY.format(x='name')} AS station_key, count(*) AS n FROM feed GROUP BY ALL")
def n13(spark, sf):
    return B.spark_view(spark, sf, B.FEED).groupBy("name", R.station_key(F.col("name")).alias("station_key")).agg(F.count("*").alias("n"))


_ADDRESS = """SELECT o_orderkey AS request_id, concat('{{"', CASE o_orderkey % 3 WHEN 0 THEN 'province' WHEN 1 THEN 'state' ELSE 'region' END, '":"',
  CASE o_orderkey % 10 WHEN 0 THEN 'Tokyo' WHEN 1 THEN 'Chiba' WHEN 2 THEN 'Saitama' WHEN 3 THEN 'Kanagawa' WHEN 4 THEN 'Kanagawa Prefecture' WHEN 5 THEN 'Saitama Prefecture' WHEN 6 THEN 'Chiba Prefecture' WHEN 7 THEN 'Tokyo Metropolis' WHEN 8 THEN '' ELSE o_orderstatus END,
  '",', CASE WHEN o_orderkey % 3 = 1 THEN '' WHEN o_orderkey % 7 = 0 THEN '"state":null,' ELSE '"state":"Tokyo",' END, '"suburb":"s","', CASE o_orderkey % 8 WHEN 0 THEN 'city' WHEN 1 THEN 'city_district' WHEN 2 THEN 'town' WHEN 3 THEN 'village' WHEN 4 THEN 'municipality' WHEN 5 THEN 'county' WHEN 6 THEN 'ward' ELSE 'road' END, '":"',
  CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE o_orderpriority END, CASE WHEN o_orderkey % 8 = 2 THEN '"}}' ELSE '","town":"t"}}' END) AS address FROM {orders}"""
_J = lambda key: f"json_extract_string(address, '$.{key}')"
_STATE = f"coalesce({_J('province')}, {_J('state')}, {_J('region')}, '')"
_PLACE = f"coalesce({_J('city_district')}, {_J('municipality')}, {_J('city')}, {_J('town')}, {_J('village')}, {_J('county')}, {_J('suburb')}, '')"


@query("n14_geocoded", f"WITH a AS ({B.duck_view(_ADDRESS)}) SELECT request_id, CASE WHEN {_STATE} IN ('Tokyo', 'Tokyo Metropolis') THEN '東京都' WHEN {_STATE} IN ('Saitama', 'Saitama Prefecture') THEN '埼玉県' WHEN {_STATE} IN ('Chiba', 'Chiba Prefecture') THEN '千葉県' WHEN {_STATE} IN ('Kanagawa', 'Kanagawa Prefecture') THEN '神奈川県' ELSE {_STATE} END AS prefecture, {_PLACE} AS municipality FROM a")
def n14(spark, sf):
    return normalize.geocoded(B.spark_view(spark, sf, _ADDRESS)).drop("address")


_REQ = f"WITH req AS ({B.duck_view(B.REQUESTS)})"


@query("n15_supported_split", f"{_REQ} SELECT request_id, prefecture IN (SELECT r_name FROM region) AS accepted FROM req")
def n15(spark, sf):
    known = spark.read.parquet(f"{sf}/region.parquet").select(F.col("r_name").alias("prefecture"))
    yes, no = normalize.split_supported(_requests(spark, sf), known)
    return yes.select("request_id", F.lit(True).alias("accepted")).unionByName(no.select("request_id", F.lit(False).alias("accepted")))


def _encoded(spark, sf, *columns):
    rows = clean(spark, sf, *columns)
    return cleaning.encode_categories(rows, cleaning.build_category_dictionary(rows))  # both read the written rows


_IDS = ", ".join(f"coalesce({c}_d.id, 0) AS {c}_id" for c in CATEGORIES)
_ID_JOINS = " ".join(f"LEFT JOIN dict {c}_d ON {c}_d.region = t.region AND {c}_d.feature = '{c}' AND {c}_d.value = t.{c}" for c in CATEGORIES)


@query("n16_feature_projection", f"{_DICT} SELECT t.l_orderkey AS key_order, t.l_linenumber AS key_line, area, age, floor(station_distance + 0.5) AS station_distance, CAST(transaction_year AS DOUBLE) AS transaction_year, {', '.join(f'CAST(coalesce({c}_d.id, 0) AS DOUBLE) AS {c}_id' for c in CATEGORIES)} FROM clean t {_ID_JOINS}")
def n16(spark, sf):
    return normalize.feature_projection(_encoded(spark, sf).withColumnsRenamed({"l_orderkey": "key_order", "l_linenumber": "key_line"}))


# ------------------------------------------------------------ outliers, dictionary, masks


@query("c01_remove_outliers", f"{_CLEAN} SELECT region, count(*) AS n, {_mean('price')} AS price, min(area) AS low, max(area) AS high FROM clean GROUP BY region")
def c01(spark, sf):
    return clean(spark, sf, "price").groupBy("region").agg(F.count("*").alias("n"), R.exact_mean(F.col("price")).alias("price"), F.min("area").alias("low"), F.max("area").alias("high"))


@query("c02_category_dictionary", f"{_DICT} SELECT region, feature, value, id FROM dict")
def c02(spark, sf):
    return _dictionary(spark, sf)


@query("c03_encode_categories", f"{_DICT} SELECT t.region, l_orderkey, l_linenumber, l_partkey, l_suppkey, {_IDS} FROM clean t {_ID_JOINS}")
def c03(spark, sf):
    return _encoded(spark, sf, *CATEGORIES, *KEYS[:4]).select("region", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *[f"{c}_id" for c in CATEGORIES])


@query("c04_time_holdout", f"{_CLEAN} SELECT region, transaction_year >= {START} AND transaction_year < {TEST} AS is_train, transaction_year = {TEST} AS is_test, count(*) AS n FROM clean GROUP BY ALL")
def c04(spark, sf):
    return cleaning.time_holdout(clean(spark, sf, "transaction_year"), START, TEST).groupBy("region", "is_train", "is_test").agg(F.count("*").alias("n"))


_ORDER = ", ".join(KEYS)


@query("c05_positional_holdout", f"{_CLEAN}, o AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY {_ORDER}) AS r, count(*) OVER (PARTITION BY region) AS n FROM clean) SELECT region, {_ORDER}, r > n - greatest(1, floor(n * 0.2)) AS is_test FROM o")
def c05(spark, sf):
    return cleaning.positional_holdout(clean(spark, sf, *KEYS), KEYS).select("region", *KEYS, "is_test")


@query("c06_tuning_split", f"{_CLEAN} SELECT region, transaction_year < {VALIDATION} AS is_fit, transaction_year = {VALIDATION} AS is_valid, count(*) AS n FROM clean WHERE transaction_year >= {START} AND transaction_year < {TEST} GROUP BY ALL")
def c06(spark, sf):
    rows = cleaning.time_holdout(clean(spark, sf, "transaction_year", *KEYS), START, TEST)
    return cleaning.tuning_split(rows, VALIDATION, KEYS).groupBy("region", "is_fit", "is_valid").agg(F.count("*").alias("n"))


@query("c07_deployment_window", f"{_CLEAN} SELECT region, transaction_year, count(*) AS n FROM clean WHERE transaction_year BETWEEN {START} AND {TEST} GROUP BY ALL")
def c07(spark, sf):
    return cleaning.deployment_window(clean(spark, sf, "transaction_year"), START, TEST).groupBy("region", "transaction_year").agg(F.count("*").alias("n"))


# ------------------------------------------------------------ joins and stations


_KM = "round(2 * 6371.0 * atan2(sqrt(h), sqrt(1 - h)), 6)"
_NEAR = f"""WITH st AS ({B.duck_view(B.STATIONS)}), po AS ({B.duck_view(B.POSITIONS)}),
pair AS (SELECT request_id, position, station_id, station_name, region, pow(sin(radians(st.lat - po.lat) / 2), 2) + cos(radians(po.lat)) * cos(radians(st.lat)) * pow(sin(radians(st.lon - po.lon) / 2), 2) AS h FROM po, st),
best AS (SELECT request_id, min(struct_pack(km := {_KM}, position := position)) AS best FROM pair GROUP BY request_id),
near AS (SELECT po.request_id, st.station_id, st.station_name, st.region AS station_region, b.best.km AS km FROM po LEFT JOIN best b ON b.request_id = po.request_id AND po.lat IS NOT NULL LEFT JOIN st ON st.position = b.best.position)"""


@query("j03_nearest_station", f"{_NEAR} SELECT request_id, station_id, station_name, station_region, km FROM near")
def j03(spark, sf):
    return stations.nearest_station(B.spark_view(spark, sf, B.POSITIONS), B.spark_view(spark, sf, B.STATIONS)).drop("walk_minutes")


@query("j04_walk_minutes", f"{_NEAR} SELECT request_id, CASE WHEN km IS NOT NULL THEN CAST(greatest(1, ceil(round(km * 1000 / 60, 6))) AS BIGINT) END AS walk_minutes FROM near")
def j04(spark, sf):
    return stations.nearest_station(B.spark_view(spark, sf, B.POSITIONS), B.spark_view(spark, sf, B.STATIONS)).select("request_id", "walk_minutes")


@query("j05_region_fallback", f"{_NEAR} SELECT request_id, coalesce(CASE WHEN request_id % 3 = 0 THEN 'GEOCODED' END, station_region, 'CURRENT') AS region FROM near")
def j05(spark, sf):
    near = stations.nearest_station(B.spark_view(spark, sf, B.POSITIONS), B.spark_view(spark, sf, B.STATIONS))
    rows = near.withColumns({"address_region": F.when(F.col("request_id") % 3 == 0, "GEOCODED"), "current_region": F.lit("CURRENT")})
    return stations.fallback_region(rows).select("request_id", "region")


def _feed(spark, sf):
    return B.spark_view(spark, sf, B.FEED)


def _names(spark, sf):
    names = B.spark_view(spark, sf, "SELECT r_name AS region, s_name AS value, CAST(s_suppkey AS BIGINT) AS id FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey WHERE s_suppkey % 3 <> 0")
    return names


_MASTER = f"""WITH feed AS ({B.duck_view(B.FEED)}),
names AS (SELECT r_name AS region, s_name AS value, s_suppkey AS id FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE s_suppkey % 3 <> 0),
dedup AS (SELECT * FROM feed QUALIFY row_number() OVER (PARTITION BY region, name, x, y ORDER BY feed_order) = 1),
numbered AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY feed_order) AS nth FROM dedup),
keyed AS (SELECT region, {_KEY.format(x='value')} AS k, arg_min(value, id) AS known FROM names GROUP BY ALL),
named AS (SELECT n.*, coalesce(k.known, n.name) AS station_name, n.region || '_' || lpad(CAST(n.nth AS STRING), CAST(greatest(4, length(CAST(n.nth AS STRING))) AS INTEGER), '0') AS station_id FROM numbered n LEFT JOIN keyed k ON n.region = k.region AND {_KEY.format(x='n.name')} = k.k),
master AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY station_name) AS position FROM (SELECT * FROM named QUALIFY row_number() OVER (PARTITION BY region, station_name ORDER BY nth) = 1))"""

@query("j06_canonical_names", f"{_MASTER} SELECT region, name, station_name, count(*) AS n FROM named GROUP BY ALL")
def j06(spark, sf):
    rows = stations.first_rows(_feed(spark, sf), ["region", "name", "x", "y"], "feed_order")
    return stations.canonical_names(rows, _names(spark, sf)).groupBy("region", "name", "station_name").agg(F.count("*").alias("n"))


@query("u04_feed_dedupe", f"{_MASTER} SELECT region, name, x, y, line, feed_order FROM dedup")
def u04(spark, sf):
    return stations.first_rows(_feed(spark, sf), ["region", "name", "x", "y"], "feed_order").select("region", "name", "x", "y", "line", "feed_order")


_M_COLS = "region, station_id, station_name, prefecture, line AS line_name, CAST(y AS DOUBLE) AS lat, CAST(x AS DOUBLE) AS lon, position"


@query("w04_w05_o02_station_master", f"{_MASTER} SELECT {_M_COLS} FROM master")
def w04(spark, sf):
    return stations.station_master(_feed(spark, sf), _names(spark, sf))


@query("u02_region_order", f"{_MASTER} SELECT station_id, row_number() OVER (ORDER BY region, station_name) AS position FROM master")
def u02(spark, sf):
    return stations.in_region_order(w04(spark, sf).drop("position")).select("station_id", "position")


@query("k05_station_master_json", f"{_MASTER} SELECT {_M_COLS} FROM master")
def k05(spark, sf):
    path, df = sources.scratch(spark, "stations"), w04(spark, sf)
    sources.write_json(df.repartition("region").sortWithinPartitions("region", "position"), path)
    return spark.read.schema(df.schema).json(path).select(*df.columns)


# ------------------------------------------------------------ aggregates and windows


@query("a01_quartiles", f"{_TX} SELECT region, round(quantile_cont(price, 0.25), 4) AS q1, round(quantile_cont(price, 0.75), 4) AS q3 FROM tx GROUP BY region")
def a01(spark, sf):
    return cleaning.iqr_bounds(tx(spark, sf), "price").select("region", F.round("q1", 4).alias("q1"), F.round("q3", 4).alias("q3"))


query("a02_price_history", f"{_HISTORY} SELECT region, station, year, floor(avg_price * 100 + 0.5) / 100 AS avg_price FROM history")(price_history)


def _history(spark, sf):
    """One row a region, station and year, written once since its readers read it several times."""
    return materialized(history.price_history(clean(spark, sf, "station", "transaction_year")), "history")


@query("a03_region_history", f"{_TREND} SELECT region, year, floor(avg_price * 100 + 0.5) / 100 AS avg_price FROM rhist")
def a03(spark, sf):
    return history.region_history(_history(spark, sf)).select("region", "year", R.rounded(F.col("avg_price"), 2).alias("avg_price"))


_MODEL = f"""{_CLEAN}, model AS (SELECT region, floor({_mean('price')} * 100 + 0.5) / 100 AS prediction FROM clean WHERE transaction_year >= {START} AND transaction_year < {TEST} GROUP BY region),
scored AS (SELECT t.*, prediction FROM clean t JOIN model USING (region) WHERE transaction_year = {TEST})"""


def _baseline(spark, sf):
    rows = cleaning.time_holdout(clean(spark, sf, "transaction_year"), START, TEST)
    model = history.mean_model(rows.filter("is_train")).select("region", R.rounded(F.col("prediction"), 2).alias("prediction"))
    return rows.filter("is_test").join(model, "region")


@query("a04_m03_metrics", f"{_MODEL} SELECT region, round(avg(abs(price - prediction)), 1) AS mae, round(sqrt(avg((price - prediction) * (price - prediction))), 1) AS rmse, round(coalesce(100 * avg(CASE WHEN price <> 0 THEN abs((price - prediction) / price) END), 0), 4) AS mape FROM scored GROUP BY region")
def a04(spark, sf):
    return history.metrics(_baseline(spark, sf), ["region"]).select("region", F.round("mae", 1).alias("mae"), F.round("rmse", 1).alias("rmse"), F.round("mape", 4).alias("mape"))


@query("a05_counts", f"{_CLEAN} SELECT region, count(*) AS records, count_if(transaction_year >= {START} AND transaction_year < {TEST}) AS train, count_if(transaction_year = {TEST}) AS test, count_if(transaction_year BETWEEN {START} AND {TEST}) AS deploy FROM clean GROUP BY region")
def a05(spark, sf):
    rows = cleaning.time_holdout(clean(spark, sf, "transaction_year"), START, TEST)
    return rows.groupBy("region").agg(F.count("*").alias("records"), F.count_if("is_train").alias("train"), F.count_if("is_test").alias("test"), F.count_if(F.col("transaction_year").between(START, TEST)).alias("deploy"))


@query("a06_distinct_values", f"{_CLEAN} SELECT region, {', '.join(f'count(DISTINCT {c}) AS {c}' for c in CATEGORIES)} FROM clean GROUP BY region")
def a06(spark, sf):
    counts = _dictionary(spark, sf).groupBy("region").agg(*[F.count_if(F.col("feature") == c).alias(c) for c in CATEGORIES])
    return counts


@query("a07_mean_model", f"{_MODEL} SELECT region, prediction FROM model")
def a07(spark, sf):
    rows = cleaning.time_holdout(clean(spark, sf, "transaction_year"), START, TEST)
    return history.mean_model(rows.filter("is_train")).select("region", R.rounded(F.col("prediction"), 2).alias("prediction"))


@query("a08_trend", f"{_TREND} SELECT region, station, floor(trend * 100 + 0.5) / 100 AS trend FROM trend")
def a08(spark, sf):
    return history.trend(_history(spark, sf), ["region", "station"], 2001).select("region", "station", R.rounded(F.col("trend"), 2).alias("trend"))


@query("w01_delta", f"{_HISTORY}, {_POINTS} SELECT region, station, year, floor(delta * 100 + 0.5) / 100 AS delta FROM points")
def w01(spark, sf):
    return history.deltas(_history(spark, sf).filter("year <= 2001"), ["region", "station"]).select("region", "station", "year", R.rounded(F.col("delta"), 2).alias("delta"))


@query("w02_last_points", f"{_HISTORY}, {_POINTS} SELECT region, station, year, from_end FROM points WHERE from_end <= 4")
def w02(spark, sf):
    return history.deltas(_history(spark, sf).filter("year <= 2001"), ["region", "station"]).filter("from_end <= 4").select("region", "station", "year", "from_end")


# ------------------------------------------------------------ scores and forecasts


_LINEAR = "greatest(18000000.0 + 850000 * area - 320000 * age - 180000 * station_distance + 450000 * ({y} - 2001), 1000000.0)"
_SCORED = f"{_REQ}, scored AS (SELECT *, {_LINEAR.format(y='year')} AS prediction FROM req)"


@query("m08_linear_score", f"{_SCORED} SELECT request_id, prediction FROM scored")
def m08(spark, sf):
    return _requests(spark, sf).select("request_id", scoring.linear_score(2001)(F.col("year")).alias("prediction"))


@query("m07_price_band", f"{_SCORED} SELECT request_id, CASE WHEN area > 0 THEN prediction / area ELSE 0 END AS unit_price, greatest(0, prediction - mae) AS lower, prediction + mae AS upper FROM scored")
def m07(spark, sf):
    rows = _requests(spark, sf).withColumn("prediction", scoring.linear_score(2001)(F.col("year")))
    return scoring.band(rows).select("request_id", "unit_price", "lower", "upper")


@query("m10_long_range", f"{_REQ} SELECT request_id, year > 2011 AS long_range FROM req")
def m10(spark, sf):
    return _requests(spark, sf).select("request_id", (F.col("year") > 2001 + scoring.LONG_RANGE_YEARS).alias("long_range"))


_WITH_TREND = f"{_TREND}, req AS ({B.duck_view(B.REQUESTS)}), asked AS (SELECT r.*, coalesce(t.trend, q.rtrend, 0.0) AS trend FROM req r LEFT JOIN trend t ON r.region = t.region AND r.station = t.station LEFT JOIN rtrend q ON r.region = q.region)"


@query("j08_trend_fallback", f"{_WITH_TREND} SELECT request_id, floor(trend * 100 + 0.5) / 100 AS trend FROM asked")
def j08(spark, sf):
    return scoring.with_trend(_requests(spark, sf), _history(spark, sf), 2001).select("request_id", R.rounded(F.col("trend"), 2).alias("trend"))


_FORE = f"""{_WITH_TREND}, years AS (SELECT *, unnest(CASE WHEN year > 2001 THEN range(2002, year + 1) ELSE [CAST(year AS BIGINT)] END) AS forecast_year FROM asked),
fore AS (SELECT *, CASE WHEN year <= 2001 THEN {_LINEAR.format(y='year')} ELSE greatest(1000000.0, {_LINEAR.format(y='2001')} + trend * (forecast_year - 2001)) END AS prediction FROM years)"""


def _forecast(spark, sf, past=None):
    return scoring.forecast(_requests(spark, sf), past if past is not None else _history(spark, sf), 2001, scoring.linear_score(2001))


@query("m09_g01_forecast", f"{_FORE} SELECT request_id, forecast_year, round(prediction, 1) AS prediction, round(greatest(0, prediction - mae), 1) AS lower, round(prediction + mae, 1) AS upper FROM fore")
def m09(spark, sf):
    return _forecast(spark, sf).select("request_id", "forecast_year", *[F.round(c, 1).alias(c) for c in ("prediction", "lower", "upper")])


_CHART = f"""{_FORE}, fp AS (SELECT region, station, CAST(forecast_year AS INTEGER) AS year, max(prediction) AS avg_price FROM fore WHERE request_id % 7 <> 0 GROUP BY ALL),
ap AS (SELECT region, station, year, max(prediction) AS avg_price FROM fore WHERE forecast_year = year GROUP BY ALL),
series AS (SELECT region, station, year, avg_price, 'actual' AS kind FROM history UNION ALL SELECT *, 'forecast' FROM fp ANTI JOIN history USING (region, station, year)),
chart AS (SELECT * FROM series UNION ALL SELECT *, 'forecast' FROM ap ANTI JOIN series USING (region, station, year))"""


def _chart(spark, sf):
    past = _history(spark, sf)
    rows = materialized(_forecast(spark, sf, past), "forecast")
    ahead = rows.filter("request_id % 7 <> 0").groupBy("region", "station", F.col("forecast_year").alias("year")).agg(F.max("prediction").alias("avg_price"))
    asked = rows.filter("forecast_year = year").groupBy("region", "station", "year").agg(F.max("prediction").alias("avg_price"))
    return past, ahead, scoring.chart_series(past, ahead, asked)


@query("j09_missing_years", f"{_CHART} SELECT region, station, year, round(avg_price, 1) AS avg_price FROM fp ANTI JOIN history USING (region, station, year)")
def j09(spark, sf):
    past, ahead, _ = _chart(spark, sf)
    return scoring.missing_years(ahead, past).select("region", "station", "year", F.round("avg_price", 1).alias("avg_price"))


@query("u03_chart_series", f"{_CHART} SELECT region, station, year, round(avg_price, 1) AS avg_price, kind FROM chart")
def u03(spark, sf):
    return _chart(spark, sf)[2].select("region", "station", "year", F.round("avg_price", 1).alias("avg_price"), "kind")


@query("o01_series_by_year", f"{_HISTORY} SELECT region, station, year, floor(avg_price * 100 + 0.5) / 100 AS avg_price FROM history ORDER BY region, station, year")
def o01(spark, sf):
    return price_history(spark, sf).orderBy("region", "station", "year")


@query("w07_forecast_line", f"{_CHART}, l AS (SELECT *, max(CASE WHEN kind = 'actual' THEN year END) OVER (PARTITION BY region, station) AS last_actual FROM chart) SELECT region, station, year, kind, last_actual, kind = 'forecast' OR coalesce(year = last_actual, false) AS on_line FROM l")
def w07(spark, sf):
    return scoring.forecast_line(_chart(spark, sf)[2]).select("region", "station", "year", "kind", "last_actual", F.coalesce("on_line", F.lit(False)).alias("on_line"))


@query("m13_expanding_folds", f"{_CLEAN}, folds AS (SELECT t.*, f.fold FROM clean t, (SELECT unnest([1999, 2000, 2001]) AS fold) f), fm AS (SELECT region, fold, floor({_mean('price')} * 100 + 0.5) / 100 AS prediction FROM folds WHERE transaction_year >= {START} AND transaction_year < fold GROUP BY ALL) SELECT region, fold, round(avg(abs(price - prediction)), 1) AS mae, count(*) AS n FROM folds JOIN fm USING (region, fold) WHERE transaction_year = fold GROUP BY ALL")
def m13(spark, sf):
    rows = cleaning.expanding_folds(clean(spark, sf, "transaction_year"), START, 1999, 2001)
    models = rows.filter("is_train").groupBy("region", "fold").agg(R.rounded(R.exact_mean(F.col("price")), 2).alias("prediction"))
    test = rows.filter("is_test").join(models, ["region", "fold"])
    return test.groupBy("region", "fold").agg(F.round(F.avg(F.abs(F.col("price") - F.col("prediction"))), 1).alias("mae"), F.count("*").alias("n"))


# ------------------------------------------------------------ registry


_EXP = f"""{_TX}, mm AS (SELECT region, floor({_mean('price')} * 100 + 0.5) / 100 AS prediction FROM tx GROUP BY region), er AS (SELECT tx.region, n_nationkey AS model_id, floor({_mean('abs(price - prediction)')} * 100 + 0.5) / 100 AS mae FROM tx JOIN mm USING (region) GROUP BY ALL),
b AS (SELECT *, min(mae) OVER (PARTITION BY region ORDER BY model_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM er),
won AS (SELECT region, model_id, mae, best IS NULL OR mae < best AS became_latest FROM b),
latest AS (SELECT *, model_id = max(CASE WHEN became_latest THEN model_id END) OVER (PARTITION BY region) AS is_latest FROM won)"""


@query("w06_latest_model", f"{_EXP} SELECT region, model_id, mae, became_latest, is_latest FROM latest")
def w06(spark, sf):
    return registry.latest_models(_experiments(spark, sf))


@query("m11_k07_publishable", f"{_EXP} SELECT region, model_id, 'best' AS policy FROM latest WHERE is_latest UNION ALL SELECT region, max(model_id), 'latest' FROM latest GROUP BY region")
def m11(spark, sf):
    models = _experiments(spark, sf)
    best = registry.publishable(models).withColumn("policy", F.lit("best"))
    return best.unionByName(registry.publishable(models, "latest").withColumn("policy", F.lit("latest")))


@query("j10_current_best", f"{_EXP} SELECT region, model_id, mae FROM latest WHERE is_latest")
def j10(spark, sf):
    rows = _experiments(spark, sf)
    models = rows.select("region", "model_id", (F.col("model_id") + 1000).alias("experiment_id"))
    return registry.current_best(models, rows.select((F.col("model_id") + 1000).alias("experiment_id"), "mae"))


_WANT = """(SELECT o_orderkey % 500 AS experiment_id, o_orderpriority AS feature_name FROM orders) w JOIN (SELECT o_orderpriority AS feature_name, min(o_orderkey) AS feature_id FROM orders GROUP BY ALL) f USING (feature_name)"""


@query("j11_feature_links", f"SELECT DISTINCT experiment_id, feature_id FROM {_WANT} WHERE NOT (experiment_id % 5 = 0)")
def j11(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    wanted = orders.select((F.col("o_orderkey") % 500).alias("experiment_id"), F.col("o_orderpriority").alias("feature_name"))
    names = orders.groupBy(F.col("o_orderpriority").alias("feature_name")).agg(F.min("o_orderkey").alias("feature_id"))
    have = wanted.filter("experiment_id % 5 = 0").join(names, "feature_name").select("experiment_id", "feature_id").distinct()
    return registry.new_feature_links(wanted, names, have)


@query("m12_experiment_state", "SELECT o_custkey AS experiment_id, arg_max(o_orderstatus, o_orderkey) AS status, arg_max(o_totalprice, o_orderkey) AS mae FROM orders GROUP BY o_custkey")
def m12(spark, sf):
    events = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_custkey").alias("experiment_id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("mae"), F.col("o_orderkey").alias("event_order"))
    return registry.experiment_state(events)


# ------------------------------------------------------------ sources and sinks


@query("u01_k01_r07_processed", f"{_CLEAN} SELECT region, transaction_year, station, count(*) AS n, CAST(NULL AS VARCHAR) AS only_here FROM clean WHERE transaction_year <= 1999 GROUP BY ALL UNION ALL SELECT region, transaction_year, station, count(*), 'x' FROM clean WHERE transaction_year > 1999 GROUP BY ALL")
def u01(spark, sf):
    rows, path = clean(spark, sf), sources.scratch(spark, "processed")
    parts = [rows.filter("transaction_year <= 1999"), rows.filter("transaction_year > 1999").withColumn("only_here", F.lit("x"))]
    sources.write_processed(sources.union_all(parts), path)
    back = sources.read_processed(spark, path + "-absent", path)
    return back.groupBy("region", "transaction_year", "station", "only_here").agg(F.count("*").alias("n"))


@query("k02_r08_history_json", f"{_HISTORY} SELECT region, station, year, floor(avg_price * 100 + 0.5) / 100 AS avg_price FROM history")
def k02(spark, sf):
    path = sources.scratch(spark, "history")
    sources.write_json(price_history(spark, sf), path)
    return spark.read.schema("region string, station string, year int, avg_price double").json(path).select("region", "station", "year", "avg_price")


@query("k03_r08_dictionary_json", f"{_DICT} SELECT region, feature, value, id FROM dict")
def k03(spark, sf):
    path = sources.scratch(spark, "dictionary")
    sources.write_json(sources.dictionary_documents(_dictionary(spark, sf)), path)
    return sources.read_dictionary(spark, path)


_QUARTER = "CASE WHEN l_linenumber % 2 = 0 THEN CAST(l_linenumber % 4 + 1 AS INTEGER) END"


@query("r06_landing_layout", f"{_RAW} SELECT raw_prefecture AS region, {_year('raw_period')} AS year, {_QUARTER} AS quarter, count(*) AS n, count(nullif(raw_price, '')) AS priced FROM raw WHERE raw_prefecture IN ('ASIA', 'EUROPE') AND {_year('raw_period')} >= 1997 GROUP BY ALL")
def r06(spark, sf):
    """Files laid out by region and year, half of them by quarter too, read for two regions and some years."""
    path = sources.scratch(spark, "landing")
    rows = _raw(spark, sf).select("raw_price", F.col("raw_prefecture").alias("region"), R.transaction_year(F.col("raw_period")).alias("year"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_linenumber") % 4 + 1).cast("int").alias("quarter")).filter("year is not null")
    rows.filter("quarter is null").drop("quarter").write.partitionBy("region", "year").csv(path)
    rows.filter("quarter is not null").write.mode("append").partitionBy("region", "year", "quarter").csv(path)
    back = sources.read_landed(spark, path, "raw_price string", ["ASIA", "EUROPE"], list(range(1997, 2030)))
    return back.groupBy("region", "year", "quarter").agg(F.count("*").alias("n"), F.count("raw_price").alias("priced"))


def _record(district: str) -> Column:
    """A row as the API names its fields."""
    return F.struct(F.col("raw_price").alias("TradePrice"), F.col("raw_area").alias("Area"), F.col("raw_period").alias("period"), F.col("raw_built").alias("BuildingYear"), F.col("raw_walk").alias("TimeToNearestStation"), F.col("raw_prefecture").alias("Prefecture"), F.col("raw_municipality").alias("Municipality"), F.col("raw_station").alias("NearestStation"), F.lit(district).alias("DistrictName"), F.col("raw_layout").alias("FloorPlan"), F.col("raw_structure").alias("Structure"))


def _wrapped(spark, sf, compressed: bool = False) -> str:
    """API payloads of all rows, in five shapes, each with an entry that is no record."""
    path = sources.scratch(spark, "api")
    rows = _raw(spark, sf).select(F.to_json(_record("district")).alias("value"))
    _payloads(rows, path, ("[{}]", *('{{"' + k + '":[{}]}}' for k in sources.WRAPPERS)), ',"not a record"', compressed)
    return path


@query("r04_api_json", f"{_RAW}, p AS (SELECT {_num('raw_price')} AS price, {_num('raw_area')} AS area, {_AGE} AS age, CAST({_walk('raw_walk')} AS DOUBLE) AS station_distance, coalesce(nullif(raw_station, ''), 'district') AS station FROM raw) SELECT station, count(*) AS n, count(price) AS priced, count(age) AS aged, sum(area) AS area, sum(station_distance) AS walk FROM p GROUP BY ALL")
def r04(spark, sf):
    parsed = normalize.require(normalize.normalize_api(sources.read_api_json(spark, [_wrapped(spark, sf, compressed=True)])))
    return parsed.groupBy("station").agg(F.count("*").alias("n"), F.count("price").alias("priced"), F.count("age").alias("aged"), F.sum("area").alias("area"), F.sum("station_distance").alias("walk"))


@query("r09_station_feed", f"WITH feed AS ({B.duck_view(B.FEED)}) SELECT name, prefecture, line, x, y FROM feed")
def r09(spark, sf):
    path = sources.scratch(spark, "feed")
    _feed(spark, sf).select("name", "prefecture", "line", "x", "y").write.json(path)
    return spark.read.schema("name string, prefecture string, line string, x string, y string").json(path)


#: Landed files are gzipped: they are read as a whole anyway, and texts of many equal words shrink well at the fastest level.
_GZIPPED = {"compression": "gzip", "zlib.compress.level": "BEST_SPEED"}


def _landed(spark, rows: DataFrame, encoding: str) -> str:
    path = sources.scratch(spark, "csv")
    with sources._JapaneseCharsets(spark):
        rows.write.option("header", True).option("encoding", encoding).options(**_GZIPPED).csv(path)
    return path


def _payloads(df: DataFrame, path: str, shapes: tuple[str, ...] = ("[{}]",), tail: str = "", compressed: bool = False) -> None:
    """JSON records as payloads of the API, a list a batch of rows, gzipped if asked for; shapes take turns, the first batch of a task has them all."""
    suffix = "json.gz" if compressed else "json"

    def run(batches):
        from pyarrow import fs

        task = TaskContext.get().partitionId()
        store, root = fs.FileSystem.from_uri(path)
        store.create_dir(root, recursive=True)
        n = 0
        for k, batch in enumerate(batches):
            records, parts = batch["value"].tolist(), 1 if k else len(shapes)
            for own in filter(None, (records[i::parts] for i in range(parts))):
                payload = shapes[n % len(shapes)].format(",".join(own) + tail).encode()
                with store.open_output_stream(f"{root}/{task:05d}-{n:05d}.{suffix}", compression=None) as out:
                    out.write(gzip.compress(payload, 1) if compressed else payload)
                n += 1
        yield pd.DataFrame({"task": [task]})

    df.mapInPandas(run, "task int").write.format("noop").mode("overwrite").save()


def _zipped(df: DataFrame, path: str) -> None:
    """Rows as archives of one CSV member each, a task an archive: a landing folder of bulk downloads."""
    names = df.columns

    def run(batches):
        from pyarrow import fs

        task = TaskContext.get().partitionId()
        store, root = fs.FileSystem.from_uri(path)
        store.create_dir(root, recursive=True)
        with store.open_output_stream(f"{root}/{task:05d}.zip", compression=None) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
            archive.writestr("readme.txt", "not a table")
            with archive.open("rows.CSV", "w") as member:
                first = True
                for batch in batches:
                    member.write(batch.to_csv(index=False, header=first).encode(archives.JAPANESE if task % 2 else "utf-8"))
                    first = False
                if first:
                    member.write((",".join(names) + "\n").encode())
        yield pd.DataFrame({"task": [task]})

    df.mapInPandas(run, "task int").write.format("noop").mode("overwrite").save()


_LAYOUT = "coalesce(nullif(raw_layout, ''), 'unknown')"


@query("r01_r05_mixed_csv", f"{_RAW} SELECT {_LAYOUT} AS room_layout, 2 * count(*) AS n, 2 * count({_num('raw_price')}) AS priced FROM raw WHERE raw_kind = '中古マンション等' GROUP BY ALL")
def r01(spark, sf):
    path = sources.scratch(spark, "raw")  # joined once for both
    _csv_view(_raw(spark, sf)).write.option("compression", "zstd").parquet(path)
    rows = spark.read.parquet(path)
    paths = [_landed(spark, rows, "UTF-8"), _landed(spark, rows, sources.JAPANESE)]
    stores.remove(spark, path)
    df = normalize.require(sources.read_transactions(spark, paths))
    return df.groupBy("room_layout").agg(F.count("*").alias("n"), F.count("price").alias("priced"))


@query("r03_r05_mixed_folder", f"{_RAW}, p AS ({_PARSED.replace('{keys}', 'l_linenumber')}), u AS (SELECT * FROM p WHERE raw_kind = '中古マンション等' OR l_linenumber > 3) SELECT coalesce(prefecture, '') AS prefecture, coalesce(station, 'district') AS station, count(*) AS n, count(price) AS priced, count(age) AS aged, sum(area) AS area, sum(station_distance) AS walk FROM u GROUP BY ALL")
def r03(spark, sf):
    """One folder with plain files in two encodings, archives, and payloads of the API below it."""
    root = sources.scratch(spark, "mixed")
    raw = _raw(spark, sf)
    with sources._JapaneseCharsets(spark):
        _csv_view(raw.filter("l_linenumber = 1")).write.option("header", True).option("encoding", sources.JAPANESE).options(**_GZIPPED).csv(f"{root}/japanese")
    _csv_view(raw.filter("l_linenumber = 2")).write.option("header", True).options(**_GZIPPED).csv(f"{root}/plain")
    _zipped(_csv_view(raw.filter("l_linenumber = 3")), f"{root}/archives")
    _payloads(raw.filter("l_linenumber > 3").select(F.to_json(_record("district")).alias("value")), f"{root}/api", compressed=True)
    df = normalize.require(sources.read_transactions(spark, [root]))
    return df.groupBy(F.coalesce("prefecture", F.lit("")).alias("prefecture"), F.coalesce("station", F.lit("district")).alias("station")).agg(F.count("*").alias("n"), F.count("price").alias("priced"), F.count("age").alias("aged"), F.sum("area").alias("area"), F.sum("station_distance").alias("walk"))


@query("r02_transcode", f"{_RAW} SELECT raw_kind AS kind, count(*) AS n FROM raw GROUP BY ALL")
def r02(spark, sf):
    target = sources.scratch(spark, "utf8")
    sources.transcode_to_utf8(spark, [_landed(spark, _csv_view(_raw(spark, sf)), sources.JAPANESE)], target, "gzip")
    return spark.read.option("header", True).csv(target).groupBy("種類").agg(F.count("*").alias("n")).withColumnRenamed("種類", "kind")


# ------------------------------------------------------------ models and providers


def _regional(spark, sf):
    """Encoded rows with their holdout marks, written once by region, and the sizes of each region that has training rows.

    Equal rows are one with their number (``rows``) from the joined facts on, so what follows
    grows with different rows. Columns that no model reads are not carried along.
    """
    facts = tx(spark, sf).groupBy("region", "price", *training.NUMBERS, *CATEGORIES).agg(F.count("*").alias("rows"))
    cleaned = cleaning.remove_iqr_outliers(materialized(facts, "transactions"), weight="rows")
    dictionary = materialized(cleaning.build_category_dictionary(cleaned), "dictionary")
    marked = cleaning.time_holdout(cleaning.encode_categories(cleaned, dictionary), START, TEST)
    path = sources.scratch(spark, "regional")
    marked.drop(*CATEGORIES).write.partitionBy("region").parquet(path)
    rows = spark.read.schema(marked.drop(*CATEGORIES).schema).parquet(path)
    sizes = training.sizes_by_region(dictionary)
    fitted = [r[0] for r in rows.filter(F.col("is_train") & F.col("region").isNotNull()).select("region").distinct().orderBy("region").collect()]
    return rows, {r: sizes[r] for r in fitted}


def _of(rows, region):
    return rows.filter(F.col("region") == region)


def _trained(spark, sf):
    """(rows, models, root, sizes): a model a region, saved below root."""
    rows, sizes = _regional(spark, sf)
    models = training.train_regions({r: _of(rows, r).filter("is_train") for r in sizes}, sizes)
    root = sources.scratch(spark, "models")
    training.save_regions(models, root)
    return rows, models, root, sizes


def _scored(rows, root):
    """The rows of all regions by the saved trees of their region, in one scan."""
    spark = rows.sparkSession
    return forest.score(rows, forest.saved_nodes(spark, root), training.INPUTS, forest.saved_depth(spark, root))


#: The regions that have training rows, and so a model.
_REGIONAL = f"{_CLEAN}, fitted AS (SELECT * FROM clean WHERE region IN (SELECT region FROM clean WHERE transaction_year >= {START} AND transaction_year < {TEST}))"


@query("m01_m06_train_and_score")
def m01(spark, sf):
    rows, _, root, _ = _trained(spark, sf)
    return history.metrics(_scored(rows.filter("is_test"), root), ["region"], weight="rows")


@query("m01_m06_against_the_mean", f"{_REGIONAL} SELECT region, count(*) AS n, true AS no_worse FROM fitted WHERE transaction_year = {TEST} GROUP BY region")
def m01_mean(spark, sf):
    """Test rows of each region, and whether the trees err no more than the mean of the training rows."""
    rows, _, root, _ = _trained(spark, sf)
    means = history.mean_model(rows.filter("is_train"), weight="rows").withColumnRenamed("prediction", "mean")
    scored = _scored(rows.filter("is_test"), root).join(means, "region")
    trees, mean = (R.mean(F.abs(F.col("price") - F.col(c)), "rows") for c in ("prediction", "mean"))
    return scored.groupBy("region").agg(F.sum("rows").alias("n"), (trees <= mean).alias("no_worse"))


def _importance(spark, sf):
    return reduce(DataFrame.unionByName, [training.feature_importance(spark, m, r) for r, m in _trained(spark, sf)[1].items()])


@query("m05_o03_feature_importance")
def m05(spark, sf):
    nth = F.row_number().over(Window.partitionBy("region").orderBy(F.desc("importance"), "feature"))  # nine rows a region
    return _importance(spark, sf).withColumn("nth", nth).filter("nth <= 5").drop("nth")  # the report's top five


@query("m05_o03_importance_sums", f"{_REGIONAL} SELECT DISTINCT region, {len(training.INPUTS)}::BIGINT AS features, 1.0::DOUBLE AS total, 0::BIGINT AS negative FROM fitted")
def m05_sums(spark, sf):
    """How many features each model weighs, the sum of their importances, and how many are negative."""
    return _importance(spark, sf).groupBy("region").agg(F.count("*").alias("features"), F.round(F.sum("importance"), 6).alias("total"), F.count_if(F.col("importance") < 0).alias("negative"))


def _tuned(spark, sf):
    """(trials, deployed): the trials of all regions, and region and trees of the models deployed by the best."""
    rows, sizes = _regional(spark, sf)
    splits = {r: _of(rows, r).filter("is_train").withColumns({"is_fit": F.col("transaction_year") < VALIDATION, "is_valid": F.col("transaction_year") == VALIDATION}) for r in sizes}
    best, trials = training.tune_regions(splits, sizes)
    nodes = training.deploy_regions({r: cleaning.deployment_window(_of(rows, r), START, TEST) for r in sizes}, sizes, best, sources.scratch(spark, "deployed"))
    return trials, nodes.groupBy("region").agg(F.countDistinct("tree").cast("int").alias("deployed_trees"))


@query("m02_m04_tune_and_deploy", f"{_REGIONAL} SELECT region, {training.TRIALS}::BIGINT AS trials, {training.TRIALS}::BIGINT AS penalised, true AS best_deployed FROM (SELECT DISTINCT region FROM fitted)")
def m02(spark, sf):
    """Trials of each region, those whose score holds the penalty, and whether the deployed model has the trees of the best."""
    trials, deployed = _tuned(spark, sf)
    right = F.abs(F.col("score") - F.col("validation_mae") - F.col("best_iteration") * 250.0) < 1e-6
    found = trials.groupBy("region").agg(F.count("*").alias("trials"), F.count_if(right).alias("penalised"), F.min_by("best_iteration", F.struct("score", "trial")).alias("wanted"))
    return found.join(F.broadcast(deployed), "region").select("region", "trials", "penalised", (F.col("wanted") == F.col("deployed_trees")).alias("best_deployed"))


@query("k06_saved_models", f"{_REGIONAL} SELECT region, count(*) AS n, 0::BIGINT AS different FROM fitted WHERE transaction_year = {TEST} GROUP BY region")
def k06(spark, sf):
    """Test rows scored by the saved trees, and how many a model read back scores differently."""
    rows, _, root, sizes = _trained(spark, sf)
    test = rows.filter("is_test").select("region", "rows", *training.INPUTS)
    read = {unquote(n.removeprefix("region=")): training.PipelineModel.load(f"{root}/{n}") for n in stores.names(spark, root)}
    # the rows that the models have scored are scored by the tables, so neither is joined to the other
    own = reduce(DataFrame.unionByName, [m.transform(training.nominal(_of(test, r), sizes[r])).select("region", "rows", *training.INPUTS, F.col("prediction").alias("own")) for r, m in read.items()])
    different = F.abs(F.col("prediction") - F.col("own")) > 1e-9 * F.abs(F.col("own"))
    return _scored(own, root).groupBy("region").agg(F.sum("rows").alias("n"), R.count_if(different, "rows").alias("different"))


@query("k04_k06_metadata_and_model")
def k04(spark, sf):
    rows, models, root, _ = _trained(spark, sf)
    marked = rows.withColumn("timed", F.lit(True))
    errors = history.metrics(_scored(rows.filter("is_test"), root), ["region"], weight="rows")
    importance = reduce(DataFrame.unionByName, [training.feature_importance(spark, m, r) for r, m in models.items()])
    docs = metadata.documents(metadata.split_counts(marked, START, TEST, weight="rows").join(errors, "region"), "2001-12-31", START, TEST, TEST, {"seed": 42}, {"enabled": False, "n_trials": training.TRIALS}, importance)
    path = sources.scratch(spark, "metadata")
    metadata.write_metadata(docs, path)
    counts = rows.groupBy("region").agg(F.sum("rows").alias("records"))
    return metadata.read_metadata(spark, path).join(counts, "region").select("region", "records", F.col("evaluation.trainCount").alias("train"), F.col("evaluation.testCount").alias("test"), F.round("mae", 1).alias("mae"))


@query("x01_x02_feature_providers", f"{_CLEAN}, m AS (SELECT station, {_mean('price')} AS station_price FROM clean GROUP BY station) SELECT station, transaction_year, count(*) AS n, floor(any_value(station_price) * 100 + 0.5) / 100 AS station_price FROM clean JOIN m USING (station) GROUP BY ALL")
def x01(spark, sf):
    df, _ = features.run_providers(clean(spark, sf), [*features.built_in(), features.GroupMean("station", "price", "station_price")])
    return df.groupBy("station", "transaction_year").agg(F.count("*").alias("n"), R.rounded(F.any_value("station_price"), 2).alias("station_price"))


@query("j07_region_tables", f"{_REQ}, {_MODEL.removeprefix('WITH ')} SELECT request_id, r.region, prediction FROM req r JOIN model m ON r.region = m.region")
def j07(spark, sf):
    return _requests(spark, sf).join(a07(spark, sf), "region").select("request_id", "region", "prediction")


