"""Views of the given star-schema tables as transactions, stations and requests.

Each is one SQL text that Spark and DuckDB both run; ``{name}`` stands for a table.
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession

KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate"]
_K = ", ".join(KEYS)
START, VALIDATION, TEST = 1996, 2000, 2001

TX = f"""
SELECT r_name AS region, r_name AS prefecture, n_name AS municipality, s_name AS station,
  p_retailprice * l_quantity * (1 + CAST(p_size AS DOUBLE) / 10) AS price,
  l_quantity * (CASE WHEN l_partkey % 97 = 0 THEN 6 ELSE 1 END) AS area,
  CAST(p_size AS DOUBLE) AS age, CAST(l_partkey % 30 + 1 AS DOUBLE) AS station_distance,
  p_brand AS room_layout, p_type AS building_type, CAST(year(o_orderdate) AS INT) AS transaction_year, n_nationkey, {_K}
FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey
JOIN {{part}} ON l_partkey = p_partkey JOIN {{supplier}} ON l_suppkey = s_suppkey
JOIN {{nation}} ON s_nationkey = n_nationkey JOIN {{region}} ON n_regionkey = r_regionkey
"""

RAW = f"""
SELECT {_K}, r_name AS raw_prefecture, n_name AS raw_municipality, CASE WHEN l_suppkey % 9 = 0 THEN '' ELSE s_name END AS raw_station,
  CASE WHEN l_partkey % 10 = 0 THEN '宅地(土地)' ELSE '中古マンション等' END AS raw_kind,
  CASE WHEN l_partkey % 13 = 0 THEN '' ELSE concat(CAST(CAST(floor(l_extendedprice) AS BIGINT) AS STRING), ',000') END AS raw_price,
  CASE WHEN l_partkey % 3 = 0 THEN concat(CAST(CAST(l_quantity AS INT) AS STRING), '㎡以上') WHEN l_partkey % 3 = 1 THEN translate(CAST(CAST(l_quantity AS INT) AS STRING), '0123456789', '０１２３４５６７８９') ELSE CAST(CAST(l_quantity AS INT) AS STRING) END AS raw_area,
  CASE WHEN l_orderkey % 50 = 0 THEN '' ELSE concat(CAST(CAST(year(o_orderdate) AS INT) AS STRING), '年第1四半期') END AS raw_period,
  CASE p_size % 6 WHEN 0 THEN concat('平成', CAST(p_size AS STRING), '年') WHEN 1 THEN concat('昭和', CAST(p_size AS STRING), '年') WHEN 2 THEN concat(CAST(1950 + p_size AS STRING), '年') WHEN 3 THEN '平成元年' WHEN 4 THEN concat('令和', CAST(p_size AS STRING), '年') ELSE '戦前' END AS raw_built,
  CASE l_linenumber WHEN 1 THEN '30分～60分' WHEN 2 THEN '1H～1H30' WHEN 3 THEN '2H～' WHEN 4 THEN '' WHEN 5 THEN '1時間以内' ELSE CAST(l_partkey % 30 + 1 AS STRING) END AS raw_walk,
  CASE WHEN l_partkey % 7 = 0 THEN '' ELSE p_brand END AS raw_layout, CASE WHEN l_partkey % 11 = 0 THEN '' ELSE p_type END AS raw_structure
FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey
JOIN {{part}} ON l_partkey = p_partkey JOIN {{supplier}} ON l_suppkey = s_suppkey
JOIN {{nation}} ON s_nationkey = n_nationkey JOIN {{region}} ON n_regionkey = r_regionkey
"""

STATIONS = """
SELECT s_suppkey AS position, concat('st', CAST(s_suppkey AS STRING)) AS station_id, s_name AS station_name, r_name AS region,
  35 + CAST(s_suppkey * 37 % 1000 AS DOUBLE) / 1000 AS lat, 139 + CAST(s_suppkey * 91 % 1000 AS DOUBLE) / 1000 AS lon
FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
"""

POSITIONS = """
SELECT o_orderkey AS request_id, CASE WHEN o_orderkey % 41 > 0 THEN 35 + CAST(o_orderkey * 53 % 997 AS DOUBLE) / 997 END AS lat, 139 + CAST(o_orderkey * 29 % 991 AS DOUBLE) / 991 AS lon FROM {orders}
"""

FEED = """
SELECT CASE WHEN s_suppkey % 4 = 0 THEN concat('　', s_name, '　（東）') WHEN s_suppkey % 4 = 1 THEN concat(' ', s_name, '(西)') ELSE s_name END AS name,
  r_name AS region, r_name AS prefecture, concat('line', CAST(p.n AS STRING)) AS line,
  CAST(139 + CAST(s_suppkey * 91 % 1000 AS DOUBLE) / 1000 AS STRING) AS x, CAST(35 + CAST(s_suppkey * 37 % 1000 AS DOUBLE) / 1000 AS STRING) AS y,
  CAST(s_suppkey * 3 + p.n AS BIGINT) AS feed_order
FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
CROSS JOIN (SELECT 0 AS n UNION ALL SELECT 1 AS n UNION ALL SELECT 2 AS n) AS p
"""

REQUESTS = """
SELECT o_orderkey AS request_id, coalesce(r_name, 'ELSEWHERE') AS region, coalesce(r_name, 'ELSEWHERE') AS prefecture,
  concat('Supplier#', lpad(CAST(o_orderkey % 130 AS STRING), 9, '0')) AS station, CAST(CAST(2001 + o_orderkey % 14 AS INT) AS INT) AS year,
  CAST(o_orderkey % 90 AS DOUBLE) AS area, CAST(o_orderkey % 40 AS DOUBLE) AS age, CAST(o_orderkey % 25 AS DOUBLE) + 0.5 AS station_distance,
  250000.0e0 AS mae
FROM {orders} LEFT JOIN {region} ON o_orderkey % 6 = r_regionkey
"""


def tables(sql: str) -> list[str]:
    return sorted({name for _, name, _, _ in string.Formatter().parse(sql) if name})


def spark_view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return spark.sql(sql, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables(sql)})


def duck_view(sql: str) -> str:
    return sql.format(**{t: t for t in tables(sql)})
