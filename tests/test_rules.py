"""Text rules on literal inputs, file readers on written fixtures, and invariants."""

from __future__ import annotations

import zipfile

import pytest
from pyspark.sql import functions as F

from tochi import functions as R
from tochi import sources
from tochi.operators import cleaning, history, normalize, registry, stations

CASES = {
    R.building_year: [("昭和55年", 1980), ("平成元年", None), ("平成12年", 2000), ("令和3年", 2021), ("2004年", 2004), ("戦前", None), ("２０２０年", 2020), ("大正10年", None), ("120234", 1202), ("", None), (None, None)],
    R.number: [("28,000,000", 28e6), ("2000㎡以上", 2000.0), ("-5", 5.0), ("５５", 55.0), ("１，２００", 1.0), ("1200万円", 1200.0), ("abc", None), ("1e3", 1.0), ("3.", 3.0), (".5", 5.0), (None, None)],
    R.walking_minutes: [("5", 5.0), ("30分～60分", 45.0), ("1H～1H30", 60.0), ("1H30～2H", 60.0), ("2H～", 2.0), ("2時間", 2.0), ("1時間以内", 60.0), ("１５", 15.0), ("", 0.0), (None, 0.0)],
    R.station_key: [("東京（南口）", "東京"), ("市ヶ谷 (東)", "市ケ谷"), (" 霞ヵ関", "霞カ関")],
}


@pytest.mark.parametrize("rule", CASES, ids=lambda r: r.__name__)
def test_text_rules(spark, rule):
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(CASES[rule])], "k int, t string")
    got = [r[0] for r in df.select("k", rule(F.col("t")).alias("v")).orderBy("k").select("v").collect()]
    assert got == [v for _, v in CASES[rule]]


HEADER = ["種類", *normalize.HEADERS]
LINES = [
    ["中古マンション等", "28,000,000", "５５", "2023年第4四半期", "2004年", "30分～60分", "東京都", "千代田区", "東京", "２ＬＤＫ", "ＲＣ"],
    ["宅地(土地)", "1", "1", "2023年", "2004年", "5", "東京都", "千代田区", "東京", "", ""],
    ["中古マンション等", "5000", "2000㎡以上", "2023年", "戦前", "", "東京都", "千代田区", "東京", "", ""],
]
TEXT = "\n".join(",".join(f'"{x}"' for x in row) for row in [HEADER, *LINES]) + "\n"


@pytest.mark.parametrize("kind", ["utf-8", "utf-8-sig", "cp932", "zip"])
def test_every_encoding_gives_one_table(spark, tmp_path, kind):
    if kind == "zip":
        path = tmp_path / "x.zip"
        with zipfile.ZipFile(path, "w") as z:
            z.writestr("readme.txt", "no")
            z.writestr("a.CSV", TEXT.encode("cp932"))
    else:
        path = tmp_path / "x.csv"
        path.write_bytes(TEXT.encode(kind))
    rows = normalize.require(sources.read_transactions(spark, [str(path)])).orderBy("price").collect()
    assert [(r.price, r.area, r.age, r.station_distance, r.room_layout, r.transaction_year) for r in rows] == [(5000.0, 2000.0, None, 0.0, "unknown", 2023), (28e6, 55.0, 19.0, 45.0, "２ＬＤＫ", 2023)]
    assert normalize.drop_missing(normalize.require(sources.read_transactions(spark, [str(path)]))).count() == 1
    assert normalize.drop_missing(normalize.require(sources.read_transactions(spark, [str(path)], "zero"))).count() == 2


def test_what_is_not_asked_for_is_not_parsed(spark):
    raw = spark.createDataFrame([("中古マンション等", "5,000", "３０㎡", "駅")], "`種類` string, `取引価格（総額）` string, `面積（㎡）` string, `最寄駅：名称` string")
    asked = normalize.require(normalize.normalize_csv(raw)).groupBy("room_layout").agg(F.count("price"))
    assert "面積" not in asked._jdf.queryExecution().optimizedPlan().toString().split("LogicalRDD")[0]
    assert [tuple(r) for r in asked.collect()] == [("unknown", 1)]


def test_archive_without_csv_is_an_error(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.writestr("readme.txt", "no")
    with pytest.raises(Exception, match="no CSV member"):
        sources.read_zipped_csv(spark, [str(tmp_path / "x.zip")]).collect()


@pytest.mark.parametrize("shape", ["[%s, 3]", '{"data": [%s]}', '{"Data": [%s]}', '{"items": [%s]}', '{"results": [%s]}', "%s"])
def test_api_wrappers(spark, tmp_path, shape):
    (tmp_path / "x.json").write_text(shape % '{"TradePrice": "12,000", "area": 30, "Period": "2020年", "Station": "A"}')
    row = normalize.normalize_api(sources.read_api_json(spark, [str(tmp_path / "x.json")])).collect()
    assert [(r.price, r.area, r.transaction_year, r.station, r.room_layout) for r in row] == [(12000.0, 30.0, 2020, "A", "unknown")]


def test_trend(spark):
    rows = [("a", 2020, 10.0), ("a", 2021, 12.0), ("a", 2022, 11.0), ("a", 2024, 20.0), ("a", 2025, 25.0), ("b", 2020, 1.0), ("c", 2020, 1.0), ("c", 2025, 11.0)]
    df = spark.createDataFrame(rows, "station string, year int, avg_price double")
    got = dict(history.trend(df, ["station"], 2025).collect())
    assert got == {"a": pytest.approx(13 / 3), "b": None, "c": 10.0}


def test_latest_is_strict_and_null_is_beaten(spark):
    df = spark.createDataFrame([("r", 1, None), ("r", 2, 5.0), ("r", 3, 5.0), ("r", 4, 4.0)], "region string, model_id int, mae double")
    got = {r.model_id: (r.became_latest, r.is_latest) for r in registry.latest_models(df).collect()}
    assert got == {1: (True, False), 2: (True, False), 3: (False, False), 4: (True, True)}


def test_nearest_station_equals_brute_force(spark):
    st = spark.sql("SELECT id AS position, concat('s', id) AS station_id, concat('n', id) AS station_name, 'r' AS region, 35 + (id * 37 % 101) / 50e0 AS lat, 139 + (id * 53 % 97) / 50e0 AS lon FROM range(40)")
    rq = spark.sql("SELECT id AS request_id, 34 + (id * 29 % 89) / 20e0 AS lat, 138 + (id * 31 % 83) / 20e0 AS lon FROM range(200)")
    got = {r.request_id: (r.station_id, r.km) for r in stations.nearest_station(rq, st).collect()}
    km = R.haversine_km(F.col("q.lat"), F.col("q.lon"), F.col("s.lat"), F.col("s.lon"))
    want = rq.alias("q").join(st.alias("s"), how="cross").groupBy("request_id").agg(F.min(F.struct(km.alias("km"), "position", "station_id")).alias("m"))
    assert got == {r.request_id: (r.m.station_id, r.m.km) for r in want.collect()}


def test_masks_are_disjoint_and_positional_where_a_side_is_empty(spark):
    df = spark.createDataFrame([("a", y, k) for k, y in enumerate([1999, 2000, 2001] * 4)] + [("b", 1999, k) for k in range(10)], "region string, transaction_year int, k int")
    rows = cleaning.holdout(df, 1999, 2001, ["k"]).collect()
    assert not any(r.is_train and r.is_test for r in rows)
    assert sum(r.is_test for r in rows if r.region == "a") == 4
    assert sorted(r.k for r in rows if r.region == "b" and r.is_test) == [8, 9]


def test_no_row_outside_its_bounds_and_codes_round_trip(spark):
    df = spark.createDataFrame([("r", float(x), 1.0, c) for x, c in zip([1, 2, 3, 4, 5, 100], "badcaf")], "region string, price double, area double, prefecture string")
    kept = cleaning.remove_iqr_outliers(df)
    assert sorted(r.price for r in kept.collect()) == [1, 2, 3, 4, 5]
    words = cleaning.build_category_dictionary(kept, ("prefecture",))
    codes = {r.prefecture: r.prefecture_id for r in cleaning.encode_categories(df, words, ("prefecture",)).collect()}
    assert codes == {"a": 1, "b": 2, "c": 3, "d": 4, "f": 0}


@pytest.mark.parametrize(
    ("address", "prefecture", "municipality"),
    [
        ('{"state":"Kanagawa Prefecture","city":"横浜市","city_district":"西区"}', "神奈川県", "西区"),
        ('{"province":"Tokyo Metropolis","state":"Chiba","municipality":"千代田区","city":"x"}', "東京都", "千代田区"),
        ('{"province":null,"state":"Saitama Prefecture","city":"川口市","town":"t"}', "埼玉県", "川口市"),
        ('{"state":"","region":"Chiba","city":"","town":"t"}', "", ""),
        ('{"region":"Chiba Prefecture","ward":"w","suburb":"s"}', "千葉県", "s"),
        ('{"state":"大阪府","county":"c","village":"v"}', "大阪府", "v"),
        ("{}", "", ""),
    ],
)
def test_geocoded_addresses(spark, address, prefecture, municipality):
    row = normalize.geocoded(spark.createDataFrame([(address,)], "address string")).first()
    assert (row.prefecture, row.municipality) == (prefecture, municipality)


def test_quartiles_are_exact_over_many_tasks(spark):
    import numpy as np

    values = {"a": list(range(1, 1002)), "b": [3.5, 3.5, 3.5, 1.0], "c": [7.0], "d": [1.0, 2.0]}
    df = spark.createDataFrame([(k, float(v)) for k, vs in values.items() for v in vs] + [("e", None), (None, 1.0)], "region string, price double").repartition(5)
    got = {r.region: (r.q1, r.q3) for r in cleaning.iqr_bounds(df, "price").collect()}
    assert got == {k: (np.percentile(v, 25), np.percentile(v, 75)) for k, v in values.items()}


def test_nearest_station_far_off_and_over_the_date_line(spark):
    stations_df = spark.createDataFrame([("s1", "a", "r", 35.0, 139.0, 1), ("s2", "b", "r", 0.0, -179.9, 2)], "station_id string, station_name string, region string, lat double, lon double, position int")
    asked = spark.createDataFrame([(1, 35.01, 139.01), (2, 50.0, 139.0), (3, 0.0, 179.9), (4, -60.0, 20.0), (5, None, 1.0)], "request_id int, lat double, lon double")
    got = {r.request_id: (r.station_id, r.km) for r in stations.nearest_station(asked, stations_df).collect()}
    assert {k: v[0] for k, v in got.items()} == {1: "s1", 2: "s1", 3: "s2", 4: "s2", 5: None}
    assert got[3][1] == pytest.approx(22.24, abs=0.01)
