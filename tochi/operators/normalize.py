"""Raw transaction records to the canonical schema, as one projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tochi import functions as R
from tochi.schema import CATEGORIES, NUMERIC, REQUIRED, TRANSACTION, regions

# Headers of the bulk files and their canonical names.
HEADERS = {
    "取引価格（総額）": "price",
    "面積（㎡）": "area",
    "取引時期": "transaction_year",
    "建築年": "building_year",
    "最寄駅：距離（分）": "station_distance",
    "都道府県名": "prefecture",
    "市区町村名": "municipality",
    "最寄駅：名称": "station",
    "間取り": "room_layout",
    "建物の構造": "building_type",
}
PRICE_HEADER, KIND_HEADER, WANTED_KIND = "取引価格（総額）", "種類", "中古マンション等"
# Alternative keys of the API's records, in order.
ALIASES = {
    "price": ("TradePrice", "tradePrice"),
    "area": ("Area", "area"),
    "transaction_year": ("Period", "period"),
    "building_year": ("BuildingYear", "buildingYear"),
    "station_distance": ("TimeToNearestStation", "TimeToNearestStationMin", "station_distance"),
    "prefecture": ("Prefecture", "prefecture"),
    "municipality": ("Municipality", "municipality"),
    "station": ("NearestStation", "Station", "station", "DistrictName"),
    "room_layout": ("FloorPlan", "floorPlan"),
    "building_type": ("Structure", "structure"),
}


def _parsed(df: DataFrame, text: dict[str, Column], missing_building_year: str) -> DataFrame:
    # parsed below a generator of one row: a filter on a parsed column stays above it and
    # does not run the parsing a second time; if one parsed column is asked for, the others
    # are not parsed. Texts pass beside it, so that they are read only if they are asked for.
    kept = [F.col(c) for c in ("region", "source_path") if c in df.columns]
    once = {
        "price": R.number(text["price"]),
        "area": R.number(text["area"]),
        "station_distance": R.walking_minutes(text["station_distance"]),
        "transaction_year": R.transaction_year(text["transaction_year"]),
        "building_year": R.building_year(text["building_year"]),
    }
    texts = ("prefecture", "municipality", "station", "room_layout", "building_type")
    df = df.select(*[text[c].alias(c) for c in texts], *kept, F.explode(F.array(F.struct(*[c.alias(k) for k, c in once.items()]))).alias("_parsed"))
    df = df.select(*texts, *kept, "_parsed.*")
    text = {k: F.col(k) for k in (*once, *texts)}
    year = F.col("transaction_year")
    age = R.building_age(year, F.col("building_year"))
    if missing_building_year == "zero":
        age = F.coalesce(age, F.lit(0.0))
    elif missing_building_year != "drop":
        raise ValueError("missing_building_year is 'drop' or 'zero'")
    new = {
        "price": text["price"],
        "area": text["area"],
        "age": age,
        "station_distance": text["station_distance"],
        "prefecture": text["prefecture"],
        "municipality": text["municipality"],
        "station": text["station"],
        "room_layout": F.coalesce(text["room_layout"], F.lit("unknown")),
        "building_type": F.coalesce(text["building_type"], F.lit("unknown")),
        "transaction_year": year,
    }
    return df.select(*[c.alias(k) for k, c in new.items()], *kept)


def normalize_csv(raw: DataFrame, missing_building_year: str = "drop") -> DataFrame:
    """Bulk rows (strings) parsed; rows without the price header pass as canonical.

    ``missing_building_year='zero'`` keeps rows without a building year at age 0, as
    row-wise parsers of such files do; ``'drop'`` leaves a null age, which goes later.
    """
    if PRICE_HEADER not in raw.columns:
        return raw
    rows = raw.filter(F.col(f"`{KIND_HEADER}`") == WANTED_KIND) if KIND_HEADER in raw.columns else raw
    have = set(raw.columns)
    text = {name: F.nullif(F.col(f"`{h}`").cast("string"), F.lit("")) if h in have else F.lit(None).cast("string") for h, name in HEADERS.items()}
    return _parsed(rows, text, missing_building_year)


def normalize_api(raw: DataFrame, record: str = "record", missing_building_year: str = "drop") -> DataFrame:
    """API records (a map of strings) parsed by the first filled alias of each field."""
    # a step of its own: a text that parsing names several times is looked up once, and the code of both stays small enough to be compiled
    text = [R.first_filled(*[F.try_element_at(F.col(record), F.lit(k)) for k in keys]).alias(f"_text_{name}") for name, keys in ALIASES.items()]
    found = raw.select(*text, *(c for c in ("region", "source_path") if c in raw.columns))
    return _parsed(found, {name: F.col(f"_text_{name}") for name in ALIASES}, missing_building_year)


def require(df: DataFrame) -> DataFrame:
    """All required columns, absent ones null, cast to the canonical types; others pass."""
    types = {f.name: f.dataType for f in TRANSACTION.fields}
    have = set(df.columns)
    return df.withColumns({c: F.col(c).try_cast(types[c]) if c in have else F.lit(None).cast(types[c]) for c in REQUIRED})


def drop_missing(df: DataFrame) -> DataFrame:
    """Rows with all of the required columns."""
    return df.dropna(subset=list(REQUIRED))


def with_region(df: DataFrame) -> DataFrame:
    """``region`` by prefecture, null where the prefecture has none."""
    dim = regions(df.sparkSession).select(F.col("prefecture").alias("_p"), F.col("region").alias("_region"))
    return df.drop("region").join(F.broadcast(dim), F.col("prefecture") == F.col("_p"), "left").withColumnRenamed("_region", "region").drop("_p")


# English names that geocoders give for the prefectures, and the levels
# of an address that may hold the prefecture and the municipality, in order.
PREFECTURE_ALIASES = {
    "Tokyo": "東京都",
    "Saitama": "埼玉県",
    "Chiba": "千葉県",
    "Kanagawa": "神奈川県",
    "Kanagawa Prefecture": "神奈川県",
    "Saitama Prefecture": "埼玉県",
    "Chiba Prefecture": "千葉県",
    "Tokyo Metropolis": "東京都",
}
STATE_LEVELS = ("province", "state", "region")
PLACE_LEVELS = ("city_district", "municipality", "city", "town", "village", "county", "suburb")


def geocoded(addresses: DataFrame, json: str = "address") -> DataFrame:
    """prefecture and municipality out of landed geocoder addresses (JSON text).

    Only absent and null levels are passed over, an empty one is taken; with none, ''.
    """
    state, place = (F.coalesce(*[F.get_json_object(json, f"$.{k}") for k in levels], F.lit("")) for levels in (STATE_LEVELS, PLACE_LEVELS))
    alias = F.create_map(*[F.lit(x) for pair in PREFECTURE_ALIASES.items() for x in pair])
    return addresses.withColumns({"prefecture": F.coalesce(F.try_element_at(alias, state), state), "municipality": place})


def split_supported(requests: DataFrame, supported: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) requests by whether ``supported`` has their prefecture."""
    known = F.broadcast(supported.select(F.col("prefecture").alias("_p")).distinct()) if supported.count() <= 10_000 else supported.select(F.col("prefecture").alias("_p")).distinct()
    hit = F.col("prefecture") == F.col("_p")
    return requests.join(known, hit, "left_semi"), requests.join(known, hit, "left_anti")


def feature_projection(df: DataFrame) -> DataFrame:
    """The ordered model inputs: numbers, null as 0, the distance rounded half up."""
    cols = []
    for c in (*NUMERIC[1:], "transaction_year", *(f"{x}_id" for x in CATEGORIES)):
        x = F.coalesce(F.col(c).cast("double"), F.lit(0.0))
        cols.append((R.half_up(x).cast("double") if c == "station_distance" else x).alias(c))
    return df.select(*[c for c in df.columns if c.startswith("key_")], *cols)
