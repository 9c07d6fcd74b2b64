"""Readers and writers: raw files in mixed encodings, processed tables, artifacts."""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tochi.operators.normalize import normalize_api, normalize_csv
from tochi.sources import archives, stores
from tochi.sources.archives import read_zipped_csv as read_zipped_csv
from tochi.tables import BROADCAST_ROWS
from tochi.tables import scratch as scratch

WRAPPERS = ("data", "Data", "items", "results")
JAPANESE = "windows-31j"


def _csv(spark: SparkSession, paths: list[str], encoding: str) -> DataFrame:
    return spark.read.option("header", True).option("multiLine", True).option("encoding", encoding).option("inferSchema", False).csv(paths)


def union_all(frames: list[DataFrame]) -> DataFrame:
    """All rows, columns that some lack as null."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def classify_encoding(spark: SparkSession, paths: list[str], range_bytes: int = archives.RANGE_BYTES) -> dict[str, list[str]]:
    """Files by encoding: UTF-8 (a byte-order mark is fine) where valid, else Japanese.

    Files are tested by byte ranges; what reaches the driver is one flag a file.
    """
    out: dict[str, list[str]] = {}
    for r in archives.encodings(spark, paths, range_bytes).orderBy("path").collect():
        out.setdefault("UTF-8" if r["is_utf8"] else JAPANESE, []).append(r["path"])
    return out


class _JapaneseCharsets:
    """Lets Spark read windows-31j while plans are made and run; restores the setting."""

    key = "spark.sql.legacy.javaCharsets"

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark

    def __enter__(self) -> None:
        self.before = self.spark.conf.get(self.key, "false")
        self.spark.conf.set(self.key, "true")

    def __exit__(self, *_: object) -> None:
        self.spark.conf.set(self.key, self.before)


def read_transaction_csv(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Bulk CSV files in UTF-8 (with or without mark) or Shift_JIS, all columns strings; they may be gzipped.

    Spark checks the charset again when a plan runs, so Japanese files are transcoded
    into the shared folder here, and the session's setting is as before on return.
    """
    frames = []
    for code, own in sorted(classify_encoding(spark, paths).items()):
        frame = _csv(spark, own, code) if code == "UTF-8" else None
        if frame is None:
            path = scratch(spark, "transcoded")
            with _JapaneseCharsets(spark):
                _csv(spark, own, code).write.option("compression", "zstd").parquet(path)
            frame = spark.read.parquet(path)
        frames.append(frame)
    return union_all(frames)


def transcode_to_utf8(spark: SparkSession, paths: list[str], target: str, compression: str = "none") -> None:
    """Write the rows of Shift_JIS (or UTF-8) files as UTF-8 CSV, plain or compressed, in parallel by file."""
    read_transaction_csv(spark, paths).write.mode("overwrite").option("header", True).option("compression", compression).csv(target)


def read_api_json(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Records of API payloads as ``record`` (a map of strings), whatever wraps them."""
    payload = spark.read.option("wholetext", True).text(paths).select(F.parse_json("value").alias("v"))
    as_records = lambda path: F.try_variant_get("v", path, "array<map<string,string>>")  # noqa: E731  # what is no object is null
    one = F.array(F.try_variant_get("v", "$", "map<string,string>"))
    rows = payload.select(F.explode(F.coalesce(as_records("$"), *[as_records(f"$.{k}") for k in WRAPPERS], one)).alias("record"))
    return rows.filter(F.col("record").isNotNull())


def by_suffix(spark: SparkSession, paths: list[str]) -> dict[str, list[str]]:
    """The files of all paths, folders expanded: zip and json (or json.gz) by their suffix, all others as csv."""
    out: dict[str, list[str]] = {}
    for path, _ in stores.files(spark, paths):
        suffix = path.lower().removesuffix(".gz").rsplit(".", 1)[-1]
        out.setdefault(suffix if suffix in ("zip", "json") else "csv", []).append(path)
    return out


def read_transactions(spark: SparkSession, paths: list[str], missing_building_year: str = "drop") -> DataFrame:
    """Files and folders of mixed inputs by suffix, each normalised, in one table."""
    by = by_suffix(spark, paths)
    frames = []
    if "csv" in by:
        frames.append(normalize_csv(read_transaction_csv(spark, by["csv"]), missing_building_year))
    if "zip" in by:
        frames.append(normalize_csv(read_zipped_csv(spark, by["zip"]), missing_building_year))
    if "json" in by:
        frames.append(normalize_api(read_api_json(spark, by["json"]), missing_building_year=missing_building_year))
    return union_all(frames)


def landed(spark: SparkSession, root: str, regions: list[str] | None = None, years: list[int] | None = None, quarters: list[int] | None = None) -> DataFrame:
    """(region, year, quarter, path) of the files below ``root``, laid out as region/year/ or region/year/quarter/.

    Only the folders asked for are listed. A quarter is null where the layout has none;
    asking for quarters leaves such files out. Levels may be named (``year=2020``, ``q1``).
    """
    number = lambda name: int(digits) if (digits := re.sub(r"\D", "", name)) else None
    plain = lambda name: unquote(name.split("=", 1)[-1])
    rows = []
    for region in stores.names(spark, root):
        if regions is not None and plain(region) not in regions:
            continue
        for year in stores.names(spark, f"{root}/{region}"):
            if years is not None and number(plain(year)) not in years:
                continue
            at = f"{root}/{region}/{year}"
            for name, is_folder in stores.entries(spark, at):
                quarter = number(plain(name)) if is_folder else None
                if quarters is None or quarter in quarters:
                    rows += [(plain(region), number(plain(year)), quarter, path) for path, _ in stores.files(spark, [f"{at}/{name}"])]
    return spark.createDataFrame(rows, "region string, year int, quarter int, path string")


def read_landed(spark: SparkSession, root: str, schema: str, regions: list[str] | None = None, years: list[int] | None = None, quarters: list[int] | None = None, **options: object) -> DataFrame:
    """CSV files of a landing folder with region, year and quarter by their place; see ``landed``."""
    found = landed(spark, root, regions, years, quarters)
    paths = [r["path"] for r in found.select("path").collect()]
    if not paths:
        return spark.createDataFrame([], f"{schema}, region string, year int, quarter int")
    plain = lambda c: F.regexp_replace(F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), "^file:/+", "file:/")
    rows = spark.read.schema(schema).options(**options).csv(paths).withColumn("_at", plain(F.col("_metadata.file_path")))
    places = found.select(plain(F.col("path")).alias("_at"), "region", "year", "quarter")
    return rows.join(F.broadcast(places) if len(paths) <= BROADCAST_ROWS else places, "_at").drop("_at")


def write_processed(df: DataFrame, path: str) -> None:
    """Cleaned rows as Parquet by region; only the regions written are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("region").parquet(path)


def read_processed(spark: SparkSession, *paths: str) -> DataFrame | None:
    """The first of the paths that holds a table, or None."""
    for path in paths:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        if target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
            return spark.read.parquet(path)
    return None


def write_json(df: DataFrame, path: str) -> None:
    """An artifact as JSON, one folder a region."""
    df.write.mode("overwrite").partitionBy("region").json(path)


def dictionary_documents(dictionary: DataFrame) -> DataFrame:
    """One document a region: feature -> (value -> id), unknown id 0."""
    values = dictionary.groupBy("region", "feature").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("value", "id")))).alias("ids"))
    return values.groupBy("region").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("feature", F.to_json("ids").alias("ids"))))).alias("features")).withColumn("unknownId", F.lit(0))


def read_dictionary(spark: SparkSession, path: str | list[str], region: Column | None = None) -> DataFrame:
    """(region, feature, value, id) of written documents; ``region`` says it where no folder does."""
    kind = "features map<string,string>, unknownId int"
    docs = spark.read.schema(kind if region is not None else f"{kind}, region string").json(path)
    rows = docs.select(F.col("region") if region is None else region, F.explode("features").alias("feature", "ids"))
    return rows.select("region", "feature", F.explode(F.from_json("ids", "map<string,int>")).alias("value", "id"))
