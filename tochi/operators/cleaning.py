"""Outliers, category dictionaries, and holdout masks, for all regions in one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tochi.schema import CATEGORIES
from tochi.tables import BROADCAST_ROWS, dimension, materialized


def iqr_bounds(df: DataFrame, column: str, by: str = "region", weight: str | None = None) -> DataFrame:
    """(by, q1, q3): exact quartiles with linear interpolation; a row stands for ``weight`` equal ones if that is named.

    Equal values are counted first; the counts are laid out by value over many tasks and
    ranks found by running counts inside a task and over tasks, so no region is in one.
    """
    counts = df.filter(F.col(by).isNotNull() & F.col(column).isNotNull()).groupBy(by, F.col(column).alias("_x")).agg((F.sum(weight) if weight else F.count("*")).alias("_n"))
    ranged = materialized(counts.repartitionByRange(by, "_x").withColumn("_part", F.spark_partition_id()), "quartiles")
    ahead = Window.partitionBy(by).orderBy("_part")
    parts = ranged.groupBy(by, "_part").agg(F.sum("_n").alias("_m"))
    parts = parts.select(by, "_part", (F.sum("_m").over(ahead) - F.col("_m")).alias("_before"), F.sum("_m").over(Window.partitionBy(by)).alias("_total"))
    upto = F.col("_before") + F.sum("_n").over(Window.partitionBy(by, "_part").orderBy("_x"))
    rows = ranged.join(F.broadcast(parts), [by, "_part"]).withColumn("_upto", upto)

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("_upto") > rank) & (F.col("_upto") - F.col("_n") <= rank), F.col("_x")))

    ends = []
    for k, share in ((1, 0.25), (3, 0.75)):
        place = (F.col("_total") - 1) * share
        ends += [at(F.floor(place)).alias(f"_low{k}"), at(F.ceil(place)).alias(f"_high{k}"), F.max(place - F.floor(place)).alias(f"_rest{k}")]
    found = rows.groupBy(by).agg(*ends)
    return found.select(by, *((F.col(f"_low{k}") + (F.col(f"_high{k}") - F.col(f"_low{k}")) * F.col(f"_rest{k}")).alias(f"q{k}") for k in (1, 3)))


def remove_iqr_outliers(df: DataFrame, columns: tuple[str, ...] = ("price", "area"), by: str = "region", weight: str | None = None) -> DataFrame:
    """Rows inside 1.5 quartile ranges, column after column on the survivors.

    The bounds, one row a region, are written, counted, and broadcast if few.
    """
    for column in columns:
        fence = 1.5 * (F.col("q3") - F.col("q1"))
        df = df.join(dimension(iqr_bounds(df, column, by, weight), "bounds"), by).filter(F.col(column).between(F.col("q1") - fence, F.col("q3") + fence)).drop("q1", "q3")
    return df


def build_category_dictionary(df: DataFrame, features: tuple[str, ...] = CATEGORIES, by: str = "region") -> DataFrame:
    """(region, feature, value, id): ids 1..n by code point among distinct values."""
    pairs = df.select(by, F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("string").alias("value")) for f in features])).alias("p"))
    values = pairs.select(by, "p.feature", "p.value").filter(F.col("value").isNotNull()).distinct()
    return values.withColumn("id", F.row_number().over(Window.partitionBy(by, "feature").orderBy("value")))


def encode_categories(df: DataFrame, dictionary: DataFrame, features: tuple[str, ...] = CATEGORIES, by: str = "region") -> DataFrame:
    """``df`` with ``<feature>_id``, 0 where the dictionary lacks the value.

    The dictionary is written, counted, and broadcast if it is small.
    """
    dictionary = materialized(dictionary, "dictionary")
    small = dictionary.count() <= BROADCAST_ROWS
    for f in features:
        ids = dictionary.filter(F.col("feature") == f).select(F.col(by).alias("_by"), F.col("value").alias("_value"), F.col("id").alias(f"{f}_id"))
        df = df.join(F.broadcast(ids) if small else ids, (F.col(by) == F.col("_by")) & (F.col(f).cast("string") == F.col("_value")), "left").drop("_by", "_value")
        df = df.withColumn(f"{f}_id", F.coalesce(F.col(f"{f}_id"), F.lit(0)))
    return df


def fold_layout_width(value: Column) -> Column:
    """Half-width layouts ('2LDK') as dictionaries spell them ('２ＬＤＫ')."""
    half = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.upper(value), half, "".join(chr(ord(c) + 0xFEE0) for c in half))


def time_holdout(df: DataFrame, start: int, test: int) -> DataFrame:
    """``df`` with is_train (start <= year < test) and is_test (year = test)."""
    year = F.col("transaction_year")
    return df.withColumns({"is_train": (year >= start) & (year < test), "is_test": year == test})


def positional_holdout(df: DataFrame, order: list[str], by: str = "region", share: float = 0.2) -> DataFrame:
    """``df`` with is_train and is_test, the last max(1, share * n) rows of each region.

    ``order`` must be a total order. Rows are numbered inside blocks of equal leading keys;
    the blocks' sizes are laid out by key over many tasks and summed up inside a task and
    over tasks, so neither rows nor keys of a region meet in one.
    """
    lead, rest = order[0], order[1:]
    counts = df.groupBy(F.col(by).alias("_by"), F.col(lead).alias("_lead")).agg(F.count("*").alias("_n"))
    ranged = materialized(counts.repartitionByRange("_by", "_lead").withColumn("_part", F.spark_partition_id()), "blocks")
    parts = ranged.groupBy("_by", "_part").agg(F.sum("_n").alias("_m"))
    of = Window.partitionBy("_by")
    parts = parts.select(F.col("_by").alias("_of"), F.col("_part").alias("_at"), (F.sum("_m").over(of.orderBy("_part")) - F.col("_m")).alias("_ahead"), F.sum("_m").over(of).alias("_total"))
    inside = F.sum("_n").over(Window.partitionBy("_by", "_part").orderBy("_lead")) - F.col("_n")
    placed = ranged.withColumn("_inside", inside).join(F.broadcast(parts), F.col("_by").eqNullSafe(F.col("_of")) & (F.col("_part") == F.col("_at")))  # a row a region and task
    blocks = placed.select("_by", "_lead", (F.col("_ahead") + F.col("_inside")).alias("_before"), "_total")
    nth = F.row_number().over(Window.partitionBy(by, lead).orderBy(*(rest or [lead])))
    out = df.withColumn("_nth", nth).join(blocks, F.col(by).eqNullSafe(F.col("_by")) & F.col(lead).eqNullSafe(F.col("_lead")))
    tested = F.greatest(F.lit(1), F.floor(F.col("_total") * share))
    test = F.col("_before") + F.col("_nth") > F.col("_total") - tested
    return out.withColumns({"is_test": test, "is_train": ~test}).drop("_nth", "_by", "_lead", "_before", "_total")


def holdout(df: DataFrame, start: int, test: int, order: list[str], by: str = "region") -> DataFrame:
    """The time holdout; regions where a side is empty take the positional one."""
    timed = time_holdout(df, start, test)
    sides = timed.groupBy(by).agg((F.bool_or("is_train") & F.bool_or("is_test")).alias("_ok"))
    marked = timed.join(sides.withColumnRenamed(by, "_r"), F.col(by).eqNullSafe(F.col("_r"))).drop("_r")
    both = positional_holdout(marked.withColumnsRenamed({"is_train": "_train", "is_test": "_test"}), order, by)
    return both.withColumns({"is_train": F.when(F.col("_ok"), F.col("_train")).otherwise(F.col("is_train")), "is_test": F.when(F.col("_ok"), F.col("_test")).otherwise(F.col("is_test"))}).drop("_ok", "_train", "_test")


def tuning_split(df: DataFrame, validation: int, order: list[str], by: str = "region") -> DataFrame:
    """Train rows split again: years before ``validation`` against that year."""
    train = df.filter("is_train").drop("is_train", "is_test")
    return holdout(train, -(10**9), validation, order, by).withColumnsRenamed({"is_train": "is_fit", "is_test": "is_valid"})


def deployment_window(df: DataFrame, start: int, latest: int) -> DataFrame:
    return df.filter(F.col("transaction_year").between(start, latest))


def expanding_folds(df: DataFrame, start: int, first_test: int, last_test: int) -> DataFrame:
    """(fold rows): each test year against all years from ``start`` before it."""
    folds = df.withColumn("fold", F.explode(F.sequence(F.lit(first_test), F.lit(last_test))))
    year = F.col("transaction_year")
    folds = folds.withColumns({"is_train": (year >= start) & (year < F.col("fold")), "is_test": year == F.col("fold")})
    return folds.filter("is_train or is_test")
