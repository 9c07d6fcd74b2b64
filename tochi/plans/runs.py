"""Queries over training runs: logs of events and models, metadata, published artifacts, requests by regional tables.

The model of these queries is one that SQL can fit too: the mean price on each side of
the mean area, as a tree of three nodes a region, scored by the code that scores trees.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tochi import functions as R
from tochi import sources
from tochi.operators import cleaning, forest, history, metadata, publishing, registry, scoring
from tochi.plans import bindings as B
from tochi.plans import catalogue as C
from tochi.plans.catalogue import START, TEST, VALIDATION, query
from tochi.schema import FEATURES
from tochi.sources import stores
from tochi.sources.log import Log
from tochi.tables import materialized

# ------------------------------------------------------------ logs


@query("m12_concurrent_events", "SELECT o_custkey AS experiment_id, arg_max(o_orderstatus, o_orderkey) AS status, arg_max(o_totalprice, o_orderkey) AS mae, count(*) AS events FROM orders GROUP BY o_custkey")
def m12_events(spark, sf):
    """The state of all experiments after two writers have appended events at the same time, some of them both."""
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    events = orders.select(F.col("o_orderkey").cast("string").alias("event_id"), F.col("o_custkey").alias("experiment_id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("mae"), F.col("o_orderkey").alias("event_order"))
    log = Log(spark, sources.scratch(spark, "events"), registry.EVENTS, "event_id")
    shares = [events.filter("event_order % 2 = 0 or event_order % 5 = 0"), events.filter("event_order % 2 = 1 or event_order % 3 = 0")]
    with ThreadPoolExecutor(2) as pool:
        list(pool.map(log.append, shares))
    log.append(shares[0])  # a repeated append adds nothing
    return registry.experiment_state(log.rows()).join(log.rows().groupBy("experiment_id").agg(F.count("*").alias("events")), "experiment_id")


@query("m11_registered_models", f"{C._EXP} SELECT region, model_id, mae, became_latest, is_latest FROM latest")
def m11_models(spark, sf):
    """Models registered in three commits, each judged by what the log held at its own."""
    models = C._experiments(spark, sf)
    log = Log(spark, sources.scratch(spark, "models"), registry.MODELS, "model_key")
    rows = materialized(models.withColumns({"model_key": F.concat_ws("/", "region", "model_id"), "experiment_id": F.col("model_id") + 1000}), "candidates")
    for low, high in ((0, 8), (8, 16), (16, 10**9)):  # nations in order
        registry.register_models(log, rows.filter((F.col("model_id") >= low) & (F.col("model_id") < high)))
    registry.register_models(log, rows)  # all are known
    return registry.registered(log.rows()).select("region", "model_id", "mae", "became_latest", "is_latest")


# ------------------------------------------------------------ a model that SQL can fit

_SPLIT = f"round({C._mean('area')}, 2)"


def _stumps_sql(name: str, where: str) -> str:
    cents = "floor({x} * 100 + 0.5) / 100"
    left, right = (cents.format(x=f"coalesce(CAST(sum(CASE WHEN area {op} cut THEN CAST(price AS DECIMAL(18,2)) END) AS DOUBLE) / count(CASE WHEN area {op} cut THEN 1 END), 0)") for op in ("<=", ">"))
    return f"{name}_cut AS (SELECT region, {_SPLIT} AS cut FROM clean WHERE {where} GROUP BY region), {name} AS (SELECT region, cut, {left} AS low, {right} AS high FROM clean JOIN {name}_cut USING (region) WHERE {where} GROUP BY ALL)"


def stumps(train):
    """The nodes of one tree a region: the mean price up to the mean area, and beyond."""
    cut = train.groupBy("region").agg(F.round(R.exact_mean(F.col("area")), 2).alias("cut"))
    side = F.col("area") <= F.col("cut")
    means = train.join(cut, "region").groupBy("region", "cut").agg(*[R.rounded(F.coalesce(R.exact_mean(F.when(s, F.col("price"))), F.lit(0.0)), 2).alias(n) for s, n in ((side, "low"), (~side, "high"))])
    none = F.lit(None)
    node = lambda k, left, right, threshold, value: F.struct(F.lit(k).alias("node"), F.lit(0 if left > 0 else -1).alias("feature"), F.lit(False).alias("nominal"), threshold.cast("double").alias("threshold"), none.cast("array<double>").alias("categories"), F.lit(left).alias("left"), F.lit(right).alias("right"), value.cast("double").alias("prediction"))
    rows = means.select("region", F.inline(F.array(node(0, 1, 2, F.col("cut"), none), node(1, -1, -1, none, F.col("low")), node(2, -1, -1, none, F.col("high")))))
    return rows.withColumns({"tree": F.lit(0), "weight": F.lit(1.0)})


def _predicted(rows, nodes):
    return forest.score(rows, nodes, ["area"], 1)


_WHERE_TRAIN = f"transaction_year >= {START} AND transaction_year < {TEST}"
_EVALUATED = f"""{C._CLEAN}, {_stumps_sql('model', _WHERE_TRAIN)},
tested AS (SELECT t.*, CASE WHEN area <= cut THEN low ELSE high END AS prediction FROM clean t JOIN model USING (region) WHERE transaction_year = {TEST}),
errors AS (SELECT region, round(avg(abs(price - prediction)), 1) AS mae, round(sqrt(avg((price - prediction) * (price - prediction))), 1) AS rmse, round(coalesce(100 * avg(CASE WHEN price <> 0 THEN abs((price - prediction) / price) END), 0), 4) AS mape FROM tested GROUP BY region)"""


def _errors(scored):
    return history.metrics(scored, ["region"]).select("region", F.round("mae", 1).alias("mae"), F.round("rmse", 1).alias("rmse"), F.round("mape", 4).alias("mape"))


# ------------------------------------------------------------ metadata

_SETTINGS = {"enabled": True, "n_trials": 30, "max_estimators": 20, "max_depth_max": 6, "size_penalty_per_iteration": 250.0}


def _documents(rows, nodes, test=TEST, errors=None):
    """Documents of all regions; one region was not tuned, and numLeavesMax is no setting of these trees."""
    marked = cleaning.time_holdout(rows, START, test).withColumn("timed", F.lit(True))
    errors = _errors(_predicted(marked.filter("is_test"), nodes)) if errors is None else errors
    evaluated = materialized(metadata.split_counts(marked, START, test).join(errors, "region"), "evaluated")  # three parts of the documents read it
    share = F.when(F.col("feature") == "area", 1.0).otherwise(0.0)  # the only split
    importance = evaluated.select("region", F.explode(F.array(*[F.lit(f) for f in FEATURES])).alias("feature")).withColumn("importance", share)
    tuned = evaluated.filter("region <> 'ASIA'").select("region", F.lit(30).alias("trials"), F.lit(VALIDATION).alias("validation_year"), F.col("mae").alias("best_mae"), (F.col("mae") + 250).alias("best_score"))
    return metadata.documents(evaluated, f"{test}-12-31", START, test, test, {"objective": "regression", "maxDepth": 1}, _SETTINGS, importance, tuned)


_FLAT = {
    "region": "region", "model_name": "modelName", "mae": "mae", "latest_training_year": "latestTrainingYear", "generated_at": "generatedAt",
    "feature_order": "array_join(featureOrder, ',')", "split": "evaluation.split", "train_start_year": "evaluation.trainStartYear", "test_year": "evaluation.testYear",
    "train_count": "evaluation.trainCount", "test_count": "evaluation.testCount", "metric_mae": "evaluation.metrics.mae", "metric_rmse": "evaluation.metrics.rmse", "metric_mape": "evaluation.metrics.mape",
    "deploy_start": "deployment.trainStartYear", "deploy_latest": "deployment.latestTrainingYear", "deploy_count": "deployment.trainCount", "all_rows": "deployment.trainedWithAllAvailableRows",
    "objective": "modelParams['objective']", "max_depth": "modelParams['maxDepth']", "importance": "array_join(transform(featureImportance, x -> concat(x.feature, '=', cast(x.importance as string))), ',')",
    "tuning_enabled": "tuning.enabled", "n_trials": "tuning.nTrials", "completed_trials": "tuning.completedTrials", "validation_year": "tuning.validationYear", "best_mae": "tuning.bestValidationMae", "best_score": "tuning.bestTuningScore",
    "max_estimators": "tuning.maxEstimators", "num_leaves_max": "tuning.numLeavesMax", "max_depth_max": "tuning.maxDepthMax", "size_penalty": "tuning.sizePenaltyPerIteration",
}
_BY_GAIN = ",".join(f"{f}={1.0 if f == 'area' else 0.0}" for f in sorted(FEATURES, key=lambda f: f != "area"))


@query(
    "k04_r08_metadata_round_trip",
    f"""{_EVALUATED}, c AS (SELECT region, count_if({_WHERE_TRAIN}) AS train, count_if(transaction_year = {TEST}) AS test, count_if(transaction_year BETWEEN {START} AND {TEST}) AS deploy FROM clean GROUP BY region)
SELECT region, region || '_latest' AS model_name, mae, {TEST} AS latest_training_year, '2001-12-31' AS generated_at, '{','.join(FEATURES)}' AS feature_order, 'time_holdout' AS split,
  {START} AS train_start_year, {TEST} AS test_year, train::BIGINT AS train_count, test::BIGINT AS test_count, mae AS metric_mae, rmse AS metric_rmse, mape AS metric_mape, {START} AS deploy_start, {TEST} AS deploy_latest, deploy::BIGINT AS deploy_count, true AS all_rows,
  'regression' AS objective, '1' AS max_depth, '{_BY_GAIN}' AS importance, true AS tuning_enabled, 30 AS n_trials, CASE WHEN region = 'ASIA' THEN 0 ELSE 30 END AS completed_trials, CASE WHEN region <> 'ASIA' THEN {VALIDATION} END AS validation_year,
  CASE WHEN region <> 'ASIA' THEN mae END AS best_mae, CASE WHEN region <> 'ASIA' THEN mae + 250 END AS best_score, 20 AS max_estimators, CAST(NULL AS INTEGER) AS num_leaves_max, 6 AS max_depth_max, 250.0::DOUBLE AS size_penalty
FROM c JOIN errors USING (region)""",
)
def k04_round_trip(spark, sf):
    """Every field of the document, written as JSON and read back; absent ones are null."""
    rows = materialized(C.clean(spark, sf, "transaction_year", "station", *C.CATEGORIES), "clean")
    path = sources.scratch(spark, "metadata")
    metadata.write_metadata(_documents(rows, stumps(rows.filter(_WHERE_TRAIN))), path)
    return metadata.read_metadata(spark, path).selectExpr(*[f"{e} AS {n}" for n, e in _FLAT.items()])


# ------------------------------------------------------------ publishing

_RUNS = ((1, VALIDATION), (2, TEST))
_PUBLISHED = f"""{C._CLEAN}, {', '.join(_stumps_sql(f'model{k}', f"transaction_year >= {START} AND transaction_year < {y}") for k, y in _RUNS)},
runs AS ({' UNION ALL '.join(f"SELECT region, {k} AS run, round(avg(abs(price - CASE WHEN area <= cut THEN low ELSE high END)), 1) AS mae FROM clean JOIN model{k} USING (region) WHERE transaction_year = {y} GROUP BY region" for k, y in _RUNS)}),
best AS (SELECT region, CASE WHEN max(CASE WHEN run = 2 THEN mae END) < max(CASE WHEN run = 1 THEN mae END) OR max(CASE WHEN run = 1 THEN mae END) IS NULL THEN 2 ELSE 1 END AS run FROM runs GROUP BY region),
shown AS (SELECT 'best' AS policy, region, run FROM best UNION ALL SELECT 'latest', region, max(run) FROM runs GROUP BY region),
vals AS (SELECT region, run, count(*) AS n FROM (SELECT DISTINCT region, run, f, v FROM (SELECT region, k.run, unnest([{', '.join(f"{{'f': '{c}', 'v': {c}}}" for c in C.CATEGORIES)}], recursive := true) FROM clean, (VALUES {', '.join(f'({k}, {y})' for k, y in _RUNS)}) k(run, upto) WHERE transaction_year <= upto) WHERE v IS NOT NULL) GROUP BY ALL),
hist AS (SELECT region, count(*) AS n FROM (SELECT DISTINCT region, station, transaction_year FROM clean WHERE transaction_year <= {VALIDATION}) GROUP BY region)"""


@query(
    "k07_m11_published_after_two_runs",
    f"""{_PUBLISHED} SELECT policy, s.region, 'metadata' AS kind, 'run' || s.run AS version, 1::BIGINT AS n FROM shown s
UNION ALL SELECT policy, s.region, 'model', 'run' || s.run, 3 FROM shown s
UNION ALL SELECT policy, s.region, 'categories', 'run' || s.run, v.n FROM shown s JOIN vals v ON v.region = s.region AND v.run = s.run
UNION ALL SELECT policy, s.region, 'history', 'run1', h.n FROM shown s JOIN hist h ON h.region = s.region""",
)
def k07(spark, sf):
    """What is published after two runs, by either policy, with the rows of each published copy.

    The second run makes no history, so that of the first stays.
    """
    rows = materialized(C.clean(spark, sf, "transaction_year", "station", *C.CATEGORIES), "clean")
    root = sources.scratch(spark, "published")
    log = Log(spark, f"{root}/log", registry.MODELS, "model_key")
    for run, test in _RUNS:
        upto, at = rows.filter(F.col("transaction_year") <= test), f"{root}/run{run}"
        nodes = materialized(stumps(rows.filter(F.col("transaction_year").between(START, test - 1))), "nodes")
        errors = materialized(_errors(_predicted(rows.filter(F.col("transaction_year") == test), nodes)), "errors")
        metadata.write_metadata(_documents(upto, nodes, test, errors), f"{at}/metadata")
        nodes.write.partitionBy("region").parquet(f"{at}/model")
        sources.write_json(sources.dictionary_documents(cleaning.build_category_dictionary(upto)), f"{at}/categories")
        if run == 1:
            sources.write_json(history.price_history(upto), f"{at}/history")
        models = errors.select("region", "mae", F.lit(run).cast("long").alias("model_id"), F.concat("region", F.lit(f"/{run}")).alias("model_key"), F.lit(at).alias("model_path"))
        commit = registry.register_models(log, models)
        added = log.rows().filter(F.col("commit") == commit)
        for policy in publishing.POLICIES:
            for (region,) in publishing.due(added, policy).select("region").collect():  # one a region
                own = {k: f"{at}/{k}/{stores.partition_folder('region', region)}" for k in ("model", "categories", "history")} | {"metadata": metadata.folder_of(f"{at}/metadata", region)}
                publishing.publish(spark, f"{root}/{policy}", region, f"run{run}", own)
    parts = []
    for policy in publishing.POLICIES:
        public = f"{root}/{policy}"
        read = {
            "metadata": metadata.read_metadata(spark, *publishing.latest_paths(spark, public, "metadata")).select("region"),
            "model": spark.read.parquet(*publishing.latest_paths(spark, public, "model")).select(_region_of_copy()),
            "history": spark.read.schema("station string, year int, avg_price double").json(publishing.latest_paths(spark, public, "history")).select(_region_of_copy()),
            "categories": sources.read_dictionary(spark, publishing.latest_paths(spark, public, "categories"), _region_of_copy()).select("region"),
        }
        counts = reduce(DataFrame.unionByName, [df.groupBy("region").agg(F.count("*").alias("n")).withColumn("kind", F.lit(k)) for k, df in read.items()])
        parts.append(publishing.published(spark, public).join(counts, ["region", "kind"]).select(F.lit(policy).alias("policy"), "region", "kind", "version", "n"))
    return reduce(DataFrame.unionByName, parts)


def _region_of_copy():
    """The region of a published copy, by its place: .../region/versions/version/kind/file."""
    return F.url_decode(F.url_decode(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -5))).alias("region")  # once for the URI, once for the name


# ------------------------------------------------------------ requests by the tables of their region

_J07 = f"""{_EVALUATED.replace('WITH tx AS', 'WITH req AS (' + B.duck_view(B.REQUESTS) + '), tx AS')}, {C._POINTS.replace('FROM history', f"FROM (SELECT region, station, transaction_year AS year, {C._mean('price')} AS avg_price FROM clean GROUP BY ALL)")},
trend AS (SELECT region, station, CASE WHEN count(*) > 1 THEN (arg_max(avg_price, year) - arg_min(avg_price, year)) / (count(*) - 1) END AS trend FROM points WHERE from_end <= 4 GROUP BY ALL),
dict AS (SELECT region, station, row_number() OVER (PARTITION BY region ORDER BY station) AS id FROM (SELECT DISTINCT region, station FROM clean WHERE station IS NOT NULL)),
b AS (SELECT r.request_id, r.region, coalesce(d.id, 0) AS station_id, CASE WHEN area <= cut THEN low ELSE high END AS price, e.mae, area, t.trend FROM req r JOIN model USING (region) JOIN errors e USING (region) LEFT JOIN dict d ON d.region = r.region AND d.station = r.station LEFT JOIN trend t ON t.region = r.region AND t.station = r.station)"""


@query("j07_m06_requests_by_region", f"{_J07} SELECT request_id, region, station_id, price AS prediction, floor(trend * 100 + 0.5) / 100 AS trend, round(CASE WHEN area > 0 THEN price / area ELSE 0 END, 4) AS unit_price, round(greatest(0, price - mae), 1) AS lower, round(price + mae, 1) AS upper FROM b")
def j07_requests(spark, sf):
    """Requests joined to the model, dictionary, metadata and history of their region, in one scan of the requests."""
    rows = materialized(C.clean(spark, sf, "transaction_year", "station", *C.CATEGORIES), "clean")
    nodes = materialized(stumps(rows.filter(_WHERE_TRAIN)), "nodes")
    past = materialized(history.price_history(rows), "history")
    docs = materialized(_documents(rows, nodes), "documents")
    stations = cleaning.build_category_dictionary(rows, ("station",))
    asked = C._requests(spark, sf).drop("mae")
    scored = forest.score(asked, nodes, ["area"], 1)
    out = scoring.with_regional_tables(scored, stations, docs, past, TEST)
    return out.select("request_id", "region", "station_id", "prediction", R.rounded(F.col("trend"), 2).alias("trend"), F.round("unit_price", 4).alias("unit_price"), F.round("lower", 1).alias("lower"), F.round("upper", 1).alias("upper"))
