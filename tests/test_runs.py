"""Commits, publishing, documents, trees, archives, encodings, landing folders, stations and providers on small inputs."""

from __future__ import annotations

import gzip
import io
import json
import os
import random
import zipfile
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from tochi import functions as R
from tochi import sources
from tochi.operators import boosting, cleaning, features, forest, history, metadata, publishing, registry, stations, training
from tochi.plans import catalogue, runs
from tochi.schema import CATEGORIES
from tochi.sources import archives, stores
from tochi.sources.log import Conflict, Log

# ------------------------------------------------------------ commits


def test_one_of_many_creates_a_file(spark, tmp_path):
    path = f"{tmp_path}/c/1.json"
    with ThreadPoolExecutor(8) as pool:
        won = list(pool.map(lambda k: stores.put_if_absent(spark, path, str(k)), range(24)))
    assert sum(won) == 1 and stores.read_text(spark, path) == str(won.index(True))
    assert os.listdir(f"{tmp_path}/c") == ["1.json"]
    stores.put(spark, path, "new")
    assert stores.read_text(spark, path) == "new"


EVENTS = "event_id string, experiment_id long, status string, mae double, rmse double, mape double, event_order long"


def _events(spark, ids):
    return spark.createDataFrame([(str(k), k % 5, "success" if k % 3 else "failed", float(k), None, None, k) for k in ids], EVENTS)


def test_concurrent_writers_lose_nothing_and_add_nothing_twice(spark, tmp_path):
    def write(k):
        Log(spark, f"{tmp_path}/log", registry.EVENTS, "event_id").append(_events(spark, range(k * 5, k * 5 + 10)))

    with ThreadPoolExecutor(6) as pool:
        list(pool.map(write, range(6)))
    log = Log(spark, f"{tmp_path}/log", registry.EVENTS, "event_id")
    assert sorted(int(r.event_id) for r in log.rows().collect()) == list(range(35))
    assert log.version() == 6 and sorted({r.commit for r in log.rows().collect()})[-1] <= 6
    assert os.listdir(f"{tmp_path}/log/incoming") == [] and len([n for n in os.listdir(f"{tmp_path}/log/data") if not n.startswith(".")]) == 6
    assert log.append(_events(spark, range(35))) == 7 and log.rows().count() == 35
    assert log.summarize() == 7 and log.append(_events(spark, [99])) == 8
    assert log.rows().count() == 36 and log.rows(7).count() == 35 and log.rows().filter("commit = 8").count() == 1
    state = {r.experiment_id: (r.status, r.mae) for r in registry.experiment_state(log.rows()).collect()}
    assert state == {k: ("failed" if m % 3 == 0 else "success", float(m)) for k, m in ((0, 30), (1, 31), (2, 32), (3, 33), (4, 99))}


def test_a_commit_is_decided_again_when_another_was_first(spark, tmp_path):
    log = Log(spark, f"{tmp_path}/log", "k string, n long", "k")
    seen = []

    def decide(have, new):
        seen.append(have.count())
        if len(seen) == 1:
            Log(spark, f"{tmp_path}/log", "k string, n long", "k").append(spark.createDataFrame([("other", 1)], "k string, n long"))
        return new.withColumn("n", F.lit(have.count()).cast("long"))

    assert log.append(spark.createDataFrame([("own", 0), ("other", 5)], "k string, n long"), decide) == 2
    assert seen == [0, 1] and {tuple(r) for r in log.rows().collect()} == {("other", 1, 1), ("own", 1, 2)}
    with pytest.raises(ValueError, match="rows without k"):
        log.append(spark.createDataFrame([(None, 1)], "k string, n long"))
    with pytest.raises(Conflict):
        log.append(spark.createDataFrame([("z", 1)], "k string, n long"), attempts=0)


def test_lifecycle_of_experiments(spark, tmp_path):
    log = Log(spark, f"{tmp_path}/log", registry.EVENTS, "event_id")
    ids = spark.createDataFrame([(1,), (2,), (3,)], "experiment_id long")
    log.append(registry.started(ids))
    log.append(registry.completed(spark.createDataFrame([(1, 5.0, 6.0, 7.0)], "experiment_id long, mae double, rmse double, mape double")))
    log.append(registry.failed(ids.filter("experiment_id = 2")))
    log.append(registry.failed(ids.filter("experiment_id = 2")))
    got = {r.experiment_id: (r.status, r.mae) for r in registry.experiment_state(log.rows()).collect()}
    assert got == {1: ("success", 5.0), 2: ("failed", None), 3: ("running", None)} and log.rows().count() == 5


def _models(spark, rows):
    return spark.createDataFrame([(f"{r}/{m}", r, m, e) for r, m, e in rows], "model_key string, region string, model_id long, mae double")


def test_models_have_to_beat_what_the_log_holds(spark, tmp_path):
    log = Log(spark, f"{tmp_path}/log", registry.MODELS, "model_key")
    for rows in ([("a", 1, 5.0), ("a", 2, 5.0), ("a", 3, 4.0), ("b", 1, None)], [("a", 4, 4.0), ("b", 2, 9.0)], [("a", 5, 3.5), ("c", 1, 1.0)], [("a", 5, 3.5)]):
        registry.register_models(log, _models(spark, rows))
    got = {r.model_key: (r.became_latest, r.is_latest) for r in registry.registered(log.rows()).collect()}
    assert got == {"a/1": (True, False), "a/2": (False, False), "a/3": (True, False), "a/4": (False, False), "a/5": (True, True), "b/1": (True, False), "b/2": (True, True), "c/1": (True, True)}


def test_two_publishers_of_one_region_agree_on_one_latest(spark, tmp_path):
    with ThreadPoolExecutor(2) as pool:
        list(pool.map(lambda k: registry.register_models(Log(spark, f"{tmp_path}/log", registry.MODELS, "model_key"), _models(spark, [("a", k, 10.0 - k)])), [1, 2]))
    rows = registry.registered(Log(spark, f"{tmp_path}/log", registry.MODELS, "model_key").rows()).collect()
    assert [r.model_id for r in rows if r.is_latest] == [2]


# ------------------------------------------------------------ publishing


def _artifacts(tmp_path, run, kinds):
    out = {}
    for kind in publishing.KINDS:
        out[kind] = f"{tmp_path}/{run}/{kind}"
        if kind in kinds:
            os.makedirs(out[kind])
            (tmp_path / run / kind / "part.json").write_text(json.dumps({"from": run}))
    return out


def _seen(spark, public):
    return {r.kind: (r.version, spark.read.json(r.path).first()["from"]) for r in publishing.published(spark, public).collect()}


def test_readers_see_the_old_set_until_the_swap(spark, tmp_path):
    public = f"{tmp_path}/public"
    assert publishing.published(spark, public).isEmpty()
    publishing.publish(spark, public, "r/s", "v1", _artifacts(tmp_path, "one", publishing.KINDS))
    old = _seen(spark, public)
    assert old == {k: ("v1", "one") for k in publishing.KINDS}
    staged = publishing.stage(spark, public, "r/s", "v2", _artifacts(tmp_path, "two", ("model", "metadata")))
    assert _seen(spark, public) == old  # all copies are there, and nobody sees them
    staged = publishing.stage(spark, public, "r/s", "v2", {k: f"{tmp_path}/two/{k}" for k in publishing.KINDS})  # again, after a failure
    publishing.swap(spark, public, staged)
    assert _seen(spark, public) == {"model": ("v2", "two"), "metadata": ("v2", "two"), "categories": ("v1", "one"), "history": ("v1", "one")}
    with pytest.raises(ValueError):
        publishing.stage(spark, public, "r", "v3", {"onyx": "x"})


def test_policies(spark):
    models = spark.createDataFrame([("a", True), ("b", False)], "region string, became_latest boolean")
    assert [r.region for r in publishing.due(models).collect()] == ["a"]
    assert sorted(r.region for r in publishing.due(models, "latest").collect()) == ["a", "b"]
    with pytest.raises(ValueError):
        publishing.due(models, "newest")


# ------------------------------------------------------------ metadata


def test_documents_of_others_may_lack_fields_and_have_more(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"region": "x", "mae": 5, "later": {"y": 1}, "tuning": {"enabled": true}, "featureImportance": [{"feature": "area"}]}')
    row = metadata.read_metadata(spark, f"{tmp_path}/a.json").first()
    assert (row.region, row.mae, row.tuning.enabled, row.tuning.nTrials, row.evaluation, row.featureImportance[0].feature, row.featureImportance[0].importance) == ("x", 5.0, True, None, None, "area", None)


def test_documents_read_the_rows_no_more_once_regions_are_evaluated(spark, tmp_path):
    rows = [("r", 50.0 + k, float(k), 1996 + k % 6) for k in range(60)]
    spark.createDataFrame(rows, "region string, price double, area double, transaction_year int").write.parquet(f"{tmp_path}/facts")
    facts = spark.read.parquet(f"{tmp_path}/facts")
    docs = runs._documents(facts, runs.stumps(facts))
    assert "/facts" not in docs._jdf.queryExecution().optimizedPlan().toString() and not any("/facts" in f for f in docs.inputFiles())
    assert [(r.region, r.evaluation.trainCount, r.evaluation.testCount) for r in docs.collect()] == [("r", 50, 10)]


def test_importance_is_listed_by_gain_then_by_order(spark, tmp_path):
    evaluated = spark.createDataFrame([("r", "time_holdout", 8, 2, 10, 1.0, 2.0, 3.0), ("s t/=", "single_year_holdout", 4, 1, 5, 1.5, 2.5, None)], "region string, split string, train long, test long, deploy long, mae double, rmse double, mape double")
    gains = spark.createDataFrame([("r", "age", 0.2), ("r", "area", 0.2), ("r", "station", 0.6)], "region string, feature string, importance double")
    docs = metadata.documents(evaluated, "2025-01-01", 2020, 2025, 2025, {}, {"enabled": True}, gains)
    metadata.write_metadata(docs, f"{tmp_path}/m")
    back = {r.region: r for r in metadata.read_metadata(spark, f"{tmp_path}/m").collect()}
    assert [tuple(x) for x in back["r"].featureImportance] == [("station", 0.6), ("area", 0.2), ("age", 0.2)]
    assert back["s t/="].featureImportance == [] and back["s t/="].evaluation.metrics.mape is None and back["s t/="].tuning.completedTrials == 0
    assert metadata.read_metadata(spark, metadata.folder_of(f"{tmp_path}/m", "s t/=")).first().evaluation.split == "single_year_holdout"


# ------------------------------------------------------------ trees


@pytest.fixture(scope="module")
def regional(spark):
    rng = random.Random(5)
    rows = []
    for region in ("a/b", "c", "d"):
        for k in range(150):
            area, kind = float(rng.randint(10, 90)), rng.randint(0, 6)
            rows.append((region, k, area * 100 + kind * (500 if region == "c" else -300) + rng.random(), area, float(k % 40), float(k % 20), 2000.0 + k % 5, *[kind if c == "station" else k % 3 for c in CATEGORIES], k % 5 < 4, k % 5 == 4))
    names = ["region", "k", "price", "area", "age", "station_distance", "transaction_year", *(f"{c}_id" for c in CATEGORIES), "is_fit", "is_valid"]
    df = spark.createDataFrame(rows, names).repartition(2).persist()
    return df, {r: {c: 6 for c in CATEGORIES} for r in ("a/b", "c", "d")}


def test_one_scan_scores_as_the_models_do(spark, regional, tmp_path):
    df, sizes = regional
    frames = {r: df.filter(F.col("region") == r) for r in sizes}
    models = training.train_regions(frames, sizes, {"c": {"maxIter": 4, "maxDepth": 2}, "a/b": {"maxIter": 3}, "d": {"maxIter": 2}})
    training.save_regions(models, f"{tmp_path}/m")
    nodes, depth = forest.saved_nodes(spark, f"{tmp_path}/m"), forest.saved_depth(spark, f"{tmp_path}/m")
    assert depth == 5 and nodes.filter("nominal").count() > 0
    df.write.parquet(f"{tmp_path}/rows")
    asked = spark.read.parquet(f"{tmp_path}/rows")
    want = {}
    for r, m in models.items():
        want |= {(r, x.k): x.prediction for x in m.transform(training.nominal(frames[r], sizes[r])).collect()}
    scored = forest.score(asked, nodes, training.INPUTS, depth)
    assert scored._jdf.queryExecution().optimizedPlan().toString().count("/rows") <= 1
    assert scored._jdf.queryExecution().executedPlan().toString().count("FileScan") == 2  # the requests and the forests, each once
    for rows in (scored, forest.score(asked, nodes, training.INPUTS, depth, most=20)):
        got = {(x.region, x.k): x.prediction for x in rows.collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-12) for k in want)


def test_requests_without_a_model_go_and_odd_tables_are_refused(spark):
    nodes = spark.createDataFrame([("r", 0, 1.0, 0, 0, False, 5.0, None, 1, 2, None), ("r", 0, 1.0, 1, -1, False, None, None, -1, -1, 1.0), ("r", 0, 1.0, 2, -1, False, None, None, -1, -1, 2.0)], forest.NODES)
    asked = spark.createDataFrame([("r", 5.0), ("r", 5.1), ("r", None), ("q", 1.0)], "region string, x double")
    assert sorted(r.prediction for r in forest.score(asked, nodes, ["x"], 1).collect()) == [1.0, 2.0, 2.0]
    assert forest.score(asked, nodes.limit(0), ["x"], 1).isEmpty()
    with pytest.raises(Exception, match="not numbered from 0"):
        forest.score(asked, nodes.filter("node <> 1"), ["x"], 1).collect()


def test_equal_inputs_are_one_weighted_row_and_the_trees_are_the_same(spark, regional):
    df, sizes = regional
    rows = df.filter("region = 'c'").withColumn("age", F.lit(1.0)).withColumn("area", F.round(F.col("area") / 20) * 20)
    own = training.weighted(rows)
    assert own.count() < rows.count() and own.agg(F.sum("rows")).first()[0] == rows.count()
    plain = training.pipeline(sizes["c"], maxIter=3).fit(training.nominal(rows, sizes["c"]))
    model = training.train(rows, sizes["c"], maxIter=3)
    assert model.stages[-1].getWeightCol() == "rows"
    seen = [[r.prediction for r in m.transform(training.nominal(rows, sizes["c"])).orderBy("k").collect()] for m in (plain, model)]
    assert seen[1] == pytest.approx(seen[0], rel=1e-9)
    assert list(model.stages[-1].featureImportances.toArray()) == pytest.approx(list(plain.stages[-1].featureImportances.toArray()), abs=1e-9)
    counted = training.train(rows, sizes["c"], maxIter=1, minInstancesPerNode=5)  # rows have to be counted there
    assert not counted.stages[-1].isDefined("weightCol")


def test_rows_that_stand_for_equal_ones_count_as_all_of_them(spark, regional):
    df, sizes = regional
    odd = df.filter("region <> 'd'").drop("k").withColumn("area", F.when(F.col("area") < 70, F.round(F.col("area") / 20) * 20).otherwise(F.col("area") * 3)).withColumn("price", F.round(F.col("price") / 500) * 500)
    all_of = odd.unionByName(odd.filter("age < 9")).unionByName(odd.filter("age < 3"))
    few = all_of.groupBy(*all_of.columns).agg(F.count("*").alias("rows"))
    assert few.count() < all_of.count() == training.expanded(few).count()
    rows = lambda own: sorted(map(tuple, own.collect()))
    for c in ("price", "area"):
        assert rows(cleaning.iqr_bounds(few, c, weight="rows")) == rows(cleaning.iqr_bounds(all_of, c))
    kept = cleaning.remove_iqr_outliers(few, weight="rows")
    assert 0 < kept.count() < few.count() and rows(training.expanded(kept)) == rows(cleaning.remove_iqr_outliers(all_of).select(kept.drop("rows").columns))
    assert rows(training.weighted(few)) == rows(training.weighted(all_of))  # prices are whole, so their sums are exact
    assert rows(boosting.merged(few)) == rows(boosting.merged(all_of))
    guess = F.col("area") * 90
    assert rows(history.metrics(few.withColumn("prediction", guess), ["region"], weight="rows"))[0][1:] == pytest.approx(rows(history.metrics(all_of.withColumn("prediction", guess), ["region"]))[0][1:], rel=1e-12)
    assert rows(history.mean_model(few, weight="rows")) == rows(history.mean_model(all_of))
    mark = lambda own: own.select("region", "rows" if "rows" in own.columns else F.lit(1).alias("rows"), "transaction_year", F.col("is_fit").alias("is_train"), F.col("is_valid").alias("is_test"), F.lit(True).alias("timed"))
    assert rows(metadata.split_counts(mark(few), 2001, 2003, weight="rows")) == rows(metadata.split_counts(mark(all_of), 2001, 2003))


def test_models_are_fitted_on_each_different_row_once(spark, tmp_path):
    for t in ("orders", "part", "supplier", "nation", "region", "lineitem"):
        df = spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet")
        (df.unionByName(df).unionByName(df) if t == "lineitem" else df).write.parquet(f"{tmp_path}/{t}.parquet")
    once, thrice = (catalogue._regional(spark, sf)[0] for sf in ("/root/testdata/sf0.001", str(tmp_path)))
    assert thrice.count() == once.count() and thrice.agg(F.sum("rows")).first()[0] == 3 * once.agg(F.sum("rows")).first()[0] == 3 * catalogue.clean(spark, "/root/testdata/sf0.001").count()


def test_forests_walked_in_batches_take_odd_inputs_as_rows_do(spark):
    node = lambda k, feature, threshold, categories, left, right, value: ("r", 0, 2.0, k, feature, categories is not None, threshold, categories, left, right, value)
    nodes = [node(0, 0, None, [0.0, 3.0, 9.0], 1, 2, None), node(1, 1, 5.0, None, 3, 4, None), node(2, -1, None, None, -1, -1, 1.0), node(3, -1, None, None, -1, -1, 10.0), node(4, -1, None, None, -1, -1, 100.0)]
    kinds, values = (0.0, 3.0, 9.0, 8.0, 10.0, -1.0, 0.5, 1e300, None, float("nan"), float("inf")), (5.0, 5.1, None, float("nan"), float("-inf"))
    asked = spark.createDataFrame([("r", a, b) for a in kinds for b in values], "region string, a double, b double")
    got = {(repr(x.a), repr(x.b)): x.prediction for x in forest.score(asked, spark.createDataFrame(nodes, forest.NODES), ["a", "b"], 2).collect()}
    leaf = lambda a, b: 1.0 if a not in (0.0, 3.0, 9.0) else 10.0 if b is not None and b <= 5.0 else 100.0
    assert got == {(repr(a), repr(b)): 2 * leaf(a, b) for a in kinds for b in values}
    one = spark.createDataFrame([("r", 0, 1.0, 0, -1, False, None, None, -1, -1, 7.0)], forest.NODES)
    plan = forest.score(asked, one, ["a", "b"], 0)
    assert {x.prediction for x in plan.collect()} == {7.0} and "aggregate(" not in plan._jdf.queryExecution().optimizedPlan().toString()


def test_the_best_trial_does_not_depend_on_threads(spark, regional):
    df, sizes = regional
    frames = {r: df.filter(F.col("region") == r) for r in ("a/b", "c")}
    one, eight = (training.tune_regions(frames, sizes, trials=3, max_trees=2, threads=t) for t in (1, 8))
    assert one[0] == eight[0] and sorted(map(tuple, one[1].collect())) == sorted(map(tuple, eight[1].collect()))
    assert one[1].count() == 6 and training.draws(3) == training.draws(30)[:3]
    assert training.tune_regions.__defaults__[0] == 30


def test_models_grown_side_by_side_are_those_of_spark_ml(spark, regional, monkeypatch):
    df, sizes = regional
    monkeypatch.setattr(boosting, "BLOCK", 40)  # many blocks a region, some with equal rows
    df = df.unionByName(df.filter("k % 3 = 0")).unionByName(df.filter("k % 50 = 0")).withColumns({"area": F.round(F.col("area") / 4) * 4, "age": F.col("k") % 23 * 1.0})
    df = df.withColumn("is_valid", F.col("is_fit"))  # splits that part the fitted rows alike are equally good
    asked = [{"stepSize": 0.2, "maxDepth": 3, "minInstancesPerNode": 7, "maxIter": 4}, {"maxDepth": 5, "maxIter": 2}]
    frames = {r: df.filter(F.col("region") == r) for r in ("a/b", "c")}
    errors = boosting.grow(training.together(frames), sizes, {r: asked for r in frames})
    for r, own in frames.items():
        for t, parameters in enumerate(asked):
            model = training.pipeline(sizes[r], **parameters).fit(training.nominal(own.filter("is_fit"), sizes[r]))
            want = model.stages[-1].evaluateEachIteration(model.stages[0].transform(training.nominal(own.filter("is_valid"), sizes[r])), "absolute")
            assert errors[r, t] == pytest.approx(list(want), rel=1e-9)
    nodes = boosting.grown(training.together(frames), sizes, dict.fromkeys(frames, asked[0]))
    model = training.pipeline(sizes["c"], **asked[0]).fit(training.nominal(frames["c"].filter("is_fit"), sizes["c"]))
    want = {x.k: x.prediction for x in model.transform(training.nominal(frames["c"], sizes["c"])).collect()}
    got = {x.k: x.prediction for x in forest.score(frames["c"], nodes, training.INPUTS, 3).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-9) for k in want)


def test_the_jobs_of_a_search_do_not_grow_with_its_trials(spark, regional):
    df, sizes = regional
    frames, jobs = {"c": df.filter("region = 'c'")}, {}
    for trials in (2, 6):
        spark.sparkContext.setJobGroup(f"search of {trials}", "")
        chosen = [{"maxDepth": 2, "maxIter": 2, "subsamplingRate": 0.8}] * trials
        boosting.grow(training.together(frames), sizes, {"c": chosen})
        jobs[trials] = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"search of {trials}"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < jobs[6] == jobs[2]


def test_arrays_of_blocks_are_files_of_which_the_named_are_read(spark, regional, tmp_path, monkeypatch):
    arrays = {n: np.arange(6).astype(k) for n, k in boosting.ARRAYS.items()}
    path = boosting.saved(f"{tmp_path}/a b", arrays)
    got = boosting.loaded(path, "predicted", "codes")
    assert [a.dtype for a in got] == [np.float64, np.int32] and all((a == np.arange(6)).all() for a in got)
    df, sizes = regional
    monkeypatch.setattr(boosting, "scratch", lambda spark, label: f"{tmp_path}/{label}-{len(os.listdir(tmp_path))}")
    monkeypatch.setattr(boosting.stores, "remove", lambda spark, path: None)
    boosting.grow(training.together({"c": df.filter("region = 'c'")}), sizes, {"c": [{"maxIter": 2, "maxDepth": 1}]})
    tables = [n for n in os.listdir(tmp_path) if n.startswith("blocks")]
    seen = {f"{tmp_path}/{n}": spark.read.parquet(f"{tmp_path}/{n}/table") for n in tables}
    assert len(seen) == 3 and {r.file is None or r.file.startswith(f"{p}/arrays/") for p, t in seen.items() for r in t.collect()} == {True}
    assert all(f.dataType.simpleString() != "binary" for t in seen.values() for f in t.schema)  # arrays pass no rows of Spark


def test_features_added_up_together_come_apart_as_they_are():
    rng, bins = np.random.default_rng(1), [100, 50, 30, 5, 2, 6, 2001, 26, 1]
    groups = boosting.joined(bins)
    assert sorted(f for g in groups for f in g) == list(range(len(bins))) and len(groups) < 6 and [6] in groups
    assert all(len(g) == 1 or np.prod([bins[f] for f in g]) <= boosting.JOINT for g in groups)
    at, codes, w = rng.integers(0, 3, 500), np.array([rng.integers(0, k, 500) for k in bins]), rng.integers(0, 9, (2, 500)) / 1.0
    sums = []
    for g in groups:
        width, code = int(np.prod([bins[f] for f in g])), np.ravel_multi_index([codes[f] for f in g], [bins[f] for f in g])
        sums.append(np.array([np.bincount(at * width + code, x, 3 * width).reshape(3, width) for x in w]))
    got = boosting.parted(sums, groups, bins)
    assert (got == np.concatenate([np.array([np.bincount(at * k + c, x, 3 * k).reshape(3, k) for x in w]) for k, c in zip(bins, codes)], axis=2)).all()


def test_equal_rows_are_drawn_one_by_one():
    keys, n = np.random.default_rng(3).integers(0, 1 << 62, 20_000).astype(np.uint64), np.repeat([1, 2, 9, 255], 5000).astype(np.uint8)
    got = boosting.drawn(keys, n, 0.8, 7)
    assert (got <= n).all() and (got == boosting.drawn(keys, n, 0.8, 7)).all() and (got != boosting.drawn(keys, n, 0.8, 8)).any()
    for c in (1, 2, 9, 255):
        own = got[n == c] / 1.0
        assert abs(own.mean() - 0.8 * c) < 5 * (0.16 * c / 5000) ** 0.5 and abs(own.var() / (0.16 * c) - 1) < 0.15
    assert (boosting.drawn(keys, n, 1.0, 7) == n).all()


# ------------------------------------------------------------ archives, encodings, folders


@pytest.mark.parametrize("text", ["plain", "é東京😀" * 3, "", "é", "😀"])
@pytest.mark.parametrize("spoiled", [None, b"\xe3\x81", b"\x80", b"\xff", b"\xed\xa0\x80", b"\xc0\x80", b"\xf5\x80\x80\x80", "日本語".encode("cp932")])
def test_encoding_of_ranges_is_that_of_the_whole_at_every_cut(text, spoiled):
    def whole(data):
        try:
            data.decode("utf-8")
        except UnicodeDecodeError:
            return False
        return True

    own = text.encode()
    for data in [own] if spoiled is None else [own[:k] + spoiled + own[k:] for k in range(len(own) + 1)]:
        for step in range(4, max(5, len(data) + 1)):
            over, ok = 0, True
            for start in range(0, max(1, len(data)), step):
                fine, skipped, more = archives.range_validity(io.BytesIO(data), start, min(start + step, len(data)))
                ok, over = ok and fine and skipped == over, more
            assert ok == whole(data), (data, step)


def test_files_are_told_apart_by_ranges(spark, tmp_path):
    (tmp_path / "a.csv").write_text("é東京😀," * 50)
    (tmp_path / "b.csv").write_bytes("日本語," .encode("cp932") * 50)
    (tmp_path / "c.csv").write_bytes(b"")
    (tmp_path / "d.csv").write_bytes("x".encode() * 99 + "é".encode()[:1])
    (tmp_path / "sp ace+.csv").write_text("ok")
    for size in (4, 7, 1000):
        got = {r.path.rsplit("/", 1)[-1]: r.is_utf8 for r in archives.encodings(spark, [str(tmp_path)], size).collect()}
        assert got == {"a.csv": True, "b.csv": False, "c.csv": True, "d.csv": False, "sp ace+.csv": True}


def test_gzipped_files_are_told_apart_by_what_they_hold(spark, tmp_path):
    text = "種類,駅\n" + "土地,新宿\n" * 5000
    held = {"a.csv.gz": text.encode(), "b.csv.gz": text.encode("cp932"), "c.CSV.GZ": b"", "d.csv.gz": text.encode() + "é".encode()[:1]}
    for name, data in held.items():
        (tmp_path / name).write_bytes(gzip.compress(data))
    for size in (4, 1000, 1 << 20):
        got = {r.path.rsplit("/", 1)[-1]: r.is_utf8 for r in archives.encodings(spark, [str(tmp_path)], size).collect()}
        assert got == {"a.csv.gz": True, "b.csv.gz": False, "c.CSV.GZ": True, "d.csv.gz": False}
    rows = sources.read_transaction_csv(spark, [f"{tmp_path}/a.csv.gz", f"{tmp_path}/b.csv.gz"])
    assert rows.groupBy("種類", "駅").count().collect() == [("土地", "新宿", 10000)]


def test_landed_files_are_gzipped(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sources, "scratch", lambda spark, label: f"{tmp_path}/{label}-{len(os.listdir(tmp_path))}")
    for encoding in ("UTF-8", sources.JAPANESE):
        path = catalogue._landed(spark, spark.createDataFrame([("新宿",)], "`駅` string"), encoding)
        assert [n.split(".", 1)[1] for n in os.listdir(path) if n.startswith("part")][0].endswith("csv.gz")
        assert sources.read_transaction_csv(spark, [path]).collect() == [("新宿",)]


def test_transcoded_files_may_be_compressed(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(("種類,駅\n" + "土地,新宿\n" * 500).encode("cp932"))
    sources.transcode_to_utf8(spark, [f"{tmp_path}/a.csv"], f"{tmp_path}/utf8", "gzip")
    names = [n for n in os.listdir(f"{tmp_path}/utf8") if not n.startswith((".", "_"))]
    assert names and all(n.endswith(".csv.gz") for n in names)
    rows = spark.read.option("header", True).csv(f"{tmp_path}/utf8")
    assert {tuple(r) for r in rows.collect()} == {("土地", "新宿")} and rows.count() == 500
    sources.transcode_to_utf8(spark, [f"{tmp_path}/a.csv"], f"{tmp_path}/plain")
    assert "土地" in "".join(open(f"{tmp_path}/plain/{n}").read() for n in os.listdir(f"{tmp_path}/plain") if n.endswith(".csv"))


def test_archives_of_different_columns(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(archives, "BLOCK", 64)
    with zipfile.ZipFile(tmp_path / "a.ZIP", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("x.txt", "no")
        z.writestr("d/t.Csv", "﻿駅,b\n" + "".join(f'"東{k}","l1\nl2, {k}"\n' for k in range(40)))
        z.writestr("u.csv", "not,this\n1,2\n")
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("t.csv", "駅,c\r\n新宿,\r\n,7\r\n".encode("cp932"))
    with zipfile.ZipFile(tmp_path / "c.zip", "w") as z:
        z.writestr("t.csv", "駅\n")
    df = sources.read_zipped_csv(spark, [str(tmp_path)])
    assert sorted(df.columns) == ["b", "c", "駅"]
    rows = {(r["駅"], r.b, r.c) for r in df.collect()}
    assert rows == {(f"東{k}", f"l1\nl2, {k}", None) for k in range(40)} | {("新宿", None, None), (None, None, "7")}
    assert df.select("c").rdd.getNumPartitions() == 3
    assert archives.ZippedCsv({"paths": f"{tmp_path}/b.zip"}).schema().fieldNames() == ["駅", "c"]


def test_folders_are_expanded_by_suffix(spark, tmp_path):
    for name in ("x/a.CSV", "x/y/b.Zip", "x/y/c.json", "x/_SUCCESS", "x/.hidden", "x/plain"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("")
    got = {k: sorted(p.rsplit("/", 1)[-1] for p in v) for k, v in sources.by_suffix(spark, [f"{tmp_path}/x"]).items()}
    assert got == {"csv": ["a.CSV", "plain"], "zip": ["b.Zip"], "json": ["c.json"]}


def test_payloads_of_the_api_are_as_many_as_batches_and_in_all_shapes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sources, "scratch", lambda spark, label: f"{tmp_path}/{label}")
    path = catalogue._wrapped(spark, "/root/testdata/sf0.001")
    texts = [open(f"{path}/{n}").read() for n in os.listdir(path)]
    assert {t[: t.index("[")] for t in texts} == {"", *(f'{{"{k}":' for k in sources.WRAPPERS)}
    assert all(t.rstrip("}").endswith(',"not a record"]') for t in texts)
    assert len(texts) < 50  # one file a supplier and line number was 70 here, and grew with the suppliers


def test_records_of_payloads_are_maps_of_strings(spark, tmp_path):
    for k, text in enumerate(('[{"a": "1", "b": null, "c": 2, "d": {"e": [1, "x"]}, "f": true}, 5, "no", null, [1]]', '{"items": [{"a": "2"}]}', '{"a": "3"}', '"no"', "[]", '{"data": [7]}')):
        (tmp_path / f"{k}.json").write_text(text)
    got = sorted((r.record for r in sources.read_api_json(spark, [str(tmp_path)]).collect()), key=lambda r: r["a"])
    assert got == [{"a": "1", "b": None, "c": "2", "d": '{"e":[1,"x"]}', "f": "true"}, {"a": "2"}, {"a": "3"}]


def test_payloads_may_be_gzipped_and_texts_are_looked_up_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sources, "scratch", lambda spark, label: f"{tmp_path}/{label}")
    path = catalogue._wrapped(spark, "/root/testdata/sf0.001", compressed=True)
    assert {n.split(".", 1)[1] for n in os.listdir(path)} == {"json.gz"}
    os.makedirs(tmp_path / "plain")
    for n in os.listdir(path):
        (tmp_path / "plain" / n.removesuffix(".gz")).write_bytes(gzip.decompress((tmp_path / "api" / n).read_bytes()))
    packed, plain = (sources.read_api_json(spark, [p]) for p in (path, f"{tmp_path}/plain"))
    seen = lambda own: sorted(str(sorted(r.record.items())) for r in own.collect())
    assert seen(packed) == seen(plain) and packed.count() > 5000
    assert set(sources.by_suffix(spark, [path])) == {"json"}
    assert sources.read_transactions(spark, [path]).count() == packed.count()
    plan = sources.normalize_api(packed).select("age")._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.count("buildingYear") <= 2  # once for each place that named it before, and too much code to be compiled


def test_landing_folders_with_and_without_quarters(spark, tmp_path):
    for place, text in {"tokyo/2020": "1\n2\n", "tokyo/2021/q1": "3\n", "tokyo/2021/q4": "4\n", "chi ba/year=2020": "5\n", "region=chiba/2019/2": "6\n"}.items():
        (tmp_path / place).mkdir(parents=True)
        (tmp_path / place / "f 1.csv").write_text(text)
    rows = lambda **k: sorted((r.v, r.region, r.year, r.quarter) for r in sources.read_landed(spark, str(tmp_path), "v int", **k).collect())
    assert rows() == [(1, "tokyo", 2020, None), (2, "tokyo", 2020, None), (3, "tokyo", 2021, 1), (4, "tokyo", 2021, 4), (5, "chi ba", 2020, None), (6, "chiba", 2019, 2)]
    assert rows(regions=["tokyo"], years=[2021], quarters=[4]) == [(4, "tokyo", 2021, 4)] and rows(regions=["none"]) == []
    read = sources.read_landed(spark, str(tmp_path), "v int", regions=["tokyo"], years=[2020])
    assert [f.rsplit("/", 3)[-3:-1] for f in read.inputFiles()] == [["tokyo", "2020"]]  # other folders are not read


# ------------------------------------------------------------ stations


def _nearest(asked, held):
    import math

    def km(a, b, c, d):
        h = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
        return round(2 * 6371.0 * math.atan2(math.sqrt(h), math.sqrt(1 - h)), 6)

    return {k: (None, None) if lat is None or lon is None else min((km(lat, lon, y, x), p) for p, y, x in held)[::-1] for k, lat, lon in asked}


@pytest.mark.parametrize("rows", [stations.BROADCAST_ROWS, 0])
def test_stations_of_any_position_and_density(spark, monkeypatch, rows):
    rng = random.Random(2)
    monkeypatch.setattr(stations, "BROADCAST_ROWS", rows)
    monkeypatch.setattr(stations, "DENSE", 20)
    monkeypatch.setattr(stations, "HOT_CELL", 30)
    held = [((1 << 20) + 5, 35.7, 139.7), (5, -10.0, 100.0), (6, 35.7, 139.7 + 1e-9)]
    held += [(100 + k, 35.0 + rng.random() / 50, 139.0 + rng.random() / 50) for k in range(150)] + [((1 << 40) + k, rng.uniform(-80, 80), rng.uniform(-180, 180)) for k in range(30)]
    asked = [(k, 35.0 + rng.random() / 50, 139.0 + rng.random() / 50) for k in range(60)] + [(100 + k, rng.uniform(-90, 90), rng.uniform(-180, 180)) for k in range(40)]
    asked += [(200, 35.71, 139.7), (201, None, 1.0), (202, 1.0, None), (203, 0.0, 180.0)]
    st = spark.createDataFrame([(p, f"s{p}", f"n{p}", "r", y, x) for p, y, x in held], "position long, station_id string, station_name string, region string, lat double, lon double")
    rq = spark.createDataFrame(asked, "request_id long, lat double, lon double")
    got = {r.request_id: r for r in stations.nearest_station(rq, st).collect()}
    want = _nearest(asked, held)
    assert {k: r.station_id for k, r in got.items()} == {k: p and f"s{p}" for k, (p, _) in want.items()}
    assert all(got[k].km == (d if d is None else pytest.approx(d, abs=2e-6)) for k, (_, d) in want.items())
    assert got[201].walk_minutes is None
    third = stations.fallback_region(spark.createDataFrame([tuple(got[201]), tuple(got[200])], stations.nearest_station(rq, st).schema).withColumns({"address_region": F.lit(None).cast("string"), "current_region": F.lit("current")}))
    assert [r.region for r in third.orderBy("request_id").collect()] == ["r", "current"]


@pytest.mark.parametrize("crowded", [1000, 3])
def test_stations_at_one_place_are_one_candidate_and_nothing_is_sorted(spark, monkeypatch, crowded):
    monkeypatch.setattr(stations, "CROWDED", crowded)
    met, around = [], stations._around
    monkeypatch.setattr(stations, "_around", lambda places, side: met.append((places.count(), side)) or around(places, side))
    held = [(1000 - k, 35.0 + k % 5 / 100, 139.0) for k in range(500)]
    asked = [(k, 35.0 + k / 1000, 139.001) for k in range(50)]
    st = spark.createDataFrame([(p, f"s{p}", f"n{p}", "r", y, x) for p, y, x in held], "position long, station_id string, station_name string, region string, lat double, lon double")
    df = stations.nearest_station(spark.createDataFrame(asked, "request_id long, lat double, lon double"), st)
    assert {r.request_id: r.station_id for r in df.collect()} == {k: f"s{p}" for k, (p, _) in _nearest(asked, held).items()}
    assert {n for n, _ in met} == {5} and min(side for _, side in met) >= stations.FIRST  # 500 stations at 5 places are not dense
    if crowded == 1000:
        places = st.groupBy("lat", "lon").agg(F.min("position").alias("position"))
        plan = stations._in_grid(spark.range(9).select(F.col("id").alias("request_id"), F.lit(35.0).alias("lat"), F.lit(139.0).alias("lon")), places, 0.1)
        assert "SortAggregate" not in plan._jdf.queryExecution().executedPlan().toString()


def test_no_stations_at_all(spark):
    rq = spark.createDataFrame([(1, 2.0, 3.0)], "request_id long, lat double, lon double")
    none = spark.createDataFrame([], "position long, station_id string, station_name string, region string, lat double, lon double")
    assert [tuple(r) for r in stations.nearest_station(rq, none).collect()] == [(1, None, None, None, None, None)]


@pytest.mark.parametrize(("name", "key"), [("　東京　（南口）", "東京"), (" \t新宿 ", "新宿"), ("\x1f\x85a b\x0b", "a b"), ("　", "")])
def test_station_keys_without_white_space_of_any_script(spark, name, key):
    assert spark.createDataFrame([(name,)], "n string").select(R.station_key(F.col("n"))).first()[0] == key == name.translate(str.maketrans("（）ヶヵ", "()ケカ")).split("(")[0].strip()


# ------------------------------------------------------------ providers


def test_fitted_providers_are_read_in_another_session(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0), (None, 7.0)], "station string, price double")
    fitted = features.fit_providers(df, [features.Columns("station", "price"), features.GroupMean("station", "price", "m"), features.GroupMean("station", "m", "mm")])
    assert features.feature_names(fitted) == ("station", "price", "m", "mm")
    fitted.write().overwrite().save(f"{tmp_path}/p")
    other = spark.newSession()
    asked = [("a",), ("new",), (None,)]
    back = PipelineModel.load(f"{tmp_path}/p")
    assert features.feature_names(back) == ("station", "price", "m", "mm")
    rows = lambda s, m: sorted(map(str, m.transform(s.createDataFrame([(*a, 0.0) for a in asked], "station string, price double")).collect()))
    assert rows(spark, fitted) == rows(other, back)
    with pytest.raises(ValueError, match="missing columns"):
        back.transform(df.drop("price"))
    assert {r.station: (r.m, r.mm) for r in fitted.transform(df).collect()} == {"a": (2.0, 2.0), "b": (5.0, 5.0), None: (4.0, 3.25)}
