"""Every registered query of the transaction engine against its SQL on small tables."""

from __future__ import annotations

import math
from collections import Counter

import duckdb
import pytest

from tochi.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem".split()


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    return x if isinstance(x, bool) else float(x) if isinstance(x, (int, float)) else str(x)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


MODELS = ("m01_m06_against_the_mean", "m05_o03_importance_sums", "m02_m04_tune_and_deploy", "k06_saved_models")


@pytest.fixture
def quick(monkeypatch):
    """One small tree where a query asks for the default number, and few trials; what was asked for."""
    train, tune, asked = catalogue.training.train, catalogue.training.tune_regions, []

    def quick_train(df, sizes, **parameters):
        asked.append(parameters)
        return train(df, sizes, **{"maxIter": 1, "maxDepth": 2} | parameters)

    def quick_tune(frames, sizes, **parameters):
        asked.append(("tune", parameters))
        return tune(frames, sizes, trials=2, max_trees=1)

    monkeypatch.setattr(catalogue.training, "train", quick_train)
    monkeypatch.setattr(catalogue.training, "tune_regions", quick_tune)
    return asked


def _equal(spark, duck, name, sql):
    df = catalogue.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    rel = duck.sql(sql)
    names = list(rel.columns)
    assert sorted(names) == cols
    got = Counter(tuple(plain(r[c]) for c in cols) for r in df.collect())
    assert got == Counter(tuple(plain(r[names.index(c)]) for c in cols) for r in rel.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.ORACLES) - set(MODELS)))
def test_equals_sql(spark, duck, name):
    _equal(spark, duck, name, catalogue.ORACLES[name])


@pytest.mark.parametrize("name", MODELS)
def test_models_equal_sql(spark, duck, quick, name):
    sql = catalogue.ORACLES[name]
    if name.startswith("m02"):
        sql = sql.replace(f"{catalogue.training.TRIALS}::BIGINT", "2::BIGINT")
    _equal(spark, duck, name, sql)


def test_models_are_made_of_all_regions(spark, quick):
    regions = {r[0] for r in catalogue.clean(spark, SF).select("region").distinct().collect()}
    assert len(regions) > 1
    for name in ("m01_m06_train_and_score", "m05_o03_feature_importance", "k04_k06_metadata_and_model"):
        assert {r.region for r in catalogue.QUERIES[name](spark, SF).collect()} == regions
    assert quick == [{}] * 3 * len(regions)  # no parameter of the operators is cut by the queries
    catalogue.QUERIES["m02_m04_tune_and_deploy"](spark, SF)
    assert quick[3 * len(regions)] == ("tune", {})
