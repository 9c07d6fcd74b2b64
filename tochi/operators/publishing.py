"""Publishing: artifacts of a run copied to where requests are served from.

A region has a folder of versions and a pointer, ``latest.json``, that names for each kind
of artifact the copy to use. All copies are made first; then one rename puts the new
pointer in place of the old. Readers that go by the pointer see the old set or the new
set, never a mixture, and a publisher that dies leaves the old set. A kind that the run
did not make stays as it was published before.

One publisher a region at a time: the log of models decides which run that is.
"""

from __future__ import annotations

import json
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tochi.sources import stores

KINDS = ("model", "categories", "metadata", "history")
POLICIES = ("best", "latest")
POINTER = "region string, version string, artifacts array<struct<kind: string, version: string, path: string>>"


def due(models: DataFrame, policy: str = "best") -> DataFrame:
    """``models`` (became_latest) that are to be published: those that became latest, or all of them."""
    if policy not in POLICIES:
        raise ValueError("policy is 'best' or 'latest'")
    return models.filter("became_latest") if policy == "best" else models


def _place(public: str, region: str) -> str:
    return f"{public}/{quote(region, safe='')}"


def pointer_of(spark: SparkSession, public: str, region: str) -> dict:
    """The pointer of a region; empty if it has none."""
    path = f"{_place(public, region)}/latest.json"
    return json.loads(stores.read_text(spark, path)) if stores.exists(spark, path) else {"region": region, "version": None, "artifacts": []}


def stage(spark: SparkSession, public: str, region: str, version: str, artifacts: dict[str, str]) -> dict:
    """Copy the artifacts that exist and return the pointer to swap in.

    Copies are named after version and kind, so a repeated publication overwrites its own.
    """
    unknown = set(artifacts) - set(KINDS)
    if unknown:
        raise ValueError(f"no artifacts are of kind {sorted(unknown)}")
    held = {a["kind"]: a for a in pointer_of(spark, public, region)["artifacts"]}
    for kind, source in artifacts.items():
        if not stores.exists(spark, source):
            continue
        target = f"{_place(public, region)}/versions/{version}/{kind}"
        stores.remove(spark, target)
        stores.copy(spark, source, target)
        held[kind] = {"kind": kind, "version": version, "path": stores.qualified(spark, target)}
    return {"region": region, "version": version, "artifacts": [held[k] for k in KINDS if k in held]}


def swap(spark: SparkSession, public: str, pointer: dict) -> None:
    """Make a staged pointer the one that readers see."""
    stores.put(spark, f"{_place(public, pointer['region'])}/latest.json", json.dumps(pointer, ensure_ascii=False))


def publish(spark: SparkSession, public: str, region: str, version: str, artifacts: dict[str, str]) -> None:
    swap(spark, public, stage(spark, public, region, version, artifacts))


def published(spark: SparkSession, public: str) -> DataFrame:
    """(region, kind, version, path) of what is published for all regions."""
    if not any(stores.exists(spark, f"{public}/{r}/latest.json") for r in stores.names(spark, public)):
        return spark.createDataFrame([], "region string, kind string, version string, path string")
    found = spark.read.schema(POINTER).json(f"{public}/*/latest.json")
    return found.select("region", F.explode("artifacts").alias("a")).select("region", "a.kind", "a.version", "a.path")


def latest_paths(spark: SparkSession, public: str, kind: str) -> list[str]:
    """The published copies of a kind, one a region."""
    return [r["path"] for r in published(spark, public).filter(F.col("kind") == kind).select("path").collect()]
