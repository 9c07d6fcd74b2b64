"""Embedding near-duplicates by hashing to the E8 lattice.

Each table projects the unit vectors at random to BLOCKS x 8 dimensions and decodes
each eight to the nearest point of E8 (Conway and Sloane's decoder). A vector probes,
besides its own cell, the nearest neighbouring cells; candidates of any table are
verified by cosine in double precision. Vectors equal in label and components are
one class from the start and are never paired with each other.

Definitions for odd input: a vector that is null, zero, or holds null or non-finite
components, or whose label is null, links with nothing and is its own component;
vectors of different lengths do not link; rows with a repeated vec_id are vectors of
their own that share an id; of null vec_ids the component id is null unless linked.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tochi.llm.common import mix, saved, small_batches, table, with_facts
from tochi.llm.graph import components

COSINE = 0.98
#: Classes of one cell that meet in one task; a denser cell is dealt over blocks of so many.
BLOCK_CLASSES = 1000
TABLES, BLOCKS = 10, 2
#: Lattice units per unit of a projected coordinate.
SCALE = 0.75
#: Neighbouring cells probed for each block.
PROBES = 2
SEED = 20240229


@lru_cache(maxsize=1)
def minimal_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8, the steps to neighbouring cells."""
    out = []
    for i, j in combinations(range(8), 2):
        for s, t in product((-1.0, 1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = s, t
            out.append(v)
    out += [np.array(s) / 2 for s in product((-1.0, 1.0), repeat=8) if np.prod(s) > 0]
    return np.array(out)


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    near = np.rint(x)
    odd = np.flatnonzero(near.sum(axis=1) % 2 != 0)
    if len(odd):
        gap = x[odd] - near[odd]
        worst = np.abs(gap).argmax(axis=1)
        rows = np.arange(len(odd))
        near[odd, worst] += np.where(gap[rows, worst] < 0, -1.0, 1.0)
    return near


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """The nearest lattice point of each row of eight."""
    whole, half = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    closer = ((x - whole) ** 2).sum(axis=1) <= ((x - half) ** 2).sum(axis=1)
    return np.where(closer[:, None], whole, half)


@lru_cache(maxsize=8)
def _projections(dim: int) -> np.ndarray:
    return np.random.default_rng([SEED, dim]).standard_normal((TABLES, BLOCKS, dim, 8)) * SCALE


def _hashed(points: np.ndarray) -> np.ndarray:
    """One 64-bit hash of each row of doubled lattice coordinates."""
    key = np.zeros(len(points), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(points.shape[1]):
            key = mix(key + (2 * points[:, k]).astype(np.int64).view(np.uint64))
    return key


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Rows times powers of two, exactly, so that their squares neither overflow nor vanish."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1, keepdims=True))[1])


def cells(vectors: np.ndarray) -> np.ndarray:
    """rows x TABLES x (1 + BLOCKS * PROBES) cell hashes, the own cell first."""
    vectors = scaled(vectors)
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    planes = _projections(vectors.shape[1])
    steps = minimal_vectors()
    out = np.zeros((len(unit), TABLES, 1 + BLOCKS * PROBES), np.uint64)
    for t in range(TABLES):
        own, others = [], []
        for b in range(BLOCKS):
            x = unit @ planes[t, b]
            point = nearest_e8(x)
            own.append(_hashed(point))
            # |x - p - v|^2 = |x - p|^2 - 2 (x - p).v + 2: the nearest neighbours maximise the product
            best = np.argpartition(-((x - point) @ steps.T), PROBES, axis=1)[:, :PROBES]
            others.append([_hashed(point + steps[best[:, k]]) for k in range(PROBES)])

        def joined(parts: list[np.ndarray], t: int = t) -> np.ndarray:
            key = np.full(len(unit), np.uint64(t + 1))
            with np.errstate(over="ignore"):
                for p in parts:
                    key = mix(key + p)
            return key

        out[:, t, 0] = joined(own)
        at = 1
        for b in range(BLOCKS):
            for k in range(PROBES):
                out[:, t, at] = joined([others[b][k] if c == b else own[c] for c in range(BLOCKS)])
                at += 1
    return out.view(np.int64)


def _cell_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, lists = batch.column(0).to_numpy(), batch.column(1)
        dims = lists.value_lengths().to_numpy()
        for dim in np.unique(dims):
            rows = np.flatnonzero(dims == dim)
            data = lists.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), dim)
            keys = cells(data)
            n, per = len(rows), keys.shape[1] * keys.shape[2]
            own = np.zeros(keys.shape, bool)
            own[:, :, 0] = True
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[rows], per)), pa.array(keys.reshape(n * per)), pa.array(own.reshape(n * per))], names=["c", "cell", "own"])


def _cosine_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x, y = batch.column(2), batch.column(3)
        same = x.value_lengths().to_numpy() == y.value_lengths().to_numpy()
        good = np.zeros(len(same), bool)
        dims = x.value_lengths().to_numpy()
        for dim in np.unique(dims[same]):
            rows = np.flatnonzero(same & (dims == dim))
            p, q = (scaled(v.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), dim)) for v in (x, y))
            dot = (p * q).sum(axis=1)
            good[rows] = dot / (np.sqrt((p * p).sum(axis=1)) * np.sqrt((q * q).sum(axis=1))) >= COSINE
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(good))


def links(classes: DataFrame) -> DataFrame:
    """Distinct pairs (a, b), a < b, of classes (c, label, embedding) that link."""
    small_batches(classes.sparkSession)
    spread = classes.select("c", "embedding").mapInArrow(_cell_batches, "c long, cell long, own boolean")
    spread = spread.join(classes.select("c", "label"), "c")
    own = saved(spread.filter("own").select(F.col("c").alias("x"), "label", "cell"), "e8-own")
    n = F.count("*")
    dense = own.groupBy("label", "cell").agg(n.alias("n")).filter(F.col("n") > BLOCK_CLASSES)
    dense = saved(dense.withColumn("blocks", F.ceil(F.col("n") / BLOCK_CLASSES)), "e8-dense")
    blocks = F.coalesce("blocks", F.lit(1).cast("long"))
    own = with_facts(own, dense, ["label", "cell"], "n").withColumn("block", F.pmod(F.xxhash64("x"), blocks)).select("x", "label", "cell", "block")
    near = with_facts(spread.select(F.col("c").alias("y"), "label", "cell"), dense, ["label", "cell"], "n")
    near = near.select("y", "label", "cell", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("block"))
    pairs = own.join(near, ["label", "cell", "block"]).filter("x <> y")
    pairs = pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    left = classes.select(F.col("c").alias("a"), F.col("embedding").alias("e_a"))
    right = classes.select(F.col("c").alias("b"), F.col("embedding").alias("e_b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "e_a", "e_b").mapInArrow(_cosine_batches, "a long, b long")


def near_embeddings(vectors: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id and kept, one row per vector."""
    e = F.col("embedding").cast("array<double>")
    usable = F.col("label").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    rows = vectors.select("vec_id", "label", e.alias("embedding")).withColumn("usable", F.coalesce(usable, F.lit(False)))
    rows = rows.withColumn("k1", F.when(F.col("usable"), F.xxhash64("label", "embedding"))).withColumn("k2", F.when(F.col("usable"), F.xxhash64(F.lit("2"), "label", "embedding")))
    rows = saved(rows.withColumn("row", F.monotonically_increasing_id()), "e8-rows")
    order = F.struct(F.col("vec_id").isNull().alias("last"), F.col("vec_id").alias("id"))
    groups = rows.filter("usable").groupBy("k1", "k2").agg(F.min("row").alias("c"), F.min(order).alias("head"), F.count("*").alias("copies"))
    groups = saved(groups, "e8-groups")
    heads = rows.join(groups.select(F.col("c").alias("row")), "row").select(F.col("row").alias("c"), "label", "embedding")
    found = saved(links(saved(heads, "e8-classes")), "e8-links")
    copies = groups.select("c", "copies")
    both = found.unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b")))
    counts = both.join(copies.withColumnRenamed("c", "b"), "b").groupBy("a").agg(F.sum("copies").alias("others"))
    labels = saved(components(found), "e8-labels").select(F.col("node").alias("c"), "component")
    groups = groups.join(labels, "c", "left").withColumn("component", F.coalesce("component", "c"))
    tops = saved(groups.groupBy("component").agg(F.min("head").alias("top"), F.count("*").alias("members")), "e8-tops")
    groups = with_facts(groups, tops, "component", "members").join(counts.withColumnRenamed("a", "c"), "c", "left")
    groups = groups.select("k1", "k2", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n"), F.col("top.id").alias("top_id"), F.lit(True).alias("placed"), "copies")
    out = with_facts(rows.select("vec_id", "k1", "k2"), saved(groups, "e8-facts"), ["k1", "k2"], "copies")
    out = out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("placed"), F.col("top_id")).otherwise(F.col("vec_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("component_id").isNull()))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: links and components of the whole embeddings table."""
    return near_embeddings(table(spark, sf_dir, "embeddings"))
