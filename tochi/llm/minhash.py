"""Near-duplicate documents by DartMinHash signatures.

Christiani, "DartMinHash: Fast Sketching for Weighted Sets", 2020. Every element
(a hashed five-word shingle) owns dyadic regions of weight x rank; a hash of
element and region throws a Poisson number of darts into each. A document keeps
the darts under its elements' weights and, at each of K coordinates, the dart of
least rank. Only the low ranks that a document of its total weight needs are
looked at, so a signature costs about K ln K darts however long the text is.
The similarity is that of shingle sets, so each shingle has the weight 1 here: with
counts as weights, texts that repeat a passage would lose links.

Documents with one and the same shingle set are one class from the start. Bands of
signatures bring classes together, a few bands at first and then ever more. In each
of these rounds a bucket of more than one component compares each member with one
pivot (a star, never all pairs), and what is linked is merged before more bands are
looked at; so a large group is one component early on. At the end the buckets that
still hold several components compare members of different components in blocks,
each pair once, in its first common band. An odd sketch (Mitzenmacher, Pagh and Pham,
"Efficient Estimation for High Similarities Using Odd Sketches", 2014) holds a parity
of the shingles at each of its bits; two sets differ in at least as many shingles as
their sketches in bits, so what it sets aside cannot be similar and no link is lost.
Every link is verified by the Jaccard similarity of the whole texts' shingles as
64-bit hashes.

Definitions for odd input: words are runs of anything but the six ASCII spaces; a
text of one to four words has itself as its only shingle; a null text or one
without a word is like no other; rows that repeat are members of one class; the
first of a class is its least doc_id, nulls last, and one of equal rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tochi.llm.common import BROADCAST_FACTS, discard, grouped, mix, saved, small_batches, spare_name, table, texts_of, with_columns, with_facts
from tochi.llm.graph import components

WORDS = 5
SIMILARITY = 0.8
#: At similarity 0.8 a pair shares none of 32 bands of 6 with probability 6e-5.
BANDS, ROWS = 32, 6
K = BANDS * ROWS
#: Bands that are looked at together, one round after the other.
ROUNDS = (2, 6, 24)
#: Bits of an odd sketch.
ODD_BITS = 2048
#: Members of a block of a bucket; blocks meet pair by pair, each in its own task.
BLOCK = 256
#: Pairs of one text that meet in one task; a text of more pairs is dealt over several.
PAIRS_PER_TEXT = 500
#: Keys of buckets or texts that are broadcast up to this many.
BROADCAST_KEYS = 2_000_000
#: Expected darts of a document: K coordinates stay empty in about 1 of 100.
DARTS = K * (np.log(K) + 4)

_BASE = np.uint64(0x100000001B3)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _BASE), np.full(n, np.uint64(pow(int(_BASE), -1, 1 << 64)))
    up[0] = down[0] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


_UP, _DOWN = _powers(1 << 21)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text index, 64-bit hash) of each word, by prefix sums over the bytes."""
    joined = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    up, down = (_UP, _DOWN) if len(joined) <= len(_UP) else _powers(len(joined))
    space = (joined == 32) | ((joined >= 9) & (joined <= 13))
    inside = np.append(False, ~space).astype(np.int8)
    edge = np.diff(inside)
    first = np.flatnonzero(edge == 1)
    last = np.flatnonzero(np.append(edge[1:], np.int8(0)) == -1) + 1
    ends = np.cumsum([len(t) + 1 for t in texts])
    with np.errstate(over="ignore"):
        sums = np.append(np.uint64(0), np.cumsum((joined.astype(np.uint64) + np.uint64(1)) * up[: len(joined)], dtype=np.uint64))
        own = (sums[last] - sums[first]) * down[first]
    return np.searchsorted(ends, first, side="right"), mix(own ^ (last - first).astype(np.uint64))


_space = re.compile(rb"[ \t-\r]")


def _parts(text: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """A long text in parts of about ``size`` bytes, cut at spaces only, however long a word is."""
    while len(text) > size:
        cut = max(text.rfind(c, 0, size) for c in (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r"))
        if cut < 0:
            found = _space.search(text, size)
            cut = found.start() if found else len(text)
        yield text[:cut]
        text = text[cut + 1 :]
    yield text


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes (uint64) of each text."""
    raw = [(i, p) for i, t in enumerate(texts) for p in _parts(t.encode("utf-8", "surrogatepass"))]
    owners, hashes = [], []
    for group in grouped([p for _, p in raw], 1 << 20):
        own, found = word_hashes([raw[g][1] for g in group])
        owners.append(np.array([raw[g][0] for g in group], np.int64)[own])
        hashes.append(found)
    owner = np.concatenate(owners) if owners else np.zeros(0, np.int64)
    word = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
    out = []
    rolled = np.zeros(max(len(word) - WORDS + 1, 0), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(WORDS):
            rolled = mix(rolled + word[k : k + len(rolled)])
        for a, b in zip(bounds[:-1], bounds[1:]):
            if b - a >= WORDS:
                out.append(np.unique(rolled[a : b - WORDS + 1]))
            elif b > a:
                one = np.uint64(b - a)
                for x in word[a:b]:
                    one = mix(np.array([one + x]))[0]
                out.append(np.array([one]))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def _poisson(area: float) -> np.ndarray:
    """Distribution function of the number of darts in a region of that area."""
    n = np.arange(int(area + 12 * np.sqrt(area) + 12))
    log_p = -area + n * np.log(area) - np.append(0.0, np.cumsum(np.log(np.maximum(n[1:], 1))))
    return np.minimum(np.cumsum(np.exp(log_p)), 1.0)


def _unit(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)).astype(np.float64) / (1 << 53)


def signatures(elements: list[np.ndarray], weights: list[np.ndarray] | None = None) -> np.ndarray:
    """len(elements) x K signatures of weighted sets (weight 1 where none is given).

    An empty set has the signature of all ones.
    """
    sizes = np.array([len(e) for e in elements])
    total = np.array([w.sum() for w in weights]) if weights else sizes.astype(np.float64)
    out = np.full((len(elements), K), np.uint64(2**64 - 1))
    todo = np.flatnonzero(sizes > 0)
    reach = DARTS
    while len(todo):
        h = np.concatenate([elements[i] for i in todo])
        w = np.concatenate([weights[i] for i in todo]).astype(np.float64) if weights else np.ones(len(h))
        doc = np.repeat(np.arange(len(todo)), sizes[todo])
        most = reach / total[todo]
        flat = np.full(len(todo) * K, np.uint64(2**64 - 1))
        nu = 0
        while True:  # weight regions (0, 1], (1, 2], (2, 4], ...
            floor, width = (0.0, 1.0) if nu == 0 else (2.0 ** (nu - 1), 2.0 ** (nu - 1))
            heavy = np.flatnonzero(w > floor)
            if not len(heavy):
                break
            rho = 0
            while True:  # rank regions [0, 1/8), [1/8, 1/4), [1/4, 1/2), ...
                low, span = (0.0, 0.125) if rho == 0 else (2.0 ** (rho - 4), 2.0 ** (rho - 4))
                own = heavy[most[doc[heavy]] > low]
                if not len(own):
                    break
                seed = mix(h[own] ^ mix(np.array([nu * 64 + rho + 1], np.uint64))[0])
                count = np.searchsorted(_poisson(width * span), _unit(seed), side="right")
                which = np.repeat(np.arange(len(own)), count)
                if len(which):
                    nth = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
                    dart = mix(seed[which] + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                    under = floor + width * _unit(mix(dart + np.uint64(1))) <= w[own[which]]
                    rank = low + span * _unit(mix(dart + np.uint64(2)))
                    keep = np.flatnonzero(under)
                    cell = doc[own[which[keep]]] * K + (mix(dart[keep] + np.uint64(3)) % np.uint64(K)).astype(np.int64)
                    value = ((rank[keep] * (1 << 24)).astype(np.uint64) << np.uint64(24)) | (dart[keep] >> np.uint64(40))
                    np.minimum.at(flat, cell, value)
                rho += 1
            nu += 1
        grid = flat.reshape(-1, K)
        # a least rank above what was looked at could still be beaten: look further
        rank = (grid >> np.uint64(24)).astype(np.float64) / (1 << 24)
        sure = (rank.max(axis=1) <= most) & (grid.max(axis=1) < np.uint64(2**64 - 1))
        out[todo[sure]] = grid[sure]
        todo = todo[~sure]
        reach *= 2
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """rows x BANDS hashes of the bands."""
    parts = signature.reshape(len(signature), BANDS, ROWS)
    key = np.zeros(parts.shape[:2], np.uint64) + np.arange(BANDS, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(ROWS):
            key = mix(key + parts[:, :, k])
    return key.view(np.int64)


def odd_sketches(sets: list[np.ndarray]) -> np.ndarray:
    """len(sets) x ODD_BITS / 64 words: at each bit the parity of the elements that fall there."""
    own = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    place = (np.concatenate(sets) >> np.uint64(16)) % np.uint64(ODD_BITS) if sets else np.zeros(0, np.uint64)
    odd = np.bincount(own * ODD_BITS + place.astype(np.int64), minlength=len(sets) * ODD_BITS) & 1
    return np.packbits(odd.astype(np.uint8).reshape(len(sets), ODD_BITS), axis=1).view(np.int64)


def sketched(docs: DataFrame, names: dict[str, str], blank: int | None = None) -> DataFrame:
    """``docs`` with set_hash (``blank`` without words), n_shingles, bands and odd.

    names: what these columns are to be called.
    """
    small_batches(docs.sparkSession)
    at = docs.columns.index("text")
    fields = [T.StructField(names["set_hash"], T.LongType()), T.StructField(names["n_shingles"], T.IntegerType()), T.StructField(names["bands"], T.ArrayType(T.LongType())), T.StructField(names["odd"], T.ArrayType(T.LongType()))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            texts_all = texts_of(whole.column(at))
            for group in grouped(texts_all, 1 << 19):
                batch = whole.slice(group[0], len(group))
                sets = shingle_sets([texts_all[g] for g in group])
                marks = signatures(sets)
                hashes, bands, odd = [], [], []
                for s, key, bit in zip(sets, band_keys(marks), odd_sketches(sets)):
                    if not len(s):
                        hashes.append(blank)
                        bands.append(None)
                        odd.append(None)
                        continue
                    with np.errstate(over="ignore"):
                        one = mix(np.array([mix(s).sum(dtype=np.uint64) + np.uint64(len(s))], np.uint64))
                    hashes.append(int(one.view(np.int64)[0]))
                    bands.append(key)
                    odd.append(bit)
                yield with_columns(batch, [(names["set_hash"], pa.array(hashes, pa.int64())), (names["n_shingles"], pa.array([len(s) for s in sets], pa.int32())), (names["bands"], pa.array(bands, pa.list_(pa.int64()))), (names["odd"], pa.array(odd, pa.list_(pa.int64())))])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *fields]))


def similar(p: np.ndarray, q: np.ndarray) -> bool:
    """Whether two sorted sets of shingles have a Jaccard similarity of SIMILARITY or more."""
    if min(len(p), len(q)) < SIMILARITY * max(len(p), len(q)) - 1e-9:
        return False
    both = np.sort(np.concatenate([p, q]), kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return common >= SIMILARITY * (len(p) + len(q) - common) - 1e-9


def _jaccard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last: dict[int, np.ndarray] = {}
    for batch in batches:
        a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        new = {c: t for c, t in zip(a + b, texts_of(batch.column(2)) + texts_of(batch.column(3))) if c not in last}
        last.update(zip(new, shingle_sets(list(new.values()))))
        keep = pa.array([similar(last[x], last[y]) for x, y in zip(a, b)], pa.bool_())
        last = {b[-1]: last[b[-1]]} if b else last  # rows come sorted by b
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(keep)


def few(keys: DataFrame) -> DataFrame:
    """Saved ``keys`` for a join: broadcast if counted and few, else shuffled."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys


def verified(pairs: DataFrame, classes: DataFrame, texts: DataFrame) -> DataFrame:
    """The saved pairs (a, b) of classes (c, mark) whose texts (mark, text) are similar enough, saved."""
    ends = saved(pairs.select(F.explode(F.array("a", "b")).alias("c")).groupBy("c").agg(F.ceil(F.count("*") / PAIRS_PER_TEXT).alias("copies")), "mh-ends")
    wanted = saved(classes.select("c", "mark").join(few(ends), "c"), "mh-wanted")
    hot = few(ends.filter("copies > 1"))
    own = texts.join(few(wanted), "mark").groupBy("c").agg(F.any_value("text").alias("t"), F.any_value("copies").alias("copies"))
    own = own.select("c", "t", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"))
    dealt = pairs
    for x, y in (("a", "b"), ("b", "a")):
        dealt = dealt.join(hot.select(F.col("c").alias(x), F.col("copies").alias("k_" + x)), x, "left")
        dealt = dealt.withColumn("k_" + x, F.coalesce(F.pmod(F.xxhash64(y), F.col("k_" + x)) + 1, F.lit(1).cast("long")))
    for x in ("a", "b"):
        dealt = dealt.join(own.select(F.col("c").alias(x), F.col("copy").alias("k_" + x), F.col("t").alias("t_" + x)), [x, "k_" + x])
    out = saved(dealt.select("a", "b", "t_a", "t_b").mapInArrow(_jaccard, "a long, b long"), "mh-links")
    discard(ends, wanted)
    return out


def _component(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    """``members`` with the component of c, itself where it is not linked yet."""
    if labels is None:
        return members.withColumn("component", F.col("c"))
    return with_facts(members, labels, "c", "one").drop("one").withColumn("component", F.coalesce("component", "c"))


def _apart() -> Column:
    """Bits in which the odd sketches of a pair differ, at most the shingles that one has and the other not."""
    return sum((F.bit_count(F.get("odd", k).bitwiseXOR(F.get("p_odd", k))) for k in range(ODD_BITS // 64)), F.lit(0))


def _may_link() -> Column:
    """No pair of sets that are similar enough fails this."""
    sizes = F.least("n", "p_n") >= SIMILARITY * F.greatest("n", "p_n") - 1e-9
    return sizes & (_apart() <= (1 - SIMILARITY) / (1 + SIMILARITY) * (F.col("n") + F.col("p_n")) + 1e-6)


def _pair() -> list[Column]:
    return [F.least("c", "p_c").alias("a"), F.greatest("c", "p_c").alias("b")]


def with_pivots(opened: DataFrame) -> DataFrame:
    """Pairs (a, b): each member of an open bucket and the likeliest of the pivots that it meets.

    A text in the middle of a group shares most buckets: the best pivot.
    """
    degrees = opened.groupBy("c").agg(F.sum("size").alias("degree"))
    best = opened.join(degrees, "c").groupBy("band", "key").agg(F.max_by(F.struct("c", "n", "odd", "component"), F.struct("degree", "c")).alias("p"))
    pivots = saved(best.select("band", "key", F.col("p.c").alias("p_c"), F.col("p.n").alias("p_n"), F.col("p.odd").alias("p_odd"), F.col("p.component").alias("p_component")), "mh-pivots")
    right = F.broadcast(pivots) if pivots.count() <= BROADCAST_FACTS // 4 else pivots
    met = opened.join(right, ["band", "key"]).filter((F.col("component") != F.col("p_component")) & _may_link())
    met = met.select("c", "p_c", (_apart() / (F.col("n") + F.col("p_n"))).alias("apart"))
    out = saved(met.groupBy("c").agg(F.min_by("p_c", F.struct("apart", "p_c")).alias("p_c")).select(*_pair()).distinct(), "mh-pairs")
    discard(pivots)
    return out


def across_components(members: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b) of members of one bucket and different components that may be similar.

    Members are (band, key, c, n, odd, component). Blocks of about BLOCK members meet
    pair by pair; those of a bucket's largest component never meet each other.
    """
    parts = members.groupBy("band", "key", "component").agg(F.count("*").alias("k"))
    tops = parts.groupBy("band", "key").agg(F.sum("k").alias("size"), F.count("*").alias("parts"), F.max_by("component", F.struct("k", "component")).alias("head"), F.max("k").alias("most"))
    tops = saved(tops.filter("parts > 1").select("band", "key", "head", F.ceil((F.col("size") - F.col("most")) / BLOCK).alias("rest"), F.ceil(F.col("most") / BLOCK).alias("heads")), "mh-tops")
    still = saved(members.join(few(tops), ["band", "key"]), "mh-still")
    own = saved(classes.select("c", "bands").join(few(saved(still.select("c").distinct(), "mh-still")), "c", "left_semi"), "mh-still")
    of = F.pmod(F.xxhash64("c"), F.when(F.col("component") == F.col("head"), F.col("heads")).otherwise(F.col("rest")))
    still = still.join(own, "c").withColumn("block", of + F.when(F.col("component") == F.col("head"), F.col("rest")).otherwise(F.lit(0)))
    x = still.filter("block < rest").withColumn("v", F.explode(F.sequence("block", F.col("rest") + F.col("heads") - 1)))
    x = x.select("band", "key", F.col("block").alias("u"), "v", "c", "n", "odd", "bands", "component")
    y = still.withColumn("u", F.explode(F.sequence(F.lit(0).cast("long"), F.least("block", F.col("rest") - 1))))
    y = y.select("band", "key", "u", F.col("block").alias("v"), *(F.col(k).alias("p_" + k) for k in ("c", "n", "odd", "bands", "component")))
    once = ((F.col("u") != F.col("v")) | (F.col("c") < F.col("p_c"))) & (F.col("component") != F.col("p_component"))
    first = F.array_position(F.zip_with("bands", "p_bands", lambda s, t: s == t), F.lit(True)) == F.col("band") + 1
    return saved(x.join(y, ["band", "key", "u", "v"]).filter(once & _may_link() & first).select(*_pair()), "mh-pairs")


def near_classes(classes: DataFrame, texts: DataFrame) -> DataFrame | None:
    """(c, component, one) of the saved classes (c, n, bands, odd, mark) that have links, saved."""
    labels: DataFrame | None = None
    opened: list[DataFrame] = []
    tested: list[DataFrame] = []

    def merge(pairs: DataFrame) -> None:
        nonlocal labels
        if pairs.isEmpty():
            return
        found = verified(pairs, classes, texts)
        known = found if labels is None else found.unionByName(labels.select(F.col("c").alias("a"), F.col("component").alias("b")))
        new = saved(components(known).select(F.col("node").alias("c"), "component", F.lit(1).alias("one")), "mh-labels")
        discard(found, *([labels] if labels is not None else []))
        labels = new

    at = 0
    for count in ROUNDS:
        spread = classes.select("c", "n", "odd", F.posexplode(F.slice("bands", at + 1, count)).alias("band", "key")).withColumn("band", F.col("band") + at)
        spread = _component(spread, labels)
        keys = spread.groupBy("band", "key").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("size")).filter("x <> y").select("band", "key", "size")
        keys = saved(keys, "mh-keys")
        opened.append(saved(spread.join(few(keys), ["band", "key"]), "mh-open"))
        discard(keys)
        tested.append(with_pivots(opened[-1]))
        merge(tested[-1])
        at += count
    members = opened[0]
    for more in opened[1:]:
        members = members.unionByName(more)
    members = _component(members.select("band", "key", "c", "n", "odd"), labels)
    pairs = across_components(members, classes)
    done = tested[0]
    for more in tested[1:]:
        done = done.unionByName(more)
    merge(saved(pairs.join(done, ["a", "b"], "left_anti"), "mh-pairs"))
    discard(*opened, *tested)
    return labels


def classify(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """class_id and kept of saved rows (row, doc_id, set_hash, n_shingles, bands, odd, mark)."""
    order = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("id"), F.col("row").alias("row"))
    worded = rows.filter(F.col("set_hash").isNotNull())
    firsts = saved(worded.groupBy("set_hash").agg(F.min(order).alias("head"), F.count("*").alias("copies")), "mh-classes")
    heads = firsts.select(F.col("head.row").alias("row"))
    classes = saved(worded.join(heads, "row").select(F.col("set_hash").alias("c"), F.col("n_shingles").alias("n"), "bands", "odd", "mark"), "mh-heads")
    near = near_classes(classes, texts)
    facts = firsts.filter("copies > 1").select("set_hash", "head", F.col("copies").alias("class_size"), "copies")
    if near is not None:
        linked = saved(near.select(F.col("c").alias("set_hash"), "component").join(firsts, "set_hash"), "mh-linked")
        groups = saved(linked.groupBy("component").agg(F.min("head").alias("top"), F.sum("copies").alias("class_size"), F.count("*").alias("n")), "mh-groups")
        named = with_facts(linked, groups, "component", "n").select("set_hash", F.col("top").alias("head"), "class_size", "copies")
        facts = facts.join(few(saved(linked.select("set_hash"), "mh-linked")), "set_hash", "left_anti").unionByName(named)
    facts = saved(facts, "mh-facts")
    discard(firsts, classes)
    out = with_facts(rows.select("row", "doc_id", "set_hash", "n_shingles"), facts, "set_hash", "copies")
    alone = F.col("head").isNull()
    return out.select("row", "doc_id", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("head.id")).alias("class_id"), F.coalesce("class_size", F.lit(1)).alias("class_size"), (alone | (F.col("head.row") == F.col("row"))).alias("kept"))


_NAMES = {x: x for x in ("set_hash", "n_shingles", "bands", "odd")}


def _texts(docs: DataFrame) -> DataFrame:
    """(mark, text): a text and its hash, by which the texts of classes are found again."""
    text = F.col("text").cast("string")
    return docs.select(F.xxhash64(text).alias("mark"), text.alias("text"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, class_id, class_size and kept, one row per document."""
    plain = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    rows = sketched(plain.withColumn("mark", F.xxhash64("text")), _NAMES).drop("text")
    rows = saved(rows.withColumn("row", F.monotonically_increasing_id()), "mh-rows")
    return classify(rows, _texts(docs)).drop("row")


def keep_first(docs: DataFrame, blank_alone: bool = True) -> DataFrame:
    """``docs`` with one document, the first, of each near-duplicate class.

    Texts without a word are like no other, or with ``blank_alone`` false copies of one
    another, as where a stage before has emptied texts that repeat.
    """
    names = docs.columns
    prefix = spare_name([c[:3] for c in names], "mh_")
    own = {x: prefix + x for x in _NAMES}
    row = prefix + "row"
    rows = saved(sketched(docs, own, None if blank_alone else 0).withColumn(row, F.monotonically_increasing_id()), "mh-rows")
    plain = rows.select(F.col(row).alias("row"), "doc_id", F.xxhash64(F.col("text").cast("string")).alias("mark"), *(F.col(v).alias(k) for k, v in own.items()))
    dropped = saved(classify(plain, _texts(rows)).filter(~F.col("kept")).select(F.col("row").alias(row)), "mh-dropped")
    return rows.join(few(dropped), row, "left_anti").select(*names)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: near-duplicate classes of the whole documents table."""
    return near_duplicates(table(spark, sf_dir, "documents"))
