"""Quality rules: base counts and a modified Kneser-Ney perplexity band.

The language model is over characters. Its highest order counts every n-gram of
every text in Spark; lower orders use continuation counts. Words of the corpora
this runs on are open-ended, so word n-grams would move more bytes than the texts
themselves, while character n-grams saturate and combine before the shuffle. The
model is one sorted array of 64-bit hashes of all grams, found by bisection, beside
their values; it grows with the corpus. Up to SHARD_GRAMS it is broadcast. Beyond, it is
cut by the hashes into files of that size in the shared folder, however the grams are
dealt over characters: a task gathers the grams of some texts, reads the files one after
another, keeps what it asked for, and scores. Texts are read once and never rewritten.

The band judges a text by a model that has not counted it: the texts are dealt into
two halves by a hash of the text, so exact copies share one, and each is scored by
the model of the other half. The reported perplexity is that of the model of all texts.

Definitions for odd input: a null text counts as empty; a null language is the
language ``und``; an empty table gives no rows; texts of any length are worked on
in windows; repeated rows are scored alike; further columns pass through.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tochi.llm.common import grouped, mix, saved, shared_dir, small_batches, spare_name, table, texts_of, with_columns

ORDER = 5
#: Bits of one character; an n-gram is two longs, its last three characters and those before.
SYMBOL_BITS = 21
SYMBOL_MASK = (1 << SYMBOL_BITS) - 1
#: The mass of characters that no text has is dealt over this many.
VOCABULARY = 4096
#: Grams of one shard of a model, 12 bytes each; a task holds one at a time.
SHARD_GRAMS = 8_000_000
#: Characters whose grams a task gathers before it reads the shards once.
HELD_CHARS = 16 << 20
#: Languages whose discounts are broadcast.
BROADCAST_LANGUAGES = 100_000
#: Distinct n-grams a counting task holds before it emits what it has.
HELD_GRAMS = 2_000_000
#: Half-width of a language's band in interquartile ranges of log perplexity, for
#: long texts; a text of n characters has a band sqrt(1 + BAND_CHARS / n) as wide,
#: since the mean of few characters spreads more. Set on the labels of sf0.1: of the
#: documents that pass the base rules it rejects 128 of 301 of quality 0 and 64 of
#: 3,302 of quality 1 (with an earlier model a width of 1.5: 190 and 129; 2: 144 and
#: 60; 2.5: 92 and 42; 6: none and 5).
BAND_WIDTH = 2.0
BAND_CHARS = 1000
#: Log perplexities are quantised to this many steps per unit for the quartiles.
STEPS = 1000

_SPACES = " \t\n\x0b\x0c\r"
_SYMBOLS = "[#*$%&|<>]"
_symbol = re.compile("[" + re.escape(_SYMBOLS[1:-1]) + "]")


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a text."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes.split() splits at exactly the six ASCII spaces
    word_chars = len(text) - sum(text.count(c) for c in _SPACES)
    seen: set[bytes] = set()
    dup_lines = 0
    for line in raw.split(b"\n"):
        if line and not line.isspace():
            if line in seen:
                dup_lines += 1
            seen.add(line)
    return len(words), word_chars, len(_symbol.findall(text)), dup_lines, repeated_words(words)


def repeated_words(words: list[bytes], width: int = 8) -> int:
    """Words inside windows of ``width`` words that occur twice or more."""
    n = len(words)
    if n <= width:
        return 0
    ids: dict[bytes, int] = {}
    rank = np.array([ids.setdefault(w, len(ids)) for w in words], dtype=np.int64)
    if len(ids) > n - width:  # no word repeats often enough for two windows
        return 0
    step = 1
    while step < width:  # rank of a window from the ranks of its two halves: exact
        pair = rank[:-step] * np.int64(n + 1) + rank[step:]
        values, rank, counts = np.unique(pair, return_inverse=True, return_counts=True)
        if len(values) == len(pair):
            return 0
        step *= 2
    hit = np.flatnonzero(counts[rank] > 1)
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + width, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


# ---------------------------------------------------------------- n-grams


@dataclass
class Grams:
    """The distinct n-grams of some texts: characters (rows x ORDER), and where they are.

    ``where`` numbers the gram and ``owner`` the text of each character of the texts;
    of grams that were only counted, ``where`` is how often each occurs.
    """

    symbols: np.ndarray
    where: np.ndarray
    owner: np.ndarray

    def packed(self, n: int = ORDER, context: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(high, low) longs of the last ``n`` characters, or of the ``n`` before the last."""
        end = ORDER - 1 if context else ORDER
        words = []
        for k in (range(max(end - n, 0), max(end - 3, 0)), range(max(end - min(n, 3), 0), end)):
            word = np.zeros(len(self.symbols), np.int64)
            for j in k:
                word = (word << np.int64(SYMBOL_BITS)) | self.symbols[:, j]
            words.append(word)
        return words[0], words[1]


def _windows(texts: list[str], counted: bool = False) -> Iterator[Grams]:
    """The grams of passes over the texts, every character predicted exactly once.

    A text is preceded by ORDER - 1 begin symbols, a further window of a long text by
    the symbols before it.
    """
    pad = ORDER - 1
    pieces: list[tuple[int, str]] = []
    for i, text in enumerate(texts):
        low = text.lower()
        for at in range(0, len(low), 1 << 20):
            before = low[at - pad : at] if at else "\x01" * pad
            pieces.append((i, before + low[at : at + (1 << 20)]))
    for group in grouped([p for _, p in pieces]):
        yield from _grams([pieces[g] for g in group], counted)


def _grams(pieces: list[tuple[int, str]], counted: bool) -> Iterator[Grams]:
    pad = ORDER - 1
    points = np.frombuffer("".join(p for _, p in pieces).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    rank = np.zeros(0x110000, np.int32)
    rank[points] = 1
    alphabet = np.flatnonzero(rank)
    base = len(alphabet)
    if base > 6000:  # base ** ORDER has to fit into 63 bits: fewer characters at once
        for i, piece in pieces:
            for at in range(pad, len(piece), 2048):
                yield from _grams([(i, piece[at - pad : at + 2048])], counted)
        return
    rank[alphabet] = np.arange(base)
    local = rank[points].astype(np.int64)
    sizes = np.array([len(p) for _, p in pieces])
    starts = np.cumsum(sizes) - sizes
    key = np.zeros(max(len(local) - pad, 0), np.int64)
    for k in range(ORDER):
        key = key * base + local[k : k + len(key)]
    inside = np.ones(len(local), dtype=bool)
    for k in range(pad):
        inside[starts + k] = False
    if counted:
        distinct, where = np.unique(key[inside[pad:]], return_counts=True)
    else:
        where, distinct = pd.factorize(key[inside[pad:]])  # by a hash table: no sort
    symbols = np.zeros((len(distinct), ORDER), np.int64)
    for k in range(ORDER - 1, -1, -1):
        symbols[:, k] = alphabet[distinct % base]
        distinct = distinct // base
    yield Grams(symbols, where, np.repeat(np.array([i for i, _ in pieces]), sizes)[inside])


def half_of(text: Column) -> Column:
    """The half of the corpus that a text belongs to, 0 or 1; copies share it."""
    return F.pmod(F.xxhash64(F.coalesce(text.cast("string"), F.lit(""))), F.lit(2)).cast("int")


def _by_language(langs: list[str | None], halves: list[int]) -> dict[tuple[str, int], list[int]]:
    found: dict[tuple[str, int], list[int]] = {}
    for i, (lang, half) in enumerate(zip(langs, halves)):
        found.setdefault((lang or "und", half), []).append(i)
    return found


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple[str, int], list[np.ndarray]] = {}
    fresh = 0

    def emit() -> Iterator[pa.RecordBatch]:
        for (lang, half), parts in held.items():
            rows = _merge(parts)
            for at in range(0, len(rows), 100_000):
                some = rows[at : at + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array([f"{half}{lang}"] * len(some), pa.string()), *(pa.array(some[:, k].copy()) for k in range(3))], names=["lang", "high", "low", "n"])

    for batch in batches:
        texts, langs = texts_of(batch.column(1)), batch.column(0).to_pylist()
        for key, rows in _by_language(langs, batch.column(2).to_pylist()).items():
            parts = held.setdefault(key, [])
            for found in _windows([texts[i] for i in rows], counted=True):
                parts.append(np.column_stack([*found.packed(), found.where]))
                fresh += len(parts[-1])
        if fresh > HELD_GRAMS:
            held = {key: [_merge(parts)] for key, parts in held.items()}
            fresh = 0
            if sum(len(parts[0]) for parts in held.values()) > HELD_GRAMS:
                yield from emit()
                held = {}
    yield from emit()


def _merge(parts: list[np.ndarray]) -> np.ndarray:
    """Rows (high, low, count) with the counts of equal grams added up."""
    rows = np.concatenate(parts) if parts else np.zeros((0, 3), np.int64)
    if len(parts) < 2:
        return rows
    order = np.lexsort((rows[:, 1], rows[:, 0]))
    rows = rows[order]
    first = np.flatnonzero(np.append(True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1)))
    return np.column_stack([rows[first, :2], np.add.reduceat(rows[:, 2], first)])


def count_grams(docs: DataFrame) -> DataFrame:
    """(lang, high, low, n) over every text.

    ``lang`` is the half, one digit, and the language behind it.
    """
    small_batches(docs.sparkSession)
    raw = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), half_of(F.col("text")).alias("half")).mapInArrow(_count_batches, "lang string, high long, low long, n long")
    return raw.groupBy("lang", "high", "low").agg(F.sum("n").alias("n"))


# ---------------------------------------------------------------- the model


def _discount(c: Column) -> Column:
    return F.when(c == 1, F.col("d1")).when(c == 2, F.col("d2")).otherwise(F.col("d3"))


def _discounts(counts: DataFrame) -> DataFrame:
    """Modified Kneser-Ney discounts of each language from counts of counts, written and broadcast if few."""
    n = [F.count_if(F.col("n") == k).cast("double").alias(f"n{k}") for k in (1, 2, 3, 4)]
    y = F.col("n1") / F.nullif(F.col("n1") + 2 * F.col("n2"), F.lit(0.0))

    def d(k: int) -> Column:
        value = k - (k + 1) * y * F.col(f"n{k + 1}") / F.nullif(F.col(f"n{k}"), F.lit(0.0))
        return F.least(F.greatest(F.coalesce(value, F.lit(0.5 * k)), F.lit(0.05 * k)), F.lit(0.95 * k)).alias(f"d{k}")

    out = saved(counts.groupBy("lang").agg(*n).select("lang", d(1), d(2), d(3)), "kn-discounts")
    return F.broadcast(out) if out.count() <= BROADCAST_LANGUAGES else out


def _suffix(n: int) -> list[Column]:
    """high and low of the last n of n + 1 characters."""
    high = F.col("high").bitwiseAND(F.lit(SYMBOL_MASK)) if n == 4 else F.lit(0).cast("long")
    low = F.col("low") if n >= 3 else F.col("low").bitwiseAND(F.lit((1 << (SYMBOL_BITS * n)) - 1))
    return [high, low]


def _context() -> list[Column]:
    """high and low of all characters but the last."""
    carried = F.shiftleft(F.col("high").bitwiseAND(F.lit(SYMBOL_MASK)), 2 * SYMBOL_BITS)
    return [F.shiftright("high", SYMBOL_BITS), carried.bitwiseOR(F.shiftright("low", SYMBOL_BITS))]


def kneser_ney(top: DataFrame) -> DataFrame:
    """(level, lang, high, low, value) of the interpolated model.

    Levels 1..ORDER hold log probabilities of the last symbol, keyed by the whole
    gram; levels -1..-(ORDER - 1) hold log backoff weights of contexts of that
    length. Each order's table is saved, since the next order reads it twice.
    """
    counts = {ORDER: top}
    for n in range(ORDER - 1, 0, -1):
        high, low = _suffix(n)
        counts[n] = counts[n + 1].groupBy("lang", high.alias("high"), low.alias("low")).agg(F.count("*").alias("n"))
        if n > 1:
            counts[n] = saved(counts[n], f"kn-counts{n}")
    out: DataFrame | None = None
    lower: DataFrame | None = None
    for n in range(1, ORDER + 1):
        c_high, c_low = _context()
        rows = counts[n].withColumn("c_high", c_high).withColumn("c_low", c_low).join(_discounts(counts[n]), "lang")
        sums = rows.groupBy("lang", "c_high", "c_low").agg(F.sum("n").alias("total"), F.sum(_discount(F.col("n"))).alias("held"))
        if n == 1:  # one context a language
            sums = F.broadcast(sums)
        rows = rows.join(sums, ["lang", "c_high", "c_low"])
        share = F.greatest(F.col("n") - _discount(F.col("n")), F.lit(0.0)) / F.col("total")
        gamma = F.col("held") / F.col("total")
        if lower is None:
            p = rows.select("lang", "high", "low", (share + gamma / F.lit(float(VOCABULARY))).alias("p"))
        else:
            high, low = _suffix(n - 1)
            rows = rows.withColumn("s_high", high).withColumn("s_low", low)
            lows = lower.select("lang", F.col("high").alias("s_high"), F.col("low").alias("s_low"), F.col("p").alias("p_low"))
            p = rows.join(lows, ["lang", "s_high", "s_low"]).select("lang", "high", "low", (share + gamma * F.col("p_low")).alias("p"))
        lower = saved(p, f"kn-p{n}")
        level = lower.select(F.lit(n).alias("level"), "lang", "high", "low", F.ln("p").alias("value"))
        out = level if out is None else out.unionByName(level)
        weight = F.ln(gamma) if n > 1 else F.ln(gamma / F.lit(float(VOCABULARY)))
        out = out.unionByName(sums.select(F.lit(1 - n).alias("level"), "lang", F.col("c_high").alias("high"), F.col("c_low").alias("low"), weight.alias("value")))
    return out


def _keys(level: int, lang: str, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """64-bit hashes of the grams of a level and language."""
    seed = np.uint64((zlib.crc32(lang.encode()) << 8) + level + 16) ^ (np.uint64(zlib.adler32(lang.encode())) << np.uint64(40))
    return mix(mix(mix(np.array([seed]))[0] ^ high.astype(np.uint64)) ^ low.astype(np.uint64))


def _key_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        level, lang, high, low = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 2, 3, 4))
        key = np.zeros(len(level), np.uint64)
        for lv in np.unique(level):
            for lg in set(lang[level == lv]):
                rows = (level == lv) & (lang == lg)
                key[rows] = _keys(int(lv), lg, high[rows], low[rows])
        yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(key.view(np.int64)), batch.column(5).cast(pa.float32())], names=["part", "key", "value"])


@dataclass
class HashedModel:
    """Sorted 64-bit hashes of grams and contexts, and their log values."""

    keys: np.ndarray
    values: np.ndarray

    def _look_up(self, level: int, lang: str, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Values of grams, NaN where there is none."""
        if not len(self.keys):
            return np.full(len(high), np.nan)
        wanted = _keys(level, lang, high, low)
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.values[at].astype(np.float64), np.nan)

    def log_p(self, lang: str, grams: Grams) -> np.ndarray:
        """log p(last symbol | those before it) of each distinct gram, backing off where unseen."""
        out = self._look_up(ORDER, lang, *grams.packed())
        open_ = np.flatnonzero(np.isnan(out))
        weight = np.zeros(len(open_))
        for n in range(ORDER - 1, -1, -1):
            if not len(open_):
                break
            held = Grams(grams.symbols[open_], grams.where, grams.owner)
            if n:
                gamma = self._look_up(-n, lang, *held.packed(n, context=True))
                weight += np.where(np.isnan(gamma), 0.0, gamma)
                got = self._look_up(n, lang, *held.packed(n))
            else:
                nothing = np.zeros(len(open_), np.int64)
                got = self._look_up(0, lang, nothing, nothing)
                got = np.where(np.isnan(got), -np.log(VOCABULARY), got)
            seen = ~np.isnan(got)
            out[open_[seen]] = weight[seen] + got[seen]
            open_, weight = open_[~seen], weight[~seen]
        return out


#: Name of the model of all texts; those of the halves are named by their digit.
WHOLE = "*"


@dataclass
class Asked:
    """Grams of some texts of one language and half; ``rows`` numbers the texts in their batch."""

    lang: str
    half: int
    rows: np.ndarray
    grams: Grams

    def keys(self) -> np.ndarray:
        """The hashes of all grams and contexts that a model may be asked for."""
        nothing = np.zeros(1, np.int64)
        found = [_keys(0, self.lang, nothing, nothing)]
        for n in range(1, ORDER + 1):
            found.append(np.unique(_keys(n, self.lang, *self.grams.packed(n))))
            if n < ORDER:
                found.append(np.unique(_keys(-n, self.lang, *self.grams.packed(n, context=True))))
        return np.concatenate(found)

    def asks(self, name: str) -> bool:
        """Whether the model of that name scores these texts: all texts', or the other half's."""
        return name in (WHOLE, str(1 - self.half))


class Resident:
    """Models that fit into one broadcast."""

    held_chars = 0

    def __init__(self, spark: SparkSession, models: dict[str, HashedModel]) -> None:
        self.models = spark.sparkContext.broadcast(models)

    def answers(self, asked: list[Asked]) -> dict[str, HashedModel]:
        return self.models.value


@dataclass
class Filed:
    """Models in files by shard; what is asked for is picked out of one shard after another."""

    path: str
    names: tuple[str, ...]
    shards: int
    held_chars: int

    def answers(self, asked: list[Asked]) -> dict[str, HashedModel]:
        """The models cut down to the grams that are asked for."""
        out = {}
        for name in self.names:
            wanted = np.unique(np.concatenate([np.zeros(0, np.uint64), *(a.keys() for a in asked if a.asks(name))]))
            shard, found = wanted.view(np.int64) % np.int64(self.shards), np.zeros(len(wanted), bool)
            values = np.zeros(len(wanted), np.float32)
            for k in np.unique(shard):
                own = np.flatnonzero(shard == k)
                for keys, held in self._parts(name, int(k)):
                    at = np.minimum(np.searchsorted(wanted[own], keys), len(own) - 1)
                    hit = wanted[own[at]] == keys
                    found[own[at[hit]]], values[own[at[hit]]] = True, held[hit]
            out[name] = HashedModel(wanted[found], values[found])
        return out

    def _parts(self, name: str, shard: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Hashes and values of a shard, a row group of its files at a time."""
        from pyarrow import fs, parquet

        store, root = fs.FileSystem.from_uri(self.path)
        folder = f"{root}/model={'all' if name == WHOLE else name}/shard={shard}"
        for info in store.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
            if info.path.endswith(".parquet"):
                with store.open_input_file(info.path) as file:
                    for rows in parquet.ParquetFile(file).iter_batches(1 << 20, columns=["key", "value"]):
                        yield rows.column(0).to_numpy().view(np.uint64), rows.column(1).to_numpy()


class Model:
    """The models of the halves (and of all texts), as one saved table of hashed grams."""

    def __init__(self, rows: DataFrame, names: tuple[str, ...], shards: int, held_chars: int = HELD_CHARS) -> None:
        self.rows, self.names, self.shards, self.held_chars = rows, names, shards, held_chars

    def source(self) -> Resident | Filed:
        """What tasks look grams up in: a broadcast for one shard, files in the shared folder for more."""
        spark = self.rows.sparkSession
        if self.shards == 1:
            models = {}
            for name in self.names:  # one at a time: the driver never holds them as rows together
                got = self.rows.filter(F.col("part") == name).select("key", "value").toArrow()
                key = got.column(0).to_numpy().view(np.uint64)
                order = np.argsort(key)
                models[name] = HashedModel(key[order], got.column(1).to_numpy()[order])
            return Resident(spark, models)
        path = f"{shared_dir(spark)}/kn-shards-{uuid.uuid4().hex}"
        model = F.when(F.col("part") == WHOLE, "all").otherwise(F.col("part"))
        rows = self.rows.select("key", "value", model.alias("model"), F.pmod("key", F.lit(self.shards)).alias("shard"))
        rows.repartition("model", "shard").sortWithinPartitions("model", "shard", "key").write.partitionBy("model", "shard").parquet(path)
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        qualified = where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString()
        return Filed(re.sub("^file:/*", "file:///", qualified), self.names, self.shards, self.held_chars)


def fit(docs: DataFrame, whole: bool = False, shard_grams: int = SHARD_GRAMS) -> Model:
    """Count, smooth and hash the models, one of each half and, with ``whole``, one of all texts."""
    top = saved(count_grams(docs), "kn-counts5")
    if whole:
        both = top.groupBy(F.concat(F.lit(WHOLE), F.substr("lang", F.lit(2))).alias("lang"), "high", "low").agg(F.sum("n").alias("n"))
        top = saved(top.unionByName(both), "kn-counts5-all")
    rows = kneser_ney(top).select("level", F.substring("lang", 1, 1).alias("part"), F.substr("lang", F.lit(2)).alias("lang"), "high", "low", "value")
    rows = saved(rows.mapInArrow(_key_batches, "part string, key long, value float"), "kn-model")
    most = rows.groupBy("part").agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    return Model(rows, ("0", "1", WHOLE) if whole else ("0", "1"), max(1, -(-most // shard_grams)))


# ---------------------------------------------------------------- scoring

_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_LOGS = ("log_perplexity", "unseen_perplexity")


def score(docs: DataFrame, model: Model, prefix: str = "") -> DataFrame:
    """``docs`` with the base counts, base_failed, log_perplexity and unseen_perplexity.

    ``log_perplexity`` (per character) is by the model of all texts, where there is
    one; ``unseen_perplexity`` is its log by the model of the half without the text.
    Both are null for an empty text. New columns are named with
    ``prefix`` where a name would clash with one of ``docs``.
    """
    small_batches(docs.sparkSession)
    half = spare_name(docs.columns, "half")
    docs = docs.withColumn(half, half_of(F.col("text")))
    at = [docs.columns.index(c) for c in ("text", "lang", half)]
    source, whole = model.source(), WHOLE in model.names
    logs = [prefix + c for c in _LOGS]
    fields = [*(T.StructField(prefix + c, T.LongType()) for c in _COUNTS), T.StructField(prefix + "base_failed", T.BooleanType()), *(T.StructField(c, T.DoubleType()) for c in logs)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _gathered(batches, at[0], source.held_chars):
            texts = [t for batch in group for t in texts_of(batch.column(at[0]))]
            langs, halves = ([x for batch in group for x in batch.column(k).to_pylist()] for k in at[1:])
            sums = _log_sums(texts, langs, halves, source)
            begin = 0
            for batch in group:
                rows = slice(begin, begin + batch.num_rows)
                begin = rows.stop
                counts = np.array([base_counts(t) for t in texts[rows]], np.int64).reshape(-1, len(_COUNTS))
                failed = (counts[:, 0] < 20) | (100 * counts[:, 4] > 30 * counts[:, 0])
                none = sums[2, rows] == 0
                means = (pa.array(-sums[k, rows] / np.maximum(sums[2, rows], 1), mask=none | (k == 0 and not whole)) for k in range(2))
                yield with_columns(batch, [*((prefix + c, pa.array(counts[:, k])) for k, c in enumerate(_COUNTS)), (prefix + "base_failed", pa.array(failed)), *zip(logs, means)])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *fields])).drop(half)


def _gathered(batches: Iterator[pa.RecordBatch], text: int, chars: int) -> Iterator[list[pa.RecordBatch]]:
    """Consecutive batches with texts of at least ``chars`` bytes together."""
    group: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        group.append(batch)
        size += batch.column(text).nbytes
        if size >= chars:
            yield group
            group, size = [], 0
    if group:
        yield group


def _log_sums(texts: list[str], langs: list[str | None], halves: list[int], source: Resident | Filed) -> np.ndarray:
    """Of each text the log probability by the model of all texts and by that of the other half, and its characters."""
    total = np.zeros((3, len(texts)))
    asked: list[Asked] = []
    held = 0

    def answer() -> None:
        models = source.answers(asked)
        for a in asked:
            for k, by in enumerate((models.get(WHOLE), models[str(1 - a.half)])):
                if by is not None:
                    total[k, a.rows] += np.bincount(a.grams.owner, by.log_p(a.lang, a.grams)[a.grams.where], len(a.rows))
            total[2, a.rows] += np.bincount(a.grams.owner, minlength=len(a.rows))
        asked.clear()

    for (lang, half), rows in _by_language(langs, halves).items():
        for grams in _windows([texts[i] for i in rows]):
            asked.append(Asked(lang, half, np.array(rows), Grams(grams.symbols, grams.where.astype(np.int32), grams.owner.astype(np.int32))))
            held += len(grams.owner)
            if held >= source.held_chars:
                answer()
                held = 0
    if asked:
        answer()
    return total


def bands(scored: DataFrame, prefix: str = "") -> DataFrame:
    """(band_lang, band_mid, band_unit): median and quartile range of unseen perplexity.

    Quartiles are exact over quantised values of all documents that pass the base
    rules; the quantised histogram is what is shuffled.
    """
    q = F.round(F.col(prefix + "unseen_perplexity") * STEPS).cast("int")
    bins = scored.filter(~F.col(prefix + "base_failed")).groupBy(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias(prefix + "band_lang"), q.alias("q")).agg(F.count("*").alias("n"))
    stats = bins.groupBy(prefix + "band_lang").agg(F.percentile("q", [0.25, 0.5, 0.75], F.col("n")).alias("p"))
    unit = F.greatest(F.col("p")[2] - F.col("p")[0], F.lit(0.02 * STEPS)) / STEPS
    return stats.select(prefix + "band_lang", (F.col("p")[1] / STEPS).alias(prefix + "band_mid"), unit.alias(prefix + "band_unit"))


def judge(scored: DataFrame, limits: DataFrame, prefix: str = "") -> DataFrame:
    """``scored`` with its language's band_low and band_high, and kept."""
    joined = scored.join(limits, F.coalesce(F.col("lang").cast("string"), F.lit("und")) == F.col(prefix + "band_lang"), "left").drop(prefix + "band_lang")
    x, mid = F.col(prefix + "unseen_perplexity"), F.col(prefix + "band_mid")
    half = BAND_WIDTH * F.col(prefix + "band_unit") * F.sqrt(1 + BAND_CHARS / F.greatest(F.col(prefix + "word_chars"), F.lit(1)))
    joined = joined.withColumns({prefix + "band_low": mid - half, prefix + "band_high": mid + half})
    inside = F.coalesce(x.between(F.col(prefix + "band_low"), F.col(prefix + "band_high")), F.lit(False))
    return joined.withColumn(prefix + "kept", ~F.col(prefix + "base_failed") & inside)


def quality_rules(docs: DataFrame) -> DataFrame:
    """One row per document: base counts, perplexity, band and verdict."""
    docs = docs.select("doc_id", "text", "lang")
    scored = saved(score(docs, fit(docs, whole=True)).drop("text"), "kn-scored")
    out = judge(scored, bands(scored))
    return out.select("doc_id", *_COUNTS, "base_failed", F.exp("log_perplexity").alias("perplexity"), F.exp("unseen_perplexity").alias("perplexity_unseen"), F.exp("band_low").alias("perplexity_low"), F.exp("band_high").alias("perplexity_high"), "kept")


def keep_good(docs: DataFrame) -> DataFrame:
    """``docs`` without the documents that the rules reject."""
    model = fit(docs.select("text", "lang"))
    names = docs.columns
    prefix = "q_"
    while any(c.lower().startswith(prefix) for c in names):
        prefix = "_" + prefix
    scored = score(docs, model, prefix)
    kept = judge(scored, saved(bands(scored, prefix), "kn-bands"), prefix)
    return kept.filter(F.col(prefix + "kept")).select(*names)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: the rules over the whole documents table."""
    return quality_rules(table(spark, sf_dir, "documents"))
