"""Packing by a space-filling curve.

Each document's ids are hashed and projected to a few dimensions; its place on the
Hilbert curve through them orders the corpus, and neighbours along the curve fill
sequences one after the other. Documents are cut freely, so only the last
sequence has padding.

Three Spark steps, none of which gathers documents in one place: (1) ids and curve
key by task, written to the shared folder; (2) a range sort of the keys alone,
ties dealt by a hash of the row, with the token sums of the ranges (one number
each, summed up on the driver and joined back as a small table); (3) a join of each
row's start with its ids, which then cuts its own pieces.

Definitions for odd input: a null text is empty and is packed as its end id alone;
repeated rows are packed each by itself, a null doc_id as any other; an empty table
gives no pieces; columns beside doc_id and text are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tochi.llm.common import mix, saved, small_batches, table

LENGTH = 1024
END_ID = 0
DIMENSIONS = 4
#: Bits of each dimension on the curve.
LEVELS = 12
#: Distinct words a worker's table holds before it is emptied.
HELD_WORDS = 500_000

#: White space other than lone spaces and line feeds, where borders between
#: pre-tokens depend on what follows; such texts go to the library whole.
_irregular = re.compile("[^\\S \\n]|[\x01\x1c-\x1f\x85]")
_UNPLAIN = "  |\n\n| \n|\n |\x01"


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    return tokenizer, [t.content for t in tokenizer.get_added_tokens_decoder().values()]


class Tokens:
    """ids by the tokenizers library, each distinct word encoded once in a task."""

    def __init__(self, path: str) -> None:
        self.tokenizer, added = _tokenizer(path)
        self.unplain = "|".join([_UNPLAIN, *(f"\\Q{a}\\E" for a in added)])
        self.line_feed = self.tokenizer.encode("\n", add_special_tokens=False).ids[0]
        self._clear()

    def _clear(self) -> None:
        """The table: words, their ids one behind the other, and how many each has."""
        self.words, self.ids, self.size = pa.array([""], pa.string()), np.zeros(0, np.uint32), np.zeros(1, np.int64)
        self._add([",", ".", "\n", " "])

    def _add(self, words: list[str]) -> None:
        """Encode words in lines of one text, since a line feed is a token of its own between words."""
        parts = [np.zeros(0, np.uint32)]
        for at in range(0, len(words), 5000):
            some = words[at : at + 5000]
            ids = np.array(self.tokenizer.encode_batch_fast(["\n".join(some) + "\n"], add_special_tokens=False)[0].ids, np.uint32)
            stop = np.flatnonzero(ids == self.line_feed)
            if len(stop) != len(some) or any(w.isspace() for w in some):
                found = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]
                size = np.array([len(x) for x in found])
                parts += found
            else:
                size = np.diff(np.append(-1, stop)) - 1
                parts.append(ids[ids != self.line_feed])
            self.size = np.append(self.size, size).astype(np.int64)
        self.words = pa.concat_arrays([self.words, pa.array(words, pa.string())])
        self.ids = np.concatenate([self.ids, *parts])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, END_ID behind each, and where each text ends.

        Arrow cuts the texts into words and finds them in the table; a text whose words
        do not stand for themselves is encoded whole.
        """
        if len(self.words) > HELD_WORDS:
            self._clear()
        texts = pc.fill_null(texts, "")
        whole = pc.match_substring_regex(texts, self.unplain).to_numpy(zero_copy_only=False)
        cut = pc.if_else(pa.array(whole), "", texts)
        for c, by in ((" ", "\x01 "), ("\n", "\x01\n\x01")):
            cut = pc.replace_substring(cut, c, by)
        cut = pc.split_pattern(cut, "\x01")
        at = cut.offsets.to_numpy() - cut.offsets[0].as_py()
        owner = np.repeat(np.arange(len(texts)), np.diff(at))
        coded = cut.flatten().dictionary_encode()
        used, part = coded.dictionary, coded.indices.to_numpy()
        # a last comma or point behind a letter stands for itself, so the table is spared such words
        ends = pc.match_substring_regex(used, "\\pL[,.]$")
        tail = pc.if_else(ends, pc.utf8_slice_codeunits(used, -1, None), "")
        used = pc.if_else(ends, pc.utf8_slice_codeunits(used, 0, -1), used)
        place = pc.index_in(used, value_set=self.words)
        new = used.filter(place.is_null()).unique().to_pylist()
        if new:
            odd = {w for w in new if _irregular.search(w)}  # never held, so always met here
            self._add([w for w in new if w not in odd])
            place = pc.index_in(used, value_set=self.words)
            whole = whole | np.isin(np.arange(len(texts)), owner[place.is_null().to_numpy(zero_copy_only=False)[part]])
        both = np.stack([pc.fill_null(place, 0).to_numpy(), pc.index_in(tail, value_set=self.words[:3]).to_numpy()], axis=1).astype(np.int64).ravel()
        ids = self.ids[_spans(np.cumsum(self.size)[both] - self.size[both], self.size[both])]
        size = self.size[both].reshape(-1, 2).sum(axis=1)
        # every text: its words, or nothing and then itself; behind them the end
        own = [self.tokenizer.encode(texts[int(i)].as_py(), add_special_tokens=False).ids for i in np.flatnonzero(whole)]
        ids = np.concatenate([ids, np.array([END_ID], np.uint32), np.fromiter(chain.from_iterable(own), np.uint32)])
        end = len(size)
        size = np.concatenate([size, [1], [len(x) for x in own], [0]]).astype(np.int64)
        nothing = len(size) - 1
        segment = np.full(len(part) + 2 * len(texts), nothing, np.int64)
        segment[np.arange(len(part)) + 2 * owner] = np.where(whole[owner], nothing, part)
        last = at[1:] + 2 * np.arange(len(texts))
        segment[last[whole]] = end + 1 + np.arange(len(own))
        segment[last + 1] = end
        sizes = size[segment]
        return ids[_spans((np.cumsum(size) - size)[segment], sizes)], np.cumsum(sizes)[last + 1]


def _spans(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (size[0] of them), first[1], ..."""
    stop = np.cumsum(size)
    return np.repeat(first - stop + size, size) + np.arange(stop[-1] if len(stop) else 0)


@lru_cache(maxsize=1)
def tokens_of(path: str) -> Tokens:
    """One table a Python worker, kept from task to task."""
    return Tokens(path)


def project(ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Rows x DIMENSIONS in [0, 1): hashed bags of ids, randomly projected."""
    signs = mix(ids.astype(np.uint64))
    starts = ends - np.diff(np.append(0, ends))
    size = np.maximum(ends - starts, 1)
    out = np.zeros((len(ends), DIMENSIONS))
    for d in range(DIMENSIONS):
        # 16 bits of the id's hash: its weight along direction d, mean 0, deviation 1
        weight = (((signs >> np.uint64(16 * d)) & np.uint64(0xFFFF)).astype(np.float64) / 65536 - 0.5) * np.sqrt(12)
        total = np.append(0.0, np.cumsum(weight))
        out[:, d] = (total[ends] - total[starts]) / size
    return 0.5 + np.arctan(4 * out) / np.pi


def hilbert(points: np.ndarray) -> np.ndarray:
    """Hilbert index of integer points (rows x dimensions, LEVELS bits each).

    Skilling's transform from coordinates to the transposed index, on whole
    columns at once.
    """
    x = points.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (LEVELS - 1)
    while q > 1:
        low = q - 1
        for i in range(n):
            on = (x[i] & q) > 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(on, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], np.int64)
    q = 1 << (LEVELS - 1)
    while q > 1:
        turn ^= np.where((x[n - 1] & q) > 0, q - 1, 0)
        q >>= 1
    x ^= turn
    key = np.zeros(x.shape[1], np.int64)
    for bit in range(LEVELS - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> bit) & 1)
    return key


def tokenised(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, key, n and ids (unsigned 16-bit where they fit) of each row."""
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = tokens_of(path)
        narrow = tokens.tokenizer.get_vocab_size() <= 1 << 16
        kind_of_id = np.dtype("<u2" if narrow else "<u4")
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, ends = tokens.encode(batch.column(1))
            key = hilbert(np.minimum((project(ids, ends) * (1 << LEVELS)).astype(np.int64), (1 << LEVELS) - 1))
            at = np.append(0, ends)
            stored = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer((at * kind_of_id.itemsize).astype(np.int32)), pa.py_buffer(ids.astype(kind_of_id))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(key), pa.array(np.diff(at)), stored, pa.array([narrow] * len(ends))], names=["doc_id", "key", "n", "ids", "narrow"])

    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("key", T.LongType()), T.StructField("n", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("narrow", T.BooleanType())])
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id())


def starts(rows: DataFrame) -> DataFrame:
    """row and start: where each row begins in the order of the curve."""
    spark = rows.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    salt = F.xxhash64("row")
    ranged = rows.select("row", "key", "n").repartitionByRange(parts, "key", salt).withColumn("range", F.spark_partition_id())
    ranged = saved(ranged, "pack-ranges")
    sums = sorted(tuple(r) for r in ranged.groupBy("range").agg(F.sum("n").alias("n")).collect())  # one number a range
    before = spark.createDataFrame(list(zip((k for k, _ in sums), accumulate([0, *(n for _, n in sums)]))), "range int, base long")
    running = F.sum("n").over(Window.partitionBy("range").orderBy("key", F.xxhash64("row"), "row").rowsBetween(Window.unboundedPreceding, -1))
    return ranged.join(F.broadcast(before), "range").select("row", (F.col("base") + F.coalesce(running, F.lit(0))).cast("long").alias("start_at"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        source, start, length, crc, seq, offset, whole = [], [], [], [], [], [], []
        ids, first, narrow = (batch.column(k).to_pylist() for k in (1, 2, 3))
        for i, (raw, at, small) in enumerate(zip(ids, first, narrow)):
            wide = np.frombuffer(raw, dtype="<u2" if small else "<u4").astype("<u4")
            done = 0
            while done < len(wide):
                here = (at + done) % LENGTH
                size = min(LENGTH - here, len(wide) - done)
                source.append(i)
                start.append(done)
                length.append(size)
                crc.append(zlib.crc32(wide[done : done + size].tobytes()))
                seq.append((at + done) // LENGTH)
                offset.append(here)
                whole.append(len(wide))
                done += size
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(source, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, whole, seq, offset))], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])


def pack(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """One row per piece; see the module for the order and the cutting."""
    rows = saved(tokenised(docs, tokenizer_path), "pack-ids")
    joined = rows.select("row", "doc_id", "ids", "narrow").join(starts(rows), "row").select("doc_id", "ids", "start_at", "narrow")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(_cut, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: all documents in sequences of 1024 ids of the public 50k byte BPE."""
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
