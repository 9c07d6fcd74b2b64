"""Language identification: multinomial naive Bayes over hashed character n-grams.

Spark counts hashed n-grams of the training documents per language; the matrix of
log probabilities (BUCKETS x languages) is broadcast and a batch is scored as a
sparse matrix in numpy. BUCKETS is fixed; of more than BLOCK_LANGUAGES labels, a
block of them at a time is broadcast and the texts are scored block after block.

Definitions for odd input: a null text, or one without a letter, is ``und`` with
score 0; so is every text where nothing was learned. Null languages and null
doc_ids are never trained on. Ties go to the first language in code-point order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tochi.llm.common import grouped, mix, saved, small_batches, spare_name, table, texts_of, with_columns

ORDERS = (1, 2, 3)
BUCKET_BITS = 16
BUCKETS = 1 << BUCKET_BITS
#: Languages of one block: its matrix takes 64 MB.
BLOCK_LANGUAGES = 256
SMOOTHING = 0.5
#: A document may fit its language worse than the median by this many interquartile
#: ranges, times sqrt(1 + FIT_CHARS / n) for n characters. Set on the labels of sf0.1:
#: of the documents that pass op2's base rules it rejects 195 of 301 of quality 0 and
#: 60 of 3,302 of quality 1 (a width of 3: 248 and 91; 6: 156 and 26).
FIT_WIDTH = 4.0
FIT_CHARS = 1000
FIT_STEPS = 1000

_letter = regex.compile(r"\p{L}")


def held_out(doc_id: Column) -> Column:
    """True for the documents that training must not see."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def _buckets(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text index, bucket, count) of all n-grams, a sparse matrix by row."""
    pieces: list[tuple[int, str]] = []
    for i, text in enumerate(texts):
        low = text.lower()
        for at in range(0, len(low), 1 << 19):
            pieces.append((i, (low[at - 2 : at] if at else "  ") + low[at : at + (1 << 19)]))
    for group in grouped([p for _, p in pieces], 1 << 19):
        chosen = [pieces[g] for g in group]
        points = np.frombuffer("".join(p for _, p in chosen).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
        sizes = np.array([len(p) for _, p in chosen])
        starts = np.cumsum(sizes) - sizes
        inside = np.ones(len(points), dtype=bool)
        inside[starts] = inside[starts + 1] = False
        inside = inside[2:]
        row = np.repeat(np.arange(len(chosen), dtype=np.int64), sizes)[2:][inside]
        keys = []
        for n in ORDERS:
            gram = points[2:].copy()
            for k in range(1, n):
                gram |= points[2 - k : len(points) - k] << np.uint64(21 * k)
            keys.append((row << BUCKET_BITS) | (mix(gram[inside] + np.uint64(n)) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64))
        cells, counts = np.unique(np.concatenate(keys), return_counts=True)
        yield np.array([i for i, _ in chosen])[cells >> BUCKET_BITS], cells & (BUCKETS - 1), counts


def _train_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    documents: dict[str, int] = {}

    def emit() -> Iterator[pa.RecordBatch]:
        for lang, total in sums.items():
            used = np.flatnonzero(total)
            bucket = np.append(used, -1)  # bucket -1 carries the number of documents
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(bucket), pa.string()), pa.array(bucket.astype(np.int32)), pa.array(np.append(total[used], documents[lang]))], names=["lang", "bucket", "n"])
        sums.clear()
        documents.clear()

    for batch in batches:
        langs, texts = batch.column(0).to_pylist(), texts_of(batch.column(1))
        by: dict[str, list[str]] = {}
        for lang, text in zip(langs, texts):
            by.setdefault(lang, []).append(text)
        for lang, own in by.items():
            if lang not in sums:
                if len(sums) >= BLOCK_LANGUAGES:
                    yield from emit()
                sums[lang] = np.zeros(BUCKETS, np.int64)
            documents[lang] = documents.get(lang, 0) + len(own)
            for _, bucket, count in _buckets(own):
                np.add.at(sums[lang], bucket, count)
    yield from emit()


#: Languages in code-point order, log probabilities BUCKETS x languages, and log priors.
Block = tuple[list[str], np.ndarray, np.ndarray]


def train(docs: DataFrame) -> list[Broadcast]:
    """The model as blocks of at most BLOCK_LANGUAGES languages, each broadcast."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    rows = rows.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    counts = saved(rows.mapInArrow(_train_batches, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")), "li-counts")
    documents = dict(sorted(tuple(r) for r in counts.filter("bucket = -1").select("lang", "n").collect()))  # one number a language
    everything = sum(documents.values())
    blocks = []
    for at in range(0, max(len(documents), 1), BLOCK_LANGUAGES):
        names = list(documents)[at : at + BLOCK_LANGUAGES]
        column = {x: k for k, x in enumerate(names)}
        seen = np.zeros((BUCKETS, len(names)))
        if names:
            got = counts.filter((F.col("bucket") >= 0) & F.col("lang").between(names[0], names[-1])).toArrow()
            seen[got.column(1).to_numpy(), np.array([column[x] for x in got.column(0).to_pylist()], np.int64)] = got.column(2).to_numpy()
        log_p = np.log((seen + SMOOTHING) / (seen.sum(axis=0) + SMOOTHING * BUCKETS)).astype(np.float32)
        prior = np.log(np.array([documents[x] for x in names]) / max(everything, 1))
        blocks.append(spark.sparkContext.broadcast((names, log_p, prior)))
    return blocks


def _log_joint(texts: list[str], block: Block) -> tuple[np.ndarray, np.ndarray]:
    """(log prior + log likelihood, texts x languages; n-grams of each text)."""
    names, log_p, prior = block
    total, grams = np.tile(prior, (len(texts), 1)), np.zeros(len(texts))
    for row, bucket, count in _buckets(texts) if names else ():
        grams += np.bincount(row, count, len(texts))
        first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        part = np.add.reduceat(log_p[bucket] * count[:, None].astype(np.float64), first, axis=0)
        np.add.at(total, row[first], part)
    return total, grams


def predict(docs: DataFrame, model: list[Broadcast], prefix: str = "") -> DataFrame:
    """``docs`` with lang_pred, score and fit.

    ``score`` is the posterior of the prediction, ``fit`` the mean log probability of
    an n-gram in that language; a long text's posterior is near 1 whatever it holds,
    its fit is not. ``fit`` is null where lang_pred is ``und``.
    """
    small_batches(docs.sparkSession)
    names = docs.columns
    best, most, total, fit = (spare_name(names, "state_" + x) for x in ("best", "most", "total", "fit"))
    nothing = F.lit(None).cast("double")
    docs = docs.withColumns({best: F.lit(None).cast("string"), most: nothing, total: nothing, fit: nothing})
    for block in model:
        docs = _best_of(docs, block, (best, most, total, fit))
        if len(model) > 1:
            docs = saved(docs, "li-best")
    out = {prefix + "lang_pred": F.coalesce(best, F.lit("und")), prefix + "score": F.coalesce(F.exp(F.col(most) - F.col(total)), F.lit(0.0)), prefix + "fit": F.col(fit)}
    return docs.select(*names, *(c.alias(k) for k, c in out.items()))


def _best_of(docs: DataFrame, block: Broadcast, state: tuple[str, ...]) -> DataFrame:
    """``docs`` with the state carried on: best language, its log joint, that of all languages, its fit."""
    at, places = docs.columns.index("text"), [docs.columns.index(x) for x in state]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, _, prior = block.value
        for batch in batches:
            texts = texts_of(batch.column(at))
            joint, grams = _log_joint(texts, block.value)
            rows = [list(r) for r in zip(*(batch.column(k).to_pylist() for k in places))]
            for text, line, n, row in zip(texts, joint, grams, rows):
                if not len(line) or not _letter.search(text):
                    continue
                k = int(np.argmax(line))
                own = line[k] + np.log(np.exp(line - line[k]).sum())
                row[2] = float(own if row[2] is None else np.logaddexp(row[2], own))
                if row[1] is None or line[k] > row[1]:  # of equals the first in code-point order stays
                    row[0], row[1], row[3] = names[k], float(line[k]), float((line[k] - prior[k]) / n)
            kinds = (pa.string(), pa.float64(), pa.float64(), pa.float64())
            new = {p: pa.array([r[j] for r in rows], kinds[j]) for j, p in enumerate(places)}
            yield pa.RecordBatch.from_arrays([new.get(k, batch.column(k)) for k in range(batch.num_columns)], names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document."""
    model = train(docs.select("doc_id", "text", "lang"))
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), held_out(F.col("doc_id")).alias("held_out"))
    return predict(rows, model).drop("text", "fit")


def fit_limits(docs: DataFrame, model: list[Broadcast], prefix: str = "") -> DataFrame:
    """(fit_lang, fit_mid, fit_unit): median and quartile range of fit by language told.

    Taken over the held-out documents, which training has not seen; what is shuffled
    is a histogram of FIT_STEPS bins a unit.
    """
    seen = predict(docs.filter(held_out(F.col("doc_id"))).select(F.col("text").cast("string").alias("text")), model)
    bins = seen.filter("lang_pred <> 'und'").groupBy("lang_pred", F.round(F.col("fit") * FIT_STEPS).cast("int").alias("q")).agg(F.count("*").alias("n"))
    stats = bins.groupBy("lang_pred").agg(F.percentile("q", [0.25, 0.5, 0.75], F.col("n")).alias("p"))
    unit = F.greatest(F.col("p")[2] - F.col("p")[0], F.lit(0.02 * FIT_STEPS)) / FIT_STEPS
    return stats.select(F.col("lang_pred").alias(prefix + "fit_lang"), (F.col("p")[1] / FIT_STEPS).alias(prefix + "fit_mid"), unit.alias(prefix + "fit_unit"))


def keep_identified(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """``docs`` whose language is told and that fit it.

    Rejected are those without a language (``und``), with a posterior under ``least``,
    and those whose fit is far below their language's; a language of which no document
    was held out has no limit.
    """
    model = train(docs.select("doc_id", "text", "lang"))
    names = docs.columns
    prefix = spare_name([c[:3] for c in names], "li_")
    limits = saved(fit_limits(docs, model, prefix), "li-limits")
    out = predict(docs, model, prefix).join(F.broadcast(limits), F.col(prefix + "lang_pred") == F.col(prefix + "fit_lang"), "left")
    wide = FIT_WIDTH * F.col(prefix + "fit_unit") * F.sqrt(1 + FIT_CHARS / F.greatest(F.length("text"), F.lit(1)))
    fits = F.coalesce(F.col(prefix + "fit") >= F.col(prefix + "fit_mid") - wide, F.lit(True))
    return out.filter((F.col(prefix + "lang_pred") != "und") & (F.col(prefix + "score") >= least) & fits).select(*names)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: the language of every document of the table."""
    return identify(table(spark, sf_dir, "documents"))
