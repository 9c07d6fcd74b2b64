"""Phrase collocations by prefix-free parsing.

Texts are cut into chunks at places that their words choose: a border stands where the
hash of the next OVERLAP words says so (or LONGEST_CHUNK words after the last one).
A chunk reaches OVERLAP words past its end, and owns the phrases that start before it,
so that every phrase of up to four words is counted in exactly one chunk. The chunks
form a dictionary with the frequency of each, and repeated passages, copies and short
pieces are in it once. All counts are taken inside the distinct chunks, weighted.

Phrases rarer than the bound are nearly all there are, so the dictionary is passed three
times: (1) words, by their text; (2) pairs of frequent words, by a hash, whose
frequent ones are marked in a bitmap; (3) phrases whose words and pairs are all marked,
by their text. Bitmaps only let phrases pass and have a fixed size, whatever the corpus;
every count is of texts and exact. Each pass adds up within a batch before it shuffles.

Definitions for odd input: null and empty texts have no words; a null lang is ``und``;
repeated rows count each time; an empty table gives no rows; a text or piece may be of
any length; columns beside text and lang are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tochi.llm.common import BROADCAST_FACTS, discard, mix, saved, small_batches, table, texts_of, tidied

#: The contract's figures: words of a phrase, its least count, the share of its count that
#: a longer phrase must have to displace it (in hundredths), scale of scores, rows a lang.
LONGEST, LEAST, DISPLACED, SCALE, TOP = 4, 30, 80, 2_000_000, 2000
#: Words that a chunk shares with the next; mean distance of borders; most words between two.
OVERLAP, SPACING, LONGEST_CHUNK = LONGEST - 1, 16, 128
#: Bits of a bitmap: 16 for each key, within these bounds (2 to 32 MB).
FEWEST_BITS, MOST_BITS = 1 << 24, 1 << 28
#: Parts up to this count are rare: phrases made of them are scored first.
RARE = 64 * LEAST
#: Langs whose floors are written into the plan.
FEW_LANGS = 50
#: Bytes of a batch that one pass over the dictionary adds up; bits of a pair's key.
MERGED_BYTES, KEY_BITS = 4 << 20, 40
#: Parts of a lang whose best rows are found apart before they meet.
SALTS = 16

# Kinds of bytes: 0 of a word, 1 between words, 2 between pieces.
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = 2
_PRIME = np.uint64(0x100000001B3)


class Words:
    """The words of some texts, one behind the other, each with one space behind it in ``flat``."""

    def __init__(self, texts: list[bytes]) -> None:
        raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        kind = _KIND[raw]
        inside = kind == 0
        edge = np.diff(np.concatenate([[0], inside.view(np.int8), [0]]))
        first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        keep = inside.copy()
        keep[last] = True
        flat = np.where(inside, raw, 0x20)[keep]
        self.flat = flat
        self.size = last - first
        self.stop = np.cumsum(self.size + 1) - 1
        self.start = self.stop - self.size
        # piece of each word: borders seen before it; text of each word: line feeds between texts
        borders = np.cumsum(kind == 2)
        self.piece = borders[first]
        ends = np.cumsum([len(t) + 1 for t in texts])
        self.text = np.searchsorted(ends, first, side="right")

    def __len__(self) -> int:
        return len(self.size)

    def column(self) -> pa.Array:
        """The words as an Arrow column."""
        is_word = np.ones(len(self.flat), bool)
        is_word[self.stop] = False
        offsets = np.concatenate([[0], np.cumsum(self.size)]).astype(np.int32)
        return pa.Array.from_buffers(pa.string(), len(self), [None, pa.py_buffer(offsets), pa.py_buffer(self.flat[is_word])])

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        if not len(self):
            return np.zeros(0, np.uint64)
        with np.errstate(over="ignore"):
            powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(int(self.size.max()), _PRIME)]))
            at = np.arange(len(self.flat)) - np.repeat(self.start, self.size + 1)
            values = (self.flat.astype(np.uint64) + np.uint64(1)) * powers[at]
            return mix(np.add.reduceat(values, self.start))

    def spans(self, first: np.ndarray, words: np.ndarray) -> pa.Array:
        """Phrases of ``words`` words from word ``first`` on, as an Arrow column."""
        if not len(first):
            return pa.array([], pa.string())
        begin, end = self.start[first], self.stop[first + words - 1]
        size = end - begin
        offsets = np.concatenate([[0], np.cumsum(size)])
        at = np.repeat(begin - offsets[:-1], size) + np.arange(offsets[-1])
        kind, width = (pa.string(), np.int32) if offsets[-1] < 1 << 31 else (pa.large_string(), np.int64)
        return pa.Array.from_buffers(kind, len(first), [None, pa.py_buffer(offsets.astype(width)), pa.py_buffer(self.flat[at])]).cast(pa.string())


def _left(group: np.ndarray) -> np.ndarray:
    """How many places of its group stand from each place on, itself included; groups are runs."""
    n = len(group)
    last = np.flatnonzero(np.append(np.diff(group) != 0, True)) if n else np.zeros(0, np.int64)
    run = np.cumsum(np.concatenate([[0], np.diff(group) != 0])) if n else last
    return last[run] - np.arange(n) + 1 if n else np.zeros(0, np.int64)


def chunks_of(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, owned words and all words of each chunk."""
    left = _left(words.piece)
    n = len(left)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    h = words.hashes()
    with np.errstate(over="ignore"):
        window = mix(h + np.roll(h, -1) * np.uint64(3) + np.roll(h, -2) * np.uint64(5))
    start = np.concatenate([[True], np.diff(words.piece) != 0])
    border = start | ((window % np.uint64(SPACING) == 0) & (left >= OVERLAP + 1))
    first = np.flatnonzero(border)
    own = np.diff(np.append(first, n))
    if own.max() > LONGEST_CHUNK:  # far from any border: cut at even distances
        parts = -(-own // LONGEST_CHUNK)
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        rest = np.repeat(own, parts) - nth * LONGEST_CHUNK
        first, own = np.repeat(first, parts) + nth * LONGEST_CHUNK, np.minimum(rest, LONGEST_CHUNK)
    return first, own, np.minimum(own + OVERLAP, left[first])


def dictionary(docs: DataFrame) -> DataFrame:
    """lang, chunk, own (words whose phrases it owns) and freq of the distinct chunks."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            words = Words([t.encode("utf-8", "replace").lower() for t in texts_of(batch.column(1))])  # lower() of bytes: A-Z alone
            first, own, size = chunks_of(words)
            lang = batch.column(0).take(pa.array(words.text[first]))
            yield pa.RecordBatch.from_arrays([lang, words.spans(first, size), pa.array(own.astype(np.int32))], names=["lang", "chunk", "own"])

    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "lang string, chunk string, own int").groupBy("lang", "chunk", "own").agg(F.count("*").alias("freq"))


class Bitmap:
    """Keys that may pass: a fixed number of bits, set for every frequent key."""

    def __init__(self, bits: bytes) -> None:
        self.words = np.frombuffer(bits, np.uint64)

    def has(self, keys: np.ndarray) -> np.ndarray:
        place = keys & np.uint64(len(self.words) * 64 - 1)
        return (self.words[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) > 0


def marked(keys: DataFrame) -> bytes:
    """The bitmap of the 64-bit column ``key``, made of 64 bits a row in Spark."""
    size = FEWEST_BITS
    n = keys.count()
    while size < min(16 * n, MOST_BITS):
        size *= 2
    rows = keys.selectExpr(f"shiftright(key & {size - 1}L, 6) as word", "shiftleft(1L, cast(key & 63L as int)) as bit")
    words = np.zeros(size // 64, np.int64)
    found = rows.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()  # at most size / 64 rows
    words[found["word"].to_numpy()] = found["bits"].to_numpy()
    return words.tobytes()


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of about MERGED_BYTES, so that more equal keys meet before they are shuffled."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= MERGED_BYTES:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if size:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _parts(batch: pa.RecordBatch) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Words of a batch of the dictionary, lang code, weight and number of phrase starts left of each; langs."""
    words = Words([c.encode("utf-8", "replace") for c in batch.column(1).to_pylist()])
    coded = batch.column(0).dictionary_encode()
    lang, freq, own = coded.indices.to_numpy(), batch.column(3).to_numpy(), batch.column(2).to_numpy()
    nth = np.arange(len(words)) - np.flatnonzero(np.diff(np.append(-1, words.text)) != 0)[np.cumsum(np.diff(np.append(-1, words.text)) != 0) - 1] if len(words) else np.zeros(0, np.int64)
    weight = np.where(nth < own[words.text], freq[words.text], 0)  # words of the overlap are the next chunk's
    return words, lang[words.text].astype(np.int64), weight, words.text, coded.dictionary


def _summed(key: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, a place of each, and their summed weights."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[first], order[first], np.add.reduceat(weight[order], first) if len(key) else np.zeros(0, np.int64)


def word_counts(chunks: DataFrame) -> DataFrame:
    """lang, phrase and f of all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _merged(batches):
            words, lang, weight, _, langs = _parts(batch)
            own = weight > 0
            if not own.any():
                continue
            coded = words.column().dictionary_encode()
            key = (coded.indices.to_numpy().astype(np.int64) * len(langs) + lang)[own]
            key, _, n = _summed(key, weight[own])
            yield pa.RecordBatch.from_arrays([langs.take(pa.array(key % len(langs))), coded.dictionary.take(pa.array(key // len(langs))), pa.array(n)], names=["lang", "phrase", "f"])

    return chunks.mapInArrow(run, "lang string, phrase string, f long").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def _word_keys(words: Words, lang: np.ndarray, langs: pa.Array) -> np.ndarray:
    """The bitmap key of each word with its lang."""
    of_lang = Words([x.encode() for x in langs.to_pylist()])
    own = np.zeros(len(langs), np.uint64)
    np.add.at(own, of_lang.text, of_lang.hashes())
    with np.errstate(over="ignore"):
        return mix(words.hashes() * np.uint64(7) + own[lang])


def word_keys(counts: DataFrame) -> DataFrame:
    """key of each (lang, phrase) whose phrase is one word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                coded = batch.column(0).dictionary_encode()
                words = Words([w.encode() for w in batch.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([pa.array(_word_keys(words, coded.indices.to_numpy().astype(np.int64), coded.dictionary).view(np.int64))], names=["key"])

    return counts.select("lang", "phrase").mapInArrow(run, "key long")


def _pair_keys(h: np.ndarray) -> np.ndarray:
    """The bitmap key of each word with the next; more bits than a bitmap has are not moved."""
    with np.errstate(over="ignore"):
        return mix(h[:-1] * np.uint64(3) + h[1:]) & np.uint64((1 << KEY_BITS) - 1)


def pair_keys(chunks: DataFrame, known) -> DataFrame:
    """key and f of pairs of marked words; different pairs may share a key, which only lets more pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passes = Bitmap(known.value)
        for batch in _merged(batches):
            words, lang, weight, text, langs = _parts(batch)
            if len(words) < 2:
                continue
            h = _word_keys(words, lang, langs)
            passed = passes.has(h)
            pair = (text[1:] == text[:-1]) & (weight[:-1] > 0) & passed[:-1] & passed[1:]
            key, _, n = _summed(_pair_keys(h)[pair], weight[:-1][pair])
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], names=["key", "f"])

    return chunks.mapInArrow(run, "key long, f long").groupBy("key").agg(F.sum("f").alias("f"))


def phrase_counts(chunks: DataFrame, known, pairs) -> DataFrame:
    """lang, phrase, words and f of phrases of two words or more whose words and pairs are marked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word_passes, pair_passes = Bitmap(known.value), Bitmap(pairs.value)
        for batch in _merged(batches):
            words, lang, weight, text, langs = _parts(batch)
            if len(words) < 2:
                continue
            h = _word_keys(words, lang, langs)
            passed = word_passes.has(h)
            pair = np.append((text[1:] == text[:-1]) & passed[:-1] & passed[1:] & pair_passes.has(_pair_keys(h)), False)
            # ids of phrases that grow by a word at a time; each is exact within the batch
            code = words.column().dictionary_encode().indices.to_numpy().astype(np.int64)
            goes_on, ids = np.ones(len(words), bool), code * len(langs) + lang
            for size in range(2, LONGEST + 1):
                # a phrase: the one a word shorter that starts here, and the one that starts at the next word
                goes_on = pair & (goes_on if size == 2 else np.append(goes_on[1:], False))
                at = np.flatnonzero(goes_on)
                if not len(at):
                    break
                both = ids[at] * (int(ids.max()) + 1) + ids[at + 1] if int(ids.max()) < 1 << 31 else None
                if both is None:  # ids too wide to be packed: number them first
                    ids = np.unique(ids, return_inverse=True)[1]
                    both = ids[at] * (int(ids.max()) + 1) + ids[at + 1]
                distinct, place, n = _summed(both, weight[at])
                ids = np.zeros(len(words), np.int64)
                ids[at] = np.searchsorted(distinct, both)
                counted = n > 0
                first = at[place][counted]
                yield pa.RecordBatch.from_arrays([langs.take(pa.array(lang[first])), words.spans(first, np.full(len(first), size)), pa.array(np.full(len(first), size, np.int32)), pa.array(n[counted])], names=["lang", "phrase", "words", "f"])

    return chunks.mapInArrow(run, "lang string, phrase string, words int, f long").groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f"))


def _piece(phrase: Column, first: Column, words: Column) -> Column:
    return F.array_join(F.slice(F.split(phrase, " "), first, words), " ")


def _wide(c: str) -> Column:
    return F.col(c).cast("decimal(20,0)")


def _cuts(found: DataFrame) -> DataFrame:
    """A row for each cut of each phrase: k, and the parts ``first`` and ``rest``."""
    names = ["lang", "phrase", "words", F.col("f").alias("a")]
    two = found.filter("words = 2").select(*names, F.lit(1).alias("k"))
    more = found.filter("words > 2").select(*names, F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    return two.unionByName(more).withColumns({"first": _piece(F.col("phrase"), F.lit(1), F.col("k")), "rest": _piece(F.col("phrase"), F.col("k") + 1, F.col("words") - F.col("k"))})


def _with_part(cuts: DataFrame, counts: DataFrame, part: str, name: str, wanted: Column, most: int) -> DataFrame:
    """``cuts`` with the count of their ``part`` as ``name``, as far as ``wanted`` holds then.

    The join itself applies ``wanted``. Few counts are broadcast whole; of many, the
    heaviest are, and only cuts without a heavy part are shuffled.
    """
    facts = counts.select(F.col("lang").alias("_lang"), F.col("phrase").alias("_part"), F.col("f").alias(name))
    same = (F.col("lang") == F.col("_lang")) & (F.col(part) == F.col("_part"))
    n, total = facts.agg(F.count("*"), F.coalesce(F.sum(name), F.lit(0))).first()
    if n <= most:
        return cuts.join(F.broadcast(facts), same & wanted).drop("_lang", "_part")
    heavy = F.col(name) > total // most
    top = F.broadcast(facts.filter(heavy))
    by_top = cuts.join(top, same & wanted)
    light = cuts.join(top.select("_lang", "_part"), same, "left_anti").join(facts.filter(~heavy), same & wanted)
    return by_top.unionByName(light).drop("_lang", "_part")


def _scored(cuts: DataFrame, counts: DataFrame, left: Column, right: Column, most: int) -> DataFrame:
    """lang, phrase, a, score, k, l and r of phrases all of whose cuts pass ``left`` and ``right``."""
    cuts = _with_part(_with_part(cuts, counts, "first", "l", left, most), counts, "rest", "r", right, most)
    score = F.expr(f"(cast(a as decimal(20,0)) * {SCALE}) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    best = cuts.groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("best"), F.count("*").alias("cuts"))
    return best.filter("cuts = words - 1").select("lang", "phrase", "a", "best.*")


def _longer(found: DataFrame) -> DataFrame:
    """lang, phrase and longer: the highest count of a phrase one word longer around it.

    A phrase two words longer needs no look: the one between them is at least as frequent.
    """
    ends = F.array(_piece(F.col("phrase"), F.lit(1), F.col("words") - 1), _piece(F.col("phrase"), F.lit(2), F.col("words") - 1))
    return found.filter("words > 2").select("lang", "f", F.explode(ends).alias("phrase")).groupBy("lang", "phrase").agg(F.max("f").alias("longer"))


def _ranked(scored: DataFrame, longer: DataFrame, top: int) -> DataFrame:
    """The first ``top`` phrases of each lang that no longer one displaces, with their rank."""
    around = longer.select(F.col("lang").alias("_lang"), F.col("phrase").alias("_phrase"), "longer")
    displaced = (F.col("lang") == F.col("_lang")) & (F.col("phrase") == F.col("_phrase")) & (_wide("longer") * 100 >= _wide("a") * DISPLACED)
    kept = scored.join(around, displaced, "left_anti")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = kept.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    best = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("rank") <= top)
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)


def _with_floor(cuts: DataFrame, floors: DataFrame) -> DataFrame:
    """``cuts`` with the floor of their lang, 0 if it has none: by a literal if langs are few."""
    few = floors.limit(FEW_LANGS + 1).collect()
    if len(few) > FEW_LANGS:
        return cuts.join(floors, "lang", "left").withColumn("floor", F.coalesce("floor", F.lit(0).cast("long")))
    floor = F.lit(0).cast("long")
    for lang, score in few:
        floor = F.when(F.col("lang") == lang, F.lit(score).cast("long")).otherwise(floor)
    return cuts.withColumn("floor", floor)


def collocations(docs: DataFrame, top: int = TOP, most: int = BROADCAST_FACTS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of the best phrases of each lang.

    Frequent pairs of frequent words are many and score low. So phrases of rare parts are
    scored first; the score of the ``top``-th of them is a floor of its lang, and a phrase
    goes as soon as one of its parts is so frequent that no score up to the floor is left.
    """
    spark = docs.sparkSession
    with tidied(spark):
        chunks = saved(dictionary(docs), "phrase-chunks")
        words = saved(word_counts(chunks).filter(F.col("f") >= LEAST), "phrase-words")
        known = spark.sparkContext.broadcast(marked(word_keys(words)))
        frequent = saved(pair_keys(chunks, known).filter(F.col("f") >= LEAST).select("key"), "phrase-pairs")
        pairs = spark.sparkContext.broadcast(marked(frequent))
        found = saved(phrase_counts(chunks, known, pairs).filter(F.col("f") >= LEAST), "phrase-found")
        known.unpersist()
        pairs.unpersist()
        totals = saved(chunks.groupBy("lang").agg(F.sum(F.col("own") * F.col("freq")).alias("n")), "phrase-totals")
        discard(chunks, frequent)

        # every part of a frequent phrase is at least as frequent, so all parts are in one table
        counts = saved(words.select("lang", "phrase", "f").unionByName(found.select("lang", "phrase", "f")), "phrase-counts")
        longer = saved(_longer(found), "phrase-longer")
        rare = [F.col(c) <= RARE for c in ("l", "r")]
        first = saved(_ranked(_scored(_cuts(found), counts, *rare, most), longer, top), "phrase-first")
    cuts = _with_floor(_cuts(found), first.filter(F.col("rank") == top).select("lang", F.col("score").alias("floor")))
    # a cut scores at most SCALE * a / (l + a), since r is at least a
    reaches = [_wide("a") * SCALE >= _wide("floor") * (_wide("l") + _wide(c)) for c in ("a", "r")]
    ranked = _ranked(_scored(cuts, counts, *reaches, most), longer, top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: the collocations of each lang of documents."""
    return collocations(table(spark, sf_dir, "documents"))


ORACLE_SQL = f"""
WITH pieces AS (
  SELECT doc_id, coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents),
lists AS (SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda w: w <> '') AS w FROM pieces),
starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM lists WHERE len(w) > 0),
sized AS (SELECT lang, w, i, unnest(range(1, {LONGEST + 1})) AS m FROM starts),
f AS (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase, count(*) AS f FROM sized WHERE i + m - 1 <= len(w) GROUP BY ALL),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang),
c AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE m >= 2 AND f >= {LEAST}),
cut AS (SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS p1, array_to_string(w[k + 1:], ' ') AS p2
        FROM (SELECT *, unnest(range(1, m)) AS k FROM c)),
scored AS (SELECT cut.lang, cut.phrase, a, k, x.f AS l, y.f AS r, ((a::HUGEINT * {SCALE}) // (x.f + y.f))::BIGINT AS score
           FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = p1 JOIN f y ON y.lang = cut.lang AND y.phrase = p2),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_ AS (SELECT lang, array_to_string(w[i:i + s - 1], ' ') AS phrase, max(a) AS longer
           FROM (SELECT *, unnest(range(1, m - s + 2)) AS i FROM (SELECT *, unnest(range(2, m)) AS s FROM c)) GROUP BY ALL),
kept AS (SELECT best.* FROM best LEFT JOIN inner_ USING (lang, phrase) WHERE longer IS NULL OR longer * 100 < a * {DISPLACED})
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept JOIN totals USING (lang) QUALIFY rank <= {TOP}
"""
