"""Near-duplicate lines by a deletion-neighbourhood join, in DataFrame functions only.

A line is its words (runs of anything but the six ASCII spaces) in lower case. A line
goes if an earlier line, by (doc_id, position), has the same words, however few, or if
both have MIN_WORDS words or more and are within the edit bound: one word put in, taken
out or replaced turns one into the other. The bound is one word at every length, which
is a similarity of 0.8 or more at MIN_WORDS = 5 words and closer for longer lines.

Every line of MIN_WORDS words or more emits, as hashed keys, itself and all its variants with one word taken
out. Two lines of n words that agree in a variant at one place differ in that word;
a line that equals a variant of a longer one lacks that word. So the earliest member
of a key stands for all others (no pairs within a key), and each drop is verified on
the words. Beforehand, lines of which neither half is shared with another line, and
which therefore have no partner, are set aside by counts of hashed halves.

Definitions for odd input: a null text stays null; empty lines stay; null doc_ids
order last; rows equal in doc_id and text are one document and keep the same lines;
a text that loses all lines becomes empty and its row stays; other columns pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tochi.llm.common import saved, spare_name, table, with_facts

MIN_WORDS = 5
#: Keys of lines that may have partners are broadcast up to this many; beyond, the
#: lines are shuffled to them.
BROADCAST_KEYS = 2_000_000


def canonical(text: Column) -> Column:
    """A text in lower case with one space between the words of a line, none at its ends.

    Worked out on whole texts: a filter on single lines would be pushed below the
    projection and would lower each line once for every look at it.
    """
    low = F.lower(text)
    odd = F.startswith(low, F.lit(" ")) | F.endswith(low, F.lit(" "))
    for part in ("  ", " \n", "\n ", "\t", "\x0b", "\x0c", "\r"):
        odd = odd | F.contains(low, F.lit(part))
    single = F.regexp_replace(low, "[\\x09\\x0B-\\x0D\\x20]+", " ")
    return F.when(odd, F.btrim(F.regexp_replace(single, " ?\n ?", "\n"), F.lit(" "))).otherwise(low)


def _half_keys(line: Column, n: Column) -> Column:
    """Hashes of the halves of a line as an equal or shorter and as a longer partner."""
    def pair(m: Column) -> list[Column]:
        a = F.floor(m / 2).cast("int")
        return [F.xxhash64(F.lit("p"), m, F.call_function("substring_index", line, F.lit(" "), a)), F.xxhash64(F.lit("s"), m, F.call_function("substring_index", line, F.lit(" "), a - m))]

    return F.array(*pair(n), *pair(n - 1))


def _order(doc: str = "d") -> Column:
    return F.struct(F.col(doc).isNull().alias("last"), F.col(doc).alias("id"), F.col("h"), F.col("pos"))


def _lines(docs: DataFrame) -> DataFrame:
    """d, h, pos, words (with one space between), n and c (their hash) of each line with a word."""
    # hashed and split below the generator: beside it, both would run once a line; the
    # outer form keeps the split out of an inferred filter (texts here are never null)
    parts = docs.select(F.col("doc_id").alias("d"), F.xxhash64("text").alias("h"), F.split(canonical(F.col("text")), "\n").alias("parts"))
    rows = parts.select("d", "h", F.posexplode_outer("parts").alias("pos", "words"))
    rows = rows.filter("words <> ''")
    n = F.octet_length("words") - F.octet_length(F.replace("words", F.lit(" "), F.lit(""))) + 1
    return rows.withColumn("n", n).withColumn("c", F.xxhash64("words"))


def near_lines(lines: DataFrame, classes: DataFrame) -> DataFrame:
    """c of the distinct lines (c, n, first, halves) that an earlier one is near to."""
    lines, classes = lines.filter(F.col("n") >= MIN_WORDS), classes.filter(F.col("n") >= MIN_WORDS)
    halves = classes.select("c", F.explode("halves").alias("half"))
    shared = halves.groupBy("half").agg(F.count("*").alias("k"), F.min("c").alias("x")).filter("k > 1").select("half")
    hopeful = saved(halves.join(shared, "half", "left_semi").select("c").distinct(), "ln-hopeful")
    if hopeful.count() <= BROADCAST_KEYS:
        hopeful = F.broadcast(hopeful)
    own = lines.join(hopeful, "c", "left_semi").groupBy("c").agg(F.split(F.any_value("words"), " ").alias("words"))
    own = saved(own.join(classes.select("c", "n", "first"), "c"), "ln-words")

    place = Window.partitionBy("c").orderBy("j")
    each = own.select("c", "n", "first", F.posexplode("words").alias("j", "w"))
    each = each.withColumn("here", F.xxhash64("w", "j")).withColumn("moved", F.xxhash64("w", F.col("j") - 1))
    before = F.coalesce(F.bit_xor("here").over(place.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    after = F.bit_xor("moved").over(Window.partitionBy("c")).bitwiseXOR(F.bit_xor("moved").over(place.rowsBetween(Window.unboundedPreceding, 0)))
    whole = F.bit_xor("here").over(Window.partitionBy("c"))
    each = saved(each.select("c", "n", "first", "j", before.bitwiseXOR(after).alias("v"), whole.alias("whole")), "ln-variants")
    full = each.filter("j = 0").select(F.col("whole").alias("v"), F.col("n").alias("m"), F.col("c").alias("f"), F.col("first").alias("f_first"))
    variants = each.select("c", "n", "first", "j", "v")

    # one word replaced: equal variants of equal length at one place
    best = variants.groupBy("v", "j", "n").agg(F.count("*").alias("k"), F.min(F.struct("first", "c")).alias("e")).filter("k > 1")
    replaced = variants.join(best.select("v", "j", "n", F.col("e.c").alias("by")), ["v", "j", "n"]).filter("c <> by").select("c", "by", "j", F.lit("r").alias("how"))
    # one word put in: a line equal to a variant of a line one word longer
    longer = variants.withColumn("m", F.col("n") - 1)
    late_long = longer.join(full, ["v", "m"]).filter("f_first < first").select("c", F.col("f").alias("by"), "j", F.lit("l").alias("how"))
    early = longer.groupBy("v", "m").agg(F.min(F.struct("first", "c", "j")).alias("e"))
    late_short = full.join(early, ["v", "m"]).filter("e.first < f_first").select(F.col("f").alias("c"), F.col("e.c").alias("by"), F.col("e.j").alias("j"), F.lit("s").alias("how"))
    found = saved(replaced.unionByName(late_long).unionByName(late_short), "ln-found")

    text = own.select("c", "words")
    both = found.join(text, "c").join(text.select(F.col("c").alias("by"), F.col("words").alias("others")), "by")

    def without(words: str) -> Column:
        w = F.col(words)
        return F.concat(F.slice(w, F.lit(1), F.col("j")), F.slice(w, F.col("j") + 2, F.size(w)))

    same = F.when(F.col("how") == "r", without("words") == without("others")).when(F.col("how") == "l", without("words") == F.col("others")).otherwise(F.col("words") == without("others"))
    return both.filter(same).select("c").distinct()


def dropped_lines(docs: DataFrame) -> DataFrame:
    """d, h and the sorted positions of the lines to drop, for documents that have any."""
    lines = _lines(docs.filter(F.col("text").isNotNull()))
    halves = F.when(F.col("n") >= MIN_WORDS, _half_keys(F.col("words"), F.col("n")))
    classes = lines.withColumn("halves", halves).groupBy("c").agg(F.any_value("n").alias("n"), F.min(_order()).alias("first"), F.count("*").alias("copies"), F.any_value("halves").alias("halves"))
    classes = saved(classes, "ln-classes")
    near = saved(near_lines(lines, classes).withColumn("near", F.lit(True)), "ln-near")
    affected = classes.select("c", "copies", "first").join(near, "c", "left").filter("near or copies > 1").select("c", "first", "copies", F.coalesce("near", F.lit(False)).alias("near"))
    places = with_facts(lines.select("c", "d", "h", "pos"), saved(affected, "ln-affected"), "c", "copies").filter(F.col("near") | (_order() != F.col("first")))
    return places.groupBy("d", "h").agg(F.sort_array(F.collect_set("pos")).alias("gone"))


def _rest(lines: Column, gone: Column) -> Column:
    """``lines`` without the sorted positions ``gone``, in time linear in both."""
    def part(i: Column) -> Column:
        begin = F.when(i == 0, F.lit(0)).otherwise(F.get(gone, i - 1) + 1)
        end = F.when(i == F.size(gone), F.size(lines)).otherwise(F.get(gone, i))
        return F.slice(lines, begin + 1, end - begin)

    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(gone)), part))


def dedup_lines(docs: DataFrame, gone: str = "gone") -> DataFrame:
    """``docs`` with texts less their repeated lines, and the positions dropped."""
    out = saved(dropped_lines(docs.select("doc_id", "text")), "ln-gone")
    d, h = spare_name(docs.columns, "d"), spare_name(docs.columns, "h")
    out = out.select(F.col("d").alias(d), F.col("h").alias(h), F.col("gone").alias(gone))
    joined = docs.join(out, docs["doc_id"].eqNullSafe(out[d]) & (F.xxhash64(docs["text"]) == out[h]), "left").drop(d, h)
    text = F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.array_join(_rest(F.split("text", "\n"), F.col(gone)), "\n"))
    return joined.withColumn("text", text)


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated lines taken out and n_chars put right; no row goes."""
    gone = spare_name(docs.columns, "gone")
    out = dedup_lines(docs, gone)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(gone).isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: every document with its lines counted, those dropped, and its text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    n = F.size(F.split("text", "\n"))
    out = dedup_lines(docs.withColumn("n_lines", F.coalesce(n, F.lit(0)).cast("long")))
    return out.select("doc_id", "n_lines", F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"), "text")


#: The same rows in DuckDB; variants are spelled out instead of hashed.
ORACLE_SQL = r"""
WITH docs AS (SELECT DISTINCT doc_id, text, string_split(text, chr(10)) AS parts FROM documents),
lines AS (
  SELECT doc_id, text, pos, list_filter(regexp_split_to_array(lower(parts[pos]), '[\x09-\x0D\x20]+'), lambda w: w <> '') AS words
  FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS pos FROM docs)),
worded AS (SELECT *, len(words) AS n FROM lines WHERE len(words) > 0),
ranked AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS LAST, pos) AS o FROM worded),
classes AS (SELECT words, any_value(n) AS n, min(o) AS o FROM ranked GROUP BY words),
long AS (SELECT * FROM classes WHERE n >= 5),
variants AS (
  SELECT words, n, o, j, list_concat(words[1:j - 1], words[j + 1:n]) AS v
  FROM (SELECT *, unnest(range(1, n + 1)) AS j FROM long)),
replaced AS (SELECT v, j, min(o) AS first_o FROM variants GROUP BY v, j),
near AS (
  SELECT a.words FROM variants a JOIN replaced b ON a.v = b.v AND a.j = b.j WHERE b.first_o < a.o
  UNION SELECT a.words FROM variants a JOIN long f ON a.v = f.words WHERE f.o < a.o
  UNION SELECT f.words FROM variants a JOIN long f ON a.v = f.words WHERE a.o < f.o),
gone AS (
  SELECT r.doc_id, r.text, list(r.pos) AS gone
  FROM ranked r JOIN classes c ON r.words = c.words LEFT JOIN near m ON m.words = c.words
  WHERE m.words IS NOT NULL OR r.o <> c.o GROUP BY r.doc_id, r.text)
SELECT d.doc_id, coalesce(len(string_split(d.text, chr(10))), 0)::BIGINT AS n_lines, coalesce(len(g.gone), 0)::BIGINT AS n_dropped,
  CASE WHEN g.gone IS NULL THEN d.text ELSE array_to_string([string_split(d.text, chr(10))[i] for i in range(1, len(string_split(d.text, chr(10))) + 1) if not list_contains(g.gone, i)], chr(10)) END AS text
FROM documents d LEFT JOIN gone g ON d.doc_id IS NOT DISTINCT FROM g.doc_id AND d.text = g.text
"""
