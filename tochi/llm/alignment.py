"""Alignment of two tokenizers on whole texts, and how often their ids meet.

A is a byte-level tokenizer of the tokenizers library, B a sentencepiece model. Both see
a text with a space before it. The libraries say where tokens lie: A in characters, B in
bytes of the text. Where one token stops and the next begins at the same place, that
place is a cut. Tokens that share a character (the bytes of a multibyte character, byte
fallback) have no such place between them; there the lengths of their decoded bytes,
counted from the last cut, say where they end. Byte offsets where tokens of both end cut
the text into groups, and each is a link of the two tokens that end there.

Neither tokenizer has a token across the border before a lone space, or a lone line feed,
that stands between other characters (for B this is checked when the model is loaded).
So a text is cut there into chunks, a worker keeps a table of distinct chunks, and joins
results by position. When half of the table is full, what was not met since the last
time goes, which changes no result. A point or comma behind a letter at the end of a
chunk is a token of its own for both (for B this is checked too) and needs no other look.

Counts of id pairs over the corpus are sums of the pairs of each document; a frequent pair
is in nearly all documents, so sums are formed in each task first, and pairs go back to
the documents by a broadcast of the counts, or of the heaviest if there are many.

Definitions for odd input: a null or empty text has no tokens, and so has one whose
tokens do not spell it (a text with the marker character U+2581 itself, say); all figures
are then 0 and the digest is empty. Every row is a document of its own, so repeated rows
count each and a null doc_id needs no rule; an empty table gives no rows; columns beside
doc_id and text are ignored.
"""

from __future__ import annotations

import gc
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from operator import attrgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tochi.llm.common import saved, small_batches, table, texts_of, with_facts

MARK = "▁"
#: Distinct chunks in half of a worker's table, and the longest that is kept there.
HELD_CHUNKS, LONG_CHUNK = 300_000, 200
#: New chunks that go through the libraries in one row.
ROW_CHUNKS = 20_000

_irregular = re.compile(r"[^\S \n]|[ \n][ \n]|[ \n]\Z")
_border = re.compile(r"(?<=\S)(?=[ \n]\S)")
_span = attrgetter("id", "begin", "end")
_byte_piece = re.compile(r"<0x([0-9A-F]{2})>\Z")


def byte_alphabet() -> dict[str, int]:
    """Characters in which byte-level vocabularies are written: printable Latin-1 for itself, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(rest)}


def ends_of(spans: list[tuple[int, int]], sizes: list[int]) -> list[int]:
    """Where tokens end, by spans where they cut cleanly and by decoded sizes between."""
    ends, at = [], 0
    for k, ((begin, end), size) in enumerate(zip(spans, sizes)):
        clean = begin == at and end > begin and (k + 1 == len(spans) or spans[k + 1][0] == end)
        at = end if clean else at + size
        ends.append(at)
    return ends


def _ends_of_row(spans: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``ends_of`` on arrays, for tokens that spell their text."""
    decoded = np.cumsum(sizes)
    clean = (spans[:, 0] == np.append(0, decoded[:-1])) & (spans[:, 1] > spans[:, 0]) & (np.append(spans[1:, 0], spans[-1, 1]) == spans[:, 1])
    last = np.maximum.accumulate(np.where(clean, np.arange(len(sizes)), -1))  # the last clean cut up to each token
    cut, counted = np.append(spans[:, 1], 0)[last], np.append(decoded, 0)[last]
    return cut + decoded - counted


class Aligner:
    """Groups of texts by their distinct chunks."""

    def __init__(self, a_path: str, b_path: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        letters = byte_alphabet()
        own = {i: bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode() for t, i in self.a.get_vocab(with_added_tokens=True).items()}
        self.a_bytes = [own.get(i, b"") for i in range(max(own) + 1)]
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        pieces = self.b.id_to_piece(list(range(self.b.vocab_size())))
        if any(MARK in p.lstrip(MARK) or "\n" in p for p in pieces):
            raise ValueError("a piece of this model crosses a border of chunks")
        self.b_bytes = [bytes([int(m[1], 16)]) if (m := _byte_piece.match(p)) else p.replace(MARK, " ").encode() for p in pieces]
        self.lone_mark = self.b.piece_to_id(MARK)
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in parts]) for parts in (self.a_bytes, self.b_bytes))
        #: how an id is written behind another one of its side, as the first of A, and as the first of B
        self.ids = max(len(self.a_bytes), len(self.b_bytes))
        self.names = [f"{c}{i}".encode() for c in ",;|" for i in range(self.ids)]
        #: marks that are a token of their own behind a letter at the end of a chunk, as such chunks are held
        self.marks = {}
        for c in ".,":
            a, b = self.a.encode(c, add_special_tokens=False).ids, self.b.piece_to_id(c)
            if len(a) == 1 and b != self.b.unk_id() and not any(x == c and y.isalpha() for p in pieces for y, x in zip(p, p[1:])):
                self.marks[c] = (f";{a[0]}|{b}".encode(), np.array([a[0] * len(self.b_bytes) + b], np.int64).tobytes())
        #: chunks met since the table was last full, and those of the time before
        self.young: dict[str, tuple] = {}
        self.old: dict[str, tuple] = {}

    def keys(self, text: str) -> list[str]:
        """Chunks of space + text; a chunk of a space and a word is named by the word alone."""
        marked = " " + text
        if not _irregular.search(marked):
            return marked.replace("\n", " \n").split(" ")[1:]
        return [c[1:] if c[0] == " " and c[1:2].strip() else c for c in _border.split(marked)]

    def tokens(self, keys: list[str]) -> Iterator[tuple[bytes, list[int], list[int], list[int], list[int], bool]]:
        """Bytes, ids and ends of A, ids and ends of B, and whether both spell it, of each chunk."""
        chunks = [k if k[0] in " \n" else " " + k for k in keys]
        theirs = self.b.encode([c[1:] if c[0] == " " else c for c in chunks], return_type="proto")
        for chunk, a, b in zip(chunks, self.a.encode_batch(chunks, add_special_tokens=False), theirs):
            raw, a_ids, a_spans = chunk.encode(), a.ids, a.offsets
            if len(raw) > len(chunk):  # characters to bytes
                at = np.concatenate([[0], np.cumsum([len(c.encode()) for c in chunk])]).tolist()
                a_spans = [(at[x], at[y]) for x, y in a_spans]
            shift = 1 if chunk[0] == " " else 0
            b_ids, b_spans = [p.id for p in b.pieces], [(p.begin + shift, p.end + shift) for p in b.pieces]
            if shift:  # the space that the model adds is the chunk's own
                b_spans[0] = (0, b_spans[0][1])
            elif b_ids[0] == self.lone_mark:
                del b_ids[0], b_spans[0]
            a_parts, b_parts = [self.a_bytes[i] for i in a_ids], [self.b_bytes[i] for i in b_ids]
            spelled = b"".join(a_parts) == raw and b"".join(b_parts) == raw
            yield raw, a_ids, ends_of(a_spans, [len(p) for p in a_parts]), b_ids, ends_of(b_spans, [len(p) for p in b_parts]), spelled

    def groups(self, a_ids: list[int], a_ends: list[int], b_ids: list[int], b_ends: list[int]) -> Iterator[tuple[int, list[int], list[int]]]:
        """(byte end, ids of A, ids of B) of each group."""
        both = set(a_ends).intersection(b_ends)
        j = first_a = first_b = 0
        for i, end in enumerate(a_ends):
            if end in both:
                while b_ends[j] != end:
                    j += 1
                yield end, a_ids[first_a : i + 1], b_ids[first_b : j + 1]
                first_a, first_b = i + 1, j + 1

    def learn(self, keys: list[str]) -> dict[str, tuple]:
        """What is held of each distinct chunk: numbers of A and B, written groups, linked pairs; None if not spelled."""
        plain = [k for k in keys if k[0] != " " and len(k.split()) == 1 and not k[-1].isspace()]
        found = self._learn_row(plain) if plain else {}
        rest = [k for k in keys if k not in found]
        for key, (_, a_ids, a_ends, b_ids, b_ends, spelled) in zip(rest, self.tokens(rest)):
            if not spelled:
                found[key] = None
                continue
            groups = list(self.groups(a_ids, a_ends, b_ids, b_ends))
            written = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for _, a, b in groups)
            pairs = np.array([a[-1] * len(self.b_bytes) + b[-1] for _, a, b in groups], np.int64)
            found[key] = (len(a_ids), len(b_ids), written.encode(), pairs.tobytes())
        return found

    def _learn_row(self, keys: list[str]) -> dict[str, tuple]:
        """``learn`` of chunks without white space inside, by one call of each library on all of them in a row.

        Their borders are borders of both tokenizers, so they do not change each other's tokens.
        Nothing is returned if a token does not spell its part of the row.
        """
        keys = sorted(keys, key=lambda k: k[0] == "\n")  # so that the row begins with a space
        if keys[0][0] == "\n":
            return {}
        chunks = [k if k[0] == "\n" else " " + k for k in keys]
        text = "".join(chunks)
        raw = text.encode()
        a, b = self.a.encode(text, add_special_tokens=False), self.b.encode(text[1:], return_type="proto").pieces
        b = np.fromiter(chain.from_iterable(map(_span, b)), np.int64).reshape(-1, 3)
        a_ids, b_ids = a.ids, b[:, 0].tolist()
        if b"".join(map(self.a_bytes.__getitem__, a_ids)) != raw or b"".join(map(self.b_bytes.__getitem__, b_ids)) != raw:
            return {}
        a_spans = np.fromiter(chain.from_iterable(a.offsets), np.int64).reshape(-1, 2)
        b_spans = b[:, 1:] + 1
        b_spans[0, 0] = 0  # the space that the model adds is the row's own
        if len(raw) > len(text):  # characters to bytes
            starts = np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
            a_spans = np.append(starts, len(raw))[a_spans]
        a_ids, b_ids = np.array(a_ids), np.array(b_ids)
        a_ends, b_ends = _ends_of_row(a_spans, self.a_sizes[a_ids]), _ends_of_row(b_spans, self.b_sizes[b_ids])
        both = np.intersect1d(a_ends, b_ends, assume_unique=True)
        a_group, b_group = np.searchsorted(both, a_ends), np.searchsorted(both, b_ends)
        pairs = (a_ids[np.flatnonzero(np.isin(a_ends, both, assume_unique=True))] * len(self.b_bytes) + b_ids[np.flatnonzero(np.isin(b_ends, both, assume_unique=True))]).astype(np.int64)
        # tokens of a group: those of A, then those of B; each is written behind its separator
        order = np.argsort(np.concatenate([a_group * 2, b_group * 2 + 1]), kind="stable")
        first = np.concatenate([np.diff(a_group, prepend=-1) != 0, np.diff(b_group, prepend=-1) != 0])
        sign = np.where(first, np.repeat([1, 2], [len(a_ids), len(b_ids)]), 0)[order]
        written = list(map(self.names.__getitem__, (sign * self.ids + np.concatenate([a_ids, b_ids])[order]).tolist()))
        stops = np.cumsum([len(c.encode()) for c in chunks]) if len(raw) > len(text) else np.cumsum([len(c) for c in chunks])
        n_a, n_b, n_groups = (np.searchsorted(x, stops, side="right") for x in (a_ends, b_ends, both))
        found, at_a, at_b, at_g = {}, 0, 0, 0
        packed = pairs.tobytes()
        for key, to_a, to_b, to_g in zip(keys, n_a.tolist(), n_b.tolist(), n_groups.tolist()):
            found[key] = (to_a - at_a, to_b - at_b, b"".join(written[at_a + at_b : to_a + to_b])[1:], packed[8 * at_g : 8 * to_g])
            at_a, at_b, at_g = to_a, to_b, to_g
        return found

    def align(self, texts: list[str]) -> Iterator[tuple[int, int, bytes, bytes]]:
        """Numbers of tokens of A and B, written groups and linked pairs of each text."""
        own = [self.keys(t) if t else [] for t in texts]
        young, old = self.young, self.old
        both: dict[str, tuple] = {}

        def known(key: str) -> bool:
            if key not in young:
                if key not in old:
                    return False
                young[key] = old[key]
            both[key] = young[key]
            return True

        new = {k for k in set(chain.from_iterable(own)) if not known(k)}
        ended = [k for k in new if k[-1] in self.marks and k[-2:-1].isalpha()]
        new.difference_update(ended)
        new.update(b for b in {k[:-1] for k in ended} if not known(b))
        learnt = list(new)
        for at in range(0, len(learnt), ROW_CHUNKS):
            found = self.learn(learnt[at : at + ROW_CHUNKS])
            both |= found
            young.update((k, v) for k, v in found.items() if len(k) <= LONG_CHUNK)
        for key in ended:
            base = both[key[:-1]]
            if base is not None:
                written, pair = self.marks[key[-1]]
                base = (base[0] + 1, base[1] + 1, base[2] + written, base[3] + pair)
            both[key] = base
            if len(key) <= LONG_CHUNK:
                young[key] = base
        if len(young) > HELD_CHUNKS:
            self.young, self.old = {}, young
        for keys in own:
            parts = [both[k] for k in keys]
            if None in parts or not parts:
                yield 0, 0, b"", b""
            else:
                a, b, written, pairs = zip(*parts)
                yield sum(a), sum(b), b";".join(written), b"".join(pairs)

    def spans(self, text: str) -> list[tuple[int, list[int], list[int]]]:
        """(byte end in space + text, ids of A, ids of B) of each group of one text."""
        out, at = [], 0
        for raw, a_ids, a_ends, b_ids, b_ends, spelled in self.tokens(self.keys(text)) if text else ():
            if not spelled:
                return []
            out += [(at + end, a, b) for end, a, b in self.groups(a_ids, a_ends, b_ids, b_ends)]
            at += len(raw)
        return out


@lru_cache(maxsize=1)
def aligner_of(a_path: str, b_path: str) -> Aligner:
    """One table a Python worker, kept from task to task."""
    return Aligner(a_path, b_path)


def group_spans(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id and groups: array of (byte end in space + text, ids of A, ids of B)."""
    small_batches(docs.sparkSession)
    kind = T.StructType([docs.select("doc_id").schema[0], T.StructField("groups", T.ArrayType(T.StructType([T.StructField("stop", T.LongType()), T.StructField("a", T.ArrayType(T.IntegerType())), T.StructField("b", T.ArrayType(T.IntegerType()))])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pa.list_(pa.struct([("stop", pa.int64()), ("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))]))
        for batch in batches:
            found = [[{"stop": s, "a": a, "b": b} for s, a, b in aligner_of(a_path, b_path).spans(t)] for t in texts_of(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, own)], names=["doc_id", "groups"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, kind)


def aligned(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id, row, n_a, n_b, n_groups, n_links, groups_sha256, pairs and times (distinct linked pairs) of each document.

    A pair is the id of A times the size of B's vocabulary plus the id of B.
    """
    small_batches(docs.sparkSession)
    kind = T.StructType([docs.select("doc_id").schema[0], *(T.StructField(n, T.LongType()) for n in ("n_a", "n_b", "n_groups", "n_links")), T.StructField("groups_sha256", T.StringType()), T.StructField("pairs", T.ArrayType(T.LongType())), T.StructField("times", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = aligner_of(a_path, b_path)
        gc.disable()  # no cycles are made, and the table is large to search for them
        for batch in batches:
            n_a, n_b, digests, pairs = [], [], [], []
            for a, b, written, linked in aligner.align(texts_of(batch.column(1))):
                n_a.append(a)
                n_b.append(b)
                digests.append(hashlib.sha256(written).hexdigest() if written else "")
                pairs.append(linked)
            links = np.array([len(p) // 8 for p in pairs], np.int64)
            both = np.frombuffer(b"".join(pairs), np.int64) if links.any() else np.zeros(0, np.int64)
            key = np.sort((np.repeat(np.arange(len(pairs)), links) << 40) | both)  # ids of both stay below 2^40
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
            offsets = np.searchsorted(key[first] >> 40, np.arange(len(pairs) + 1)).astype(np.int32)
            pair, times = key[first] & ((1 << 40) - 1), np.diff(np.append(first, len(key)))
            arrays = [pa.array(n_a, pa.int64()), pa.array(n_b, pa.int64()), pa.array(links), pa.array(links), pa.array(digests, pa.string()), pa.ListArray.from_arrays(offsets, pa.array(pair, pa.int64())), pa.ListArray.from_arrays(offsets, pa.array(times, pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=kind.fieldNames())
        gc.enable()

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, kind).withColumn("row", F.monotonically_increasing_id())


def id_pairs(rows: DataFrame, b_size: int) -> DataFrame:
    """pair, a, b, n (links of the corpus) and best (no pair of this b has more) of all linked pairs."""
    each = rows.select(F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("p.*")
    counts = saved(each.groupBy(F.col("pairs").alias("pair")).agg(F.sum("times").alias("n")).withColumns({"a": F.expr(f"pair div {b_size}"), "b": F.expr(f"pair % {b_size}")}), "align-counts")
    top = counts.groupBy("b").agg(F.max("n").alias("top"))  # a row an id of B at most
    return counts.join(F.broadcast(top), "b").select("pair", "a", "b", "n", (F.col("n") == F.col("top")).alias("best"))


def alignment(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """The figures of each document; see the module."""
    import sentencepiece

    rows = saved(aligned(docs, a_path, b_path), "align-rows")
    facts = saved(id_pairs(rows, sentencepiece.SentencePieceProcessor(model_file=b_path).vocab_size()).select("pair", "n", "best"), "align-pairs")
    each = rows.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("row", F.col("p.pairs").alias("pair"), F.col("p.times").alias("times"))
    scored = with_facts(each, facts, "pair", "n")
    sums = scored.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return rows.join(sums, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: documents by the public 50k byte BPE and the public 32k pieces."""
    import public_tokenizers

    return alignment(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
