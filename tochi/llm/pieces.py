"""SentencePiece encoding and decoding by a table of distinct marked words.

No piece of the model has a whitespace marker behind another character (checked
when the model is loaded), so no merge crosses the border before a run of
markers. Each worker keeps a table of the distinct marked words it met, has the
library segment and decode each once, and joins ids and surfaces back by position.
The table is emptied when it is full, which costs time and never changes a result.

Definitions for odd input: a null text is the empty text and has the ids of begin
and end only; every row is encoded by itself, so repeated rows and null doc_ids
need no rule.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tochi.llm.common import small_batches, table, texts_of

MARK = "\u2581"
#: Distinct words a worker's table holds.
HELD_WORDS = 500_000
#: Longer words are segmented each time they occur and not kept.
LONG_WORD = 200

_chunk = re.compile(" *[^ ]+| +")


@lru_cache(maxsize=2)
def _model(path: str):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = model.id_to_piece(list(range(model.vocab_size())))
    if any(MARK in p.lstrip(MARK) for p in pieces):
        raise ValueError("a piece of this model crosses a whitespace marker")
    return model


class Encoder:
    """ids and decoded text by distinct words, equal to the library's on whole texts."""

    def __init__(self, path: str) -> None:
        self.model = _model(path)
        self.lone_mark = self.model.piece_to_id(MARK)
        self.words: dict[str, tuple[bytes, bytes]] = {}

    def _segment(self, word: str) -> tuple[bytes, bytes]:
        """(ids, surface) of a word whose first marker was taken off."""
        ids = self.model.encode(word) if word else [self.lone_mark]
        surface = " " + self.model.decode(ids)
        found = np.array(ids, dtype="<u4").tobytes(), surface.encode()
        if len(word) <= LONG_WORD:
            if len(self.words) >= HELD_WORDS:
                self.words.clear()
            self.words[word] = found
        return found

    def encode(self, text: str) -> tuple[bytes, bytes]:
        """(ids without begin and end, decoded text)."""
        if not text:
            return b"", b""
        marked = " " + text.replace(MARK, " ")
        words = marked.split(" ")[1:] if "  " not in marked and marked[-1] != " " else [c[1:] for c in _chunk.findall(marked)]
        held = self.words
        parts = [held.get(w) or self._segment(w) for w in words]
        return b"".join([p[0] for p in parts]), b"".join([p[1] for p in parts])[1:]


@lru_cache(maxsize=1)
def encoder_of(path: str) -> Encoder:
    """One table a Python worker, kept from task to task."""
    return Encoder(path)


def digests(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(model_path)
        begin, end = (np.array([x], dtype="<u4").tobytes() for x in (encoder.model.bos_id(), encoder.model.eos_id()))
        for batch in batches:
            counts, ids, decoded = [], [], []
            for text in texts_of(batch.column(1)):
                own, surface = encoder.encode(text)
                counts.append(len(own) // 4 + 2)
                ids.append(hashlib.sha256(begin + own + end).hexdigest())
                decoded.append(hashlib.sha256(surface).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: every whole text of documents through the public 32k piece model."""
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
