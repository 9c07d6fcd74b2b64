"""The queries of the text operators and their SQL, for the entry module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tochi.llm import alignment, chat, embeddings, langid, licenses, lines, minhash, packing, phrases, pieces, quality, warc, webpages


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_license_scan": licenses.query,
        "op2_quality_rules": quality.query,
        "op3_line_dedup": lines.query,
        "op4_language_id": langid.query,
        "op5_minhash_near_dedup": minhash.query,
        "op6_html_extraction": webpages.query,
        "op7_sentencepiece": pieces.query,
        "op8_packing": packing.query,
        "op9_chat_formatting": chat.query,
        "op10_embedding_near_dedup": embeddings.query,
        "op11_warc": warc.query,
        "op12_phrase_collocations": phrases.query,
        "op13_tokenizer_alignment": alignment.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_license_scan": licenses.ORACLE_SQL,
        "op3_line_dedup": lines.ORACLE_SQL,
        "op9_chat_formatting": chat.ORACLE_SQL,
        "op11_warc": warc.ORACLE_SQL,
        "op12_phrase_collocations": phrases.ORACLE_SQL,
    }
