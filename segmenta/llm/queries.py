"""Queries over the provided tables, one for each operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontam, html_text, lm, neighbours, ngram_join, pieces, pii, spans, toxicity, urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard_join": ngram_join.query,
    "op2_embedding_near_dedup": neighbours.query,
    "op3_lm_scoring": lm.query,
    "op4_url_filters": urls.query,
    "op5_sentencepiece": pieces.query,
    "op6_toxicity": toxicity.query,
    "op7_html_extraction": html_text.query,
    "op8_substring_dedup": spans.query,
    "op9_benchmark_decontamination": decontam.query,
    "op10_pii": pii.query,
}

#: the others are no SQL: learned scores, sampled pieces, parsers and keyed networks; tests hold them against brute force
ORACLE_SQL: dict[str, str] = {
    "op1_ngram_jaccard_join": ngram_join.SQL,
    "op2_embedding_near_dedup": neighbours.SQL,
    "op9_benchmark_decontamination": decontam.SQL,
}
