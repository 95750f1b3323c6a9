"""A corpus pipeline of five stages, each over all that the one before it kept.

STAGES holds (name, function); a function takes (spark, docs, sf_dir) and returns a
DataFrame. run writes each stage's rows as parquet into the shared folder and reads
them again as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from segmenta.llm import decontam, ngram_join, pieces, pii, toxicity
from segmenta.llm.store import saved
from segmenta.session import table

STAGES = [
    ("toxicity", toxicity.stage),
    ("near_duplicates", ngram_join.stage),
    ("decontamination", decontam.stage),
    ("pii", pii.stage),
    ("sentencepiece", pieces.stage),
]

#: learned scores and sampled pieces are no SQL; tests hold the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents: doc_id, ids, n_pieces, lossless of what is kept."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
