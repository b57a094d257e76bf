"""A corpus from raw documents to token ids.

Quality and toxicity reject documents, near duplicates give way to the first of their group,
benchmark passages are cut out, and what is left is encoded. Every stage works on all that its
predecessor kept; between stages the rows are written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skyledger.llm import decontaminate, quality, sentencepiece_fst, simhash, toxicity
from skyledger.llm.common import DOCUMENT_COLUMNS, stored, table
from skyledger.session import tune


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    tune(spark)  # for all stages
    return quality.drop_low_quality(docs)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_near_duplicates(docs, simhash.SHINGLE)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, the text that they decode to, and whether it is the text that went in."""
    pieces = sentencepiece_fst.read_model()
    done = sentencepiece_fst.round_trip(docs.select(*DOCUMENT_COLUMNS), pieces)
    return done.select("doc_id", "lang", "source", "n_chars", "ids", "n_pieces", "decoded", "round_trip")


STAGES = [
    ("quality classifier", quality_stage),
    ("toxicity", toxicity_stage),
    ("SimHash near-dedup", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("SentencePiece encoding and decoding", encoding_stage),
]

# Trained models and hashes have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for place, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if place + 1 < len(STAGES):
            docs = stored(docs, "pipeline")
    return docs
