"""Corpus cleaning: language ID, exact dedup, near dedup, repeated passages,
packing. Each stage works on all rows its predecessor kept.

Stages take (spark, docs, sf_dir) and return a DataFrame, which is written as
Parquet and reread as the next stage's input. All but the last return the
columns of ``documents``; the last returns the packed pieces. Empty inputs give
empty results; null texts and texts without a letter go in the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kiln.llm import exact_dedup, language_id, near_dedup, packing, suffix_dedup
from kiln.llm.helpers import held_out_of, read, staged

# A repeated passage: about fifty words. Copies of whole texts are gone by then.
PASSAGE_BYTES, PASSAGE_COVER = 250, 128


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is certain enough; rejected ones go."""
    model = language_id.fit_dictionaries(docs, ~held_out_of("doc_id", (4, 2)))
    return language_id.accepted_rows(docs, model)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the largest id) of each group of equal texts."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the smallest id) of each near-duplicate component."""
    return near_dedup.drop_near_copies(docs)


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that occur elsewhere too; ``n_chars`` follows
    the text, and documents without any text left go."""
    out = suffix_dedup.remove_repeats(docs, length=PASSAGE_BYTES, cover=PASSAGE_COVER)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed pieces: shard, bin, doc_id, piece, text_start, n_bytes, bin_offset."""
    return packing.pack(docs)


STAGES = [("language_id", identify_language), ("exact_dedup", drop_exact_copies), ("near_dedup", drop_near_copies),
          ("repeated_passages", remove_repeated_passages), ("packing", pack_sequences)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
