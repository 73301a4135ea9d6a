"""A training-corpus pipeline over ``documents``; each stage's rows are written as Parquet and read by the next."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from planframe.llm import minhash, packing, quality, substrings
from planframe.llm.common import settle, tune
from planframe.session import ship


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly trained scorer rejects go."""
    tune(ship(spark))
    return quality.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least doc_id, of each class of near duplicates stays (five-word shingles, 0.8)."""
    tune(ship(spark))
    return minhash.drop_near_duplicates(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that a document with a smaller doc_id holds are cut from the texts."""
    tune(ship(spark))
    return substrings.drop_repeats(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each text lies among the training sequences of 4096 tokens."""
    tune(ship(spark))
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), remembered=100_000)


STAGES = [
    ("quality_filter", quality_filter),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("best_fit_packing", best_fit_packing),
]

#: The stages have no SQL form (a fitted model, a tokenizer and a packing); tests compare each with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the ``documents`` below ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
