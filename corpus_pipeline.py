"""A training corpus from ``documents``: known languages, not toxic, one of each group of
near duplicates, no benchmark passages, encoded.

Each stage is written as Parquet in the cluster's shared folder and read again, so a lost
executor costs the stage that runs. Every stage but the last returns the columns of
documents, whatever else they are called, as they are. Every stage takes rows with a null
doc_id, rows that repeat and empty tables: what a row's text says decides about it, a null
id joins no group of copies, and an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandflow.llm import bpe, decontam, langid, near_dedup, toxicity
from strandflow.llm.common import materialise, read_table
from strandflow.llm.queries import tokenizer_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or that no learned language fits, go; so do null texts."""
    return langid.keep_known(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored toxic go; null and empty texts stay."""
    return toxicity.keep_clean(docs, read_table(spark, sf_dir, "labels"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, 0.8) the smallest doc_id stays.

    Rows without an id or without a word stay."""
    return near_dedup.keep_one(docs, width=5, percent=80)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, or one with other names and numbers, go; null
    and empty texts stay."""
    return decontam.keep_clean(docs, read_table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each whole text, and the digest of what they decode to; a null text is
    empty. Of the documents' columns the id, language and source are kept."""
    path = tokenizer_path(spark, "word_bpe_49k.json")
    out = bpe.encode(docs.select("doc_id", "lang", "source", "text"), path, without=("text",), decoded=True)
    return out.select("doc_id", "lang", "source", "ids", F.size("ids").alias("n_tokens"), "decoded_sha256")


STAGES = [
    ("language_id", language),
    ("toxicity", clean),
    ("near_dedup", distinct),
    ("decontamination", without_benchmark),
    ("bpe_encoding", encoded),
]

#: The models of the first two stages have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table ``documents`` of ``sf_dir``, in order."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
