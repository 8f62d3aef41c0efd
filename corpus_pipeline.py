"""The corpus pipeline: language identification, near-duplicate removal, decontamination, mixing and
token files, each stage over all that the stage before kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame,
which is written as Parquet and read again as the next stage's ``docs``. All stages but the last
return the columns of ``documents``. Texts that the language model rejects go; one document of each
near-duplicate component stays; contaminated documents go; the mix takes documents as often as its
blocks cover them, one in each cell only up to the word where the last block ends; the last stage writes
the token files and returns what they hold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kinfold.llm.common import Scratch, read
from kinfold.llm.decontaminate import scan
from kinfold.llm.langid import accepted, train, trained_on
from kinfold.llm.mixing import mixed
from kinfold.llm.neardup import deduplicated
from kinfold.llm.token_files import default_tokenizer, token_table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts without a letter and texts whose language is a close call."""
    return accepted(docs, train(trained_on(docs)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each component."""
    return deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold benchmark passages."""
    return scan(docs, read(spark, sf_dir, "benchmark"), keep_rows=True)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take the words of each document that the mix's blocks cover."""
    return mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Write the token files and return what was read back from them."""
    return token_table(docs, default_tokenizer())


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixture", mixture),
    ("tokens", tokens),
]

ORACLE_SQL = None
"""Compression, signatures, suffix arrays and tokenizers are beyond SQL; tests hold the stages against brute force."""


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    scratch, docs = Scratch(spark, "pipeline"), read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.put(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
