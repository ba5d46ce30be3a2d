"""Corpus preparation in five stages, each over all documents that the one before it kept.

Quality rules drop documents, the n-gram join leaves one of each group of near copies (five-word
shingles, similarity of 0.8 or more), decontamination drops documents that hold benchmark passages,
personal data is replaced, and what is left is encoded. Stages pass tables through the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from newsburst.llm import decontam, partenum, pieces, quality, surrogates
from newsburst.llm.common import table
from newsburst.llm.queries import SURROGATE_KEY, model_file
from newsburst.session import stage


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return partenum.keep_one(docs, words=5, percent=80)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pii_surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return surrogates.pseudonymize(docs, SURROGATE_KEY)


def sentencepiece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.add_ids(docs, model_file("piece_bpe_32k.model"))


STAGES = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("pii_surrogates", pii_surrogates),
    ("sentencepiece_ids", sentencepiece_ids),
]

#: SQL cannot express the tokenizer; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, apply in STAGES:
        docs = stage(apply(spark, docs, sf_dir), name)
    return docs
