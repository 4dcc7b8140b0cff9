"""A training corpus from raw documents: five stages, each a full pass over what the one before it kept.

All stages but the last return the columns of ``documents``; the last returns the packed pieces. Each states its
results on nulls, empty texts and repeated rows in its operator's module.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lattica.llm.jaccard_join import one_of_each_group
from lattica.llm.packing import pack
from lattica.llm.quality import good_documents
from lattica.llm.secrets import redact
from lattica.llm.toxicity import clean_documents
from lattica.session import cut, table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is 0.5 or more go."""
    return clean_documents(docs, table(spark, sf_dir, "labels"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is under 0.3 go."""
    return good_documents(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest doc_id."""
    return one_of_each_group(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the text; every document stays."""
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their place in sequences of 4096 tokens; word memos are small, as workers that other stages use hold them."""
    return pack(docs, memo_bytes=16 << 20)


STAGES = [
    ("toxicity", toxicity),
    ("quality_classifier", quality),
    ("ngram_jaccard_join", near_duplicates),
    ("secret_scans", secret_scans),
    ("best_fit_packing", packing),
]

#: Models, shingle hashes and a tokenizer are beyond SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over the whole ``documents`` table."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = cut(docs)
    return docs
