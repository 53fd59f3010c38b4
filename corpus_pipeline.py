"""Documents to training sequences: quality, near copies, secrets, packing.

Each stage takes what the one before kept, written and read again. The first three return the columns of ``documents``:

1. quality: documents that the ranking rejects go; it is learned from all labels of the documents at hand.
2. near copies: of each component of near copies (five-word shingles, similarity 0.8) the smallest id stays.
3. secrets: what is found is masked in the text, and the document stays.
4. packing: sequences of a power of two of ids, with the ids.

Each stage's handling of nulls, empty texts, repeated rows and empty tables is stated at its operator.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from epipanel.llm import near_dedup, packing, quality, secret_scan
from epipanel.llm.common import read_table, stage


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, quality.learn(docs, read_table(spark, sf_dir, "labels")))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.drop_near_copies(docs, width=5, percent=80)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=True)


STAGES = [("quality", good_quality), ("near copies", without_near_copies), ("secrets", without_secrets), ("packing", packed)]

# Learned scores, hashing and tokenizers are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, function in STAGES:
        docs = function(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stage(docs)
    return docs
