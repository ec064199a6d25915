"""Raw documents to training data: a chain of stages, each written as Parquet and read again.

Each stage takes (spark, docs, sf_dir), works on every row that the stage before kept, and returns
a frame. All but the last return the columns of `documents`.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from recordloom.llm import blob_ledger, mixing, near_dedup, ordinal, trie_bpe
from recordloom.llm.common import prepare
from recordloom.session import shared_dir, tune

VOCABULARY = "byte_bpe_50k.json"


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose probability of the best grade is under one half."""
    return ordinal.select_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies, linked from Jaccard similarity 0.8 on.

    The 0.85 of near_dedup is that of op4's contract; a pair at 0.8 misses all 32 bands with probability 6e-5.
    """
    return near_dedup.one_of_each(docs, percent=80)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask every secret found; texts without one stay as they are."""
    return blob_ledger.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix of sources draws them."""
    return mixing.mix_documents(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, ids, n_tokens, and whether decoding gives the text back."""
    path = public_tokenizers.path(VOCABULARY)
    coded = trie_bpe.decode(trie_bpe.encode(docs, path, ("doc_id", "source", "text")), path)
    return coded.select("doc_id", "source", "ids", F.size("ids").cast("long").alias("n_tokens"),
                        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("decodes"))


STAGES = [("quality", good_quality), ("near_copies", without_near_copies), ("secrets", without_secrets),
          ("mixing", mixed), ("encoding", encoded)]
#: The classifier is fitted and encoding follows a vocabulary: SQL cannot say either.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    prepare(tune(spark))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
