"""A training corpus from raw documents: quality, near duplicates, repeated passages, source mix, tokens."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from siltflow.llm import jaccard, mixing, quality, suffixes, tokens
from siltflow.llm.common import ensure_checkpoint_dir, table
from siltflow.llm.queries import pre_token_pattern, vocabulary


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled classifier doesn't reject."""
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a Jaccard similarity of at least 0.8 of their five-word shingles."""
    return jaccard.keep_one(docs, k=5, pct=80)


def repeated_passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 250 bytes, about fifty short words, that occur more than once in the corpus."""
    return suffixes.strip_repeats(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per time that the mix takes a document."""
    return mixing.mixed_documents(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the mixed documents."""
    return tokens.encode_decode(docs, vocabulary("byte_bpe_multi_50k.tiktoken"), pre_token_pattern(), keep_ids=True)


STAGES = [
    ("quality", quality_stage),
    ("near duplicates", near_duplicate_stage),
    ("repeated passages", repeated_passage_stage),
    ("mixing", mixing_stage),
    ("tokens", token_stage),
]

#: The classifier, the tokens and the mix have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; each result but the last is a Parquet table in the shared folder, dropped after its use."""
    ensure_checkpoint_dir(spark)
    base = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{i}")
        docs = spark.read.parquet(f"{base}/{i}")
        if i:
            old = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/{i - 1}")
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
    return docs
