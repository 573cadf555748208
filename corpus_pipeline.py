"""A corpus pipeline of five operators: quality, exact copies, near copies, mix of sources, packing.

Null texts count as empty in each stage, repeated rows are copies of each other, columns beyond those that a stage reads pass
through whatever their names, and an empty table gives no pieces. Each stage docstring says which row of several stays.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelloom.llm import exact_dedup, mixing, near_dedup, packing, quality
from panelloom.llm.common import P, remove, shared_root
from panelloom.llm.queries import quality_model

#: A document stays where its score of quality is at least this.
LEAST_QUALITY = 0.3


def by_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier takes for good; the model is fitted on labelled documents of docs."""
    scored = quality.score(docs, quality_model(spark, docs, sf_dir), score_col=f"{P}score")
    return scored.filter(F.col(f"{P}score") >= LEAST_QUALITY).select(*docs.columns)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest doc_id; null ids lose."""
    return exact_dedup.drop_copies(docs, keep="largest")


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document with the smallest doc_id; null ids lose."""
    return near_dedup.drop_near(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources ask for; a null source is a source."""
    return mixing.emit(mixing.mix(docs, prefix=P), docs.columns, f"{P}copies")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality", by_quality),
    ("exact_dedup", without_copies),
    ("near_dedup", without_near_copies),
    ("mixing", mixed),
    ("packing", packed),
]

#: The stages need a fitted model, signatures and a tokenizer: no SQL gives run()'s rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table of documents; each is written as Parquet and read again, and goes when the next is there."""
    root = f"{shared_root(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        path = f"{root}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        if i:
            remove(spark, f"{root}/{i - 1}-{STAGES[i - 1][0]}")
        docs = spark.read.parquet(path)
    return docs
