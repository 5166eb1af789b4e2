"""A corpus from raw documents to packed sequences, stage by stage.

Every stage reads what the one before it wrote and works on all of it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from wattframe.llm import lines, mixing, near, packing, quality
from wattframe.llm.common import new_folder, table
from wattframe.session import tune

TOKENIZER = "byte_bpe_50k.json"


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the classifier accepts (7); it learns from the labelled ones that aren't held out."""
    model = quality.train(docs, table(tune(spark), sf_dir, "labels"))
    return quality.score_documents(docs, model).where("predicted = 1").select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that stand earlier, or almost so (10). All documents stay, some with an empty text."""
    tune(spark)
    return lines.dedup_lines(docs).select(*docs.columns)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (9), the one with the smallest id: five-word Jaccard of 0.8 or more.

    Golay codewords of SimHash bits find the candidates, exact similarity decides.
    """
    tune(spark)
    return near.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them (2)."""
    tune(spark)
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences of 1024 tokens (5)."""
    tune(spark)
    return packing.pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("quality", classify_quality),
    ("lines", dedup_lines),
    ("near", dedup_near),
    ("mix", mix_sources),
    ("pack", pack_sequences),
]

#: Hashes, models and tokenizers of the stages are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written as Parquet in the shared folder and read again."""
    docs = table(tune(spark), sf_dir, "documents")
    for name, stage in STAGES:
        path = new_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
