"""Corpus pipeline: classify, deduplicate, decontaminate, mix and encode the documents table.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. All but the last return the
columns of docs; the last returns what the token file holds of each document, in the order of the mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.llm import dac, mixing, quality, simhash, tiling
from tramline.llm.common import id_remainder, new_path, table


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the positive-unlabelled classifier rejects."""
    model = quality.train(docs, table(spark, sf_dir, "labels"), may_learn=id_remainder(3) != 1)
    return quality.keep_good(docs, model)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each SimHash component."""
    return simhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    return tiling.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts all documents into the order of the source mix; files and rows follow it."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token file in the order in which docs are stored, and reads it back.

    docs must be read from files, as they are between stages: their order is that of files and rows. Nulls and repeated
    rows are encoded where they stand; a null text has the end id alone.
    """
    import public_tokenizers

    path = new_path(spark, "tokens")
    stored_at = (F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("long"), F.col("_metadata.file_name"), F.col("_metadata.row_index"))
    dac.write_tokens(docs, path, public_tokenizers.path("byte_bpe_50k.json"), order=stored_at)
    return dac.read_documents(spark, path)


STAGES = [("quality classifier", classify), ("SimHash near-dedup", deduplicate), ("benchmark decontamination", decontaminate), ("mixing to target weights", mix), ("token codes", encode)]

#: SQL can express neither the classifier nor the fingerprints; tests/llm/test_pipeline.py checks every stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each result but the last is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = new_path(spark, "pipeline-" + name.split()[0].lower())
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.schema(docs.schema).parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
