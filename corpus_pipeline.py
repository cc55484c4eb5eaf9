"""The corpus pipeline: each stage works on all that the one before kept; between stages, documents are written and read again.

Stages: quality classifier (rejected documents go), SimHash near-duplicates (one document of a group stays), benchmark
decontamination (contaminated documents go), PII (spans become tags), mixing (the mixed corpus: each document with the text that the mix takes
of it, repeats counted, and how much that is). A stage's folder goes when the next stage is written.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm import decontam, mixing, pii, quality, simhash
from tesserae.llm.common import table
from tesserae.session import ensure_checkpoint_dir


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a quality score of THRESHOLD or more."""
    return quality.accepted(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.deduplicated(docs)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.without(docs, table(spark, sf_dir, "benchmark"))


def counted(docs: DataFrame) -> DataFrame:
    """n_chars as the text has it now."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with tags for personal data; n_chars follows."""
    return counted(pii.redacted(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed corpus, a row a document."""
    return counted(mixing.mixed(docs))


STAGES = [
    ("quality", keep_good),
    ("simhash", keep_one),
    ("decontamination", keep_uncontaminated),
    ("pii", hide_personal_data),
    ("mixing", mix_sources),
]

ORACLE_SQL = None  # trees, fingerprints and checksums aren't SQL; tests/llm/test_pipeline.py holds the rows against plain code


def removed(spark: SparkSession, path: str) -> None:
    """By Hadoop's file systems, as the folder may be on any store."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = f"{folder}/{k}-{name}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
            if k:
                removed(spark, f"{folder}/{k - 1}-{STAGES[k - 1][0]}")
    return docs
