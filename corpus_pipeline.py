"""The corpus pipeline: quality filter, exact dedup, near-dedup, PII redaction, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read back as the next stage's documents.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from retentio.llm import exact_dedup, packing, pii, quality, simhash
from retentio.llm.queries import tokenizer
from retentio.session import checkpoint_dir
from retentio.sources.tables import table

#: packing runs beside the memory that an executor's JVM keeps from the stages before it, so its workers take less
PACK_CACHE, PACK_SLICE = 10 << 20, 1 << 20


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.with_scores(docs, model).where("predicted = 1").select(*docs.columns)


def dedup_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays: the longest, then the smallest doc_id."""
    return exact_dedup.keep_first(docs)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked SimHash fingerprints stays: the smallest doc_id."""
    return simhash.one_per_group(docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced by marks; n_chars follows the text."""
    found = pii.redacted(docs, pii.fit(docs))
    return found.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Power-of-two pieces of every document that is left."""
    return packing.pack(docs, tokenizer("word_bpe_49k.json"), cache_bytes=PACK_CACHE, slice_chars=PACK_SLICE)


STAGES = [("quality", filter_quality), ("exact_dedup", dedup_exact), ("near_dedup", dedup_near),
          ("pii", redact), ("packing", pack)]

#: BPE pieces and trained scores are beyond SQL; tests compare run() with a plain chain of the stages
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = os.path.join(checkpoint_dir(spark), "pipeline", uuid.uuid4().hex)
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        path = os.path.join(folder, f"{k}_{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
