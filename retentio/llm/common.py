"""Small helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: rows and bytes of one Arrow batch: documents may be megabytes long
BATCH_ROWS, BATCH_BYTES = 2048, 4 << 20


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches that reach Python, so long documents cannot fill a worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
