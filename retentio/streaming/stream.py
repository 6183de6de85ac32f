"""Structured Streaming forms of scoring, activity, live KPIs and upsert (STR1-4).

* Scoring (STR1) is stateless: each micro-batch is transformed by the fitted
  models and written by ``foreachBatch`` into ``<sink>/batch=<id>`` with
  overwrite, so a replayed batch (after a failure) rewrites the same folder:
  exactly-once output on plain files.
* Activity (STR2) is a tumbling event-time window with a watermark, run in
  update mode: windows behind the watermark leave the state, and rows later
  than it are dropped; ``late`` keeps those rows. Each batch writes the windows it changed; the last
  state of a window counts. The same function runs on a batch DataFrame.
* Live KPIs (STR3) are a small grouped state (one row a tier), written whole
  on every batch.
* Continuous upsert (STR4) merges each batch into a hash-bucketed table
  (``operators.bucketed``), of which only the touched buckets are rewritten.

All folders live under the session's shared checkpoint directory.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import risk_tier
from ..operators.bucketed import BucketedTable
from ..session import checkpoint_dir
from ..sources.prediction_log import PredictionLog


def run_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder for one streaming run under the shared checkpoint dir."""
    return os.path.join(checkpoint_dir(spark), "streams", f"{name}-{uuid.uuid4().hex[:12]}")


def stage_files(df: DataFrame, path: str, files: int | None = None) -> str:
    """Write ``df`` as Parquet files (its own partitions unless ``files`` is given) to act as an arriving file stream."""
    (df.repartition(files) if files else df).write.mode("overwrite").parquet(path)
    return path


def file_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 64) -> DataFrame:
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
            .parquet(path))


def _run(writer, name: str):
    q = writer.trigger(availableNow=True).queryName(name).start()
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    return q


def exact_avg(col: str):
    """Mean over a fixed-point cast: the sum is exact, so the result does not
    depend on how rows were split into partitions or micro-batches."""
    return F.avg(F.col(col).cast("decimal(20,12)")).cast("double")


def activity(df: DataFrame, ts: str = "predicted_at", window: str = "1 day",
             tier_col: str = "churn_risk_tier", watermark: str | None = "1 hour") -> DataFrame:
    """STR2: predictions per tumbling window and tier (batch or stream)."""
    if tier_col not in df.columns:
        df = df.withColumn(tier_col, risk_tier("churn_probability"))
    t = df.withColumn("__ts", F.col(ts).cast("timestamp"))
    if watermark and df.isStreaming:
        t = t.withWatermark("__ts", watermark)
    return (t.groupBy(F.window("__ts", window).alias("w"), tier_col)
            .agg(F.count(F.lit(1)).alias("predictions"), exact_avg("churn_probability").alias("avg_probability")))


def tier_kpis(df: DataFrame, tier_col: str = "churn_risk_tier") -> DataFrame:
    """STR3: live per-tier KPIs (the log view kept current)."""
    if tier_col not in df.columns:
        df = df.withColumn(tier_col, risk_tier("churn_probability"))
    return df.groupBy(tier_col).agg(F.count(F.lit(1)).alias("customers"),
                                    exact_avg("ltv_prediction").alias("avg_ltv"),
                                    exact_avg("churn_probability").alias("avg_churn_probability"))


def score_stream(stream: DataFrame, score_fn, sink: str | PredictionLog, checkpoint: str,
                 model_version: str = "2.0.0", name: str = "score_stream") -> str | PredictionLog:
    """STR1: score arriving rows and append them, idempotent by batch id, to a folder or to the prediction log with its ids."""
    def write_batch(batch: DataFrame, batch_id: int) -> None:
        if isinstance(sink, PredictionLog):
            sink.append(score_fn(batch), model_version, feed=name, batch=batch_id)
            return
        scored = (score_fn(batch).withColumn("model_version", F.lit(model_version))
                  .withColumn("predicted_at", F.current_timestamp())
                  .withColumn("batch_id", F.lit(batch_id)))
        scored.write.mode("overwrite").parquet(os.path.join(sink, f"batch={batch_id}"))

    _run(stream.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint), name)
    return sink


def aggregate_stream(stream_agg: DataFrame, sink: str, checkpoint: str, name: str) -> str:
    """Run a grouped streaming aggregate in complete mode; each batch rewrites the (small) result."""
    def write_batch(batch: DataFrame, batch_id: int) -> None:
        write_version(batch.sparkSession, batch, sink, batch_id)

    _run(stream_agg.writeStream.outputMode("complete").foreachBatch(write_batch)
         .option("checkpointLocation", checkpoint), name)
    return sink


def window_stream(windows: DataFrame, sink: str, checkpoint: str, name: str) -> str:
    """Run a watermarked aggregate in update mode; a replayed batch overwrites its own windows."""
    def write_batch(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(os.path.join(sink, f"epoch={batch_id}"))

    _run(windows.writeStream.outputMode("update").foreachBatch(write_batch)
         .option("checkpointLocation", checkpoint), name)
    return sink


def latest_windows(spark: SparkSession, sink: str, keys: tuple[str, ...] = ("w", "churn_risk_tier")) -> DataFrame:
    """The last state of every window that ``window_stream`` wrote."""
    told = spark.read.parquet(sink)
    values = [c for c in told.columns if c not in (*keys, "epoch")]
    last = told.groupBy(*keys).agg(F.max_by(F.struct(*values), "epoch").alias("last"))
    return last.select(*keys, "last.*")


def _version_path(table: str, version: int) -> str:
    return os.path.join(table, f"v={version:012d}")


def write_version(spark: SparkSession, df: DataFrame, table: str, version: int) -> None:
    """Write a table version, then name it in ``_latest``; earlier names stay, so a crash never leaves none."""
    df.write.mode("overwrite").parquet(_version_path(table, version))
    spark.createDataFrame([(version,)], "version long").coalesce(1).write.mode("append") \
        .json(os.path.join(table, "_latest"))


def latest_version(spark: SparkSession, table: str) -> DataFrame:
    """Read the newest version that was named (works on any shared filesystem)."""
    v = spark.read.schema("version long").json(os.path.join(table, "_latest")).agg(F.max("version")).first()[0]
    return spark.read.parquet(_version_path(table, v))


def upsert_stream(spark: SparkSession, stream: DataFrame, table: BucketedTable, checkpoint: str,
                  keep_first=(), name: str = "upsert_stream") -> BucketedTable:
    """STR4: each batch merges into the buckets it touches; a replayed batch finds its number applied."""
    def write_batch(batch: DataFrame, batch_id: int) -> None:
        table.upsert(batch, keep_first=keep_first, feed=name, batch=batch_id)

    _run(stream.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint), name)
    return table
