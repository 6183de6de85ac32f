"""Rows that come too late for a watermark, and the windows they belong to (STR2).

Spark drops a row whose window lies behind the watermark. Here a first stream
parts the arriving rows before they are aggregated: a row is late if its window
ended at or before the largest event time of all earlier batches less the
allowed delay. That is at least as strict as the aggregation's own watermark,
so the rows passed on as in time are never dropped, and the others are kept in
a table of their own. A batch's verdict depends on the marks of earlier batches
alone, each written under its batch number, so a replay gives the same rows.

``corrected`` then recomputes the windows that late rows hit, from all of their
rows; the other windows are the stream's.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import path_exists


def delayed(log: DataFrame, ts: str, key: str, slices: int, late_by: int, share: int) -> DataFrame:
    """``log`` with ``arrival``: the slice of event time in which a row comes; one in ``share`` comes ``late_by`` slices later."""
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    first, last = log.agg(F.min(at), F.max(at)).first()
    width = ((last - first) // slices + 1) if first is not None else 1
    on_time = F.floor((at - F.lit(first or 0)) / width).cast("int")
    slow = F.pmod(F.xxhash64(F.col(key)), F.lit(share)) == 0
    return log.withColumn("arrival", F.least(on_time + F.when(slow, late_by).otherwise(0), F.lit(slices - 1)))


def arrive(log: DataFrame, path: str, slices: int) -> None:
    """Write the slices one after the other, as files that arrive in this order."""
    for k in range(slices):
        log.where(F.col("arrival") == k).drop("arrival").coalesce(1).write.mode("append").parquet(path)


def _window_end(ts: str, window: str) -> Column:
    return F.window(F.col(ts).cast("timestamp"), window)["end"]


def split_late(spark: SparkSession, source: str, schema, sink: str, checkpoint: str, ts: str, window: str, delay: str,
               files_per_trigger: int = 1, name: str = "split_late") -> None:
    """Write each batch of the files in ``source`` to ``sink/batch=k/late=0`` (in time) and ``late=1``."""
    marks = os.path.join(checkpoint, "marks")

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        at = os.path.join(marks, f"batch={batch_id}")
        before = os.path.join(marks, f"batch={batch_id - 1}")
        mark = spark.read.schema("mark timestamp").json(before).first()[0] if path_exists(spark, before) else None
        limit = F.lit(mark).cast("timestamp") - F.expr(f"INTERVAL {delay}")
        late = F.coalesce(_window_end(ts, window) <= limit, F.lit(False)).cast("int")
        batch.withColumn("late", late).write.mode("overwrite").partitionBy("late").parquet(os.path.join(sink, f"batch={batch_id}"))
        top = batch.agg(F.max(F.col(ts).cast("timestamp")).alias("mark")).select(F.greatest("mark", F.lit(mark).cast("timestamp")).alias("mark"))
        top.coalesce(1).write.mode("overwrite").json(at)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(source)
    query = (stream.writeStream.foreachBatch(write_batch).option("checkpointLocation", os.path.join(checkpoint, "stream"))
             .trigger(availableNow=True).queryName(name).start())
    query.awaitTermination()


def corrected(windows: DataFrame, rows: str, schema, aggregate: Callable[[DataFrame], DataFrame], ts: str, window: str) -> DataFrame:
    """The stream's ``windows`` (column w), those hit by late rows replaced by a recompute over all of their rows."""
    placed = T.StructType([*schema.fields, T.StructField("batch", T.IntegerType()), T.StructField("late", T.IntegerType())])
    told = windows.sparkSession.read.schema(placed).parquet(rows)
    told = told.withColumn("__end", _window_end(ts, window))
    hit = told.where("late = 1").select("__end").distinct()
    again = aggregate(told.join(hit, "__end", "left_semi").drop("__end", "batch", "late"))
    left = windows.join(hit, windows["w.end"] == hit["__end"], "left_anti")
    return left.select(*again.columns).unionByName(again)
