"""Prefix sums and row numbers over a global order, without a one-task window.

``Window.orderBy`` with no partition moves every row into a single task. The
two-pass form used here range-partitions the rows on the order key, takes a
running sum inside each partition (sorted, one pass in ``mapInPandas``),
sums each partition, turns those per-partition totals (one row per
partition: a fixed, proven bound) into offsets and adds them back.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage

_PID = "__pid"


def global_running_sum(df: DataFrame, order: Sequence[Column], sums: Sequence[str],
                       prefix: str = "cum_", partitions: int | None = None) -> DataFrame:
    """Add inclusive running sums ``cum_<c>`` of ``sums`` in the global ``order``.

    ``order`` must be a total order (ties broken by the caller) for the sums to
    be deterministic.
    """
    # without an explicit count, AQE sizes the ranges by their bytes
    ranged = (df.repartitionByRange(*([partitions] if partitions else []), *order)
              .sortWithinPartitions(*order)
              .withColumn(_PID, F.spark_partition_id()))
    out_names = [f"{prefix}{c}" for c in sums]
    schema = T.StructType(ranged.schema.fields + [
        T.StructField(n, T.DoubleType()) for n in out_names])

    def running(batches):
        carry = None
        for pdf in batches:
            if pdf.empty:
                continue
            part = pdf[list(sums)].astype("float64").cumsum()
            if carry is not None:
                part = part + carry
            carry = part.iloc[-1]
            for src, dst in zip(sums, out_names):
                pdf[dst] = part[src].to_numpy()
            yield pdf

    local = cut_lineage(ranged.mapInPandas(running, schema))
    totals = local.groupBy(_PID).agg(*[F.sum(c).alias(f"__t_{c}") for c in sums])
    w = Window.orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(_PID, *[F.coalesce(F.sum(f"__t_{c}").over(w), F.lit(0.0)).alias(f"__o_{c}")
                                    for c in sums])
    # offsets has one row per range partition (at most spark.sql.shuffle.partitions): bounded, safe to broadcast
    joined = local.join(F.broadcast(offsets), _PID)
    return joined.select(
        *[c for c in df.columns],
        *[(F.col(f"{prefix}{c}") + F.col(f"__o_{c}")).alias(f"{prefix}{c}") for c in sums])


def global_row_number(df: DataFrame, order: Sequence[Column], name: str = "row_number",
                      partitions: int | None = None) -> DataFrame:
    """1-based position of each row in the global ``order`` (a total order)."""
    ones = df.withColumn("__one", F.lit(1))
    res = global_running_sum(ones, order, ["__one"], prefix="cum", partitions=partitions)
    return res.select(*df.columns, F.col("cum__one").cast("long").alias(name))

