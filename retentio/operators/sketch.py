"""Mergeable quantile sketches beside the exact path (CLN3 at scale).

A KLL sketch a day is a few kilobytes, whatever the day holds. New days add
their own, a rerun day replaces its own, and quantiles over any span of days
come from merging these instead of reading the rows. The rank error is that of
one sketch over all rows: below ``RANK_ERROR`` for the default size (measured
in the tests; the exact path is ``quantile.exact_quantiles``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .quantile import finite

SIZE = 4096
RANK_ERROR = 0.005


def sketches(df: DataFrame, value: str, by: Sequence[str], size: int = SIZE) -> DataFrame:
    """One row per group: the count and the sketch of its values (null and NaN left out; no value: null sketch).

    Tasks sketch what they hold before the shuffle, so a group with a third of the rows moves as one sketch a task.
    """
    x = finite(value)
    return df.groupBy(*by).agg(F.count(x).alias("n"), F.kll_sketch_agg_double(x, size).alias("sketch")).select(
        *by, "n", F.when(F.col("n") > 0, F.col("sketch")).alias("sketch"))


def merged_quantiles(stored: DataFrame, probs: Sequence[float], by: Sequence[str] = (),
                     names: Sequence[str] | None = None) -> DataFrame:
    """Quantiles over the union of stored sketches, per ``by`` group, with ``n``; nulls where there is no value."""
    names = list(names) if names else [f"q_{i}" for i in range(len(probs))]
    merged = stored.groupBy(*by).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.kll_merge_agg_double("sketch").alias("sk"))
    at = [F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("sk", F.lit(float(p)))).alias(name)
          for p, name in zip(probs, names)]
    return merged.select(*by, "n", *at)


class SketchStore:
    """Sketches by day in a table partitioned by it; writing a day again replaces it."""

    def __init__(self, spark: SparkSession, path: str, day: str = "day"):
        self.spark, self.path, self.day = spark, path, day

    def write(self, rows: DataFrame, value: str) -> None:
        # bounded: one sketch a day; the days of a run are spread over tasks by the shuffle
        (sketches(rows, value, [self.day]).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy(self.day).parquet(self.path))

    def read(self, first=None, last=None) -> DataFrame:
        """Sketches of the days from ``first`` to ``last``; other partitions are not read."""
        stored = self.spark.read.parquet(self.path)
        if first is not None:
            stored = stored.where(F.col(self.day) >= first)
        return stored if last is None else stored.where(F.col(self.day) <= last)

    def quantiles(self, probs: Sequence[float], first=None, last=None, names: Sequence[str] | None = None) -> DataFrame:
        return merged_quantiles(self.read(first, last), probs, (), names)
