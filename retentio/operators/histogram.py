"""Histograms, binned kernel density and box-plot summaries (HST1-5).

Bins are equal-width over [min, max] (last bin closed, as numpy does). The
edges come from one global min/max aggregate (one row, broadcast), counts from
a grouped count on the bin index: both algebraic, partial-aggregated.

The density estimate is binned: values are first counted into ``fine`` bins
(bounded table), then a Gaussian kernel (Scott bandwidth) is summed from the
bin centres onto a grid of at most 200 points. The grid is a literal array
exploded on the bounded bin table, so the work after the first pass is
constant-size regardless of the data.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .quantile import exact_quantiles, join_groups


def _edges(df: DataFrame, value: str) -> DataFrame:
    return df.agg(F.min(value).cast("double").alias("__min"), F.max(value).cast("double").alias("__max"))


def auto_edges(data: DataFrame, value: str) -> DataFrame:
    """One row: min, max and the larger bin count of the Freedman-Diaconis and Sturges rules.

    The quartiles are exact. Without a spread between them Sturges alone counts, and the count is not capped: far
    outliers give many empty bins, which a histogram leaves out.
    """
    x = data.select(F.col(value).cast("double").alias("__x"))
    q = exact_quantiles(x, "__x", [0.25, 0.75], names=["__q1", "__q3"])
    # both sides are one-row aggregates
    row = x.agg(F.min("__x").alias("__min"), F.max("__x").alias("__max"), F.count("__x").alias("__n")).crossJoin(F.broadcast(q))
    n, iqr = F.col("__n"), F.col("__q3") - F.col("__q1")
    # ceil(log2 n) in whole numbers: the binary digits of n - 1
    sturges = F.when(n > 1, F.length(F.bin(n - 1))).otherwise(0).cast("long") + 1
    spread = (F.col("__max") - F.col("__min")) / (2 * iqr / F.pow(n.cast("double"), F.lit(1.0 / 3)))
    bins = F.greatest(sturges, F.when(iqr > 0, F.ceil(spread)).otherwise(0).cast("long"))
    return row.select("__min", "__max", bins.alias("__bins"))


def bin_index(value: F.Column, lo: F.Column, hi: F.Column, bins: int | F.Column) -> F.Column:
    width = hi - lo
    raw = F.floor((value - lo) / width * bins)
    return F.when(width > 0, F.least(raw, F.lit(bins - 1))).otherwise(F.lit(0)).cast("long")


def histogram(df: DataFrame, value: str, bins: int | None, by: Sequence[str] = ()) -> DataFrame:
    """Counts per equal-width bin over the shared [min, max] of ``value``; ``bins`` None counts them by ``auto_edges``.

    Output: ``by``..., bin, bin_lo, bin_hi, n. Empty bins are omitted.
    """
    # NaN has no bin, like null
    data = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    edges = auto_edges(data, value) if bins is None else _edges(data, value).withColumn("__bins", F.lit(bins))
    # one-row scalar table: provably tiny broadcast
    j = data.select(*by, F.col(value).cast("double").alias("__v")).crossJoin(F.broadcast(edges))
    j = j.withColumn("bin", bin_index(F.col("__v"), F.col("__min"), F.col("__max"), F.col("__bins")))
    counts = j.groupBy(*by, "bin", "__min", "__max", "__bins").agg(F.count(F.lit(1)).alias("n"))
    width = (F.col("__max") - F.col("__min")) / F.col("__bins")
    return counts.select(*by, "bin",
                         (F.col("__min") + F.col("bin") * width).alias("bin_lo"),
                         (F.col("__min") + (F.col("bin") + 1) * width).alias("bin_hi"),
                         "n")


def kde(df: DataFrame, value: str, grid_points: int = 200, fine: int = 1024) -> DataFrame:
    """Binned Gaussian KDE on ``grid_points`` over [min, max]; Scott's bandwidth.

    Output: point, x, density.
    """
    data = df.select(F.col(value).cast("double").alias("__v")).where(F.col("__v").isNotNull() & ~F.isnan("__v"))
    stats = data.agg(F.min("__v").alias("__min"), F.max("__v").alias("__max"),
                     F.count(F.lit(1)).alias("__n"), F.stddev_samp("__v").alias("__sd"))
    j = data.crossJoin(F.broadcast(stats))
    j = j.withColumn("__b", bin_index(F.col("__v"), F.col("__min"), F.col("__max"), fine))
    binned = j.groupBy("__b", "__min", "__max", "__n", "__sd").agg(F.count(F.lit(1)).alias("__c"))
    span = F.col("__max") - F.col("__min")
    centre = F.col("__min") + (F.col("__b") + 0.5) * span / fine
    bw = F.col("__sd") * F.pow(F.col("__n").cast("double"), F.lit(-0.2))
    points = F.explode(F.sequence(F.lit(0), F.lit(grid_points - 1)))
    g = binned.select("__c", "__n", "__min", centre.alias("__ctr"), bw.alias("__bw"), span.alias("__span"),
                      points.alias("point"))
    gx = F.col("__min") + F.col("point") * F.col("__span") / (grid_points - 1)
    # a constant column has no bandwidth and so a null density
    z = F.when(F.col("__bw") > 0, (gx - F.col("__ctr")) / F.col("__bw"))
    contrib = F.col("__c") * F.exp(F.lit(-0.5) * z * z)
    out = g.groupBy("point", "__n", "__bw", "__min", "__span").agg(F.sum(contrib).alias("__s"))
    norm = F.col("__n") * F.col("__bw") * F.lit(math.sqrt(2 * math.pi))
    return out.select("point",
                      (F.col("__min") + F.col("point") * F.col("__span") / (grid_points - 1)).alias("x"),
                      F.when(F.col("__bw") > 0, F.col("__s") / norm).alias("density"))


def box_summary(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Quartiles, IQR, 1.5-IQR whiskers (most extreme points inside) and outlier count."""
    # one narrow copy feeds the quartiles and the whiskers; the quartiles, one row per group, are
    # written too, so that the planner knows their size when it chooses the join
    data = cut_lineage(df.select(*by, F.col(value).cast("double").alias("__v")).where(F.col(value).isNotNull()))
    q = cut_lineage(exact_quantiles(data, "__v", [0.25, 0.5, 0.75], by, ["q1", "median", "q3"]))
    jj = join_groups(data, q, by)
    iqr = F.col("q3") - F.col("q1")
    lo_fence, hi_fence = F.col("q1") - 1.5 * iqr, F.col("q3") + 1.5 * iqr
    res = jj.groupBy(*by, "q1", "median", "q3").agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.when(F.col("__v") >= lo_fence, F.col("__v"))).alias("whisker_lo"),
        F.max(F.when(F.col("__v") <= hi_fence, F.col("__v"))).alias("whisker_hi"),
        F.sum(F.when((F.col("__v") < lo_fence) | (F.col("__v") > hi_fence), 1).otherwise(0))
        .cast("long").alias("outliers"))
    return res.withColumn("iqr", F.col("q3") - F.col("q1"))
