"""Exact quantiles without gathering a group into one task.

Spark's exact ``percentile`` merges a value->count map per group in a single
task, so a group holding a third of 100 TB would have to fit in one executor.
Here one path serves every size:

1. the input is read once into counts per (group, value), collapsed before the
   shuffle, and written;
2. a running sum over the counts in the global (group, value) order gives each
   value the range of ranks it covers; the order is range-partitioned, so a
   large group is cut by value over many tasks;
3. one row per group (its first rank and its row count) is written and joined
   back; as a written table its size is known, so the planner broadcasts it
   below its threshold and otherwise joins by shuffle;
4. the values that cover the wanted ranks are picked by a partial aggregate.

Without groups there is a shorter way to the same values. The column is
written once, narrow; a sketch of it brackets the wanted ranks; a counting
pass says how many values lie below, at and between the bracket's ends, so the
ranks are known to lie inside whatever the sketch's error; and the search goes
on inside until few enough values are left to sort in one row. Every round
leaves about a hundredth of the values, and no value is moved by a shuffle.

Interpolation is linear between the values at ranks ``floor(p*(n-1))`` and
``ceil(p*(n-1))``, as in pandas, DuckDB and Spark.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from .ordered import global_running_sum

_X = "__qx"
LEFT = 1 << 16     # values that one row may hold when they are sorted: 512 KB
_HALF_WIDTH = 0.005


def finite(value: str) -> Column:
    """The column as a double, NaN as null."""
    x = F.col(value).cast("double")
    return F.when(~F.isnan(x), x)


def join_groups(left: DataFrame, groups: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Null-safe inner join with a table of one row per group; keeps the left key columns only."""
    if not keys:
        # groups is one row (a global aggregate): a provably one-row broadcast
        return left.crossJoin(F.broadcast(groups))
    right = groups.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    cond = [left[k].eqNullSafe(right[f"__r_{k}"]) for k in keys]
    return left.join(right, cond).drop(*[f"__r_{k}" for k in keys])


def exact_quantiles(df: DataFrame, value: str, probs: Sequence[float],
                    by: Sequence[str] = (), names: Sequence[str] | None = None) -> DataFrame:
    """Exact linear-interpolated quantiles of ``value`` per ``by`` group.

    Returns ``by`` columns plus one double column per probability (default
    names ``q_<index>``). NaN counts as null; groups whose values are all null
    get nulls, and so does an empty table without groups (one row).
    """
    keys = list(by)
    names = list(names) if names else [f"q_{i}" for i in range(len(probs))]
    if not keys:
        return _one_group(df, value, probs, names)
    counts = cut_lineage(df.select(*keys, finite(value).alias(_X))
                         .groupBy(*keys, _X).agg(F.count(_X).alias("__c")))
    ranked = global_running_sum(counts, [*[F.col(k) for k in keys], F.col(_X)], ["__c"])
    first = F.col("cum___c") - F.col("__c")
    groups = cut_lineage(ranked.groupBy(*keys).agg(F.min(first).alias("__first"), F.sum("__c").alias("__n")))
    joined = join_groups(ranked, groups, keys)
    at, end = first - F.col("__first"), F.col("cum___c") - F.col("__first")
    picks, out = [], []
    for i, p in enumerate(probs):
        pos = F.lit(float(p)) * (F.col("__n") - 1)
        for side, r in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            picks.append(F.max(F.when((at <= r) & (r < end), F.col(_X))).alias(f"__{side}_{i}"))
        lo, hi, frac = F.col(f"__lo_{i}"), F.col(f"__hi_{i}"), pos - F.floor(pos)
        out.append(F.when(frac == 0, lo).otherwise(lo + (hi - lo) * frac).alias(names[i]))
    return joined.groupBy(*keys).agg(*picks, F.max("__n").alias("__n")).select(*keys, *out)


def _one_group(df: DataFrame, value: str, probs: Sequence[float], names: Sequence[str]) -> DataFrame:
    values = cut_lineage(df.select(finite(value).alias(_X)).where(F.col(_X).isNotNull()))
    n = values.count()
    at = [p * (n - 1) for p in probs]
    found = values_at(values, n, {r for pos in at for r in (math.floor(pos), math.ceil(pos))}) if n else {}
    row = []
    for pos in at if n else []:
        lo, hi, frac = found[math.floor(pos)], found[math.ceil(pos)], pos - math.floor(pos)
        row.append(lo if frac == 0 else lo + (hi - lo) * frac)
    schema = T.StructType([T.StructField(c, T.DoubleType()) for c in names])
    return df.sparkSession.createDataFrame([tuple(row) or (None,) * len(names)], schema)


def values_at(values: DataFrame, n: int, ranks: set[int], left: int = LEFT) -> dict[int, float]:
    """The values at 0-based ``ranks`` of the ``n`` rows of a one-column frame without nulls."""
    if not ranks:
        return {}
    x = F.col(values.columns[0])
    if n <= left:
        ordered = F.sort_array(F.collect_list(x))
        row = values.agg(ordered.alias("o")).select(*[F.get("o", F.lit(r)).alias(str(r)) for r in ranks]).first()
        return {r: row[str(r)] for r in ranks}
    found = {}
    todo = sorted(ranks)
    # ranks far apart are searched one after the other; neighbours (floor and ceil) together
    near = {r for r in todo if r - todo[0] <= n * _HALF_WIDTH}
    found.update(values_at(values, n, ranks - near, left))
    ends = [max(0.0, todo[0] / n - _HALF_WIDTH), min(1.0, max(near) / n + _HALF_WIDTH)]
    sketch = values.agg(F.kll_sketch_agg_double(x, 4096).alias("s"))
    lo, hi = sketch.select(*[F.kll_sketch_get_quantile_double("s", F.lit(p)) for p in ends]).first()
    parts = [(x < lo, None), (x == lo, lo), ((x > lo) & (x < hi), None), ((x == hi) & (hi > lo), hi), (x > hi, None)]
    counts = values.agg(*[F.count(F.when(cond, 1)) for cond, _ in parts]).first()
    before = 0
    for (cond, single), c in zip(parts, counts):
        inside = {r for r in near if before <= r < before + c}
        if single is not None:
            found.update({r: single for r in inside})
        elif inside:
            got = values_at(values.where(cond), c, {r - before for r in inside}, left)
            found.update({r + before: v for r, v in got.items()})
        before += c
    return found


def exact_median(df: DataFrame, value: str, by: Sequence[str] = (), name: str = "median") -> DataFrame:
    return exact_quantiles(df, value, [0.5], by, [name])
