"""Reproducible splits and samples (SPL1, SMP1, JN1).

The split key is a seeded md5 of the row id, so membership depends only on
the id: independent of partitioning, file layout and engine (the same
expression runs in DuckDB). ``exact=True`` keeps exactly round(0.8 n) train
rows, ``stratify`` the same per class: the cut-off (hash, id) of each class is
found by counting hash heads on a narrow projection, and every row is compared
with its class's cut-off, so the table itself is not moved. Rows that share an
id go to the same side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def hash_key(id_col: str, seed: int = 42) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))


def _threshold(fraction: float) -> str:
    return format(int(fraction * 2 ** 32), "08x")


def assign_split(df: DataFrame, id_col: str, test_size: float = 0.2, seed: int = 42,
                 exact: bool = False, stratify: str | None = None, name: str = "split") -> DataFrame:
    """Add ``split`` = 'train' / 'test'."""
    if not exact and stratify is None:
        is_test = F.substring(hash_key(id_col, seed), 1, 8) < F.lit(_threshold(test_size))
        return df.withColumn(name, F.when(is_test, "test").otherwise("train"))
    group = F.lit("all") if stratify is None else F.coalesce(F.concat(F.lit("v"), F.col(stratify).cast("string")), F.lit("null"))
    keyed = df.withColumns({"__g": group, "__h": F.coalesce(hash_key(id_col, seed), F.lit(""))})
    cuts = _cutoffs(keyed.select("__g", "__h", F.col(id_col).alias("__id")), 1 - test_size)
    # one row in all; per class, the planner knows the size of the written table
    cuts = F.broadcast(cuts) if stratify is None else cuts
    before = (F.col("__h") < F.col("__ch")) | ((F.col("__h") == F.col("__ch"))
                                               & (F.col(id_col).isNull() | (F.col(id_col) <= F.col("__cid"))))
    out = keyed.join(cuts, "__g", "left").withColumn(name, F.when(F.coalesce(before, F.lit(False)), "train").otherwise("test"))
    return out.select(*[c for c in df.columns if c != name], name)


def _cutoffs(keyed: DataFrame, share: float) -> DataFrame:
    """(__g, __ch, __cid): hash and id of the last train row of each class; a class without train rows has no row."""
    narrow = cut_lineage(keyed)
    head = F.substring("__h", 1, 4)
    # at most 65,536 heads a class
    counts = narrow.groupBy("__g", head.alias("__head")).agg(F.count(F.lit(1)).alias("__n"))
    heads = Window.partitionBy("__g")
    marked = counts.withColumns({
        "__upto": F.sum("__n").over(heads.orderBy("__head").rowsBetween(Window.unboundedPreceding, 0)),
        "__want": F.bround(F.lit(share) * F.sum("__n").over(heads), 0).cast("long")})  # half-even, as the reference rounds
    edge = marked.where("__upto >= __want AND __upto - __n < __want").select(
        "__g", "__head", (F.col("__want") - F.col("__upto") + F.col("__n")).alias("__left"))
    # the rows under one head: a 65,536th of the class
    inside = narrow.withColumn("__head", head).join(edge, ["__g", "__head"])
    place = F.row_number().over(Window.partitionBy("__g").orderBy("__h", "__id"))
    return cut_lineage(inside.withColumn("__place", place).where("__place = __left").select(
        "__g", F.col("__h").alias("__ch"), F.col("__id").alias("__cid")))


def train_test(df: DataFrame, id_col: str, **kw) -> tuple[DataFrame, DataFrame]:
    s = assign_split(df, id_col, **kw)
    return (s.where(F.col("split") == "train").drop("split"),
            s.where(F.col("split") == "test").drop("split"))


def complement(df: DataFrame, subset: DataFrame, id_col: str) -> DataFrame:
    """JN1: rows of ``df`` not in ``subset`` (anti-join on the id)."""
    return df.join(subset.select(id_col), id_col, "left_anti")


def sample_k(df: DataFrame, id_col: str, k: int, seed: int = 42) -> DataFrame:
    """SMP1: deterministic min(n, k) sample: the k smallest seeded hashes.

    The limit is the feature here; each task keeps its own top k before the
    final merge (k rows per task), so no task sees more than k * tasks rows.
    """
    return df.orderBy(hash_key(id_col, seed), F.col(id_col)).limit(k)
