"""Sharding by extendible hashing: a directory of hash prefixes in which only oversized buckets split on another bit.

A row's bits are 60 bits of md5 of its id and, for rows that these cannot part
(repeated ids), 60 bits of md5 of its place in the written key table. A bucket
is a prefix; it splits while its bytes exceed the limit and it has more than
one row. One round counts bytes for ``step`` further bits at once, by one
aggregation of the rows (partial sums first), and takes for each cell the
shortest prefix that fits: the same directory as splitting bit by bit. Only
cells that still exceed the limit go on to the next round.

Defined results: null text counts 0 bytes, a null id hashes as the empty
string; a single row above the limit is a shard of its own; repeated rows
spread over shards by place; kept columns may have any names; an empty table
gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import text_or_empty

LIMIT, MORE_BITS = 2 << 20, 8


def _bits(value: Column) -> Column:
    return F.lpad(F.conv(F.substring(F.md5(value.cast("binary")), 1, 15), 16, 2), 60, "0")


def directory_round(rows: DataFrame, start: int, stop: int, limit: int) -> DataFrame:
    """cell (prefix of ``stop`` bits) -> depth, shard_bytes, shard_docs of its shard; depth null: still oversized."""
    cells = rows.groupBy(F.substring("bits", 1, stop).alias("cell")).agg(F.sum("n_bytes").alias("b"), F.count("*").alias("n"))
    prefixes = cells.select("cell", "b", "n", F.explode(F.sequence(F.lit(start), F.lit(stop))).alias("depth"))
    prefixes = prefixes.withColumn("prefix", F.expr("substring(cell, 1, depth)"))
    fits = (prefixes.groupBy("depth", "prefix").agg(F.sum("b").alias("shard_bytes"), F.sum("n").alias("shard_docs"))
            .where((F.col("shard_bytes") <= limit) | (F.col("shard_docs") == 1)))
    first = (prefixes.select("cell", "depth", "prefix").join(fits, ["depth", "prefix"], "left")
             .groupBy("cell").agg(F.min(F.when(F.col("shard_bytes").isNotNull(), F.struct("depth", "shard_bytes", "shard_docs"))).alias("s")))
    return first.select("cell", "s.*")


def assign(docs: DataFrame, limit: int = LIMIT, keep: tuple[str, ...] = ("doc_id",),
           doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The kept columns with n_bytes, shard_id (the hash prefix), depth, shard_bytes, shard_docs."""
    key = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    keyed = cut_lineage(docs.select(F.struct(*keep).alias("row"), F.octet_length(text_or_empty(text)).cast("long").alias("n_bytes"),
                                    F.concat(_bits(key), _bits(F.monotonically_increasing_id().cast("string"))).alias("bits")))
    total = keyed.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    start, rows, done = 0, keyed, []
    stop = max(2, math.ceil(math.log2(max(2, total / limit))) + 3)
    while True:
        found = cut_lineage(directory_round(rows, start, min(stop, 120), limit))
        placed = rows.withColumn("cell", F.substring("bits", 1, min(stop, 120))).join(found, "cell")
        done.append(placed.where("depth is not null").select(
            "row.*", "n_bytes", F.expr("substring(bits, 1, depth)").alias("shard_id"), "depth", "shard_bytes", "shard_docs"))
        if stop >= 120 or found.where("depth is null").isEmpty():
            break
        rows = cut_lineage(placed.where("depth is null").select("row", "n_bytes", "bits"))
        start, stop = stop + 1, stop + MORE_BITS
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def write_shards(docs: DataFrame, path: str, limit: int = LIMIT, **options) -> None:
    """One folder per shard."""
    placed = assign(docs, limit, tuple(docs.columns), **options)
    placed.repartition("shard_id").write.mode("errorifexists").partitionBy("shard_id").parquet(path)
