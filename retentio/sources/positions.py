"""CSV rows with their place in the files, and ids made from it (SRC1, PRJ4).

Spark gives a CSV row no number. It does give the file and the block that the
row was read from, and within a task rows come in file order. So the rows are
written once with ``monotonically_increasing_id`` taken right above the scan;
from then on the numbering is data, which retries and other layouts cannot
change. The row count of every block (one narrow row a block) becomes the
block's offset by a range-partitioned running sum, and

    position = rows in the blocks before + place in the block

counts from 0 over all files in the order of their paths, as one reader going
through them would. Blank lines and headers have no position. A quoted line
break ends a record here, as blocks are cut at line ends.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordered import global_running_sum
from ..schemas import RAW_SUBSCRIBER
from ..session import cut_lineage
from .files import read_subscribers_csv

FILE, FILE_ROW, POSITION, CORRUPT = "source_file", "file_row", "position", "_corrupt_record"
_BLOCK, _PLACE = "block__", "place__"


def read_placed_csv(spark: SparkSession, path: str, schema=RAW_SUBSCRIBER) -> DataFrame:
    """CSV rows with ``source_file``, ``file_row`` (0-based in the file) and ``position`` (0-based over all files)."""
    rows = cut_lineage(read_subscribers_csv(spark, path, schema).select(
        "*", F.col("_metadata.file_path").alias(FILE), F.col("_metadata.file_block_start").alias(_BLOCK),
        F.monotonically_increasing_id().alias(_PLACE)))
    blocks = cut_lineage(rows.groupBy(FILE, _BLOCK).agg(F.min(_PLACE).alias("first__"), F.count(F.lit(1)).alias("n__")))
    blocks = cut_lineage(global_running_sum(blocks, [F.col(FILE), F.col(_BLOCK)], ["n__"])
                         .withColumn("before__", F.col("cum_n__").cast("long") - F.col("n__"))
                         .select(FILE, _BLOCK, "first__", "before__"))
    files = blocks.groupBy(FILE).agg(F.min("before__").alias("file_start__"))
    # one row a block, written: the planner knows its size and broadcasts it or joins by shuffle
    placed = rows.join(blocks.join(files, FILE), [FILE, _BLOCK])
    position = F.col("before__") + F.col(_PLACE) - F.col("first__")
    return placed.select(*[c for c in rows.columns if c not in (FILE, _BLOCK, _PLACE)], FILE,
                         (position - F.col("file_start__")).alias(FILE_ROW), position.alias(POSITION))


def split_corrupt(placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(readable rows, quarantine): a line that does not fit the schema goes with its place and its text."""
    bad = F.col(CORRUPT).isNotNull()
    return placed.where(~bad).drop(CORRUPT), placed.where(bad).select(FILE, FILE_ROW, POSITION, CORRUPT)


def corrupt_counts(placed: DataFrame) -> DataFrame:
    """Rows and unreadable rows per file."""
    return placed.groupBy(FILE).agg(F.count(F.lit(1)).alias("n_rows"), F.count(CORRUPT).alias("n_corrupt"))


def positional_ids(placed: DataFrame, id_col: str, prefix: str = "TEMP_") -> DataFrame:
    """PRJ4: rows without an id are named by their position, so equal rows get different names."""
    name = F.concat(F.lit(prefix), F.col(POSITION).cast("string"))
    given = F.col(id_col).cast("string") if id_col in placed.columns else F.lit(None).cast("string")
    return placed.withColumn(id_col, F.coalesce(given, name))
