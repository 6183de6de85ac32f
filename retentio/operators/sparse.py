"""Sparse encoding with a distributed category dictionary, for any number of categories (FE6, FE10, FE13).

The fit leaves a table (column, value, index, n): distinct pairs in the order
of the columns and of their values, numbered by a range-partitioned order with
counted offsets. No list of categories reaches the driver and no plan grows
with them. Rows are encoded in long form, (id, index, value) for each non-zero
cell, by joining the stacked (id, column, value) rows with the dictionary.

A value that more than one in ``HOT`` cells holds is known from the fit's
counts; there are fewer than ``HOT`` of these, so they are broadcast, and no key
of the other join holds more than that share. Vectors come from grouping the
cells by row.

Rules as in ``encode``: a null category is all zeros, an unseen one is dropped,
numbers come first, scaled where they are listed.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import checkpoint_dir, cut_lineage
from .encode import EncoderState, _is_numeric, fit_numeric, stack_categories
from .ordered import global_row_number

HOT = 1000


def category_index(df: DataFrame, cols: Sequence[str], start: int = 0) -> DataFrame:
    """(column, value, index, n): a number for every category, from ``start`` on, and how many rows hold it."""
    place = F.element_at(F.create_map(*[x for k, c in enumerate(cols) for x in (F.lit(c), F.lit(k))]), F.col("column"))
    counted = stack_categories(df, cols).groupBy("column", "value").agg(F.count("*").alias("n")).withColumn("__place", place)
    numbered = global_row_number(counted, [F.col("__place"), F.col("value")], "index")
    return numbered.select("column", "value", (F.col("index") - 1 + start).alias("index"), "n")


@dataclass
class SparseEncoder:
    """Numeric columns by ``numeric`` (their state as in ``encode``), categories by the written table ``path``."""

    numeric: EncoderState
    columns: list[str]
    path: str
    size: int

    def dictionary(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema("column string, value string, index long, n long").parquet(self.path)

    def cells(self, df: DataFrame, id_col: str) -> DataFrame:
        """(id, index, value): the non-zero cells of every row."""
        words = self.dictionary(df.sparkSession)
        present = [c for c in self.columns if c in df.columns]
        out = []
        names = self.numeric.feature_columns
        if names:
            enc = self.numeric.transform(df, [id_col], positional=True)
            pairs = F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("index"), F.col(f"__f{i}").alias("value")) for i in range(len(names))]))
            out.append(enc.select(id_col, pairs.alias("c")).select(id_col, "c.index", "c.value").where("value <> 0"))
        if present:
            rows = stack_categories(df, present, id_col)
            total = words.agg(F.sum("n")).first()[0] or 0
            often = F.col("n") * HOT > F.lit(total)
            told = words.select("column", "value", "index", "n")
            # fewer than HOT rows by their definition
            hot = F.broadcast(told.where(often).select("column", "value", F.col("index").alias("__hot")))
            split = rows.join(hot, ["column", "value"], "left")
            seldom = split.where("__hot IS NULL").drop("__hot").join(told.where(~often).drop("n"), ["column", "value"])
            both = split.where("__hot IS NOT NULL").select(id_col, F.col("__hot").alias("index")).unionByName(seldom.select(id_col, "index"))
            out.append(both.withColumn("value", F.lit(1.0)))
        cells = out[0]
        for more in out[1:]:
            cells = cells.unionByName(more)
        return cells

    def vector(self, df: DataFrame, keep: Sequence[str] = (), output: str = "features") -> DataFrame:
        """FE13: ``keep`` and one sparse vector per row."""
        placed = cut_lineage(df.withColumn("__row", F.monotonically_increasing_id()))
        cells = self.cells(placed, "__row").groupBy("__row").agg(F.array_sort(F.collect_list(F.struct("index", "value"))).alias("cells"))
        none = F.array().cast("array<struct<index:bigint,value:double>>")
        rows = placed.select("__row", *[c for c in keep if c in df.columns]).join(cells, "__row", "left").withColumn("cells", F.coalesce("cells", none))
        # the layout in which a sparse vector is stored: written once, it is read back as vectors
        stored = F.struct(F.lit(0).cast("tinyint").alias("type"), F.lit(self.size).alias("size"),
                          F.transform("cells", lambda c: c["index"].cast("int")).alias("indices"), F.transform("cells", lambda c: c["value"]).alias("values"))
        rows = rows.withColumn(output, stored).drop("cells")
        spark = df.sparkSession
        at = os.path.join(checkpoint_dir(spark), "tables", uuid.uuid4().hex)
        rows.write.mode("errorifexists").parquet(at)
        schema = T.StructType([T.StructField(output, VectorUDT()) if f.name == output else f for f in rows.schema.fields])
        return spark.read.schema(schema).parquet(at).drop("__row")

    @property
    def feature_columns(self) -> list[str]:
        """Names of the numeric columns; the others are in the dictionary."""
        return self.numeric.feature_columns

    # -- persistence (SNK5) ------------------------------------------------
    def save(self, spark: SparkSession, path: str) -> None:
        kept = os.path.join(path, "categories")
        self.dictionary(spark).write.mode("overwrite").parquet(kept)
        state = json.dumps({"numeric": self.numeric.to_json(), "columns": self.columns, "size": self.size})
        spark.createDataFrame([(state,)], "state string").coalesce(1).write.mode("overwrite").json(os.path.join(path, "state"))

    @staticmethod
    def load(spark: SparkSession, path: str) -> "SparseEncoder":
        d = json.loads(spark.read.json(os.path.join(path, "state")).first()["state"])
        return SparseEncoder(EncoderState.from_json(d["numeric"]), d["columns"], os.path.join(path, "categories"), d["size"])


def fit_sparse(df: DataFrame, categorical: Sequence[str], numerical: Sequence[str], exclude: Sequence[str] = ()) -> SparseEncoder:
    """FE6-FE8 fit with the rules of ``fit_encoder``; the categories stay a table."""
    present = [c for c in df.columns if c not in exclude]
    cat = [c for c in categorical if c in present]
    extra = [c for c in present if c not in cat and not _is_numeric(df.schema[c].dataType)]
    passthrough = [c for c in present if c not in cat and c not in extra]
    numeric = fit_numeric(df, passthrough, [c for c in numerical if c in passthrough])
    spark = df.sparkSession
    path = os.path.join(checkpoint_dir(spark), "tables", uuid.uuid4().hex)
    nothing = spark.createDataFrame([], "column string, value string, index long, n long")
    (category_index(df, cat + extra, len(passthrough)) if cat + extra else nothing).write.parquet(path)
    return SparseEncoder(numeric, cat + extra, path, len(passthrough) + spark.read.schema(nothing.schema).parquet(path).count())
