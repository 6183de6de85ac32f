"""Profile of a table taken while it is written: shape, missing values, types, allowed values (PRF1, PRF3, PRF6).

The counts are observed on the rows on their way into the files, so the
profile costs no second scan. The observation sits in the writing stage
itself, whose finished tasks count once, retries included. The rows go to a pending
folder first: one that breaks an allowed-value rule never gets the table's
name, and stays for inspection.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..session import move_folder


@dataclass
class TableProfile:
    n_rows: int
    columns: list[tuple[str, str, int]]   # (name, type, missing)

    @property
    def total_missing(self) -> int:
        return sum(missing for _, _, missing in self.columns)

    def frame(self, spark: SparkSession) -> DataFrame:
        """One row per column, the shape beside it."""
        rows = [(c, t, m, self.n_rows - m, self.n_rows, len(self.columns), self.total_missing) for c, t, m in self.columns]
        return spark.createDataFrame(rows, "column string, type string, missing long, non_null long, "
                                           "n_rows long, n_columns long, total_missing long")


def _missing(df: DataFrame, name: str) -> Column:
    col = F.col(f"`{name}`")
    return col.isNull() | F.isnan(col) if dict(df.dtypes)[name] in ("double", "float") else col.isNull()


def profiled_write(df: DataFrame, path: str, allowed: Mapping[str, Sequence] | None = None) -> TableProfile:
    """Write ``df`` to ``path`` (replacing it) and return its profile; NaN counts as missing.

    ``allowed`` names the values that a column may hold; missing ones pass. A value outside raises ``ValueError`` with
    the count per column, and ``path`` stays as it was.
    """
    allowed = dict(allowed or {})
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    metrics = [F.count(F.lit(1)).alias("rows")]
    metrics += [count(_missing(df, c)).alias(f"m{i}") for i, c in enumerate(df.columns)]
    metrics += [count(~_missing(df, c) & ~F.col(f"`{c}`").isin(list(values))).alias(f"d{i}")
                for i, (c, values) in enumerate(allowed.items())]
    seen = Observation()
    pending = path.rstrip("/") + ".pending"
    df.observe(seen, *metrics).write.mode("overwrite").parquet(pending)
    got = seen.get
    broken = {c: got[f"d{i}"] for i, c in enumerate(allowed) if got[f"d{i}"]}
    if broken:
        raise ValueError(f"values outside the allowed ones (rows by column): {broken}; the rows are in {pending}")
    move_folder(df.sparkSession, pending, path)
    return TableProfile(got["rows"], [(c, t, got[f"m{i}"] or 0) for i, (c, t) in enumerate(df.dtypes)])
