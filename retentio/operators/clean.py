"""Cleaning and projection (CLN1-5, PRJ1-4).

TotalCharges text -> double (blank/unparsable -> null), tenure 0 -> 0.0, then
the remaining nulls are filled with the median of the column *after* the
tenure-0 step. Churn Yes/No -> 1/0, other text -> null, integers untouched.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import to_number, yes_no_to_int
from ..schemas import CHURN_COL, DB_RENAME, ID_COL
from .quantile import exact_median


def coerce_total(df: DataFrame, col: str = "TotalCharges") -> DataFrame:
    """CLN1 + CLN2: numeric coercion, then zero for tenure-0 rows."""
    if col not in df.columns:
        return df
    value = to_number(col)
    if "tenure" in df.columns:
        value = F.when(F.col("tenure") == 0, F.lit(0.0)).otherwise(value)
    return df.withColumn(col, value)


def map_churn(df: DataFrame, col: str = CHURN_COL) -> DataFrame:
    """CLN4: Yes/No -> 1/0 unless the column is already integral."""
    if col not in df.columns:
        return df
    if isinstance(df.schema[col].dataType, T.IntegralType):
        return df
    return df.withColumn(col, yes_no_to_int(col))


def training_median(df: DataFrame, col: str = "TotalCharges") -> DataFrame:
    """One-row DataFrame ``median`` of the coerced column (kept as fit state)."""
    return exact_median(coerce_total(df, col), col, name="median")


def clean(df: DataFrame, impute: str = "median", median: DataFrame | float | None = None,
          col: str = "TotalCharges") -> DataFrame:
    """CLN1-5. ``impute``: "median" (training pipeline) or "zero" (API variant).

    ``median``: the training value, as a number or a one-row DataFrame with
    column ``median``; computed from ``df`` when not given. It is a scalar fit
    state, so it is resolved once here and applied as a literal: later actions
    on the cleaned frame do not re-run the quantile search.
    """
    out = coerce_total(df, col)
    if col in out.columns:
        if impute == "zero":
            out = out.withColumn(col, F.coalesce(F.col(col), F.lit(0.0)))
        elif impute == "median":
            med = median if median is not None else exact_median(out, col, name="median")
            if isinstance(med, DataFrame):
                med = med.select("median").first()[0]  # one row, one value
            fill = F.lit(None).cast("double") if med is None else F.lit(float(med))
            out = out.withColumn(col, F.coalesce(F.col(col), fill))
        elif impute is not None:
            raise ValueError(f"unknown impute policy {impute!r}")
    return map_churn(out)


def to_db_columns(df: DataFrame, rename: Sequence[tuple[str, str]] = DB_RENAME) -> DataFrame:
    """PRJ1: rename by map and keep mapped columns, in map order."""
    return df.select(*[F.col(src).alias(dst) for src, dst in rename if src in df.columns])


def drop_columns(df: DataFrame, *cols: str) -> DataFrame:
    """PRJ2: drop, ignoring absent columns."""
    return df.drop(*cols)


def select_existing(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """PRJ3: projection limited to columns that exist."""
    return df.select(*[c for c in cols if c in df.columns])


def ensure_id(df: DataFrame, id_col: str = ID_COL, prefix: str = "CUST_") -> DataFrame:
    """PRJ4: rows without an id get a content-derived name (stable across layouts; equal rows share it).

    ``sources.positions`` gives names by file position, which differ for equal rows.
    """
    if id_col not in df.columns:
        df = df.withColumn(id_col, F.lit(None).cast("string"))
    others = [c for c in df.columns if c != id_col]
    fallback = F.concat(F.lit(prefix), F.abs(F.xxhash64(*[F.col(c) for c in others])).cast("string"))
    return df.withColumn(id_col, F.coalesce(F.col(id_col).cast("string"), fallback))
