"""Encoding with saved fit state (FE6-FE13).

Fit state is small: the sorted category list of each categorical column
(found with one distributed ``distinct`` over a stacked (column, value)
projection) and mean / sample std of each numeric column (one fused
aggregate). Lists beyond a size stay on the cluster (``sparse``). Applying
the state is pure column expressions, so scoring stays in whole-stage codegen.

Rules kept from the reference: dummies are named ``<col>_<value>``, values
sorted, none dropped; a null category is all zeros; an unseen category at
scoring is dropped and a training category absent from the batch is 0; the
scale uses sample std and falls back to 1.0 when std <= 0 or undefined.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: categories up to which the encoding is column expressions; ``sparse`` encodes any number
WIDE = 1000


def _is_numeric(dt: T.DataType) -> bool:
    return isinstance(dt, (T.NumericType, T.BooleanType))


def _value_text(dt: T.DataType, c: str) -> F.Column:
    """Category value as the text used in dummy names (ints without decimals)."""
    return F.col(c).cast("string")


def stack_categories(df: DataFrame, cols: Sequence[str], id_col: str | None = None) -> DataFrame:
    """Long (id?, column, value) projection of categorical columns (nulls dropped)."""
    pairs = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), _value_text(df.schema[c].dataType, c).alias("value"))
        for c in cols]))
    keep = [F.col(id_col)] if id_col else []
    return (df.select(*keep, pairs.alias("__p"))
            .select(*keep, F.col("__p.column").alias("column"), F.col("__p.value").alias("value"))
            .where(F.col("value").isNotNull()))


def category_table(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Distributed fit of the category lists: distinct (column, value) with feature names."""
    return (stack_categories(df, cols).distinct()
            .withColumn("feature", F.concat_ws("_", "column", "value")))


def onehot_long(df: DataFrame, cols: Sequence[str], id_col: str) -> DataFrame:
    """One-hot encoding in long form: one (id, feature) row per set indicator."""
    return (stack_categories(df, cols, id_col)
            .select(id_col, F.concat_ws("_", "column", "value").alias("feature")))


def scale_stats(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """FE8 as a long table (column, mean, std) from one fused aggregate pass."""
    wide = df.agg(*[F.avg(F.col(c).cast("double")).alias(f"m__{c}") for c in cols],
                  *[F.stddev_samp(F.col(c).cast("double")).alias(f"s__{c}") for c in cols])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"m__{c}").alias("mean"),
                                        F.col(f"s__{c}").alias("std")) for c in cols]))
    return wide.select(rows.alias("r")).select("r.column", "r.mean", "r.std")


@dataclass
class EncoderState:
    """Fitted encoding: categories per column, numeric stats, output column order."""

    categories: dict[str, list[str]] = field(default_factory=dict)
    stats: dict[str, tuple[float, float]] = field(default_factory=dict)
    passthrough: list[str] = field(default_factory=list)
    feature_columns: list[str] = field(default_factory=list)
    fill: dict[str, float] = field(default_factory=dict)

    # -- apply -------------------------------------------------------------
    def transform(self, df: DataFrame, keep: Sequence[str] = (), positional: bool = False) -> DataFrame:
        """Encode + scale + align to ``feature_columns`` (missing -> 0, extra dropped).

        ``positional=True`` names the outputs ``__f<i>`` so kept columns can share names.
        """
        exprs = {}
        for c in self.passthrough:
            if c in df.columns:
                value = F.col(c).cast("double")
                if c in self.fill:
                    # MLlib vectors take no NaN: a missing value becomes the training mean
                    value = F.coalesce(F.when(~F.isnan(value), value), F.lit(self.fill[c]))
                if c in self.stats:
                    mean, std = self.stats[c]
                    std = std if (std is not None and not math.isnan(std) and std > 0) else 1.0
                    value = (value - F.lit(mean)) / F.lit(std)
                exprs[c] = value
        for c, values in self.categories.items():
            if c not in df.columns:
                continue
            text = F.col(c).cast("string")
            for v in values:
                exprs[f"{c}_{v}"] = F.when(text == v, F.lit(1.0)).otherwise(F.lit(0.0))
        out = [F.col(k) for k in keep if k in df.columns]
        for i, name in enumerate(self.feature_columns):
            out.append((exprs[name] if name in exprs else F.lit(0.0))
                       .alias(f"__f{i}" if positional else name))
        return df.select(*out)

    def vector(self, df: DataFrame, keep: Sequence[str] = (), output: str = "features") -> DataFrame:
        """FE13: encoded columns assembled into one MLlib vector column."""
        from pyspark.ml.feature import VectorAssembler
        enc = self.transform(df, keep, positional=True)
        cols = [f"__f{i}" for i in range(len(self.feature_columns))]
        va = VectorAssembler(inputCols=cols, outputCol=output, handleInvalid="keep")
        return va.transform(enc).drop(*cols)

    def long(self, df: DataFrame, id_col: str) -> DataFrame:
        """FE10 in long form: one (id, feature, value) row per row and training column, zeros included."""
        enc = self.transform(df, [id_col], positional=True)
        cells = F.explode(F.array(*[F.struct(F.lit(name).alias("feature"), F.col(f"__f{i}").alias("value"))
                                    for i, name in enumerate(self.feature_columns)]))
        return enc.select(id_col, cells.alias("__c")).select(id_col, "__c.feature", "__c.value")

    # -- persistence (SNK5) ------------------------------------------------
    def to_json(self) -> str:
        return json.dumps({"categories": self.categories,
                           "stats": {k: list(v) for k, v in self.stats.items()},
                           "passthrough": self.passthrough,
                           "feature_columns": self.feature_columns,
                           "fill": self.fill})

    @staticmethod
    def from_json(text: str) -> "EncoderState":
        d = json.loads(text)
        return EncoderState(d["categories"], {k: tuple(v) for k, v in d["stats"].items()},
                            d["passthrough"], d["feature_columns"], d.get("fill", {}))

    def save(self, spark, path: str) -> None:
        """Write the fit state as a one-row table (works on any shared filesystem)."""
        spark.createDataFrame([(self.to_json(),)], "state string").coalesce(1) \
            .write.mode("overwrite").json(path)

    @staticmethod
    def load(spark, path: str) -> "EncoderState":
        return EncoderState.from_json(spark.read.json(path).first()["state"])


def fit_encoder(df: DataFrame, categorical: Sequence[str], numerical: Sequence[str],
                exclude: Sequence[str] = ()) -> EncoderState:
    """FE6-FE8 fit: category lists, scale stats and the output column order.

    Like the reference, non-listed non-numeric columns are auto-encoded (FE7)
    and other numeric columns pass through unscaled; ``exclude`` (ids, targets)
    are left out. More than ``WIDE`` categories give a ``sparse.SparseEncoder``,
    whose categories stay a table; its vectors have the same order.
    """
    present = [c for c in df.columns if c not in exclude]
    cat = [c for c in categorical if c in present]
    extra = [c for c in present if c not in cat and not _is_numeric(df.schema[c].dataType)]
    passthrough = [c for c in present if c not in cat and c not in extra]
    num = [c for c in numerical if c in passthrough]

    enc_cols = cat + extra
    cats: dict[str, list[str]] = {c: [] for c in enc_cols}
    # two passes over the input (categories, stats): keep it for the fit, as MLlib estimators do
    persisted_here = not df.storageLevel.useMemory and not df.storageLevel.useDisk
    if persisted_here:
        df = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        if enc_cols:
            # the bound is checked by the same job that fetches the table: at most WIDE + 1 rows move
            rows = category_table(df, enc_cols).select("column", "value").limit(WIDE + 1).collect()
            if len(rows) > WIDE:
                from .sparse import fit_sparse

                return fit_sparse(df, categorical, numerical, exclude)
            for r in rows:
                cats[r["column"]].append(r["value"])
            for c in cats:
                cats[c].sort()
        state = fit_numeric(df, passthrough, num)
    finally:
        if persisted_here:
            df.unpersist()
    state.categories = cats
    state.feature_columns += [f"{c}_{v}" for c in enc_cols for v in cats[c]]
    return state


def fit_numeric(df: DataFrame, passthrough: Sequence[str], scaled: Sequence[str]) -> EncoderState:
    """Means of all numeric columns (null fill) and stds of the scaled ones, from one aggregate."""
    state = EncoderState(passthrough=list(passthrough), feature_columns=list(passthrough))
    for r in scale_stats(df, passthrough).collect() if passthrough else ():
        state.fill[r["column"]] = r["mean"] if r["mean"] is not None else 0.0
        if r["column"] in scaled:
            state.stats[r["column"]] = (r["mean"], r["std"] if r["std"] is not None else float("nan"))
    return state
