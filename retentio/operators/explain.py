"""Additive score attributions (EXP1-4).

For a linear model on the encoded features the exact attribution of feature
j for a row is ``coef_j * (x_j - mean_j)`` (means over the training rows),
and the attributions plus the base value ``intercept + sum(coef * mean)`` sum
to the row's log-odds. Everything is a column expression over an exploded
(feature, coefficient, mean) array whose length is the feature count.
"""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import ID_COL
from .models import FittedModel


def feature_means(model: FittedModel, train: DataFrame) -> list[float]:
    """Mean of each encoded feature over the training rows (one aggregate)."""
    v = model.features(train, keep=[]).select(vector_to_array("features").alias("__a"))
    n = len(model.encoder.feature_columns)
    row = v.agg(*[F.avg(F.col("__a")[i]).alias(f"m{i}") for i in range(n)]).first()
    return [float(row[f"m{i}"] or 0.0) for i in range(n)]


def linear_attributions(model: FittedModel, train: DataFrame, rows: DataFrame,
                        id_col: str = ID_COL) -> DataFrame:
    """Long (id, feature, value, phi) + a ``base`` column; exact for linear models."""
    coefs = [float(c) for c in model.model.coefficients.toArray()]
    means = feature_means(model, train)
    names = model.encoder.feature_columns
    base = float(model.model.intercept) + sum(c * m for c, m in zip(coefs, means))
    v = model.features(rows, keep=[id_col]).select(id_col, vector_to_array("features").alias("__a"))
    spec = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(n).alias("feature"), F.lit(c).alias("coef"),
                              F.lit(m).alias("mean")) for i, (n, c, m) in enumerate(zip(names, coefs, means))])
    e = v.select(id_col, "__a", F.explode(spec).alias("s"))
    x = F.col("__a")[F.col("s.i")]
    return e.select(id_col, F.col("s.feature").alias("feature"), x.alias("value"),
                    (F.col("s.coef") * (x - F.col("s.mean"))).alias("phi"),
                    F.lit(base).alias("base"))


def mean_abs_attribution(attr: DataFrame, top: int = 15) -> DataFrame:
    """EXP2: mean |phi| per feature, top ``top`` (a report: the limit is the feature)."""
    return (attr.groupBy("feature").agg(F.avg(F.abs("phi")).alias("mean_abs_phi"))
            .orderBy(F.desc("mean_abs_phi"), "feature").limit(top))


def waterfall(attr: DataFrame, customer: DataFrame, id_col: str = ID_COL, shown: int = 12) -> DataFrame:
    """EXP3: base value, the ``shown`` largest |phi| of one customer, then the remainder."""
    from pyspark.sql import Window
    one = attr.join(customer.select(id_col), id_col, "left_semi")
    w = Window.partitionBy(id_col).orderBy(F.desc(F.abs("phi")), "feature")
    ranked = one.withColumn("rank", F.row_number().over(w))  # one customer: feature-count rows
    top = ranked.where(F.col("rank") <= shown).select(id_col, "rank", "feature", "phi")
    rest = (ranked.where(F.col("rank") > shown).groupBy(id_col)
            .agg(F.lit(shown + 1).alias("rank"), F.lit("other features").alias("feature"),
                 F.sum("phi").alias("phi")))
    base = one.groupBy(id_col).agg(F.lit(0).alias("rank"), F.lit("base value").alias("feature"),
                                   F.first("base").alias("phi"))
    return base.unionByName(top).unionByName(rest)
