"""Table definitions with types, defaults, checks and a key, held while loading (SNK8, SNK9).

``conform`` brings a frame into the definition: columns in order, cast, absent
or null ones filled where the definition has a default. ``load`` counts the
rows and every broken rule on the rows' way into the files, looks for repeated
keys in what was written, and only a clean load gets the table's name; a rule
that breaks raises with the counts, as a database would refuse the statement.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import PREDICTION_LOG
from ..session import move_folder


@dataclass(frozen=True)
class TableDef:
    schema: T.StructType
    key: str
    defaults: Mapping[str, Column] = field(default_factory=dict)
    checks: Mapping[str, Column] = field(default_factory=dict)   # true or null passes

    def conform(self, df: DataFrame) -> DataFrame:
        """The columns of the definition, in order; what it does not name is dropped."""
        def column(f: T.StructField) -> Column:
            value = F.col(f.name) if f.name in df.columns else F.lit(None)
            if isinstance(f.dataType, T.DecimalType):
                value = F.round(value.cast("decimal(38,6)"), f.dataType.scale)  # the same half cents in every engine
            value = value.cast(f.dataType)
            if f.name in self.defaults:
                value = F.coalesce(value, self.defaults[f.name].cast(f.dataType))
            return value.alias(f.name)

        return df.select(*[column(f) for f in self.schema.fields])

    def load(self, df: DataFrame, path: str) -> int:
        """Write ``df`` as the table at ``path`` (replacing it); returns the rows it then holds."""
        spark, pending, seen = df.sparkSession, path.rstrip("/") + ".pending", Observation()
        rules = {"missing key": F.col(self.key).isNotNull(), **self.checks}
        broken = [F.count(F.when(~rule, 1)).alias(f"r{i}") for i, rule in enumerate(rules.values())]
        (self.conform(df).observe(seen, F.count(F.lit(1)).alias("n"), *broken)
         .write.mode("overwrite").parquet(pending))
        got = seen.get
        found = {name: got[f"r{i}"] for i, name in enumerate(rules) if got[f"r{i}"]}
        stored = spark.read.schema(self.schema).parquet(pending)
        keys = stored.groupBy(self.key).agg(F.count(F.lit(1)).alias("c")).where("c > 1").agg(F.count(F.lit(1))).first()[0]
        if keys:
            found["repeated keys"] = keys
        if found:
            raise ValueError(f"rows against the definition: {found}; they are in {pending}")
        total = stored.count()   # of the files, from their footers
        if total != got["n"]:
            raise ValueError(f"{got['n']} rows were written, {total} are stored in {pending}")
        move_folder(spark, pending, path)
        return total


def customers() -> TableDef:
    """The customer table; made on call, as columns need a session."""
    text, whole, money = T.StringType(), T.IntegerType(), T.DecimalType(10, 2)
    # fixed values: columns and types of the customer table
    columns = [("customer_id", text), ("gender", text), ("senior_citizen", whole), ("partner", text), ("dependents", text),
               ("tenure", whole), ("phone_service", text), ("multiple_lines", text), ("internet_service", text),
               ("online_security", text), ("online_backup", text), ("device_protection", text), ("tech_support", text),
               ("streaming_tv", text), ("streaming_movies", text), ("contract", text), ("paperless_billing", text),
               ("payment_method", text), ("monthly_charges", money), ("total_charges", money), ("churn", whole),
               ("ingested_at", T.TimestampType())]
    return TableDef(T.StructType([T.StructField(n, t) for n, t in columns]), "customer_id",
                    {"ingested_at": F.current_timestamp()},
                    {"senior_citizen in (0, 1)": F.col("senior_citizen").isin(0, 1), "tenure >= 0": F.col("tenure") >= 0,
                     "churn in (0, 1)": F.col("churn").isin(0, 1)})


def predictions() -> TableDef:
    """The prediction log; its ids come from ``PredictionLog``."""
    return TableDef(PREDICTION_LOG, "id", {"predicted_at": F.current_timestamp()})
