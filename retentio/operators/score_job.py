"""The offline scoring job: a restartable run over stored test rows (SCO4, SNK3, JN2-JN4).

Customers are dealt to parts by a hash of their id. A run works through the
parts in groups: the group's rows are read by partition, scored, tiered by the
offline cut-offs, joined with their true labels by id and written with dynamic
partition overwrite, so that a group that was interrupted replaces just its own
parts. A marker per group says that it is complete, and a last one that the job is. A run
that finds markers goes on behind them; a finished job only reads its table.

Probabilities are rounded to four places before the tiers are cut and spend to
two, as doubles: scaled, rounded to even, scaled back.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import risk_tier
from ..schemas import ID_COL, TIER_OFFLINE
from ..session import path_exists

PARTS, GROUP = 64, 16


def stage(rows: DataFrame, path: str, parts: int = PARTS) -> None:
    """Store rows by part, once per job: reading a group prunes to its parts."""
    if path_exists(rows.sparkSession, os.path.join(path, "_SUCCESS")):
        return
    part = F.pmod(F.xxhash64(ID_COL), F.lit(parts)).cast("int")
    rows.withColumn("part", part).repartition("part").write.mode("overwrite").partitionBy("part").parquet(path)


def final_columns(scored: DataFrame, labels: DataFrame) -> DataFrame:
    """The dashboard's columns: rounded scores, hard label, offline tier and the true label."""
    out = scored.withColumns({"churn_probability": F.rint(F.col("churn_probability") * 10_000) / 10_000,
                              "predicted_ltv": F.rint(F.col("ltv_prediction") * 100) / 100}).drop("ltv_prediction")
    out = out.withColumn("risk_tier", risk_tier("churn_probability", *TIER_OFFLINE))
    return out.join(labels, ID_COL, "left")


def run(spark: SparkSession, source: str, labels: DataFrame, score: Callable[[DataFrame], DataFrame], out: str,
        parts: int = PARTS, group: int = GROUP) -> DataFrame:
    """Score the staged rows into ``out/table``. ``score`` adds churn_probability, churn_prediction and ltv_prediction."""
    table, done = os.path.join(out, "table"), os.path.join(out, "done")

    def marker(name: str) -> str:
        return os.path.join(done, name)

    if not path_exists(spark, os.path.join(marker("job"), "_SUCCESS")):
        rows = spark.read.parquet(source)
        for first in range(0, parts, group):
            name = f"group={first}"
            if path_exists(spark, os.path.join(marker(name), "_SUCCESS")):
                continue
            mine = rows.where(F.col("part").between(first, min(first + group, parts) - 1))
            told = final_columns(score(mine), labels)
            told.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(table)
            spark.range(1).coalesce(1).write.mode("overwrite").parquet(marker(name))
        spark.range(1).coalesce(1).write.mode("overwrite").parquet(marker("job"))
    return spark.read.parquet(table).drop("part")
