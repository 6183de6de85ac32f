"""The prediction log: appended batches with dense long ids, each applied once (SNK2, STR1).

Ids run 1, 2, 3... over the whole log, as a serial key does, without a row
counter on the driver. An append first writes its rows with the place that the
writing task gave them (task, row in task). These files are the truth from
then on: the rows per task, one row a task, become offsets, and
``id = last id so far + offset of the task + row in the task + 1``. The
numbered rows go to ``rows/n=<append>``, and the small entry
``appends/n=<append>`` then commits them with the last id and the last batch of
every feed. A crash before that entry leaves the log as it was, and the retry
overwrites what it left; a replayed batch of a feed is skipped. So no id is
missing or given twice. One job at a time may append; readers see committed
appends only.
"""

from __future__ import annotations

import json
import os
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import ID_COL, PREDICTION_LOG
from ..session import delete_folder, folder_names, path_exists

_PLACE, _TASK, _APPEND = "place__", "task__", "n"
_TASK_BITS = 33  # monotonically_increasing_id: the task above, the row in the task below
_ENTRY = "last_id long, applied string"
_TIER = "churn_risk_tier"


def log_rows(scores: DataFrame, model_version: str) -> DataFrame:
    """Score rows in the log's columns but for the id; a missing label or spend estimate is null."""
    def given(name: str, source: str | None = None) -> Column:
        source = source or name
        value = F.col(source) if source in scores.columns else F.lit(None)
        return value.cast(PREDICTION_LOG[name].dataType).alias(name)

    return scores.select(
        given("customer_id", ID_COL), given("churn_probability"), given("churn_prediction"), given(_TIER),
        given("ltv_prediction"), F.lit(model_version).alias("model_version"), F.current_timestamp().alias("predicted_at"))


class PredictionLog:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _at(self, kind: str, n: int) -> str:
        return os.path.join(self.path, kind, f"{_APPEND}={n}")

    def _last(self) -> tuple[int, int, dict]:
        """(append, last id, last batch by feed) of the last committed append; (-1, 0, {}) for a new log."""
        known = sorted((int(x.split("=")[1]) for x in folder_names(self.spark, os.path.join(self.path, "appends"))), reverse=True)
        for n in known:  # appends commit in order: at most the newest is incomplete
            if path_exists(self.spark, os.path.join(self._at("appends", n), "_SUCCESS")):
                entry = self.spark.read.schema(_ENTRY).json(self._at("appends", n)).first()
                return n, entry["last_id"], json.loads(entry["applied"])
        return -1, 0, {}

    def append(self, scores: DataFrame, model_version: str, feed: str = "", batch: int | None = None,
               order: Sequence[Column] = ()) -> tuple[int, int]:
        """Append score rows; (first id, last id) given, first > last if none.

        With a batch number, a batch up to the last applied one of its feed is a replay and adds nothing. With
        ``order`` (a total order) ids follow it; otherwise they follow the input's partitions.
        """
        last, end, applied = self._last()
        if batch is not None and batch <= applied.get(feed, -1):
            return end + 1, end
        n = last + 1
        rows = log_rows(scores, model_version)
        if order:
            rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
        staged = self._at("staged", n)
        placed = rows.withColumn(_PLACE, F.monotonically_increasing_id())
        placed.write.mode("overwrite").parquet(staged)
        placed = self.spark.read.schema(placed.schema).parquet(staged).withColumn(_TASK, F.shiftright(_PLACE, _TASK_BITS))
        # one row per writing task: a small table, so its window and its broadcast are bounded by the task count
        before = Window.orderBy(_TASK).rowsBetween(Window.unboundedPreceding, -1)
        offsets = (placed.groupBy(_TASK).agg(F.count(F.lit(1)).alias("c__"))
                   .select(_TASK, F.coalesce(F.sum("c__").over(before), F.lit(0)).alias("o__")))
        row = F.col(_PLACE).bitwiseAND(F.lit((1 << _TASK_BITS) - 1))
        numbered = placed.join(F.broadcast(offsets), _TASK).withColumn("id", F.lit(end + 1) + F.col("o__") + row)
        numbered.select(*PREDICTION_LOG.fieldNames()).write.mode("overwrite").partitionBy(_TIER).parquet(self._at("rows", n))
        total = placed.count()
        if batch is not None:
            applied[feed] = batch
        (self.spark.createDataFrame([(end + total, json.dumps(applied))], _ENTRY).coalesce(1)
         .write.mode("overwrite").json(self._at("appends", n)))
        delete_folder(self.spark, staged)
        return end + 1, end + total

    def read(self) -> DataFrame:
        """The committed rows; an append that did not commit has a number beyond the last and is pruned."""
        last, _, _ = self._last()
        if last < 0:
            return self.spark.createDataFrame([], PREDICTION_LOG)
        with_append = T.StructType(PREDICTION_LOG.fields + [T.StructField(_APPEND, T.LongType())])
        rows = self.spark.read.schema(with_append).parquet(os.path.join(self.path, "rows"))
        return rows.where(F.col(_APPEND) <= last).select(*PREDICTION_LOG.fieldNames())
