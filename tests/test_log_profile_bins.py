"""The prediction log's ids, the profile taken while writing, automatic bins."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from retentio.operators import histogram as H
from retentio.operators.profile import profiled_write
from retentio.session import path_exists
from retentio.sources.prediction_log import PredictionLog
from retentio.streaming.stream import run_folder


def _scores(spark, first, n):
    return spark.range(first, first + n, 1, 5).select(
        F.format_string("c%04d", "id").alias("customerID"), (F.col("id") % 7 / 7).alias("churn_probability"),
        F.when(F.col("id") % 2 == 0, "HIGH").alias("churn_risk_tier"))


def _ids(log):
    return sorted(r["id"] for r in log.read().select("id").collect())


def test_ids_are_dense_over_appends_replays_and_empty_batches(spark):
    log = PredictionLog(spark, run_folder(spark, "t-ids"))
    assert log.read().count() == 0
    assert log.append(_scores(spark, 0, 40), "v1", feed="a", batch=0) == (1, 40)
    assert log.append(_scores(spark, 0, 40), "v1", feed="a", batch=0) == (41, 40)   # replay
    assert log.append(_scores(spark, 0, 0), "v1", feed="a", batch=1) == (41, 40)    # empty
    assert log.append(_scores(spark, 100, 13), "v1", feed="b", batch=0) == (41, 53)  # another feed's numbers
    assert log.append(_scores(spark, 200, 7), "v2") == (54, 60)                      # no batch number: always added
    assert _ids(log) == list(range(1, 61))
    rows = log.read().where("model_version = 'v2'")
    assert rows.count() == 7 and rows.where("churn_risk_tier is null").count() == 3  # a missing tier is kept


def test_order_decides_the_ids(spark):
    log = PredictionLog(spark, run_folder(spark, "t-order"))
    log.append(_scores(spark, 0, 300).orderBy(F.rand(3)), "v1", order=[F.col("customer_id").desc()])
    got = [r["customer_id"] for r in log.read().orderBy("id").collect()]
    assert got == [f"c{i:04d}" for i in reversed(range(300))]


def test_a_crash_before_the_entry_leaves_the_log_and_the_retry_mends_it(spark, monkeypatch):
    log = PredictionLog(spark, run_folder(spark, "t-crash"))
    log.append(_scores(spark, 0, 10), "v1", feed="a", batch=0)
    entry = PredictionLog._at

    def broken(self, kind, n):
        if kind == "appends":
            raise OSError("lost driver")
        return entry(self, kind, n)

    rows = _scores(spark, 50, 30)
    monkeypatch.setattr(PredictionLog, "_at", lambda self, kind, n: broken(self, kind, n) if n == 1 else entry(self, kind, n))
    with pytest.raises(OSError):
        log.append(rows, "v1", feed="a", batch=1)
    monkeypatch.undo()
    assert path_exists(spark, entry(log, "rows", 1)) and _ids(log) == list(range(1, 11))
    assert log.append(_scores(spark, 50, 25), "v1", feed="a", batch=1) == (11, 35)
    assert _ids(log) == list(range(1, 36))


def test_profile_counts_while_writing_and_refuses_other_values(spark):
    df = spark.createDataFrame([("Yes", 1.5, 1), (None, float("nan"), 2), ("No", None, None)], "c string, x double, a.b int".replace("a.b", "`a.b`"))
    path = run_folder(spark, "t-profile")
    got = profiled_write(df, path, {"c": ["Yes", "No"]})
    assert got.n_rows == 3 and got.total_missing == 4
    assert got.columns == [("c", "string", 1), ("x", "double", 2), ("a.b", "int", 1)]
    assert got.frame(spark).where("`column` = 'x'").first()["non_null"] == 1
    with pytest.raises(ValueError, match="'c': 1"):
        profiled_write(df.withColumn("c", F.lit("Maybe")).limit(1), path, {"c": ["Yes", "No"]})
    assert spark.read.parquet(path).count() == 3  # the refused rows did not take the table's place
    empty = profiled_write(df.limit(0), path, {"c": ["Yes"]})
    assert empty.n_rows == 0 and empty.total_missing == 0 and spark.read.parquet(path).count() == 0


@pytest.mark.parametrize("values", [
    [float(i) for i in range(64)], [float(i % 9) ** 3 for i in range(257)], [5.0], [2.0, 2.0]])
def test_automatic_bins_are_those_of_numpy(spark, values):
    df = spark.createDataFrame([(v,) for v in values + [None, float("nan")]], "v double")
    got = {r["bin"]: r["n"] for r in H.histogram(df, "v", None).collect()}
    if min(values) == max(values):
        assert got == {0: len(values)}
        return
    counts, _ = np.histogram(values, bins="auto")
    assert got == {i: int(n) for i, n in enumerate(counts) if n}


def test_without_a_spread_between_the_quartiles_sturges_counts_alone(spark):
    df = spark.createDataFrame([(1.0,)] * 12 + [(9.0,)], "v double")  # ceil(log2 13) + 1 = 5 bins
    assert {(r["bin"], r["n"]) for r in H.histogram(df, "v", None).collect()} == {(0, 12), (4, 1)}


def test_automatic_bins_of_an_empty_table(spark):
    assert H.histogram(spark.createDataFrame([], "v double"), "v", None).count() == 0
