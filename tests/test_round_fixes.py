import pytest
from pyspark.sql import functions as F

from retentio.operators import evaluate as EV
from retentio.operators import histogram as H
from retentio.operators import quality as Q


def test_histogram_passes_over_nan(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (float("nan"),), (None,)], "v double")
    assert [(r["bin"], r["n"]) for r in H.histogram(df, "v", 2).orderBy("bin").collect()] == [(0, 1), (1, 1)]


def test_kde_of_a_constant_column_is_null(spark):
    df = spark.createDataFrame([(2.0,), (2.0,)], "v double")
    assert {r["density"] for r in H.kde(df, "v", 5).collect()} == {None}


def test_r2_covers_complete_pairs_only(spark):
    df = spark.createDataFrame([(1.0, 1.5), (2.0, 2.0), (50.0, None)], "actual double, predicted double")
    assert EV.regression_metrics(df).first()["r2"] == pytest.approx(0.5)


def test_unknown_labels_are_no_negatives(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.1), (None, 0.95)], "label int, score double")
    assert EV.roc_auc(df).first()["roc_auc"] == 1.0


def test_upsert_refuses_repeated_source_keys(spark):
    target = spark.createDataFrame([(1, "a")], "k long, v string")
    twice = spark.createDataFrame([(1, "b"), (1, "c")], "k long, v string")
    with pytest.raises(Exception, match="repeated source key"):
        Q.upsert(target, twice, "k").collect()
    once = Q.upsert(target, twice.where(F.col("v") == "b"), "k").collect()
    assert [tuple(r) for r in once] == [(1, "b")]
