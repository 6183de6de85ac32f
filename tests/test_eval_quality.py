import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from retentio.operators import evaluate as EV
from retentio.operators import quality as Q


def _brute_auc(y, p):
    """Share of (positive, negative) pairs that the score ranks right; a tie counts one half."""
    wins = [1.0 if a > b else 0.5 if a == b else 0.0
            for a, ya in zip(p, y) if ya for b, yb in zip(p, y) if not yb]
    if 1 not in y:
        return 0.0
    return sum(wins) / len(wins) if wins else 1.0


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(0, 5)), min_size=1, max_size=40))
def test_auc_matches_brute_force_with_ties(spark, pairs):
    y = [a for a, _ in pairs]; p = [b / 5 for _, b in pairs]
    df = spark.createDataFrame(list(zip(y, p)), "label int, score double")
    got = EV.roc_auc(df).first()["roc_auc"]
    assert got == pytest.approx(_brute_auc(y, p))
    # invariant to a monotone transform of the scores
    got2 = EV.roc_auc(df.withColumn("score", F.exp(F.col("score") * 3))).first()["roc_auc"]
    assert got2 == pytest.approx(got)


def test_confusion_and_report(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 0), (0, 0), (0, 1)], "label int, prediction int")
    cm = {(r["actual"], r["predicted"]): r["n"] for r in EV.confusion_matrix(df).collect()}
    assert cm == {(0, 0): 2, (0, 1): 1, (1, 0): 1, (1, 1): 1}
    prf = EV.precision_recall_f1(df).first()
    assert prf["precision"] == 0.5 and prf["recall"] == 0.5 and prf["f1"] == 0.5
    only_neg = spark.createDataFrame([(0, 0)], "label int, prediction int")
    assert EV.precision_recall_f1(only_neg).first()["f1"] == 0.0
    rep = {r["class"]: r for r in EV.class_report(df).collect()}
    assert rep["weighted avg"]["support"] == 5


def test_regression_metrics(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 2.0), (3.0, 5.0)], "actual double, predicted double")
    m = EV.regression_metrics(df).first()
    assert m["mae"] == pytest.approx(1.0) and m["mse"] == pytest.approx(5 / 3)
    assert m["r2"] == pytest.approx(1 - 5 / 2)


def test_rules_and_referential(spark):
    df = spark.createDataFrame([(0, 5, 1), (2, -1, None), (None, 3, 0)], "SeniorCitizen int, tenure int, Churn int")
    rep = {r["rule"]: r["violations"] for r in Q.rule_report(df, Q.table_rules()).collect()}
    assert rep == {"senior_citizen_in_0_1": 1, "tenure_non_negative": 1, "churn_in_0_1": 0}
    parent = spark.createDataFrame([("a",), ("b",)], "id string")
    child = spark.createDataFrame([(1, "a"), (2, "z"), (3, None)], "n int, fk string")
    assert [r["n"] for r in Q.orphans(child, parent, "fk", "id").collect()] == [2]
    assert [r["n"] for r in Q.valid_children(child, parent, "fk", "id").collect()] == [1]
    sn = {r["n"]: r["fk"] for r in Q.set_null_orphans(child, parent, "fk", "id").collect()}
    assert sn == {1: "a", 2: None, 3: None}


def test_upsert_replace_keep_first_and_idempotent(spark):
    t = spark.createDataFrame([("1", "x", "t0"), ("2", "y", "t0")], "k string, v string, at string")
    s = spark.createDataFrame([("2", None, "t1"), ("3", "z", "t1")], "k string, v string, at string")
    once = Q.upsert(t, s, "k", keep_first=["at"])
    got = {r["k"]: (r["v"], r["at"]) for r in once.collect()}
    assert got == {"1": ("x", "t0"), "2": (None, "t0"), "3": ("z", "t1")}
    twice = {r["k"]: (r["v"], r["at"]) for r in Q.upsert(once, s, "k", keep_first=["at"]).collect()}
    assert twice == got
    dup = spark.createDataFrame([("3", "old", "t1", 1), ("3", "new", "t1", 2)], "k string, v string, at string, seq int")
    d = {r["k"]: r["v"] for r in Q.upsert(t, dup, "k", keep_first=["at"], order="seq").collect()}
    assert d["3"] == "new"
