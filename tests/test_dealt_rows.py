"""A boosted fit takes its tasks and its draws from the rows, not from the layout they come in (F1-F11)."""

from pyspark.sql import functions as F

from retentio.operators import models as M


def _rows(spark, n=400):
    rows = spark.range(n).select(
        F.when(F.col("id") % 4 != 0, F.col("id").cast("string")).alias("customerID"),
        F.element_at(F.array(F.lit("DSL"), F.lit("No")), (F.col("id") % 2 + 1).cast("int")).alias("InternetService"),
        (F.col("id") * 37 % 73).cast("int").alias("tenure"), (F.col("id") * 53 % 101).cast("double").alias("MonthlyCharges"),
        (F.col("id") * 11 % 7 < 3).cast("int").alias("Churn"))
    return rows.unionByName(rows.where("tenure = 5"))


def test_tasks_of_a_boosted_fit_follow_the_rows(spark, monkeypatch):
    rows = _rows(spark).repartition(64)
    dealt = M._dealt(rows, "gbt")
    assert dealt.rdd.getNumPartitions() == 1
    assert sorted(map(str, dealt.collect())) == sorted(map(str, rows.collect()))
    monkeypatch.setattr(M, "ROWS_PER_TASK", 100)
    sizes = M._dealt(rows, "gbt").rdd.glom().map(len).collect()
    assert len(sizes) == 5 and max(sizes) < 200  # null and repeated ids are spread


def test_a_boosted_fit_does_not_depend_on_the_layout(spark):
    rows = _rows(spark)
    fits = [M.train_churn(rows.repartition(n), "gbt", maxIter=3, maxDepth=3).importances() for n in (3, 17)]
    assert fits[0] == fits[1]


def test_vectors_of_a_boosted_fit_are_written_once_and_cut_from_the_joins(spark, monkeypatch):
    for name in ("GBTClassifier", "LogisticRegression"):
        monkeypatch.setattr(getattr(M.MC, name), "fit", lambda self, data: data)
    monkeypatch.setattr(M.MR.GBTRegressor, "fit", lambda self, data: data)
    rows = _rows(spark).join(spark.range(3).withColumnRenamed("id", "tenure"), "tenure", "left").repartition(64)
    spent = rows.withColumn("TotalCharges", F.col("MonthlyCharges") * 2)
    for fitted in (M.train_churn(rows, "gbt"), M.train_ltv(spent, "gbt")):
        plan = fitted.model._jdf.queryExecution().analyzed().toString()
        assert "Join" not in plan and "Repartition" not in plan and "LogicalRDD" in plan
        assert fitted.model.rdd.getNumPartitions() == 1 and fitted.model.count() == rows.count()
    assert "Join" in M.train_churn(rows, "lr").model._jdf.queryExecution().analyzed().toString()


def test_models_of_one_query_are_fitted_side_by_side(spark, monkeypatch):
    from threading import Barrier

    from retentio.plans import q_models as Q

    both = Barrier(2, timeout=20)
    monkeypatch.setattr(Q, "_splits", lambda *_: None)
    monkeypatch.setattr(Q, "_model", lambda spark, sf_dir, task, kind: (both.wait() >= 0) and (task, kind))
    assert Q._fit_together(spark, "", ("churn", "gbt"), ("ltv", "gbt")) == [("churn", "gbt"), ("ltv", "gbt")]
