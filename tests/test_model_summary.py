"""A fitted model can be sent to tasks after a write was observed in the session."""

from pyspark.sql import Observation
from pyspark.sql import functions as F

from retentio.operators import models as M


def test_a_linear_model_scores_after_an_observation(spark):
    seen = Observation("rows")
    spark.range(5).observe(seen, F.count(F.lit(1)).alias("n")).collect()
    assert seen.get == {"n": 5}
    rows = spark.range(60).select(
        F.col("id").cast("string").alias("customerID"), F.when(F.col("id") % 2 == 0, "DSL").otherwise("No").alias("InternetService"),
        (F.col("id") % 7).cast("int").alias("tenure"), (F.col("id") % 11).cast("double").alias("MonthlyCharges"),
        (F.col("id") % 3 % 2).cast("int").alias("Churn"))
    model = M.train_churn(rows, "lr")
    assert not model.model.hasSummary
    assert M.score_churn(model, rows).where("churn_probability between 0 and 1").count() == 60
