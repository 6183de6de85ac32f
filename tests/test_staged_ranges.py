"""The AUC after every tree without a row per margin (round 3, F14)."""

from pyspark.sql import functions as F

from retentio.operators.evaluate import compare_models
from retentio.operators.forest import staged_auc


def _scored(spark):
    def margin(salt):
        return (F.pmod(F.hash("id", F.lit(salt)), F.lit(700)) / 7).cast("double")

    ties = F.when(F.col("id") % 2 == 0, F.lit(3.0)).otherwise(margin(3))  # half of the rows are equal
    one_side = F.when(F.col("id") % 4 == 0, F.lit(None).cast("int")).otherwise((margin(9) > 40).cast("int"))
    cell = F.when(F.col("id") % 3 > 0, (F.col("id") % 3).cast("int"))  # a null name is a group as well
    return spark.range(0, 3000, 1, 7).select(
        cell.alias("cell"), F.lit(0).alias("fold"), F.when(F.col("id") % 3 == 1, F.lit(0)).otherwise(one_side).alias("label"),
        F.array(margin(1), ties, F.lit(-0.0), margin(9)).alias("margins"))


def test_staged_auc_is_exact_over_ranges_and_makes_no_row_per_margin(spark):
    scored = _scored(spark)
    long = scored.select("cell", "fold", "label", F.posexplode("margins").alias("at", "m")).withColumn("iteration", F.col("at") + 1)
    want = compare_models(long, ["cell", "fold", "iteration"], "label", "m").select("cell", "fold", "iteration", "n", "roc_auc")
    want = {tuple(r) for r in want.collect() if r["cell"] is not None}
    for size in (37, 10_000):
        out = staged_auc(scored, ["cell", "fold"], range_rows=size)
        assert "Generate" not in out._jdf.queryExecution().executedPlan().toString()
        got = out.collect()
        assert {tuple(r) for r in got if r["cell"] is not None} == want and len(got) == 12
    assert staged_auc(scored.limit(0), ["cell", "fold"]).count() == 0
