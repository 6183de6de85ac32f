"""Jobs over stored tables: the offline scoring run and the bucketed table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import score_job as SJ
from ..operators.bucketed import BucketedTable
from ..operators.clean import to_db_columns
from ..sources import fixture
from ..streaming.stream import run_folder
from . import common as C
from .catalog import register
from .oracle_sql import with_clean, with_scores
from .q_quality import _UPSERT_SQL, _upsert_body


@register("offline_predictions", with_scores("""
SELECT sc."customerID", s."Contract", label AS actual_churn, ROUND_EVEN(churn_probability * 10000, 0) / 10000 AS churn_probability,
       CAST(churn_probability >= 0.5 AS INTEGER) AS churn_prediction,
       CASE WHEN ROUND_EVEN(churn_probability * 10000, 0) / 10000 >= 0.7 THEN 'HIGH' WHEN ROUND_EVEN(churn_probability * 10000, 0) / 10000 >= 0.4 THEN 'MEDIUM' ELSE 'LOW' END AS risk_tier,
       ROUND_EVEN(ltv_prediction * 100, 0) / 100 AS predicted_ltv
FROM sc JOIN s ON s."customerID" = sc."customerID"
WHERE substr(md5('42:' || sc."customerID"), 1, 8) < '33333333'"""))
def offline_predictions(spark, sf_dir):
    """SCO4, SNK3, JN2-JN4: the test rows scored part by part into the stored table (model-free score)."""
    from ..operators.split import assign_split

    run = run_folder(spark, "offline")
    test = assign_split(C.raw(spark, sf_dir), "customerID").where(F.col("split") == "test").select("customerID", "Contract")
    SJ.stage(test, f"{run}/source")
    scores = C.scores(spark, sf_dir)
    labels = scores.select("customerID", F.col("label").alias("actual_churn"))

    def score(rows):
        told = scores.select("customerID", "churn_probability", "ltv_prediction")
        return rows.join(told, "customerID").withColumn("churn_prediction", (F.col("churn_probability") >= 0.5).cast("int"))

    return SJ.run(spark, f"{run}/source", labels, score, f"{run}/out")


@register("bucketed_upsert", with_clean(f"WITH {_UPSERT_SQL}\n{_upsert_body()}"))
def bucketed_upsert(spark, sf_dir):
    """SNK1: the customer feed merged into a hash-bucketed table, which rewrites the touched buckets only."""
    c = C.customers(spark, sf_dir)
    target = to_db_columns(c).withColumn("ingested_at", F.lit(fixture.LOAD_TIME).cast("timestamp_ntz"))
    feed = to_db_columns(fixture.upsert_feed(c)).withColumn("ingested_at", F.lit(fixture.FEED_TIME).cast("timestamp_ntz"))
    table = BucketedTable(spark, f"{run_folder(spark, 'bucketed')}/table")
    table.create(target, "customer_id", buckets=64)
    table.upsert(feed, keep_first=["ingested_at"])
    return table.read().withColumn("monthly_charges", C.r6("monthly_charges")).withColumn("total_charges", C.r6("total_charges"))
