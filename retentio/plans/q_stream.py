"""Streaming queries: each runs a Structured Streaming job over files staged
from the given tables (availableNow trigger) and returns the sink's result,
which must equal the batch computation (same oracle SQL where one exists)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.bucketed import BucketedTable
from ..operators.clean import to_db_columns
from ..operators.segment import add_tier
from ..sources import fixture
from ..sources.prediction_log import PredictionLog
from ..streaming import late as LT
from ..streaming import stream as ST
from . import common as C
from .catalog import register
from .oracle_sql import with_log, with_scores
from .q_quality import _UPSERT_SQL, _upsert_body
from .oracle_sql import with_clean

_ACTIVITY_SQL = with_log("""
SELECT strftime(date_trunc('day', predicted_at), '%Y-%m-%d %H:%M:%S') AS window_start,
       CASE WHEN churn_probability >= 0.65 THEN 'HIGH' WHEN churn_probability >= 0.35 THEN 'MEDIUM'
            ELSE 'LOW' END AS churn_risk_tier,
       COUNT(*) AS predictions, ROUND(AVG(CAST(churn_probability AS DECIMAL(20,12))), 6) AS avg_probability
FROM lg GROUP BY 1, 2""")


def _activity_out(df):
    return df.select(F.date_format(F.col("w.start"), "yyyy-MM-dd HH:mm:ss").alias("window_start"),
                     "churn_risk_tier", "predictions", C.r6("avg_probability"))


@register("prediction_activity", _ACTIVITY_SQL)
def prediction_activity(spark, sf_dir):
    """STR2 (batch form): predictions per day and tier."""
    return _activity_out(ST.activity(C.log(spark, sf_dir)))


@register("stream_activity", _ACTIVITY_SQL)
def stream_activity(spark, sf_dir):
    """STR2: windows of a stream with a short watermark, and a recompute of those that late rows hit.

    The log arrives in slices of event time; one row in twenty comes two slices late.
    """
    run = ST.run_folder(spark, "activity")
    log = C.log(spark, sf_dir)
    LT.arrive(LT.delayed(log, "predicted_at", "id", slices=6, late_by=2, share=20), f"{run}/source", slices=6)
    LT.split_late(spark, f"{run}/source", log.schema, f"{run}/rows", f"{run}/split", ts="predicted_at", window="1 day", delay="1 hour")
    stream = ST.file_stream(spark, f"{run}/rows/batch=*/late=0", log.schema, files_per_trigger=64)
    ST.window_stream(ST.activity(stream, watermark="1 hour"), f"{run}/sink", f"{run}/checkpoint", "stream_activity")
    windows = ST.latest_windows(spark, f"{run}/sink")
    return _activity_out(LT.corrected(windows, f"{run}/rows", log.schema, ST.activity, ts="predicted_at", window="1 day"))


@register("stream_tier_kpis", with_log("""
SELECT CASE WHEN churn_probability >= 0.65 THEN 'HIGH' WHEN churn_probability >= 0.35 THEN 'MEDIUM'
            ELSE 'LOW' END AS churn_risk_tier,
       COUNT(*) AS customers, ROUND(AVG(CAST(ltv_prediction AS DECIMAL(20,12))), 6) AS avg_ltv,
       ROUND(AVG(CAST(churn_probability AS DECIMAL(20,12))), 6) AS avg_churn_probability
FROM lg GROUP BY 1"""))
def stream_tier_kpis(spark, sf_dir):
    """STR3: live per-tier KPIs maintained from a stream of log files."""
    run = ST.run_folder(spark, "tiers")
    log = C.log(spark, sf_dir)
    ST.stage_files(log, f"{run}/source")
    stream = ST.file_stream(spark, f"{run}/source", log.schema)
    ST.aggregate_stream(ST.tier_kpis(stream), f"{run}/sink", f"{run}/checkpoint", "stream_tier_kpis")
    out = ST.latest_version(spark, f"{run}/sink")
    return out.select("churn_risk_tier", "customers", C.r6("avg_ltv"), C.r6("avg_churn_probability"))


@register("stream_upsert", with_clean(f"WITH {_UPSERT_SQL}\n{_upsert_body()}"))
def stream_upsert(spark, sf_dir):
    """STR4: the customer feed applied batch by batch; the final table equals the batch upsert."""
    run = ST.run_folder(spark, "upsert")
    c = C.customers(spark, sf_dir)
    target = to_db_columns(c).withColumn("ingested_at", F.lit(fixture.LOAD_TIME).cast("timestamp_ntz"))
    feed = to_db_columns(fixture.upsert_feed(c)).withColumn(
        "ingested_at", F.lit(fixture.FEED_TIME).cast("timestamp_ntz"))
    table = BucketedTable(spark, f"{run}/table")
    table.create(target, "customer_id", buckets=64)
    ST.stage_files(feed, f"{run}/source")
    stream = ST.file_stream(spark, f"{run}/source", feed.schema)
    ST.upsert_stream(spark, stream, table, f"{run}/checkpoint", keep_first=["ingested_at"])
    return table.read().withColumn("monthly_charges", C.r6("monthly_charges")) \
        .withColumn("total_charges", C.r6("total_charges"))


@register("stream_scores")
def stream_scores(spark, sf_dir):
    """STR1: raw customer records arriving as files are scored and appended to the log, batch-idempotent."""
    from ..operators import models as M
    from .q_models import _fit_together
    churn, ltv = _fit_together(spark, sf_dir, ("churn", "gbt"), ("ltv", "gbt"))
    run = ST.run_folder(spark, "scores")
    raw = C.raw(spark, sf_dir)
    ST.stage_files(raw, f"{run}/source")
    stream = ST.file_stream(spark, f"{run}/source", raw.schema)
    log = ST.score_stream(stream, lambda b: M.score_raw(churn, ltv, b), PredictionLog(spark, f"{run}/log"), f"{run}/checkpoint")
    return log.read().drop("predicted_at")


@register("stream_log_ids", with_scores("""
SELECT COUNT(*) AS n, COUNT(DISTINCT "customerID") AS customers, COUNT(*) AS ids, CAST(1 AS BIGINT) AS first_id, COUNT(*) AS last_id,
       ROUND(CAST(SUM(CAST(churn_probability AS DECIMAL(6,4))) AS DOUBLE), 4) AS probability_sum FROM sc"""))
def stream_log_ids(spark, sf_dir):
    """STR1 / SNK2: scores arriving in several micro-batches, then a replayed one; ids run from 1 without gap or repeat."""
    run = ST.run_folder(spark, "log-ids")
    scores = add_tier(C.scores(spark, sf_dir))
    ST.stage_files(scores, f"{run}/source", files=6)
    stream = ST.file_stream(spark, f"{run}/source", scores.schema, files_per_trigger=2)
    log = ST.score_stream(stream, lambda b: b, PredictionLog(spark, f"{run}/log"), f"{run}/checkpoint", name="log_ids")
    log.append(scores, "2.0.0", feed="log_ids", batch=1)
    return log.read().agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("customer_id").alias("customers"), F.countDistinct("id").alias("ids"),
        F.min("id").alias("first_id"), F.max("id").alias("last_id"),
        F.round(F.sum("churn_probability").cast("double"), 4).alias("probability_sum"))
