"""Streaming forms equal their batch forms; replays do not duplicate output."""

from pyspark.sql import functions as F

from retentio.operators.bucketed import BucketedTable
from retentio.operators.clean import to_db_columns
from retentio.operators.quality import upsert
from retentio.plans import common as C
from retentio.sources import fixture
from retentio.streaming import stream as ST


def _rows(df, cols=None):
    cols = cols or sorted(df.columns)
    return sorted((tuple(r) for r in df.select(*cols).collect()),
                  key=lambda t: tuple((v is None, str(v)) for v in t))


def _stream_of(spark, df, run):
    ST.stage_files(df, f"{run}/source", files=4)
    return ST.file_stream(spark, f"{run}/source", df.schema, files_per_trigger=1)


def test_activity_and_tier_kpis_stream_equal_batch(spark, sf):
    log = C.log(spark, sf)
    run = ST.run_folder(spark, "t-activity")
    ST.window_stream(ST.activity(_stream_of(spark, log, run), watermark="3650 days"), f"{run}/sink", f"{run}/ckpt", "t_act")
    streamed = ST.latest_windows(spark, f"{run}/sink")
    flat = lambda d: d.select(F.col("w.start").alias("start"), "churn_risk_tier", "predictions",
                              F.round("avg_probability", 9).alias("p"))
    assert _rows(flat(streamed)) == _rows(flat(ST.activity(log)))

    run2 = ST.run_folder(spark, "t-tiers")
    ST.aggregate_stream(ST.tier_kpis(_stream_of(spark, log, run2)), f"{run2}/sink", f"{run2}/ckpt", "t_tier")
    r9 = lambda d: d.select("churn_risk_tier", "customers", F.round("avg_ltv", 6).alias("l"),
                            F.round("avg_churn_probability", 9).alias("p"))
    assert _rows(r9(ST.latest_version(spark, f"{run2}/sink"))) == _rows(r9(ST.tier_kpis(log)))


def test_upsert_stream_equals_batch_and_replay_is_idempotent(spark, sf):
    c = C.customers(spark, sf)
    target = to_db_columns(c).withColumn("ingested_at", F.lit(fixture.LOAD_TIME).cast("timestamp_ntz"))
    feed = to_db_columns(fixture.upsert_feed(c)).withColumn(
        "ingested_at", F.lit(fixture.FEED_TIME).cast("timestamp_ntz"))
    batch = upsert(target, feed, "customer_id", keep_first=["ingested_at"])

    run = ST.run_folder(spark, "t-upsert")
    table = BucketedTable(spark, f"{run}/table")
    table.create(target, "customer_id", buckets=16)
    stream = _stream_of(spark, feed, run)
    ST.upsert_stream(spark, stream, table, f"{run}/ckpt", keep_first=["ingested_at"])
    first = table.read()
    assert _rows(first) == _rows(batch)
    # a restart on the same checkpoint finds nothing new and leaves the table as it was
    ST.upsert_stream(spark, ST.file_stream(spark, f"{run}/source", feed.schema), table, f"{run}/ckpt", keep_first=["ingested_at"])
    assert _rows(table.read()) == _rows(batch)


def test_score_stream_appends_each_row_once(spark, sf):
    feats = C.features(spark, sf)
    run = ST.run_folder(spark, "t-score")
    score = lambda b: b.select("customerID", (F.col("tenure") / 100).alias("churn_probability"))
    ST.score_stream(_stream_of(spark, feats, run), score, f"{run}/sink", f"{run}/ckpt")
    ST.score_stream(ST.file_stream(spark, f"{run}/source", feats.schema), score, f"{run}/sink", f"{run}/ckpt")
    out = spark.read.parquet(f"{run}/sink")
    assert out.count() == feats.count()
    assert out.select("customerID").distinct().count() == feats.count()
    assert set(out.columns) >= {"model_version", "predicted_at", "batch_id"}


def test_activity_drops_rows_behind_the_watermark(spark):
    run = ST.run_folder(spark, "t-late")
    schema = "predicted_at timestamp, churn_probability double"
    # Spark holds a batch's rows against the watermark that its predecessor began with
    for rows in ([("2024-04-01 10:00:00", 0.9)], [("2024-04-01 11:00:00", 0.9)], [("2024-02-01 10:00:00", 0.9), ("2024-04-02 10:00:00", 0.9)]):
        df = spark.createDataFrame(rows, "at string, churn_probability double")
        df.select(F.col("at").cast("timestamp").alias("predicted_at"), "churn_probability").coalesce(1).write.mode("append").parquet(f"{run}/source")
    stream = ST.file_stream(spark, f"{run}/source", schema, files_per_trigger=1)
    ST.window_stream(ST.activity(stream), f"{run}/sink", f"{run}/ckpt", "t_late")
    got = ST.latest_windows(spark, f"{run}/sink").select(F.date_format("w.start", "MM-dd").alias("d"), "predictions").collect()
    assert sorted((r.d, r.predictions) for r in got) == [("04-01", 2), ("04-02", 1)]


def test_versions_keep_a_current_one(spark):
    run = ST.run_folder(spark, "t-version")
    for k in (0, 1, 1):
        ST.write_version(spark, spark.range(k + 1), run, k)
    assert ST.latest_version(spark, run).count() == 2
