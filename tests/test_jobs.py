"""Bucketed upserts, sparse encoding, late rows and the offline scoring job."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from retentio.operators import encode, models, quality, score_job, sparse
from retentio.operators.bucketed import BucketedTable
from retentio.session import delete_folder, folder_names
from retentio.streaming import late
from retentio.streaming import stream as ST

ROW = "id string, a int, b string, seen string"


def people(spark, ids, tag):
    return spark.createDataFrame([(str(k), k % 7, None if k % 5 == 0 else f"{tag}{k}", tag) for k in ids], ROW)


def same(x, y):
    return sorted(map(str, x.collect())) == sorted(map(str, y.select(*x.columns).collect()))


def test_bucketed_rewrites_touched_buckets_only(spark, tmp_path):
    table = BucketedTable(spark, f"{tmp_path}/t")
    base = people(spark, range(3_000), "old")
    table.create(base, "id", 100)
    table.create(people(spark, range(5), "again"), "id", 100)  # there already: nothing happens
    feed = people(spark, [17], "new")
    m = table.upsert(feed, keep_first=["seen"])
    data = f"{tmp_path}/t/data"
    assert [n for n in folder_names(spark, f"{data}/v={1:012d}") if "=" in n] == [f"bucket__={b}" for b, v in m["folders"].items() if v == 1]
    assert sum(v == 1 for v in m["folders"].values()) == 1 and len(m["folders"]) == 100
    want = quality.upsert(base, feed, "id", keep_first=["seen"])
    assert same(table.read(), want)
    assert same(table.read(0), base)
    assert table.vacuum(keep=1) == 1 and same(table.read(), want)


def test_bucketed_replay_and_crash(spark, tmp_path, monkeypatch):
    table = BucketedTable(spark, f"{tmp_path}/t")
    base, first, second = people(spark, range(200), "x"), people(spark, range(150, 260), "y"), people(spark, range(255, 300), "z")
    table.create(base, "id", 8)
    table.upsert(first, feed="f", batch=0)
    assert table.upsert(people(spark, range(9), "no"), feed="f", batch=0)["version"] == 1
    # a crash after the data and before the manifest
    with monkeypatch.context() as c:
        c.setattr(BucketedTable, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError):
            table.upsert(second, feed="f", batch=1)
    merged = quality.upsert(base, first, "id")
    assert same(table.read(), merged)
    # and one while the manifest is written: no success marker
    table.upsert(second, feed="f", batch=1)
    os.remove(f"{tmp_path}/t/manifest/v={2:012d}/_SUCCESS")
    assert same(table.read(), merged)
    table.upsert(second, feed="f", batch=1)
    assert same(table.read(), quality.upsert(merged, second, "id")) and table.versions() == [0, 1, 2]
    assert table.upsert(second.where("false"), feed="f", batch=2)["version"] == 3 and table.read().count() == 300


def test_sparse_encodes_many_categories(spark):
    n = 200_000
    rows = spark.range(n).select(F.col("id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("v"), "id")).alias("c"),
                                 F.when(F.col("id") % 4 == 0, None).otherwise(F.col("id") % 2).cast("string").alias("d"), (F.col("id") % 10).cast("double").alias("x"))
    state = encode.fit_encoder(rows, ["c", "d"], ["x"], exclude=["id"])
    assert isinstance(state, sparse.SparseEncoder)
    kinds = n - (n + 2) // 3 + 1 + 2
    assert state.size == 1 + kinds
    cells = state.cells(rows, "id")
    named = cells.join(state.dictionary(spark).select("index", F.concat_ws("_", "column", "value").alias("feature")), "index").select("id", "feature")
    want = encode.onehot_long(rows, ["c", "d"], "id")
    assert named.count() == want.count() and named.exceptAll(want).isEmpty()
    words = state.dictionary(spark).orderBy("index").select("column", "value", "index").collect()
    assert [r["index"] for r in words] == list(range(1, kinds + 1))
    assert [(r["column"], r["value"]) for r in words] == sorted((r["column"], r["value"]) for r in words)


def test_sparse_equals_wide(spark, monkeypatch, tmp_path):
    r = random.Random(3)
    rows = [(k, r.choice(["p", "q", None]), r.choice(["1", "2", "3"]), r.choice([None, 1.0, 2.5]), float(k)) for k in range(60)]
    train = spark.createDataFrame(rows[:40], "id long, c string, d string, x double, y double")
    test = spark.createDataFrame([*rows[40:], (99, "unseen", None, None, 0.0)], train.schema)
    wide = encode.fit_encoder(train, ["c", "d"], ["x"], exclude=["id"])
    monkeypatch.setattr(encode, "WIDE", 2)
    thin = encode.fit_encoder(train, ["c", "d"], ["x"], exclude=["id"])
    assert isinstance(wide, encode.EncoderState) and isinstance(thin, sparse.SparseEncoder)
    thin.save(spark, f"{tmp_path}/e")
    for state in (thin, models.load_encoder(spark, f"{tmp_path}/e")):
        got = {x.id: [round(v, 9) + 0.0 for v in x.features.toArray()] for x in state.vector(test, ["id"]).collect()}
        assert got == {x.id: [round(v, 9) + 0.0 for v in x.features.toArray()] for x in wide.vector(test, ["id"]).collect()}
    assert not state.vector(test.where("id = 99"), ["id"]).first().features.toArray()[2:].any()
    assert thin.vector(test.where("false"), ["id"]).count() == 0


def test_model_on_sparse_vectors(spark, monkeypatch, tmp_path):
    rows = [(str(k), "abcdefgh"[k % 8], float(k % 5), int(k % 8 < 4)) for k in range(240)]
    train = spark.createDataFrame(rows, "customerID string, Contract string, tenure double, Churn int")
    monkeypatch.setattr(encode, "WIDE", 3)
    m = models.train_churn(train, "lr", categorical=["Contract"], numerical=["tenure"])
    assert isinstance(m.encoder, sparse.SparseEncoder)
    back = models.FittedModel.load(spark, m.save(spark, f"{tmp_path}/m"))
    for model in (m, back):
        got = models.score_churn(model, train).collect()
        assert sum((x.churn_probability >= 0.5) == bool(int(x.customerID) % 8 < 4) for x in got) == 240
    assert len(m.importances()) == 9


def test_late_rows_are_kept_and_merged(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [(k, start + dt.timedelta(hours=k), 0.1 * (k % 10), 1.0) for k in range(24 * 30)]
    log = spark.createDataFrame(rows, "id long, predicted_at timestamp, churn_probability double, ltv_prediction double")
    late.arrive(late.delayed(log, "predicted_at", "id", slices=10, late_by=3, share=9), f"{tmp_path}/source", slices=10)
    for _ in range(2):  # the second run finds nothing new
        late.split_late(spark, f"{tmp_path}/source", log.schema, f"{tmp_path}/rows", f"{tmp_path}/split", "predicted_at", "1 day", "1 hour")
    stored = spark.read.schema(log.schema.add("batch", "integer").add("late", "integer")).parquet(f"{tmp_path}/rows")
    assert stored.count() == len(rows) and stored.where("late = 1").count() > 20
    stream = ST.file_stream(spark, f"{tmp_path}/rows/batch=*/late=0", log.select("id", "predicted_at", "churn_probability", "ltv_prediction").schema, files_per_trigger=1)
    q = ST._run(ST.activity(stream, watermark="1 hour").writeStream.outputMode("update").foreachBatch(
        lambda b, k: b.write.mode("overwrite").parquet(f"{tmp_path}/sink/epoch={k}")).option("checkpointLocation", f"{tmp_path}/checkpoint"), "late_test")
    states = [p["stateOperators"][0] for p in q.recentProgress if p["stateOperators"]]
    # windows behind the watermark leave the state, and no row that the split passed on is dropped
    assert sum(s["numRowsRemoved"] for s in states) > 50 and max(s["numRowsTotal"] for s in states) < 40
    assert sum(s["numRowsDroppedByWatermark"] for s in states) == 0
    plain = log.select("id", "predicted_at", "churn_probability", "ltv_prediction")
    windows = ST.latest_windows(spark, f"{tmp_path}/sink")
    fixed = late.corrected(windows, f"{tmp_path}/rows", plain.schema, ST.activity, "predicted_at", "1 day")
    want = ST.activity(plain)
    assert same(fixed, want) and not same(windows.select(*fixed.columns), want)


def test_score_job_goes_on_after_a_kill(spark, tmp_path):
    rows = spark.createDataFrame([(str(k), k / 100) for k in range(100)], "customerID string, p double")
    labels = spark.createDataFrame([(str(k), k % 2) for k in range(90)], "customerID string, actual_churn int")
    score_job.stage(rows, f"{tmp_path}/source", parts=8)
    calls = []

    def score(part, broken=False):
        calls.append(part)
        if broken and len(calls) == 3:
            raise RuntimeError("killed")
        p = F.col("p")
        return part.select("customerID", "part", p.alias("churn_probability"), (p >= 0.5).cast("int").alias("churn_prediction"), (p * 1000 / 7).alias("ltv_prediction"))

    whole = score_job.run(spark, f"{tmp_path}/source", labels, score, f"{tmp_path}/whole", 8, 2)
    calls.clear()
    with pytest.raises(RuntimeError):
        score_job.run(spark, f"{tmp_path}/source", labels, lambda d: score(d, True), f"{tmp_path}/out", 8, 2)
    # what a killed group left behind is replaced by its retry
    delete_folder(spark, f"{tmp_path}/out/done/group=2")
    calls.clear()
    got = score_job.run(spark, f"{tmp_path}/source", labels, score, f"{tmp_path}/out", 8, 2)
    assert len(calls) == 3 and same(got, whole) and got.count() == 100
    assert score_job.run(spark, f"{tmp_path}/source", labels, score, f"{tmp_path}/out", 8, 2).count() == 100 and len(calls) == 3
    by_id = {r.customerID: r for r in got.collect()}
    assert (by_id["70"].risk_tier, by_id["69"].risk_tier, by_id["39"].risk_tier) == ("HIGH", "MEDIUM", "LOW")
    assert by_id["95"].actual_churn is None and by_id["10"].predicted_ltv == 14.29
