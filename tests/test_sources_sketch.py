"""Positions, request folders, table definitions, sketches and the one-group quantile search."""

import os
import random

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from retentio.operators import report as R
from retentio.operators import sketch as SK
from retentio.operators.quantile import exact_quantiles, values_at
from retentio.sources import files as FS
from retentio.sources import positions as POS
from retentio.sources import table_def as TD

SCHEMA = "customerID string, tenure int, note string"


def _placed(spark, folder):
    from pyspark.sql.types import StructType
    return POS.read_placed_csv(spark, folder, StructType.fromDDL(SCHEMA))


def test_positions_follow_the_lines_over_blocks_and_files(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    lines = []
    for name, n in (("a.csv", 400), ("b.csv", 1), ("c.csv", 0), ("d.csv", 250)):
        rows = [f"{'' if i % 3 == 0 else f'{name}-{i}'},{'x' if i % 40 == 39 else i % 5},same" for i in range(n)]
        (folder / name).write_text("customerID,tenure,note\n" + "\n\n".join(rows) + "\n")  # blank lines have no place
        lines += [(name, i, row) for i, row in enumerate(rows)]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")   # many blocks a file, several a task
    try:
        placed = _placed(spark, str(folder)).cache()
        got = {r["position"]: r for r in placed.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted(got) == list(range(len(lines)))
    for place, (name, i, row) in enumerate(lines):
        r = got[place]
        assert os.path.basename(r["source_file"]) == name and r["file_row"] == i
        assert (r["customerID"] or "") == row.split(",")[0]
        assert (r["_corrupt_record"] == row) if ",x," in row else r["_corrupt_record"] is None
    good, bad = POS.split_corrupt(placed)
    assert good.count() + bad.count() == len(lines) and bad.count() == sum(",x," in row for _, _, row in lines)
    assert {(os.path.basename(r["source_file"]), r["n_rows"], r["n_corrupt"]) for r in POS.corrupt_counts(placed).collect()} == {
        (f, sum(x == f for x, _, _ in lines), sum(x == f and ",x," in row for x, _, row in lines)) for f in ("a.csv", "b.csv", "d.csv")}
    named = POS.positional_ids(placed, "customerID").collect()
    assert len({r["customerID"] for r in named}) == len(lines)
    assert all(r["customerID"] == f"TEMP_{r['position']}" for r in named if got[r["position"]]["customerID"] is None)
    no_column = POS.positional_ids(placed.drop("customerID"), "customerID", "CUST_").agg(F.min("customerID")).first()[0]
    assert no_column == "CUST_0"


def test_positions_of_an_empty_folder_of_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("customerID,tenure,note\n")
    assert _placed(spark, str(tmp_path)).count() == 0


def test_request_folder_takes_or_refuses_whole_files(spark, tmp_path):
    head = ",".join(f.name for f in FS.RAW_SUBSCRIBER.fields) + "\n"
    line = ",".join(["7"] * len(FS.RAW_SUBSCRIBER.fields)) + "\n"
    sub = tmp_path / "request=2"
    sub.mkdir()
    (tmp_path / "ok.csv").write_text(head + line * 3)
    (sub / "long.csv").write_text(head + line * 4)
    (tmp_path / "empty.csv").write_text(head)
    (tmp_path / "other.txt").write_text(head + line)
    rows, verdicts = FS.read_batch_folder(spark, str(tmp_path), ".csv", 3)
    got = {os.path.basename(r["request_file"]): (r["n_rows"], r["verdict"]) for r in verdicts.collect()}
    assert got == {"ok.csv": (3, "ok"), "long.csv": (4, "too long"), "empty.csv": (0, "empty"), "other.txt": (0, "wrong type")}
    assert [os.path.basename(r["request_file"]) for r in rows.collect()] == ["ok.csv"] * 3


def _customer_rows(spark, rows):
    return spark.createDataFrame(rows, "customer_id string, senior_citizen int, tenure int, monthly_charges double, churn int, extra int")


def test_load_fills_defaults_and_counts(spark, tmp_path):
    path, table = str(tmp_path / "t"), TD.customers()
    assert table.load(_customer_rows(spark, [("a", 0, 3, 10.005, 1, 9), ("b", None, None, None, None, 9)]), path) == 2
    stored = spark.read.parquet(path)
    assert stored.columns == table.schema.fieldNames()
    rows = {r["customer_id"]: r for r in stored.collect()}
    assert all(r["ingested_at"] is not None for r in rows.values()) and str(rows["a"]["monthly_charges"]) == "10.01"
    given_time = _customer_rows(spark, [("a", 0, 3, 1.0, 1, 9)]).withColumn("ingested_at", F.lit("2024-01-01").cast("timestamp"))
    assert table.conform(given_time).first()["ingested_at"].year == 2024
    assert table.load(_customer_rows(spark, []), path) == 0


@pytest.mark.parametrize("rows, rule", [
    ([("a", 2, 1, 1.0, 0, 0)], "senior_citizen"), ([("a", 0, -1, 1.0, 0, 0)], "tenure"), ([("a", 0, 1, 1.0, 5, 0)], "churn"),
    ([(None, 0, 1, 1.0, 0, 0)], "missing key"), ([("a", 0, 1, 1.0, 0, 0)] * 2, "repeated keys")])
def test_load_refuses_what_the_definition_forbids(spark, tmp_path, rows, rule):
    path = str(tmp_path / "t")
    TD.customers().load(_customer_rows(spark, [("old", 0, 1, 1.0, 0, 0)]), path)
    with pytest.raises(ValueError, match=rule):
        TD.customers().load(_customer_rows(spark, rows), path)
    assert [r["customer_id"] for r in spark.read.parquet(path).collect()] == ["old"]


def test_guards_on_empty_results(spark):
    df = _customer_rows(spark, [("a", 1, 3, 10.0, 1, 0)]).select(
        F.col("churn").alias("Churn"), F.col("monthly_charges").alias("MonthlyCharges"), F.col("senior_citizen").alias("SeniorCitizen"))
    senior = {"s": R.dashboard_filter(senior_only=True), "none": F.col("Churn") > 5, "null": F.lit(None).cast("boolean")}
    got = {r["filter_name"]: (r["n"], r["status"], r["churn_rate"]) for r in R.guarded_kpis(df, senior).collect()}
    assert got == {"s": (1, "ok", 100.0), "none": (0, R.NO_MATCH, None), "null": (0, R.NO_MATCH, None)}
    assert {r["n"] for r in R.guarded_kpis(df.limit(0), senior).collect()} == {0}
    assert R.non_empty(df) is df
    with pytest.raises(ValueError, match="no customers"):
        R.non_empty(df.where("Churn > 5"))


def test_merged_daily_sketches_stay_below_the_rank_error(spark, tmp_path):
    rows = spark.range(200_000).select(
        F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 40).cast("int").alias("day"),   # a third in one day
        F.when(F.col("id") % 1000 == 0, F.lit(float("nan"))).when(F.col("id") % 1000 == 1, None)
        .otherwise(F.pow(F.rand(3), 3) * 1000).alias("x"))
    rows.write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    store = SK.SketchStore(spark, str(tmp_path / "sk"))
    store.write(rows, "x")
    store.write(rows.where("day in (1, 7)"), "x")        # days written again replace their own
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]
    values = sorted(r[0] for r in rows.where("x is not null and not isnan(x)").select("x").collect())
    got = store.quantiles(probs).first()
    assert got["n"] == len(values)
    import bisect
    for i, p in enumerate(probs):
        v = got[f"q_{i}"]
        lo, hi = bisect.bisect_left(values, v) / len(values), bisect.bisect_right(values, v) / len(values)
        assert lo - SK.RANK_ERROR <= p <= hi + SK.RANK_ERROR
    some = store.quantiles([0.5], first=5, last=9).first()
    assert some["n"] == rows.where("day between 5 and 9 and x is not null and not isnan(x)").count()


def test_sketches_of_nothing(spark):
    df = spark.createDataFrame([("a", None), ("b", float("nan"))], "g string, x double")
    sk = SK.sketches(df, "x", ["g"])
    assert {(r["g"], r["n"], r["sketch"]) for r in sk.collect()} == {("a", 0, None), ("b", 0, None)}
    for stored in (sk, sk.limit(0)):
        assert tuple(SK.merged_quantiles(stored, [0.5]).first()) == (0, None)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(1, 400), st.integers(1, 300), st.randoms(use_true_random=False))
def test_search_by_sketch_finds_the_ranked_values(spark, n, distinct, rnd):
    values = [float(rnd.randrange(distinct)) for _ in range(n)] + [0.0] * (n // 3)   # a third of the rows ties
    ranks = {0, len(values) - 1, len(values) // 2, rnd.randrange(len(values))}
    df = spark.createDataFrame([(v,) for v in values], "x double")
    ordered = sorted(values)
    assert values_at(df, len(values), ranks, left=8) == {r: ordered[r] for r in ranks}


def test_one_group_quantiles_equal_spark_percentile(spark):
    rnd = random.Random(5)
    df = spark.createDataFrame([(rnd.choice([None, float("nan"), -1.5, rnd.random()]),) for _ in range(999)], "x double")
    probs = [0.0, 0.1, 0.5, 0.9, 1.0]
    want = df.where("not isnan(x)").agg(F.percentile("x", F.array(*[F.lit(p) for p in probs]))).first()[0]
    assert list(exact_quantiles(df, "x", probs).first()) == pytest.approx(want, abs=1e-12)
    assert list(exact_quantiles(df.limit(0), "x", probs).first()) == [None] * 5
