import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from retentio.operators.quantile import exact_quantiles, exact_median
from retentio.operators.ordered import global_running_sum, global_row_number
from pyspark.sql import functions as F


def _np_q(values, p):
    return float(np.quantile(np.asarray(values, dtype=float), p)) if len(values) else None


def test_grouped_quantiles_match_numpy(spark):
    rng = np.random.default_rng(1)
    rows = []
    for g in ("a", "b", "c"):
        vals = rng.normal(size=400).round(3).tolist()
        if g == "b":
            vals += [5.0] * 300  # one hot value holding a large share of the group
        rows += [(g, float(v)) for v in vals]
    rows += [("d", None), ("e", 1.0)]
    df = spark.createDataFrame(rows, "g string, x double")
    probs = [0.0, 0.25, 0.5, 0.75, 1.0]
    got = {r["g"]: r for r in exact_quantiles(df, "x", probs, ["g"]).collect()}
    for g in ("a", "b", "c", "e"):
        vals = [v for gg, v in rows if gg == g and v is not None]
        for i, p in enumerate(probs):
            assert got[g][f"q_{i}"] == pytest.approx(_np_q(vals, p), abs=1e-9)
    assert got["d"]["q_0"] is None


def test_global_median(spark):
    vals = [float(v) for v in range(1, 1002)] + [7.5] * 50
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    r = exact_median(df, "x").first()["median"]
    assert r == pytest.approx(float(np.median(vals)))
    assert exact_median(df.limit(0), "x").first()["median"] is None


def test_two_valued_group_is_not_shuffled_whole(spark):
    df = spark.range(20_000).selectExpr("if(id % 2 = 0, null, 'k') g", "cast(id % 7919 as double) x")
    q = exact_quantiles(df, "x", [0.5], ["g"])
    assert "SortMergeJoin" not in q._jdf.queryExecution().toString()  # one row per group is broadcast by its size
    ids = np.arange(20_000)
    assert {r["g"]: r["q_0"] for r in q.collect()} == {
        None: float(np.median(ids[::2] % 7919)), "k": float(np.median(ids[1::2] % 7919))}


@settings(max_examples=5, deadline=None)
@given(st.lists(st.integers(-50, 50), min_size=1, max_size=60))
def test_median_property(spark, xs):
    df = spark.createDataFrame([(float(x),) for x in xs], "x double")
    got = exact_quantiles(df, "x", [0.5]).first()["q_0"]
    assert got == pytest.approx(float(np.median(xs)))


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_global_running_sum_is_partition_independent(spark, parts):
    data = [(i, float(i % 7)) for i in range(200)]
    df = spark.createDataFrame(data, "k long, v double").repartition(5)
    out = global_running_sum(df, [F.col("k")], ["v"], partitions=parts).orderBy("k").collect()
    expect = np.cumsum([v for _, v in data])
    assert [r["cum_v"] for r in out] == pytest.approx(list(expect))
    rn = global_row_number(df, [F.col("k").desc()], partitions=parts).orderBy("k").collect()
    assert [r["row_number"] for r in rn] == list(range(200, 0, -1))
