"""Staged evaluation, early stopping, votes of stumps, and models compared in one job."""

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from retentio.operators import evaluate as EV
from retentio.operators import forest as FO
from retentio.operators import models as M
from retentio.plans import common as C
from retentio.operators.clean import clean
from retentio.operators.features import create_features


def _brute_auc(y, p):
    wins = [1.0 if a > b else 0.5 if a == b else 0.0
            for a, ya in zip(p, y) if ya for b, yb in zip(p, y) if not yb]
    if 1 not in y:
        return 0.0
    return sum(wins) / len(wins) if wins else 1.0


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(240, 4))
    y = (x[:, 0] + x[:, 1] * x[:, 2] + rng.normal(scale=0.7, size=240) > 0).astype(float)
    rows = [(i, float(b), Vectors.dense(a)) for i, (a, b) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, ["id", "label", "features"]).repartition(3).persist()


def _gbt(rounds):
    return GBTClassifier(maxIter=rounds, maxDepth=3, subsamplingRate=0.8, featureSubsetStrategy="0.8", seed=42)


def test_margins_after_every_tree_are_those_of_shorter_models(points):
    """The last margin is the model's own, and a prefix of the trees is the model of so many rounds."""
    long = FO.staged_margins(_gbt(6).fit(points), points).select("id", "margins")
    for rounds in (2, 6):
        short = _gbt(rounds).fit(points).transform(points).select("id", "probability")
        for r in long.join(short, "id").collect():
            assert len(r["margins"]) == 6
            assert 1 / (1 + np.exp(-2 * r["margins"][rounds - 1])) == pytest.approx(r["probability"][1], abs=1e-9)


def test_best_iteration_equals_a_search_over_prefixes(points):
    model = _gbt(8).fit(points)
    held = points.where("id % 3 = 0")
    scored = FO.staged_margins(model, held).withColumn("fold", F.lit(0))
    curve = [r["roc_auc"] for r in FO.staged_auc(scored, ["fold"]).orderBy("iteration").collect()]
    rows = scored.collect()
    brute = [_brute_auc([r["label"] for r in rows], [r["margins"][k] for r in rows]) for k in range(8)]
    assert curve == pytest.approx(brute)
    assert FO.best_round(curve, 20) == (int(np.argmax(brute)) + 1, False)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 6), min_size=1, max_size=40), st.integers(1, 8))
def test_best_round_stops_by_patience(curve, patience):
    best, stopped = FO.best_round(curve, patience)
    end = next((t for t in range(len(curve)) if t - curve[:t + 1].index(max(curve[:t + 1])) >= patience), None)
    seen = curve if end is None else curve[:end + 1]
    assert (best, stopped) == (seen.index(max(seen)) + 1, end is not None)


def test_votes_of_stumps_are_counted(points):
    model = RandomForestClassifier(numTrees=15, maxDepth=1, featureSubsetStrategy="sqrt", seed=1).fit(points)
    got = {r["id"]: r["churn_probability"] for r in FO.vote_share(model, points).select("id", "churn_probability").collect()}
    for r in points.collect():
        assert got[r["id"]] == pytest.approx(sum(t.predict(r["features"]) for t in model.trees) / 15)
    deeper = RandomForestClassifier(numTrees=2, maxDepth=3, seed=1).fit(points)
    with pytest.raises(ValueError):
        FO.vote_share(deeper, points)
    one_class = points.withColumn("label", F.lit(0.0)).where("id < 40")
    single = RandomForestClassifier(numTrees=3, maxDepth=1, seed=1).fit(one_class.union(points.where("id < 0")))
    assert {r[0] for r in FO.vote_share(single, points).select("churn_probability").collect()} == {0.0}


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.sampled_from([0, 1, 1, None]), st.integers(0, 4)), min_size=1, max_size=60))
def test_all_groups_in_one_job_equal_each_alone(spark, rows):
    df = spark.createDataFrame([(m, y, s / 4, int(s >= 2)) for m, y, s in rows], "model string, label int, score double, prediction int")
    got = {r["model"]: r for r in EV.compare_models(df, ["model"], prediction="prediction").collect()}
    for m in {m for m, y, _ in rows if y is not None}:
        mine = [(y, s / 4, int(s >= 2)) for k, y, s in rows if k == m and y is not None]
        tp = sum(y == 1 and p == 1 for y, _, p in mine)
        assert got[m]["n"] == len(mine)
        assert got[m]["roc_auc"] == pytest.approx(_brute_auc([y for y, _, _ in mine], [s for _, s, _ in mine]))
        assert got[m]["accuracy"] == pytest.approx(sum(y == p for y, _, p in mine) / len(mine))
        said = sum(p for _, _, p in mine)
        assert got[m]["precision"] == pytest.approx(tp / said if said else 0.0)
    assert len(got) == len({m for m, y, _ in rows if y is not None})


def test_grid_search_shares_fits_and_keeps_the_first_of_equals(spark, sf):
    raw = C.raw(spark, sf)
    train = create_features(clean(raw, median=1000.0)).persist()
    grid = {"maxDepth": [2], "maxIter": [3, 6], "stepSize": [0.1]}
    model, told = M.grid_search(train, grid, patience=2, first_rounds=2, median=1000.0)
    assert [r["params"]["maxIter"] for r in told] == [3, 6]
    assert all(1 <= r["best_iteration"] <= r["params"]["maxIter"] for r in told)
    assert told[1]["mean_auc"] >= told[0]["mean_auc"]  # the longer setting holds the shorter one's curve
    best = max(told, key=lambda r: r["mean_auc"])
    assert model.params["maxIter"] == best["best_iteration"] == model.model.getNumTrees
    # the staged refit gives the same curve whatever the first number of rounds is
    _, again = M.grid_search(train, grid, patience=2, first_rounds=6, median=1000.0)
    assert [r["mean_auc"] for r in again] == pytest.approx([r["mean_auc"] for r in told])
