"""The grid search fits no setting more often than it must, and judges each fit straight from its trees (round 4, F1)."""

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from retentio.operators import evaluate as EV
from retentio.operators import forest as FO
from retentio.operators import models as M
from retentio.schemas import CATEGORICAL
from retentio.session import storage_memory


def _train(spark, n=60):
    names = [F.element_at(F.array(F.lit("Yes"), F.lit("No")), (F.col("id") % k % 2 + 1).cast("int")).alias(c) for k, c in enumerate(CATEGORICAL, 2)]
    return spark.range(n).select(F.col("id").cast("string").alias("customerID"), *names, (F.col("id") % 7).cast("int").alias("tenure"),
                                 (F.col("id") % 11).cast("double").alias("MonthlyCharges"), (F.col("id") % 3 % 2).cast("int").alias("Churn"))


@pytest.fixture
def fits(monkeypatch):
    """Rounds of all fits, which are made up: ``fits.curve`` gives the AUC of each round on a held-out fold."""
    class Fits(list):
        curve = None
    seen = Fits()

    def staged_auc(scored, by):
        fold, rounds = scored.select("fold", F.size("margins")).first()
        rows = [(fold, k + 1, float(seen.curve(k + 1))) for k in range(rounds)]
        return scored.sparkSession.createDataFrame(rows, "fold int, iteration int, roc_auc double")

    def refit(train, kind, median=None, long_tasks=False, **params):
        assert long_tasks
        seen.append(("refit", params["maxIter"]))
        return params

    monkeypatch.setattr(M.MC.GBTClassifier, "fit", lambda self, data: seen.append(self.getMaxIter()) or self)
    monkeypatch.setattr(M, "staged_margins", lambda model, rows: rows.withColumn("margins", F.array_repeat(F.lit(0.0), model.getMaxIter())))
    monkeypatch.setattr(M, "staged_auc", staged_auc)
    monkeypatch.setattr(M, "train_churn", refit)
    return seen


GRID = {"maxDepth": [4], "maxIter": [100, 200], "stepSize": [0.1]}


def test_a_curve_that_rises_to_its_end_is_fitted_in_full_at_once(spark, fits):
    fits.curve = lambda k: k / 1000
    _, told = M.grid_search(_train(spark), GRID)
    assert fits == [40, 200, 200, 200, ("refit", 200)]  # 40, 80, 160 and 200 rounds of every fold before
    assert [r["best_iteration"] for r in told] == [100, 200]
    assert [r["mean_auc"] for r in told] == pytest.approx([0.1, 0.2])


def test_a_curve_that_stops_early_is_fitted_once_for_each_fold(spark, fits):
    fits.curve = lambda k: 0.9 - abs(k - 7) / 100
    _, told = M.grid_search(_train(spark), GRID)
    assert fits == [40, 40, 40, ("refit", 7)]
    assert [r["best_iteration"] for r in told] == [7, 7] and [r["mean_auc"] for r in told] == pytest.approx([0.9, 0.9])


def test_a_curve_that_has_passed_its_best_is_fitted_with_twice_as_many(spark, fits):
    fits.curve = lambda k: 0.9 - abs(k - 26) / 100
    _, told = M.grid_search(_train(spark), GRID)
    assert fits == [40, 80, 80, 80, ("refit", 26)] and told[1]["best_iteration"] == 26


def test_rounds_that_follow_a_curve():
    rising, passed = list(range(40)), [*range(25), *[0] * 15]
    assert FO.next_rounds(rising, 40, 200, 20) == 200
    assert FO.next_rounds(passed, 40, 200, 20) == 80 and FO.next_rounds(passed, 40, 60, 20) == 60
    assert FO.next_rounds([], 40, 200, 20) == 80


def test_fits_side_by_side_follow_tasks_and_memory(spark):
    gb = 1 << 30
    assert M._side_by_side(4, 8, 8, gb, 64 * gb) == 4
    assert M._side_by_side(4, 8, 1, gb, 64 * gb) == 8  # a fit of one task leaves cores idle
    assert M._side_by_side(4, 8, 8, 2 * gb, 5 * gb) == 2
    assert M._side_by_side(4, 8, 8, 9 * gb, 5 * gb) == 1  # and 1 where not even one fits
    assert M._side_by_side(4, 8, 0, 0, gb) == 8  # no rows
    assert storage_memory(spark) > 0


def test_the_last_fit_has_fewer_and_longer_tasks(spark, monkeypatch):
    monkeypatch.setattr(M, "ROWS_PER_TASK", 10)
    monkeypatch.setattr(M, "LONG_ROWS_PER_TASK", 25)
    tasks = {n: [M._dealt(_train(spark, n), "gbt", long).rdd.getNumPartitions() for long in (False, True)] for n in (40, 150, 300)}
    assert tasks == {40: [4, 4], 150: [15, 8], 300: [30, 12]}


def _fitted(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 3))
    y = (x[:, 0] * x[:, 1] + rng.normal(scale=0.4, size=300) > 0).astype(int)
    points = spark.createDataFrame([(i, int(b), Vectors.dense(a)) for i, (a, b) in enumerate(zip(x, y))], ["id", "label", "features"])
    return points, GBTClassifier(maxIter=5, maxDepth=4, seed=1).fit(points)


def test_margins_are_computed_once_and_never_written(spark):
    points, model = _fitted(spark)
    scored = FO.staged_margins(model, points).withColumn("fold", F.pmod("id", F.lit(2)))
    out = FO.staged_auc(scored, ["fold"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") + plan.count("BatchEvalPython") == 1  # once more in a filter and in the names before
    long = scored.select("fold", "label", F.posexplode("margins").alias("at", "m")).withColumn("iteration", F.col("at") + 1)
    want = EV.compare_models(long, ["fold", "iteration"], "label", "m").select("fold", "iteration", "n", "roc_auc")
    assert {tuple(r) for r in out.collect()} == {tuple(r) for r in want.collect()}


def test_rows_without_margins_and_null_margins(spark):
    rows = [(0, 1, [0.2, 0.9]), (0, 0, [0.1, None]), (0, 1, None), (0, 0, []), (0, 1, [None]), (0, None, [5.0, 5.0]), (1, 1, [0.5]), (1, 0, [0.5])]
    scored = spark.createDataFrame(rows, "fold int, label int, margins array<double>").coalesce(1)
    for size in (1, 100):
        got = {tuple(r) for r in FO.staged_auc(scored, ["fold"], range_rows=size).collect()}
        # fold 0, first tree: 0.2 and null are positive, 0.1 is negative
        assert got == {(0, 1, 3, 0.5), (0, 2, 2, 1.0), (1, 1, 2, 0.5)}


def test_repeated_margins_are_sent_with_counts():
    held, counts = FO._counted(np.array([2.0, -0.0, 2.0, 0.0, 2.0]))
    assert held.tolist() == [0.0, 2.0] and counts.tolist() == [2, 3]
    held, counts = FO._counted(np.array([2.0, 1.0, 3.0]))
    assert held.tolist() == [1.0, 2.0, 3.0] and not len(counts)
    assert [len(a) for a in FO._counted(np.empty(0))] == [0, 0]
    met, before = FO._met([held.tobytes(), np.array([0.0, 2.0]).tobytes()], [b"", np.array([4, 5]).tobytes()])
    assert met.tolist() == [0.0, 1.0, 2.0, 2.0, 3.0] and before.tolist() in ([0, 4, 5, 6, 11, 12], [0, 4, 5, 10, 11, 12])


def test_walking_reaches_the_leaves_of_an_uneven_tree():
    tree = {"feature": np.array([0, 0, 1, 0, 0]), "threshold": np.array([0.5, 0, 0.25, 0, 0]), "left": np.array([1, -1, 3, -1, -1]),
            "right": np.array([2, -1, 4, -1, -1]), "value": np.array([0, 1.0, 0, 2.0, 3.0])}
    walk = FO.walkable(tree)
    x = np.array([[0.5, 9.0], [0.6, 0.25], [0.6, 0.3], [np.nan, 0.0], [0.7, np.nan]])
    assert walk["levels"] == 2 and FO.leaf_values(x, walk).tolist() == [1.0, 2.0, 3.0, 2.0, 3.0]
    leaf = FO.walkable({k: v[1:2] for k, v in tree.items()})
    assert leaf["levels"] == 0 and FO.leaf_values(x, leaf).tolist() == [1.0] * 5
