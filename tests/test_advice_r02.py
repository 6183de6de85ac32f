import math

import pytest
from pyspark.sql import functions as F

from retentio.operators.encode import fit_encoder
from retentio.schemas import CATEGORICAL, NUMERICAL_WIDE
from retentio.sources import files as FS


def test_aligned_matrix_has_every_training_column(spark, sf):
    import __spark_entry__ as E

    rows = E.queries()["aligned_matrix_wide"](spark, sf).collect()
    ids, names = {r["customerID"] for r in rows}, {r["feature"] for r in rows}
    assert len(rows) == len(ids) * len(names) and {0.0, 1.0} <= {r["value"] for r in rows}
    assert set(NUMERICAL_WIDE) <= names
    assert all(any(n.startswith(f"{c}_") for n in names) for c in [*CATEGORICAL, "tenure_group"])


def test_long_alignment_fills_and_drops(spark):
    train = spark.createDataFrame([("1", "a", 1.0), ("2", "b", 3.0)], "id string, cat string, num double")
    test = spark.createDataFrame([("3", "c", None, "x"), ("4", "a", 2.0, "x")], "id string, cat string, num double, extra string")
    state = fit_encoder(train, ["cat"], ["num"], exclude=["id"])
    got = {(r["id"], r["feature"]): r["value"] for r in state.long(test, "id").collect()}
    assert got == {("3", "num"): 0.0, ("3", "cat_a"): 0.0, ("3", "cat_b"): 0.0, ("4", "num"): 0.0, ("4", "cat_a"): 1.0, ("4", "cat_b"): 0.0}
    assert {r["value"] for r in state.long(test.drop("cat"), "id").where("feature like 'cat%'").collect()} == {0.0}


def test_batch_guards_reject(spark, tmp_path):
    row = [{"customerID": str(k), "tenure": 1, "Churn": "No"} for k in range(3)]
    path = str(tmp_path / "b.csv")
    FS.records_frame(spark, row).write.option("header", True).csv(path)
    assert FS.read_batch_csv(spark, path, 3).count() == 3
    with pytest.raises(ValueError, match="exceeds 2 rows"):
        FS.read_batch_csv(spark, path, 2)
    with pytest.raises(ValueError, match="only .csv"):
        FS.read_batch_csv(spark, str(tmp_path / "b.txt"))
    FS.records_frame(spark, row).where("false").write.json(str(tmp_path / "j"))
    with pytest.raises(ValueError, match="empty batch"):
        FS.read_batch_json(spark, str(tmp_path / "j"))


def test_survey_units_are_registered():
    import __spark_entry__ as E

    assert {"hist_total", "kde_total", "kde_tenure", "box_tenure_by_churn", "csv_batch", "json_batch", "stored_splits", "dashboard_load"} <= set(E.oracle_sql())
    assert "tree_attribution_waterfall" in E.queries()


def test_booster_waterfall_adds_up_to_its_log_odds(spark, sf, monkeypatch):
    from retentio.operators import models as M
    from retentio.plans import q_models as Q

    fit = M.train_churn
    monkeypatch.setattr(Q, "_CACHE", {})
    monkeypatch.setattr(M, "train_churn", lambda *a, **kw: fit(*a, **{**kw, "maxIter": 5, "maxDepth": 3}))
    rows = Q.tree_attribution_waterfall(spark, sf).collect()
    top = Q._test_scores(spark, sf, "gbt").orderBy(F.desc("__p"), "customerID").first()
    p = top["__p"]
    assert {r["customerID"] for r in rows} == {top["customerID"]}
    assert sum(r["phi"] for r in rows) == pytest.approx(math.log(p / (1 - p)), abs=1e-6)
