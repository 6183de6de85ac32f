import math

import pytest
from pyspark.sql import functions as F

SAMPLE = {
    "customerID": "K-77", "gender": "Male", "SeniorCitizen": 1, "Partner": "No", "Dependents": "Yes", "tenure": 31,
    "PhoneService": "Yes", "MultipleLines": "Yes", "InternetService": "Fiber optic", "OnlineSecurity": "No",
    "OnlineBackup": "Yes", "DeviceProtection": "Yes", "TechSupport": "No", "StreamingTV": "Yes", "StreamingMovies": "No",
    "Contract": "One year", "PaperlessBilling": "No", "PaymentMethod": "Mailed check",
    "MonthlyCharges": 88.4, "TotalCharges": "2740.4", "Churn": None,
}


@pytest.fixture(scope="module")
def fitted(spark, sf):
    from retentio.plans import common as C
    from retentio.operators import split as SP, models as M
    f = C.features(spark, sf)
    train, test = SP.train_test(f, "customerID")
    train = train.persist()
    return {"train": train, "test": test,
            "rf": M.train_churn(train, "rf", numTrees=10),
            "lr": M.train_churn(train, "lr", maxIter=50),
            "ltv": M.train_ltv(train, "gbt", maxIter=5)}


def _records(spark, n):
    from retentio.sources.files import records_frame
    from retentio.operators.clean import clean
    from retentio.operators.features import create_features
    rows = [dict(SAMPLE, customerID=f"ID-{i}") for i in range(n)]
    return create_features(clean(records_frame(spark, rows), impute="zero"))


def test_single_and_batch_scoring(spark, fitted):
    from retentio.operators import models as M
    one = M.score_customers(fitted["rf"], fitted["ltv"], _records(spark, 1)).collect()
    assert len(one) == 1 and 0.0 <= one[0]["churn_probability"] <= 1.0
    assert one[0]["churn_prediction"] in (0, 1) and one[0]["churn_risk_tier"] in ("LOW", "MEDIUM", "HIGH")
    two = M.score_customers(fitted["rf"], fitted["ltv"], _records(spark, 2).repartition(2)).collect()
    assert len(two) == 2 and two[0]["churn_probability"] == two[1]["churn_probability"]


def test_train_score_parity_and_save_load(spark, fitted, tmp_path):
    from retentio.operators import models as M
    test = fitted["test"]
    together = {r["customerID"]: r["churn_probability"] for r in M.score_churn(fitted["rf"], test).collect()}
    first = test.orderBy("customerID").limit(3)
    alone = {r["customerID"]: r["churn_probability"] for r in M.score_churn(fitted["rf"], first).collect()}
    for k, v in alone.items():
        assert together[k] == pytest.approx(v)
    path = fitted["rf"].save(spark, str(tmp_path / "m"))
    loaded = M.FittedModel.load(spark, path)
    again = {r["customerID"]: r["churn_probability"] for r in M.score_churn(loaded, first).collect()}
    assert again == pytest.approx(alone)


def test_mock_and_refusal(spark):
    from retentio.operators import models as M
    df = _records(spark, 1)
    assert M.score_churn(None, df, allow_mock=True).first()["churn_probability"] == 0.15
    with pytest.raises(RuntimeError):
        M.score_churn(None, df)


def test_ltv_model_never_sees_target(fitted):
    cols = fitted["ltv"].encoder.feature_columns
    assert not {"TotalCharges", "charge_ratio", "charges_difference"} & set(cols)


def test_linear_attributions_sum_to_logit(spark, fitted):
    from retentio.operators import explain as EX, models as M
    m = fitted["lr"]
    attr = EX.linear_attributions(m, fitted["train"], fitted["test"])
    sums = attr.groupBy("customerID").agg((F.sum("phi") + F.first("base")).alias("logit"))
    probs = M.score_churn(m, fitted["test"]).select("customerID", "churn_probability")
    for r in sums.join(probs, "customerID").collect():
        assert 0.5 * (1 + math.tanh(r["logit"] / 2)) == pytest.approx(r["churn_probability"], abs=1e-6)


def test_type_guard(spark):
    from retentio.sources.files import records_frame
    with pytest.raises(TypeError):
        records_frame(spark, [99999])


def test_entry_and_registry(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() > 0
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 80


def test_raw_record_scores_alike_alone_and_in_a_batch(spark, fitted, tmp_path):
    from dataclasses import replace
    from retentio.operators import models as M
    from retentio.sources.files import records_frame
    rows = [dict(SAMPLE, customerID=f"R-{k}", TotalCharges=" " if k == 0 else str(100.0 * k)) for k in range(4)]
    churn = replace(fitted["lr"], median=1400.5)
    batch = {r["customerID"]: r for r in M.score_raw(churn, fitted["ltv"], records_frame(spark, rows)).collect()}
    alone = M.score_raw(churn, fitted["ltv"], records_frame(spark, rows[:1])).first()
    assert len(batch) == 4 and alone == batch["R-0"]
    filled = M.score_raw(churn, fitted["ltv"], records_frame(spark, [dict(rows[0], TotalCharges="1400.5")])).first()
    assert filled == alone
    back = M.FittedModel.load(spark, churn.save(spark, str(tmp_path / "m")))
    assert back.median == 1400.5
    with pytest.raises(ValueError):
        M.score_raw(fitted["lr"], fitted["ltv"], records_frame(spark, rows))
