import pytest
from pyspark.sql import functions as F

from retentio.operators.encode import fit_encoder, EncoderState
from retentio.operators import split as SP


def test_encoder_alignment_rules(spark, tmp_path):
    train = spark.createDataFrame([("a", 1.0, 5.0), ("b", 3.0, 5.0), (None, 2.0, 5.0)],
                                  "cat string, num double, const double")
    st = fit_encoder(train, ["cat"], ["num", "const"])
    assert st.feature_columns == ["num", "const", "cat_a", "cat_b"]
    score = spark.createDataFrame([("c", 2.0, 6.0), ("a", None, 5.0)], "cat string, num double, const double")
    out = st.transform(score).collect()
    # unseen category -> all zeros; constant column keeps x - mean (std falls back to 1.0)
    assert (out[0]["cat_a"], out[0]["cat_b"]) == (0.0, 0.0)
    assert out[0]["const"] == 1.0 and out[0]["num"] == 0.0
    # missing numeric -> training mean -> 0 after scaling
    assert out[1]["num"] == 0.0 and out[1]["cat_a"] == 1.0
    # absent column at scoring -> 0
    assert st.transform(score.drop("cat")).first()["cat_a"] == 0.0
    # round trip of the fit state
    st.save(spark, str(tmp_path / "enc"))
    assert EncoderState.load(spark, str(tmp_path / "enc")) == st


def test_auto_encodes_extra_text_columns(spark):
    df = spark.createDataFrame([("x", "g1", 1)], "cat string, tenure_group string, tenure int")
    st = fit_encoder(df, ["cat"], ["tenure"])
    assert st.feature_columns == ["tenure", "cat_x", "tenure_group_g1"]


def _ids(n):
    return [(str(i), i % 3) for i in range(n)]


def test_hash_split_is_layout_independent(spark):
    df = spark.createDataFrame(_ids(500), "id string, y int")
    a = {r["id"]: r["split"] for r in SP.assign_split(df, "id").collect()}
    b = {r["id"]: r["split"] for r in SP.assign_split(df.repartition(7).orderBy(F.rand()), "id").collect()}
    assert a == b and set(a.values()) == {"train", "test"}


def test_exact_and_stratified_split_counts(spark):
    df = spark.createDataFrame(_ids(501), "id string, y int")
    ex = SP.assign_split(df, "id", exact=True)
    assert ex.where("split = 'train'").count() == round(0.8 * 501)
    st = SP.assign_split(df, "id", stratify="y").groupBy("y", "split").count().collect()
    got = {(r["y"], r["split"]): r["count"] for r in st}
    for y in range(3):
        n = sum(1 for _, yy in _ids(501) if yy == y)
        assert got[(y, "train")] == round(0.8 * n) and got[(y, "train")] + got[(y, "test")] == n
    train, test = SP.train_test(df, "id", exact=True)
    assert train.join(test, "id").count() == 0 and train.count() + test.count() == 501
    assert SP.complement(df, train, "id").count() == test.count()


def test_sample_k(spark):
    df = spark.createDataFrame(_ids(50), "id string, y int")
    assert SP.sample_k(df, "id", 1200).count() == 50
    a = [r["id"] for r in SP.sample_k(df, "id", 10).collect()]
    b = [r["id"] for r in SP.sample_k(df.repartition(4), "id", 10).collect()]
    assert a == b and len(a) == 10


def test_exact_split_edges(spark):
    rows = [(str(i), None if i % 4 == 0 else "a") for i in range(41)] + [(None, "b"), ("7", "one")]
    df = spark.createDataFrame(rows, "id string, y string")
    got = {(r["y"], r["split"]): r["count"] for r in SP.assign_split(df, "id", stratify="y").groupBy("y", "split").count().collect()}
    assert got[(None, "train")] == round(0.8 * 11) and got[("a", "train")] == round(0.8 * 30)
    assert got[("b", "train")] == 1 and got[("one", "train")] == 1 and sum(got.values()) == 43
    assert SP.assign_split(df.where("false"), "id", exact=True).count() == 0
    assert SP.assign_split(df, "id", exact=True, test_size=1.0).where("split = 'train'").count() == 0
    # the ranks by hash, brute force
    import hashlib
    ids = [str(i) for i in range(200)]
    split = {r["id"]: r["split"] for r in SP.assign_split(spark.createDataFrame([(i,) for i in ids], "id string"), "id", exact=True).collect()}
    ranked = sorted(ids, key=lambda i: (hashlib.md5(f"42:{i}".encode()).hexdigest(), i))
    assert {i for i in ids if split[i] == "train"} == set(ranked[:160])
