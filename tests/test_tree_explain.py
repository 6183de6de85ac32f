import itertools
import math

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import GBTRegressor

from retentio.operators.tree_explain import ensemble_paths, shap_batch


def _cond_exp(nodes_paths, x, S, weights):
    """Brute-force E[f | x_S] with cover weighting, from the leaf paths."""
    total = 0.0
    for leaves, w in zip(nodes_paths, weights):
        for leaf in leaves:
            p = leaf.value * w
            for feat, tests, r in zip(leaf.features, leaf.tests, leaf.ratios):
                if feat in S:
                    ok = all(((x[feat] <= t) if not cat else (x[feat] in t)) == left for t, left, cat in tests)
                    p *= 1.0 if ok else 0.0
                else:
                    p *= r
            total += p
    return total


def test_tree_shap_matches_brute_force_shapley(spark):
    rng = np.random.default_rng(0)
    rows = []
    for _ in range(300):
        a, b, c = rng.integers(0, 5, size=3).astype(float)
        rows.append((Vectors.dense([a, b, c]), float(a * 2 + (b > 2) * 3 + a * (c > 1))))
    df = spark.createDataFrame(rows, ["features", "label"])
    model = GBTRegressor(maxIter=4, maxDepth=3, stepSize=0.5, seed=1).fit(df)
    trees, weights = ensemble_paths(spark, model)
    xs = np.array([[0.0, 4.0, 2.0], [3.0, 1.0, 0.0], [4.0, 4.0, 4.0]])
    phi, base = shap_batch(xs, trees, weights)
    d = 3
    for r, x in enumerate(xs):
        for i in range(d):
            others = [j for j in range(d) if j != i]
            expect = 0.0
            for k in range(d):
                for S in itertools.combinations(others, k):
                    w = math.factorial(k) * math.factorial(d - k - 1) / math.factorial(d)
                    expect += w * (_cond_exp(trees, x, set(S) | {i}, weights) - _cond_exp(trees, x, set(S), weights))
            assert phi[r, i] == pytest.approx(expect, abs=1e-9)
        pred = model.predict(Vectors.dense(x))
        assert phi[r].sum() + base == pytest.approx(pred, abs=1e-9)


def test_rows_look_their_pattern_up_and_long_paths_are_worked_out(monkeypatch):
    """Short paths are worked out once per leaf and not per batch; the values are those worked out row by row (F6, F10)."""
    from retentio.operators import tree_explain as TE

    rng = np.random.default_rng(3)

    def leaf(m):
        tests = [[(float(rng.normal()), bool(rng.integers(2)), False) for _ in range(int(rng.integers(1, 3)))] for _ in range(m)]
        return TE.LeafPath(float(rng.normal()), list(map(int, rng.permutation(9)[:m])), tests, list(rng.uniform(0.1, 0.9, m)))

    trees, weights, x = [[leaf(m) for m in (0, 1, 3, 6, 8)] for _ in range(3)], [1.0, 0.1, 0.1], rng.normal(size=(50, 9))
    tables, worked, whole = TE.shap_tables(trees, weights, 2.0), [], TE._leaf_phi
    monkeypatch.setattr(TE, "_leaf_phi", lambda leaf, v, z: worked.append(len(leaf.features)) or whole(leaf, v, z))
    phi, base = shap_batch(x, trees, weights, 2.0, tables)
    assert worked == [8, 8, 8]
    monkeypatch.setattr(TE, "TABLE_FEATURES", -1)
    plain, plain_base = shap_batch(x, trees, weights, 2.0)
    assert np.array_equal(phi, plain) and base == plain_base
    empty, _ = shap_batch(x[:0], trees, weights, 2.0, tables)
    assert empty.shape == (0, 9)
