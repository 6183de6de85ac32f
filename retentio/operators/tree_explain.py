"""Exact path-dependent tree attributions for MLlib tree ensembles (EXP1, trees).

The fitted ensemble is read from MLlib's own persistence format (one row per
node: split feature/threshold, children, weighted count). Its size is
bounded by trees x 2^depth nodes, so it is broadcast to the tasks.

For one leaf with value v, let P be the distinct features on its path. For a
coalition S of features, the leaf's share of the expected prediction is
``v * prod_{j in S} z_j(x) * prod_{j not in S} r_j``, with z_j the indicator
that x follows the path at every node splitting on j, and r_j the product of
the cover ratios (child count / parent count) at those nodes. The tree's
value function is the sum over leaves, so its Shapley values are the sum of
each leaf's Shapley values; for a leaf (a product game) feature i gets

    v * (z_i - r_i) * sum_k c_k * k! (m - k - 1)! / m!,

where c_k sums, over coalitions of size k of the other m - 1 path features,
the product of their z (in) and r (out) factors (a short dynamic program).
The z of a short path take few patterns, so this runs once per leaf and
pattern, and a row only looks its pattern up. This equals path-dependent tree
SHAP (Lundberg et al., 2018). Everything is vectorised over the rows of an
Arrow batch inside ``mapInPandas``.

For GBT classifiers the margin is ``sum_t w_t tree_t(x)`` and MLlib's
probability is ``sigmoid(2 * margin)``, so attributions are reported in
log-odds: they plus ``base`` sum to ``logit(p)``.
"""

from __future__ import annotations

import math
import os
import uuid
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import ID_COL
from ..session import checkpoint_dir


#: distinct features of a path up to which a leaf's attributions are looked up, 64 rows of doubles each
TABLE_FEATURES = 6


@dataclass
class LeafPath:
    value: float
    # per distinct feature: list of (threshold or categories, goes_left, is_categorical), ratio product
    features: list[int]
    tests: list[list[tuple]]
    ratios: list[float]


def _tree_paths(nodes: dict[int, dict]) -> list[LeafPath]:
    out: list[LeafPath] = []

    def walk(nid: int, path: list[tuple]):
        n = nodes[nid]
        if n["leftChild"] < 0:
            feats: dict[int, list] = {}
            ratio: dict[int, float] = {}
            for feat, test, left, cat, r in path:
                feats.setdefault(feat, []).append((test, left, cat))
                ratio[feat] = ratio.get(feat, 1.0) * r
            keys = list(feats)
            out.append(LeafPath(n["prediction"], keys, [feats[k] for k in keys], [ratio[k] for k in keys]))
            return
        split = n["split"]
        feat = split["featureIndex"]
        cat = split["numCategories"] >= 0
        test = tuple(split["leftCategoriesOrThreshold"]) if cat else split["leftCategoriesOrThreshold"][0]
        parent = max(n["cover"], 1e-300)
        for child, left in ((n["leftChild"], True), (n["rightChild"], False)):
            walk(child, path + [(feat, test, left, cat, nodes[child]["cover"] / parent)])

    walk(0, [])
    return out


def ensemble_paths(spark: SparkSession, model) -> tuple[list[list[LeafPath]], list[float]]:
    """Leaf paths of every tree plus the tree weights (bounded by the model size)."""
    path = os.path.join(checkpoint_dir(spark), "models", f"explain-{uuid.uuid4().hex[:12]}")
    model.write().overwrite().save(path)
    rows = (spark.read.parquet(os.path.join(path, "data"))
            .select("treeID", "nodeData.id", "nodeData.prediction", "nodeData.leftChild",
                    "nodeData.rightChild", "nodeData.split",
                    F.element_at("nodeData.impurityStats", 1).alias("cover")).collect())
    trees: dict[int, dict[int, dict]] = {}
    for r in rows:
        trees.setdefault(r["treeID"], {})[r["id"]] = {
            "prediction": r["prediction"], "leftChild": r["leftChild"], "rightChild": r["rightChild"],
            "split": r["split"].asDict(), "cover": float(r["cover"] or 0.0)}
    weights = list(getattr(model, "treeWeights", [1.0] * len(trees)))
    return [_tree_paths(trees[t]) for t in sorted(trees)], weights


def _shapley_weights(m: int) -> np.ndarray:
    return np.array([math.factorial(k) * math.factorial(m - k - 1) / math.factorial(m) for k in range(m)])


def _leaf_phi(leaf: LeafPath, v: float, z: list[np.ndarray]) -> list[np.ndarray]:
    """Per path feature the leaf's attributions, for any number of rows given as indicators ``z`` by path feature."""
    m, r = len(leaf.features), leaf.ratios
    wts = _shapley_weights(m)
    out = []
    for i in range(m):
        c = [np.ones(len(z[0]))]  # c[k]: coalitions of size k among the other features
        for j in range(m):
            if j == i:
                continue
            nxt = [c[0] * r[j]]
            for k in range(1, len(c)):
                nxt.append(c[k] * r[j] + c[k - 1] * z[j])
            nxt.append(c[-1] * z[j])
            c = nxt
        total = sum(ck * wts[k] for k, ck in enumerate(c))
        out.append(v * (z[i] - r[i]) * total)
    return out


def shap_tables(trees: list[list[LeafPath]], weights: list[float], scale: float = 1.0) -> list[list]:
    """``_leaf_phi`` of every leaf for all patterns ``sum_j z_j 2^j`` of up to ``TABLE_FEATURES`` path features, else None."""
    patterns = [[((np.arange(1 << m) >> j) & 1).astype(float) for j in range(m)] for m in range(TABLE_FEATURES + 1)]
    return [[_leaf_phi(leaf, leaf.value * w * scale, patterns[len(leaf.features)])
             if len(leaf.features) <= TABLE_FEATURES else None for leaf in leaves] for leaves, w in zip(trees, weights)]


def shap_batch(x: np.ndarray, trees: list[list[LeafPath]], weights: list[float], scale: float = 1.0,
               tables: list[list] | None = None) -> tuple[np.ndarray, float]:
    """(n x d) attributions and the base value for a batch of feature rows; ``tables`` are those of ``shap_tables``."""
    n, d = x.shape
    cols = np.ascontiguousarray(x.T)
    phi = np.zeros((d, n))
    base = 0.0
    for leaves, w, made in zip(trees, weights, tables or shap_tables(trees, weights, scale)):
        for leaf, table in zip(leaves, made):
            v = leaf.value * w * scale
            if not leaf.features:
                base += v
                continue
            z = []
            for feat, tests in zip(leaf.features, leaf.tests):
                ok = np.ones(n, dtype=bool)
                for test, left, cat in tests:
                    go_left = np.isin(cols[feat], np.asarray(test)) if cat else (cols[feat] <= test)
                    ok &= go_left if left else ~go_left
                z.append(ok)
            base += v * float(np.prod(leaf.ratios))
            if table is None:
                shares = _leaf_phi(leaf, v, [ok.astype(float) for ok in z])
            else:
                pattern = sum(ok.astype(np.intp) << j for j, ok in enumerate(z))
                shares = [t[pattern] for t in table]
            for feat, share in zip(leaf.features, shares):
                phi[feat] += share
    return np.ascontiguousarray(phi.T), base


def tree_attributions(fitted, rows: DataFrame, id_col: str = ID_COL) -> DataFrame:
    """Long (id, feature, value, phi, base) for every row, computed in ``mapInPandas``."""
    spark = rows.sparkSession
    if fitted.kind != "gbt":
        raise NotImplementedError("tree attributions are defined here for boosted trees")
    trees, weights = ensemble_paths(spark, fitted.model)
    # GBT classifier probability = sigmoid(2 * margin): report log-odds contributions
    scale = 2.0 if fitted.task == "churn" and fitted.kind == "gbt" else 1.0
    names = list(fitted.encoder.feature_columns)
    bc = spark.sparkContext.broadcast((trees, weights, names, scale, shap_tables(trees, weights, scale)))
    feats = fitted.features(rows, keep=[id_col]).select(
        F.col(id_col).cast("string").alias(id_col), vector_to_array("features").alias("x"))
    schema = T.StructType([T.StructField(id_col, T.StringType()), T.StructField("feature", T.StringType()),
                           T.StructField("value", T.DoubleType()), T.StructField("phi", T.DoubleType()),
                           T.StructField("base", T.DoubleType())])

    def explain(batches):
        tr, wt, nm, sc, tabs = bc.value
        for pdf in batches:
            if pdf.empty:
                continue
            x = np.vstack(pdf["x"].to_numpy())
            phi, base = shap_batch(x, tr, wt, sc, tabs)
            n, d = phi.shape
            yield pd.DataFrame({id_col: np.repeat(pdf[id_col].to_numpy(), d),
                                "feature": np.tile(np.asarray(nm, dtype=object), n),
                                "value": x.reshape(-1), "phi": phi.reshape(-1),
                                "base": np.full(n * d, base)})

    return feats.mapInPandas(explain, schema)
