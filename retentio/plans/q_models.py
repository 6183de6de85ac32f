"""Model training, scoring and attribution queries (rows-only checks).

Models are fitted on the hash split's train rows of the full derived table
and evaluated on its test rows. Fitted models are memoised per session and
data folder so dependent queries (importance, scoring, attributions) reuse
one fit instead of training again.
"""

from __future__ import annotations

from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import evaluate as EV
from ..operators import explain as EX
from ..operators import models as M
from ..operators import split as SP
from ..operators.clean import clean, training_median
from ..operators.features import create_features
from ..session import cut_lineage
from . import common as C
from .catalog import register

_CACHE: dict = {}


def _splits(spark, sf_dir):
    """(train, test, median): the fill value comes from the training rows only."""
    key = (id(spark), sf_dir, "splits")
    if key not in _CACHE:
        raw_train, raw_test = SP.train_test(C.raw(spark, sf_dir), "customerID")
        median = training_median(raw_train).first()["median"]  # one row
        _CACHE[key] = (*(create_features(clean(part, median=median)).persist() for part in (raw_train, raw_test)), median)
    return _CACHE[key]


def _model(spark, sf_dir, task: str, kind: str, **overrides):
    key = (id(spark), sf_dir, task, kind, tuple(sorted(overrides.items())))
    if key not in _CACHE:
        train, _, median = _splits(spark, sf_dir)
        fit = M.train_churn if task == "churn" else M.train_ltv
        _CACHE[key] = fit(train, kind, median=median, **overrides)
    return _CACHE[key]


def _fit_together(spark, sf_dir, *wanted: tuple[str, str]) -> list:
    """The models of (task, kind) pairs, fitted side by side: a boosted fit leaves most of a cluster idle between its jobs."""
    _splits(spark, sf_dir)
    with ThreadPool(len(wanted)) as pool:
        return pool.starmap(lambda task, kind: _model(spark, sf_dir, task, kind), wanted)


def _test_scores(spark, sf_dir, kind: str, **overrides):
    _, test, _ = _splits(spark, sf_dir)
    m = _model(spark, sf_dir, "churn", kind, **overrides)
    s = M.score_churn(m, test)
    return s.select("customerID", F.col("Churn").alias("label"),
                    F.round("churn_probability", 4).alias("churn_probability"),
                    F.col("churn_prediction").alias("prediction"), F.col("churn_probability").alias("__p"))


def _top_risk(spark, sf_dir, kind: str):
    """The feature row of the test customer with the highest score, written once: only it is explained."""
    _, test, _ = _splits(spark, sf_dir)
    top = _test_scores(spark, sf_dir, kind).orderBy(F.desc("__p"), "customerID").limit(1)
    return cut_lineage(test.join(F.broadcast(top.select("customerID")), "customerID", "left_semi"))  # one row


@register("churn_lr")
def churn_lr(spark, sf_dir):
    """MDL5: logistic regression (MLlib optimiser, no regularisation)."""
    return _test_scores(spark, sf_dir, "lr").drop("__p")


@register("churn_rf_stumps")
def churn_rf_stumps(spark, sf_dir):
    """MDL6: 100 bagged depth-1 trees on sqrt(features)."""
    return _test_scores(spark, sf_dir, "rf").drop("__p")


@register("churn_gbt")
def churn_gbt(spark, sf_dir):
    """MDL1/MDL3: boosted trees with the reference settings (100 x depth 6, lr 0.1)."""
    return _test_scores(spark, sf_dir, "gbt").drop("__p")


@register("churn_gbt_baseline")
def churn_gbt_baseline(spark, sf_dir):
    """MDL7: the depth-4 baseline booster."""
    return _test_scores(spark, sf_dir, "gbt", maxDepth=M.BASELINE_GBT_DEPTH).drop("__p")


@register("ltv_gbt")
def ltv_gbt(spark, sf_dir):
    """MDL2/MDL4: spend regressor; test rows with actual, predicted and residual."""
    _, test, _ = _splits(spark, sf_dir)
    m = _model(spark, sf_dir, "ltv", "gbt")
    s = M.score_ltv(m, test)
    return s.select("customerID", F.col("TotalCharges").alias("actual"),
                    F.round("ltv_prediction", 2).alias("predicted"),
                    F.round(F.col("ltv_prediction") - F.col("TotalCharges"), 2).alias("residual"))


@register("ltv_metrics")
def ltv_metrics(spark, sf_dir):
    """EVL6 on the spend model's test predictions."""
    s = ltv_gbt(spark, sf_dir)
    return EV.regression_metrics(s, "actual", "predicted").select(*[C.r6(c) for c in ("mae", "mse", "rmse", "r2")])


@register("model_comparison")
def model_comparison(spark, sf_dir):
    """MDL9: label metrics and ROC-AUC of all models on the same test rows, in one job over the stacked scores."""
    models = (("LogisticRegression", "lr"), ("RandomForestStumps", "rf"), ("GBT", "gbt"))
    _fit_together(spark, sf_dir, *(("churn", kind) for _, kind in models))
    stacked = [_test_scores(spark, sf_dir, kind).withColumn("model", F.lit(name)) for name, kind in models]
    m = EV.compare_models(reduce(DataFrame.unionByName, stacked), ["model"], "label", "__p", "prediction")
    return m.select("model", "n", *[C.r6(c) for c in ("accuracy", "precision", "recall", "f1", "roc_auc")])


@register("feature_importance")
def feature_importance(spark, sf_dir):
    """MDL10 / TOP1: the 15 most important features of the churn booster."""
    m = _model(spark, sf_dir, "churn", "gbt")
    imp = spark.createDataFrame(m.importances(), "feature string, importance double")
    return imp.orderBy(F.desc("importance"), "feature").limit(15)


@register("score_customers")
def score_customers(spark, sf_dir):
    """SCO3/SCO4: every customer scored by both models, tiered, with the true label."""
    churn, ltv = _fit_together(spark, sf_dir, ("churn", "gbt"), ("ltv", "gbt"))
    raw = C.raw(spark, sf_dir)
    s = M.score_raw(churn, ltv, raw)
    return s.join(C.labelled(spark, sf_dir).select("customerID", F.col("Churn").alias("actual_churn")), "customerID")


@register("linear_attributions")
def linear_attributions(spark, sf_dir):
    """EXP1 (linear): exact per-row attributions of the logistic model, long form."""
    train, test, _ = _splits(spark, sf_dir)
    m = _model(spark, sf_dir, "churn", "lr")
    return EX.linear_attributions(m, train, test)


@register("mean_abs_attribution")
def mean_abs_attribution(spark, sf_dir):
    """EXP2 / TOP2: mean |attribution| per feature, top 15."""
    return EX.mean_abs_attribution(linear_attributions(spark, sf_dir))


@register("attribution_waterfall")
def attribution_waterfall(spark, sf_dir):
    """EXP3: base value, 12 largest contributions and the rest for the top-risk customer."""
    train, _, _ = _splits(spark, sf_dir)
    top = _top_risk(spark, sf_dir, "lr")
    return EX.waterfall(cut_lineage(EX.linear_attributions(_model(spark, sf_dir, "churn", "lr"), train, top)), top)


@register("churn_cv")
def churn_cv(spark, sf_dir):
    """MDL8: 3-fold grid search (depth x trees x rate) with early stopping after 20 rounds; one row per setting."""
    train, _, median = _splits(spark, sf_dir)
    best, results = M.grid_search(train, median=median)
    key = (id(spark), sf_dir, "churn", "cv")
    _CACHE[key] = best
    top = max(results, key=lambda r: r["mean_auc"])
    rows = [(r["params"]["maxDepth"], r["params"]["maxIter"], float(r["params"]["stepSize"]), r["best_iteration"],
             r["mean_auc"], r is top) for r in results]
    return spark.createDataFrame(rows, "max_depth int, max_iter int, step_size double, best_iteration int, "
                                       "mean_auc double, is_best boolean")


@register("tree_attributions")
def tree_attributions(spark, sf_dir):
    """EXP1/EXP4 (trees): exact path-dependent attributions of the churn booster, long form."""
    from ..operators.tree_explain import tree_attributions as TA
    _, test, _ = _splits(spark, sf_dir)
    return TA(_model(spark, sf_dir, "churn", "gbt"), test)


@register("mean_abs_tree_attribution")
def mean_abs_tree_attribution(spark, sf_dir):
    """EXP2 (trees): mean |attribution| per feature of the booster, top 15."""
    return EX.mean_abs_attribution(tree_attributions(spark, sf_dir))


@register("tree_attribution_waterfall")
def tree_attribution_waterfall(spark, sf_dir):
    """EXP3 (trees): base value, 12 largest contributions and the rest for the booster's top-risk customer."""
    from ..operators.tree_explain import tree_attributions as TA
    top = _top_risk(spark, sf_dir, "gbt")
    return EX.waterfall(cut_lineage(TA(_model(spark, sf_dir, "churn", "gbt"), top)), top)
