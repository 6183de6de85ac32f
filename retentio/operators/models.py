"""Churn and spend models on MLlib (MDL1-10, SNK6-7, SCO1-4).

Training is distributed by MLlib (tree histograms are aggregated across
executors; nothing is collected but the fitted model). The encoder state
(categories, scale stats, column order) travels with the model, so training
and scoring run the exact same feature pipeline, and each model owns its
feature list (the spend model never sees its target or values derived from it).
"""

from __future__ import annotations

import json
import math
import os
from dataclasses import dataclass, field
from itertools import product
from multiprocessing.pool import ThreadPool

from pyspark import StorageLevel
from pyspark.ml import classification as MC
from pyspark.ml import regression as MR
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import risk_tier
from ..schemas import CATEGORICAL, CHURN_COL, ID_COL, LTV_TARGET, MOCK_PROBABILITY, NUMERICAL, TIER_ONLINE
from ..session import checkpoint_dir, cut_lineage, path_exists, storage_memory
from .clean import clean
from .encode import EncoderState, fit_encoder
from .features import create_features
from .forest import best_round, next_rounds, staged_auc, staged_margins, vote_share
from .sparse import SparseEncoder

# The reference's booster settings.
CHURN_GBT = dict(maxIter=100, maxDepth=6, stepSize=0.1, subsamplingRate=0.8,
                 featureSubsetStrategy="0.8", seed=42)
LTV_GBT = dict(maxIter=200, maxDepth=5, stepSize=0.05, subsamplingRate=0.8,
               featureSubsetStrategy="0.8", seed=42)
# Execution settings for tree ensembles (results unchanged): the per-iteration state is checkpointed every 10 iterations
# into the shared folder. Node ids are not cached: a tree of a few levels is cheaper to walk than a column of ids is to
# store anew after every level.
_TREE_EXEC = dict(cacheNodeIds=False, checkpointInterval=10)
#: training rows of one task: a boosted fit runs a short job for every level of every tree
ROWS_PER_TASK = 20_000
#: the same beyond ``FEW_TASKS`` tasks for the search's last fit, which runs alone: its tasks then outlast their start
LONG_ROWS_PER_TASK, FEW_TASKS = 100_000, 8
BASELINE_GBT_DEPTH = 4
RF_STUMPS = dict(numTrees=100, maxDepth=1, featureSubsetStrategy="sqrt", bootstrap=True, seed=42)
LTV_LEAKS = (LTV_TARGET, "charge_ratio", "charges_difference")

_CLASSIFIERS = {
    "gbt": (MC.GBTClassifier, MC.GBTClassificationModel, CHURN_GBT),
    "rf": (MC.RandomForestClassifier, MC.RandomForestClassificationModel, RF_STUMPS),
    "lr": (MC.LogisticRegression, MC.LogisticRegressionModel, dict(maxIter=800, regParam=0.0)),
}
_REGRESSORS = {
    "gbt": (MR.GBTRegressor, MR.GBTRegressionModel, LTV_GBT),
    "linear": (MR.LinearRegression, MR.LinearRegressionModel, dict(regParam=1.0, elasticNetParam=0.0)),
}


@dataclass
class FittedModel:
    """A fitted MLlib model plus the encoder it was trained with."""

    task: str                      # "churn" or "ltv"
    kind: str                      # key of _CLASSIFIERS / _REGRESSORS
    encoder: EncoderState | SparseEncoder
    model: object
    params: dict = field(default_factory=dict)
    median: float | None = None    # TotalCharges of the training rows; fills blanks when raw records are scored

    def features(self, df: DataFrame, keep=(ID_COL,)) -> DataFrame:
        return self.encoder.vector(df, keep=[k for k in keep if k in df.columns])

    def importances(self) -> list[tuple[str, float]]:
        """MDL10: feature importance by name (trees) or |coefficient| (linear)."""
        m = self.model
        if hasattr(m, "featureImportances"):
            vals = m.featureImportances.toArray()
        else:
            vals = [abs(v) for v in m.coefficients.toArray()]
        names = list(self.encoder.feature_columns)
        return list(zip(names + [str(k) for k in range(len(names), len(vals))], [float(v) for v in vals]))

    def save(self, spark, path: str) -> str:
        """SNK6: model + fit state under one folder (shared filesystem)."""
        self.model.write().overwrite().save(os.path.join(path, "model"))
        self.encoder.save(spark, os.path.join(path, "encoder"))
        meta = json.dumps({"task": self.task, "kind": self.kind, "params": self.params, "median": self.median})
        spark.createDataFrame([(meta,)], "meta string").coalesce(1).write.mode("overwrite") \
            .json(os.path.join(path, "meta"))
        return path

    @staticmethod
    def load(spark, path: str) -> "FittedModel":
        """SNK7."""
        meta = json.loads(spark.read.json(os.path.join(path, "meta")).first()["meta"])
        table = _CLASSIFIERS if meta["task"] == "churn" else _REGRESSORS
        model = table[meta["kind"]][1].load(os.path.join(path, "model"))
        return FittedModel(meta["task"], meta["kind"], load_encoder(spark, os.path.join(path, "encoder")),
                           model, meta.get("params", {}), meta.get("median"))


def load_encoder(spark, path: str) -> EncoderState | SparseEncoder:
    return (SparseEncoder if path_exists(spark, os.path.join(path, "categories")) else EncoderState).load(spark, path)


def _exec(kind: str) -> dict:
    return _TREE_EXEC if kind in ("gbt", "rf") else {}


def _fit(estimator, train: DataFrame, kind: str, encode, long_tasks: bool = False):
    """(encoder, model): ``encode`` gives the encoder fitted on the rows and their vectors, which the estimator takes.

    A boosted fit runs hundreds of short jobs, so its rows are dealt once, and their vectors are written to the shared
    checkpoint folder: every job else ships and walks the plan of the joins before them.
    """
    rows = _dealt(train, kind, long_tasks)
    if kind != "gbt":
        enc, vectors = encode(rows)
        return enc, _without_summary(estimator.fit(vectors))
    rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        enc, vectors = encode(rows)
        vectors = vectors.checkpoint()
    finally:
        rows.unpersist()
    return enc, estimator.fit(vectors)


def _without_summary(model):
    """The model without its training summary, which holds the session: once a write was observed in it, that cannot be sent to tasks."""
    if getattr(model, "hasSummary", False):
        model._java_obj.setSummary(SparkSession.active()._jvm.scala.Option.empty())
    return model


def _dealt(train: DataFrame, kind: str, long_tasks: bool = False) -> DataFrame:
    """The rows for a boosted fit in even tasks of about ``ROWS_PER_TASK``, in an order of their own.

    The tasks follow the rows and not the partitions that the upstream joins leave, of which every level of every tree
    would start two tasks each. Rows are dealt by all columns, so that null or repeated ids do not meet in one task, and
    sorted, so that MLlib's draws do not depend on the layout. ``long_tasks`` deals many rows to fewer tasks.
    """
    if kind != "gbt":
        return train
    rows = train.count()
    tasks = max(1, math.ceil(rows / ROWS_PER_TASK))
    if long_tasks:
        tasks = min(tasks, max(FEW_TASKS, math.ceil(rows / LONG_ROWS_PER_TASK)))
    return train.repartition(tasks, *train.columns).sortWithinPartitions(*train.columns)


def _feature_frame(df: DataFrame, task: str) -> DataFrame:
    drop = [ID_COL, CHURN_COL]
    if task == "ltv":
        drop += list(LTV_LEAKS)
    return df.drop(*[c for c in drop if c in df.columns])


def train_churn(train: DataFrame, kind: str = "gbt", categorical=CATEGORICAL, numerical=NUMERICAL,
                median: float | None = None, long_tasks: bool = False, **overrides) -> FittedModel:
    """MDL1/3/5/6/7: fit the encoder on the training rows, then the classifier."""
    cls, _, defaults = _CLASSIFIERS[kind]
    params = {**defaults, **overrides}
    checkpoint_dir(train.sparkSession)  # MLlib checkpoints only when the context has a folder

    def encode(rows):
        enc = fit_encoder(_feature_frame(rows, "churn"), categorical, numerical)
        return enc, enc.vector(rows, keep=[CHURN_COL]).withColumnRenamed(CHURN_COL, "label")

    enc, model = _fit(cls(featuresCol="features", labelCol="label", **params, **_exec(kind)), train, kind, encode, long_tasks)
    return FittedModel("churn", kind, enc, model, params, median)


def train_ltv(train: DataFrame, kind: str = "gbt", categorical=CATEGORICAL, numerical=NUMERICAL,
              median: float | None = None, **overrides) -> FittedModel:
    """MDL2/4: spend regressor on TotalCharges; target and its derivatives never features."""
    reg, _, defaults = _REGRESSORS[kind]
    params = {**defaults, **overrides}
    checkpoint_dir(train.sparkSession)

    def encode(rows):
        enc = fit_encoder(_feature_frame(rows, "ltv"), categorical, [c for c in numerical if c not in LTV_LEAKS])
        return enc, enc.vector(rows, keep=[LTV_TARGET]).withColumn("label", F.col(LTV_TARGET).cast("double"))

    enc, model = _fit(reg(featuresCol="features", labelCol="label", **params, **_exec(kind)), train, kind, encode)
    return FittedModel("ltv", kind, enc, model, params, median)


def score_churn(model: FittedModel | None, df: DataFrame, threshold: float = 0.5,
                allow_mock: bool = False) -> DataFrame:
    """SCO1/SCO2: probability (unrounded) and hard label; mock only when allowed.

    A forest of stumps gives the share of its trees that vote for churn (MDL6); the other models give their probability.
    """
    if model is None:
        if not allow_mock:
            raise RuntimeError("no churn model loaded")
        return df.withColumn("churn_probability", F.lit(MOCK_PROBABILITY)) \
            .withColumn("churn_prediction", F.lit(0))
    feats = model.features(df, keep=df.columns)
    if model.kind == "rf" and model.params.get("maxDepth") == 1:
        out = vote_share(model.model, feats)
    else:
        out = model.model.transform(feats).withColumn("churn_probability", vector_to_array(F.col("probability"))[1])
    return (out
            .withColumn("churn_prediction", (F.col("churn_probability") >= threshold).cast("int"))
            .drop("features", "rawPrediction", "probability", "prediction"))


def score_ltv(model: FittedModel, df: DataFrame) -> DataFrame:
    feats = model.features(df, keep=df.columns)
    return model.model.transform(feats).withColumnRenamed("prediction", "ltv_prediction").drop("features")


def score_customers(churn: FittedModel, ltv: FittedModel, df: DataFrame,
                    tiers: tuple[float, float] = TIER_ONLINE) -> DataFrame:
    """SCO3: churn probability, label, tier and LTV in one pass (models refuse when missing)."""
    if churn is None or ltv is None:
        raise RuntimeError("both models are required")
    s = score_churn(churn, df)
    s = score_ltv(ltv, s)
    return s.select(ID_COL, F.round("churn_probability", 4).alias("churn_probability"),
                    "churn_prediction", risk_tier("churn_probability", *tiers).alias("churn_risk_tier"),
                    F.round("ltv_prediction", 2).alias("ltv_prediction"))


def score_raw(churn: FittedModel, ltv: FittedModel, raw: DataFrame,
              tiers: tuple[float, float] = TIER_ONLINE) -> DataFrame:
    """SCO1/SCO3 from raw records: clean with the stored training median, derive features, score.

    No job runs and nothing is fitted on ``raw``, so a record scores alike alone, in a batch and on a stream.
    """
    if churn is None or ltv is None:
        raise RuntimeError("both models are required")
    if churn.median is None:
        raise ValueError("the churn model was trained without median=, which raw records need")
    return score_customers(churn, ltv, create_features(clean(raw, median=churn.median)), tiers)


# The reference's search grid.
CV_GRID = {"maxDepth": [4, 6], "maxIter": [100, 200], "stepSize": [0.05, 0.1]}
CV_FOLDS = 3


def _fit_bytes(rows: int, features: int) -> int:
    """What a boosted fit keeps cached: the binned rows (one int a feature) and, a few times, their margins and counts."""
    return rows * (4 * features + 250)


def _side_by_side(parallelism: int, cores: int, tasks: int, fit_bytes: int, memory: int) -> int:
    """How many fits run at once: more where a fit has few tasks, fewer where their cached rows would not fit into memory.

    Rows that do not fit are read back from disk at every level of every tree, which costs more than idle cores do.
    """
    return max(1, min(max(parallelism, cores // max(1, tasks)), memory // max(1, fit_bytes)))


def grid_search(train: DataFrame, grid: dict | None = None, folds: int = CV_FOLDS, parallelism: int = 4,
                seed: int = 42, patience: int = 20, median: float | None = None, first_rounds: int = 40):
    """MDL8: k-fold grid search on the ROC-AUC after every tree, stopped after ``patience`` rounds without a gain.

    Fold membership is a seeded hash of the id (deterministic across runs and layouts). A boosted model's first k trees
    are the model of k rounds, so settings that differ in ``maxIter`` alone share one fit per fold, and all prefixes of
    a fit are judged in one job, straight from its trees. Fits begin with ``first_rounds`` trees, on one fold: where its
    curve still rises at its end, all folds are fitted with the largest ``maxIter`` at once, as MLlib cannot go on from a
    fitted ensemble. A setting whose mean curve has not stopped is fitted anew with more trees. The best setting (the
    first of equals) is refitted on all training rows with as many trees as its best round.
    Returns (best FittedModel, [{params, mean_auc, best_iteration}, ...] in grid order).
    """
    grid = dict(grid or CV_GRID)
    limits = grid.setdefault("maxIter", [CHURN_GBT["maxIter"]])
    most = max(limits)
    enc = fit_encoder(_feature_frame(train, "churn"), CATEGORICAL, NUMERICAL)
    spark = train.sparkSession
    data = cut_lineage(enc.vector(train, keep=[ID_COL, CHURN_COL]).withColumnRenamed(CHURN_COL, "label").withColumn(
        "fold", F.pmod(F.xxhash64(F.lit(seed), F.col(ID_COL)), F.lit(folds)).cast("int")))
    names = [k for k in grid if k != "maxIter"]
    cells = list(product(*(grid[k] for k in names)))
    base = {k: v for k, v in CHURN_GBT.items() if k not in grid}

    def held_out(job) -> list[float]:
        cell, fold, rounds = job
        gbt = MC.GBTClassifier(featuresCol="features", labelCol="label", maxIter=rounds, **base,
                               **dict(zip(names, cell)), **_TREE_EXEC)
        scored = staged_margins(gbt.fit(data.where(F.col("fold") != fold)), data.where(F.col("fold") == fold))
        told = staged_auc(scored.select("fold", "label", "margins"), ["fold"]).orderBy("iteration")
        return [r["roc_auc"] for r in told.collect()]  # one row a round

    lanes = _side_by_side(parallelism, spark.sparkContext.defaultParallelism, data.rdd.getNumPartitions(),
                          _fit_bytes(data.count(), len(enc.feature_columns)), storage_memory(spark))
    fitted: dict[tuple, tuple[int, list[float]]] = {}  # (cell, fold): rounds, AUC after each on the held-out rows
    curves: dict[tuple, list[float]] = {}
    wanted = {c: min(first_rounds, most) for c in cells}
    jobs = [(c, 0, wanted[c]) for c in cells]
    while jobs:
        with ThreadPool(min(lanes, len(jobs))) as pool:
            for (c, f, rounds), curve in zip(jobs, pool.map(held_out, jobs, chunksize=1)):
                fitted[c, f] = (rounds, curve)
        for c in (c for c in cells if c not in curves):
            mine = [fitted[c, f] for f in range(folds) if (c, f) in fitted]
            mean = [math.fsum(at) / len(at) for at in zip(*(curve for _, curve in mine if curve))]
            stopped = wanted[c] >= most or best_round(mean, patience)[1]
            if len(mine) == folds and min(rounds for rounds, _ in mine) >= wanted[c] and stopped:
                curves[c] = mean
            elif not stopped and (mean or len(mine) == folds):  # the first fold may be empty
                wanted[c] = next_rounds(mean, wanted[c], most, patience)
        jobs = [(c, f, wanted[c]) for c in cells if c not in curves for f in range(folds) if fitted.get((c, f), (0,))[0] < wanted[c]]
    results = []
    for values in product(*grid.values()):
        params = dict(zip(grid, values))
        curve = curves[tuple(params[k] for k in names)][:params["maxIter"]]
        best, _ = best_round(curve, patience)
        results.append({"params": params, "mean_auc": curve[best - 1], "best_iteration": best})
    top = max(results, key=lambda r: r["mean_auc"])
    model = train_churn(train, "gbt", median=median, long_tasks=True,
                        **{**top["params"], "maxIter": top["best_iteration"]})
    return model, results
