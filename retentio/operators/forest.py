"""Work on the trees of a fitted MLlib ensemble: staged margins, early stopping, votes (MDL6, MDL8).

A saved ensemble is at most trees x 2^(depth + 1) nodes, so its node arrays are
what the driver and the tasks hold; rows are never collected.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import checkpoint_dir

#: rows whose margins meet in one task when the tree counts are judged: 8 bytes a margin, or less where margins repeat
RANGE_ROWS = 2_000_000
#: rows that walk the trees together, so that their features stay in the cache of a core
WALK_ROWS = 2_048


def tree_arrays(spark: SparkSession, model) -> list[dict[str, np.ndarray]]:
    """Per tree the arrays feature, threshold, left, right (-1 at a leaf) and value, by node id."""
    path = os.path.join(checkpoint_dir(spark), "models", f"trees-{uuid.uuid4().hex[:12]}")
    model.write().overwrite().save(path)
    rows = spark.read.parquet(os.path.join(path, "data")).select("treeID", "nodeData.*").collect()  # bounded by the model
    trees: dict[int, list] = {}
    for r in rows:
        trees.setdefault(r["treeID"], []).append(r)
    out = []
    for _, nodes in sorted(trees.items()):
        size = max(r["id"] for r in nodes) + 1
        tree = {"feature": np.zeros(size, np.int64), "threshold": np.zeros(size), "left": np.full(size, -1),
                "right": np.full(size, -1), "value": np.zeros(size)}
        for r in nodes:
            tree["value"][r["id"]] = r["prediction"]
            if r["leftChild"] < 0:
                continue
            if r["split"]["numCategories"] >= 0:
                raise NotImplementedError("the encoders give numeric columns; a categorical split has no threshold")
            tree["feature"][r["id"]] = r["split"]["featureIndex"]
            tree["threshold"][r["id"]] = r["split"]["leftCategoriesOrThreshold"][0]
            tree["left"][r["id"]], tree["right"][r["id"]] = r["leftChild"], r["rightChild"]
        out.append(tree)
    return out


def walkable(tree: dict[str, np.ndarray]) -> dict:
    """``tree`` with both children of a node beside each other, each leaf its own child, and the levels to walk."""
    node = np.arange(len(tree["left"]))
    leaf = tree["left"] < 0
    child = np.stack([np.where(leaf, node, tree["left"]), np.where(leaf, node, tree["right"])], axis=1).ravel()
    level, levels = np.zeros(1, np.int64), 0
    while (inner := level[~leaf[level]]).size:
        level, levels = np.concatenate([child[2 * inner], child[2 * inner + 1]]), levels + 1
    return {**tree, "child": child, "levels": levels}


def leaf_values(x: np.ndarray, tree: dict) -> np.ndarray:
    """The value of the leaf of a ``walkable`` tree that each row of ``x`` reaches, all rows one level at a time."""
    flat, first = x.ravel(), np.arange(len(x)) * x.shape[1]
    at = np.zeros(len(x), np.int64)
    for _ in range(tree["levels"]):
        goes_right = ~(flat[first + tree["feature"][at]] <= tree["threshold"][at])
        at = tree["child"][2 * at + goes_right]
    return tree["value"][at]


def staged_margins(model, features: DataFrame, name: str = "margins") -> DataFrame:
    """Add the margin after each tree of a boosted model as an array column: the last is the model's own."""
    spark = features.sparkSession
    shared = spark.sparkContext.broadcast(([walkable(t) for t in tree_arrays(spark, model)], list(model.treeWeights)))

    @F.pandas_udf("array<double>")
    def margins(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        trees, weights = shared.value
        for batch in batches:
            if not len(batch):
                yield pd.Series([], dtype=object)
                continue
            x = np.vstack(batch.to_numpy())
            steps = np.empty((len(x), len(trees)))
            for a in range(0, len(x), WALK_ROWS):
                some = x[a:a + WALK_ROWS]
                steps[a:a + WALK_ROWS] = np.cumsum([w * leaf_values(some, t) for t, w in zip(trees, weights)], axis=0).T
            yield pd.Series(list(steps))

    return features.withColumn(name, margins(vector_to_array("features")))


def _margin_columns(batch: pa.RecordBatch) -> Iterator[tuple[str, int, np.ndarray, np.ndarray]]:
    """(key, iteration, margins, whether positive) of every key and tree count of a batch; a null margin is the least."""
    lists = batch.column("m")
    sizes = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = lists.flatten().fill_null(float("-inf")).to_numpy(zero_copy_only=False)
    begin = np.cumsum(sizes) - sizes
    keys = batch.column("key").dictionary_encode()
    names, code = keys.dictionary.to_pylist(), keys.indices.to_numpy(zero_copy_only=False)
    positive = batch.column("y").to_numpy(zero_copy_only=False) == 1
    for c, size in np.unique(np.stack([code, sizes], axis=1), axis=0).tolist():
        same = np.flatnonzero((code == c) & (sizes == size))
        block = np.ascontiguousarray(values[begin[same][:, None] + np.arange(size)].T)
        for k in range(size):
            yield names[c], k + 1, block[k], positive[same]


def _counted(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values in ascending order; where half of them or more repeat, the distinct ones and their counts."""
    values = np.sort(values)
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    at = np.flatnonzero(new)
    if 2 * len(at) > len(values):
        return values, np.empty(0, np.int64)
    return values[at], np.diff(np.append(at, len(values)))


def _met(values: Sequence[bytes], counts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """What ``_counted`` gave for several batches as one: values in ascending order, how many lie before each and after all."""
    parts, each = [np.frombuffer(v) for v in values], [np.frombuffer(n, np.int64) for n in counts]
    whole = np.concatenate(parts)
    if not any(map(len, each)):
        return np.sort(whole), np.arange(len(whole) + 1)
    order = np.argsort(whole, kind="stable")
    weight = np.concatenate([n if len(n) else np.ones(len(v), np.int64) for v, n in zip(parts, each)])
    return whole[order], np.append(0, np.cumsum(weight[order]))


def staged_auc(scored: DataFrame, by: Sequence[str], label: str = "label", margins: str = "margins",
               range_rows: int = RANGE_ROWS) -> DataFrame:
    """ROC-AUC after every tree: (by..., iteration from 1, n, roc_auc), exact, all prefixes in one job.

    No row is made for a margin: each batch sends the margins of a tree count, sorted and by class, as arrays to ranges
    of about ``range_rows`` rows, whose bounds come from quantiles of all batches where a group has more rows. A range
    gives its counts and area; what lies above it is added per tree count. Margins that repeat within a batch are sent
    once with their counts, so a frequent one is no load on its range. The margins are read once, and once more for
    bounds, so ``scored`` may compute them. As in ``compare_models``: rows without a label do not count; a null margin
    is the least. Rows without margins do not count either.
    """
    key = F.to_json(F.struct(*by), {"ignoreNullFields": "false"}).alias("key")
    told = scored.where(F.col(label).isNotNull())
    # no filter on the margins: it would compute them twice
    rows = told.select(key, (F.col(label) == 1).cast("int").alias("y"), F.col(margins).cast("array<double>").alias("m"))
    most = told.groupBy(*by).count().agg(F.max("count")).first()[0] or 0
    ranges = -(-most // range_rows)
    bounds: dict[tuple[str, int], np.ndarray] = {}
    if ranges > 1:
        at = np.linspace(0, 1, 65)

        def quantiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                drawn = [(name, k, float(len(v)), np.sort(v)[(at * (len(v) - 1)).astype(int)]) for name, k, v, _ in _margin_columns(batch)]
                names, ks, ns, qs = zip(*drawn) if drawn else ((),) * 4
                yield pa.record_batch({"key": pa.array(names, pa.string()), "iteration": pa.array(ks, pa.int32()),
                                       "n": pa.array(ns, pa.float64()), "q": pa.array(qs, pa.list_(pa.float64()))})

        def cuts(pdf: pd.DataFrame) -> pd.DataFrame:
            values, weight = np.concatenate(pdf["q"].to_list()), np.repeat(pdf["n"].to_numpy(), len(at))
            order = np.argsort(values)
            upto = np.cumsum(weight[order])
            places = np.searchsorted(upto, upto[-1] * np.arange(1, ranges) / ranges)
            return pd.DataFrame({"key": pdf["key"].iloc[:1], "iteration": pdf["iteration"].iloc[:1], "cuts": [np.unique(values[order][places])]})

        drawn = rows.mapInArrow(quantiles, "key string, iteration int, n double, q array<double>")
        found = drawn.groupBy("key", "iteration").applyInPandas(cuts, "key string, iteration int, cuts array<double>")
        bounds = {(r["key"], r["iteration"]): np.array(r["cuts"]) for r in found.collect()}  # settings x folds x trees rows
    shared = scored.sparkSession.sparkContext.broadcast(bounds)
    none = np.empty(0)
    sent = pa.schema([("key", pa.string()), ("iteration", pa.int32()), ("range", pa.int32()),
                      *((c, pa.binary()) for c in ("p", "p_n", "q", "q_n"))])

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for name, k, values, positive in _margin_columns(batch):
                limits = shared.value.get((name, k), none)
                parts: list[list[bytes]] = [[] for _ in range(len(limits) + 1)]
                for side in (values[positive], values[~positive]):
                    held, counts = _counted(side)
                    ends = [0, *np.searchsorted(held, limits, side="left").tolist(), len(held)]
                    for part, a, b in zip(parts, ends, ends[1:]):
                        part += [held[a:b].tobytes(), counts[a:b].tobytes()]
                out += [(name, k, r, *part) for r, part in enumerate(parts) if part[0] or part[2]]
            columns = zip(*out) if out else ((),) * len(sent)
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, sent)], schema=sent)

    def judged(pdf: pd.DataFrame) -> pd.DataFrame:
        (p, p_before), (q, q_before) = _met(pdf["p"], pdf["p_n"]), _met(pdf["q"], pdf["q_n"])
        lower, upto = (p_before[np.searchsorted(p, q, side=side)] for side in ("left", "right"))
        area = (np.diff(q_before) * (2 * p_before[-1] - lower - upto)).sum()  # 2 for a positive above, 1 for an equal one
        return pdf[["key", "iteration", "range"]].iloc[:1].assign(p=float(p_before[-1]), q=float(q_before[-1]), area=float(area))

    kind = "key string, iteration int, range int"
    parts = (rows.mapInArrow(dealt, f"{kind}, p binary, p_n binary, q binary, q_n binary").groupBy("key", "iteration", "range")
             .applyInPandas(judged, f"{kind}, p double, q double, area double"))
    higher = Window.partitionBy("key", "iteration").orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("before", F.coalesce(F.sum("p").over(higher), F.lit(0.0)))
    whole = parts.groupBy("key", "iteration").agg(F.sum("p").alias("P"), F.sum("q").alias("N"), F.sum(F.col("area") + 2 * F.col("before") * F.col("q")).alias("a"))
    auc = F.when(F.col("P") == 0, F.lit(0.0)).when(F.col("N") == 0, F.lit(1.0)).otherwise(F.col("a") / (2 * F.col("P") * F.col("N")))
    named = told.select(*by, key).distinct()
    return (whole.join(named, "key").select(*by, "iteration", (F.col("P") + F.col("N")).cast("long").alias("n"), auc.alias("roc_auc")))


def best_round(curve: Sequence[float], patience: int) -> tuple[int, bool]:
    """(best iteration from 1, stopped): the first best value that ``patience`` further rounds do not beat."""
    best = 0
    for at, value in enumerate(curve):
        if value > curve[best]:
            best = at
        elif at - best >= patience:
            return best + 1, True
    return best + 1, False


def next_rounds(curve: Sequence[float], rounds: int, most: int, patience: int) -> int:
    """Trees of the next fit where a curve of ``rounds`` has not stopped: all if it gains to its end, else twice as many."""
    rises = len(curve) - best_round(curve, patience)[0] < patience / 2 if curve else False
    return most if rises else min(2 * rounds, most)


def vote_share(model, features: DataFrame, name: str = "churn_probability") -> DataFrame:
    """Add the share of a forest's depth-1 trees that vote for class 1, as one JVM expression over the trees."""
    specs = []
    for t in tree_arrays(features.sparkSession, model):
        split = t["left"][0] >= 0
        left, right = (t["left"][0], t["right"][0]) if split else (0, 0)
        if split and (t["left"][left] >= 0 or t["left"][right] >= 0):
            raise ValueError("votes are counted for depth-1 trees")
        specs.append(F.struct(F.lit(int(t["feature"][0])).alias("i"), F.lit(float(t["threshold"][0])).alias("t"),
                              F.lit(float(t["value"][left])).alias("l"), F.lit(float(t["value"][right])).alias("r")))

    def add(total: Column, s: Column) -> Column:
        return total + F.when(F.col("__x")[s["i"]] <= s["t"], s["l"]).otherwise(s["r"])

    votes = F.aggregate(F.array(*specs), F.lit(0.0), add)
    return features.withColumn("__x", vector_to_array("features")).withColumn(name, votes / len(specs)).drop("__x")
