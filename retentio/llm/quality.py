"""Quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration.

``statistics`` turns a whole text into a short vector of counts and shares.
Random Fourier features of the standardised vector approximate a Gaussian
kernel. Every partition sums its own normal equations, per fold; the sums are
added up, and one small solve gives the ridge weights, so no row of the
training data reaches the driver. Each fold is scored by the weights of the
other folds (total minus own sums); these out-of-fold scores, binned, give the
isotonic curve by pooling adjacent violators.

The fit uses every labelled row outside the held-out fold, scoring covers every
document. Defined results: null text
counts as empty and is scored like any text; null ids are never training rows;
a document with several labels counts with its least one; labels other than 0
and 1 and null labels are passed over; without labelled rows, or with labels
of one kind, every score is the mean label (0.5 without any); extra columns are
kept, columns of the same names replaced; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass
from operator import eq
from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import small_batches, text_or_empty

FOLDS, HELD_OUT = 5, 0
FEATURES, RIDGE, BINS, SEED = 256, 1e-3, 2000, 11
#: raw ridge scores are binned for calibration between these
LOW, HIGH = -0.5, 1.5

_CLASSES = [bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(48, 58)), b" ", b"\n", b"!", b"?", b"*#$%&@^~", b"|", b".", b",",
            b";:'\"", b"()[]{}<>", b"-_+=/\\", bytes(range(128, 256)), bytes(range(0, 9)) + bytes(range(14, 32))]
_CLASS = np.zeros((256, len(_CLASSES)))
for _k, _chars in enumerate(_CLASSES):
    _CLASS[list(_chars), _k] = 1.0


def statistics(text: str) -> list[float]:
    """Sizes, character-class shares, and how much words and lines repeat."""
    data = text.encode("utf-8", "replace")
    n = max(1, len(data))
    shares = np.bincount(np.frombuffer(data, np.uint8), minlength=256) @ _CLASS / n
    words, lines = text.split(), text.split("\n")
    w = max(1, len(words))
    counts = Counter(words)
    top = counts.most_common(1)[0][1] if words else 0
    return [
        math.log1p(len(data)), math.log1p(len(words)), *(math.sqrt(s) for s in shares.tolist()),
        len(text) / w if words else 0.0, len(counts) / w, top / w,
        sum(map(eq, words, words[1:])) / w, len(set(lines)) / len(lines), math.log1p(len(text) / len(lines)),
        max(map(len, words), default=0) ** 0.5, math.log1p(len(lines)),
    ]


N_STATS = len(statistics(""))


def stats_column(text: Column) -> Column:
    @F.pandas_udf("array<double>")
    def stats(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([statistics(t) for t in texts])

    return stats(text)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # directions of the random features
    phase: np.ndarray
    beta: np.ndarray
    knots: np.ndarray  # isotonic curve: raw score -> probability
    values: np.ndarray

    def score(self, stats: np.ndarray) -> np.ndarray:
        raw = fourier(stats, self) @ self.beta
        return np.clip(np.interp(np.clip(raw, LOW, HIGH), self.knots, self.values), 0.0, 1.0)


def fourier(stats: np.ndarray, m: Model) -> np.ndarray:
    x = np.clip((stats - m.mean) / m.scale, -6, 6)
    z = np.cos(x @ m.weights + m.phase) * math.sqrt(2 / len(m.phase))
    return np.hstack([z, np.ones((len(x), 1))])


def fold_of(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)).cast("int")


def isotonic(scores: np.ndarray, n: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over bins; (block centres, block means), both increasing."""
    blocks: list[list[float]] = []
    for s, k, y in zip(scores, n, ones):
        blocks.append([s * k, k, y])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][1] >= blocks[-1][2] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    b = np.array(blocks)
    return b[:, 0] / b[:, 1], b[:, 2] / b[:, 1]


def _sums(m: Model):
    """Normal equations of a partition, one row per fold: A and c as bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        size = len(m.phase) + 1
        a, c = np.zeros((FOLDS, size, size)), np.zeros((FOLDS, size))
        for batch in batches:
            z, y, fold = fourier(np.array(batch["stats"].tolist()), m), batch["y"].to_numpy(float), batch["fold"].to_numpy()
            for f in np.unique(fold):
                rows = fold == f
                a[f] += z[rows].T @ z[rows]
                c[f] += z[rows].T @ y[rows]
        yield pd.DataFrame({"fold": range(FOLDS), "a": [x.tobytes() for x in a], "c": [x.tobytes() for x in c]})

    return run


def _added(pdf: pd.DataFrame) -> pd.DataFrame:
    a = sum(np.frombuffer(x) for x in pdf["a"])
    c = sum(np.frombuffer(x) for x in pdf["c"])
    return pd.DataFrame({"fold": [pdf["fold"].iloc[0]], "a": [a.tobytes()], "c": [c.tobytes()]})


def fit(docs: DataFrame, labels: DataFrame, features: int = FEATURES, ridge: float = RIDGE,
        doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> Model:
    """Learns from labelled rows outside the held-out fold."""
    small_batches(docs.sparkSession)
    told = (labels.where(F.col(label).isin(0, 1)).groupBy(F.col("doc_id").alias("_id")).agg(F.min(label).cast("double").alias("y")))
    mine = docs.select(F.col(doc_id).alias("doc_id"), stats_column(text_or_empty(text)).alias("stats")).where("doc_id is not null")
    rows = cut_lineage(mine.withColumn("fold", fold_of(F.col("doc_id"))).where(F.col("fold") != HELD_OUT)
                        .join(told, F.col("doc_id") == F.col("_id")).select("fold", "stats", "y"))
    moments = rows.agg(F.count("*"), F.avg("y"), *[F.avg(F.get("stats", F.lit(k))) for k in range(N_STATS)],
                       *[F.stddev_pop(F.get("stats", F.lit(k))) for k in range(N_STATS)]).first()
    rng = np.random.default_rng(SEED)
    # the median distance of standardised vectors grows with the square root of their length
    m = Model(np.zeros(N_STATS), np.ones(N_STATS), rng.standard_normal((N_STATS, features)) / math.sqrt(N_STATS),
              rng.uniform(0, 2 * math.pi, features), np.zeros(features + 1), np.array([LOW, HIGH]), np.array([0.5, 0.5]))
    if not moments[0] or moments[1] in (0.0, 1.0):
        m.values = np.full(2, 0.5 if not moments[0] else moments[1])
        return m
    m.mean = np.array(moments[2 : 2 + N_STATS], float)
    m.scale = np.maximum(np.array(moments[2 + N_STATS :], float), 1e-6)
    kind = "fold int, a binary, c binary"
    sums = rows.mapInPandas(_sums(m), kind).withColumn("part", F.spark_partition_id())
    # partitions are added up in groups on the executors; FOLDS rows reach the driver
    sums = sums.groupBy("fold", F.pmod("part", F.lit(16)).alias("part")).applyInPandas(lambda pdf: _added(pdf), kind)
    got = sums.groupBy("fold").applyInPandas(lambda pdf: _added(pdf), kind).collect()
    size = features + 1
    a = {r["fold"]: np.frombuffer(r["a"]).reshape(size, size) for r in got}
    c = {r["fold"]: np.frombuffer(r["c"]) for r in got}
    total_a, total_c = sum(a.values()), sum(c.values())

    def solve(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.linalg.solve(x + ridge * max(1.0, x[-1, -1]) * np.eye(size), y)

    m.beta = solve(total_a, total_c)
    others = np.array([solve(total_a - a[f], total_c - c[f]) for f in range(FOLDS)])
    step = (HIGH - LOW) / BINS

    def binned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            z = fourier(np.array(batch["stats"].tolist()), m)
            raw = np.einsum("ij,ij->i", z, others[batch["fold"].to_numpy()])
            at = np.clip(((np.clip(raw, LOW, HIGH) - LOW) / step).astype(int), 0, BINS - 1)
            yield pd.DataFrame({"bin": at, "y": batch["y"].to_numpy(float)}).groupby("bin")["y"].agg(["count", "sum"]).reset_index()

    bins = (rows.mapInPandas(binned, "bin int, count long, sum double").groupBy("bin")
            .agg(F.sum("count").alias("n"), F.sum("sum").alias("ones")).orderBy("bin").collect())  # at most BINS rows
    m.knots, m.values = isotonic(np.array([LOW + (r["bin"] + 0.5) * step for r in bins]),
                                 np.array([r["n"] for r in bins], float), np.array([r["ones"] for r in bins], float))
    return m


def score_column(text: Column, model: Model) -> Column:
    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            stats = np.array([statistics(t) for t in texts], float).reshape(-1, N_STATS)
            yield pd.Series(model.score(stats), dtype="float64")

    return score(text)


def with_scores(docs: DataFrame, model: Model, threshold: float = 0.3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with held_out, score and predicted (1: score >= threshold)."""
    small_batches(docs.sparkSession)
    out = docs.withColumns({"held_out": fold_of(F.col(doc_id)) == HELD_OUT, "score": score_column(text_or_empty(text), model)})
    return out.withColumn("predicted", (F.col("score") >= F.lit(threshold)).cast("int"))
