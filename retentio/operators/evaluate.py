"""Model-quality metrics as distributed aggregates (EVL1-7).

Counts are conditional sums (one pass, partial aggregation). ROC points come
from a group-by on the score and a two-pass global prefix sum, so no window
ever holds all scores in one task. AUC is the trapezoid sum written per
distinct threshold: fp_i * (2 TP_i - tp_i) / (2 P N), which equals the
point-to-point trapezoid with (0,0) and (1,1) endpoints.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import global_running_sum


def hard_label(p, threshold: float = 0.5) -> F.Column:
    """SCO7."""
    col = F.col(p) if isinstance(p, str) else p
    return (col >= threshold).cast("int")


def confusion_counts(df: DataFrame, label: str = "label", pred: str = "prediction") -> DataFrame:
    """One row: tp, fp, fn, tn, n (zero-filled by construction)."""
    y, p = F.col(label), F.col(pred)
    s = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    return df.agg(s((y == 1) & (p == 1)).alias("tp"), s((y == 0) & (p == 1)).alias("fp"),
                  s((y == 1) & (p == 0)).alias("fn"), s((y == 0) & (p == 0)).alias("tn"),
                  F.count(F.lit(1)).alias("n"))


def accuracy(df: DataFrame, label: str = "label", pred: str = "prediction") -> DataFrame:
    """EVL1."""
    return df.agg(F.avg((F.col(label) == F.col(pred)).cast("double")).alias("accuracy"))


def confusion_matrix(df: DataFrame, label: str = "label", pred: str = "prediction") -> DataFrame:
    """EVL2: long (actual, predicted, n) over the full 2x2 grid."""
    c = confusion_counts(df, label, pred)
    cells = F.explode(F.array(
        F.struct(F.lit(0).alias("actual"), F.lit(0).alias("predicted"), F.col("tn").alias("n")),
        F.struct(F.lit(0).alias("actual"), F.lit(1).alias("predicted"), F.col("fp").alias("n")),
        F.struct(F.lit(1).alias("actual"), F.lit(0).alias("predicted"), F.col("fn").alias("n")),
        F.struct(F.lit(1).alias("actual"), F.lit(1).alias("predicted"), F.col("tp").alias("n"))))
    return c.select(cells.alias("c")).select("c.actual", "c.predicted", "c.n")


def _ratio(num, den) -> F.Column:
    return F.when(den > 0, num / den).otherwise(F.lit(0.0))


def precision_recall_f1(df: DataFrame, label: str = "label", pred: str = "prediction") -> DataFrame:
    """EVL3: counts, precision, recall, F1 (0 on a zero denominator)."""
    c = confusion_counts(df, label, pred)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    prec = _ratio(tp, tp + fp)
    rec = _ratio(tp, tp + fn)
    return c.select("tp", "fp", "fn", "tn", prec.alias("precision"), rec.alias("recall")).withColumn(
        "f1", _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def class_report(df: DataFrame, label: str = "label", pred: str = "prediction") -> DataFrame:
    """EVL5: per-class precision/recall/F1/support, then macro and weighted averages."""
    c = confusion_counts(df, label, pred)
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))

    def cls(name, t, f_p, f_n):
        prec, rec = _ratio(t, t + f_p), _ratio(t, t + f_n)
        return F.struct(F.lit(name).alias("class"), prec.alias("precision"), rec.alias("recall"),
                        _ratio(2 * prec * rec, prec + rec).alias("f1"), (t + f_n).alias("support"))

    per = c.select(F.explode(F.array(cls("0", tn, fn, fp), cls("1", tp, fp, fn))).alias("r")).select("r.*")
    tot = F.sum("support")
    avg = per.agg(
        F.struct(F.lit("macro avg").alias("class"), F.avg("precision").alias("precision"),
                 F.avg("recall").alias("recall"), F.avg("f1").alias("f1"), tot.alias("support")).alias("m"),
        F.struct(F.lit("weighted avg").alias("class"),
                 _ratio(F.sum(F.col("precision") * F.col("support")), tot).alias("precision"),
                 _ratio(F.sum(F.col("recall") * F.col("support")), tot).alias("recall"),
                 _ratio(F.sum(F.col("f1") * F.col("support")), tot).alias("f1"), tot.alias("support")).alias("w"))
    rows = avg.select(F.explode(F.array("m", "w")).alias("r")).select("r.*")
    return per.unionByName(rows)


def roc_points(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """EVL4 points: one row per distinct score (descending), cumulative TP/FP, tpr, fpr."""
    df = df.where(F.col(label).isNotNull())  # an unknown label is neither class
    grouped = df.groupBy(F.col(score).alias("threshold")).agg(
        F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).cast("double").alias("tp_inc"),
        F.sum(F.when(F.col(label) == 1, 0).otherwise(1)).cast("double").alias("fp_inc"))
    totals = df.agg(F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).cast("double").alias("__P"),
                    F.sum(F.when(F.col(label) == 1, 0).otherwise(1)).cast("double").alias("__N"))
    cum = global_running_sum(grouped, [F.col("threshold").desc()], ["tp_inc", "fp_inc"])
    # totals is one row: a provably tiny broadcast
    j = cum.crossJoin(F.broadcast(totals))
    return j.select(
        "threshold", "tp_inc", "fp_inc",
        F.col("cum_tp_inc").alias("tp"), F.col("cum_fp_inc").alias("fp"),
        _ratio(F.col("cum_tp_inc"), F.col("__P")).alias("tpr"),
        _ratio(F.col("cum_fp_inc"), F.col("__N")).alias("fpr"),
        "__P", "__N")


def roc_auc(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """EVL4 AUC; no positives -> 0.0, no negatives -> 1.0."""
    pts = roc_points(df, label, score)
    area = F.sum(F.col("fp_inc") * (2 * F.col("tp") - F.col("tp_inc")))
    agg = pts.agg(area.alias("__a"), F.first("__P").alias("P"), F.first("__N").alias("N"))
    auc = (F.when(F.col("P") == 0, F.lit(0.0))
           .when(F.col("N") == 0, F.lit(1.0))
           .otherwise(F.col("__a") / (2 * F.col("P") * F.col("N"))))
    return agg.select(auc.alias("roc_auc"))


def compare_models(stacked: DataFrame, by: Sequence[str], label: str = "label", score: str = "score",
                   prediction: str | None = None) -> DataFrame:
    """MDL9 / EVL4: n, confusion metrics and exact ROC-AUC of every group of a stacked score table, in one job.

    ``stacked`` holds one row per (group, scored row); a group is a model, a fold, a tree count or all of these.
    Rows collapse to counts per (group, score) before one range shuffle; the running sum runs over all groups at
    once, and what came before a group is taken off in its aggregate, so a group may hold most of the rows. As in
    ``roc_auc``: rows without a label do not count, no positives give 0.0 and no negatives 1.0. The label threshold
    metrics need ``prediction``; a null prediction is in no cell of the matrix.
    """
    keys = list(by)
    y = F.col(label) == 1
    told = [("tp", y & (F.col(prediction) == 1)), ("fp", ~y & (F.col(prediction) == 1)),
            ("fn", y & (F.col(prediction) == 0)), ("tn", ~y & (F.col(prediction) == 0))] if prediction else []
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    grouped = (stacked.where(F.col(label).isNotNull()).groupBy(*keys, F.col(score).alias("__s"))
               .agg(count(y).cast("double").alias("__p"), count(~y).cast("double").alias("__q"),
                    *[count(c).alias(f"__{name}") for name, c in told]))
    cum = global_running_sum(grouped, [*[F.col(k) for k in keys], F.col("__s").desc()], ["__p"])
    area = F.sum(F.col("__q") * (2 * F.col("cum___p") - F.col("__p")))
    whole = cum.groupBy(*keys).agg(
        F.sum("__p").alias("__P"), F.sum("__q").alias("__N"), area.alias("__a"),
        F.min(F.col("cum___p") - F.col("__p")).alias("__before"),
        *[F.sum(f"__{name}").alias(name) for name, _ in told])
    pos, neg = F.col("__P"), F.col("__N")
    auc = (F.when(pos == 0, F.lit(0.0)).when(neg == 0, F.lit(1.0))
           .otherwise((F.col("__a") - 2 * F.col("__before") * neg) / (2 * pos * neg)))
    n = (pos + neg).cast("long")
    metrics = []
    if prediction:
        tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
        precision, recall = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
        metrics = [((tp + tn) / n).alias("accuracy"), precision.alias("precision"), recall.alias("recall"),
                   _ratio(2 * precision * recall, precision + recall).alias("f1")]
    return whole.select(*keys, n.alias("n"), *metrics, auc.alias("roc_auc"))


_FIXED = "decimal(38,6)"


def regression_metrics(df: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """EVL6: MAE, MSE, RMSE, R2 = 1 - SSres / SStot (stable variance aggregate).

    Error sums are accumulated in fixed point (each row's term rounded to 6
    decimals, then summed exactly), so the metrics do not change with the
    number of partitions or the order in which partial sums are merged.
    """
    # error and total sums cover the same rows: those with both values
    df = df.where(F.col(predicted).isNotNull() & F.col(actual).isNotNull())
    err = F.col(predicted) - F.col(actual)
    ae, se = F.abs(err).cast(_FIXED), (err * err).cast(_FIXED)
    a = df.agg(F.avg(ae).cast("double").alias("mae"), F.avg(se).cast("double").alias("mse"),
               F.sum(se).cast("double").alias("__ssr"),
               (F.var_pop(F.col(actual)) * F.count(F.col(actual))).alias("__sst"))
    return a.select("mae", "mse", F.sqrt("mse").alias("rmse"),
                    F.when(F.col("__sst") > 0, 1 - F.col("__ssr") / F.col("__sst")).alias("r2"))

