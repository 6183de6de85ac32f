"""Evaluation, tier and segmentation queries over the model-free score table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluate as EV
from ..operators import segment as SG
from . import common as C
from .catalog import register
from .oracle_sql import with_clean, with_log, with_scores

_PRED_SQL = "CASE WHEN churn_probability >= 0.5 THEN 1 ELSE 0 END"


def _scored(spark, sf_dir):
    s = C.scores(spark, sf_dir)
    return s.withColumn("prediction", EV.hard_label("churn_probability"))


@register("accuracy", with_scores(f"""
SELECT ROUND(AVG(CASE WHEN label = {_PRED_SQL} THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM sc"""))
def accuracy(spark, sf_dir):
    """EVL1 with the 0.5 hard label (SCO7)."""
    return EV.accuracy(_scored(spark, sf_dir)).select(C.r6("accuracy"))


@register("confusion_matrix", with_scores(f"""
WITH g AS (SELECT a.actual, p.predicted FROM (VALUES (0), (1)) a(actual), (VALUES (0), (1)) p(predicted))
SELECT g.actual, g.predicted, COUNT(sc."customerID") AS n
FROM g LEFT JOIN sc ON sc.label = g.actual AND {_PRED_SQL} = g.predicted
GROUP BY g.actual, g.predicted"""))
def confusion_matrix(spark, sf_dir):
    """EVL2: zero-filled 2x2 grid, long form."""
    return EV.confusion_matrix(_scored(spark, sf_dir))


_COUNTS_SQL = f"""
c4 AS (SELECT CAST(SUM(CASE WHEN label = 1 AND {_PRED_SQL} = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp,
              CAST(SUM(CASE WHEN label = 0 AND {_PRED_SQL} = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
              CAST(SUM(CASE WHEN label = 1 AND {_PRED_SQL} = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fn,
              CAST(SUM(CASE WHEN label = 0 AND {_PRED_SQL} = 0 THEN 1 ELSE 0 END) AS BIGINT) AS tn FROM sc)"""


@register("precision_recall_f1", with_scores(f"""
WITH {_COUNTS_SQL},
m AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision,
             CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall FROM c4)
SELECT tp, fp, fn, tn, ROUND(precision, 6) AS precision, ROUND(recall, 6) AS recall,
       ROUND(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END, 6) AS f1
FROM m"""))
def precision_recall_f1(spark, sf_dir):
    """EVL3."""
    m = EV.precision_recall_f1(_scored(spark, sf_dir))
    return m.select("tp", "fp", "fn", "tn", C.r6("precision"), C.r6("recall"), C.r6("f1"))


@register("class_report", with_scores(f"""
WITH {_COUNTS_SQL},
per AS (
  SELECT '0' AS class, CASE WHEN tn + fn > 0 THEN tn / (tn + fn) ELSE 0.0 END AS precision,
         CASE WHEN tn + fp > 0 THEN tn / (tn + fp) ELSE 0.0 END AS recall, tn + fp AS support FROM c4
  UNION ALL
  SELECT '1', CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END,
         CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END, tp + fn FROM c4),
per2 AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM per),
allr AS (
  SELECT class, precision, recall, f1, support FROM per2
  UNION ALL SELECT 'macro avg', AVG(precision), AVG(recall), AVG(f1), SUM(support) FROM per2
  UNION ALL SELECT 'weighted avg', SUM(precision * support) / SUM(support), SUM(recall * support) / SUM(support),
                   SUM(f1 * support) / SUM(support), SUM(support) FROM per2)
SELECT class, ROUND(precision, 6) AS precision, ROUND(recall, 6) AS recall, ROUND(f1, 6) AS f1,
       CAST(support AS BIGINT) AS support FROM allr"""))
def class_report(spark, sf_dir):
    """EVL5: per-class metrics plus macro and weighted averages."""
    r = EV.class_report(_scored(spark, sf_dir))
    return r.select("class", C.r6("precision"), C.r6("recall"), C.r6("f1"),
                    F.col("support").cast("long").alias("support"))


_ROC_SQL = """
g AS (SELECT churn_probability AS threshold,
             SUM(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS tp_inc,
             SUM(CASE WHEN label = 1 THEN 0 ELSE 1 END) AS fp_inc FROM sc GROUP BY 1),
t AS (SELECT SUM(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS p, SUM(CASE WHEN label = 1 THEN 0 ELSE 1 END) AS n FROM sc),
cum AS (SELECT threshold, tp_inc, fp_inc,
               SUM(tp_inc) OVER (ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING) AS tp,
               SUM(fp_inc) OVER (ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING) AS fp FROM g)"""


@register("roc_curve", with_scores(f"""
WITH {_ROC_SQL}
SELECT ROUND(threshold, 6) AS threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp,
       ROUND(CASE WHEN p > 0 THEN tp / p ELSE 0.0 END, 6) AS tpr,
       ROUND(CASE WHEN n > 0 THEN fp / n ELSE 0.0 END, 6) AS fpr
FROM cum, t"""))
def roc_curve(spark, sf_dir):
    """EVL4 points: one per distinct score, ties share a point."""
    p = EV.roc_points(_scored(spark, sf_dir), "label", "churn_probability")
    return p.select(C.r6("threshold"), F.col("tp").cast("long").alias("tp"),
                    F.col("fp").cast("long").alias("fp"), C.r6("tpr"), C.r6("fpr"))


@register("roc_auc", with_scores(f"""
WITH {_ROC_SQL}
SELECT ROUND(CASE WHEN MAX(p) = 0 THEN 0.0 WHEN MAX(n) = 0 THEN 1.0
                  ELSE SUM(fp_inc * (2 * tp - tp_inc)) / (2.0 * MAX(p) * MAX(n)) END, 6) AS roc_auc
FROM cum, t"""))
def roc_auc(spark, sf_dir):
    """EVL4: exact trapezoid AUC over all distinct thresholds."""
    return EV.roc_auc(_scored(spark, sf_dir), "label", "churn_probability").select(C.r6("roc_auc"))


@register("score_sets_compared", with_scores(f"""
WITH m AS (
  SELECT 'score' AS model, label, churn_probability AS score FROM sc
  UNION ALL SELECT 'inverted', label, 1 - churn_probability FROM sc
  UNION ALL SELECT 'coarse', label, FLOOR(churn_probability * 10) / 10 FROM sc
  UNION ALL SELECT 'constant', label, 0.5 FROM sc
  UNION ALL SELECT 'churners_only', label, churn_probability FROM sc WHERE label = 1
  UNION ALL SELECT 'stayers_only', label, churn_probability FROM sc WHERE label = 0),
g AS (SELECT model, score, SUM(label) AS p, SUM(1 - label) AS q FROM m GROUP BY 1, 2),
cum AS (SELECT *, SUM(p) OVER (PARTITION BY model ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS tp FROM g),
auc AS (SELECT model, CASE WHEN SUM(p) = 0 THEN 0.0 WHEN SUM(q) = 0 THEN 1.0
                           ELSE SUM(q * (2 * tp - p)) / (2.0 * SUM(p) * SUM(q)) END AS roc_auc FROM cum GROUP BY 1),
c AS (SELECT model, COUNT(*) AS n, SUM(CASE WHEN label = 1 AND score >= 0.5 THEN 1.0 ELSE 0.0 END) AS tp,
             SUM(CASE WHEN label = 0 AND score >= 0.5 THEN 1.0 ELSE 0.0 END) AS fp,
             SUM(CASE WHEN label = 1 AND score < 0.5 THEN 1.0 ELSE 0.0 END) AS fn,
             SUM(CASE WHEN label = 0 AND score < 0.5 THEN 1.0 ELSE 0.0 END) AS tn FROM m GROUP BY 1),
r AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision,
             CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall FROM c)
SELECT r.model, n, ROUND((tp + tn) / n, 6) AS accuracy, ROUND(precision, 6) AS precision, ROUND(recall, 6) AS recall,
       ROUND(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END, 6) AS f1,
       ROUND(roc_auc, 6) AS roc_auc
FROM r JOIN auc ON auc.model = r.model"""))
def score_sets_compared(spark, sf_dir):
    """MDL9 / EVL4: six score sets of one table, two of them with one class only, compared in one job."""
    p = F.col("churn_probability")
    sets = {"score": (p, None), "inverted": (1 - p, None), "coarse": (F.floor(p * 10) / 10, None),
            "constant": (F.lit(0.5), None), "churners_only": (p, 1), "stayers_only": (p, 0)}
    one = [F.struct(F.lit(name).alias("model"), score.cast("double").alias("score"), F.lit(only).cast("int").alias("only"))
           for name, (score, only) in sets.items()]
    stacked = (C.scores(spark, sf_dir).select("label", F.explode(F.array(*one)).alias("m")).select("label", "m.*")
               .where(F.col("only").isNull() | (F.col("only") == F.col("label")))
               .withColumn("prediction", EV.hard_label("score")))
    m = EV.compare_models(stacked, ["model"], prediction="prediction")
    return m.select("model", "n", *[C.r6(c) for c in ("accuracy", "precision", "recall", "f1", "roc_auc")])


_REG_SQL = """
r AS (SELECT c."TotalCharges" AS actual, sc.ltv_prediction AS predicted
      FROM c JOIN sc ON sc."customerID" = c."customerID")"""


@register("regression_metrics", with_clean(f"""
WITH {_REG_SQL.replace('JOIN sc', 'JOIN (SELECT "customerID", "MonthlyCharges" * (tenure + 1) AS ltv_prediction FROM s) sc')}
SELECT ROUND(AVG(CAST(ABS(predicted - actual) AS DECIMAL(38,6))), 6) AS mae,
       ROUND(AVG(CAST((predicted - actual) * (predicted - actual) AS DECIMAL(38,6))), 6) AS mse,
       ROUND(SQRT(AVG(CAST((predicted - actual) * (predicted - actual) AS DECIMAL(38,6)))), 6) AS rmse,
       ROUND(1 - CAST(SUM(CAST((predicted - actual) * (predicted - actual) AS DECIMAL(38,6))) AS DOUBLE)
                 / (VAR_POP(actual) * COUNT(actual)), 6) AS r2
FROM r"""))
def regression_metrics(spark, sf_dir):
    """EVL6: MAE, MSE, RMSE, R2 of the LTV estimate against the cleaned total."""
    c = C.customers(spark, sf_dir).select("customerID", F.col("TotalCharges").alias("actual"))
    sc = C.scores(spark, sf_dir).select("customerID", F.col("ltv_prediction").alias("predicted"))
    m = EV.regression_metrics(c.join(sc, "customerID"))
    return m.select(*[C.r6(x) for x in ("mae", "mse", "rmse", "r2")])


# ---------------------------------------------------------------- tiers and segments
@register("risk_tier_online", with_scores("""
SELECT "customerID", ROUND(churn_probability, 6) AS churn_probability,
       CASE WHEN churn_probability >= 0.65 THEN 'HIGH' WHEN churn_probability >= 0.35 THEN 'MEDIUM'
            ELSE 'LOW' END AS churn_risk_tier FROM sc"""))
def risk_tier_online(spark, sf_dir):
    """SCO5: API cut-offs on the unrounded probability."""
    t = SG.add_tier(C.scores(spark, sf_dir), preset="online")
    return t.select("customerID", C.r6("churn_probability"), "churn_risk_tier")


@register("risk_tier_offline", with_scores("""
SELECT "customerID", ROUND_EVEN(churn_probability, 4) AS churn_probability,
       CASE WHEN ROUND_EVEN(churn_probability, 4) >= 0.7 THEN 'HIGH'
            WHEN ROUND_EVEN(churn_probability, 4) >= 0.4 THEN 'MEDIUM' ELSE 'LOW' END AS churn_risk_tier
FROM sc"""))
def risk_tier_offline(spark, sf_dir):
    """SCO6: batch-job cut-offs on the probability rounded to 4 places."""
    t = SG.add_tier(C.scores(spark, sf_dir), preset="offline")
    return t.select("customerID", F.bround("churn_probability", 4).alias("churn_probability"),
                    "churn_risk_tier")


@register("high_risk", with_log("""
SELECT id, customer_id, ROUND(churn_probability, 6) AS churn_probability FROM lg
WHERE churn_probability >= 0.65"""))
def high_risk(spark, sf_dir):
    """FLT5: log rows in the HIGH tier."""
    t = SG.add_tier(C.log(spark, sf_dir), preset="online")
    return t.where(F.col("churn_risk_tier") == "HIGH").select("id", "customer_id", C.r6("churn_probability"))


@register("risk_adjusted_ltv", with_scores("""
SELECT "customerID", ROUND(ltv_prediction * (1 - churn_probability), 6) AS risk_adjusted_ltv FROM sc"""))
def risk_adjusted_ltv(spark, sf_dir):
    """SEG1."""
    r = SG.risk_adjusted(C.scores(spark, sf_dir))
    return r.select("customerID", C.r6("risk_adjusted_ltv"))


_SEG_SQL = """
m AS (SELECT MEDIAN(ltv_prediction) AS med FROM sc),
sg AS (SELECT sc.*, ltv_prediction * (1 - churn_probability) AS risk_adjusted_ltv,
              CASE WHEN ltv_prediction >= med AND churn_probability >= 0.5 THEN 'Rescue Target (High Spend, High Churn Risk)'
                   WHEN ltv_prediction >= med THEN 'Loyal Champion (High Spend, Low Churn Risk)'
                   WHEN churn_probability >= 0.5 THEN 'Low Priority Churn (Low Spend, High Churn Risk)'
                   ELSE 'Stable Core (Low Spend, Low Churn Risk)' END AS segment
       FROM sc, m)"""


@register("value_risk_segments", with_scores(f"""
WITH {_SEG_SQL}
SELECT "customerID", segment FROM sg"""))
def value_risk_segments(spark, sf_dir):
    """SEG2: spend/risk quadrants around the exact median spend."""
    return SG.value_risk_segments(C.scores(spark, sf_dir)).select("customerID", "segment")


@register("segment_summary", with_scores(f"""
WITH {_SEG_SQL}
SELECT segment, COUNT(*) AS customers, ROUND(AVG(ltv_prediction), 6) AS avg_ltv,
       ROUND(AVG(churn_probability), 6) AS avg_churn_probability,
       ROUND(AVG(risk_adjusted_ltv), 6) AS avg_risk_adjusted_ltv
FROM sg GROUP BY segment"""))
def segment_summary(spark, sf_dir):
    """AGG14: per-segment count and means."""
    seg = SG.risk_adjusted(SG.value_risk_segments(C.scores(spark, sf_dir)))
    s = SG.segment_summary(seg)
    return s.select("segment", "customers", C.r6("avg_ltv"), C.r6("avg_churn_probability"),
                    C.r6("avg_risk_adjusted_ltv"))


@register("median_predicted_spend", with_scores("""
SELECT ROUND(MEDIAN(ltv_prediction), 6) AS median_ltv FROM sc"""))
def median_predicted_spend(spark, sf_dir):
    """AGG18: exact median without a single-task gather."""
    from ..operators.quantile import exact_median
    return exact_median(C.scores(spark, sf_dir), "ltv_prediction", name="median_ltv") \
        .select(C.r6("median_ltv"))


@register("top_risk_customer", with_scores("""
SELECT "customerID", ROUND(churn_probability, 6) AS churn_probability FROM sc
ORDER BY churn_probability DESC, "customerID" LIMIT 1"""))
def top_risk_customer(spark, sf_dir):
    """TOP3: highest-probability customer (ties -> smallest id)."""
    return SG.top_risk(C.scores(spark, sf_dir)).select("customerID", C.r6("churn_probability"))
