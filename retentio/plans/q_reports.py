"""Report, view, profile and dashboard queries (AGG*, PRF*, FLT*, SEG3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import report as R
from . import common as C
from .catalog import register
from .oracle_sql import with_clean, with_log, with_subscribers

# Dashboard filter used by the filtered KPI query (FLT1-3 with values that
# occur in the derived data).
FILTER_CONTRACTS = ["AUTOMOBILE", "BUILDING", "MACHINERY"]
FILTER_INTERNET = ["AMERICA", "ASIA", "EUROPE"]
FILTER_TENURE = (6, 60)
FILTER_MONTHLY = (150000.0, 350000.0)
FILTER_GENDER = "Female"


@register("churn_by_contract", with_clean("""
SELECT "Contract", COUNT(*) AS total_customers, CAST(SUM("Churn") AS BIGINT) AS churned,
       ROUND(AVG("Churn") * 100, 2) AS churn_rate_pct,
       ROUND(AVG("MonthlyCharges"), 2) AS avg_monthly_charges
FROM c GROUP BY "Contract" ORDER BY churn_rate_pct DESC NULLS FIRST"""))
def churn_by_contract(spark, sf_dir):
    return R.churn_by_contract(C.labelled(spark, sf_dir))


@register("ltv_segments", with_log("""
SELECT CASE WHEN churn_probability >= 0.65 THEN 'HIGH'
            WHEN churn_probability >= 0.35 THEN 'MEDIUM' ELSE 'LOW' END AS churn_risk_tier,
       COUNT(*) AS customers, ROUND(AVG(ltv_prediction), 2) AS avg_ltv,
       ROUND(AVG(churn_probability) * 100, 2) AS avg_churn_prob_pct
FROM lg GROUP BY 1 ORDER BY avg_ltv DESC NULLS FIRST"""))
def ltv_segments(spark, sf_dir):
    return R.ltv_segments(C.log(spark, sf_dir))


@register("kpi_overall", with_clean("""
SELECT COUNT(*) AS n_total, CAST(SUM("Churn") AS BIGINT) AS n_churned,
       ROUND(SUM("Churn") / COUNT(*) * 100, 6) AS churn_rate,
       ROUND(AVG("MonthlyCharges"), 6) AS avg_charges, ROUND(AVG(tenure), 6) AS avg_tenure
FROM c"""))
def kpi_overall(spark, sf_dir):
    k = R.kpis(C.labelled(spark, sf_dir))
    return k.select("n_total", "n_churned", C.r6("churn_rate"), C.r6("avg_charges"), C.r6("avg_tenure"))


_FILTER_SQL = (
    """("Contract" IN ('AUTOMOBILE', 'BUILDING', 'MACHINERY')
      AND "InternetService" IN ('AMERICA', 'ASIA', 'EUROPE')
      AND tenure BETWEEN 6 AND 60 AND "MonthlyCharges" BETWEEN 150000.0 AND 350000.0
      AND gender = 'Female')""")


@register("kpi_filtered_vs_overall", with_clean(f"""
SELECT CAST(SUM(CASE WHEN {_FILTER_SQL} THEN 1 ELSE 0 END) AS BIGINT) AS n_filtered,
       COUNT(*) AS n_total,
       CAST(SUM(CASE WHEN {_FILTER_SQL} THEN "Churn" END) AS BIGINT) AS n_churned,
       ROUND(SUM(CASE WHEN {_FILTER_SQL} THEN "Churn" END)
             / SUM(CASE WHEN {_FILTER_SQL} THEN 1 ELSE 0 END) * 100, 6) AS churn_rate,
       ROUND(AVG(CASE WHEN {_FILTER_SQL} THEN "MonthlyCharges" END), 6) AS avg_charges,
       ROUND(AVG("MonthlyCharges"), 6) AS avg_charges_overall,
       ROUND(AVG(CASE WHEN {_FILTER_SQL} THEN tenure END), 6) AS avg_tenure,
       ROUND(AVG(tenure), 6) AS avg_tenure_overall
FROM c"""))
def kpi_filtered_vs_overall(spark, sf_dir):
    pred = R.dashboard_filter(FILTER_CONTRACTS, FILTER_INTERNET, FILTER_TENURE,
                              FILTER_MONTHLY, FILTER_GENDER)
    k = R.kpis_filtered_vs_overall(C.labelled(spark, sf_dir), pred)
    return k.select("n_filtered", "n_total", "n_churned",
                    *[C.r6(c) for c in ["churn_rate", "avg_charges", "avg_charges_overall",
                                        "avg_tenure", "avg_tenure_overall"]])


@register("filtered_customers", with_clean(f"""
SELECT "customerID", "Contract", "InternetService", tenure,
       ROUND("MonthlyCharges", 6) AS "MonthlyCharges", "Churn"
FROM c WHERE {_FILTER_SQL}"""))
def filtered_customers(spark, sf_dir):
    """FLT1-4: the dashboard's filtered slice (empty result is a valid answer)."""
    pred = R.dashboard_filter(FILTER_CONTRACTS, FILTER_INTERNET, FILTER_TENURE,
                              FILTER_MONTHLY, FILTER_GENDER)
    return (C.labelled(spark, sf_dir).where(pred)
            .select("customerID", "Contract", "InternetService", "tenure",
                    C.r6("MonthlyCharges"), "Churn"))


@register("churn_share", with_clean("""
SELECT "Churn", COUNT(*) AS n, ROUND(COUNT(*) / SUM(COUNT(*)) OVER (), 6) AS share
FROM c GROUP BY "Churn" """))
def churn_share(spark, sf_dir):
    s = R.churn_share(C.labelled(spark, sf_dir))
    return s.select("Churn", "n", C.r6("share"))


@register("class_balance", with_subscribers("""
SELECT "Churn" AS churn_text, COUNT(*) AS n, ROUND(COUNT(*) / SUM(COUNT(*)) OVER () * 100, 6) AS pct
FROM s GROUP BY "Churn" """))
def class_balance(spark, sf_dir):
    """AGG13 on the raw Yes/No text: counts and normalised percent."""
    s = R.churn_share(C.raw(spark, sf_dir), label="Churn")
    return s.select(F.col("Churn").alias("churn_text"), "n", C.r6(F.col("share") * 100, "pct"))


@register("contract_churn_pivot", with_subscribers("""
SELECT "Contract", CAST(SUM(CASE WHEN "Churn" = 'No' THEN 1 ELSE 0 END) AS BIGINT) AS "No",
       CAST(SUM(CASE WHEN "Churn" = 'Yes' THEN 1 ELSE 0 END) AS BIGINT) AS "Yes"
FROM s GROUP BY "Contract" """))
def contract_churn_pivot(spark, sf_dir):
    return R.crosstab_counts(C.raw(spark, sf_dir), "Contract")


@register("internet_churn_counts", with_subscribers("""
SELECT "InternetService", CAST(SUM(CASE WHEN "Churn" = 'No' THEN 1 ELSE 0 END) AS BIGINT) AS "No",
       CAST(SUM(CASE WHEN "Churn" = 'Yes' THEN 1 ELSE 0 END) AS BIGINT) AS "Yes"
FROM s GROUP BY "InternetService" """))
def internet_churn_counts(spark, sf_dir):
    return R.crosstab_counts(C.raw(spark, sf_dir), "InternetService")


@register("internet_churn_rate", with_clean("""
SELECT "InternetService", ROUND(AVG("Churn"), 6) AS churn_rate,
       ROUND(AVG("Churn") * 100, 1) AS churn_pct
FROM c GROUP BY "InternetService" ORDER BY churn_rate"""))
def internet_churn_rate(spark, sf_dir):
    r = R.rate_by(C.labelled(spark, sf_dir), "InternetService")
    return r.select("InternetService", C.r6("churn_rate"), "churn_pct")


@register("payment_churn_rate", with_clean("""
SELECT "PaymentMethod", ROUND(AVG("Churn"), 6) AS churn_rate,
       ROUND(AVG("Churn") * 100, 1) AS churn_pct
FROM c GROUP BY "PaymentMethod" ORDER BY churn_rate"""))
def payment_churn_rate(spark, sf_dir):
    r = R.rate_by(C.labelled(spark, sf_dir), "PaymentMethod")
    return r.select("PaymentMethod", C.r6("churn_rate"), "churn_pct")


@register("payment_rate_normalised", with_clean("""
WITH r AS (SELECT "PaymentMethod", ROUND(AVG("Churn") * 100, 1) AS churn_pct FROM c GROUP BY 1)
SELECT "PaymentMethod", churn_pct,
       ROUND((churn_pct - MIN(churn_pct) OVER ()) / (MAX(churn_pct) OVER () - MIN(churn_pct) OVER () + 1e-9), 6) AS norm
FROM r"""))
def payment_rate_normalised(spark, sf_dir):
    r = R.rate_by(C.labelled(spark, sf_dir), "PaymentMethod").select("PaymentMethod", "churn_pct")
    return R.min_max_normalise(r).select("PaymentMethod", "churn_pct", C.r6("norm"))


@register("revenue_by_contract", with_clean("""
SELECT "Contract", COUNT(*) AS customers, ROUND(SUM("MonthlyCharges"), 6) AS monthly_revenue,
       ROUND(SUM("TotalCharges"), 6) AS total_revenue, ROUND(AVG("Churn"), 6) AS churn_rate
FROM c GROUP BY "Contract" """))
def revenue_by_contract(spark, sf_dir):
    """AGG17: customers, revenue and churn rate by group (BI suggestions)."""
    c = C.customers(spark, sf_dir)
    return c.groupBy("Contract").agg(
        F.count(F.lit(1)).alias("customers"), C.r6(F.sum("MonthlyCharges"), "monthly_revenue"),
        C.r6(F.sum("TotalCharges"), "total_revenue"), C.r6(F.avg("Churn"), "churn_rate"))


@register("null_profile", with_subscribers("""
WITH s2 AS (SELECT s.*, CASE WHEN regexp_matches("TotalCharges", '^\\s*$') THEN NULL
                             ELSE TRY_CAST("TotalCharges" AS DOUBLE) END AS tc FROM s)
SELECT 'TotalCharges' AS "column", COUNT(*) - COUNT(tc) AS nulls, COUNT(tc) AS non_null
FROM s2 HAVING COUNT(*) - COUNT(tc) > 0"""))
def null_profile(spark, sf_dir):
    """PRF1-3: per-column missing counts after numeric coercion (only > 0)."""
    from ..functions.columns import to_number
    raw = C.raw(spark, sf_dir).withColumn("TotalCharges", to_number("TotalCharges"))
    return R.null_profile(raw)


@register("blank_profile", with_subscribers("""
SELECT 'TotalCharges' AS "column", CAST(SUM(CASE WHEN "TotalCharges" = ' ' THEN 1 ELSE 0 END) AS BIGINT) AS blanks
FROM s"""))
def blank_profile(spark, sf_dir):
    """PRF4: cells that are exactly one space."""
    return R.blank_profile(C.raw(spark, sf_dir), ["TotalCharges"])


@register("distinct_values", with_subscribers("""
SELECT DISTINCT 'Contract' AS "column", "Contract" AS value FROM s
UNION ALL SELECT DISTINCT 'InternetService', "InternetService" FROM s
UNION ALL SELECT DISTINCT 'PaymentMethod', "PaymentMethod" FROM s
UNION ALL SELECT DISTINCT 'gender', gender FROM s"""))
def distinct_values(spark, sf_dir):
    """PRF5: sorted distinct values of the filter columns."""
    return R.distinct_values(C.raw(spark, sf_dir),
                             ["Contract", "InternetService", "PaymentMethod", "gender"])


@register("risk_factor_lift", with_clean("""
WITH named AS (
  SELECT c.* REPLACE (
           CASE WHEN "Contract" = 'BUILDING' THEN 'Month-to-month' ELSE "Contract" END AS "Contract",
           CASE WHEN "InternetService" = 'ASIA' THEN 'Fiber optic' ELSE "InternetService" END AS "InternetService",
           CASE WHEN "PaymentMethod" IN ('BRAZIL', 'CHINA', 'FRANCE', 'KENYA', 'PERU') THEN 'Electronic check'
                ELSE "PaymentMethod" END AS "PaymentMethod")
  FROM c),
a AS (
  SELECT AVG("Churn") AS rate,
         SUM(CASE WHEN "Contract" = 'Month-to-month' THEN 1 ELSE 0 END) AS n0,
         AVG(CASE WHEN "Contract" = 'Month-to-month' THEN "Churn" END) AS r0,
         SUM(CASE WHEN "InternetService" = 'Fiber optic' THEN 1 ELSE 0 END) AS n1,
         AVG(CASE WHEN "InternetService" = 'Fiber optic' THEN "Churn" END) AS r1,
         SUM(CASE WHEN tenure BETWEEN 0 AND 12 THEN 1 ELSE 0 END) AS n2,
         AVG(CASE WHEN tenure BETWEEN 0 AND 12 THEN "Churn" END) AS r2,
         SUM(CASE WHEN "PaymentMethod" = 'Electronic check' THEN 1 ELSE 0 END) AS n3,
         AVG(CASE WHEN "PaymentMethod" = 'Electronic check' THEN "Churn" END) AS r3,
         SUM(CASE WHEN "SeniorCitizen" = 1 THEN 1 ELSE 0 END) AS n4,
         AVG(CASE WHEN "SeniorCitizen" = 1 THEN "Churn" END) AS r4
  FROM named)
SELECT 'Month-to-month contract' AS factor, 'HIGH' AS level, CAST(n0 AS BIGINT) AS n, ROUND(r0, 6) AS churn_rate, ROUND(r0 / rate, 6) AS lift FROM a
UNION ALL SELECT 'Fiber optic service', 'HIGH', CAST(n1 AS BIGINT), ROUND(r1, 6), ROUND(r1 / rate, 6) FROM a
UNION ALL SELECT 'Tenure 0–12 months', 'MED', CAST(n2 AS BIGINT), ROUND(r2, 6), ROUND(r2 / rate, 6) FROM a
UNION ALL SELECT 'Electronic check payment', 'MED', CAST(n3 AS BIGINT), ROUND(r3, 6), ROUND(r3 / rate, 6) FROM a
UNION ALL SELECT 'Senior citizen', 'LOW', CAST(n4 AS BIGINT), ROUND(r4, 6), ROUND(r4 / rate, 6) FROM a"""))
def risk_factor_lift(spark, sf_dir):
    """SEG3: the given tables' values stand for the factors' ones, so that every factor occurs."""
    stands_for = {"Contract": ("Month-to-month", ["BUILDING"]), "InternetService": ("Fiber optic", ["ASIA"]),
                  "PaymentMethod": ("Electronic check", ["BRAZIL", "CHINA", "FRANCE", "KENYA", "PERU"])}
    customers = C.labelled(spark, sf_dir).withColumns({
        c: F.when(F.col(c).isin(values), name).otherwise(F.col(c)) for c, (name, values) in stands_for.items()})
    r = R.risk_factor_lift(customers)
    return r.select("factor", "level", "n", C.r6("churn_rate"), C.r6("lift"))
