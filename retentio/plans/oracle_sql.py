"""Shared SQL text for the DuckDB oracle (independent of the Spark code).

``SUBSCRIBERS`` is the FIXTURES.md derivation; the CTE prefixes below build the
cleaned table, the model-free score table and the prediction log on top of it.
"""

from __future__ import annotations

SUBSCRIBERS = """
o AS (
  SELECT o_custkey,
         COUNT(*) AS n_orders, MIN(o_orderdate) AS first_d, MAX(o_orderdate) AS last_d,
         SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS gross,
         SUM(CASE WHEN o_orderstatus = 'F' THEN CAST(o_totalprice AS DECIMAL(18,2)) END) AS billed,
         SUM(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END) AS n1,
         SUM(CASE WHEN o_orderpriority = '2-HIGH' THEN 1 ELSE 0 END) AS n2,
         SUM(CASE WHEN o_orderpriority = '3-MEDIUM' THEN 1 ELSE 0 END) AS n3,
         SUM(CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 1 ELSE 0 END) AS n4,
         SUM(CASE WHEN o_orderpriority = '5-LOW' THEN 1 ELSE 0 END) AS n5,
         SUM(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) AS n6
  FROM orders GROUP BY o_custkey),
s AS (
SELECT CAST(c_custkey AS VARCHAR(20))                                AS "customerID",
       CASE WHEN c_custkey % 2 = 0 THEN 'Female' ELSE 'Male' END     AS gender,
       CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END                     AS "SeniorCitizen",
       CASE WHEN c_custkey % 3 = 0 THEN 'Yes' ELSE 'No' END          AS "Partner",
       CASE WHEN c_custkey % 5 = 0 THEN 'Yes' ELSE 'No' END          AS "Dependents",
       CAST((YEAR(last_d) - YEAR(first_d)) * 12 + MONTH(last_d) - MONTH(first_d) AS INTEGER) AS tenure,
       CASE WHEN c_custkey % 10 < 9 THEN 'Yes' ELSE 'No' END         AS "PhoneService",
       CASE WHEN n_orders > 10 THEN 'Yes' ELSE 'No' END              AS "MultipleLines",
       r_name                                                        AS "InternetService",
       CASE WHEN n1 > 2 THEN 'Yes' ELSE 'No' END                     AS "OnlineSecurity",
       CASE WHEN n2 > 2 THEN 'Yes' ELSE 'No' END                     AS "OnlineBackup",
       CASE WHEN n3 > 2 THEN 'Yes' ELSE 'No' END                     AS "DeviceProtection",
       CASE WHEN n4 > 2 THEN 'Yes' ELSE 'No' END                     AS "TechSupport",
       CASE WHEN n5 > 2 THEN 'Yes' ELSE 'No' END                     AS "StreamingTV",
       CASE WHEN n6 > 3 THEN 'Yes' ELSE 'No' END                     AS "StreamingMovies",
       c_mktsegment                                                  AS "Contract",
       CASE WHEN c_custkey % 7 < 4 THEN 'Yes' ELSE 'No' END          AS "PaperlessBilling",
       n_name                                                        AS "PaymentMethod",
       CAST(gross AS DOUBLE) / n_orders                              AS "MonthlyCharges",
       COALESCE(CAST(billed AS VARCHAR(30)), ' ')                    AS "TotalCharges",
       CASE WHEN last_d < TIMESTAMP '2000-10-01 00:00:00' THEN 'Yes' ELSE 'No' END AS "Churn"
FROM customer
LEFT JOIN o ON o_custkey = c_custkey
JOIN nation ON n_nationkey = c_nationkey
JOIN region ON r_regionkey = n_regionkey)"""

# TotalCharges coerced (blank/unparsable/NaN -> NULL), tenure 0 -> 0.0
_COERCED = """
s1 AS (
  SELECT s.* REPLACE (
           CASE WHEN tenure = 0 THEN 0.0
                WHEN regexp_matches("TotalCharges", '^\\s*$') THEN NULL
                WHEN isnan(TRY_CAST("TotalCharges" AS DOUBLE)) THEN NULL
                ELSE TRY_CAST("TotalCharges" AS DOUBLE) END AS "TotalCharges")
  FROM s),
med AS (SELECT MEDIAN("TotalCharges") AS m FROM s1)"""

_CLEAN = """
c AS (
  SELECT s1.* REPLACE (
           COALESCE("TotalCharges", (SELECT m FROM med)) AS "TotalCharges",
           CAST(CASE WHEN "Churn" = 'Yes' THEN 1 WHEN "Churn" = 'No' THEN 0 END AS INTEGER) AS "Churn")
  FROM s1)"""

_FEATURES = """
f AS (
  SELECT c.*,
         CASE WHEN tenure IS NULL THEN '0-1 Year'
              WHEN LEAST(GREATEST(tenure, 0), 72) <= 12 THEN '0-1 Year'
              WHEN LEAST(GREATEST(tenure, 0), 72) <= 24 THEN '1-2 Years'
              WHEN LEAST(GREATEST(tenure, 0), 72) <= 36 THEN '2-3 Years'
              WHEN LEAST(GREATEST(tenure, 0), 72) <= 48 THEN '3-4 Years'
              WHEN LEAST(GREATEST(tenure, 0), 72) <= 60 THEN '4-5 Years'
              ELSE '5-6 Years' END AS tenure_group,
         CAST((CASE WHEN "OnlineSecurity" = 'Yes' THEN 1 ELSE 0 END)
            + (CASE WHEN "OnlineBackup" = 'Yes' THEN 1 ELSE 0 END)
            + (CASE WHEN "DeviceProtection" = 'Yes' THEN 1 ELSE 0 END)
            + (CASE WHEN "TechSupport" = 'Yes' THEN 1 ELSE 0 END)
            + (CASE WHEN "StreamingTV" = 'Yes' THEN 1 ELSE 0 END)
            + (CASE WHEN "StreamingMovies" = 'Yes' THEN 1 ELSE 0 END) AS INTEGER) AS total_services,
         CASE WHEN "TotalCharges" > 0 THEN "MonthlyCharges" / "TotalCharges" ELSE 0.0 END AS charge_ratio,
         "TotalCharges" - tenure * "MonthlyCharges" AS charges_difference
  FROM c)"""

_SCORES = """
sc AS (
  SELECT s."customerID",
         CASE WHEN s."Churn" = 'Yes' THEN 1 ELSE 0 END AS label,
         0.3 * (CASE WHEN s."Churn" = 'Yes' THEN 1 ELSE 0 END)
           + 0.7 * (CAST((CAST(s."customerID" AS BIGINT) * 7919 + 104729) % 1009 AS DOUBLE) / 1009) AS churn_probability,
         s."MonthlyCharges" * (s.tenure + 1) AS ltv_prediction
  FROM s)"""

_LOG = """
lg AS (
  SELECT event_id AS id,
         CAST(user_id * 11 AS VARCHAR(20)) AS customer_id,
         LEAST(value / 200, 1.0) AS churn_probability,
         value * 100 AS ltv_prediction,
         '2.0.0' AS model_version,
         ts AS predicted_at
  FROM events)"""


def _compose(ctes: list[str], body: str) -> str:
    body = body.strip()
    if body[:4].upper() == "WITH":
        return "WITH " + ",".join(ctes) + ",\n" + body[4:].lstrip()
    return "WITH " + ",".join(ctes) + "\n" + body


def with_subscribers(body: str) -> str:
    return _compose([SUBSCRIBERS], body)


def with_clean(body: str) -> str:
    return _compose([SUBSCRIBERS, _COERCED, _CLEAN], body)


def with_features(body: str) -> str:
    return _compose([SUBSCRIBERS, _COERCED, _CLEAN, _FEATURES], body)


def with_scores(body: str) -> str:
    return _compose([SUBSCRIBERS, _SCORES], body)


def with_log(body: str) -> str:
    return _compose([_LOG], body)


def with_log_and_subscribers(body: str) -> str:
    return _compose([SUBSCRIBERS, _LOG], body)
