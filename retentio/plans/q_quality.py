"""Data-quality, referential and upsert queries (DQ1-5, JN5-6, SNK1, PRJ1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import to_number
from ..operators import quality as Q
from ..operators.clean import to_db_columns
from ..schemas import DB_RENAME, REQUIRED_COLUMNS
from ..sources import fixture
from . import common as C
from .catalog import register
from .oracle_sql import with_clean, with_log_and_subscribers, with_subscribers


@register("quality_rules", with_clean("""
SELECT 'senior_citizen_in_0_1' AS rule, COUNT(*) AS checked,
       CAST(SUM(CASE WHEN COALESCE("SeniorCitizen" IN (0, 1), TRUE) THEN 0 ELSE 1 END) AS BIGINT) AS violations FROM c
UNION ALL SELECT 'tenure_non_negative', COUNT(*),
       CAST(SUM(CASE WHEN COALESCE(tenure >= 0, TRUE) THEN 0 ELSE 1 END) AS BIGINT) FROM c
UNION ALL SELECT 'churn_in_0_1', COUNT(*),
       CAST(SUM(CASE WHEN COALESCE("Churn" IN (0, 1), TRUE) THEN 0 ELSE 1 END) AS BIGINT) FROM c"""))
def quality_rules(spark, sf_dir):
    """DQ1: table CHECK rules in one pass (NULL passes)."""
    return Q.rule_report(C.customers(spark, sf_dir), Q.table_rules())


def _request_sql() -> str:
    parts = []
    for col in REQUIRED_COLUMNS:
        src = f'"{col}"'
        parts.append(f"SELECT '{col}_required' AS rule, COUNT(*) AS checked, "
                     f"CAST(SUM(CASE WHEN {src} IS NOT NULL THEN 0 ELSE 1 END) AS BIGINT) AS violations FROM r")
    checks = [("senior_citizen_0_to_1", '"SeniorCitizen" BETWEEN 0 AND 1'),
              ("tenure_non_negative", "tenure >= 0"),
              ("monthly_non_negative", '"MonthlyCharges" >= 0'),
              ("total_non_negative", '"TotalCharges" >= 0')]
    for name, pred in checks:
        parts.append(f"SELECT '{name}', COUNT(*), CAST(SUM(CASE WHEN COALESCE({pred}, FALSE) THEN 0 ELSE 1 END) AS BIGINT) FROM r")
    body = "\nUNION ALL ".join(parts)
    return with_subscribers(f"""
WITH r AS (SELECT s.* REPLACE (CASE WHEN regexp_matches("TotalCharges", '^\\s*$') THEN NULL
                                    ELSE TRY_CAST("TotalCharges" AS DOUBLE) END AS "TotalCharges") FROM s)
{body}""")


@register("request_checks", _request_sql())
def request_checks(spark, sf_dir):
    """DQ2: request-level validation (all fields required, ranges; NULL fails)."""
    raw = C.raw(spark, sf_dir).withColumn("TotalCharges", to_number("TotalCharges"))
    return Q.rule_report(raw, Q.request_rules(REQUIRED_COLUMNS))


@register("quarantine", with_subscribers("""
SELECT "customerID", ['total_non_negative'] AS failed_rules FROM s
WHERE COALESCE(CASE WHEN regexp_matches("TotalCharges", '^\\s*$') THEN NULL
                    ELSE TRY_CAST("TotalCharges" AS DOUBLE) END >= 0, FALSE) = FALSE"""))
def quarantine(spark, sf_dir):
    """DQ2 split: rows failing any request rule, with the failed rule names."""
    raw = C.raw(spark, sf_dir).withColumn("TotalCharges", to_number("TotalCharges"))
    _, bad = Q.split_valid(raw, Q.request_rules(REQUIRED_COLUMNS))
    return bad.select("customerID", "failed_rules")


_DB_COLS = [dst for _, dst in DB_RENAME]


def _db_select_sql(prefix: str) -> str:
    out = []
    for src, dst in DB_RENAME:
        if dst in ("monthly_charges", "total_charges"):
            out.append(f'ROUND({prefix}"{src}", 6) AS {dst}')
        else:
            out.append(f'{prefix}"{src}" AS {dst}')
    return ", ".join(out)


@register("customer_table", with_clean(f"SELECT {_db_select_sql('')} FROM c"))
def customer_table(spark, sf_dir):
    """PRJ1: rename to the table's column names, in map order."""
    t = to_db_columns(C.customers(spark, sf_dir))
    return t.withColumn("monthly_charges", C.r6("monthly_charges")) \
        .withColumn("total_charges", C.r6("total_charges"))


_UPSERT_SQL = f"""
t AS (SELECT {_db_select_sql('')}, TIMESTAMP '{fixture.LOAD_TIME}' AS ingested_at FROM c),
fd AS (SELECT c.* REPLACE (CAST(NULL AS VARCHAR) AS "Contract") FROM c WHERE tenure > 60
       UNION ALL
       SELECT c.* REPLACE (CAST(CAST("customerID" AS BIGINT) + 1000000 AS VARCHAR) AS "customerID")
       FROM c WHERE "SeniorCitizen" = 1),
src AS (SELECT {_db_select_sql('')}, TIMESTAMP '{fixture.FEED_TIME}' AS ingested_at FROM fd)"""


def _upsert_body() -> str:
    cols = []
    for dst in _DB_COLS:
        if dst == "customer_id":
            cols.append("COALESCE(src.customer_id, t.customer_id) AS customer_id")
        else:
            cols.append(f"CASE WHEN src.customer_id IS NOT NULL THEN src.{dst} ELSE t.{dst} END AS {dst}")
    cols.append("COALESCE(t.ingested_at, src.ingested_at) AS ingested_at")
    return f"SELECT {', '.join(cols)} FROM t FULL OUTER JOIN src ON t.customer_id = src.customer_id"


@register("upsert_customers", with_clean(f"WITH {_UPSERT_SQL}\n{_upsert_body()}"))
def upsert_customers(spark, sf_dir):
    """SNK1: keyed upsert; updated rows take the whole new row, ingested_at keeps the first load."""
    c = C.customers(spark, sf_dir)
    target = to_db_columns(c).withColumn("ingested_at", F.lit(fixture.LOAD_TIME).cast("timestamp_ntz"))
    source = to_db_columns(fixture.upsert_feed(c)).withColumn(
        "ingested_at", F.lit(fixture.FEED_TIME).cast("timestamp_ntz"))
    merged = Q.upsert(target, source, "customer_id", keep_first=["ingested_at"])
    return merged.withColumn("monthly_charges", C.r6("monthly_charges")) \
        .withColumn("total_charges", C.r6("total_charges"))


@register("duplicate_keys", with_clean(f"""
WITH {_UPSERT_SQL},
k AS (SELECT customer_id FROM t UNION ALL SELECT customer_id FROM src)
SELECT customer_id, COUNT(*) AS n FROM k GROUP BY customer_id HAVING COUNT(*) > 1"""))
def duplicate_keys(spark, sf_dir):
    """DQ3: keys present more than once in the staged union of table and feed."""
    c = C.customers(spark, sf_dir)
    keys = to_db_columns(c).select("customer_id").unionByName(
        to_db_columns(fixture.upsert_feed(c)).select("customer_id"))
    return Q.duplicate_keys(keys, "customer_id")


@register("orphan_predictions", with_log_and_subscribers("""
SELECT id, customer_id FROM lg WHERE customer_id IS NOT NULL
AND customer_id NOT IN (SELECT "customerID" FROM s)"""))
def orphan_predictions(spark, sf_dir):
    """DQ4: log rows whose customer does not exist (anti-join)."""
    o = Q.orphans(C.log(spark, sf_dir), C.raw(spark, sf_dir), "customer_id", "customerID")
    return o.select("id", "customer_id")


@register("valid_predictions", with_log_and_subscribers("""
SELECT id, customer_id FROM lg WHERE customer_id IN (SELECT "customerID" FROM s)"""))
def valid_predictions(spark, sf_dir):
    """JN6: log rows with an existing customer (semi-join)."""
    v = Q.valid_children(C.log(spark, sf_dir), C.raw(spark, sf_dir), "customer_id", "customerID")
    return v.select("id", "customer_id")


@register("set_null_orphans", with_log_and_subscribers("""
SELECT id, CASE WHEN customer_id IN (SELECT "customerID" FROM s) THEN customer_id END AS customer_id FROM lg"""))
def set_null_orphans(spark, sf_dir):
    """DQ5: ON DELETE SET NULL applied to the log."""
    return Q.set_null_orphans(C.log(spark, sf_dir), C.raw(spark, sf_dir), "customer_id", "customerID") \
        .select("id", "customer_id")


@register("predictions_by_contract", with_log_and_subscribers("""
SELECT s."Contract", COUNT(*) AS predictions, ROUND(AVG(lg.churn_probability), 6) AS avg_churn_probability,
       ROUND(SUM(lg.ltv_prediction), 6) AS total_ltv
FROM lg JOIN s ON lg.customer_id = s."customerID" GROUP BY s."Contract" """))
def predictions_by_contract(spark, sf_dir):
    """JN5: prediction log joined to customers (AQE picks broadcast or sort-merge)."""
    lg = C.log(spark, sf_dir)
    s = C.raw(spark, sf_dir).select("customerID", "Contract")
    j = lg.join(s, lg["customer_id"] == s["customerID"])
    return j.groupBy("Contract").agg(F.count(F.lit(1)).alias("predictions"),
                                     C.r6(F.avg("churn_probability"), "avg_churn_probability"),
                                     C.r6(F.sum("ltv_prediction"), "total_ltv"))
