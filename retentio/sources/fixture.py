"""Subscriber-shaped views derived from the star-schema test tables.

The derivation follows FIXTURES.md: one row per customer with order-history
statistics as the billing columns. The orders side is aggregated by customer
first (map-side partial aggregation, so a customer holding a third of all
orders collapses to one row per task before the shuffle) and then joined to
``customer`` on the key. ``nation`` and ``region`` are fixed-size dimension
tables (25 and 5 rows); the planner broadcasts them from their file size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import table

_MONEY = "decimal(18,2)"


def _yes_no(cond) -> F.Column:
    return F.when(cond, F.lit("Yes")).otherwise(F.lit("No"))


def order_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    price = F.col("o_totalprice").cast(_MONEY)

    def n_priority(p: str) -> F.Column:
        return F.sum(F.when(F.col("o_orderpriority") == p, 1).otherwise(0))

    return o.groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n_orders"),
        F.min("o_orderdate").alias("first_d"),
        F.max("o_orderdate").alias("last_d"),
        F.sum(price).alias("gross"),
        F.sum(F.when(F.col("o_orderstatus") == "F", price)).alias("billed"),
        n_priority("1-URGENT").alias("n1"),
        n_priority("2-HIGH").alias("n2"),
        n_priority("3-MEDIUM").alias("n3"),
        n_priority("4-NOT SPECIFIED").alias("n4"),
        n_priority("5-LOW").alias("n5"),
        F.sum(F.when(F.col("o_orderstatus") == "P", 1).otherwise(0)).alias("n6"),
    )


def raw_subscribers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw 21-column subscriber table (TotalCharges as text, Churn Yes/No)."""
    c = table(spark, sf_dir, "customer")
    n = table(spark, sf_dir, "nation")
    r = table(spark, sf_dir, "region")
    o = order_stats(spark, sf_dir)
    key = F.col("c_custkey")
    months = ((F.year("last_d") - F.year("first_d")) * 12
              + F.month("last_d") - F.month("first_d"))
    joined = (c.join(o, key == F.col("o_custkey"), "left")
              .join(n, F.col("n_nationkey") == F.col("c_nationkey"))
              .join(r, F.col("r_regionkey") == F.col("n_regionkey")))
    return joined.select(
        key.cast("string").alias("customerID"),
        F.when(key % 2 == 0, "Female").otherwise("Male").alias("gender"),
        F.when(F.col("c_acctbal") < 0, 1).otherwise(0).alias("SeniorCitizen"),
        _yes_no(key % 3 == 0).alias("Partner"),
        _yes_no(key % 5 == 0).alias("Dependents"),
        months.cast("int").alias("tenure"),
        _yes_no(key % 10 < 9).alias("PhoneService"),
        _yes_no(F.col("n_orders") > 10).alias("MultipleLines"),
        F.col("r_name").alias("InternetService"),
        _yes_no(F.col("n1") > 2).alias("OnlineSecurity"),
        _yes_no(F.col("n2") > 2).alias("OnlineBackup"),
        _yes_no(F.col("n3") > 2).alias("DeviceProtection"),
        _yes_no(F.col("n4") > 2).alias("TechSupport"),
        _yes_no(F.col("n5") > 2).alias("StreamingTV"),
        _yes_no(F.col("n6") > 3).alias("StreamingMovies"),
        F.col("c_mktsegment").alias("Contract"),
        _yes_no(key % 7 < 4).alias("PaperlessBilling"),
        F.col("n_name").alias("PaymentMethod"),
        (F.col("gross").cast("double") / F.col("n_orders")).alias("MonthlyCharges"),
        F.coalesce(F.col("billed").cast("string"), F.lit(" ")).alias("TotalCharges"),
        _yes_no(F.col("last_d") < F.lit("2000-10-01 00:00:00").cast("timestamp_ntz")).alias("Churn"),
    )


def model_free_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deterministic score table: label, churn_probability, ltv_prediction per customer.

    Model-free so evaluation, tier and segment operators have an exact oracle.
    """
    s = raw_subscribers(spark, sf_dir)
    label = F.when(F.col("Churn") == "Yes", 1).otherwise(0)
    spread = ((F.col("customerID").cast("bigint") * 7919 + 104729) % 1009).cast("double") / 1009
    return s.select(
        "customerID",
        label.alias("label"),
        (F.lit(0.3) * label + F.lit(0.7) * spread).alias("churn_probability"),
        (F.col("MonthlyCharges") * (F.col("tenure") + 1)).alias("ltv_prediction"),
    )


def prediction_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prediction-log rows derived from ``events`` (some reference unknown customers)."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("id"),
        (F.col("user_id") * 11).cast("string").alias("customer_id"),
        F.least(F.col("value") / 200, F.lit(1.0)).alias("churn_probability"),
        (F.col("value") * 100).alias("ltv_prediction"),
        F.lit("2.0.0").alias("model_version"),
        F.col("ts").alias("predicted_at"),
    )


LOAD_TIME = "2024-01-01 00:00:00"
FEED_TIME = "2024-02-01 00:00:00"


def upsert_feed(customers: DataFrame) -> DataFrame:
    """A later snapshot of the customer table, derived from the data itself.

    Long-tenured customers (tenure > 60) come back with ``Contract`` cleared
    (proves replace-with-null); senior customers come back under new keys
    (``key + 1000000``), which the upsert must insert.
    """
    updates = customers.where(F.col("tenure") > 60).withColumn("Contract", F.lit(None).cast("string"))
    new = (customers.where(F.col("SeniorCitizen") == 1)
           .withColumn("customerID", (F.col("customerID").cast("bigint") + 1000000).cast("string")))
    return updates.unionByName(new)
