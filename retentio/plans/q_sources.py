"""Places in source files, table loads, filter guards and stored sketches (SRC1, PRJ4, SNK8, SNK9, FLT4, CLN3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import report as R
from ..operators import sketch as SK
from ..operators.clean import to_db_columns
from ..operators.quantile import exact_quantiles
from ..sources import positions as POS
from ..sources import table_def as TD
from ..streaming.stream import run_folder
from . import common as C
from .catalog import register
from .oracle_sql import with_clean, with_log, with_subscribers

_PLACED_SQL = """
WITH lines AS (
  SELECT *, CAST("customerID" AS BIGINT) AS k,
         ROW_NUMBER() OVER (ORDER BY CAST("customerID" AS BIGINT)) - 1 AS position FROM s)"""


def _placed(spark, sf_dir):
    """The raw table written as CSV in key order and read with places: every 9th key blank, every 50th tenure no number."""
    path, key = run_folder(spark, "placed"), F.col("customerID").cast("bigint")
    lines = C.raw(spark, sf_dir).orderBy(key).withColumn(
        "tenure", F.when(key % 50 == 7, "n/a").otherwise(F.col("tenure").cast("string"))).withColumn(
        "customerID", F.when(key % 9 != 0, F.col("customerID")))
    (lines.write.option("header", True).option("ignoreLeadingWhiteSpace", False)
     .option("ignoreTrailingWhiteSpace", False).csv(path))
    return POS.read_placed_csv(spark, path)


@register("positional_ids", with_subscribers(_PLACED_SQL + """
SELECT position, CASE WHEN k % 9 = 0 THEN 'TEMP_' || position ELSE "customerID" END AS "customerID", gender, tenure
FROM lines WHERE k % 50 <> 7"""))
def positional_ids(spark, sf_dir):
    """SRC1/PRJ4: readable lines with their position over all files, which names the customers without an id."""
    good, _ = POS.split_corrupt(_placed(spark, sf_dir))
    return POS.positional_ids(good, "customerID").select("position", "customerID", "gender", "tenure")


@register("corrupt_lines", with_subscribers(_PLACED_SQL + """
SELECT position, CASE WHEN k % 9 = 0 THEN '' ELSE "customerID" END AS first_field FROM lines WHERE k % 50 = 7"""))
def corrupt_lines(spark, sf_dir):
    """SRC1: lines that do not fit the schema, in quarantine with their place and text."""
    _, bad = POS.split_corrupt(_placed(spark, sf_dir))
    first = F.regexp_replace(F.split_part(F.col("_corrupt_record"), F.lit(","), F.lit(1)), '"', "")
    return bad.select("position", first.alias("first_field"))


def _loaded_sql() -> str:
    fixed = {"monthly_charges": '"MonthlyCharges"', "total_charges": '"TotalCharges"'}
    cols = ", ".join(f"CAST(CAST(CAST({src} AS DECIMAL(38,6)) AS DECIMAL(10,2)) AS DOUBLE) AS {dst}" for dst, src in fixed.items())
    return with_clean(f"""
SELECT "customerID" AS customer_id, "SeniorCitizen" AS senior_citizen, tenure, "Churn" AS churn, {cols},
       TRUE AS has_load_time, (SELECT COUNT(*) FROM c) AS table_rows FROM c""")


@register("load_customers", _loaded_sql())
def load_customers(spark, sf_dir):
    """SNK8/SNK9: the customer table loaded under its definition, its load time by default, with the rows it holds."""
    path = run_folder(spark, "customers")
    definition = TD.customers()
    total = definition.load(to_db_columns(C.customers(spark, sf_dir)), path)
    stored = spark.read.schema(definition.schema).parquet(path)
    return stored.select("customer_id", "senior_citizen", "tenure", "churn",
                         *[F.col(c).cast("double").alias(c) for c in ("monthly_charges", "total_charges")],
                         F.col("ingested_at").isNotNull().alias("has_load_time"), F.lit(total).cast("long").alias("table_rows"))


_FILTERS = {
    "all": ({}, "TRUE"),
    "seniors": ({"senior_only": True}, '"SeniorCitizen" = 1'),
    "long tenure, asia": ({"tenure": (60, 72), "internet": ["ASIA"]},
                          "tenure BETWEEN 60 AND 72 AND \"InternetService\" = 'ASIA'"),
    "nobody": ({"contracts": ["Two year"]}, "\"Contract\" = 'Two year'"),
}


@register("filter_guard", with_clean("\nUNION ALL ".join(f"""
SELECT '{name}' AS filter_name, COUNT(*) AS n, CASE WHEN COUNT(*) = 0 THEN 'no customers match' ELSE 'ok' END AS status,
       ROUND(AVG("Churn") * 100, 6) AS churn_rate, ROUND(AVG("MonthlyCharges"), 6) AS avg_charges FROM c WHERE {cond}"""
                                                          for name, (_, cond) in _FILTERS.items())))
def filter_guard(spark, sf_dir):
    """FLT4: KPIs per filter choice in one scan; a choice without customers says so."""
    k = R.guarded_kpis(C.labelled(spark, sf_dir), {n: R.dashboard_filter(**choice) for n, (choice, _) in _FILTERS.items()})
    return k.select("filter_name", "n", "status", C.r6("churn_rate"), C.r6("avg_charges"))


_PROBS = (0.05, 0.25, 0.5, 0.75, 0.95)


@register("spend_sketch", with_log("\nUNION ALL ".join(f"""
SELECT CAST({p} AS DOUBLE) AS prob, COUNT(ltv_prediction) AS n, ROUND(quantile_cont(ltv_prediction, {p}), 6) AS exact_value,
       TRUE AS within_error FROM lg""" for p in _PROBS)))
def spend_sketch(spark, sf_dir):
    """CLN3: quantiles of predicted spend from stored daily sketches beside the exact ones, and whether the measured
    rank error stays below the stated one."""
    log = C.log(spark, sf_dir)
    store = SK.SketchStore(spark, run_folder(spark, "sketches"))
    store.write(log.withColumn("day", F.to_date("predicted_at")), "ltv_prediction")
    names = [f"q{i}" for i in range(len(_PROBS))]
    told = store.quantiles(_PROBS, names=names).withColumnsRenamed({c: f"told_{c}" for c in names})
    exact = exact_quantiles(log, "ltv_prediction", _PROBS, names=names)
    at = told.crossJoin(exact)   # two single rows
    x = F.col("ltv_prediction")
    # a quantile's rank is anywhere in the run of its equals
    ranks = log.crossJoin(F.broadcast(told)).agg(*[e for c in names for e in (
        F.avg((x < F.col(f"told_{c}")).cast("int")).alias(f"lo_{c}"), F.avg((x <= F.col(f"told_{c}")).cast("int")).alias(f"hi_{c}"))])
    rows = [F.struct(F.lit(p).alias("prob"), F.col("n"), F.round(c, 6).alias("exact_value"),
                     ((F.col(f"lo_{c}") <= p + SK.RANK_ERROR) & (F.col(f"hi_{c}") >= p - SK.RANK_ERROR)).alias("within_error"))
            for p, c in zip(_PROBS, names)]
    return at.crossJoin(ranks).select(F.inline(F.array(*rows)))
