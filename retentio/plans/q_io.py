"""Source/sink round trips and the baseline report (SRC1-5, SNK2-4, SNK10, SRT2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluate as EV
from ..operators import split as SP
from ..operators.clean import clean
from ..operators.profile import profiled_write
from ..operators.quantile import exact_median
from ..schemas import MAX_CSV_BATCH, MAX_JSON_BATCH, RAW_SUBSCRIBER
from ..sources import files as FS
from ..sources.prediction_log import PredictionLog
from ..streaming.stream import run_folder
from . import common as C
from .catalog import register
from .oracle_sql import with_clean, with_scores, with_subscribers

_RAW_COLS_SQL = ", ".join(
    f'ROUND("{f.name}", 6) AS "{f.name}"' if f.name == "MonthlyCharges" else f'"{f.name}"'
    for f in RAW_SUBSCRIBER.fields)


def _raw_out(df):
    return df.select(*[C.r6(f.name) if f.name == "MonthlyCharges" else F.col(f.name)
                       for f in RAW_SUBSCRIBER.fields])


@register("csv_roundtrip", with_subscribers(f"SELECT {_RAW_COLS_SQL} FROM s"))
def csv_roundtrip(spark, sf_dir):
    """SRC1/SRC2/SNK3: the raw table written as CSV and read back with the fixed schema."""
    path = run_folder(spark, "csv")
    # keep whitespace-only text as written (a blank total is data, decided by cleaning)
    (C.raw(spark, sf_dir).write.option("header", True)
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
    df = FS.read_subscribers_csv(spark, path)
    FS.validate_schema(df)
    return _raw_out(df)


@register("json_roundtrip", with_subscribers(f"SELECT {_RAW_COLS_SQL} FROM s"))
def json_roundtrip(spark, sf_dir):
    """SRC4: JSON-lines request records read with the fixed schema (blank text kept)."""
    path = run_folder(spark, "json")
    C.raw(spark, sf_dir).write.json(path)
    return _raw_out(FS.read_records_json(spark, path))


def _request_sql(limit: int) -> str:
    """Customers of the requests that the limit lets through; two requests a span of 2.4 limits, 0.8 and 1.6 long."""
    span, short = limit * 12 // 5, limit * 4 // 5
    return with_subscribers(f"""
WITH r AS (SELECT *, CAST("customerID" AS BIGINT) // {span} * 2 + CAST(CAST("customerID" AS BIGINT) % {span} >= {short} AS INTEGER) AS request FROM s)
SELECT {_RAW_COLS_SQL} FROM r QUALIFY COUNT(*) OVER (PARTITION BY request) <= {limit}""")


def _requests(df, limit: int):
    """The table as request files, one a folder ``request=``; each is bounded by its span of keys."""
    span, short, key = limit * 12 // 5, limit * 4 // 5, F.col("customerID").cast("bigint")
    request = F.floor(key / span) * 2 + (key % span >= short).cast("int")
    return df.withColumn("request", request).repartition("request").write.partitionBy("request")


@register("csv_batch", _request_sql(MAX_CSV_BATCH))
def csv_batch(spark, sf_dir):
    """SRC3: the whole table as scoring files, each taken or refused by the limits of the batch service."""
    path = run_folder(spark, "batch-csv")
    (_requests(C.raw(spark, sf_dir), MAX_CSV_BATCH).option("header", True)
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
    return _raw_out(FS.read_batch_folder(spark, path, ".csv")[0])


@register("json_batch", _request_sql(MAX_JSON_BATCH))
def json_batch(spark, sf_dir):
    """SRC4: the whole table as scoring requests of JSON records, each taken or refused by the service's limits."""
    path = run_folder(spark, "batch-json")
    _requests(C.raw(spark, sf_dir), MAX_JSON_BATCH).json(path)
    return _raw_out(FS.read_batch_folder(spark, path, ".json")[0])


@register("stored_splits", with_clean("""
SELECT "customerID", CASE WHEN substr(md5('42:' || "customerID"), 1, 8) < '33333333' THEN 'test' ELSE 'train' END AS split,
       tenure, "Churn" FROM c"""))
def stored_splits(spark, sf_dir):
    """SRC6/SNK4: the splits written, read back as features and labels, and put side by side."""
    path = run_folder(spark, "splits")
    FS.write_table(SP.assign_split(C.labelled(spark, sf_dir), "customerID"), path, ["split"])
    x_train, x_test, y_train, y_test = FS.read_splits(spark, path, "Churn")
    parts = [x.join(y, "customerID").select("customerID", F.lit(s).alias("split"), "tenure", "Churn")
             for s, x, y in (("train", x_train, y_train), ("test", x_test, y_test))]
    return parts[0].unionByName(parts[1])


@register("dashboard_load", with_clean("""
SELECT c."customerID", s."Churn", ROUND(c."TotalCharges", 6) AS "TotalCharges",
       CASE WHEN s."Churn" = 'Yes' THEN 1 ELSE 0 END AS "Churn_Binary" FROM c JOIN s ON s."customerID" = c."customerID" """))
def dashboard_load(spark, sf_dir):
    """SRC7: cleaned totals beside the churn text and ``Churn_Binary``, 0 for anything but Yes."""
    raw = C.raw(spark, sf_dir).withColumn("__churn", F.col("Churn")).withColumn(
        "Churn_Binary", F.coalesce((F.col("Churn") == "Yes").cast("int"), F.lit(0)))
    return clean(raw).select("customerID", F.col("__churn").alias("Churn"), C.r6("TotalCharges"), "Churn_Binary")


@register("first_rows", with_subscribers("""
SELECT "customerID", tenure, "Contract" FROM s ORDER BY "customerID" LIMIT 5"""))
def first_rows(spark, sf_dir):
    """SRT2: first n rows in key order (a preview: the limit is the feature)."""
    return C.raw(spark, sf_dir).orderBy("customerID").limit(5).select("customerID", "tenure", "Contract")


@register("prediction_log_append", with_scores("""
SELECT "customerID" AS customer_id, CAST(CAST(churn_probability AS DECIMAL(6,4)) AS DOUBLE) AS churn_probability,
       CASE WHEN churn_probability >= 0.5 THEN 1 ELSE 0 END AS churn_prediction,
       CASE WHEN churn_probability >= 0.65 THEN 'HIGH' WHEN churn_probability >= 0.35 THEN 'MEDIUM' ELSE 'LOW' END AS churn_risk_tier,
       CAST(CAST(CAST(ltv_prediction AS DECIMAL(20,6)) AS DECIMAL(10,2)) AS DOUBLE) AS ltv_prediction, model_version,
       ROW_NUMBER() OVER (ORDER BY model_version, "customerID") AS id
FROM sc, (VALUES ('2.0.0'), ('2.0.1')) AS v(model_version)"""))
def prediction_log_append(spark, sf_dir):
    """SNK2: two batches and a replay of the second; ids without gap or repeat, in customer order within a batch."""
    from ..operators.segment import add_tier
    path = run_folder(spark, "log")
    sc = add_tier(C.scores(spark, sf_dir)).withColumn(
        "churn_prediction", EV.hard_label("churn_probability")).withColumn(
        "ltv_prediction", C.r6("ltv_prediction"))  # 6 decimals first, so that half cents round alike in both engines
    log = PredictionLog(spark, path)
    for batch, version in ((0, "2.0.0"), (1, "2.0.1"), (1, "2.0.1")):
        log.append(sc, version, feed="scores", batch=batch, order=[F.col("customer_id")])
    return log.read().drop("predicted_at").withColumns(
        {c: F.col(c).cast("double") for c in ("churn_probability", "ltv_prediction")})


_PROFILE_SQL = with_subscribers("WITH p AS (" + "\nUNION ALL ".join(
    f"""SELECT '{f.name}' AS "column", '{f.dataType.simpleString()}' AS type, COUNT(*) - COUNT("{f.name}") AS missing,
       COUNT("{f.name}") AS non_null, COUNT(*) AS n_rows FROM s""" for f in RAW_SUBSCRIBER.fields) + """)
SELECT *, (SELECT COUNT(*) FROM p) AS n_columns, CAST((SELECT SUM(missing) FROM p) AS BIGINT) AS total_missing FROM p""")


@register("profile_on_write", _PROFILE_SQL)
def profile_on_write(spark, sf_dir):
    """PRF1/PRF3/PRF6: shape, types and missing values counted while the raw table is written, churn text checked."""
    raw = C.raw(spark, sf_dir)
    return profiled_write(raw, run_folder(spark, "profiled"), {"Churn": ["Yes", "No"], "SeniorCitizen": [0, 1]}).frame(spark)


_REPORT_SQL = with_clean("""
WITH sc AS (SELECT c."customerID", c."Churn" AS label,
                   0.3 * c."Churn" + 0.7 * (CAST((CAST(c."customerID" AS BIGINT) * 7919 + 104729) % 1009 AS DOUBLE) / 1009) AS p
            FROM c),
g AS (SELECT p, SUM(label) AS tp_inc, SUM(1 - label) AS fp_inc FROM sc GROUP BY p),
cum AS (SELECT tp_inc, fp_inc, SUM(tp_inc) OVER (ORDER BY p DESC ROWS UNBOUNDED PRECEDING) AS tp FROM g),
auc AS (SELECT SUM(fp_inc * (2 * tp - tp_inc)) / (2.0 * (SELECT SUM(label) FROM sc) * (SELECT SUM(1 - label) FROM sc)) AS v FROM cum)
SELECT 'customers' AS metric, CAST(COUNT(*) AS DOUBLE) AS value FROM c
UNION ALL SELECT 'churned', CAST(SUM("Churn") AS DOUBLE) FROM c
UNION ALL SELECT 'churn_rate_pct', ROUND(AVG("Churn") * 100, 6) FROM c
UNION ALL SELECT 'avg_monthly_charges', ROUND(AVG("MonthlyCharges"), 6) FROM c
UNION ALL SELECT 'avg_tenure', ROUND(AVG(tenure), 6) FROM c
UNION ALL SELECT 'zero_tenure_rows', CAST(SUM(CASE WHEN tenure = 0 THEN 1 ELSE 0 END) AS DOUBLE) FROM c
UNION ALL SELECT 'blank_total_charges', CAST(SUM(CASE WHEN "TotalCharges" = ' ' THEN 1 ELSE 0 END) AS DOUBLE) FROM s
UNION ALL SELECT 'median_total_charges', ROUND((SELECT m FROM med), 6)
UNION ALL SELECT 'score_roc_auc', ROUND(v, 6) FROM auc""")


@register("baseline_report", _REPORT_SQL)
def baseline_report(spark, sf_dir):
    """SNK10: the baseline analytics report as one long (metric, value) table."""
    raw = C.raw(spark, sf_dir)
    c = C.customers(spark, sf_dir)
    from ..operators.clean import coerce_total
    med = exact_median(coerce_total(raw), "TotalCharges", name="m")
    kpis = c.agg(F.count(F.lit(1)).cast("double").alias("customers"),
                 F.sum("Churn").cast("double").alias("churned"),
                 C.r6(F.avg("Churn") * 100, "churn_rate_pct"),
                 C.r6(F.avg("MonthlyCharges"), "avg_monthly_charges"),
                 C.r6(F.avg("tenure"), "avg_tenure"),
                 F.sum(F.when(F.col("tenure") == 0, 1).otherwise(0)).cast("double").alias("zero_tenure_rows"))
    blanks = raw.agg(F.sum(F.when(F.col("TotalCharges") == " ", 1).otherwise(0)).cast("double")
                     .alias("blank_total_charges"))
    sc = c.select("customerID", F.col("Churn").alias("label"),
                  (F.lit(0.3) * F.col("Churn") + F.lit(0.7) * (
                      (F.col("customerID").cast("bigint") * 7919 + 104729) % 1009).cast("double") / 1009)
                  .alias("p"))
    auc = EV.roc_auc(sc, "label", "p").select(C.r6("roc_auc", "score_roc_auc"))
    # every part is a one-row aggregate: provably tiny cross joins
    wide = (kpis.crossJoin(blanks).crossJoin(med.select(C.r6("m", "median_total_charges")))
            .crossJoin(auc))
    names = ["customers", "churned", "churn_rate_pct", "avg_monthly_charges", "avg_tenure",
             "zero_tenure_rows", "blank_total_charges", "median_total_charges", "score_roc_auc"]
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value"))
                               for n in names]))
    return wide.select(rows.alias("r")).select("r.metric", "r.value")
