"""Cleaning, feature, encoding, histogram and split queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import encode as EN
from ..operators import sparse as SPA
from ..operators import histogram as H
from ..operators import split as SP
from ..operators.clean import clean
from ..operators.features import add_billing_ratios, add_service_density, add_tenure_cohorts
from ..schemas import CATEGORICAL, NUMERICAL, NUMERICAL_WIDE
from . import common as C
from .catalog import register
from .oracle_sql import with_clean, with_features, with_scores, with_subscribers

_CLEAN_COLS_SQL = """
"customerID", gender, "SeniorCitizen", "Partner", "Dependents", tenure, "PhoneService",
"MultipleLines", "InternetService", "OnlineSecurity", "OnlineBackup", "DeviceProtection",
"TechSupport", "StreamingTV", "StreamingMovies", "Contract", "PaperlessBilling", "PaymentMethod",
ROUND("MonthlyCharges", 6) AS "MonthlyCharges", ROUND("TotalCharges", 6) AS "TotalCharges", "Churn" """


def _round_money(df):
    return df.withColumn("MonthlyCharges", C.r6("MonthlyCharges")).withColumn("TotalCharges", C.r6("TotalCharges"))


@register("clean_customers", with_clean(f"SELECT {_CLEAN_COLS_SQL} FROM c"))
def clean_customers(spark, sf_dir):
    """CLN1-4: coerced totals, tenure-0 zero, exact median fill, 0/1 churn."""
    return _round_money(C.customers(spark, sf_dir))


@register("impute_zero_policy", with_clean(f"""
SELECT {_CLEAN_COLS_SQL.replace('ROUND("TotalCharges", 6)', 'ROUND(COALESCE("TotalCharges", 0.0), 6)')}
FROM (SELECT s1.* REPLACE (CAST(CASE WHEN "Churn" = 'Yes' THEN 1 WHEN "Churn" = 'No' THEN 0 END AS INTEGER) AS "Churn") FROM s1)"""))
def impute_zero_policy(spark, sf_dir):
    """CLN5: API variant, missing totals become 0.0."""
    return _round_money(clean(C.raw(spark, sf_dir), impute="zero"))


@register("tenure_cohorts", with_subscribers("""
SELECT "customerID", tenure,
       CASE WHEN tenure IS NULL THEN '0-1 Year'
            WHEN LEAST(GREATEST(tenure, 0), 72) <= 12 THEN '0-1 Year'
            WHEN LEAST(GREATEST(tenure, 0), 72) <= 24 THEN '1-2 Years'
            WHEN LEAST(GREATEST(tenure, 0), 72) <= 36 THEN '2-3 Years'
            WHEN LEAST(GREATEST(tenure, 0), 72) <= 48 THEN '3-4 Years'
            WHEN LEAST(GREATEST(tenure, 0), 72) <= 60 THEN '4-5 Years'
            ELSE '5-6 Years' END AS tenure_group
FROM s"""))
def tenure_cohorts(spark, sf_dir):
    """FE1: right-closed yearly cohorts with clamping."""
    return add_tenure_cohorts(C.raw(spark, sf_dir)).select("customerID", "tenure", "tenure_group")


@register("tenure_cohorts_unclamped", with_subscribers("""
SELECT "customerID", tenure,
       CASE WHEN tenure >= 0 AND tenure <= 12 THEN '0-1 Year'
            WHEN tenure > 12 AND tenure <= 24 THEN '1-2 Years'
            WHEN tenure > 24 AND tenure <= 36 THEN '2-3 Years'
            WHEN tenure > 36 AND tenure <= 48 THEN '3-4 Years'
            WHEN tenure > 48 AND tenure <= 60 THEN '4-5 Years'
            WHEN tenure > 60 AND tenure <= 72 THEN '5-6 Years' END AS tenure_group
FROM s"""))
def tenure_cohorts_unclamped(spark, sf_dir):
    """FE1b: out-of-range tenure -> null."""
    return add_tenure_cohorts(C.raw(spark, sf_dir), clamp=False).select("customerID", "tenure", "tenure_group")


@register("tenure_cohort_counts", with_features("""
SELECT tenure_group, COUNT(*) AS n FROM f GROUP BY tenure_group ORDER BY n DESC"""))
def tenure_cohort_counts(spark, sf_dir):
    """AGG12: cohort value counts, descending."""
    from ..operators.report import value_counts
    return value_counts(add_tenure_cohorts(C.labelled(spark, sf_dir)), "tenure_group")


@register("service_density", with_features("""
SELECT "customerID", total_services FROM f"""))
def service_density(spark, sf_dir):
    """FE2."""
    return add_service_density(C.raw(spark, sf_dir)).select("customerID", "total_services")


@register("services_by_churn", with_features("""
SELECT "Churn", ROUND(AVG(total_services), 6) AS avg_total_services FROM f GROUP BY "Churn" """))
def services_by_churn(spark, sf_dir):
    """AGG11: mean service count by churn class."""
    d = add_service_density(C.labelled(spark, sf_dir))
    return d.groupBy("Churn").agg(C.r6(F.avg("total_services"), "avg_total_services"))


@register("billing_ratios", with_features("""
SELECT "customerID", ROUND(charge_ratio, 6) AS charge_ratio,
       ROUND(charges_difference, 6) AS charges_difference FROM f"""))
def billing_ratios(spark, sf_dir):
    """FE3 + FE4 on the cleaned table."""
    d = add_billing_ratios(C.customers(spark, sf_dir))
    return d.select("customerID", C.r6("charge_ratio"), C.r6("charges_difference"))


@register("feature_table", with_features("""
SELECT "customerID", tenure_group, total_services, ROUND(charge_ratio, 6) AS charge_ratio,
       ROUND(charges_difference, 6) AS charges_difference, ROUND("TotalCharges", 6) AS "TotalCharges",
       "Churn" FROM f"""))
def feature_table(spark, sf_dir):
    """FE5: the full chain on the cleaned table."""
    d = C.features(spark, sf_dir)
    return d.select("customerID", "tenure_group", "total_services", C.r6("charge_ratio"),
                    C.r6("charges_difference"), C.r6("TotalCharges"), "Churn")


# ---------------------------------------------------------------- encoding
_UNPIVOT_CATS = ", ".join(f'"{c}"' for c in CATEGORICAL)


@register("onehot_long", with_subscribers(f"""
SELECT "customerID", col_name || '_' || val AS feature
FROM (SELECT "customerID", gender, CAST("SeniorCitizen" AS VARCHAR) AS "SeniorCitizen", "Partner",
             "Dependents", "PhoneService", "MultipleLines", "InternetService", "OnlineSecurity",
             "OnlineBackup", "DeviceProtection", "TechSupport", "StreamingTV", "StreamingMovies",
             "Contract", "PaperlessBilling", "PaymentMethod" FROM s)
UNPIVOT (val FOR col_name IN ({_UNPIVOT_CATS}))"""))
def onehot_long(spark, sf_dir):
    """FE6 in long form: one row per set indicator (null category = no row)."""
    return EN.onehot_long(C.raw(spark, sf_dir), CATEGORICAL, "customerID")


@register("scale_stats", with_features("""
SELECT 'tenure' AS "column", ROUND(AVG(tenure), 6) AS mean, ROUND(STDDEV_SAMP(tenure), 6) AS std FROM f
UNION ALL SELECT 'MonthlyCharges', ROUND(AVG("MonthlyCharges"), 6), ROUND(STDDEV_SAMP("MonthlyCharges"), 6) FROM f
UNION ALL SELECT 'charge_ratio', ROUND(AVG(charge_ratio), 6), ROUND(STDDEV_SAMP(charge_ratio), 6) FROM f
UNION ALL SELECT 'charges_difference', ROUND(AVG(charges_difference), 6), ROUND(STDDEV_SAMP(charges_difference), 6) FROM f
UNION ALL SELECT 'total_services', ROUND(AVG(total_services), 6), ROUND(STDDEV_SAMP(total_services), 6) FROM f"""))
def scale_stats(spark, sf_dir):
    """FE8 (wide numeric list): mean and sample std in one pass."""
    s = EN.scale_stats(C.features(spark, sf_dir), NUMERICAL_WIDE)
    return s.select("column", C.r6("mean"), C.r6("std"))


@register("scaled_features", with_clean("""
WITH st AS (SELECT AVG(tenure) AS mt, STDDEV_SAMP(tenure) AS st,
                   AVG("MonthlyCharges") AS mm, STDDEV_SAMP("MonthlyCharges") AS sm FROM c)
SELECT "customerID",
       ROUND((tenure - mt) / CASE WHEN st > 0 THEN st ELSE 1.0 END, 6) AS tenure,
       ROUND(("MonthlyCharges" - mm) / CASE WHEN sm > 0 THEN sm ELSE 1.0 END, 6) AS "MonthlyCharges"
FROM c, st"""))
def scaled_features(spark, sf_dir):
    """FE8 + FE9: fit on the table, apply as column expressions."""
    c = C.customers(spark, sf_dir)
    state = EN.fit_encoder(c.select("customerID", *NUMERICAL), [], NUMERICAL, exclude=["customerID"])
    out = state.transform(c, keep=["customerID"])
    return out.select("customerID", *[C.r6(n) for n in NUMERICAL])


_WIDE_CATS = [*CATEGORICAL, "tenure_group"]
_WIDE_CATS_SQL = ", ".join(f'"{c}"' for c in _WIDE_CATS)
_WIDE_NUMS_SQL = " UNION ALL ".join(
    f"""SELECT "customerID", '{c}' AS feature, ROUND((COALESCE("{c}", m) - m) / CASE WHEN d > 0 THEN d ELSE 1.0 END, 6) + 0.0 AS value
FROM sp, (SELECT AVG("{c}") AS m, STDDEV_SAMP("{c}") AS d FROM sp WHERE split = 'train') WHERE split = 'test'""" for c in NUMERICAL_WIDE)


@register("aligned_matrix_wide", with_features(f"""
WITH sp AS (SELECT f.* REPLACE (CAST("SeniorCitizen" AS VARCHAR) AS "SeniorCitizen"),
                   CASE WHEN substr(md5('42:' || "customerID"), 1, 8) < '33333333' THEN 'test' ELSE 'train' END AS split FROM f),
     lng AS (SELECT "customerID", split, col_name || '_' || val AS feature
             FROM (SELECT "customerID", split, {_WIDE_CATS_SQL} FROM sp) UNPIVOT (val FOR col_name IN ({_WIDE_CATS_SQL}))),
     trained AS (SELECT DISTINCT feature FROM lng WHERE split = 'train')
SELECT t."customerID", trained.feature, CASE WHEN lng.feature IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS value
FROM (SELECT "customerID" FROM sp WHERE split = 'test') t CROSS JOIN trained
LEFT JOIN lng ON lng."customerID" = t."customerID" AND lng.feature = trained.feature
UNION ALL {_WIDE_NUMS_SQL}"""))
def aligned_matrix_wide(spark, sf_dir):
    """FE10: all categorical and numeric columns of the test rows, aligned to the training columns (absent -> 0, extra dropped).

    The wide numeric list holds the narrow one. Long form: a row per test row and training column.
    """
    f = SP.assign_split(C.features(spark, sf_dir), "customerID").select("customerID", "split", *_WIDE_CATS, *NUMERICAL_WIDE)
    train, test = f.where(F.col("split") == "train").drop("split"), f.where(F.col("split") == "test").drop("split")
    state = EN.fit_encoder(train, _WIDE_CATS, NUMERICAL_WIDE, exclude=["customerID"])
    return state.long(test, "customerID").select("customerID", "feature", C.r6("value"))


_SPARSE_SQL = f"""
WITH sp AS (SELECT f.* REPLACE (CAST("SeniorCitizen" AS VARCHAR) AS "SeniorCitizen"),
                   CASE WHEN substr(md5('42:' || "customerID"), 1, 8) < '33333333' THEN 'test' ELSE 'train' END AS split FROM f),
     lng AS (SELECT "customerID", split, col_name, val
             FROM (SELECT "customerID", split, {_WIDE_CATS_SQL} FROM sp) UNPIVOT (val FOR col_name IN ({_WIDE_CATS_SQL}))),
     trained AS (SELECT col_name, val, {len(NUMERICAL_WIDE)} - 1 + row_number() OVER (ORDER BY list_position([{', '.join(f"'{c}'" for c in _WIDE_CATS)}], col_name), val) AS index
                 FROM (SELECT DISTINCT col_name, val FROM lng WHERE split = 'train')),
     cells AS (SELECT "customerID", col_name || '_' || val AS feature, index, 1.0::DOUBLE AS value FROM lng JOIN trained USING (col_name, val) WHERE split = 'test'
               UNION ALL SELECT n."customerID", n.feature, list_position([{', '.join(f"'{c}'" for c in NUMERICAL_WIDE)}], n.feature) - 1, n.value FROM ({_WIDE_NUMS_SQL}) n WHERE n.value <> 0)"""


def _sparse(spark, sf_dir):
    f = SP.assign_split(C.features(spark, sf_dir), "customerID").select("customerID", "split", *NUMERICAL_WIDE, *_WIDE_CATS)
    f = f.withColumn("SeniorCitizen", F.col("SeniorCitizen").cast("string"))
    train, test = f.where(F.col("split") == "train").drop("split"), f.where(F.col("split") == "test").drop("split")
    return SPA.fit_sparse(train, _WIDE_CATS, NUMERICAL_WIDE, exclude=["customerID"]), test


@register("aligned_matrix", with_features(_SPARSE_SQL + """
SELECT "customerID", feature, index, value FROM cells"""))
def aligned_matrix(spark, sf_dir):
    """FE6, FE10: the non-zero cells of all test rows, aligned by a distributed dictionary of the training categories."""
    state, test = _sparse(spark, sf_dir)
    numbers = spark.createDataFrame([(i, c) for i, c in enumerate(state.numeric.feature_columns)], "index long, feature string")
    names = state.dictionary(spark).select("index", F.concat_ws("_", "column", "value").alias("feature")).unionByName(numbers)
    cells = state.cells(test, "customerID").withColumn("value", C.r6("value")).where("value <> 0")
    return cells.join(names, "index").select("customerID", "feature", "index", "value")


@register("sparse_vectors", with_features(_SPARSE_SQL + """
SELECT "customerID", (SELECT COUNT(*) FROM trained) + 3 AS size, COUNT(*) AS filled, SUM(index)::BIGINT AS index_sum, ROUND(SUM(value), 4) AS value_sum
FROM cells GROUP BY "customerID" """.replace("+ 3", f"+ {len(NUMERICAL_WIDE)}")))
def sparse_vectors(spark, sf_dir):
    """FE13: one MLlib sparse vector per test row, shown by its size, filled cells and sums."""
    from pyspark.ml.functions import vector_to_array

    state, test = _sparse(spark, sf_dir)
    cells = F.transform(vector_to_array("features"), lambda v, i: F.struct(i.alias("index"), F.round(v, 6).alias("value")))
    full = state.vector(test, ["customerID"]).withColumn("all", cells).withColumn("cells", F.filter("all", lambda c: c["value"] != 0))
    return full.select("customerID", F.size("all").cast("long").alias("size"), F.size("cells").cast("long").alias("filled"),
                       F.aggregate("cells", F.lit(0).cast("long"), lambda a, c: a + c["index"]).alias("index_sum"),
                       F.round(F.aggregate("cells", F.lit(0.0), lambda a, c: a + c["value"]), 4).alias("value_sum"))


# ---------------------------------------------------------------- histograms
@register("hist_monthly", with_clean("""
WITH e AS (SELECT MIN("MonthlyCharges") AS lo, MAX("MonthlyCharges") AS hi FROM c),
b AS (SELECT CASE WHEN hi > lo THEN LEAST(CAST(FLOOR(("MonthlyCharges" - lo) / (hi - lo) * 20) AS BIGINT), 19)
                  ELSE 0 END AS bin, lo, hi FROM c, e WHERE "MonthlyCharges" IS NOT NULL)
SELECT bin, ROUND(lo + bin * ((hi - lo) / 20), 6) AS bin_lo, ROUND(lo + (bin + 1) * ((hi - lo) / 20), 6) AS bin_hi,
       COUNT(*) AS n FROM b GROUP BY bin, lo, hi"""))
def hist_monthly(spark, sf_dir):
    """HST1: 20 equal-width bins of monthly charges."""
    h = H.histogram(C.labelled(spark, sf_dir), "MonthlyCharges", 20)
    return h.select("bin", C.r6("bin_lo"), C.r6("bin_hi"), "n")


@register("hist_total", with_clean("""
WITH e AS (SELECT MIN("TotalCharges") AS lo, MAX("TotalCharges") AS hi FROM c),
b AS (SELECT CASE WHEN hi > lo THEN LEAST(CAST(FLOOR(("TotalCharges" - lo) / (hi - lo) * 20) AS BIGINT), 19)
                  ELSE 0 END AS bin, lo, hi FROM c, e WHERE "TotalCharges" IS NOT NULL)
SELECT bin, ROUND(lo + bin * ((hi - lo) / 20), 6) AS bin_lo, ROUND(lo + (bin + 1) * ((hi - lo) / 20), 6) AS bin_hi,
       COUNT(*) AS n FROM b GROUP BY bin, lo, hi"""))
def hist_total(spark, sf_dir):
    """HST1: 20 equal-width bins of cleaned total charges."""
    h = H.histogram(C.customers(spark, sf_dir), "TotalCharges", 20)
    return h.select("bin", C.r6("bin_lo"), C.r6("bin_hi"), "n")


@register("hist_monthly_by_churn", with_clean("""
WITH e AS (SELECT MIN("MonthlyCharges") AS lo, MAX("MonthlyCharges") AS hi FROM c),
b AS (SELECT "Churn", CASE WHEN hi > lo THEN LEAST(CAST(FLOOR(("MonthlyCharges" - lo) / (hi - lo) * 30) AS BIGINT), 29)
                  ELSE 0 END AS bin, lo, hi FROM c, e WHERE "MonthlyCharges" IS NOT NULL)
SELECT "Churn", bin, ROUND(lo + bin * ((hi - lo) / 30), 6) AS bin_lo,
       ROUND(lo + (bin + 1) * ((hi - lo) / 30), 6) AS bin_hi, COUNT(*) AS n
FROM b GROUP BY "Churn", bin, lo, hi"""))
def hist_monthly_by_churn(spark, sf_dir):
    """HST2: 30 bins per class on a shared axis."""
    h = H.histogram(C.labelled(spark, sf_dir), "MonthlyCharges", 30, by=["Churn"])
    return h.select("Churn", "bin", C.r6("bin_lo"), C.r6("bin_hi"), "n")


@register("hist_tenure", with_subscribers("""
WITH e AS (SELECT MIN(tenure) AS lo, MAX(tenure) AS hi FROM s),
b AS (SELECT CASE WHEN hi > lo THEN LEAST(CAST(FLOOR((CAST(tenure AS DOUBLE) - lo) / (hi - lo) * 20) AS BIGINT), 19)
                  ELSE 0 END AS bin, lo, hi FROM s, e WHERE tenure IS NOT NULL)
SELECT bin, ROUND(lo + bin * ((hi - lo) / 20), 6) AS bin_lo, ROUND(lo + (bin + 1) * ((hi - lo) / 20), 6) AS bin_hi,
       COUNT(*) AS n FROM b GROUP BY bin, lo, hi"""))
def hist_tenure(spark, sf_dir):
    """HST1: tenure distribution."""
    h = H.histogram(C.raw(spark, sf_dir), "tenure", 20)
    return h.select("bin", C.r6("bin_lo"), C.r6("bin_hi"), "n")


def _register_auto_histogram(column: str):
    sql = with_clean(f"""
WITH st AS (SELECT MIN(x) AS lo, MAX(x) AS hi, COUNT(x) AS n, QUANTILE_CONT(x, 0.25) AS q1, QUANTILE_CONT(x, 0.75) AS q3
            FROM (SELECT CAST("{column}" AS DOUBLE) AS x FROM c)),
e AS (SELECT lo, hi, GREATEST(CAST(CEIL(LOG2(n)) AS BIGINT) + 1, CASE WHEN q3 > q1
        THEN CAST(CEIL((hi - lo) / (2 * (q3 - q1) / POWER(CAST(n AS DOUBLE), 1.0 / 3))) AS BIGINT) ELSE 0 END) AS bins FROM st),
b AS (SELECT CASE WHEN hi > lo THEN LEAST(CAST(FLOOR((CAST("{column}" AS DOUBLE) - lo) / (hi - lo) * bins) AS BIGINT), bins - 1)
                  ELSE 0 END AS bin, lo, hi, bins FROM c, e WHERE "{column}" IS NOT NULL)
SELECT bin, ROUND(lo + bin * ((hi - lo) / bins), 6) AS bin_lo, ROUND(lo + (bin + 1) * ((hi - lo) / bins), 6) AS bin_hi,
       COUNT(*) AS n FROM b GROUP BY bin, lo, hi, bins""")

    def query(spark, sf_dir):
        source = C.customers if column == "TotalCharges" else C.labelled
        h = H.histogram(source(spark, sf_dir), column, None)
        return h.select("bin", C.r6("bin_lo"), C.r6("bin_hi"), "n")

    query.__doc__ = f"""HST1: {column} in as many equal-width bins as its quartiles, range and count ask for."""
    register(f"hist_auto_{column.lower()}", sql)(query)


for _column in ("tenure", "MonthlyCharges", "TotalCharges"):
    _register_auto_histogram(_column)


@register("hist_residual", with_clean("""
WITH r AS (SELECT sc.ltv_prediction - c."TotalCharges" AS residual
           FROM c JOIN (SELECT "customerID", "MonthlyCharges" * (tenure + 1) AS ltv_prediction FROM s) sc
           ON sc."customerID" = c."customerID"),
e AS (SELECT MIN(residual) AS lo, MAX(residual) AS hi FROM r),
b AS (SELECT CASE WHEN hi > lo THEN LEAST(CAST(FLOOR((residual - lo) / (hi - lo) * 40) AS BIGINT), 39)
                  ELSE 0 END AS bin, lo, hi FROM r, e WHERE residual IS NOT NULL)
SELECT bin, ROUND(lo + bin * ((hi - lo) / 40), 6) AS bin_lo, ROUND(lo + (bin + 1) * ((hi - lo) / 40), 6) AS bin_hi,
       COUNT(*) AS n FROM b GROUP BY bin, lo, hi"""))
def hist_residual(spark, sf_dir):
    """HST3 / EVL7: 40-bin histogram of LTV residuals (predicted - actual)."""
    c = C.customers(spark, sf_dir).select("customerID", "TotalCharges")
    sc = C.scores(spark, sf_dir).select("customerID", "ltv_prediction")
    r = c.join(sc, "customerID").select((F.col("ltv_prediction") - F.col("TotalCharges")).alias("residual"))
    h = H.histogram(r, "residual", 40)
    return h.select("bin", C.r6("bin_lo"), C.r6("bin_hi"), "n")


@register("kde_monthly", with_clean("""
WITH st AS (SELECT MIN("MonthlyCharges") AS lo, MAX("MonthlyCharges") AS hi, COUNT(*) AS n,
                   STDDEV_SAMP("MonthlyCharges") AS sd FROM c WHERE "MonthlyCharges" IS NOT NULL),
b AS (SELECT CASE WHEN hi > lo THEN LEAST(CAST(FLOOR(("MonthlyCharges" - lo) / (hi - lo) * 1024) AS BIGINT), 1023)
                  ELSE 0 END AS bin, COUNT(*) AS cnt
      FROM c, st WHERE "MonthlyCharges" IS NOT NULL GROUP BY 1),
g AS (SELECT range AS point FROM range(0, 200)),
k AS (SELECT point, SUM(cnt * EXP(-0.5 * POWER(((lo + point * (hi - lo) / 199)
                                   - (lo + (bin + 0.5) * (hi - lo) / 1024)) / (sd * POWER(CAST(n AS DOUBLE), -0.2)), 2))) AS sm
      FROM b, g, st GROUP BY point)
SELECT point, ROUND(lo + point * (hi - lo) / 199, 6) AS x,
       ROUND(sm / (n * sd * POWER(CAST(n AS DOUBLE), -0.2) * SQRT(2 * PI())) * sd, 6) AS density_x_sd
FROM k, st"""))
def kde_monthly(spark, sf_dir):
    """HST4: binned Gaussian KDE on a 200-point grid (density scaled by the std)."""
    c = C.labelled(spark, sf_dir)
    sd = c.agg(F.stddev_samp("MonthlyCharges").alias("__sd"))
    k = H.kde(c, "MonthlyCharges").crossJoin(F.broadcast(sd))
    return k.select(F.col("point").cast("long").alias("point"), C.r6("x"),
                    C.r6(F.col("density") * F.col("__sd"), "density_x_sd"))


@register("kde_total", with_clean("""
WITH st AS (SELECT MIN("TotalCharges") AS lo, MAX("TotalCharges") AS hi, COUNT(*) AS n,
                   STDDEV_SAMP("TotalCharges") AS sd FROM c WHERE "TotalCharges" IS NOT NULL),
b AS (SELECT CASE WHEN hi > lo THEN LEAST(CAST(FLOOR(("TotalCharges" - lo) / (hi - lo) * 1024) AS BIGINT), 1023)
                  ELSE 0 END AS bin, COUNT(*) AS cnt
      FROM c, st WHERE "TotalCharges" IS NOT NULL GROUP BY 1),
g AS (SELECT range AS point FROM range(0, 200)),
k AS (SELECT point, SUM(cnt * EXP(-0.5 * POWER(((lo + point * (hi - lo) / 199)
                                   - (lo + (bin + 0.5) * (hi - lo) / 1024)) / (sd * POWER(CAST(n AS DOUBLE), -0.2)), 2))) AS sm
      FROM b, g, st GROUP BY point)
SELECT point, ROUND(lo + point * (hi - lo) / 199, 6) AS x,
       ROUND(sm / (n * sd * POWER(CAST(n AS DOUBLE), -0.2) * SQRT(2 * PI())) * sd, 6) AS density_x_sd
FROM k, st"""))
def kde_total(spark, sf_dir):
    """HST4: total charges, binned Gaussian KDE on a 200-point grid (density scaled by the std)."""
    c = C.customers(spark, sf_dir)
    sd = c.agg(F.stddev_samp("TotalCharges").alias("__sd"))
    k = H.kde(c, "TotalCharges").crossJoin(F.broadcast(sd))
    return k.select(F.col("point").cast("long").alias("point"), C.r6("x"),
                    C.r6(F.col("density") * F.col("__sd"), "density_x_sd"))


@register("kde_tenure", with_clean("""
WITH st AS (SELECT MIN("tenure") AS lo, MAX("tenure") AS hi, COUNT(*) AS n,
                   STDDEV_SAMP("tenure") AS sd FROM c WHERE "tenure" IS NOT NULL),
b AS (SELECT CASE WHEN hi > lo THEN LEAST(CAST(FLOOR((CAST("tenure" AS DOUBLE) - lo) / (hi - lo) * 1024) AS BIGINT), 1023)
                  ELSE 0 END AS bin, COUNT(*) AS cnt
      FROM c, st WHERE "tenure" IS NOT NULL GROUP BY 1),
g AS (SELECT range AS point FROM range(0, 200)),
k AS (SELECT point, SUM(cnt * EXP(-0.5 * POWER(((lo + point * (hi - lo) / 199)
                                   - (lo + (bin + 0.5) * (hi - lo) / 1024)) / (sd * POWER(CAST(n AS DOUBLE), -0.2)), 2))) AS sm
      FROM b, g, st GROUP BY point)
SELECT point, ROUND(lo + point * (hi - lo) / 199, 6) AS x,
       ROUND(sm / (n * sd * POWER(CAST(n AS DOUBLE), -0.2) * SQRT(2 * PI())) * sd, 6) AS density_x_sd
FROM k, st"""))
def kde_tenure(spark, sf_dir):
    """HST4: tenure, binned Gaussian KDE on a 200-point grid (density scaled by the std)."""
    c = C.labelled(spark, sf_dir)
    sd = c.agg(F.stddev_samp("tenure").alias("__sd"))
    k = H.kde(c, "tenure").crossJoin(F.broadcast(sd))
    return k.select(F.col("point").cast("long").alias("point"), C.r6("x"),
                    C.r6(F.col("density") * F.col("__sd"), "density_x_sd"))


@register("box_by_churn", with_clean("""
WITH q AS (SELECT "Churn", QUANTILE_CONT("MonthlyCharges", 0.25) AS q1, MEDIAN("MonthlyCharges") AS median,
                  QUANTILE_CONT("MonthlyCharges", 0.75) AS q3 FROM c GROUP BY "Churn")
SELECT q."Churn", ROUND(q1, 6) AS q1, ROUND(median, 6) AS median, ROUND(q3, 6) AS q3,
       ROUND(q3 - q1, 6) AS iqr, COUNT(*) AS n,
       ROUND(MIN(CASE WHEN "MonthlyCharges" >= q1 - 1.5 * (q3 - q1) THEN "MonthlyCharges" END), 6) AS whisker_lo,
       ROUND(MAX(CASE WHEN "MonthlyCharges" <= q3 + 1.5 * (q3 - q1) THEN "MonthlyCharges" END), 6) AS whisker_hi,
       CAST(SUM(CASE WHEN "MonthlyCharges" < q1 - 1.5 * (q3 - q1) OR "MonthlyCharges" > q3 + 1.5 * (q3 - q1)
                THEN 1 ELSE 0 END) AS BIGINT) AS outliers
FROM c JOIN q ON c."Churn" IS NOT DISTINCT FROM q."Churn"
GROUP BY q."Churn", q1, median, q3"""))
def box_by_churn(spark, sf_dir):
    """HST5: exact quartiles and whiskers of monthly charges by churn class."""
    b = H.box_summary(C.labelled(spark, sf_dir), "MonthlyCharges", ["Churn"])
    return b.select("Churn", C.r6("q1"), C.r6("median"), C.r6("q3"), C.r6("iqr"), "n",
                    C.r6("whisker_lo"), C.r6("whisker_hi"), "outliers")


@register("box_tenure_by_churn", with_clean("""
WITH q AS (SELECT "Churn", QUANTILE_CONT("tenure", 0.25) AS q1, MEDIAN("tenure") AS median,
                  QUANTILE_CONT("tenure", 0.75) AS q3 FROM c GROUP BY "Churn")
SELECT q."Churn", ROUND(q1, 6) AS q1, ROUND(median, 6) AS median, ROUND(q3, 6) AS q3,
       ROUND(q3 - q1, 6) AS iqr, COUNT(*) AS n,
       ROUND(MIN(CASE WHEN "tenure" >= q1 - 1.5 * (q3 - q1) THEN CAST("tenure" AS DOUBLE) END), 6) AS whisker_lo,
       ROUND(MAX(CASE WHEN "tenure" <= q3 + 1.5 * (q3 - q1) THEN CAST("tenure" AS DOUBLE) END), 6) AS whisker_hi,
       CAST(SUM(CASE WHEN "tenure" < q1 - 1.5 * (q3 - q1) OR "tenure" > q3 + 1.5 * (q3 - q1)
                THEN 1 ELSE 0 END) AS BIGINT) AS outliers
FROM c JOIN q ON c."Churn" IS NOT DISTINCT FROM q."Churn"
GROUP BY q."Churn", q1, median, q3"""))
def box_tenure_by_churn(spark, sf_dir):
    """HST5: exact quartiles and whiskers of tenure by churn class."""
    b = H.box_summary(C.labelled(spark, sf_dir), "tenure", ["Churn"])
    return b.select("Churn", C.r6("q1"), C.r6("median"), C.r6("q3"), C.r6("iqr"), "n",
                    C.r6("whisker_lo"), C.r6("whisker_hi"), "outliers")


# ---------------------------------------------------------------- splits
_HASH_TEST = """CASE WHEN substr(md5('42:' || "customerID"), 1, 8) < '33333333' THEN 'test' ELSE 'train' END"""


@register("split_hash", with_subscribers(f"""SELECT "customerID", {_HASH_TEST} AS split FROM s"""))
def split_hash(spark, sf_dir):
    """SPL1: seeded-hash 80/20 split (layout- and engine-independent)."""
    return SP.assign_split(C.raw(spark, sf_dir), "customerID").select("customerID", "split")


@register("split_exact", with_subscribers("""
SELECT "customerID",
       CASE WHEN ROW_NUMBER() OVER (ORDER BY md5('42:' || "customerID"), "customerID")
                 <= ROUND_EVEN(0.8 * COUNT(*) OVER (), 0) THEN 'train' ELSE 'test' END AS split
FROM s"""))
def split_exact(spark, sf_dir):
    """SPL1 exact: exactly round(0.8 n) train rows (two-pass global rank)."""
    return SP.assign_split(C.raw(spark, sf_dir), "customerID", exact=True).select("customerID", "split")


@register("split_stratified", with_clean("""
SELECT "customerID",
       CASE WHEN ROW_NUMBER() OVER (PARTITION BY "Churn" ORDER BY md5('42:' || "customerID"), "customerID")
                 <= ROUND_EVEN(0.8 * COUNT(*) OVER (PARTITION BY "Churn"), 0) THEN 'train' ELSE 'test' END AS split
FROM c"""))
def split_stratified(spark, sf_dir):
    """SPL1 stratified: exact per-class 80/20 (class offsets, no per-class window)."""
    return SP.assign_split(C.labelled(spark, sf_dir), "customerID", stratify="Churn") \
        .select("customerID", "split")


@register("split_balance", with_clean(f"""
SELECT {_HASH_TEST} AS split, COUNT(*) AS n, ROUND(AVG("Churn"), 6) AS churn_rate FROM c GROUP BY 1"""))
def split_balance(spark, sf_dir):
    """AGG15: size and churn rate of each split."""
    s = SP.assign_split(C.labelled(spark, sf_dir), "customerID")
    return s.groupBy("split").agg(F.count(F.lit(1)).alias("n"), C.r6(F.avg("Churn"), "churn_rate"))


@register("sample_k", with_subscribers("""
SELECT "customerID", tenure FROM s ORDER BY md5('42:' || "customerID"), "customerID" LIMIT 500"""))
def sample_k(spark, sf_dir):
    """SMP1: deterministic fixed-size sample (k = 500)."""
    return SP.sample_k(C.raw(spark, sf_dir), "customerID", 500).select("customerID", "tenure")


@register("ltv_target_stats", with_clean("""
SELECT ROUND(AVG("TotalCharges"), 6) AS mean, ROUND(STDDEV_SAMP("TotalCharges"), 6) AS std FROM c"""))
def ltv_target_stats(spark, sf_dir):
    """AGG16: LTV target mean and sample std."""
    c = C.customers(spark, sf_dir)
    return c.agg(C.r6(F.avg("TotalCharges"), "mean"), C.r6(F.stddev_samp("TotalCharges"), "std"))
