"""Profile, dashboard and view aggregates (AGG*, PRF*, FLT*).

All aggregates are algebraic (count/sum/avg/min/max), so Spark combines them
map-side before the shuffle: a hot group costs one partial row per task.
Several KPI cards are fused into one pass with conditional aggregation.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import risk_tier
from ..schemas import RISK_FACTORS


def churn_by_contract(customers: DataFrame) -> DataFrame:
    """AGG1 (view v_churn_by_contract)."""
    return (customers.groupBy("Contract").agg(
        F.count(F.lit(1)).alias("total_customers"),
        F.sum("Churn").cast("long").alias("churned"),
        F.round(F.avg("Churn") * 100, 2).alias("churn_rate_pct"),
        F.round(F.avg("MonthlyCharges"), 2).alias("avg_monthly_charges"))
        .orderBy(F.desc_nulls_first("churn_rate_pct")))


def ltv_segments(predictions: DataFrame, tier_col: str = "churn_risk_tier") -> DataFrame:
    """AGG2 (view v_ltv_segments) over the prediction log."""
    if tier_col not in predictions.columns:
        predictions = predictions.withColumn(tier_col, risk_tier("churn_probability"))
    return (predictions.groupBy(tier_col).agg(
        F.count(F.lit(1)).alias("customers"),
        F.round(F.avg("ltv_prediction"), 2).alias("avg_ltv"),
        F.round(F.avg("churn_probability") * 100, 2).alias("avg_churn_prob_pct"))
        .orderBy(F.desc_nulls_first("avg_ltv")))


def kpis(customers: DataFrame) -> DataFrame:
    """AGG3: n, churned, churn %, mean monthly charges, mean tenure (one pass)."""
    return customers.agg(
        F.count(F.lit(1)).alias("n_total"),
        F.sum("Churn").cast("long").alias("n_churned"),
        (F.sum("Churn") / F.count(F.lit(1)) * 100).alias("churn_rate"),
        F.avg("MonthlyCharges").alias("avg_charges"),
        F.avg("tenure").alias("avg_tenure"))


def dashboard_filter(contracts: Sequence[str] = (), internet: Sequence[str] = (),
                     tenure: tuple[float, float] | None = None,
                     monthly: tuple[float, float] | None = None,
                     gender: str | None = None, senior_only: bool = False) -> F.Column:
    """FLT1-3 as one predicate: empty lists / None mean 'no filter'."""
    cond = F.lit(True)
    if contracts:
        cond = cond & F.col("Contract").isin(list(contracts))
    if internet:
        cond = cond & F.col("InternetService").isin(list(internet))
    if tenure is not None:
        cond = cond & F.col("tenure").between(tenure[0], tenure[1])
    if monthly is not None:
        cond = cond & F.col("MonthlyCharges").between(monthly[0], monthly[1])
    if gender not in (None, "All"):
        cond = cond & (F.col("gender") == gender)
    if senior_only:
        cond = cond & (F.col("SeniorCitizen") == 1)
    return cond


def kpis_filtered_vs_overall(customers: DataFrame, predicate: F.Column) -> DataFrame:
    """AGG4: filtered KPIs beside full-data KPIs in a single scan."""
    sel = F.coalesce(predicate, F.lit(False))
    n_sel = F.sum(F.when(sel, 1).otherwise(0))
    return customers.agg(
        n_sel.cast("long").alias("n_filtered"),
        F.count(F.lit(1)).alias("n_total"),
        F.sum(F.when(sel, F.col("Churn"))).cast("long").alias("n_churned"),
        (F.sum(F.when(sel, F.col("Churn"))) / n_sel * 100).alias("churn_rate"),
        F.avg(F.when(sel, F.col("MonthlyCharges"))).alias("avg_charges"),
        F.avg("MonthlyCharges").alias("avg_charges_overall"),
        F.avg(F.when(sel, F.col("tenure"))).alias("avg_tenure"),
        F.avg("tenure").alias("avg_tenure_overall"))


NO_MATCH = "no customers match"


def guarded_kpis(customers: DataFrame, filters: Mapping[str, F.Column]) -> DataFrame:
    """FLT4: KPIs of several filter choices in one scan; a choice that matches nobody says so and has null KPIs."""
    def kpis(name: str, predicate: F.Column) -> F.Column:
        sel = F.coalesce(predicate, F.lit(False))
        n = F.count(F.when(sel, 1))
        return F.struct(
            F.lit(name).alias("filter_name"), n.alias("n"),
            F.when(n == 0, NO_MATCH).otherwise("ok").alias("status"),
            (F.avg(F.when(sel, F.col("Churn"))) * 100).alias("churn_rate"),
            F.avg(F.when(sel, F.col("MonthlyCharges"))).alias("avg_charges"))

    row = customers.agg(F.array(*[kpis(name, p) for name, p in filters.items()]).alias("k"))
    return row.select(F.inline("k"))


def non_empty(df: DataFrame, message: str = NO_MATCH) -> DataFrame:
    """FLT4: the frame itself, or ``ValueError`` when it has no row (stops at the first row found)."""
    if df.isEmpty():
        raise ValueError(message)
    return df


def churn_share(customers: DataFrame, label: str = "Churn") -> DataFrame:
    """AGG5 / AGG13: class counts and share of the total."""
    counts = customers.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("__total"))  # one row
    return counts.crossJoin(F.broadcast(total)).select(label, "n", (F.col("n") / F.col("__total")).alias("share"))


def crosstab_counts(customers: DataFrame, row: str, col: str = "Churn",
                    values: Sequence[str] = ("No", "Yes")) -> DataFrame:
    """AGG6 / AGG7: zero-filled pivot of counts (fixed pivot values: one pass, no discovery job)."""
    return (customers.groupBy(row).pivot(col, list(values)).count().fillna(0, subset=list(values))
            .select(row, *[F.col(v).cast("long").alias(v) for v in values]))


def rate_by(customers: DataFrame, key: str, label: str = "Churn", digits: int = 1) -> DataFrame:
    """AGG8 / AGG9: churn rate (percent, rounded) per group, ascending."""
    return (customers.groupBy(key).agg(F.avg(label).alias("churn_rate"))
            .withColumn("churn_pct", F.round(F.col("churn_rate") * 100, digits))
            .orderBy("churn_rate"))


def min_max_normalise(rates: DataFrame, value: str = "churn_pct", name: str = "norm") -> DataFrame:
    """AGG10: (v - min) / (max - min + 1e-9).

    min and max come from one global aggregate (partial per task, one row
    out), broadcast back: no window that would pull every row into one task.
    """
    bounds = rates.agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    return (rates.crossJoin(F.broadcast(bounds))
            .withColumn(name, (F.col(value) - F.col("__lo")) / (F.col("__hi") - F.col("__lo") + F.lit(1e-9)))
            .drop("__lo", "__hi"))


def mean_by(df: DataFrame, key: str, value: str, name: str | None = None) -> DataFrame:
    """AGG11 / AGG16-style grouped mean."""
    return df.groupBy(key).agg(F.avg(value).alias(name or f"avg_{value}"))


def value_counts(df: DataFrame, key: str) -> DataFrame:
    """AGG12: counts per value, descending."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), key)


def null_profile(df: DataFrame, only_positive: bool = True) -> DataFrame:
    """PRF1-3: null count per column in one pass, returned long (column, nulls, non_null)."""
    aggs = []
    for c in df.columns:
        aggs.append(F.sum(F.col(c).isNull().cast("long")).alias(f"n__{c}"))
    wide = df.agg(F.count(F.lit(1)).alias("__rows"), *aggs)
    stack = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"n__{c}").alias("nulls")) for c in df.columns]))
    long = wide.select("__rows", stack.alias("s")).select(
        F.col("s.column").alias("column"), F.col("s.nulls").alias("nulls"),
        (F.col("__rows") - F.col("s.nulls")).alias("non_null"))
    return long.where(F.col("nulls") > 0) if only_positive else long


def blank_profile(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """PRF4: cells exactly equal to one space, per string column."""
    cols = list(cols) if cols else [f.name for f in df.schema.fields
                                    if f.dataType.simpleString() == "string"]
    wide = df.agg(*[F.sum(F.when(F.col(c) == " ", 1).otherwise(0)).cast("long").alias(c) for c in cols])
    stack = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("blanks")) for c in cols]))
    return wide.select(stack.alias("s")).select("s.column", "s.blanks")


def distinct_values(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """PRF5: distinct values per column, long (column, value), sorted."""
    parts = [df.select(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")).distinct()
             for c in cols]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy("column", "value")


def risk_factor_lift(customers: DataFrame, label: str = "Churn") -> DataFrame:
    """SEG3: the dashboard's static risk factors, measured: n, churn rate, lift.

    One scan: each factor is a conditional aggregate; the overall rate is the
    denominator of the lift.
    """
    preds = [
        F.col("Contract") == "Month-to-month",
        F.col("InternetService") == "Fiber optic",
        F.col("tenure").between(0, 12),
        F.col("PaymentMethod") == "Electronic check",
        F.col("SeniorCitizen") == 1,
    ]
    aggs = [F.count(F.lit(1)).alias("__n"), F.avg(label).alias("__rate")]
    for i, p in enumerate(preds):
        hit = F.coalesce(p, F.lit(False))
        aggs.append(F.sum(F.when(hit, 1).otherwise(0)).alias(f"n{i}"))
        aggs.append(F.avg(F.when(hit, F.col(label))).alias(f"r{i}"))
    wide = customers.agg(*aggs)
    rows = F.explode(F.array(*[
        F.struct(F.lit(name).alias("factor"), F.lit(level).alias("level"),
                 F.col(f"n{i}").cast("long").alias("n"), F.col(f"r{i}").alias("churn_rate"))
        for i, (name, level) in enumerate(RISK_FACTORS)]))
    return (wide.select("__rate", rows.alias("s"))
            .select("s.factor", "s.level", "s.n", "s.churn_rate",
                    (F.col("s.churn_rate") / F.col("__rate")).alias("lift")))
