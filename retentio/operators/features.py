"""Feature operators (FE1-5): cohorts, service density, billing ratios.

Each step is a pure column expression and skips itself when its inputs are
absent, so the chain works on partial frames (single API records, etc.).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import safe_ratio, tenure_cohort, yes_flag
from ..schemas import SERVICE_COLS


def add_tenure_cohorts(df: DataFrame, clamp: bool = True, name: str = "tenure_group") -> DataFrame:
    """FE1 / FE1b."""
    if "tenure" not in df.columns:
        return df
    return df.withColumn(name, tenure_cohort("tenure", clamp=clamp))


def add_service_density(df: DataFrame, name: str = "total_services") -> DataFrame:
    """FE2: number of the six optional services equal to exactly 'Yes'."""
    available = [c for c in SERVICE_COLS if c in df.columns]
    if not available:
        return df
    total = None
    for c in available:
        total = yes_flag(c) if total is None else total + yes_flag(c)
    return df.withColumn(name, total.cast("int"))


def add_billing_ratios(df: DataFrame) -> DataFrame:
    """FE3 + FE4: charge_ratio (0 when total is not > 0), charges_difference."""
    if not {"MonthlyCharges", "TotalCharges"} <= set(df.columns):
        return df
    total = F.col("TotalCharges").cast("double")
    out = df.withColumn("charge_ratio", safe_ratio("MonthlyCharges", total))
    if "tenure" in df.columns:
        out = out.withColumn("charges_difference",
                             total - F.col("tenure") * F.col("MonthlyCharges"))
    return out


def create_features(df: DataFrame) -> DataFrame:
    """FE5: cohorts -> service density -> billing ratios."""
    return df.transform(add_tenure_cohorts).transform(add_service_density).transform(add_billing_ratios)
