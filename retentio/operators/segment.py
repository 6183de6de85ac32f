"""Risk tiers, value/risk segmentation and top-risk lookup (SCO5-7, SEG1-2, AGG14, TOP3)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import risk_tier
from ..schemas import (SEGMENT_CHAMPION, SEGMENT_LOW_PRIORITY, SEGMENT_RESCUE, SEGMENT_STABLE,
                       TIER_OFFLINE, TIER_ONLINE)
from .quantile import exact_median

PRESETS = {"online": TIER_ONLINE, "offline": TIER_OFFLINE}


def add_tier(df: DataFrame, prob: str = "churn_probability", preset: str = "online",
             name: str = "churn_risk_tier") -> DataFrame:
    """SCO5 (online: unrounded p, 0.65/0.35) / SCO6 (offline: p rounded to 4 dp, 0.70/0.40)."""
    high, low = PRESETS[preset]
    p = F.col(prob)
    if preset == "offline":
        p = F.bround(p, 4)
    return df.withColumn(name, risk_tier(p, high, low))


def risk_adjusted(df: DataFrame, ltv: str = "ltv_prediction", prob: str = "churn_probability",
                  name: str = "risk_adjusted_ltv") -> DataFrame:
    """SEG1: LTV * (1 - p)."""
    return df.withColumn(name, F.col(ltv) * (1 - F.col(prob)))


def value_risk_segments(df: DataFrame, ltv: str = "ltv_prediction", prob: str = "churn_probability",
                        risk_threshold: float = 0.5, name: str = "segment") -> DataFrame:
    """SEG2: quadrants by (LTV >= median LTV, p >= threshold); exact distributed median."""
    med = exact_median(df, ltv, name="__median_ltv")
    # one-row scalar: provably tiny broadcast
    j = df.crossJoin(F.broadcast(med))
    high_spend = F.col(ltv) >= F.col("__median_ltv")
    high_risk = F.col(prob) >= risk_threshold
    seg = (F.when(high_spend & high_risk, SEGMENT_RESCUE)
           .when(high_spend, SEGMENT_CHAMPION)
           .when(high_risk, SEGMENT_LOW_PRIORITY)
           .otherwise(SEGMENT_STABLE))
    return j.withColumn(name, seg).drop("__median_ltv")


def segment_summary(df: DataFrame, segment: str = "segment", ltv: str = "ltv_prediction",
                    prob: str = "churn_probability", adj: str = "risk_adjusted_ltv") -> DataFrame:
    """AGG14: count and mean LTV / probability / risk-adjusted LTV per segment."""
    return df.groupBy(segment).agg(F.count(F.lit(1)).alias("customers"),
                                   F.avg(ltv).alias("avg_ltv"), F.avg(prob).alias("avg_churn_probability"),
                                   F.avg(adj).alias("avg_risk_adjusted_ltv"))


def top_risk(df: DataFrame, prob: str = "churn_probability", id_col: str = "customerID") -> DataFrame:
    """TOP3: the highest-probability row (ties -> smallest id); per-task top-1 then merge."""
    return df.orderBy(F.col(prob).desc(), F.col(id_col).asc()).limit(1)
