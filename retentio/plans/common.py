"""Frames shared by the named queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.clean import clean, map_churn
from ..operators.features import create_features
from ..sources import fixture

DIGITS = 6


def r6(c, name: str | None = None) -> Column:
    """Round to 6 decimals (both engines do the same in the oracle)."""
    col = F.col(c) if isinstance(c, str) else c
    out = F.round(col.cast("double"), DIGITS)
    name = name or (c if isinstance(c, str) else None)
    return out.alias(name) if name else out


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture.raw_subscribers(spark, sf_dir)


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned subscriber table (median-imputed TotalCharges, 0/1 Churn)."""
    return clean(raw(spark, sf_dir))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subscribers with 0/1 churn only (for aggregates that never touch TotalCharges)."""
    return map_churn(raw(spark, sf_dir))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return create_features(customers(spark, sf_dir))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture.model_free_scores(spark, sf_dir)


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture.prediction_log(spark, sf_dir)
