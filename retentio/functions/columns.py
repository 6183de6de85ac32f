"""Column expressions (JVM-side, codegen-friendly; no Python UDFs)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import TENURE_BINS, TENURE_LABELS, TIER_ONLINE


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_number(c) -> Column:
    """Blank/whitespace text -> null, then a non-raising numeric cast; NaN -> null."""
    text = col(c).cast("string")
    value = F.when(text.rlike(r"^\s*$"), F.lit(None).cast("double")).otherwise(
        text.try_cast("double"))
    return F.when(F.isnan(value), F.lit(None).cast("double")).otherwise(value)


def yes_no_to_int(c) -> Column:
    """'Yes' -> 1, 'No' -> 0, anything else -> null."""
    c = col(c)
    return F.when(c == "Yes", 1).when(c == "No", 0).otherwise(F.lit(None).cast("int"))


def yes_flag(c) -> Column:
    """1 when the value is exactly 'Yes', else 0 (null counts 0)."""
    return F.when(col(c) == "Yes", 1).otherwise(0)


def tenure_cohort(c, clamp: bool = True) -> Column:
    """Right-closed yearly cohorts [0,12], (12,24], ... (60,72].

    ``clamp=True`` clips out-of-range tenure into the end bins and maps null to
    the first label; ``clamp=False`` leaves out-of-range and null as null.
    """
    t = col(c).cast("double")
    if clamp:
        t = F.when(t.isNull(), t).otherwise(
            F.least(F.greatest(t, F.lit(float(TENURE_BINS[0]))), F.lit(float(TENURE_BINS[-1]))))
    ladder = None
    for i, label in enumerate(TENURE_LABELS):
        lo, hi = TENURE_BINS[i], TENURE_BINS[i + 1]
        cond = (t >= lo) & (t <= hi) if i == 0 else (t > lo) & (t <= hi)
        ladder = F.when(cond, F.lit(label)) if ladder is None else ladder.when(cond, F.lit(label))
    if clamp:
        return ladder.otherwise(F.lit(TENURE_LABELS[0]))
    return ladder.otherwise(F.lit(None).cast("string"))


def risk_tier(p, high: float = TIER_ONLINE[0], low: float = TIER_ONLINE[1]) -> Column:
    p = col(p)
    return (F.when(p >= high, F.lit("HIGH"))
            .when(p >= low, F.lit("MEDIUM"))
            .otherwise(F.lit("LOW")))



def safe_ratio(num, den) -> Column:
    """num/den when den > 0, else 0.0 (null den -> 0.0, like the reference)."""
    den = col(den)
    return F.when(den > 0, col(num) / den).otherwise(F.lit(0.0))
