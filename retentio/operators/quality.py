"""Data-quality rules, referential checks and the keyed upsert (DQ1-5, SNK1, JN5-6).

Rules are column predicates evaluated in one pass (a conditional count per
rule). Referential checks are semi/anti joins on the key: both sides shuffle
on the key (or AQE broadcasts a side it has measured as small); keys are
unique on the dimension side, so no key is hot there.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    name: str
    predicate: Column
    null_ok: bool = True  # SQL CHECK semantics: NULL passes


def table_rules() -> list[Rule]:
    """DQ1: the table CHECK constraints (NULL passes)."""
    return [Rule("senior_citizen_in_0_1", F.col("SeniorCitizen").isin(0, 1)),
            Rule("tenure_non_negative", F.col("tenure") >= 0),
            Rule("churn_in_0_1", F.col("Churn").isin(0, 1))]


def request_rules(fields: Sequence[str]) -> list[Rule]:
    """DQ2: request validation (every field required; ranges; NULL fails)."""
    rules = [Rule(f"{c}_required", F.col(c).isNotNull(), null_ok=False) for c in fields]
    rules += [Rule("senior_citizen_0_to_1", F.col("SeniorCitizen").between(0, 1), null_ok=False),
              Rule("tenure_non_negative", F.col("tenure") >= 0, null_ok=False),
              Rule("monthly_non_negative", F.col("MonthlyCharges") >= 0, null_ok=False),
              Rule("total_non_negative", F.col("TotalCharges").cast("double") >= 0, null_ok=False)]
    return rules


def _passes(rule: Rule) -> Column:
    return F.coalesce(rule.predicate, F.lit(rule.null_ok))


def rule_report(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Violations per rule from a single scan: (rule, checked, violations)."""
    wide = df.agg(F.count(F.lit(1)).alias("__n"),
                  *[F.sum(F.when(_passes(r), 0).otherwise(1)).cast("long").alias(f"v{i}")
                    for i, r in enumerate(rules)])
    rows = F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), F.col(f"v{i}").alias("violations"))
                               for i, r in enumerate(rules)]))
    return wide.select("__n", rows.alias("r")).select("r.rule", F.col("__n").alias("checked"), "r.violations")


def split_valid(df: DataFrame, rules: Sequence[Rule]) -> tuple[DataFrame, DataFrame]:
    """Good rows and quarantined rows (with the list of failed rule names)."""
    failed = F.array_compact(F.array(*[F.when(~_passes(r), F.lit(r.name)) for r in rules]))
    tagged = df.withColumn("failed_rules", failed)
    return (tagged.where(F.size("failed_rules") == 0).drop("failed_rules"),
            tagged.where(F.size("failed_rules") > 0))


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """DQ3: keys occurring more than once (partial-aggregated count)."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def orphans(child: DataFrame, parent: DataFrame, fk: str, pk: str) -> DataFrame:
    """DQ4: child rows whose non-null foreign key has no parent (anti-join)."""
    keys = parent.select(F.col(pk).alias("__pk"))
    return child.where(F.col(fk).isNotNull()).join(keys, F.col(fk) == F.col("__pk"), "left_anti")


def valid_children(child: DataFrame, parent: DataFrame, fk: str, pk: str) -> DataFrame:
    """JN6: child rows with a parent (semi-join)."""
    keys = parent.select(F.col(pk).alias("__pk"))
    return child.join(keys, F.col(fk) == F.col("__pk"), "left_semi")


def set_null_orphans(child: DataFrame, parent: DataFrame, fk: str, pk: str) -> DataFrame:
    """DQ5: ON DELETE SET NULL: the foreign key becomes null when the parent is gone."""
    keys = parent.select(F.col(pk).alias("__pk")).distinct()
    j = child.join(keys, F.col(fk) == F.col("__pk"), "left")
    return j.withColumn(fk, F.when(F.col("__pk").isNotNull(), F.col(fk))).drop("__pk")


def upsert(target: DataFrame, source: DataFrame, key: str, keep_first: Sequence[str] = (),
           order: str | None = None) -> DataFrame:
    """SNK1: insert new keys; for existing keys take the *whole* source row
    (nulls included), except ``keep_first`` columns which keep the target value.

    A key repeated in the source keeps its last row by ``order`` via a
    ``max_by`` aggregate (partial aggregation: a hot key never gathers in one
    task); without ``order`` a repeated key fails the job. Then one full outer
    join on the key.
    """
    cols = target.columns
    if order is not None:
        src_cols = [c for c in source.columns if c != key]
        latest = source.groupBy(key).agg(F.max_by(F.struct(*src_cols), F.col(order)).alias("__r"))
        source = latest.select(key, *[F.col(f"__r.{c}").alias(c) for c in src_cols])
    else:
        src_cols = [c for c in source.columns if c != key]
        row = F.struct(*src_cols)
        once = source.groupBy(key).agg(F.first(row).alias("__r"), F.count(F.lit(1)).alias("__n"))
        once = once.withColumn("__r", F.when(F.col("__n") > 1, F.raise_error(F.lit("upsert: repeated source key")).cast(
            once.schema["__r"].dataType)).otherwise(F.col("__r")))
        source = once.select(key, *[F.col(f"__r.{c}").alias(c) for c in src_cols])
    t = target.select(*[F.col(c).alias(f"t__{c}") for c in cols])
    s = source.select(*[F.col(c).alias(f"s__{c}") for c in cols if c in source.columns],
                      F.lit(True).alias("__src"))
    j = t.join(s, F.col(f"t__{key}") == F.col(f"s__{key}"), "full_outer")
    has_src = F.col("__src").isNotNull()
    out = []
    for c in cols:
        sc = F.col(f"s__{c}") if c in source.columns else F.lit(None)
        if c == key:
            out.append(F.coalesce(F.col(f"s__{c}"), F.col(f"t__{c}")).alias(c))
        elif c in keep_first:
            out.append(F.coalesce(F.col(f"t__{c}"), sc).alias(c))
        else:
            out.append(F.when(has_src, sc).otherwise(F.col(f"t__{c}")).alias(c))
    return j.select(*out)
