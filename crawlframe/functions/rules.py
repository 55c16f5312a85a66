"""Rule engine: a catalogue of conditions becomes issue rows and penalties in one pass."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Rule:
    code: str
    severity: str | Column
    penalty: float | Column
    when: Column
    category: str = ""


def _severity(rule: Rule) -> Column:
    return F.lit(rule.severity) if isinstance(rule.severity, str) else rule.severity


def _penalty(rule: Rule) -> Column:
    return rule.penalty if isinstance(rule.penalty, Column) else F.lit(float(rule.penalty))


def issue_array(rules: list[Rule]) -> Column:
    """Array of the issues that hold for a row; a null condition doesn't."""
    found = [F.when(F.coalesce(r.when, F.lit(False)), F.struct(F.lit(r.code).alias("code"), _severity(r).alias("severity"), _penalty(r).alias("penalty"), F.lit(r.category).alias("category"))) for r in rules]
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def issues(df: DataFrame, rules: list[Rule], keys: list[str]) -> DataFrame:
    """``(*keys, code, severity, penalty, category)``, a row per issue."""
    return df.select(*keys, F.explode(issue_array(rules)).alias("issue")).select(*keys, "issue.*")


def health(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """Adds the array ``issues`` and ``health``, 100 less all penalties."""
    d = df.withColumn("issues", issue_array(rules))
    return d.withColumn("health", F.greatest(F.lit(0.0), 100.0 - F.aggregate("issues", F.lit(0.0), lambda s, x: s + x["penalty"])))
