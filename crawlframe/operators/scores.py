"""Score catalogues: evidence, detectors, calibrated confidences, page scores from named terms."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlframe.functions.common import clamp, rnd


@dataclass
class Term:
    """A part of a score: its value times a weight, at most a cap."""

    name: str
    value: Column
    weight: float
    cap: float = 100.0


def score(terms: list[Term], digits: int = 1) -> Column:
    """Sum of capped terms, between 0 and 100; a null value counts 0."""
    parts = [F.least(F.lit(t.cap), F.coalesce(t.value.cast("double"), F.lit(0.0)) * t.weight) for t in terms]
    return rnd(clamp(reduce(lambda a, b: a + b, parts)), digits)


def breakdown(df: DataFrame, keys: list[str], terms: list[Term]) -> DataFrame:
    """Long table ``(*keys, term, points)`` of what each term gives."""
    parts = F.explode(F.array(*[F.struct(F.lit(t.name).alias("term"), rnd(F.least(F.lit(t.cap), F.coalesce(t.value.cast("double"), F.lit(0.0)) * t.weight), 2).alias("points")) for t in terms]))
    return df.select(*keys, parts.alias("p")).select(*keys, "p.*")


def argmax_label(evidence: dict[str, Column], floor: float) -> Column:
    """``struct(label, confidence)`` of the highest evidence; the first of equals; ``unknown`` below the floor."""
    names = list(evidence)
    best = F.array_max(F.array(*[F.struct(evidence[n].cast("double").alias("s"), F.lit(-i).alias("r"), F.lit(n).alias("label")) for i, n in enumerate(names)]))
    total = reduce(lambda a, b: a + b, [evidence[n].cast("double") for n in names])
    confidence = rnd(best["s"] / F.greatest(F.lit(1.0), total), 4)
    return F.struct(F.when(best["s"] >= floor, best["label"]).otherwise("unknown").alias("label"), F.when(best["s"] >= floor, confidence).otherwise(0.0).alias("confidence"))


def detector_rows(df: DataFrame, keys: list[str], detectors: dict[str, Column]) -> DataFrame:
    """Long table ``(*keys, detector, detected, confidence)``; confidence is the detector's value from 0 to 1."""
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("detector"), F.coalesce(c.cast("double"), F.lit(0.0)).alias("confidence")) for n, c in detectors.items()]))
    d = df.select(*keys, rows.alias("d")).select(*keys, "d.*")
    return d.withColumn("detected", F.col("confidence") > 0)


def coverage(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Share of detectors that found something, and their mean confidence."""
    return rows.groupBy(*keys).agg(rnd(F.avg(F.col("detected").cast("int")), 4).alias("coverage"), rnd(F.coalesce(F.avg(F.when(F.col("detected"), F.col("confidence"))), F.lit(0.0)), 4).alias("mean_confidence"))


def calibrated(rows: DataFrame, profile: DataFrame) -> DataFrame:
    """``rows(page_type, detector, confidence)`` by ``profile(page_type, detector, multiplier, floor)``; unlisted ones stay."""
    j = rows.join(profile, ["page_type", "detector"], "left")
    value = rnd(F.least(F.lit(1.0), F.col("confidence") * F.coalesce("multiplier", F.lit(1.0))), 4)
    kept = F.when(value < F.coalesce("floor", F.lit(0.0)), 0.0).otherwise(value)
    return j.withColumn("calibrated", kept).withColumn("downgraded", F.col("calibrated") < F.col("confidence")).drop("multiplier", "floor")


def cooccurrence(entities: DataFrame) -> DataFrame:
    """``entities(doc_id, entity)`` -> ``(a, b, documents)``: how many documents hold both. Entities per document are few."""
    e = entities.select("doc_id", "entity").distinct()
    a, b = e.withColumnRenamed("entity", "a"), e.withColumnRenamed("entity", "b")
    return a.join(b, "doc_id").where("a < b").groupBy("a", "b").agg(F.count("*").alias("documents"))
