"""Ranks over whole tables, and samples by rank, without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crawlframe.operators.graph import cut


def ranked(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """Adds the place of each row in the order, from 1; the order must have no ties.

    Rows are ranged over partitions by the order and written once; ranks come from the partitions' counts.
    """
    ranged = cut(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    counts = ranged.groupBy("__part").agg(F.count("*").alias("__n"))
    # One row per partition, so this window stays small however many rows there are.
    before = counts.select("__part", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    own = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return ranged.join(F.broadcast(before), "__part").withColumn(name, (own + F.col("__before")).cast("long")).drop("__part", "__before")


def spread(df: DataFrame, order: list[str], k: int) -> DataFrame:
    """k rows at even distances of the sorted rows, first and last included; all if there are fewer."""
    places = cut(ranked(df, [F.asc(c) for c in order], "__rank"))
    n = places.count()
    wanted = sorted({int(i * (n - 1) / max(1, k - 1) + 0.5) + 1 for i in range(k)}) if n else []
    return places.where(F.col("__rank").isin(wanted)).select(*df.columns)
