"""Rounding, shares and top-k that give equal digits on any engine and partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rnd(x: Column, digits: int) -> Column:
    """Round half up by floor, in plain double arithmetic."""
    return F.floor(x * 10.0**digits + 0.5) / F.lit(10.0**digits)


def rnd_sql(x: str, digits: int) -> str:
    return f"(floor(({x}) * {10.0**digits!r} + 0.5) / {10.0**digits!r})"


def pct(part: Column, total: Column, digits: int = 2) -> Column:
    """Share in percent; of nothing it is 0."""
    return rnd(part.cast("double") / F.greatest(F.lit(1.0), total.cast("double")) * 100.0, digits)


def pct_sql(part: str, total: str, digits: int = 2) -> str:
    return rnd_sql(f"CAST({part} AS DOUBLE) / greatest(1.0, CAST({total} AS DOUBLE)) * 100.0", digits)


#: Values below this are added up in billionths, which doubles hold exactly up to here.
EXACT_BELOW = 9e6


def exact_mean(x: Column) -> Column:
    """Mean that no order of the rows changes: a sum of billionths. With values beyond EXACT_BELOW it is the plain mean."""
    near = F.abs(x) < EXACT_BELOW
    units = F.floor(F.when(near, x) * 1e9 + 0.5).cast("decimal(20,0)")
    return F.when(F.count_if(near) == F.count(x), F.sum(units).cast("double") / (1e9 * F.count(x))).otherwise(F.avg(x))


def exact_mean_sql(x: str, where: str = "TRUE") -> str:
    near = f"abs({x}) < {EXACT_BELOW!r}::DOUBLE"
    of = lambda f, condition=where: f"{f} FILTER (WHERE {condition})"
    units = f"sum(CAST(floor(CASE WHEN {near} THEN {x} END * 1e9::DOUBLE + 0.5::DOUBLE) AS BIGINT))"
    return f"CASE WHEN {of('count(*)', f'({where}) AND {near}')} = {of(f'count({x})')} THEN CAST({of(units)} AS DOUBLE) / (1e9::DOUBLE * {of(f'count({x})')}) ELSE {of(f'avg({x})')} END"


def clamp(x: Column, low: float = 0.0, high: float = 100.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group; the order must have no ties."""
    w = Window.partitionBy(*by).orderBy(*order) if by else Window.orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def over_the_cluster(df: DataFrame) -> DataFrame:
    """The rows dealt over all cores where the input has fewer splits than these, as a small table of one file has.

    Large tables have more splits and are read as they are, without a shuffle.
    """
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df
