"""Helpers shared by the training-data operators: scratch tables, text cleaning, components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlframe.sources.scratch import scratch_path

_LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, *_LOWER)


#: Rows of an Arrow batch of texts: a few MB, where Spark's default of 10,000 rows may be hundreds.
TEXT_ROWS = 1000


def in_small_batches(df: DataFrame) -> DataFrame:
    """The frame, its session set to send whole texts to Python in batches that suit them."""
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") or 0) not in range(1, TEXT_ROWS + 1):
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXT_ROWS))
    return df


def save(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Smallest reachable node id per node: ``nodes(node)``, ``edges(a, b)`` -> ``(node, component)``.

    Each round takes the least label among a node and its neighbours, then jumps to the label of that label, so
    chains shrink geometrically, until no label moves. Every round is written to the shared folder. Only whether a label
    moved reaches the driver.
    """
    both = save(
        edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(),
        "cc-edges",
    )
    touched = both.select(F.col("a").alias("node")).distinct()
    labels = save(touched.withColumn("label", F.col("node")), "cc-0")
    turn, moving = 0, True
    while moving:
        near = (
            both.join(labels.select(F.col("node").alias("b"), "label"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("label").alias("near"))
        )
        step = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("label").alias("lower"))
        done = step.join(jump, "low").select("node", F.least("low", "lower").alias("label"), (F.least("low", "lower") != F.col("label")).alias("moved"))
        turn += 1
        done = save(done, f"cc-{turn}")
        labels = done.select("node", "label")
        moving = done.where("moved").limit(1).count() > 0
    return nodes.join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("component"))
