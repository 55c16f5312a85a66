"""Structured Streaming jobs over an event stream: budgets, history, alerts, counters, sessions.

Each takes a streaming (or batch) frame with ``ts`` as timestamp and returns one; ``run_available`` drives it to the end of
what is there. Windows are aligned to the clock. A window is given out once the watermark has passed its end.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crawlframe.sources.scratch import scratch_path


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """The events as a stream, with a proper timestamp; the path is a file or a folder."""
    schema = spark.read.parquet(path).schema
    as_glob = f"{path[:-1]}[{path[-1]}]"  # a file source takes a single file by a glob only
    return spark.readStream.schema(schema).parquet(as_glob).withColumn("ts", F.col("ts").cast("timestamp"))


def run_available(stream: DataFrame, name: str) -> DataFrame:
    """Write what the stream gives for all data that is there, and read it back."""
    spark = stream.sparkSession
    out, state = scratch_path(spark, name), scratch_path(spark, f"{name}-state")
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def over_budget(events: DataFrame, window: str = "1 hour", limit: int = 1, delay: str = "1 hour") -> DataFrame:
    """Subjects with more than limit requests in a fixed window."""
    counts = events.withWatermark("ts", delay).groupBy(F.window("ts", window), "user_id").agg(F.count("*").alias("requests"))
    return counts.where(F.col("requests") > limit).select(F.col("window.start").alias("start"), "user_id", "requests")


def windowed_counts(events: DataFrame, window: str = "1 day", slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Counts and sums per type, in tumbling or sliding windows."""
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    g = events.withWatermark("ts", delay).groupBy(w, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "6 hours", delay: str = "1 hour") -> DataFrame:
    """Activity sessions per subject."""
    g = events.withWatermark("ts", delay).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("events"))
    return g.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "user_id", "events")


def newest_of_day(snapshots: DataFrame) -> DataFrame:
    """``(user_id, day, ts, event_id, value)``: the newest of each subject and day."""
    g = snapshots.groupBy("user_id", "day").agg(F.max_by(F.struct("ts", "event_id", "value"), F.struct("ts", "event_id")).alias("r"))
    return g.select("user_id", "day", "r.*")


def keep_daily_snapshots(events: DataFrame, path: str) -> None:
    """Drive a stream of events into a table of daily snapshots, a later event of a day replacing the earlier one.

    Each batch merges the days that it holds and overwrites these partitions. A batch that runs again changes nothing.
    """
    from crawlframe.operators.graph import cut

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = cut(newest_of_day(batch.withColumn("day", F.to_date("ts")).select("user_id", "day", "ts", "event_id", "value")))
        if number or _exists(spark, path):
            days = fresh.select("day").distinct()
            kept = spark.read.schema(fresh.schema).parquet(path).join(days, "day", "left_semi")
            fresh = cut(newest_of_day(kept.select(*fresh.columns).unionByName(fresh)))
        fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)

    stream = events.writeStream.foreachBatch(merge).option("checkpointLocation", scratch_path(events.sparkSession, "snapshots-state")).trigger(availableNow=True).start()
    stream.awaitTermination()


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def snapshot_history(snapshots: DataFrame, keep: int = 50) -> DataFrame:
    """The newest snapshots of each subject, with the change to the one before."""
    order = Window.partitionBy("user_id")
    rows = snapshots.withColumns({"age": F.row_number().over(order.orderBy(F.desc("day"))), "previous": F.lag("value").over(order.orderBy("day"))})
    return rows.where(F.col("age") <= keep).select("user_id", "day", "value", (F.col("value") - F.col("previous")).alias("delta"))


def drop_alerts(daily: DataFrame, least: float = 3.0) -> DataFrame:
    """``daily(key, ts, value)`` -> ``(key, ts, value, previous)`` where the value fell by least or more from the one before.

    The last value of each key is kept as state; rows of a batch are taken in the order of their time.
    """

    def step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        out = []
        for r in pd.concat(list(batches)).sort_values("ts").itertuples():
            if last is not None and r.value - last <= -least:
                out.append((key[0], r.ts, r.value, last))
            last = r.value
        state.update((last,))
        yield pd.DataFrame(out, columns=["key", "ts", "value", "previous"])

    return daily.groupBy("key").applyInPandasWithState(step, "key string, ts timestamp, value double, previous double", "last double", "append", "NoTimeout")
