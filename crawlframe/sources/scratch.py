"""Paths in the shared folder for tables that a job writes and reads again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

from crawlframe.sources.shipping import ship


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the cluster's shared folder, removed when the session's JVM ends.

    ``spark.checkpoint.dir`` names that folder. Where it is unset a session in one process (a local test) gets a temporary
    one; a cluster, whose machines would not share that, gets an error.
    """
    ship(spark)
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/crawlframe/{name}-{uuid.uuid4().hex}"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path
