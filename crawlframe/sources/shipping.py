"""The library itself, sent to the executors, so that their Python workers can import it."""

from __future__ import annotations

import io
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[2]
_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once for each application: workers of this process get the path, those of a cluster a zip from the shared folder."""
    context = spark.sparkContext
    if context.applicationId in _sent:
        return
    _sent.add(context.applicationId)
    if context.master.split("[")[0] == "local":
        known = context.environment.get("PYTHONPATH", "")
        context.environment["PYTHONPATH"] = f"{ROOT}:{known}" if known else str(ROOT)
        return
    from crawlframe.sources.scratch import scratch_path

    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as out:
        for file in sorted((ROOT / "crawlframe").rglob("*.py")):
            out.write(file, str(file.relative_to(ROOT)))
    path = f"{scratch_path(spark, 'library')}/crawlframe.zip"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target)
    stream.write(packed.getvalue())
    stream.close()
    context.addPyFile(path)
