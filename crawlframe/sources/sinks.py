"""Sinks: chunked JSON lines with a manifest, disavow lists, URL lists in parts, named tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlframe.operators.sampling import ranked


def write_chunked_json(df: DataFrame, path: str, order: list[str], rows_per_file: int = 1000) -> DataFrame:
    """JSON lines in the given order, which must have no ties, in files of so many rows, and a manifest of them.

    The manifest ``(part, rows, bytes, sha256)`` is made from the files as they lie there and written last, to ``_manifest``
    within the folder, which readers pass over: a job that fails leaves none. It is returned as well.
    """
    lines = ranked(df.select(*order, F.to_json(F.struct(*df.columns)).alias("value")), [F.asc(c) for c in order], "__rank")
    lines = lines.withColumn("part", F.floor((F.col("__rank") - 1) / rows_per_file))
    lines.repartition("part").sortWithinPartitions("part", "__rank").select("part", "value").write.partitionBy("part").text(path)
    spark = df.sparkSession
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path)
    part = F.regexp_extract("path", "/part=([0-9]+)/", 1).cast("long")
    rows = F.length(F.col("content").cast("string")) - F.length(F.replace(F.col("content").cast("string"), F.lit("\n"), F.lit("")))
    manifest = files.select(part.alias("part"), rows.cast("long").alias("rows"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    manifest.sort("part").write.json(f"{path}/_manifest")
    return spark.read.schema("part long, rows long, bytes long, sha256 string").json(f"{path}/_manifest")


def disavow_lines(scores: DataFrame, threshold: float) -> DataFrame:
    """``scores(domain, score)`` -> sorted lines ``domain:x`` from a score on."""
    return scores.where(F.col("score") >= threshold).select(F.concat(F.lit("domain:"), "domain").alias("value")).distinct()


def write_lines(lines: DataFrame, path: str) -> None:
    """Sorted text in as many parts as the order's ranges give."""
    lines.sort("value").write.text(path)


def write_url_parts(urls: DataFrame, path: str, rows_per_file: int = 25_000) -> None:
    """Different URLs as text files of at most rows_per_file lines."""
    urls.select("loc").where("loc <> ''").distinct().write.option("maxRecordsPerFile", rows_per_file).text(path)


def report_tables(tables: dict[str, DataFrame], limits: dict[str, tuple[int, list[Column]]] | None = None) -> dict[str, DataFrame]:
    """Named tables of a report; a limit with its order applies to the report alone, never to what is computed."""
    limits = limits or {}
    return {name: df.orderBy(*limits[name][1]).limit(limits[name][0]) if name in limits else df for name, df in tables.items()}
