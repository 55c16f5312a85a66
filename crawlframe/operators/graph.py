"""Link graph operators over ``edges(src, dst)`` and ``nodes(node)``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crawlframe.functions import urls as U
from crawlframe.functions.common import rnd
from crawlframe.sources.scratch import scratch_path


def cut(df: DataFrame) -> DataFrame:
    """Written to the shared folder and read back: computed once, with a short lineage that survives lost executors."""
    path = scratch_path(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def known_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Different edges whose ends are both known pages."""
    ends = nodes.select(F.col("node").alias("src"))
    return edges.select("src", "dst").distinct().join(ends, "src", "left_semi").join(ends.withColumnRenamed("src", "dst"), "dst", "left_semi").select("src", "dst")


#: Links of a page that stand in one row, so that a page with very many is several rows.
LINKS_A_ROW = 1000


def pagerank(edges: DataFrame, nodes: DataFrame, damping: float = 0.85, rounds: int = 20) -> DataFrame:
    """``(node, pagerank)``: dangling mass goes to all pages evenly; the highest is 100.

    A page's links are lists in its rows, so a round is one join, of what pages got with their lists, and one sum, of what they
    hand on; links are not shuffled one by one to meet scores. What pages without links have is summed under no page. A round
    reads what pages got twice, so it is written: kept lazy, the work would double with every round.
    """
    degree = edges.groupBy("src").agg(F.count("*").alias("out"))
    part = F.pmod(F.xxhash64("dst"), F.ceil(F.col("out") / LINKS_A_ROW))
    lists = edges.select("src", "dst").join(degree, "src").groupBy("src", "out", part.alias("part")).agg(F.collect_list("dst").alias("dsts"))
    pages = cut(nodes.select("node").distinct())
    base = cut(pages.join(lists.withColumnRenamed("src", "node").drop("part"), "node", "left"))
    n = max(1, pages.count())

    def scored(rows: DataFrame, got: DataFrame | None) -> DataFrame:
        if got is None:
            return rows.withColumn("score", F.lit(1.0 / n))
        lost = F.broadcast(got.where("node is null").agg(F.coalesce(F.sum("got"), F.lit(0.0)).alias("lost")))
        value = (1.0 - damping) / n + damping * F.coalesce("got", F.lit(0.0)) + damping * F.col("lost") / n
        return rows.join(got, "node", "left").crossJoin(lost).withColumn("score", value).drop("got", "lost")

    got = None
    for _ in range(rounds):
        handed = scored(base, got).select((F.col("score") / F.coalesce("out", F.lit(1))).alias("given"), F.explode_outer("dsts").alias("node"))
        got = cut(handed.groupBy("node").agg(F.sum("given").alias("got")))
    scores = cut(scored(pages, got))
    top = F.broadcast(scores.agg(F.max("score").alias("top")))
    return scores.crossJoin(top).select("node", rnd(F.col("score") / F.col("top") * 100.0, 2).alias("pagerank"))


def degrees(occurrences: DataFrame, nodes: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``(node, incoming, outgoing, orphan)``: incoming counts every occurrence of a link, outgoing different ones.

    ``known`` are the ``known_edges`` of both, where they are at hand.
    """
    into = occurrences.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("incoming"))
    out = (known or known_edges(occurrences, nodes)).groupBy(F.col("src").alias("node")).agg(F.count("*").alias("outgoing"))
    zero = F.lit(0).cast("long")
    found = nodes.join(into, "node", "left").join(out, "node", "left").select("node", F.coalesce("incoming", zero).alias("incoming"), F.coalesce("outgoing", zero).alias("outgoing"))
    return found.withColumn("orphan", F.col("incoming") == 0)


def click_depth(edges: DataFrame, start: Column | str) -> DataFrame:
    """``(node, depth)``: breadth-first levels from the start page, until no new page is found; unreached pages are left out."""
    spark = edges.sparkSession
    links = cut(edges.select("src", "dst").distinct())
    seen = front = cut(spark.range(1).select((F.lit(start) if isinstance(start, str) else start).alias("node"), F.lit(0).alias("depth")))
    depth = 0
    while front.limit(1).count():
        depth += 1
        found = links.join(front.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti")
        front = cut(found.withColumn("depth", F.lit(depth)))
        seen = seen.unionByName(front)
        if depth % 16 == 0:  # so that the union of levels stays short
            seen = cut(seen)
    return seen


def link_scores(ranks: DataFrame, degree: DataFrame, semantic: DataFrame) -> DataFrame:
    """Authority and quality of each page from rank, links and ``semantic(node, semantic)`` link counts."""
    j = ranks.join(degree, "node").join(semantic, "node", "left").withColumn("semantic", F.coalesce("semantic", F.lit(0).cast("long")))
    pa, inc, sem = F.col("pagerank"), F.col("incoming").cast("double"), F.col("semantic").cast("double")
    authority = F.floor(F.least(F.lit(100.0), pa * 20 + sem * 10 + F.least(F.lit(50.0), inc * 2))).cast("int")
    j = j.withColumn("link_authority", authority)
    score = F.least(F.lit(45.0), pa * 45) + F.least(F.lit(25.0), F.col("link_authority") * 0.25) + F.least(F.lit(15.0), inc * 2) + F.least(F.lit(10.0), sem * 2)
    score = score - F.when(F.col("orphan"), 10.0).otherwise(0.0) - F.when(F.col("outgoing") == 0, 5.0).otherwise(0.0)
    return j.select("node", "pagerank", "link_authority", F.floor(F.greatest(F.lit(0.0), F.least(F.lit(100.0), score))).cast("double").alias("link_quality"))


def broken_links(edges: DataFrame, status: DataFrame) -> DataFrame:
    """Per page, how many of its links lead to ``status(node, code)`` pages that fail or redirect."""
    j = edges.join(status.select(F.col("node").alias("dst"), "code"), "dst")
    return j.groupBy(F.col("src").alias("node")).agg(F.count_if(F.col("code") >= 400).alias("broken"), F.count_if(F.col("code").between(300, 399)).alias("redirecting"), F.array_join(F.slice(F.array_sort(F.collect_set(F.when(F.col("code") >= 400, F.col("dst")))), 1, 5), ", ").alias("broken_sample")).where("broken > 0 or redirecting > 0")


def unlinked_topics(topics: DataFrame, edges: DataFrame, k: int = 10) -> DataFrame:
    """Pages of ``topics(node, topic)`` that the first page of their topic does not link to."""
    first = topics.groupBy("topic").agg(F.min("node").alias("hub"))
    pairs = topics.join(first, "topic").where("node <> hub").select("topic", F.col("hub").alias("src"), F.col("node").alias("dst"))
    missing = pairs.join(edges, ["src", "dst"], "left_anti")
    return missing.withColumn("rank", F.row_number().over(Window.partitionBy("topic").orderBy("dst"))).where(F.col("rank") <= k)


def redirect_chains(hops: DataFrame) -> DataFrame:
    """``hops(from, to, status)`` -> ``(start, hops, final, path, loop, statuses, permanent, temporary)``.

    Every step joins the open ends with the hop table; a chain ends where there is no hop, or at a page it has been to, so
    every chain ends. A page has one hop at most. Where hops have ``ms``, chains have the ``ms`` of all their hops, added up on the way.
    """
    timed = "ms" in hops.columns
    table = cut(hops.select(F.col("from").alias("at"), F.col("to").alias("next"), "status", *([F.col("ms").cast("long").alias("took")] if timed else [])))
    starts = table.select("at").distinct()
    spent = [F.lit(0).cast("long").alias("ms")] if timed else []
    open_ = starts.select(F.col("at").alias("start"), "at", F.array("at").alias("path"), F.array().cast("array<int>").alias("codes"), *spent)
    columns, rounds = ["start", "at", "path", "codes", *(["ms"] if timed else [])], []
    while not rounds or open_.limit(1).count():
        j = open_.join(table, "at", "left")
        moved = F.col("next").isNotNull()
        step = j.select(
            "start",
            F.coalesce("next", "at").alias("at"),
            F.when(moved, F.array_append("path", F.col("next"))).otherwise(F.col("path")).alias("path"),
            F.when(moved, F.array_append("codes", F.col("status").cast("int"))).otherwise(F.col("codes")).alias("codes"),
            (moved & F.array_contains("path", F.col("next"))).alias("loop"),
            (~moved).alias("ended"),
            *([(F.col("ms") + F.coalesce("took", F.lit(0))).alias("ms")] if timed else []),
        )
        step = cut(step)
        rounds.append(step.where("loop or ended").select(*columns, "loop"))
        open_ = step.where("not loop and not ended").select(*columns)
    done = reduce(DataFrame.unionByName, rounds)
    return done.select(
        "start",
        F.size("codes").alias("hops"),
        F.col("at").alias("final"),
        "path",
        "loop",
        F.array_join(F.transform("codes", lambda x: x.cast("string")), ">").alias("statuses"),
        F.exists("codes", lambda x: x.isin(301, 308)).alias("permanent"),
        F.exists("codes", lambda x: x.isin(302, 303, 307)).alias("temporary"),
        *(["ms"] if timed else []),
    )


def redirect_ends(chains: DataFrame, pages: DataFrame) -> DataFrame:
    """``(start, final, cross_domain, soft_404, broken)`` of chains, with ``pages(url, code, title)`` for where they end."""
    domain = lambda c: U.registrable(U.host(F.col(c)))
    j = chains.select("start", "final").join(pages.withColumnRenamed("url", "final"), "final", "left")
    lost = (F.col("code") == 200) & F.lower("title").rlike("not found|404|does not exist")
    return j.select("start", "final", (domain("start") != domain("final")).alias("cross_domain"), F.coalesce(lost, F.lit(False)).alias("soft_404"), F.coalesce(F.col("code") >= 400, F.lit(False)).alias("broken"))


def hop_times(hops: DataFrame) -> DataFrame:
    """``hops(from, to, status, ms)`` -> ``(start, hops, ms)``: the time of all hops of a chain."""
    return redirect_chains(hops).select("start", "hops", "ms")
