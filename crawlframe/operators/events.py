"""Vitals measurements and bot checks: statuses, grades, comparisons, summaries."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crawlframe.functions.common import pct, rnd
from crawlframe.operators.sampling import ranked

# Upper limits of good and of needing improvement.
LIMITS = {"lcp": (2500.0, 4000.0), "inp": (200.0, 500.0), "cls": (0.1, 0.25), "fcp": (1800.0, 3000.0), "ttfb": (800.0, 1800.0), "speed_index": (3400.0, 5800.0), "tbt": (200.0, 600.0), "tti": (3800.0, 7300.0)}
CORE = ["lcp", "inp", "cls"]
WEIGHTS = {"Google": 1.0, "Search": 0.9, "Bing": 0.8, "Yandex": 0.7, "AI": 0.5}
SLA = {"Google": 95.0, "Search": 90.0, "Bing": 90.0, "Yandex": 85.0, "AI": 70.0}


def metric_status(metric: Column, value: Column) -> Column:
    out = F.when(value.isNull(), "unknown")
    for m, (good, fair) in LIMITS.items():
        out = out.when((metric == m) & (value <= good), "good").when((metric == m) & (value <= fair), "needs_improvement").when(metric == m, "poor")
    return out.otherwise("unknown")


def worst_of(statuses: list[Column]) -> Column:
    s = F.array(*[F.coalesce(x, F.lit("unknown")) for x in statuses])
    return F.when(F.array_contains(s, "poor"), "poor").when(F.array_contains(s, "needs_improvement"), "needs_improvement").when(F.array_contains(s, "unknown"), "unknown").otherwise("good")


def site_snapshots(vitals: DataFrame, mean: Callable[[Column], Column] = F.avg) -> DataFrame:
    """``vitals(site, metric, value)`` -> one row per site: mean of each core metric, worst status, score."""
    wide = vitals.groupBy("site").pivot("metric", CORE).agg(mean(F.col("value")))
    wide = wide.select("site", *[rnd(F.col(m), 4).alias(m) for m in CORE])
    status = worst_of([metric_status(F.lit(m), F.col(m)) for m in CORE])
    part = [F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - F.col(m) / (2.0 * LIMITS[m][1]))) for m in CORE]
    return wide.withColumn("status", status).withColumn("score", rnd(reduce(lambda a, b: a + b, part) / len(CORE) * 100.0, 1))


def leaderboard(sites: DataFrame) -> DataFrame:
    """Sites by status, score and metrics; unknown values last. Ranked over partitions, so no task sees all sites."""
    rank = F.when(F.col("status") == "good", 0).when(F.col("status") == "needs_improvement", 1).when(F.col("status") == "poor", 2).otherwise(3)
    last = lambda c: F.coalesce(F.col(c), F.lit(1e12)).asc()
    return ranked(sites, [rank.asc(), F.coalesce("score", F.lit(-1.0)).desc(), last("lcp"), last("inp"), last("cls"), F.asc("site")])


def summary(sites: DataFrame) -> DataFrame:
    """One row: counts by status, and mean, median, least and most of the score."""
    return sites.agg(
        F.count("*").alias("sites"),
        *[F.count_if(F.col("status") == s).alias(s) for s in ("good", "needs_improvement", "poor", "unknown")],
        rnd(F.avg("score"), 2).alias("mean_score"),
        F.median("score").alias("median_score"),
        F.min("score").alias("min_score"),
        F.max("score").alias("max_score"),
    )


def against_primary(sites: DataFrame, primary) -> DataFrame:
    """Each other site's differences to the primary one, and its rank among them."""
    mine = F.broadcast(sites.where(F.col("site") == primary).select(*[F.col(c).alias(f"p_{c}") for c in ("score", *CORE)]))
    j = sites.where(F.col("site") != primary).crossJoin(mine)
    return j.select("site", *[rnd(F.col(c) - F.col(f"p_{c}"), 4).alias(f"delta_{c}") for c in ("score", *CORE)], (F.col("score") > F.col("p_score")).alias("ahead"))


def against_median(sites: DataFrame, primary) -> DataFrame:
    """``(metric, ours, competitors_median, gap, verdict)`` of one site beside all others; only the score is better when higher."""
    names = ["score", *CORE]
    long = sites.select("site", *[F.col(c).cast("double").alias(c) for c in names]).unpivot(["site"], names, "metric", "v")
    mine = F.col("site") == primary
    g = long.groupBy("metric").agg(F.max(F.when(mine, F.col("v"))).alias("ours"), F.median(F.when(~mine, F.col("v"))).alias("m"))
    better = F.when(F.col("metric") == "score", F.col("ours") > F.col("m")).otherwise(F.col("ours") < F.col("m"))
    verdict = F.when(F.col("ours").isNull() | F.col("m").isNull(), "unknown").when(F.col("ours") == F.col("m"), "even").when(better, "strength").otherwise("gap")
    return g.select("metric", rnd(F.col("ours"), 4).alias("ours"), rnd(F.col("m"), 4).alias("competitors_median"), rnd(F.col("ours") - F.col("m"), 4).alias("gap"), verdict.alias("verdict"))


def baseline_diff(current: DataFrame, baseline: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Long table ``(*keys, metric, current, baseline, delta)``."""
    c, b = (x.unpivot(keys, metrics, "metric", v) for x, v in ((current, "current"), (baseline, "baseline")))
    return c.join(b, [*keys, "metric"], "left").withColumn("delta", rnd(F.col("current") - F.col("baseline"), 4))


def history(snapshots: DataFrame, keep: int = 50) -> DataFrame:
    """``snapshots(domain, ts, seq, value)``: the last of equal times, the newest ones, and the change to the one before."""
    one = snapshots.withColumn("r", F.row_number().over(Window.partitionBy("domain", "ts").orderBy(F.desc("seq")))).where("r = 1")
    newest = one.withColumn("age", F.row_number().over(Window.partitionBy("domain").orderBy(F.desc("ts")))).where(F.col("age") <= keep)
    before = F.lag("value").over(Window.partitionBy("domain").orderBy("ts"))
    return newest.select("domain", "ts", "value", "age", rnd(F.col("value") - before, 4).alias("delta"))


def weighted_score(parts: DataFrame, weights: DataFrame) -> DataFrame:
    """``parts(id, part, value)`` with ``weights(part, weight)``: weights count over the parts that are there."""
    j = parts.where("value is not null").join(weights, "part")
    return j.groupBy("id").agg(rnd(F.sum(F.col("value") * F.col("weight")) / F.sum("weight"), 2).alias("score"), F.count("*").alias("parts"))


def with_verdicts(checks: DataFrame) -> DataFrame:
    """Crawlable, renderable and indexable from the flags of a check, and the reasons against."""
    crawl = F.col("accessible") & F.col("robots_allowed")
    render = crawl & F.col("has_content") & ~F.col("waf")
    index = render & ~F.col("x_robots") & ~F.col("meta")
    reasons = [
        F.when(~F.col("accessible"), "unreachable"),
        F.when(F.col("accessible") & ~F.col("has_content"), "empty_content"),
        F.when(~F.col("robots_allowed"), "robots_disallow"),
        F.when(F.col("x_robots") | F.col("meta"), "indexing_directive"),
        F.when(F.col("waf"), "waf_challenge"),
    ]
    return checks.withColumns({"crawlable": crawl, "renderable": render, "indexable": index, "reasons": F.filter(F.array(*reasons), lambda x: x.isNotNull())})


def _weight(category: Column, table: dict[str, float], default: float) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[category], F.lit(default))


def category_stats(verdicts: DataFrame) -> DataFrame:
    """Totals per bot category, and risk: the share that is not indexable by the category's weight."""
    n = F.col("total")
    flags = ["accessible", "has_content", "crawlable", "renderable", "indexable"]
    g = verdicts.groupBy("category").agg(F.count("*").alias("total"), *[F.count_if(c).alias(c) for c in flags])
    g = g.withColumns({"indexable_pct": pct(F.col("indexable"), n, 1), "weight": _weight(F.col("category"), WEIGHTS, 0.5), "sla_target_pct": _weight(F.col("category"), SLA, 85.0)})
    return g.withColumns({"sla_met": F.col("indexable_pct") >= F.col("sla_target_pct"), "risk": rnd((n - F.col("indexable")) / n * 100.0 * F.col("weight"), 1)})


def blockers(verdicts: DataFrame, ai_block_expected: bool = False) -> DataFrame:
    """Causes with counts and weights; an AI bot that is kept out on purpose does not count."""
    v = verdicts
    if ai_block_expected:
        v = v.where(~((F.col("category") == "AI") & (~F.col("accessible") | ~F.col("robots_allowed") | F.col("waf"))))
    rows = v.select("bot", "category", F.explode("reasons").alias("code")).where((F.col("code") == "unreachable") | True)
    rows = rows.withColumn("w", _weight(F.col("category"), WEIGHTS, 0.5))
    return rows.groupBy("code").agg(F.count("*").alias("count"), rnd(F.sum("w"), 2).alias("weighted"), F.array_join(F.slice(F.array_sort(F.collect_set("category")), 1, 5), ", ").alias("sample"))


def allow_category(verdicts: DataFrame) -> DataFrame:
    """What would be indexable if each category were let in."""
    stopped = ~F.col("accessible") | F.col("waf") | ~F.col("robots_allowed") | F.col("x_robots") | F.col("meta")
    g = verdicts.groupBy("category").agg(F.count_if(stopped).alias("affected"), F.count_if(stopped & ~F.col("indexable")).alias("gain"))
    total = F.broadcast(verdicts.agg(F.count("*").alias("n"), F.count_if("indexable").alias("now")))
    return g.crossJoin(total).select("category", "affected", (F.col("now") + F.col("gain")).alias("projected_indexable"), F.col("gain").alias("delta_indexable"), pct(F.col("now") + F.col("gain"), F.col("n"), 1).alias("projected_pct"))
