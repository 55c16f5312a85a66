"""Backlink profiles: classification columns, aggregates by donor and target, comparisons and scores.

Inputs are ``backlinks`` with source_domain, target_domain, target_url, anchor, follow, lost, dr, ur, traffic, http_code, ugc,
sponsored, link_type, language, first_seen and last_seen, and ``metrics`` with one row per domain.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crawlframe.functions.common import pct, rnd
from crawlframe.functions.urls import is_homepage, is_own, zone


def dr_bucket(dr: Column) -> Column:
    return F.when(dr.isNull(), "unknown").when(dr < 10, "0-9").when(dr < 30, "10-29").when(dr < 50, "30-49").when(dr < 70, "50-69").otherwise("70+")


def dr_decile(dr: Column) -> Column:
    low = F.floor(F.greatest(F.lit(0.0), F.least(F.lit(100.0), dr)) / 10).cast("int") * 10
    return F.when(dr.isNull(), "DR unknown").when(low >= 90, "DR 90-100").otherwise(F.concat(F.lit("DR "), low.cast("string"), F.lit("-"), (low + 9).cast("string")))


def http_class(code: Column) -> Column:
    return F.when(code.rlike("^[2-5]"), F.concat(F.substring(code, 1, 1), F.lit("xx"))).otherwise("unknown")


def anchor_class(anchor: Column, words: dict[str, list[str]]) -> Column:
    """One of eleven labels, by word lists in a fixed order of priority."""
    x = F.trim(F.regexp_replace(F.lower(F.coalesce(anchor, F.lit(""))), r"\s+", " "))

    def has(kind: str) -> Column:
        return reduce(lambda a, b: a | b, [x.contains(w) for w in words.get(kind, []) if w], F.lit(False))

    naked = x.rlike(r"^(https?://|www\.)") | x.rlike(r"^[a-z0-9.-]+\.[a-z]{2,}(?:/[^\s]*)?$")
    return (
        F.when(x == "", "empty")
        .when(naked, "naked_url")
        .when(has("spam"), "spam")
        .when(has("brand") & has("commercial"), "brand_commercial")
        .when(has("brand") & has("navigational"), "brand_navigational")
        .when(has("brand"), "brand")
        .when(has("navigational"), "navigational")
        .when(has("commercial"), "commercial")
        .when(has("informational"), "informational")
        .when(has("generic") | (F.length(x) <= 3), "generic")
        .otherwise("other")
    )


def brand_tokens(domains: DataFrame) -> DataFrame:
    """``(domain, token)``: host, its first label and the parts of that, of two characters and more."""
    h = F.regexp_replace(F.split(F.lower(F.trim("domain")), ":").getItem(0), r"^www\.", "")
    main = F.split(h, r"\.").getItem(0)
    rows = domains.select("domain", F.explode(F.concat(F.array(h, main), F.split(main, "[^a-z0-9а-яё]+"))).alias("token"))
    return rows.where(F.length("token") >= 2).distinct()


def donor_stats(links: DataFrame) -> DataFrame:
    """Means that ignore nulls and rates per donor; exports without a count of external links have 0 there."""
    external = F.col("external_links") if "external_links" in links.columns else F.lit(None).cast("double")
    share = lambda c: F.count_if(c) / F.count("*")
    return links.groupBy(F.col("source_domain").alias("domain")).agg(
        F.count("*").alias("links"),
        F.coalesce(F.avg("dr"), F.lit(0.0)).alias("avg_dr"),
        F.coalesce(F.avg("ur"), F.lit(0.0)).alias("avg_ur"),
        F.coalesce(F.avg("traffic"), F.lit(0.0)).alias("avg_traffic"),
        F.coalesce(F.avg(external), F.lit(0.0)).alias("avg_external_links"),
        share(F.col("follow") == F.lit(False)).alias("nofollow_rate"),
        share(F.col("lost")).alias("lost_rate"),
        share(F.col("http_code").startswith("2")).alias("http2xx_rate"),
    )


def target_profile(links: DataFrame) -> DataFrame:
    """Totals and shares per target; flags that an export does not have count as unset."""
    links = links.withColumns({c: F.lit(None).cast("boolean") for c in ("rendered", "raw") if c not in links.columns})
    home = is_homepage(F.col("target_url"))
    yes, no = F.coalesce("follow", F.lit(False)), F.coalesce(~F.col("follow"), F.lit(False))
    counted = links.groupBy("target_domain").agg(
        F.count("*").alias("n"),
        F.count_if(home).alias("home"),
        F.count_if(yes).alias("yes"),
        F.count_if(no).alias("no"),
        F.count_if(yes & home).alias("home_yes"),
        F.count_if(no & home).alias("home_no"),
        *[F.count_if(F.coalesce(c, F.lit(False))).alias(c) for c in ("lost", "ugc", "sponsored", "rendered", "raw")],
        F.count_if(F.col("http_code").startswith("2")).alias("ok"),
    )
    c = F.col
    return counted.select(
        "target_domain",
        c("n").alias("total_links"),
        pct(c("home"), c("n")).alias("homepage_pct"),
        pct(c("n") - c("home"), c("n")).alias("internal_pct"),
        pct(c("yes"), c("n")).alias("follow_pct"),
        pct(c("no"), c("n")).alias("nofollow_pct"),
        pct(c("home_yes"), c("yes")).alias("homepage_follow_pct"),
        pct(c("home_no"), c("no")).alias("homepage_nofollow_pct"),
        pct(c("yes") - c("home_yes"), c("yes")).alias("internal_follow_pct"),
        pct(c("no") - c("home_no"), c("no")).alias("internal_nofollow_pct"),
        pct(c("lost"), c("n")).alias("lost_pct"),
        pct(c("ugc"), c("n")).alias("ugc_pct"),
        pct(c("sponsored"), c("n")).alias("sponsored_pct"),
        pct(c("rendered"), c("n")).alias("rendered_pct"),
        pct(c("raw"), c("n")).alias("raw_pct"),
        pct(c("ok"), c("n")).alias("http_2xx_pct"),
    )


def quality_score() -> Column:
    """Quality of a profile from its shares: follow, answers, kept links, inner pages."""
    c = F.col
    return rnd(c("follow_pct") * 0.35 + c("http_2xx_pct") * 0.25 + (100.0 - c("lost_pct")) * 0.25 + (100.0 - c("homepage_pct")) * 0.15, 2)


def executive_kpis(links: DataFrame, own: str) -> DataFrame:
    """``(metric, ours, competitors_mean, difference)``: our shares and quality beside the mean of the competitors'."""
    mine = is_own(F.col("target_domain"), own)
    names = ["follow_pct", "lost_pct", "http_2xx_pct", "quality"]
    long = target_profile(links).withColumn("quality", quality_score()).unpivot(["target_domain"], names, "metric", "v")
    g = long.groupBy("metric").agg(rnd(F.avg(F.when(mine, F.col("v"))), 2).alias("ours"), rnd(F.avg(F.when(~mine, F.col("v"))), 2).alias("competitors_mean"))
    dr = links.agg(F.lit("avg_dr").alias("metric"), rnd(F.avg(F.when(mine, F.col("dr"))), 2).alias("ours"), rnd(F.avg(F.when(~mine, F.col("dr"))), 2).alias("competitors_mean"))
    return g.unionByName(dr).withColumn("difference", rnd(F.col("ours") - F.col("competitors_mean"), 2))


def overlap_matrix(links: DataFrame, own: str, shown: int = 8) -> DataFrame:
    """Each donor with the competitors it links to, and whether it is a gap, shared, or neither."""
    pairs = links.select("source_domain", "target_domain").distinct()
    mine = is_own(F.col("target_domain"), own)
    g = pairs.groupBy(F.col("source_domain").alias("domain")).agg(F.bool_or(mine).alias("has_ours"), F.count_if(~mine).alias("competitors"), F.count("*").alias("targets"), F.array_join(F.slice(F.array_sort(F.collect_set(F.when(~mine, F.col("target_domain")))), 1, shown), ", ").alias("competitor_list"))
    kind = F.when(~F.col("has_ours") & (F.col("competitors") >= 2), "gap").when(F.col("has_ours") & (F.col("competitors") > 0), "shared").otherwise("single")
    return g.withColumn("gap_type", kind)


def benchmark_table(links: DataFrame, metrics: DataFrame, own: str) -> DataFrame:
    """Each target's shares with its metrics and quality, and rows of mean and median of the competitors."""
    p = target_profile(links).withColumn("quality", quality_score())
    names = ["dr", "backlinks_all", "ref_domains_all", "follow_pct", "lost_pct", "http_2xx_pct", "homepage_pct", "ugc_pct", "sponsored_pct", "rendered_pct", "quality"]
    rows = p.join(best_metrics(metrics).withColumnRenamed("domain", "target_domain"), "target_domain", "left").select(F.col("target_domain").alias("domain"), *names)
    return rows.unionByName(_means(rows.where(~is_own(F.col("domain"), own)), names))


def _means(rows: DataFrame, names: list[str]) -> DataFrame:
    row = lambda label, f: rows.agg(*[rnd(f(c), 2).alias(c) for c in names]).select(F.lit(label).alias("domain"), *names)
    return row("mean", F.avg).unionByName(row("median", F.median))


def core_metrics(links: DataFrame, metrics: DataFrame) -> DataFrame:
    """Authority and volume of each target that has any, and rows of their mean and median."""
    names = ["dr", "backlinks_all", "ref_domains_all"]
    targets = links.select(F.col("target_domain").alias("domain")).distinct()
    rows = targets.join(best_metrics(metrics), "domain").where("coalesce(dr, backlinks_all, ref_domains_all) is not null").select("domain", *names)
    return rows.unionByName(_means(rows, names))


def with_imported(scores: DataFrame, imported: DataFrame) -> DataFrame:
    """Priority scores where imported rows replace computed ones of their domain."""
    fields = [c for c in scores.columns if c != "domain"]
    theirs = imported.select("domain", *[F.col(c).alias(f"i_{c}") for c in fields], F.lit(True).alias("i"))
    j = scores.join(theirs, "domain", "full_outer")
    return j.select("domain", *[F.when(F.col("i"), F.col(f"i_{c}")).otherwise(F.col(c)).alias(c) for c in fields])


def donor_classes(links: DataFrame, own: str) -> DataFrame:
    """Each donor: shared with us, only ours, one competitor's, or several competitors'."""
    pairs = links.select("source_domain", "target_domain").distinct()
    g = pairs.groupBy(F.col("source_domain").alias("domain")).agg(
        F.count("*").alias("targets"),
        F.bool_or(is_own(F.col("target_domain"), own)).alias("ours"),
        F.count_if(~is_own(F.col("target_domain"), own)).alias("competitors"),
        F.array_join(F.slice(F.array_sort(F.collect_set(F.when(~is_own(F.col("target_domain"), own), F.col("target_domain")))), 1, 5), ", ").alias("competitor_targets"),
    )
    kind = F.when(F.col("ours") & (F.col("competitors") > 0), "with_ours").when(F.col("ours"), "only_ours").when(F.col("competitors") == 1, "single_competitor").otherwise("several_competitors")
    return g.select("domain", kind.alias("class"), "targets", "competitors", "competitor_targets")


def overlap(links: DataFrame, own: str) -> DataFrame:
    """Donors that each competitor shares with us, has alone, and lacks."""
    pairs = links.select("source_domain", "target_domain").distinct()
    ours = pairs.where(is_own(F.col("target_domain"), own)).select("source_domain", F.lit(True).alias("ours")).distinct()
    n = F.broadcast(ours.agg(F.count("*").alias("n_ours")))
    g = pairs.where(~is_own(F.col("target_domain"), own)).join(ours, "source_domain", "left").groupBy("target_domain").agg(F.count("*").alias("refs"), F.count_if(F.col("ours")).alias("shared"))
    c = F.col
    return g.crossJoin(n).select(
        c("target_domain").alias("competitor_domain"),
        c("shared").alias("shared_ref_domains"),
        (c("refs") - c("shared")).alias("competitor_only_domains"),
        (c("n_ours") - c("shared")).alias("our_only_domains"),
        pct(c("shared"), c("refs")).alias("overlap_pct"),
        pct(c("shared"), c("n_ours")).alias("coverage_of_our_ref_domains_pct"),
        pct(c("refs") - c("shared"), c("refs")).alias("donor_gap_pct"),
    )


def best_metrics(metrics: DataFrame) -> DataFrame:
    """One row per domain: the most complete, then the largest."""
    numbers = ["dr", "traffic", "backlinks_all", "ref_domains_all"]
    filled = sum([F.col(c).isNotNull().cast("int") for c in numbers[1:]], F.col(numbers[0]).isNotNull().cast("int"))
    order = [F.desc("filled"), *[F.coalesce(c, F.lit(-1.0)).desc() for c in ("backlinks_all", "ref_domains_all", "traffic", "dr")]]
    ranked = metrics.withColumn("filled", filled).withColumn("r", F.row_number().over(Window.partitionBy("domain").orderBy(*order)))
    return ranked.where("r = 1").select("domain", *numbers)


def with_metrics(links: DataFrame, metrics: DataFrame) -> DataFrame:
    """Links with the donor's metrics where the row has none of its own."""
    m = best_metrics(metrics).select(F.col("domain").alias("source_domain"), F.col("dr").alias("m_dr"), F.col("traffic").alias("m_traffic"))
    return links.join(m, "source_domain", "left").withColumns({"effective_dr": F.coalesce("dr", "m_dr"), "effective_traffic": F.coalesce("traffic", "m_traffic")}).drop("m_dr", "m_traffic")


def mix(links: DataFrame, dims: dict[str, Column], by: list[str]) -> DataFrame:
    """Long table ``(*by, dimension, value, count, pct)`` of several dimensions, from one pass."""
    value = F.explode(F.array(*[F.struct(F.lit(k).alias("dimension"), F.coalesce(c.cast("string"), F.lit("unknown")).alias("value")) for k, c in dims.items()]))
    counts = links.select(*by, value.alias("v")).groupBy(*by, "v.dimension", "v.value").count()
    total = F.sum("count").over(Window.partitionBy(*by, "dimension"))
    return counts.select(*by, "dimension", "value", "count", pct(F.col("count"), total).alias("pct"))


PROFILE = ["homepage_pct", "internal_pct", "follow_pct", "nofollow_pct", "homepage_follow_pct", "homepage_nofollow_pct", "internal_follow_pct", "internal_nofollow_pct", "lost_pct"]


def benchmark(profile: DataFrame, own: str) -> DataFrame:
    """Our shares beside mean and median of the competitors'."""
    long = profile.unpivot(["target_domain"], PROFILE, "metric", "v")
    mine = is_own(F.col("target_domain"), own)
    g = long.groupBy("metric").agg(F.coalesce(F.max(F.when(mine, F.col("v"))), F.lit(0.0)).alias("our"), F.avg(F.when(~mine, F.col("v"))).alias("a"), F.median(F.when(~mine, F.col("v"))).alias("m"))
    g = g.select("metric", F.col("our").alias("our_site_pct"), rnd(F.col("a"), 2).alias("competitors_avg_pct"), rnd(F.col("m"), 2).alias("competitors_median_pct"))
    return g.withColumns({"delta_vs_avg": rnd(F.col("our_site_pct") - F.col("competitors_avg_pct"), 2), "delta_vs_median": rnd(F.col("our_site_pct") - F.col("competitors_median_pct"), 2)})


def candidates(links: DataFrame, own: str) -> DataFrame:
    """Statistics of donors that link to competitors and not to us, with the competitors they cover."""
    classes = donor_classes(links, own).where("class in ('single_competitor', 'several_competitors')").select("domain", "competitors")
    total = F.broadcast(links.where(~is_own(F.col("target_domain"), own)).agg(F.count_distinct("target_domain").alias("n")))
    return donor_stats(links).join(classes, "domain").crossJoin(total)


def opportunities(links: DataFrame, own: str) -> DataFrame:
    c = F.col
    found = candidates(links, own).withColumn("covered_pct", pct(c("competitors"), c("n")))
    score = c("covered_pct") * 0.35 + c("avg_dr") * 0.35 + F.least(c("avg_traffic"), F.lit(10000.0)) / 100.0 * 0.15 + (1.0 - c("nofollow_rate")) * 100.0 * 0.1 + (1.0 - c("lost_rate")) * 100.0 * 0.05
    return found.select(
        "domain",
        c("competitors").alias("competitors_covered"),
        "covered_pct",
        c("links").alias("links_in_dataset"),
        rnd(c("avg_dr"), 2).alias("avg_dr"),
        rnd(c("avg_traffic"), 2).alias("avg_traffic"),
        rnd((1.0 - c("nofollow_rate")) * 100.0, 2).alias("follow_pct"),
        rnd(c("lost_rate") * 100.0, 2).alias("lost_pct"),
        rnd(c("http2xx_rate") * 100.0, 2).alias("http_2xx_pct"),
        rnd(score, 2).alias("opportunity_score"),
    )


def ready_to_buy(opportunity: DataFrame) -> DataFrame:
    c = F.col
    strong = opportunity.where("avg_dr >= 30 and avg_traffic >= 50 and follow_pct >= 60 and lost_pct <= 40")
    return strong.withColumn("popularity_score", rnd(c("covered_pct") * 0.55 + c("avg_traffic") / 200.0 * 0.25 + c("avg_dr") * 0.20, 2))


def priorities(links: DataFrame, own: str) -> DataFrame:
    """Candidates by priority; the relaxed filter applies only where the strict one leaves nothing."""
    c = F.col
    found = candidates(links, own).where("avg_dr > 5")
    found = found.select("domain", rnd(c("avg_dr"), 2).alias("avg_dr"), rnd(c("avg_ur"), 2).alias("avg_ur"), rnd(c("avg_traffic"), 2).alias("avg_traffic"), rnd(c("nofollow_rate"), 4).alias("nofollow_rate"), rnd(c("avg_dr") * 0.5 + c("avg_ur") * 0.3 + c("avg_traffic") * 0.2 / 1000.0, 4).alias("priority_score"))
    strict, relaxed = (c("avg_dr") > 40) & (c("nofollow_rate") < 0.5), (c("avg_dr") > 30) & (c("nofollow_rate") < 0.7)
    n = F.broadcast(found.agg(F.count_if(strict).alias("n_strict")))
    return found.crossJoin(n).where(F.when(c("n_strict") > 0, strict).otherwise(relaxed)).drop("n_strict")


def velocity(links: DataFrame) -> DataFrame:
    """Links gained and lost per month."""
    month = lambda d: F.date_format(d, "yyyy-MM").alias("month")
    gained = links.where("first_seen is not null").select(month("first_seen"), F.lit(1).alias("gained"), F.lit(0).alias("lost"))
    lost = links.where("lost and last_seen is not null").select(month("last_seen"), F.lit(0).alias("gained"), F.lit(1).alias("lost"))
    g = gained.unionAll(lost).groupBy("month").agg(F.sum("gained").alias("gained"), F.sum("lost").alias("lost"))
    return g.withColumn("net", F.col("gained") - F.col("lost"))


def follow_classes(links: DataFrame) -> DataFrame:
    """How many donors only follow, only do not, do both, or say nothing."""
    g = links.groupBy("source_domain").agg(F.bool_or("follow").alias("some"), F.bool_or(~F.col("follow")).alias("none"))
    yes, no = F.coalesce("some", F.lit(False)), F.coalesce("none", F.lit(False))
    kind = F.when(yes & no, "mixed").when(yes, "follow_only").when(no, "nofollow_only").otherwise("unknown")
    return g.groupBy(kind.alias("follow_class")).agg(F.count("*").alias("domains"))


def zone_of_source(links: DataFrame) -> DataFrame:
    return links.withColumn("zone", zone(F.col("source_domain")))
