"""Queries over events as vitals measurements, bot checks and snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlframe.functions.common import exact_mean, exact_mean_sql, pct_sql, rnd, rnd_sql
from crawlframe.operators import events as E
from crawlframe.plans.registry import query, table

VITALS = """vt AS (SELECT event_id, user_id AS site, CASE event_id % 2 WHEN 0 THEN 'mobile' ELSE 'desktop' END AS strategy,
 CASE event_type WHEN 'click' THEN 'lcp' WHEN 'error' THEN 'inp' WHEN 'view' THEN 'cls' WHEN 'purchase' THEN 'fcp' ELSE 'ttfb' END AS metric,
 CASE event_type WHEN 'click' THEN value * 60 WHEN 'error' THEN value * 5 WHEN 'view' THEN value / 300 WHEN 'purchase' THEN value * 40 ELSE value * 20 END AS value, CAST(ts AS DATE) AS day FROM events)"""


def vitals(spark, sf_dir) -> DataFrame:
    """``(event_id, site, strategy, metric, value, day)``: event types as metrics, users as sites."""
    return table(spark, sf_dir, "events").selectExpr(
        "event_id",
        "user_id AS site",
        "CASE event_id % 2 WHEN 0 THEN 'mobile' ELSE 'desktop' END AS strategy",
        "CASE event_type WHEN 'click' THEN 'lcp' WHEN 'error' THEN 'inp' WHEN 'view' THEN 'cls' WHEN 'purchase' THEN 'fcp' ELSE 'ttfb' END AS metric",
        "CASE event_type WHEN 'click' THEN value * 60 WHEN 'error' THEN value * 5 WHEN 'view' THEN value / 300 WHEN 'purchase' THEN value * 40 ELSE value * 20 END AS value",
        "CAST(ts AS DATE) AS day",
    )


BOTS = """bt AS (SELECT event_id AS bot, CASE event_type WHEN 'click' THEN 'Google' WHEN 'view' THEN 'Search' WHEN 'purchase' THEN 'AI' WHEN 'error' THEN 'Yandex' ELSE 'Bing' END AS category,
 event_id % 10 <> 0 AS accessible, CAST(regexp_extract(props, '[0-9]+') AS INTEGER) % 4 <> 0 AS robots_allowed, value > 5 AS has_content, event_id % 17 = 0 AS x_robots, event_id % 19 = 0 AS meta, event_id % 23 = 0 AS waf, CAST(ts AS DATE) AS day FROM events),
bv AS (SELECT *, accessible AND robots_allowed AS crawlable, accessible AND robots_allowed AND has_content AND NOT waf AS renderable, accessible AND robots_allowed AND has_content AND NOT waf AND NOT x_robots AND NOT meta AS indexable FROM bt)"""


def bot_checks(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "event_id AS bot",
        "CASE event_type WHEN 'click' THEN 'Google' WHEN 'view' THEN 'Search' WHEN 'purchase' THEN 'AI' WHEN 'error' THEN 'Yandex' ELSE 'Bing' END AS category",
        "event_id % 10 <> 0 AS accessible",
        "CAST(get_json_object(props, '$.k') AS INT) % 4 <> 0 AS robots_allowed",
        "value > 5 AS has_content",
        "event_id % 17 = 0 AS x_robots",
        "event_id % 19 = 0 AS meta",
        "event_id % 23 = 0 AS waf",
        "CAST(ts AS DATE) AS day",
    )


def _status(metric: str, value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN 'unknown' " + " ".join(f"WHEN {metric} = '{m}' AND {value} <= {a} THEN 'good' WHEN {metric} = '{m}' AND {value} <= {b} THEN 'needs_improvement' WHEN {metric} = '{m}' THEN 'poor'" for m, (a, b) in E.LIMITS.items()) + " ELSE 'unknown' END"


def _means(mean) -> str:
    return f"""w AS (SELECT site, {", ".join(f"{rnd_sql(mean('value', f"metric = '{m}'"), 4)} AS {m}" for m in E.CORE)} FROM vt GROUP BY site)"""


_STATUSES = f"""si AS (SELECT site, lcp, inp, cls, CASE WHEN list_contains(s, 'poor') THEN 'poor' WHEN list_contains(s, 'needs_improvement') THEN 'needs_improvement' WHEN list_contains(s, 'unknown') THEN 'unknown' ELSE 'good' END AS status,
 {rnd_sql(f"({' + '.join(f'CASE WHEN {m} IS NULL THEN NULL ELSE greatest(0.0, least(1.0, 1.0 - {m} / {2.0 * E.LIMITS[m][1]!r}::DOUBLE)) END' for m in E.CORE)}) / 3 * 100.0", 1)} AS score
 FROM (SELECT *, [{", ".join(_status(f"'{m}'", m) for m in E.CORE)}] AS s FROM w))"""
_SITE = f"{_means(lambda x, where: f'avg({x}) FILTER (WHERE {where})')},\n{_STATUSES}"
_EXACT_SITE = f"{_means(exact_mean_sql)},\n{_STATUSES}"  # by means that no order of the rows changes


@query(f"WITH {VITALS} SELECT metric, {_status('metric', 'value')} AS status, count(*) AS n FROM vt GROUP BY 1, 2")
def b21_metric_status(spark, sf_dir):
    return vitals(spark, sf_dir).groupBy("metric", E.metric_status(F.col("metric"), F.col("value")).alias("status")).agg(F.count("*").alias("n"))


def sites(spark, sf_dir) -> DataFrame:
    return E.site_snapshots(vitals(spark, sf_dir))


def exact_sites(spark, sf_dir) -> DataFrame:
    return E.site_snapshots(vitals(spark, sf_dir), exact_mean)


_LAST = ", ".join(f"coalesce({m}, 1e12)" for m in E.CORE)


@query(
    f"""WITH {VITALS}, {_EXACT_SITE} SELECT *, row_number() OVER (ORDER BY CASE status WHEN 'good' THEN 0 WHEN 'needs_improvement' THEN 1 WHEN 'poor' THEN 2 ELSE 3 END, coalesce(score, -1.0) DESC, {_LAST}, site) AS rank FROM si"""
)
def e2_leaderboard(spark, sf_dir):
    return E.leaderboard(exact_sites(spark, sf_dir))


@query(
    f"""WITH {VITALS}, {_SITE} SELECT count(*) AS sites, {", ".join(f"count(*) FILTER (WHERE status = '{s}') AS {s}" for s in ("good", "needs_improvement", "poor", "unknown"))}, {rnd_sql("avg(score)", 2)} AS mean_score, median(score) AS median_score, min(score) AS min_score, max(score) AS max_score FROM si"""
)
def d27_vitals_summary(spark, sf_dir):
    return E.summary(sites(spark, sf_dir))


@query(f"WITH {VITALS} SELECT site, {', '.join(f'''{rnd_sql(f"avg(value) FILTER (WHERE strategy = '{s}' AND metric = 'lcp')", 4)} AS {s}''' for s in ('mobile', 'desktop'))} FROM vt WHERE metric = 'lcp' GROUP BY site")
def c19_device_comparison(spark, sf_dir):
    """Largest paint on mobile beside desktop."""
    p = vitals(spark, sf_dir).where("metric = 'lcp'").groupBy("site").pivot("strategy", ["mobile", "desktop"]).agg(F.avg("value"))
    return p.select("site", rnd(F.col("mobile"), 4).alias("mobile"), rnd(F.col("desktop"), 4).alias("desktop"))


_DELTA = ", ".join(f"{rnd_sql(f'si.{c} - p.{c}', 4)} AS delta_{c}" for c in ("score", *E.CORE))


@query(f"WITH {VITALS}, {_EXACT_SITE}, p AS (SELECT * FROM si WHERE site = (SELECT min(site) FROM si)) SELECT si.site, {_DELTA}, si.score > p.score AS ahead FROM si, p WHERE si.site <> p.site")
def c20_against_primary(spark, sf_dir):
    """Every site against the first."""
    s = exact_sites(spark, sf_dir)
    first = vitals(spark, sf_dir).agg(F.min("site")).first()[0]
    return E.against_primary(s, first)


@query(
    f"""WITH {VITALS}, g AS (SELECT site, day >= DATE '2024-01-16' AS now, CAST(count(*) AS DOUBLE) AS checks, avg(value) AS mean FROM vt WHERE metric = 'lcp' GROUP BY 1, 2),
l AS (SELECT site, now, 'checks' AS metric, checks AS v FROM g UNION ALL SELECT site, now, 'mean', {rnd_sql("mean", 4)} FROM g)
SELECT c.site, c.metric, c.v AS current, b.v AS baseline, {rnd_sql("c.v - b.v", 4)} AS delta FROM l c LEFT JOIN l b ON b.site = c.site AND b.metric = c.metric AND NOT b.now WHERE c.now"""
)
def c16_baseline_diff(spark, sf_dir):
    """The second half of the month against the first."""
    g = vitals(spark, sf_dir).where("metric = 'lcp'").groupBy("site", (F.col("day") >= F.lit("2024-01-16").cast("date")).alias("now")).agg(F.count("*").cast("double").alias("checks"), rnd(F.avg("value"), 4).alias("mean"))
    return E.baseline_diff(g.where("now"), g.where("not now"), ["site"], ["checks", "mean"])


@query(
    f"""WITH {VITALS}, s AS (SELECT site AS domain, day AS ts, event_id AS seq, value FROM vt), o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY domain, ts ORDER BY seq DESC) AS r FROM s) WHERE r = 1),
n AS (SELECT *, CAST(row_number() OVER (PARTITION BY domain ORDER BY ts DESC) AS INTEGER) AS age FROM o)
SELECT domain, ts, value, age, {rnd_sql("value - lag(value) OVER (PARTITION BY domain ORDER BY ts)", 4)} AS delta FROM n WHERE age <= 50"""
)
def e5_snapshot_history(spark, sf_dir):
    """Daily snapshots per site, newest fifty, with the change to the day before."""
    return E.history(vitals(spark, sf_dir).select(F.col("site").alias("domain"), F.col("day").alias("ts"), F.col("event_id").alias("seq"), "value"))


PARTS = {"lcp": 0.4, "inp": 0.3, "cls": 0.2, "fcp": 0.1}


@query(f"WITH {VITALS}, p AS (SELECT site AS id, metric AS part, avg(value) AS value FROM vt GROUP BY 1, 2), w(part, weight) AS (VALUES {', '.join(f'''('{k}', {v!r}::DOUBLE)''' for k, v in PARTS.items())}) SELECT id, {rnd_sql('sum(value * weight) / sum(weight)', 2)} AS score, count(*) AS parts FROM p JOIN w USING (part) GROUP BY id")
def c21_weighted_score(spark, sf_dir):
    parts = vitals(spark, sf_dir).groupBy(F.col("site").alias("id"), F.col("metric").alias("part")).agg(F.avg("value").alias("value"))
    return E.weighted_score(parts, spark.createDataFrame(list(PARTS.items()), "part string, weight double"))


_GRADE = "CASE WHEN score >= 90 THEN 'A' WHEN score >= 80 THEN 'B' WHEN score >= 70 THEN 'C' WHEN score >= 60 THEN 'D' WHEN score >= 50 THEN 'E' ELSE 'F' END"
_RISK = "CASE WHEN score >= 80 THEN 'low' WHEN score >= 50 THEN 'medium' ELSE 'high' END"


@query(f"WITH {VITALS}, {_EXACT_SITE} SELECT site, score, {_GRADE} AS grade, {_RISK} AS risk FROM si")
def b23_grades(spark, sf_dir):
    """Grade and risk bands of the site scores."""
    return exact_sites(spark, sf_dir).select("site", "score", F.expr(_GRADE).alias("grade"), F.expr(_RISK).alias("risk"))


_PLAN = """SELECT site, 'speed' AS area, 'P1' AS priority, 'slow_lcp' AS code FROM si WHERE lcp > 4000 UNION ALL SELECT site, 'speed', 'P2', 'fair_lcp' FROM si WHERE lcp > 2500 AND lcp <= 4000
 UNION ALL SELECT site, 'interaction', 'P1', 'slow_inp' FROM si WHERE inp > 500 UNION ALL SELECT site, 'interaction', 'P2', 'fair_inp' FROM si WHERE inp > 200 AND inp <= 500
 UNION ALL SELECT site, 'layout', 'P1', 'high_cls' FROM si WHERE cls > 0.25 UNION ALL SELECT site, 'layout', 'P2', 'fair_cls' FROM si WHERE cls > 0.1 AND cls <= 0.25"""


@query(f"WITH {VITALS}, {_SITE} {_PLAN}")
def b30_action_plan(spark, sf_dir):
    """Actions per site from the statuses of its metrics."""
    from crawlframe.functions.rules import Rule, issues

    rules = []
    for m, area, slow, fair in (("lcp", "speed", "slow_lcp", "fair_lcp"), ("inp", "interaction", "slow_inp", "fair_inp"), ("cls", "layout", "high_cls", "fair_cls")):
        good, most = E.LIMITS[m]
        rules += [Rule(slow, "P1", 0, F.col(m) > most, area), Rule(fair, "P2", 0, (F.col(m) > good) & (F.col(m) <= most), area)]
    return issues(sites(spark, sf_dir), rules, ["site"]).select("site", F.col("category").alias("area"), F.col("severity").alias("priority"), "code")


def verdicts(spark, sf_dir) -> DataFrame:
    return E.with_verdicts(bot_checks(spark, sf_dir))


_REASONS = "array_to_string(list_filter([CASE WHEN NOT accessible THEN 'unreachable' END, CASE WHEN accessible AND NOT has_content THEN 'empty_content' END, CASE WHEN NOT robots_allowed THEN 'robots_disallow' END, CASE WHEN x_robots OR meta THEN 'indexing_directive' END, CASE WHEN waf THEN 'waf_challenge' END], lambda x: x IS NOT NULL), ',')"


@query(f"WITH {BOTS} SELECT bot, crawlable, renderable, indexable, {_REASONS} AS reasons FROM bv")
def b17_indexability(spark, sf_dir):
    """Verdict and reasons of each check."""
    return verdicts(spark, sf_dir).select("bot", "crawlable", "renderable", "indexable", F.array_join("reasons", ",").alias("reasons"))


def _map(d: dict, default: float) -> str:
    return "CASE category " + " ".join(f"WHEN '{k}' THEN {v!r}::DOUBLE" for k, v in d.items()) + f" ELSE {default!r}::DOUBLE END"


_STATS = f"""cs AS (SELECT *, indexable_pct >= sla_target_pct AS sla_met, {rnd_sql("CAST(total - indexable AS DOUBLE) / total * 100.0 * weight", 1)} AS risk FROM (SELECT category, count(*) AS total, {", ".join(f"count(*) FILTER (WHERE {c}) AS {c}" for c in ("accessible", "has_content", "crawlable", "renderable", "indexable"))},
 {pct_sql("count(*) FILTER (WHERE indexable)", "count(*)", 1)} AS indexable_pct, {_map(E.WEIGHTS, 0.5)} AS weight, {_map(E.SLA, 85.0)} AS sla_target_pct FROM bv GROUP BY category))"""


@query(f"WITH {BOTS}, {_STATS} SELECT * FROM cs")
def d29_category_stats(spark, sf_dir):
    return E.category_stats(verdicts(spark, sf_dir))


@query(
    f"""WITH {BOTS}, r AS (SELECT category, unnest(list_filter([CASE WHEN NOT accessible THEN 'unreachable' END, CASE WHEN accessible AND NOT has_content THEN 'empty_content' END, CASE WHEN NOT robots_allowed THEN 'robots_disallow' END, CASE WHEN x_robots OR meta THEN 'indexing_directive' END, CASE WHEN waf THEN 'waf_challenge' END], lambda x: x IS NOT NULL)) AS code,
 {_map(E.WEIGHTS, 0.5)} AS w FROM bv WHERE NOT (category = 'AI' AND (NOT accessible OR NOT robots_allowed OR waf)))
SELECT code, count(*) AS count, {rnd_sql("sum(w)", 2)} AS weighted, array_to_string(list_sort(list(DISTINCT category))[1:5], ', ') AS sample FROM r GROUP BY code"""
)
def d30_blockers(spark, sf_dir):
    """Causes that keep bots out, where AI bots are kept out on purpose."""
    return E.blockers(verdicts(spark, sf_dir), ai_block_expected=True)


_STOPPED = "(NOT accessible OR waf OR NOT robots_allowed OR x_robots OR meta)"


@query(
    f"""WITH {BOTS}, t AS (SELECT count(*) AS n, count(*) FILTER (WHERE indexable) AS now FROM bv), g AS (SELECT category, count(*) FILTER (WHERE {_STOPPED}) AS affected, count(*) FILTER (WHERE {_STOPPED} AND NOT indexable) AS gain FROM bv GROUP BY category)
SELECT category, affected, now + gain AS projected_indexable, gain AS delta_indexable, {pct_sql("now + gain", "n", 1)} AS projected_pct FROM g, t"""
)
def d31_allow_category(spark, sf_dir):
    return E.allow_category(verdicts(spark, sf_dir))


@query(
    f"""WITH {BOTS} SELECT code, severity, count(*) AS n FROM (SELECT 'unreachable' AS code, CASE WHEN category = 'AI' THEN 'info' ELSE 'critical' END AS severity FROM bv WHERE NOT accessible
 UNION ALL SELECT 'robots_disallow', CASE WHEN category = 'AI' THEN 'info' ELSE 'warning' END FROM bv WHERE NOT robots_allowed UNION ALL SELECT 'noindex', 'warning' FROM bv WHERE x_robots OR meta UNION ALL SELECT 'empty', 'warning' FROM bv WHERE accessible AND NOT has_content) GROUP BY 1, 2"""
)
def b31_bot_issues(spark, sf_dir):
    """Issues by rule; an expected policy lowers the severity."""
    from crawlframe.functions.rules import Rule, issues

    c = F.col
    expected = c("category") == "AI"
    rules = [
        Rule("unreachable", F.when(expected, "info").otherwise("critical"), 0, ~c("accessible")),
        Rule("robots_disallow", F.when(expected, "info").otherwise("warning"), 0, ~c("robots_allowed")),
        Rule("noindex", "warning", 0, c("x_robots") | c("meta")),
        Rule("empty", "warning", 0, c("accessible") & ~c("has_content")),
    ]
    return issues(verdicts(spark, sf_dir), rules, ["bot"]).groupBy("code", "severity").agg(F.count("*").alias("n"))


@query(
    f"""WITH {BOTS}, d AS (SELECT day, CAST(count(*) FILTER (WHERE indexable) AS BIGINT) AS indexable, count(*) AS n FROM bv GROUP BY day), p AS (SELECT *, indexable - lag(indexable) OVER (ORDER BY day) AS change FROM d)
SELECT day, 'low_indexable_rate' AS code FROM p WHERE CAST(indexable AS DOUBLE) / n < 0.7 UNION ALL SELECT day, 'indexable_drop_vs_previous' FROM p WHERE change <= -3"""
)
def d38_drift_alerts(spark, sf_dir):
    """Alerts on daily rates and on drops against the day before."""
    from pyspark.sql import Window

    from crawlframe.functions.rules import Rule, issues

    d = verdicts(spark, sf_dir).groupBy("day").agg(F.count_if("indexable").alias("indexable"), F.count("*").alias("n"))
    d = d.withColumn("change", F.col("indexable") - F.lag("indexable").over(Window.orderBy("day")))
    rules = [Rule("low_indexable_rate", "warning", 0, F.col("indexable") / F.col("n") < 0.7), Rule("indexable_drop_vs_previous", "critical", 0, F.col("change") <= -3)]
    return issues(d, rules, ["day"]).select("day", "code")


GATES = {"quality": 0.5, "clean": 0.9}


@query(f"WITH m AS (SELECT 'quality' AS metric, avg(CAST(quality AS DOUBLE)) AS value FROM labels UNION ALL SELECT 'clean', avg(1.0 - toxic) FROM labels), g(metric, least) AS (VALUES {', '.join(f'''('{k}', {v!r}::DOUBLE)''' for k, v in GATES.items())}) SELECT metric, {rnd_sql('value', 4)} AS value, CASE WHEN value >= least THEN 'pass' WHEN value >= least * 0.9 THEN 'warn' ELSE 'fail' END AS status FROM m JOIN g USING (metric)")
def d36_quality_gate(spark, sf_dir):
    """Shares of labels against thresholds."""
    m = table(spark, sf_dir, "labels").agg(F.avg("quality").alias("quality"), F.avg(1.0 - F.col("toxic")).alias("clean")).unpivot([], list(GATES), "metric", "value")
    g = m.join(F.broadcast(spark.createDataFrame(list(GATES.items()), "metric string, least double")), "metric")
    return g.select("metric", rnd(F.col("value"), 4).alias("value"), F.when(F.col("value") >= F.col("least"), "pass").when(F.col("value") >= F.col("least") * 0.9, "warn").otherwise("fail").alias("status"))


@query(
    f"""SELECT d.lang, count(*) AS cases, count(quality) AS applicable, {rnd_sql("avg(CASE WHEN quality IS NOT NULL THEN CAST((n_chars >= 500) = (quality = 1) AS INTEGER) END)", 4)} AS pass_rate FROM documents d LEFT JOIN labels USING (doc_id) GROUP BY d.lang"""
)
def c25_case_evaluation(spark, sf_dir):
    """Expected against computed quality, over the documents that have a label."""
    j = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    hit = F.when(F.col("quality").isNotNull(), ((F.col("n_chars") >= 500) == (F.col("quality") == 1)).cast("int"))
    return j.groupBy("lang").agg(F.count("*").alias("cases"), F.count("quality").alias("applicable"), rnd(F.avg(hit), 4).alias("pass_rate"))
