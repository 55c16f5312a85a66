"""Queries over robots rules and sitemaps derived from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlframe.operators import site_files as S
from crawlframe.plans.registry import columns_of, query, table

_TEXT = """concat('# rules of ', s_name, '
User-agent: *
Disallow: /private', s_suppkey % 5, '
', CASE s_suppkey % 3 WHEN 0 THEN 'Allow: /private0/open' WHEN 1 THEN 'Disallow: /tmp*.html$' ELSE 'Disallow: tmp' END, '
User-agent: Googlebot
User-agent: Bingbot
', CASE s_suppkey % 4 WHEN 0 THEN 'Disallow: /' WHEN 1 THEN 'Disallow:' WHEN 2 THEN 'Crawl-delay: 5' ELSE 'Disallow: /private1
Allow: /private1' END, '
noindex: /x
', CASE WHEN s_suppkey % 6 = 0 THEN 'no colon here' ELSE 'Sitemap: https://example.com/sitemap.xml' END)"""
ROBOTS = f"rb AS (SELECT 's' || s_suppkey || '.example.com' AS host, {_TEXT} AS text FROM supplier)"

_DIRECTIVES = f"""{ROBOTS}, r1 AS (SELECT host, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM rb), r2 AS (SELECT host, line, trim(raw) AS raw FROM r1 WHERE trim(raw) <> '' AND NOT starts_with(trim(raw), '#')),
r3 AS (SELECT host, line, CASE WHEN contains(raw, ':') THEN lower(trim(string_split(raw, ':')[1])) ELSE 'syntax_error' END AS key, CASE WHEN contains(raw, ':') THEN trim(substr(raw, position(':' IN raw) + 1)) ELSE raw END AS value FROM r2),
r4 AS (SELECT *, CAST(key = 'user-agent' AND coalesce(lag(key) OVER (PARTITION BY host ORDER BY line), '') <> 'user-agent' AS INTEGER) AS fresh FROM r3 WHERE key <> 'syntax_error'),
dr AS (SELECT host, CAST(line AS INTEGER) AS line, CAST(sum(fresh) OVER (PARTITION BY host ORDER BY line) AS BIGINT) AS group_id, key, value FROM r4 UNION ALL SELECT host, CAST(line AS INTEGER), NULL, key, value FROM r3 WHERE key = 'syntax_error')"""


def robots(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.expr("concat('s', s_suppkey, '.example.com')").alias("host"), F.expr(_TEXT).alias("text"))


def rules(spark, sf_dir) -> DataFrame:
    return S.directives(robots(spark, sf_dir))


@query(f"WITH {_DIRECTIVES} SELECT * FROM dr")
def a5_robots_directives(spark, sf_dir):
    """Directive rows with their groups."""
    return rules(spark, sf_dir)


BOTS = ["Googlebot", "Bingbot", "GPTBot"]
_BOTS = "bo(bot) AS (VALUES " + ", ".join(f"('{b}')" for b in BOTS) + ")"
_PATHS = "pt AS (SELECT DISTINCT 's' || l_suppkey || '.example.com' AS host, CASE l_partkey % 3 WHEN 0 THEN '/private' || (l_partkey % 6) || '/open' WHEN 1 THEN '/tmp' || (l_partkey % 9) || '.html' ELSE '/p/' || (l_partkey % 7) END AS path FROM lineitem)"
_RX = r"""'^' || replace(regexp_replace(value, '([.+?()\[\]{}^|\\])', '\\\1', 'g'), '*', '.*')"""
_ACCESS = f"""ag AS (SELECT host, group_id, bot, CASE WHEN value = '*' THEN 1 WHEN lower(value) = lower(bot) THEN 100 + length(value) WHEN contains(lower(bot), lower(value)) THEN 60 + length(value) WHEN contains(lower(value), lower(bot)) THEN 40 + length(bot) END AS score FROM dr, bo WHERE key = 'user-agent' AND value <> ''),
gr AS (SELECT host, bot, group_id FROM (SELECT *, row_number() OVER (PARTITION BY host, bot ORDER BY score DESC, group_id) AS r FROM ag WHERE score IS NOT NULL) WHERE r = 1),
ow AS (SELECT host, group_id, key, value, {_RX} AS rx, length(replace(value, '*', '')) AS n FROM dr WHERE key IN ('allow', 'disallow') AND value <> ''),
hi AS (SELECT pt.host, path, gr.bot, key, value, row_number() OVER (PARTITION BY pt.host, path, gr.bot ORDER BY n DESC, key = 'allow' DESC, value DESC) AS r FROM pt JOIN gr USING (host) JOIN ow ON ow.host = pt.host AND ow.group_id = gr.group_id WHERE regexp_matches(path, rx)),
ac AS (SELECT pt.host, pt.path, bo.bot, coalesce(hi.key, 'allow') = 'allow' AS allowed, coalesce(hi.key || ' ' || hi.value, '') AS rule FROM pt CROSS JOIN bo LEFT JOIN hi ON hi.host = pt.host AND hi.path = pt.path AND hi.bot = bo.bot AND hi.r = 1)"""


def paths(spark, sf_dir) -> DataFrame:
    path = F.expr("CASE l_partkey % 3 WHEN 0 THEN concat('/private', l_partkey % 6, '/open') WHEN 1 THEN concat('/tmp', l_partkey % 9, '.html') ELSE concat('/p/', l_partkey % 7) END")
    return table(spark, sf_dir, "lineitem").select(F.expr("concat('s', l_suppkey, '.example.com')").alias("host"), path.alias("path")).distinct()


def bots(spark) -> DataFrame:
    return spark.createDataFrame([(b,) for b in BOTS], "bot string")


@query(f"WITH {_DIRECTIVES}, {_BOTS}, {_PATHS}, {_ACCESS} SELECT * FROM ac")
def c12_robots_access(spark, sf_dir):
    """May each bot fetch each path of its host."""
    return S.access(rules(spark, sf_dir), bots(spark), paths(spark, sf_dir))


@query(f"WITH {_DIRECTIVES}, {_BOTS}, {_PATHS}, {_ACCESS} SELECT bot, count(*) AS paths, count(*) FILTER (WHERE allowed) AS allowed, count(DISTINCT host) FILTER (WHERE NOT allowed) AS hosts_that_block FROM ac GROUP BY bot")
def c24_bot_visibility(spark, sf_dir):
    """Visibility of the site per bot."""
    a = S.access(rules(spark, sf_dir), bots(spark), paths(spark, sf_dir))
    return a.groupBy("bot").agg(F.count("*").alias("paths"), F.count_if("allowed").alias("allowed"), F.count_distinct(F.when(~F.col("allowed"), F.col("host"))).alias("hosts_that_block"))


@query(
    f"""WITH {_DIRECTIVES}, ua AS (SELECT host, group_id, lower(value) AS agent FROM dr WHERE key = 'user-agent'), g AS (SELECT dr.host, agent, value AS path, count(*) FILTER (WHERE key = 'allow') AS allows, count(*) FILTER (WHERE key = 'disallow') AS disallows FROM dr JOIN ua ON ua.host = dr.host AND ua.group_id = dr.group_id WHERE key IN ('allow', 'disallow') GROUP BY 1, 2, 3)
SELECT *, CASE WHEN allows > 0 AND disallows > 0 THEN 'conflict' ELSE 'duplicate' END AS kind FROM g WHERE (allows > 0 AND disallows > 0) OR allows > 1 OR disallows > 1"""
)
def d33_robots_conflicts(spark, sf_dir):
    return S.conflicts(rules(spark, sf_dir))


@query(
    f"""WITH {_DIRECTIVES}, g AS (SELECT host, count(*) FILTER (WHERE key = 'disallow' AND value = '/') AS global_blocks, count(*) FILTER (WHERE key = 'crawl-delay') AS crawl_delays, count(*) FILTER (WHERE key IN ('noindex', 'nofollow', 'noarchive')) AS unsupported,
 count(*) FILTER (WHERE key = 'syntax_error') AS syntax_errors, count(*) FILTER (WHERE key = 'sitemap') AS sitemaps, count(*) FILTER (WHERE key IN ('allow', 'disallow') AND value <> '' AND NOT starts_with(value, '/')) AS bad_paths FROM dr GROUP BY host)
SELECT *, greatest(0, 100 - 30 * least(global_blocks, 1) - 5 * crawl_delays - 5 * unsupported - 10 * syntax_errors - CASE WHEN sitemaps = 0 THEN 10 ELSE 0 END - 5 * bad_paths) AS score FROM g"""
)
def b26_robots_lint(spark, sf_dir):
    return S.lint(rules(spark, sf_dir))


_URL = """concat('sitemap-', o_orderkey % 4, '.xml') AS file, o_orderkey AS pos, CASE WHEN o_orderkey % 97 = 0 THEN concat('ftp://example.com/', o_orderkey) ELSE concat('https://example.com/o/', o_orderkey % 9000) END AS loc,
 CASE o_orderkey % 7 WHEN 0 THEN '' WHEN 1 THEN 'yesterday' ELSE substring(CAST(CAST(o_orderdate AS DATE) AS STRING), 1, 10) END AS lastmod,
 CASE o_orderkey % 5 WHEN 0 THEN 'sometimes' ELSE 'weekly' END AS changefreq, CASE o_orderkey % 6 WHEN 0 THEN '1.5' WHEN 1 THEN 'high' ELSE '0.5' END AS priority"""
AS_OF = "1998-01-01"
_SITEMAP = f"sm AS (SELECT {_URL.replace('STRING', 'VARCHAR')} FROM orders)"


def sitemap_urls(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").withColumn("o_orderdate", F.to_date("o_orderdate")).selectExpr(*columns_of(_URL))


_CAPPED = " - ".join(["100.0", "least(40.0, invalid * 1.0::DOUBLE / urls * 100.0)", *(f"least(20.0, {x} * 1.0::DOUBLE / urls * 100.0 * 0.5)" for x in ("duplicates", "missing_lastmod", "bad_lastmod", "future", "bad_changefreq", "bad_priority"))])


@query(
    f"""WITH {_SITEMAP}, u AS (SELECT *, count(*) OVER (PARTITION BY loc) AS copies, TRY_CAST(substr(lastmod, 1, 10) AS DATE) AS day, TRY_CAST(priority AS DOUBLE) AS p FROM sm),
g AS (SELECT file, count(*) AS urls, count(*) FILTER (WHERE NOT regexp_matches(loc, '^https?://')) AS invalid, count(*) FILTER (WHERE copies > 1) AS duplicates, count(*) FILTER (WHERE coalesce(lastmod, '') = '') AS missing_lastmod, count(*) FILTER (WHERE lastmod <> '' AND day IS NULL) AS bad_lastmod,
 count(*) FILTER (WHERE day > DATE '{AS_OF}') AS future, count(*) FILTER (WHERE DATE '{AS_OF}' - day > 365) AS stale, count(*) FILTER (WHERE changefreq NOT IN ('always', 'hourly', 'daily', 'weekly', 'monthly', 'yearly', 'never')) AS bad_changefreq, count(*) FILTER (WHERE p IS NULL OR p < 0 OR p > 1) AS bad_priority FROM u GROUP BY file)
SELECT *, floor(({_CAPPED}) * 10.0 + 0.5) / 10.0 AS score FROM g"""
)
def d32_sitemap_quality(spark, sf_dir):
    return S.sitemap_quality(sitemap_urls(spark, sf_dir), F.lit(AS_OF).cast("date"))


@query(f"WITH {_SITEMAP} SELECT loc, min_by(file, struct_pack(f := file, p := pos)) AS first_file, count(*) - 1 AS later FROM sm GROUP BY loc HAVING count(*) > 1")
def e8_first_sitemap(spark, sf_dir):
    return S.first_file(sitemap_urls(spark, sf_dir))


@query(f"WITH {_SITEMAP} SELECT pos, loc, lastmod FROM sm")
def a6_sitemap_xml(spark, sf_dir):
    """URL elements parsed from XML, with every value kept as text."""
    from crawlframe.sources.readers import parse_sitemap_urls

    xml = F.concat(F.lit("<url><loc>"), "loc", F.lit("</loc><lastmod>"), "lastmod", F.lit("</lastmod></url>"))
    return parse_sitemap_urls(sitemap_urls(spark, sf_dir).select("pos", xml.alias("xml"))).select("pos", "loc", "lastmod")
