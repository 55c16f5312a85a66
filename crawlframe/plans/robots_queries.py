"""Queries over parameter rules and the visibility of pages to bots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlframe.functions.common import rnd_sql as R
from crawlframe.operators import site_files as S
from crawlframe.plans.registry import columns_of, query, table
from crawlframe.plans.site_queries import _ACCESS, _BOTS, _DIRECTIVES, bots, rules

_CLEAN_TEXT = """concat('User-agent: ', CASE s_suppkey % 3 WHEN 0 THEN 'Yandex' ELSE '*' END, '
Disallow: /search?q=
Disallow: /*sid=
Disallow: /a?b', '
', CASE WHEN s_suppkey % 5 = 4 THEN 'Allow: /' ELSE concat('Clean-param: ref&utm_source /catalog
Clean-param: sort&', 'p', s_suppkey % 7, '&sid /catalog/shoes/', s_suppkey % 2, '
Clean-param: utm_source&utm_medium
Clean-param: ref&size /catalog/shoes', s_suppkey % 4, '
Clean-param: a=b /bad
Clean-param: sid catalog
Clean-param: && /empty
Clean-param: ', CASE WHEN s_suppkey % 2 = 0 THEN 'sid /' ELSE 'sid&sort /catalog' END, '
Clean-param: ref&utm_source   /catalog
Clean-param: x /q?y') END)"""
_RULES = _DIRECTIVES.split(", r1 AS", 1)[1]
_CLEAN = f"rb AS (SELECT 's' || s_suppkey || '.example.com' AS host, {_CLEAN_TEXT} AS text FROM supplier), r1 AS{_RULES}"
_PARAMS = f"""{_CLEAN}, cq AS (SELECT host, line, trim(regexp_replace(value, '\\s+', ' ', 'g')) AS raw FROM dr WHERE key = 'clean-param'),
cp AS (SELECT host, line, raw, list_filter(string_split(string_split(raw, ' ')[1], '&'), lambda p: p <> '') AS params, CASE WHEN contains(raw, ' ') THEN substr(raw, position(' ' IN raw) + 1) ELSE '' END AS path FROM cq WHERE raw <> '')"""


def clean_rules(spark, sf_dir) -> DataFrame:
    text = table(spark, sf_dir, "supplier").select(F.expr("concat('s', s_suppkey, '.example.com')").alias("host"), F.expr(_CLEAN_TEXT).alias("text"))
    return S.directives(text)


_TRACKING = "['ysclid', 'yrclid', 'utm_source', 'utm_medium', 'utm_campaign', 'utm_term', 'utm_content', 'yclid', 'gclid', 'fbclid']"


@query(
    f"""WITH {_PARAMS}, ho AS (SELECT host, bool_or(key = 'clean-param') AS has, bool_or(key = 'user-agent' AND contains(lower(value), 'yandex')) AS yandex, count(*) FILTER (WHERE key = 'disallow' AND (contains(value, '?') OR contains(value, '='))) AS queries FROM dr GROUP BY 1)
SELECT host, line, 'too_long' AS code FROM cp WHERE length(raw) > 500 UNION ALL SELECT host, line, 'no_parameters' FROM cp WHERE len(params) = 0 UNION ALL SELECT host, line, 'invalid_parameter' FROM cp WHERE len(list_filter(params, lambda p: regexp_matches(p, '[?=/]'))) > 0
UNION ALL SELECT host, line, 'path_without_slash' FROM cp WHERE path <> '' AND path NOT LIKE '/%' UNION ALL SELECT host, line, 'path_with_query' FROM cp WHERE contains(path, '?') OR contains(path, '&')
UNION ALL SELECT host, line, 'tracking_only' FROM cp WHERE len(params) > 0 AND len(list_filter(params, lambda p: NOT list_contains({_TRACKING}, lower(p)))) = 0
UNION ALL SELECT host, min(line), 'duplicate' FROM cp GROUP BY host, raw HAVING count(*) > 1
UNION ALL SELECT host, 0, CASE WHEN has THEN 'no_yandex_group' ELSE 'parameters_disallowed' END FROM ho WHERE (has AND NOT yandex) OR (NOT has AND queries >= 3)"""
)
def d33_parameter_issues(spark, sf_dir):
    """What is wrong with the parameter rules of each host."""
    return S.clean_param_issues(clean_rules(spark, sf_dir))


@query(
    f"""WITH {_PARAMS}, pa AS (SELECT host, line, path, unnest(params) AS param, generate_subscripts(params, 1) - 1 AS at_ FROM cp),
ok AS (SELECT * FROM pa WHERE NOT regexp_matches(param, '[?=/]') AND (path = '' OR path LIKE '/%') AND NOT regexp_matches(path, '[?&]')),
up AS (SELECT a.host, a.line, a.at_, a.param, min_by(b.path, length(b.path)) AS path FROM ok a JOIN ok b ON b.host = a.host AND b.param = a.param AND starts_with(a.path, b.path) GROUP BY ALL),
pp AS (SELECT host, path, param, min(line * 1000 + at_) AS first FROM up GROUP BY ALL)
SELECT r.host, r.path, trim('Clean-param: ' || string_agg(param, '&' ORDER BY first) || ' ' || r.path) AS rule, any_value(lines) AS replaces FROM pp r JOIN (SELECT host, path, string_agg(CAST(line AS VARCHAR), ',' ORDER BY line) AS lines FROM (SELECT DISTINCT host, path, line FROM up) GROUP BY ALL) l ON l.host = r.host AND l.path = r.path GROUP BY r.host, r.path"""
)
def d33_merged_parameters(spark, sf_dir):
    """The fewest parameter rules that cover those of each host, with the lines that each replaces."""
    return S.merged_params(clean_rules(spark, sf_dir))


_VISITED = """page_id, concat('s', page_id % 40 + 1, '.example.com') AS host, CASE page_id % 3 WHEN 0 THEN concat('/private', page_id % 6, '/open') WHEN 1 THEN concat('/tmp', page_id % 9, '.html') ELSE concat('/p/', page_id % 7) END AS path,
 CASE page_id % 7 WHEN 0 THEN 'noindex, follow' WHEN 1 THEN 'NoSnippet' ELSE 'index' END AS robots, CAST(page_id % 101 AS DOUBLE) AS score, CAST(page_id % 10 AS DOUBLE) / 10.0 AS main_ratio, CAST(page_id % 13 AS DOUBLE) / 10.0 AS boilerplate,
 length(html) AS chars, CASE page_id % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS js_risk, CAST(page_id % 5 AS DOUBLE) / 4.0 AS coverage, length(html) + page_id % 11 * 40 AS browser_chars, CASE WHEN page_id % 6 <> 0 THEN length(html) - page_id % 8 * 90 END AS gpt_chars, CASE WHEN page_id % 5 <> 0 THEN length(html) END AS google_chars"""


@query(
    f"""WITH {_DIRECTIVES}, {_BOTS}, vi AS (SELECT {_VISITED.replace("CAST(page_id % 10 AS DOUBLE) / 10.0", "CAST(page_id % 10 AS DOUBLE) / 10.0::DOUBLE")} FROM pages), pt AS (SELECT DISTINCT host, path FROM vi), {_ACCESS},
x AS (SELECT vi.*, bot, allowed, greatest(0.0::DOUBLE, least(100.0::DOUBLE, score * 0.45::DOUBLE + main_ratio * 25.0::DOUBLE + (1.0::DOUBLE - least(1.0::DOUBLE, boilerplate)) * 15.0::DOUBLE + least(100.0::DOUBLE, chars / 18.0::DOUBLE) * 0.15::DOUBLE)) AS base, regexp_matches(lower(robots), 'noindex|none|nosnippet|max-snippet:0|noai|noimageai') AS restricted,
 greatest(0.05::DOUBLE, least(1.2::DOUBLE, CASE WHEN bot = 'GPTBot' THEN gpt_chars WHEN bot = 'Googlebot' THEN google_chars END / greatest(1, browser_chars, chars)::DOUBLE)) AS r0, CASE WHEN bot = 'GPTBot' THEN gpt_chars WHEN bot = 'Googlebot' THEN google_chars END AS own FROM vi JOIN ac USING (host, path)),
y AS (SELECT *, CASE WHEN own IS NOT NULL THEN r0 END AS ratio FROM x),
z AS (SELECT *, {R("greatest(0.0::DOUBLE, least(100.0::DOUBLE, CASE WHEN NOT allowed THEN 0.0::DOUBLE ELSE (base - (CASE WHEN restricted THEN 20 ELSE 0 END + CASE js_risk WHEN 'high' THEN 14 WHEN 'medium' THEN 7 ELSE 0 END)) * coalesce(ratio, CASE WHEN coverage > 0 THEN greatest(0.6::DOUBLE, least(1.05::DOUBLE, coverage + 0.2::DOUBLE)) END, 1.0::DOUBLE) END))", 2)} AS visibility FROM y)
SELECT page_id, bot, CASE WHEN NOT allowed THEN 'blocked' WHEN restricted THEN 'partial' ELSE 'allowed' END AS access, CASE WHEN NOT allowed THEN 'blocked' WHEN restricted THEN 'restricted' ELSE 'allowed' END AS directive_status, visibility,
 CASE WHEN allowed AND ratio IS NOT NULL THEN {R("greatest(0.0::DOUBLE, 1.0::DOUBLE - least(1.0::DOUBLE, ratio))", 4)} END AS delta, CASE WHEN visibility >= 75 THEN 'low' WHEN visibility >= 45 THEN 'medium' ELSE 'high' END AS risk FROM z"""
)
def c24_visibility_matrix(spark, sf_dir):
    """Each page and bot: access, status of its directives, visibility, and what the bot got less than a browser."""
    p = table(spark, sf_dir, "pages").selectExpr(*columns_of(_VISITED))
    allowed = S.access(rules(spark, sf_dir), bots(spark), p.select("host", "path").distinct())
    return S.visibility(p, allowed)
