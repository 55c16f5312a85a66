"""Queries over sites as a whole, projected scores and bots' snapshots as sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlframe.functions.common import rnd_sql as R
from crawlframe.operators import site_audit as A
from crawlframe.plans.registry import columns_of, query, table

# Columns of a crawled site from the page table, the same in both engines; ten sites.
_PAGE = """page_id, CAST(page_id % 10 AS {S}) AS site, url, CASE page_id % 6 WHEN 0 THEN '' WHEN 1 THEN 'One title' ELSE concat('Title ', CAST(page_id % 37 AS {S})) END AS title, CASE page_id % 4 WHEN 0 THEN 'Same words' WHEN 1 THEN NULL ELSE concat('About ', CAST(page_id AS {S})) END AS description,
 CASE WHEN page_id % 23 = 0 THEN NULL WHEN page_id % 8 = 3 THEN 404 ELSE 200 END AS status, page_id % 7 AS depth, page_id < 20 AS home, url LIKE 'https:%' AS https, page_id % 3 = 0 AS hsts, page_id % 4 = 0 AS csp, page_id % 5 = 0 AS xfo, CASE WHEN page_id % 6 > 0 THEN page_id % 2 = 0 END AS referrer_policy, page_id % 9 = 0 AS permissions_policy, page_id % 11 - 5 AS mixed"""
_LINK = "o_custkey % 200 AS page_id, concat('/t/', CAST(o_orderkey % 90 AS {S})) AS target, CASE o_orderkey % 12 WHEN 0 THEN 404 WHEN 1 THEN NULL WHEN 2 THEN 301 ELSE 200 END AS status"
_IMAGE = "CAST(p_partkey % 10 AS {S}) AS site, concat('/i/', CAST(p_partkey % 70 AS {S})) AS src, p_partkey % 70 * (CASE p_partkey % 10 WHEN 3 THEN 20000 WHEN 4 THEN 9000 ELSE 900 END) AS bytes, CASE p_partkey % 70 % 5 WHEN 0 THEN 'webp' WHEN 1 THEN CASE WHEN p_partkey % 10 < 4 THEN 'avif' ELSE 'png' END WHEN 2 THEN CASE WHEN p_partkey % 10 < 4 THEN 'svg' ELSE 'jpeg' END ELSE 'jpeg' END AS format"


def _rows(spark, sf_dir, name: str, columns: str) -> DataFrame:
    return table(spark, sf_dir, name).selectExpr(*columns_of(columns.format(S="STRING")))


_CODES = "CASE code " + " ".join(f"WHEN '{c}' THEN '{s}'" for c, s in A.SITE_CODES.items()) + " END"


@query(
    f"""WITH pg AS (SELECT {_PAGE.format(S="VARCHAR")} FROM pages), lk AS (SELECT {_LINK.format(S="VARCHAR")} FROM orders), im AS (SELECT DISTINCT {_IMAGE.format(S="VARCHAR")} FROM part),
t AS (SELECT site, title, count(*) AS n FROM pg WHERE title <> '' GROUP BY 1, 2), d AS (SELECT site, description, count(*) AS n FROM pg WHERE description <> '' GROUP BY 1, 2),
hp AS (SELECT * FROM pg WHERE home QUALIFY row_number() OVER (PARTITION BY site ORDER BY page_id) = 1),
sz AS (SELECT site, count(*) AS n, count(*) FILTER (format IN ('webp', 'avif', 'svg')) AS modern, count(*) FILTER (bytes > 512000) AS large, count(*) FILTER (bytes > 1048576) AS very_large FROM im GROUP BY 1),
x AS (SELECT page_id, 'duplicate_title' AS code, CAST(n AS VARCHAR) AS details FROM pg JOIN t USING (site, title) WHERE n > 1 UNION ALL SELECT page_id, 'duplicate_meta_description', CAST(n AS VARCHAR) FROM pg JOIN d USING (site, description) WHERE n > 1
UNION ALL SELECT page_id, 'deep_click_depth', CAST(depth AS VARCHAR) FROM pg WHERE depth > 3 UNION ALL SELECT page_id, 'broken_links_on_page', CAST(count(DISTINCT target) AS VARCHAR) FROM lk WHERE status >= 400 OR status IS NULL GROUP BY 1 UNION ALL SELECT page_id, 'request_failed', '' FROM pg WHERE status IS NULL
UNION ALL SELECT page_id, 'security_missing_csp', '' FROM hp WHERE csp IS DISTINCT FROM TRUE UNION ALL SELECT page_id, 'security_missing_xfo', '' FROM hp WHERE xfo IS DISTINCT FROM TRUE UNION ALL SELECT page_id, 'security_missing_referrer_policy', '' FROM hp WHERE referrer_policy IS DISTINCT FROM TRUE
UNION ALL SELECT page_id, 'security_missing_permissions_policy', '' FROM hp WHERE permissions_policy IS DISTINCT FROM TRUE UNION ALL SELECT page_id, 'security_missing_hsts', '' FROM hp WHERE https AND hsts IS DISTINCT FROM TRUE UNION ALL SELECT page_id, 'security_mixed_content_homepage', '' FROM hp WHERE mixed > 0
UNION ALL SELECT page_id, 'low_modern_image_formats_site', modern || '/' || n FROM sz JOIN hp USING (site) WHERE {R("modern / n::DOUBLE * 100.0::DOUBLE", 1)} < 50 UNION ALL SELECT page_id, 'very_large_images', CAST(very_large AS VARCHAR) FROM sz JOIN hp USING (site) WHERE very_large > 0 UNION ALL SELECT page_id, 'large_images', CAST(large AS VARCHAR) FROM sz JOIN hp USING (site) WHERE very_large = 0 AND large > 0)
SELECT page_id, code, {_CODES} AS severity, details FROM x"""
)
def b29_site_codes(spark, sf_dir):
    """All codes that need other rows of a site: repeats, depth, broken links, images, headers of the home page."""
    pages = _rows(spark, sf_dir, "pages", _PAGE)
    return A.site_issues(pages, _rows(spark, sf_dir, "orders", _LINK), _rows(spark, sf_dir, "part", _IMAGE))


_SCORED = "page_id, CAST(page_id % 101 AS DOUBLE) AS score, page_id * 7 % 100 AS schema, page_id % 3 AS author, page_id % 80 AS trust"


@query(
    f"""WITH p AS (SELECT {_SCORED} FROM pages), s1 AS (SELECT *, CASE WHEN schema < 50 THEN greatest(score, least(100.0::DOUBLE, score + 12)) ELSE score END AS a1 FROM p), s2 AS (SELECT *, CASE WHEN author = 0 THEN greatest(a1, least(100.0::DOUBLE, a1 + 8)) ELSE a1 END AS a2 FROM s1), s3 AS (SELECT *, CASE WHEN trust < 50 THEN greatest(a2, least(100.0::DOUBLE, a2 + 5)) ELSE a2 END AS a3 FROM s2),
r AS (SELECT page_id, 1 AS o, 'schema_coverage' AS label, score AS before, a1 AS after FROM s3 WHERE schema < 50 UNION ALL SELECT page_id, 2, 'author_and_date', a1, a2 FROM s3 WHERE author = 0 UNION ALL SELECT page_id, 3, 'trust_signals', a2, a3 FROM s3 WHERE trust < 50 UNION ALL SELECT page_id, NULL, 'none', score, score FROM s3 WHERE schema >= 50 AND author <> 0 AND trust >= 50)
SELECT page_id, CAST(CASE WHEN o IS NULL THEN 0 ELSE row_number() OVER (PARTITION BY page_id ORDER BY o) END AS INTEGER) AS step, label, {R("before", 2)} AS before, {R("after", 2)} AS after, {R("after - before", 2)} AS gained FROM r"""
)
def h28_projected_waterfall(spark, sf_dir):
    """What a page could win step by step, each step with what those before it left."""
    return A.waterfall(table(spark, sf_dir, "pages").selectExpr(*columns_of(_SCORED)), "score")




@query(
    f"""WITH l AS (SELECT doc_id, line, min(i) AS i FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents) WHERE trim(line) <> '' GROUP BY 1, 2),
n AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS at_, count(*) OVER (PARTITION BY doc_id) AS n FROM l),
g AS (SELECT doc_id, 'gptbot' AS bot, line, n, at_, CASE WHEN at_ % 5 <> 3 THEN at_ + CASE at_ WHEN 0 THEN 1.5 ELSE 0 END END AS o FROM n UNION ALL SELECT doc_id, 'googlebot', line, n, at_, (at_ + 1) % n FROM n),
k AS (SELECT doc_id, bot, any_value(n) AS n, count(o) AS both_, list(at_ ORDER BY o) FILTER (o IS NOT NULL) AS p FROM g GROUP BY 1, 2),
z AS (SELECT *, list_max(list_transform(list_reduce(list_transform(p, lambda v: CAST(v AS BIGINT)), lambda acc, v: list_append(acc, {{'v': v, 'l': 1 + coalesce(list_max(list_transform(list_filter(acc, lambda w: w.v < v), lambda w: w.l)), 0)}}), [{{'v': CAST(-1 AS BIGINT), 'l': CAST(0 AS BIGINT)}}]), lambda w: w.l)) AS rising FROM k)
SELECT d.doc_id AS page_id, 'heading' AS kind, b.bot, coalesce(n, 0) AS seen, coalesce(both_, 0) + CASE WHEN b.bot = 'gptbot' THEN 1 ELSE 0 END AS got, coalesce(n - both_, 0) AS missing, CASE WHEN b.bot = 'gptbot' THEN 1 ELSE 0 END AS added, coalesce(both_ - rising, 0) AS moved
FROM documents d CROSS JOIN (VALUES ('gptbot'), ('googlebot')) AS b(bot) LEFT JOIN z ON z.doc_id = d.doc_id AND z.bot = b.bot"""
)
def c28_aligned_snapshots(spark, sf_dir):
    """Headings that two bots got against a browser's, in order: missing, added and moved ones."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), F.array_distinct(F.filter(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda x: F.trim(x) != "")).alias("seen"))
    placed = F.transform("seen", lambda x, i: F.struct(F.when(i == 0, 1.5).otherwise(i).alias("o"), x.alias("x"), i.alias("i")))
    gpt = F.concat(F.transform(F.array_sort(F.filter(placed, lambda p: p["i"] % 5 != 3)), lambda p: p["x"]), F.array(F.lit("Only a bot sees this")))
    google = F.when(F.size("seen") > 1, F.concat(F.slice("seen", F.size("seen"), 1), F.slice("seen", F.lit(1), F.greatest(F.lit(0), F.size("seen") - 1)))).otherwise(F.col("seen"))
    both = F.explode(F.array(F.struct(F.lit("gptbot").alias("bot"), gpt.alias("got")), F.struct(F.lit("googlebot").alias("bot"), google.alias("got"))))
    return A.aligned_lists(d.select("page_id", F.lit("heading").alias("kind"), "seen", both.alias("b")).select("page_id", "kind", "b.bot", "seen", "b.got"))
