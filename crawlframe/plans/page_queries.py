"""Queries over pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crawlframe.functions import urls as U
from crawlframe.functions.common import over_the_cluster, pct, pct_sql, rnd, rnd_sql, top_k
from crawlframe.functions.text import all_of
from crawlframe.operators import html as H
from crawlframe.plans.registry import query, table


def pages(spark, sf_dir) -> DataFrame:
    return over_the_cluster(table(spark, sf_dir, "pages"))


_HEAD = "regexp_extract(w, '^([^/]*//[^/?]*)', 1)"
_NORMAL = f"(SELECT *, regexp_replace(lower({_HEAD}) || substr(w, length({_HEAD}) + 1), '/$', '') AS u FROM (SELECT *, regexp_replace(trim(url), '#.*$', '') AS w FROM pages))"


@query(f"SELECT page_id, u AS normalised FROM {_NORMAL}")
def b1_normalised_url(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", U.normalised(F.col("url")).alias("normalised"))


@query("SELECT page_id, url, length(html) AS html_chars, md5(html) AS digest FROM pages")
def a4_page_scan(spark, sf_dir):
    """One record per crawled page."""
    return pages(spark, sf_dir).select("page_id", "url", F.length("html").cast("long").alias("html_chars"), F.md5("html").alias("digest"))


_A = """la AS (SELECT page_id, url, unnest(regexp_extract_all(html, '(?is)<a\\s[^>]*>[^<]*</a>')) AS a, generate_subscripts(regexp_extract_all(html, '(?is)<a\\s[^>]*>[^<]*</a>'), 1) - 1 AS pos FROM pages),
lb AS (SELECT page_id, url, pos, regexp_extract(a, '(?i)href="([^"]*)"', 1) AS href, trim(regexp_extract(a, '(?s)>([^<]*)<', 1)) AS anchor, regexp_matches(a, '(?i)rel="[^"]*nofollow') AS nofollow, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS base FROM la),
lc AS (SELECT *, CASE WHEN regexp_matches(href, '^[a-z]+://') THEN href WHEN starts_with(href, '/') THEN base || href ELSE base || '/' || href END AS target FROM lb),
ln AS (SELECT page_id, CAST(pos AS INTEGER) AS pos, href, target, anchor, nofollow, lower(regexp_extract(target, '//([^/?#:]*)', 1)) = lower(regexp_extract(url, '//([^/?#:]*)', 1)) AS internal, lower(anchor) IN ('click here', 'here', 'read more', 'more', 'link') AS weak FROM lc)"""


@query(f"WITH {_A} SELECT * FROM ln")
def b2_page_links(spark, sf_dir):
    """Links of each page, resolved and classified."""
    return H.links(pages(spark, sf_dir))


@query("SELECT page_id, CAST(len(regexp_extract_all(regexp_replace(html, '(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->', ' ', 'g'), '(?i)<a[ >]')) AS BIGINT) AS links, CAST(len(regexp_extract_all(html, '(?i)<h1[ >]')) AS BIGINT) AS h1, CAST(len(regexp_extract_all(regexp_replace(html, '(?is)<script.*?</script>', ' ', 'g'), '(?i)<p[ >]')) AS BIGINT) AS paragraphs FROM pages")
def u2_element_counts(spark, sf_dir):
    """Elements from the tokenizer, counted per page."""
    el = H.elements(pages(spark, sf_dir))
    g = el.groupBy("page_id").agg(F.count_if(F.col("tag") == "a").alias("links"), F.count_if(F.col("tag") == "h1").alias("h1"), F.count_if(F.col("tag") == "p").alias("paragraphs"))
    return pages(spark, sf_dir).select("page_id").join(g, "page_id", "left").fillna(0)


_HEADS = "hd AS (SELECT page_id, unnest(regexp_extract_all(h, '(?is)<h[1-6][ >][^<]*')) AS t, generate_subscripts(regexp_extract_all(h, '(?is)<h[1-6][ >][^<]*'), 1) AS pos FROM (SELECT page_id, regexp_replace(html, '(?is)<script.*?</script>|<!--.*?-->', ' ', 'g') AS h FROM pages))"


@query(
    f"""WITH {_HEADS}, l AS (SELECT page_id, pos, CAST(regexp_extract(t, '(?i)<h([1-6])', 1) AS INTEGER) AS level, lower(regexp_extract(t, '(?s)>(.*)', 1)) AS text FROM hd), k AS (SELECT *, level - lag(level) OVER (PARTITION BY page_id ORDER BY pos) > 1 AS skip FROM l)
SELECT page_id, count(*) AS headings, min_by(level, pos) AS first_level, count(*) FILTER (WHERE skip) AS level_skips, count(text) - count(DISTINCT text) AS repeated_texts FROM k GROUP BY page_id"""
)
def e3_heading_outline(spark, sf_dir):
    """First level, skipped levels and repeated headings, from the element table."""
    return H.heading_outline(H.elements(pages(spark, sf_dir)))


_TITLE = "trim(regexp_extract(html, '(?is)<title>(.*?)</title>', 1))"
_TEXT = r"trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))"


@query(
    rf"""SELECT page_id, {_TITLE} AS title, length({_TITLE}) AS title_len, regexp_matches(html, '(?i)<meta[^>]+charset') AS charset, regexp_matches(html, '(?i)<meta[^>]+name="viewport"') AS viewport,
 regexp_matches(html, '(?i)<meta[^>]+name="description"') AS description, regexp_extract(html, '(?i)<html[^>]+lang="([^"]*)"', 1) AS lang FROM pages"""
)
def h17_head_metadata(spark, sf_dir):
    h = F.col("html")
    return pages(spark, sf_dir).select("page_id", H.title(h).alias("title"), F.length(H.title(h)).cast("long").alias("title_len"), h.rlike("(?i)<meta[^>]+charset").alias("charset"), h.rlike('(?i)<meta[^>]+name="viewport"').alias("viewport"), h.rlike('(?i)<meta[^>]+name="description"').alias("description"), F.regexp_extract(h, '(?i)<html[^>]+lang="([^"]*)"', 1).alias("lang"))


_TAGS = ["h1", "h2", "h3", "ul", "table", "nav", "article", "footer", "script", "img"]


@query(f"SELECT page_id, {', '.join(f'''CAST(len(regexp_extract_all(html, '(?i)<{t}[ >]')) AS INTEGER) AS n_{t}''' for t in _TAGS)} FROM pages")
def h18_dom_counts(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", *[H.count_tag(F.col("html"), t).alias(f"n_{t}") for t in _TAGS])


@query(f"SELECT page_id, {rnd_sql(f'CAST(length({_TEXT}) AS DOUBLE) / greatest(1, length(html))', 4)} AS text_html_ratio, CAST(len(list_filter(string_split({_TEXT}, ' '), lambda x: x <> '')) AS INTEGER) AS words FROM pages")
def h27_text_ratio(spark, sf_dir):
    """Share of visible text in a page."""
    t = H.visible_text(F.col("html"))
    return pages(spark, sf_dir).select("page_id", rnd(F.length(t).cast("double") / F.greatest(F.lit(1), F.length("html")), 4).alias("text_html_ratio"), F.size(F.filter(F.split(t, " "), lambda x: x != "")).alias("words"))


_PATH = "regexp_extract(url, '//[^/?#]*([^?#]*)', 1)"
_PARAMS = "len(list_filter(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'), lambda x: x <> ''))"
_DEPTH = f"len(list_filter(string_split({_PATH}, '/'), lambda x: x <> ''))"


@query(f"SELECT page_id, CAST(params AS INTEGER) AS params, CAST(depth AS INTEGER) AS depth, CASE WHEN params >= 3 OR depth >= 5 THEN 'high' WHEN params >= 1 OR depth >= 3 THEN 'medium' ELSE 'low' END AS risk FROM (SELECT page_id, {_PARAMS} AS params, {_DEPTH} AS depth FROM pages)")
def b20_crawl_budget(spark, sf_dir):
    """Risk for the crawl budget from parameters and depth of a URL."""
    n = lambda x, sep: F.size(F.filter(F.split(x, sep), lambda p: p != ""))
    d = pages(spark, sf_dir).select("page_id", n(U.query_string(F.col("url")), "&").alias("params"), n(U.path(F.col("url")), "/").alias("depth"))
    return d.withColumn("risk", F.when((F.col("params") >= 3) | (F.col("depth") >= 5), "high").when((F.col("params") >= 1) | (F.col("depth") >= 3), "medium").otherwise("low"))


# Words of page types and of legal notices.
_TYPES = [("product", ("product", "shop", "catalog", "товар")), ("article", ("blog", "news", "article", "post", "статья", "новост")), ("category", ("category", "catalog", "collection", "категор")), ("service", ("contact", "about", "company", "контакт", "о-компании"))]
_LEGAL = ("privacy policy", "terms", "cookie", "политика", "условия", "согласие")


def _any(x: str, words) -> str:
    return "(" + " OR ".join(f"contains({x}, '{w}')" for w in words) + ")"


@query(
    f"""SELECT page_id, CASE WHEN p = '' THEN 'home' WHEN {_any("p", _TYPES[0][1])} THEN 'product' WHEN {_any("p", _TYPES[1][1])} THEN 'article' WHEN {_any("p", _TYPES[2][1])} THEN 'category'
 WHEN {_any("t", _LEGAL)} THEN 'legal' WHEN {_any("p", _TYPES[3][1])} THEN 'service' ELSE 'other' END AS page_type FROM (SELECT page_id, trim(lower({_PATH}), '/') AS p, lower({_TITLE} || ' ' || {_TEXT}) AS t FROM pages)"""
)
def b18_page_type(spark, sf_dir):
    """Page type by words of the path and of the text."""
    d = pages(spark, sf_dir).select("page_id", F.regexp_replace(F.lower(U.path(F.col("url"))), "^/+|/+$", "").alias("p"), F.lower(F.concat_ws(" ", H.title(F.col("html")), H.visible_text(F.col("html")))).alias("t"))
    has = lambda c, words: F.coalesce(*[F.when(F.col(c).contains(w), True) for w in words], F.lit(False))
    kind = F.when(F.col("p") == "", "home")
    for name, words in _TYPES[:3]:
        kind = kind.when(has("p", words), name)
    return d.select("page_id", kind.when(has("t", _LEGAL), "legal").when(has("p", _TYPES[3][1]), "service").otherwise("other").alias("page_type"))


@query(f"SELECT page_id, count(*) OVER (PARTITION BY lower(t)) > 1 AS duplicate_title, count(*) OVER (PARTITION BY lower(t)) AS same FROM (SELECT page_id, {_TITLE} AS t FROM pages) WHERE t <> ''")
def c15_duplicate_titles(spark, sf_dir):
    d = pages(spark, sf_dir).select("page_id", H.title(F.col("html")).alias("t")).where("t <> ''")
    n = F.count("*").over(Window.partitionBy(F.lower("t")))
    return d.select("page_id", (n > 1).alias("duplicate_title"), n.alias("same"))


@query(f"SELECT lower(t) AS title, count(*) AS pages, min(page_id) AS first_page FROM (SELECT page_id, {_TITLE} AS t FROM pages) WHERE t <> '' GROUP BY 1 HAVING count(*) > 1")
def d22_title_groups(spark, sf_dir):
    d = pages(spark, sf_dir).select("page_id", F.lower(H.title(F.col("html"))).alias("title")).where("title <> ''")
    return d.groupBy("title").agg(F.count("*").alias("pages"), F.min("page_id").alias("first_page")).where("pages > 1")


_TECH = {"inline_script": "<script>", "inline_style": "<style>", "charset": "charset=", "article": "<article", "tracking": "track("}


@query(" UNION ALL ".join(f"SELECT '{k}' AS technology, count(*) FILTER (WHERE contains(html, '{v}')) AS pages, {pct_sql(f'''count(*) FILTER (WHERE contains(html, '{v}'))''', 'count(*)')} AS pct FROM pages" for k, v in _TECH.items()))
def d34_technologies(spark, sf_dir):
    """Pages that hold the mark of a technology."""
    p = pages(spark, sf_dir).agg(F.count("*").alias("n"), *[F.count_if(F.contains("html", F.lit(v))).alias(k) for k, v in _TECH.items()])
    return p.unpivot(["n"], list(_TECH), "technology", "pages").select("technology", "pages", pct(F.col("pages"), F.col("n")).alias("pct"))


@query(
    f"""WITH k AS (SELECT DISTINCT lower(string_split(p_name, ' ')[1]) AS kw FROM part), t AS (SELECT page_id, lower({_TITLE}) AS title, lower({_TEXT}) AS text FROM pages),
w AS (SELECT page_id, title, unnest(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+')) AS x, len(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+')) AS n FROM t)
SELECT page_id, x AS keyword, count(*) AS occurrences, {rnd_sql("CAST(count(*) AS DOUBLE) / any_value(n) * 100.0", 4)} AS density, bool_or(contains(title, x)) AS in_title FROM w JOIN k ON x = kw GROUP BY 1, 2"""
)
def h10_keyword_audit(spark, sf_dir):
    """Given keywords in pages: occurrences, density, presence in the title."""
    kw = table(spark, sf_dir, "part").select(F.lower(F.split("p_name", " ").getItem(0)).alias("keyword")).distinct()
    w = all_of(F.col("text"), r"[\p{L}\p{N}_]+")
    d = pages(spark, sf_dir).select("page_id", F.lower(H.title(F.col("html"))).alias("title"), F.lower(H.visible_text(F.col("html"))).alias("text"))
    d = d.select("page_id", "title", w.alias("w")).select("page_id", "title", F.size("w").alias("n"), F.explode("w").alias("keyword"))
    return d.join(kw, "keyword").groupBy("page_id", "keyword").agg(F.count("*").alias("occurrences"), rnd(F.count("*") / F.first("n") * 100.0, 4).alias("density"), F.bool_or(F.contains("title", F.col("keyword"))).alias("in_title"))


# The raw page lacks its article's first paragraphs and some of its head; the rendered one is the page.
_RAW = """regexp_replace(CASE WHEN page_id % 3 = 0 THEN regexp_replace(html, '(?is)<title>.*?</title>', '<title>Loading</title>') WHEN page_id % 3 = 1 THEN regexp_replace(html, '(?is)<h1.*?</h1>', '') ELSE html END, '(?is)<nav>.*?</nav>', '')"""
_SIDE = """length({t}) AS n, list_sort(list_distinct(regexp_extract_all({h}, '(?i)href="([^"]*)"', 1))) AS l, list_distinct(list_transform(regexp_extract_all({h}, '(?is)<h[1-6](?:\\s[^>]*)?>([^<]*)', 1), lambda x: trim(x))) AS hd, trim(regexp_extract({h}, '(?is)<title>(.*?)</title>', 1)) AS title, regexp_extract({h}, '(?i)<meta[^>]*charset="?([^">]*)', 1) AS charset"""


@query(
    f"""WITH a AS (SELECT page_id, {_SIDE.format(t=_TEXT, h="html")} FROM (SELECT page_id, {_RAW} AS html FROM pages)), b AS (SELECT page_id, {_SIDE.format(t=_TEXT, h="html")} FROM pages),
j AS (SELECT a.page_id, a.n AS raw_chars, b.n AS rendered_chars, len(list_filter(b.l, lambda x: NOT list_contains(a.l, x))) AS links_added, len(list_filter(a.l, lambda x: NOT list_contains(b.l, x))) AS links_removed, len(list_filter(b.hd, lambda x: NOT list_contains(a.hd, x))) AS headings_added, len(list_filter(a.hd, lambda x: NOT list_contains(b.hd, x))) AS headings_removed,
 CAST(a.title <> '' AND b.title = a.title AS INTEGER) + CAST(a.charset <> '' AND b.charset = a.charset AS INTEGER) AS meta_same, CAST(a.title <> '' AND b.title <> '' AND b.title <> a.title AS INTEGER) + CAST(a.charset <> '' AND b.charset <> '' AND b.charset <> a.charset AS INTEGER) AS meta_changed,
 CAST(a.title <> '' AND b.title = '' AS INTEGER) + CAST(a.charset <> '' AND b.charset = '' AS INTEGER) AS meta_raw_only, CAST(b.title <> '' AND a.title = '' AS INTEGER) + CAST(b.charset <> '' AND a.charset = '' AS INTEGER) AS meta_rendered_only, len(b.l) AS nl, len(b.hd) AS nh FROM a JOIN b USING (page_id))
SELECT page_id, CAST(raw_chars AS INTEGER) AS raw_chars, CAST(rendered_chars AS INTEGER) AS rendered_chars, CAST(links_added AS INTEGER) AS links_added, CAST(links_removed AS INTEGER) AS links_removed, CAST(headings_added AS INTEGER) AS headings_added, CAST(headings_removed AS INTEGER) AS headings_removed, meta_same, meta_changed, meta_raw_only, meta_rendered_only,
 floor(least(1e0, raw_chars / greatest(1, rendered_chars)) * 10000e0 + 0.5e0) / 10000e0 AS coverage,
 floor((100e0 - (greatest(0, rendered_chars - raw_chars) / greatest(1, rendered_chars) * 40e0 + links_added / greatest(1, nl) * 25e0 + headings_added / greatest(1, nh) * 20e0 + (meta_changed + meta_rendered_only) / greatest(1, meta_same + meta_changed + meta_raw_only + meta_rendered_only) * 15e0)) * 10e0 + 0.5e0) / 10e0 AS score FROM j"""
)
def c13_snapshot_diff(spark, sf_dir):
    """Pages without navigation and parts of their heads against pages as they are."""
    h = F.col("html")

    def side(p):
        meta = F.create_map(F.lit("title"), H.title(h), F.lit("charset"), F.regexp_extract(h, '(?i)<meta[^>]*charset="?([^">]*)', 1))
        headings = F.array_distinct(F.transform(F.regexp_extract_all(h, F.lit(r"(?is)<h[1-6](?:\s[^>]*)?>([^<]*)"), F.lit(1)), lambda x: F.trim(x)))
        return p.select("page_id", H.visible_text(h).alias("text"), F.array_distinct(F.regexp_extract_all(h, F.lit('(?i)href="([^"]*)"'), F.lit(1))).alias("hrefs"), headings.alias("headings"), meta.alias("meta"))

    full = pages(spark, sf_dir)
    return H.snapshot_diff(side(full.withColumn("html", F.expr(_RAW))), side(full))


@query("SELECT host, CAST(position AS INTEGER) AS position, page_id FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY page_id) AS position FROM (SELECT page_id, lower(regexp_extract(url, '//([^/?#:]*)', 1)) AS host FROM pages)) WHERE position = 1")
def g2_ordered_distinct(spark, sf_dir):
    """The first page of each host, in order."""
    d = pages(spark, sf_dir).select("page_id", U.host(F.col("url")).alias("host"))
    return top_k(d, ["host"], [F.asc("page_id")], 1).select("host", F.col("rank").alias("position"), "page_id")


@query("WITH n AS (SELECT url, page_id, row_number() OVER (ORDER BY url, page_id) AS r, count(*) OVER () AS n FROM pages), w AS (SELECT DISTINCT CAST(floor(i * (n - 1) / 9.0 + 0.5) AS BIGINT) + 1 AS r FROM n, range(10) t(i)) SELECT page_id, url FROM n WHERE r IN (SELECT r FROM w)")
def f2_spread_sample(spark, sf_dir):
    """Ten URLs spread evenly over the sorted list: a sampling report."""
    from crawlframe.operators.sampling import spread

    return spread(pages(spark, sf_dir).select("page_id", "url"), ["url", "page_id"], 10)


@query(r"""SELECT page_id, regexp_matches(lower(html), 'cookie (wall|consent|policy)') AS cookie_wall, regexp_matches(lower(html), 'subscribe to (read|continue)|paywall') AS paywall, regexp_matches(lower(html), 'type="password"') AS login_wall, CASE WHEN starts_with(url, 'https') THEN CAST(len(regexp_extract_all(html, '(?i)(?:src|href)\s*=\s*"http://')) AS INTEGER) ELSE 0 END AS mixed_content FROM pages""")
def b28_resource_barriers(spark, sf_dir):
    """Walls in front of the content, and insecure resources of secure pages."""
    low = F.lower("html")
    mixed = F.when(F.col("url").startswith("https"), F.size(all_of(F.col("html"), r'(?i)(?:src|href)\s*=\s*"http://'))).otherwise(0)
    return pages(spark, sf_dir).select("page_id", low.rlike("cookie (wall|consent|policy)").alias("cookie_wall"), low.rlike("subscribe to (read|continue)|paywall").alias("paywall"), low.rlike('type="password"').alias("login_wall"), mixed.alias("mixed_content"))


_FINAL = "regexp_replace(regexp_replace(lower(url), '^http://', 'https://'), '//www\\.', '//')"


@query(f"SELECT page_id, starts_with(url, 'http://') AS to_https, regexp_matches(lower(url), '//www\\.') AS drops_www, regexp_matches(url, '[?&](utm_[a-z]+|ref)=') AS tracking, regexp_matches({_PATH}, '/$') AND {_PATH} <> '/' AS slash, regexp_matches({_PATH}, '\\.html?$') AS legacy_extension, url <> {_FINAL} AS changes FROM pages")
def c23_url_policies(spark, sf_dir):
    """What a canonical address would change: scheme, www, tracking parameters, slash, extension."""
    url = F.col("url")
    final = F.regexp_replace(F.regexp_replace(F.lower(url), "^http://", "https://"), r"//www\.", "//")
    p = U.path(url)
    return pages(spark, sf_dir).select("page_id", url.startswith("http://").alias("to_https"), F.lower(url).rlike(r"//www\.").alias("drops_www"), url.rlike("[?&](utm_[a-z]+|ref)=").alias("tracking"), (p.rlike("/$") & (p != "/")).alias("slash"), p.rlike(r"\.html?$").alias("legacy_extension"), (url != final).alias("changes"))
