"""Queries of address policies, redirects between hosts, robots details, and smaller reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlframe.functions import text as T
from crawlframe.functions import urls as U
from crawlframe.functions.common import pct, pct_sql, rnd, rnd_sql, top_k
from crawlframe.operators import events as E
from crawlframe.operators import graph as G
from crawlframe.operators import keywords as K
from crawlframe.operators import markup as M
from crawlframe.operators import page_audit as A
from crawlframe.operators import site_files as S
from crawlframe.operators.graph import cut
from crawlframe.plans import keyword_queries as KQ
from crawlframe.plans.audit_queries import SITE, site_pages
from crawlframe.plans.event_queries import _SITE, VITALS, sites
from crawlframe.plans.markup_queries import _IMAGES, RICH, rich_pages
from crawlframe.plans.registry import query, table
from crawlframe.plans.site_queries import _DIRECTIVES, _SITEMAP, rules, sitemap_urls
from crawlframe.plans.text_queries import _list, _words, docs

# --- redirects between hosts: an order's page moves to that of half its number, and some numbers live on another host

_PLACE = "concat(CASE WHEN {0} % 5 = 0 THEN 'https://www.b.example.org/o/' ELSE 'https://a.example.com/o/' END, {0})"
_HOPS = f"""hp AS (SELECT {_PLACE.format("o_orderkey")} AS "from", {_PLACE.format("o_orderkey // 2")} AS "to", 301 AS status, o_orderkey % 300 AS ms FROM orders WHERE o_orderkey > 0 AND o_orderkey % 2 = 0),
pg AS (SELECT {_PLACE.format("o_orderkey")} AS url, CASE WHEN o_orderkey % 11 = 0 THEN 410 ELSE 200 END AS code, CASE WHEN o_orderkey % 3 = 0 THEN 'Page Not Found' ELSE 'Order' END AS title FROM orders),
w(start, here, n, ms) AS (SELECT "from", "from", 0, 0 FROM hp UNION ALL SELECT start, "to", n + 1, w.ms + hp.ms FROM w JOIN hp ON hp."from" = w.here),
ch AS (SELECT start, here AS final, n AS hops, CAST(ms AS BIGINT) AS ms FROM w WHERE here NOT IN (SELECT "from" FROM hp))"""
_HOST = lambda u: f"regexp_replace(lower(regexp_extract({u}, '//([^/?#:]*)', 1)), '^.*?([^.]+\\.[^.]+)$', '\\1')"


def _hops(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders").where("o_orderkey > 0 AND o_orderkey % 2 = 0")
    return o.select(F.expr(_PLACE.format("o_orderkey")).alias("from"), F.expr(_PLACE.format("(o_orderkey div 2)")).alias("to"), F.lit(301).alias("status"), (F.col("o_orderkey") % 300).alias("ms"))


@query(
    f"""WITH RECURSIVE {_HOPS} SELECT start, final, {_HOST("start")} <> {_HOST("final")} AS cross_domain, coalesce(code = 200 AND regexp_matches(lower(title), 'not found|404|does not exist'), FALSE) AS soft_404, coalesce(code >= 400, FALSE) AS broken FROM ch LEFT JOIN pg ON url = final"""
)
def c22_redirect_ends(spark, sf_dir):
    """Where chains end: on another domain, at a page that says it is not there, or at an error."""
    pages = table(spark, sf_dir, "orders").select(F.expr(_PLACE.format("o_orderkey")).alias("url"), F.when(F.col("o_orderkey") % 11 == 0, 410).otherwise(200).alias("code"), F.when(F.col("o_orderkey") % 3 == 0, "Page Not Found").otherwise("Order").alias("title"))
    return G.redirect_ends(G.redirect_chains(_hops(spark, sf_dir).drop("ms")), pages)


@query(f"WITH RECURSIVE {_HOPS} SELECT start, hops, ms FROM ch")
def c26_hop_times(spark, sf_dir):
    """What all hops of a chain took together."""
    return G.hop_times(_hops(spark, sf_dir))


_P = "regexp_extract(url, '//[^/?#]*([^?#]*)', 1)"
_KEYS = "list_transform(list_filter(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'), lambda x: x <> ''), lambda x: string_split(x, '=')[1])"
_ALLOWED, _NEEDED = ["id", "page", "q"], ["id"]


@query(
    f"""SELECT page_id, regexp_matches({_P}, '[A-Z]') AS upper_case, regexp_matches({_P}, '/(index|default)\\.[a-z]+$') AS index_file, regexp_matches({_P}, '//') AS double_slash, array_to_string(list_sort(list_distinct(list_filter({_KEYS}, lambda x: x NOT IN {_list(_ALLOWED)}))), ',') AS extra_params,
 len({_KEYS}) > 0 AND NOT list_contains({_KEYS}, '{_NEEDED[0]}') AS lacks_params FROM (SELECT page_id, CASE page_id % 5 WHEN 0 THEN url || '/Index.html' WHEN 1 THEN replace(url, '.com/', '.com//') || '/index.php' ELSE url END AS url FROM pages)"""
)
def c23_url_rules(spark, sf_dir):
    """Letters, index files, slashes and parameters of addresses against a policy."""
    url = F.expr("CASE page_id % 5 WHEN 0 THEN concat(url, '/Index.html') WHEN 1 THEN concat(replace(url, '.com/', '.com//'), '/index.php') ELSE url END")
    p = table(spark, sf_dir, "pages").select("page_id", url.alias("url"))
    return U.policy(p, _ALLOWED, _NEEDED)


_START = "concat(url, CASE page_id % 4 WHEN 0 THEN '/index.html' WHEN 1 THEN '?page=1' WHEN 2 THEN '/a.php' ELSE '?utm_source=x' END)"
_END = "CASE WHEN page_id % 3 = 0 THEN concat(url, CASE page_id % 4 WHEN 0 THEN '/index.html' WHEN 1 THEN '?page=1' WHEN 2 THEN '/a.php' ELSE '?utm_source=x' END) ELSE url END"
_KINDS = {"index_file": "/(index|default)\\.[a-z]+$", "first_page": "[?&]page=1$", "old_extension": "\\.(php|asp|aspx|jsp)$", "tracking": "[?&]utm_[a-z]+="}


@query(f"WITH p AS (SELECT page_id, {_START} AS a, {_END} AS b FROM (SELECT page_id, 'https://x.example.com/' || page_id AS url FROM pages)) " + " UNION ALL ".join(f"SELECT page_id, '{k}' AS kind, NOT regexp_matches(b, '{v}') AS handled FROM p WHERE regexp_matches(a, '{v}')" for k, v in _KINDS.items()))
def c27_recorded_hops(spark, sf_dir):
    """Index files, first pages, old extensions and tracking marks, and whether a recorded hop took them away."""
    p = table(spark, sf_dir, "pages").select("page_id", F.expr("concat('https://x.example.com/', page_id)").alias("url")).select("page_id", F.expr(_START).alias("a"), F.expr(_END).alias("b"))
    kinds = F.explode(F.filter(F.array(*[F.when(F.col("a").rlike(v), F.struct(F.lit(k).alias("kind"), (~F.col("b").rlike(v)).alias("handled"))) for k, v in _KINDS.items()]), lambda x: x.isNotNull()))
    return p.select("page_id", kinds.alias("k")).select("page_id", "k.kind", "k.handled")


# --- robots and sitemaps


@query(
    f"""WITH {_DIRECTIVES}, ua AS (SELECT host, group_id, lower(value) AS agent FROM dr WHERE key = 'user-agent'), r AS (SELECT dr.host, agent, key, value FROM dr JOIN ua ON ua.host = dr.host AND ua.group_id = dr.group_id WHERE key IN ('allow', 'disallow') AND value <> '')
SELECT DISTINCT a.host, a.agent, a.value AS allow, d.value AS disallow, starts_with(a.value, d.value) AS allow_is_longer FROM r a JOIN r d ON d.host = a.host AND d.agent = a.agent AND d.key = 'disallow' AND a.key = 'allow' AND a.value <> d.value AND (starts_with(d.value, a.value) OR starts_with(a.value, d.value))"""
)
def d33_overlapping_rules(spark, sf_dir):
    """Allowed and disallowed paths of an agent of which one begins with the other; the longer one holds."""
    return S.overlapping(rules(spark, sf_dir))


_WANTED = ["googlebot", "yandex", "gptbot"]


@query(f"WITH {_DIRECTIVES}, w(bot) AS (VALUES {', '.join(f'''('{b}')''' for b in _WANTED)}) SELECT host, bot FROM (SELECT DISTINCT host FROM dr), w WHERE NOT EXISTS (SELECT 1 FROM dr x WHERE x.host = dr.host AND x.key = 'user-agent' AND contains(lower(x.value), bot))".replace("x.host = dr.host", "x.host = h.host").replace("(SELECT DISTINCT host FROM dr), w", "(SELECT DISTINCT host FROM dr) h, w").replace("SELECT host, bot FROM", "SELECT h.host, bot FROM"))
def b26_missing_bots(spark, sf_dir):
    """Hosts that say nothing to a bot of a list."""
    return S.missing_bots(rules(spark, sf_dir), _WANTED)


@query(f"WITH {_SITEMAP}, d AS (SELECT file, lastmod, count(*) AS n FROM sm WHERE TRY_CAST(substr(lastmod, 1, 10) AS DATE) IS NOT NULL GROUP BY 1, 2), f AS (SELECT file, sum(n) AS dated, max(n) AS most FROM d GROUP BY file) SELECT file, CAST(dated AS BIGINT) AS dated, most, dated >= 20 AND most * 1.0 / dated >= 0.9 AS uniform FROM f")
def d32_uniform_lastmod(spark, sf_dir):
    """Whether nearly all dated urls of a file have one date, which then says nothing."""
    return S.uniform_lastmod(sitemap_urls(spark, sf_dir))


# --- smaller reports


@query("SELECT p_brand, p_partkey, p_retailprice, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part) WHERE rank <= 3")
def e10_top_of_group(spark, sf_dir):
    """The three first rows of each group in an order without ties."""
    p = table(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_retailprice")
    return top_k(p, ["p_brand"], [F.desc("p_retailprice"), F.asc("p_partkey")], 3)


def _pairs_by(method: str) -> str:
    part = {"dice": "2.0 * {b} / ({x} + {y})", "overlap": "CAST({b} AS DOUBLE) / least({x}, {y})"}[method].format(b="len(list_intersect(ea.stems, eb.stems))", x="len(ea.stems)", y="len(eb.stems)")
    return f"WITH {KQ._E}, {KQ._PAIRS}".replace("CAST(len(list_intersect(ea.stems, eb.stems)) AS DOUBLE) / (len(ea.stems) + len(eb.stems) - len(list_intersect(ea.stems, eb.stems))) AS st", f"{part} AS st") + " SELECT * FROM pairs"


@query(_pairs_by("dice"))
def u1_dice_similarity(spark, sf_dir):
    """The keyword join with another measure, which the user chooses."""
    return K.similar_pairs(cut(KQ.entries(spark, sf_dir)), KQ.THRESHOLD, "dice", KQ.FREQUENT)


@query(_pairs_by("overlap"))
def u1_overlap_similarity(spark, sf_dir):
    """The keyword join by overlap."""
    return K.similar_pairs(cut(KQ.entries(spark, sf_dir)), KQ.THRESHOLD, "overlap", KQ.FREQUENT)


_SLACK = ["score", *E.CORE]


@query(
    f"""WITH {VITALS}, {_SITE}, u AS (UNPIVOT (SELECT site, {", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in _SLACK)} FROM si) ON {", ".join(_SLACK)} INTO NAME metric VALUE v), f AS (SELECT min(site) AS p FROM si),
g AS (SELECT metric, max(v) FILTER (WHERE site = p) AS ours, median(v) FILTER (WHERE site <> p) AS median FROM u, f GROUP BY metric)
SELECT metric, {rnd_sql("ours", 4)} AS ours, {rnd_sql("median", 4)} AS competitors_median, {rnd_sql("ours - median", 4)} AS gap, CASE WHEN ours IS NULL OR median IS NULL THEN 'unknown' WHEN (metric = 'score') = (ours > median) AND ours <> median THEN 'strength' WHEN ours = median THEN 'even' ELSE 'gap' END AS verdict FROM g"""
)
def c20_against_median(spark, sf_dir):
    """The first site's metrics beside the median of all others: strengths and gaps; only the score is better when higher."""
    s = sites(spark, sf_dir)
    return E.against_median(s, s.agg(F.min("site")).first()[0])


@query(f"WITH {RICH}, {_IMAGES} SELECT count(*) AS images, {pct_sql('count(*) FILTER (WHERE modern)', 'count(*)')} AS modern_pct, {pct_sql('count(*) FILTER (WHERE no_alt)', 'count(*)')} AS no_alt_pct, {pct_sql('count(*) FILTER (WHERE sized)', 'count(*)')} AS sized_pct, {pct_sql('count(*) FILTER (WHERE lazy)', 'count(*)')} AS lazy_pct, count(*) FILTER (WHERE external) AS external FROM im")
def d23_image_summary(spark, sf_dir):
    """The images of the site in one row."""
    n = F.count("*")
    return M.images(rich_pages(spark, sf_dir)).agg(n.alias("images"), *[pct(F.count_if(c), n).alias(f"{c}_pct") for c in ("modern", "no_alt", "sized", "lazy")], F.count_if("external").alias("external"))


_LETTERS = ", ".join(f"len(regexp_extract_all(text, '{p}')) AS {k}_" for k, p in T.LANGUAGE_CHARS.items())
_MOST = f"greatest({', '.join(k + '_' for k in T.LANGUAGE_CHARS)})"


@query(f"WITH {SITE}, l AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN '' ELSE html_lang END AS declared, {_LETTERS} FROM fe) SELECT page_id, CASE WHEN declared <> '' THEN lower(left(declared, 2)) WHEN {_MOST} <= 10 THEN 'en' {' '.join(f'''WHEN {k}_ = {_MOST} THEN '{k}' ''' for k in T.LANGUAGE_CHARS)} END AS language FROM l")
def h11_page_language(spark, sf_dir):
    """A page's language: the one it declares, else by the letters of its text."""
    p = A.markup_features(site_pages(spark, sf_dir))
    counts = {k: F.regexp_count("text", F.lit(v)) for k, v in T.LANGUAGE_CHARS.items()}
    p = p.select("page_id", F.when(F.col("page_id") % 3 == 0, "").otherwise(F.col("html_lang")).alias("declared"), *[c.alias(f"{k}_") for k, c in counts.items()])
    best = F.greatest(*[F.col(f"{k}_") for k in counts])
    language = F.when(F.col("declared") != "", F.lower(F.left("declared", F.lit(2)))).when(best <= 10, "en")
    for k in counts:
        language = language.when(F.col(f"{k}_") == best, k)
    return p.select("page_id", language.alias("language"))


_TOPS = lambda g: f"(floor(coalesce(list_max(map_values(list_histogram({g}))), 0) * 100e0 / greatest(1, len({g})) * 100e0 + 0.5e0) / 100e0)"


@query(
    f"""WITH d AS (SELECT doc_id, list_filter({_words("lower(text)")}, lambda x: length(x) > 2 AND x NOT IN {_list(T.STOP_WORDS)}) AS c FROM documents)
SELECT doc_id, {_TOPS("c")} AS top_term_pct, {_TOPS("list_transform(range(1, len(c)), lambda i: c[i] || ' ' || c[i + 1])")} AS top_bigram_pct, {_TOPS("list_transform(range(1, len(c) - 1), lambda i: c[i] || ' ' || c[i + 1] || ' ' || c[i + 2])")} AS top_trigram_pct FROM d"""
)
def h9_repetition(spark, sf_dir):
    """Shares of the most frequent word, pair and triple of words in each document."""
    c = F.filter(T.words(F.lower("text")), lambda v: (F.length(v) > 2) & ~T.in_list(v, T.STOP_WORDS))
    return A.top_shares(docs(spark, sf_dir).select("doc_id", c.alias("c"))).select("doc_id", "top_term_pct", "top_bigram_pct", "top_trigram_pct")


_CATS = {"lcp": "loading", "fcp": "loading", "ttfb": "server", "inp": "interaction", "cls": "stability"}


@query(f"WITH {VITALS}, c AS (SELECT site, CASE metric {' '.join(f'''WHEN '{k}' THEN '{v}' ''' for k, v in _CATS.items())} END AS category, metric, avg(value) AS v FROM vt GROUP BY ALL) SELECT category, count(DISTINCT site) AS sites, {rnd_sql('avg(v)', 2)} AS mean, {rnd_sql('median(v)', 2)} AS median, {rnd_sql('min(v)', 2)} AS least, {rnd_sql('max(v)', 2)} AS most FROM c GROUP BY category")
def d27_category_means(spark, sf_dir):
    """Means, medians and extremes of the sites' metrics by category."""
    from crawlframe.plans.event_queries import vitals

    names = F.create_map(*[F.lit(x) for kv in _CATS.items() for x in kv])
    c = vitals(spark, sf_dir).groupBy("site", names[F.col("metric")].alias("category"), "metric").agg(F.avg("value").alias("v"))
    return c.groupBy("category").agg(F.count_distinct("site").alias("sites"), rnd(F.avg("v"), 2).alias("mean"), rnd(F.median("v"), 2).alias("median"), rnd(F.min("v"), 2).alias("least"), rnd(F.max("v"), 2).alias("most"))
