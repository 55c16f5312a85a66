"""Queries of the page audit: features, rules and scores over pages with head tags, headers and structured data.

The SQL beside a query asks DuckDB for the same features by the same patterns; rules and derived features are ANSI SQL over
the features' names and are read by both engines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crawlframe.functions import text as T
from crawlframe.functions.common import rnd, rnd_sql, top_k
from crawlframe.functions.rules import issue_array, issues
from crawlframe.operators import markup as M
from crawlframe.operators import page_audit as A
from crawlframe.plans.markup_queries import _SIGNALS, RICH, rich_pages
from crawlframe.plans.page_queries import _LEGAL, _TEXT, _TITLE, _TYPES
from crawlframe.plans.registry import query
from crawlframe.plans.text_queries import _len, _list, _occurrences, _ratio, _sentences, _tokens, _words

# More markup for the pages, by their ids, in SQL that both engines read.
_IN_HEAD = """CASE WHEN page_id % 2 = 0 THEN '<meta charset="utf-8">' ELSE '' END || CASE WHEN page_id % 3 > 0 THEN '<meta name="viewport" content="width=device-width">' ELSE '' END
 || CASE WHEN page_id % 17 = 0 THEN '<meta name="description" content="A second one"><title>Second</title>' ELSE '' END || CASE WHEN page_id % 19 = 0 THEN '<meta content="index" name="robots">' ELSE '' END
 || CASE WHEN page_id % 4 = 1 THEN '<meta property="og:title" content="T"><meta property="og:type" content="article"><meta property="og:image" content="/i.png">' ELSE '' END
 || CASE WHEN page_id % 8 = 1 THEN '<meta property="og:url" content="https://site.example.com"><meta property="og:description" content="D"><meta name="twitter:card" content="summary">' ELSE '' END
 || CASE WHEN page_id % 6 = 2 THEN '<meta name="author" content="A. Writer"><meta property="article:published_time" content="2024-01-0' || CAST(1 + page_id % 9 AS {S}) || '">' ELSE '' END
 || CASE WHEN page_id % 5 < 3 THEN '<script src="/a.js"></script><script async src="/b.js"></script><link rel="stylesheet" href="/s.css">' ELSE '<link rel="preload" href="/f.woff"><script src="/c.js" defer></script>' END
 || CASE WHEN page_id % 10 = 3 THEN '<script type="application/ld+json">[{{"@type":["Product","Thing"],"offers":{{"price":"3"}}}},{{"@type":"FAQPage"}},{{"@type":"https://schema.org/BreadcrumbList","itemListElement":[]}}]</script>' ELSE '' END"""
_IN_BODY = """CASE page_id % 5 WHEN 0 THEN '<h2>Early</h2><h1>Main topic</h1>' WHEN 1 THEN '<h1>Main topic</h1><h1>Main topic</h1>' WHEN 2 THEN '' WHEN 3 THEN '<h1>Main topic</h1><h4>Deep</h4>' ELSE '<H1 class="t">Main topic</H1><h2>Part</h2>' END
 || CASE WHEN page_id % 4 = 0 THEN '<nav><a href="/buy">Buy now</a><a href="https://else.example.org/" rel="nofollow">Else</a><a href="/x"></a></nav><ul><li>One</li></ul>' ELSE '' END
 || CASE WHEN page_id % 7 = 3 THEN '<img src="/d.gif" role="presentation" alt="a line"><img alt="image" src="http://cdn.example.net/e.avif" width="1" height="2"><font>old</font>' ELSE '' END
 || CASE WHEN page_id % 9 = 4 THEN '<div aria-hidden="true">unseen by many readers</div><p style="font-size: 2px">tiny letters here</p><i class="icon" aria-hidden="true">icon text</i>' ELSE '' END
 || CASE WHEN page_id % 12 = 5 THEN '<div itemscope itemtype="https://schema.org/FAQPage">Q</div><span typeof="schema:Person">P</span><table><tr><td>1</td></tr></table>' ELSE '' END"""
_SITE_URL = "CASE WHEN page_id % 23 = 0 THEN 'http://site.example.com/p/' || CAST(page_id AS {S}) WHEN page_id % 7 = 5 THEN url || '?a=1&b=2' WHEN page_id % 7 = 6 THEN 'https://site.example.com/blog/2024/05/x/' || CAST(page_id AS {S}) WHEN page_id % 29 = 0 THEN 'https://site.example.com/' ELSE url END"
_SITE_HTML = f"replace(replace(html, '</head>', {_IN_HEAD} || '</head>'), '</body>', {_IN_BODY} || '</body>')"
_HEADERS = {
    "Content-Encoding": "CASE WHEN page_id % 3 = 0 THEN 'gzip' END",
    "Cache-Control": "CASE page_id % 4 WHEN 0 THEN 'max-age=60' WHEN 1 THEN 'no-store' END",
    "ETag": "CASE WHEN page_id % 6 = 1 THEN 'x' END",
    "X-Robots-Tag": "CASE WHEN page_id % 13 = 2 THEN 'NoIndex' END",
    "Content-Security-Policy": "CASE WHEN page_id % 2 = 0 THEN 'default-src' END",
    "Strict-Transport-Security": "CASE WHEN page_id % 3 = 1 THEN 'max-age=1' END",
    "X-Frame-Options": "CASE WHEN page_id % 5 = 0 THEN 'DENY' END",
}
_MS = "(page_id * 137) % 4000"


def site_pages(spark, sf_dir) -> DataFrame:
    """``(page_id, url, html, code, ms, headers)``."""
    s = lambda x: x.format(S="STRING")
    pairs = F.filter(F.array(*[F.struct(F.lit(k).alias("key"), F.expr(v).alias("value")) for k, v in _HEADERS.items()]), lambda e: e["value"].isNotNull())
    p = rich_pages(spark, sf_dir)
    return p.select("page_id", F.expr(s(_SITE_URL)).alias("url"), F.expr(s(_SITE_HTML)).alias("html"), "code", F.expr(_MS).cast("long").alias("ms"), F.map_from_entries(pairs).alias("headers"))


# --- the same features in SQL


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _sql_feature(spec) -> str:
    if isinstance(spec, A.Count):
        return f"CAST(len(regexp_extract_all({spec.part}, {_quoted(spec.pattern)})) AS BIGINT)"
    inner = rf"(?is)\s{spec.attribute}\s*=\s*{A._Q}([^\"']*)"
    return f"trim(regexp_extract(regexp_extract(html, {_quoted(spec.pattern)}), {_quoted(inner)}, 1))"


_of = lambda h: _HEADERS.get({v.lower(): v for v in _HEADERS}.get(h, ""), "NULL")
_REPEATED = lambda x: f"CAST(len(list_filter(list_distinct({x}), lambda a: len(list_filter({x}, lambda b: b = a)) > 1)) AS BIGINT)"
_ROUNDED = lambda x, n: f"(floor(({x}) * 1e{n} + 0.5e0) / 1e{n})"
_V = lambda x: x.format(S="VARCHAR")
_PATH = "regexp_extract(url, '//[^/?#]*([^?#]*)', 1)"
_MARKERS = " + ".join([f"CAST(regexp_matches(low, '(^|[^\\p{{L}}\\p{{N}}_]){m}([^\\p{{L}}\\p{{N}}_]|$)') AS BIGINT)" for m in T.TECH_MARKERS] + [f"CAST(contains(low, {_list([m])[1:-1]}) AS BIGINT)" for m in T.AI_MARKERS])
_ANY = lambda x, words: "(" + " OR ".join(f"contains({x}, '{w}')" for w in words) + ")"
_KEY = lambda u: f"regexp_replace(lower(regexp_extract({u}, '^([^/]*//[^/?]*)', 1)) || substr({u}, length(regexp_extract({u}, '^([^/]*//[^/?]*)', 1)) + 1), '/$', '')"
_TOP = lambda g: _ROUNDED(f"coalesce(list_max(map_values(list_histogram({g}))), 0) * 100e0 / greatest(1, len({g}))", 2)
_READ = f"CASE WHEN len(w) = 0 THEN 0.0 ELSE {rnd_sql('greatest(0.0, least(100.0, 100.0 - greatest(0.0, (' + _ratio('len(w)', 'len(s)') + ' - 14.0) * 2.2) - greatest(0.0, (' + _ratio(_len('w'), 'len(w)') + ' - 5.5) * 8.0)))', 1)} END"
_HIDDEN_SQL = f"list_transform(list_filter(list_transform(regexp_extract_all(html, {_quoted(M.HIDDEN_ELEMENT)}), lambda x: struct_pack(e := x, tag := lower(regexp_extract(x, '^<([a-zA-Z]+)', 1)), said := trim(regexp_extract(x, '(?s)>([^<]*)<$', 1)))), lambda h: length(h.said) >= 4 AND NOT list_contains({M.SKIPPED_TAGS!r}, h.tag) AND NOT (list_contains(['i', 'span'], h.tag) AND regexp_matches(h.e, {_quoted(M.ICON)}))), lambda h: length(h.said))"
SITE = f"""{RICH}, sp AS (SELECT page_id, {_V(_SITE_URL)} AS url, {_V(_SITE_HTML)} AS html, code, {_MS} AS ms FROM rp),
s1 AS (SELECT *, regexp_replace(html, '(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->', ' ', 'g') AS bare, regexp_extract(html, '(?is)<head[\\s>](.*?)</head>', 1) AS head, {_TITLE} AS title, {_TEXT} AS text FROM sp),
s2 AS (SELECT *, {", ".join(f"{_sql_feature(f)} AS {k}" for k, f in A.FEATURES.items())}, {", ".join(f"coalesce({_of(h)}, '') AS {k}" for k, h in A.HEADERS.items())}, lower(text) AS low,
 regexp_extract_all(bare, {_quoted(A.HEADING)}) AS hx, regexp_extract_all(bare, {_quoted(A.SRC)}, 1) AS sources, {_HIDDEN_SQL} AS hidden_chars FROM s1),
s3 AS (SELECT *, list_transform(hx, lambda x: CAST(x[3] AS INTEGER)) AS lv, list_transform(hx, lambda x: trim(lower(regexp_extract(x, '(?s)>(.*)$', 1)))) AS ht, strlen(html) AS bytes, len(list_filter(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'), lambda x: x <> '')) AS params,
 len(list_filter(string_split({_PATH}, '/'), lambda x: x <> '')) AS depth, lower(regexp_extract(url, '//([^/?#:]*)', 1)) AS host, {_KEY("url")} AS url_key, lower(regexp_extract(canonical, '^[a-zA-Z]+://([^/?#:]*)', 1)) AS canonical_host, {_KEY("canonical")} AS canonical_key, {_REPEATED("sources")} AS repeated_images,
 CAST(len(hidden_chars) AS BIGINT) AS hidden_nodes, coalesce(list_sum(hidden_chars), 0) AS hidden_sum, {_tokens("text")} AS t, {_words("low")} AS w, {_sentences("text")} AS s, lower(concat_ws(' ', title, text)) AS said FROM s2),
s4 AS (SELECT *, lv[1] AS first_level, CAST(len(list_filter(range(2, len(lv) + 1), lambda i: lv[i] - lv[i - 1] > 1)) AS BIGINT) AS level_skips, {_REPEATED("ht")} AS repeated_headings,
 hidden_nodes > 0 AND length(text) > 0 AND (hidden_nodes >= 20 OR (hidden_sum / greatest(1, length(text)) >= 0.3e0 AND hidden_sum >= 200) OR (hidden_nodes >= 8 AND hidden_sum >= 200) OR (hidden_nodes >= 6 AND length(text) < 200)) AS cloaked,
 list_filter(w, lambda x: length(x) > 2 AND x NOT IN {_list(T.STOP_WORDS)}) AS c, len(t) AS words, len(w) AS all_words, {_MARKERS} AS markers, {_ROUNDED(_ratio(f"len(list_filter(t, lambda x: x IN {_list(T.TOXIC_WORDS)}))", "len(t)") + " * 100e0", 2)} AS toxic_pct,
 {_ROUNDED(_ratio(f"len(list_filter(w, lambda x: x IN {_list(T.FILLER_WORDS)}))", "len(w)"), 4)} AS filler_ratio, regexp_matches(low, '(^|[^\\p{{L}}\\p{{N}}_])(api|sdk|json|http|ssl|tls|csp)([^\\p{{L}}\\p{{N}}_]|$)') AS technical_words,
 {", ".join(f"regexp_matches(said, '{_SIGNALS[k]}') AS {k}" for k in ("contact", "legal", "reviews", "badges"))}, regexp_matches(said, '{_SIGNALS["author"]}') OR author <> '' AS has_author, {_READ} AS readability,
 {_ROUNDED(_ratio("len(list_distinct(w))", "len(w)"), 4)} AS lexical_diversity, {_ROUNDED(_ratio(f"len(list_filter(s, lambda x: len({_words('x')}) > 20))", "len(s)"), 4)} AS long_sentence_ratio, {_ROUNDED(_ratio("len(regexp_extract_all(text, '\\p{Lu}'))", "len(regexp_extract_all(text, '\\p{L}'))"), 4)} AS uppercase_ratio,
 {_ROUNDED(_ratio("len(regexp_extract_all(text, '[!?.,;:]'))", "length(text)"), 4)} AS punctuation_ratio, {_ROUNDED(_ratio("length(text)", "length(html)"), 4)} AS text_html_ratio, {_ROUNDED(_ratio("len(s) - len(list_distinct(s))", "len(s)"), 4)} AS duplicate_sentence_ratio,
 {_ROUNDED(_ratio(_occurrences("low", T.TEMPLATE_PHRASES) + " * 1000e0", "len(w)"), 2)} AS template_repetition,
 CASE WHEN trim(lower({_PATH}), '/') = '' THEN 'home' {" ".join(f"WHEN {_ANY(f'lower({_PATH})', ws)} THEN '{k}'" for k, ws in _TYPES[:-1])} WHEN {_ANY("said", _LEGAL)} THEN 'legal' WHEN {_ANY(f"lower({_PATH})", _TYPES[-1][1])} THEN '{_TYPES[-1][0]}' ELSE 'other' END AS page_type FROM s3),
js0 AS (SELECT page_id, TRY_CAST(unnest(regexp_extract_all(html, '(?is)<script type="application/ld\\+json">(.*?)</script>', 1)) AS JSON) AS v FROM sp),
js1 AS (SELECT page_id, v FROM js0 WHERE json_type(v) = 'OBJECT' UNION ALL SELECT page_id, unnest(from_json(v, '["json"]')) FROM js0 WHERE json_type(v) = 'ARRAY'),
js AS (SELECT page_id, v FROM js1 UNION ALL SELECT page_id, unnest(from_json(json_extract(v, '$."@graph"'), '["json"]')) FROM js1 WHERE json_type(json_extract(v, '$."@graph"')) = 'ARRAY'),
jt AS (SELECT page_id, v, list_transform(CASE json_type(json_extract(v, '$."@type"')) WHEN 'ARRAY' THEN from_json(json_extract(v, '$."@type"'), '["varchar"]') WHEN 'VARCHAR' THEN [json_extract_string(v, '$."@type"')] ELSE [] END, lambda x: lower(trim(regexp_replace(x, '^.*[#?/]|^schema:', '')))) AS types FROM js),
jc0 AS (SELECT page_id, types, {", ".join(f"trim(coalesce(json_extract_string(v, '$.{f}'), '')) AS {f}" for f in ("name", "headline", "datePublished", "author", "url", "itemListElement", "mainEntity"))}, json_type(json_extract(v, '$.offers')) AS ot,
 CASE json_type(json_extract(v, '$.offers')) WHEN 'OBJECT' THEN [json_extract(v, '$.offers')] WHEN 'ARRAY' THEN from_json(json_extract(v, '$.offers'), '["json"]') ELSE [] END AS offers FROM jt),
jc AS (SELECT DISTINCT page_id, unnest(list_filter([CASE WHEN p AND name = '' THEN 'product_missing_name' END, CASE WHEN p AND len(offers) = 0 THEN 'product_missing_offers' END, CASE WHEN p AND len(offers) > 0 AND len(list_filter(offers, lambda o: trim(coalesce(json_extract_string(o, '$.price'), '')) <> '')) = 0 THEN 'product_missing_price' END,
 CASE WHEN p AND len(offers) > 0 AND len(list_filter(offers, lambda o: trim(coalesce(json_extract_string(o, '$.priceCurrency'), '')) <> '')) = 0 THEN 'product_missing_price_currency' END, CASE WHEN a AND headline = '' THEN 'article_missing_headline' END, CASE WHEN a AND "datePublished" = '' THEN 'article_missing_date_published' END,
 CASE WHEN a AND author = '' THEN 'article_missing_author' END, CASE WHEN o AND name = '' THEN 'organization_missing_name' END, CASE WHEN o AND url = '' THEN 'organization_missing_url' END, CASE WHEN list_contains(types, 'breadcrumblist') AND "itemListElement" IN ('', '[]') THEN 'breadcrumb_missing_item_list' END,
 CASE WHEN list_contains(types, 'faqpage') AND "mainEntity" IN ('', '[]') THEN 'faq_missing_main_entity' END], lambda x: x IS NOT NULL)) AS code
 FROM (SELECT *, list_contains(types, 'product') AS p, list_has_any(types, ['article', 'newsarticle', 'blogposting']) AS a, list_has_any(types, ['organization', 'localbusiness']) AS o FROM jc0)),
s5 AS (SELECT s4.*, coalesce(jn.n, 0) AS structured_errors, coalesce(jv.n, 0) AS valid_json_ld, {_ROUNDED("1e0 - " + _ratio("len(c)", "len(w)"), 4)} AS stopword_ratio, CASE WHEN len(c) = 0 THEN 0e0 ELSE {_ROUNDED(_ratio("len(list_distinct(c))", "len(c)") + " * 100e0", 1)} END AS unique_pct,
 {_TOP("c")} AS top_term_pct, {_TOP("list_transform(range(1, len(c)), lambda i: c[i] || ' ' || c[i + 1])")} AS top_bigram_pct, {_TOP("list_transform(range(1, len(c) - 1), lambda i: c[i] || ' ' || c[i + 1] || ' ' || c[i + 2])")} AS top_trigram_pct
 FROM s4 LEFT JOIN (SELECT page_id, count(*) AS n FROM jc GROUP BY 1) jn USING (page_id) LEFT JOIN (SELECT page_id, count(v) AS n FROM js0 GROUP BY 1) jv USING (page_id)),
fe AS MATERIALIZED (SELECT *, {", ".join(f"{rule} AS {name}" for name, rule in A.DERIVED.items())} FROM s5)"""


def features(spark, sf_dir) -> DataFrame:
    """All features of the pages, one row each."""
    p = site_pages(spark, sf_dir)
    f = A.with_page_type(A.text_features(A.markup_features(p)), _TYPES, _LEGAL)
    objects = M.structured_objects(p)
    wrong = M.structured_issues(objects).groupBy("page_id").agg(F.count("*").alias("structured_errors"))
    valid = M.structured_scripts(p).where("v is not null").groupBy("page_id").agg(F.count("*").alias("valid_json_ld"))
    f = A.top_shares(f).join(wrong, "page_id", "left").join(valid, "page_id", "left").fillna(0, ["structured_errors", "valid_json_ld"])
    return A.derived(f)


_ISSUES = "iss AS (" + " UNION ALL ".join(f"SELECT page_id, '{c}' AS code, '{s}' AS severity, CAST({p} AS DOUBLE) AS penalty FROM fe WHERE {w}" for c, s, p, w in A.RULES) + ")"
_W = f"WITH {SITE}"


@query(f"{_W}, {_ISSUES} SELECT * FROM iss")
def b24_page_issues(spark, sf_dir):
    """Issues of each page by the catalogue of page rules."""
    return issues(features(spark, sf_dir), A.page_rules(), ["page_id"]).select("page_id", "code", "severity", "penalty")


_HEALTH = "ph AS (SELECT fe.page_id, greatest(0e0, 100e0 - coalesce(sum(iss.penalty), 0e0)) AS health, count(iss.penalty) AS n_issues FROM fe LEFT JOIN iss ON iss.page_id = fe.page_id GROUP BY fe.page_id)"


def _with_issues(spark, sf_dir) -> DataFrame:
    d = features(spark, sf_dir).withColumn("found", issue_array(A.page_rules()))
    return d.withColumn("health", F.greatest(F.lit(0.0), 100.0 - F.aggregate("found", F.lit(0.0), lambda s, x: s + x["penalty"])))


@query(f"{_W}, {_ISSUES}, {_HEALTH} SELECT * FROM ph")
def h25_page_health(spark, sf_dir):
    """Hundred less the penalties of a page's issues."""
    return _with_issues(spark, sf_dir).select("page_id", "health", F.size("found").cast("long").alias("n_issues"))


@query(
    f"""{_W}, {_ISSUES}, {_HEALTH} SELECT (SELECT count(*) FROM iss WHERE severity = 'critical') AS criticals, (SELECT count(*) FROM iss WHERE severity = 'warning') AS warnings, (SELECT count(*) FROM iss WHERE severity = 'info') AS infos, {rnd_sql("avg(health)", 1)} AS mean_health, count(*) AS pages,
 count(*) FILTER (WHERE budget_risk = 'high') AS high_risk_urls, count(*) FILTER (WHERE budget_risk = 'medium') AS medium_risk_urls, count(*) FILTER (WHERE params > 0) AS parameterized_urls, count(*) FILTER (WHERE depth >= 4) AS deep_path_urls FROM ph JOIN fe USING (page_id)"""
)
def d20_site_summary(spark, sf_dir):
    """Issues by severity, the mean health of the site, and what strains a crawl budget."""
    n = lambda s: F.sum(F.size(F.filter("found", lambda x: x["severity"] == s))).cast("long")
    risk = lambda r: F.count_if(F.col("budget_risk") == r)
    return _with_issues(spark, sf_dir).agg(
        n("critical").alias("criticals"),
        n("warning").alias("warnings"),
        n("info").alias("infos"),
        rnd(F.avg("health"), 1).alias("mean_health"),
        F.count("*").alias("pages"),
        risk("high").alias("high_risk_urls"),
        risk("medium").alias("medium_risk_urls"),
        F.count_if(F.col("params") > 0).alias("parameterized_urls"),
        F.count_if(F.col("depth") >= 4).alias("deep_path_urls"),
    )


_ONPAGE = "oi AS (" + " UNION ALL ".join(f"SELECT page_id, '{c}' AS code, '{s}' AS severity FROM fe WHERE {w.format(**A.LIMITS)}" for c, s, w in A.ONPAGE_RULES) + ")"


@query(f"{_W}, {_ONPAGE} SELECT * FROM oi")
def b25_onpage_issues(spark, sf_dir):
    """On-page issues of each page, by limits from settings."""
    return issues(features(spark, sf_dir), A.onpage_rules(), ["page_id"]).select("page_id", "code", "severity")


# Issues that count as spam, words of codes by area, effort and weights.
_SPAM_CODES = ["top_term_spam", "top_term_repetition", "bigram_spam", "bigram_repetition_high", "trigram_spam", "trigram_repetition_high", "duplicate_sentences_high", "duplicate_sentences_warning", "uppercase_spam_signal", "punctuation_spam_signal"]
_SPAM = "greatest(0e0, 100e0 - least(30e0, top_bigram_pct * 4e0) - least(25e0, top_trigram_pct * 8e0) - least(20e0, duplicate_sentence_ratio * 80e0) - least(10e0, greatest(0e0, (uppercase_ratio - 0.18e0) * 100e0)) - least(10e0, greatest(0e0, (punctuation_ratio - 0.07e0) * 120e0)) - least(20e0, spam_issues * 3e0))"
_BLEND = "floor((greatest(0, 100 - 20 * critical - 7 * warning - 3 * info) * 0.7e0 + spam_score * 0.2e0 + 10e0) * 10e0 + 0.5e0) / 10e0"
_AREAS = [("links", ("link", "anchor")), ("schema", ("schema", "open", "og", "structured", "twitter")), ("content", ("keyword", "term", "water", "nausea", "content", "lexical", "sentence")), ("technical", ("canonical", "robots", "viewport", "h1", "title", "description", "heading")), ("ai", ("ai_", "template", "burst", "perplex", "source", "author"))]
_AREA = "CASE " + " ".join(f"WHEN {' OR '.join(f'instr(code, {chr(39)}{w}{chr(39)}) > 0' for w in ws)} THEN '{k}'" for k, ws in _AREAS) + " ELSE 'other' END"
_HOLDS = lambda words: "(" + " OR ".join(f"instr(code, '{w}') > 0" for w in words) + ")"
_EFFORT = f"CASE WHEN {_HOLDS(('title', 'description', 'h1', 'open', 'og', 'schema_missing'))} THEN 25 WHEN {_HOLDS(('canonical', 'robots', 'viewport'))} THEN 35 WHEN {_HOLDS(('duplicate', 'template', 'ai_risk', 'nausea', 'wateriness'))} THEN 60 ELSE 50 END"
_IMPACT = "CASE severity WHEN 'critical' THEN 90 WHEN 'warning' THEN 65 ELSE 35 END"


@query(
    f"""{_W}, {_ONPAGE}, g AS (SELECT page_id, {", ".join(f"count(*) FILTER (WHERE severity = '{s}') AS {s}" for s in ("critical", "warning", "info"))}, count(*) FILTER (WHERE code IN {_list(_SPAM_CODES)}) AS spam_issues FROM oi GROUP BY 1),
j AS (SELECT fe.page_id, coalesce(critical, 0) AS critical, coalesce(warning, 0) AS warning, coalesce(info, 0) AS info, coalesce(g.spam_issues, 0) AS spam_issues, top_bigram_pct, top_trigram_pct, duplicate_sentence_ratio, uppercase_ratio, punctuation_ratio FROM fe LEFT JOIN g ON g.page_id = fe.page_id)
SELECT page_id, critical, warning, info, {_ROUNDED("spam_score", 2)} AS spam_score, {_BLEND} AS score FROM (SELECT *, {_SPAM} AS spam_score FROM j)"""
)
def d35_onpage_score(spark, sf_dir):
    """Issues by severity, a spam score, and both as one score; without given keywords their part is full."""
    d = features(spark, sf_dir).withColumn("i", issue_array(A.onpage_rules()))
    n = lambda s: F.size(F.filter("i", lambda x: x["severity"] == s)).cast("long")
    d = d.withColumns({**{s: n(s) for s in ("critical", "warning", "info")}, "spam_issues": F.size(F.filter("i", lambda x: x["code"].isin(*_SPAM_CODES))).cast("long")})
    d = d.withColumn("spam_score", F.expr(_SPAM))
    return d.select("page_id", "critical", "warning", "info", rnd(F.col("spam_score"), 2).alias("spam_score"), F.expr(_BLEND).alias("score"))


@query(
    f"""{_W}, {_ONPAGE}, a AS (SELECT page_id, severity, {_AREA} AS area FROM oi), p AS (SELECT page_id, area, count(*) AS n, count(*) FILTER (WHERE severity = 'critical') AS critical, count(*) FILTER (WHERE severity = 'warning') AS warning, greatest(0, 100 - 8 * sum(CASE severity WHEN 'critical' THEN 3 WHEN 'warning' THEN 2 ELSE 1 END)) AS score FROM a GROUP BY 1, 2)
SELECT page_id, area, n AS issues, critical, warning, CAST(score AS BIGINT) AS score FROM p"""
)
def d41_issue_heat_map(spark, sf_dir):
    """Issues of each page by area, with a score of each area that has any."""
    i = issues(features(spark, sf_dir), A.onpage_rules(), ["page_id"]).withColumn("area", F.expr(_AREA))
    weight = F.when(F.col("severity") == "critical", 3).when(F.col("severity") == "warning", 2).otherwise(1)
    g = i.groupBy("page_id", "area").agg(F.count("*").alias("issues"), F.count_if(F.col("severity") == "critical").alias("critical"), F.count_if(F.col("severity") == "warning").alias("warning"), F.sum(weight).alias("w"))
    return g.select("page_id", "area", "issues", "critical", "warning", F.greatest(F.lit(0), 100 - 8 * F.col("w")).cast("long").alias("score"))


_PRIORITY = f"floor(({_IMPACT} * 0.7e0 + (100 - {_EFFORT}) * 0.3e0) * 10e0 + 0.5e0) / 10e0"


@query(
    f"""{_W}, {_ONPAGE}, q AS (SELECT page_id, code, severity, {_PRIORITY} AS priority FROM oi)
SELECT page_id, code, severity, priority, CASE WHEN priority >= 75 THEN 'Now' WHEN priority >= 55 THEN 'Next' ELSE 'Later' END AS bucket, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY priority DESC, code) AS rank FROM q) WHERE rank <= 20"""
)
def d41_priority_queue(spark, sf_dir):
    """The twenty issues of each page to take first, by impact and effort."""
    q = issues(features(spark, sf_dir), A.onpage_rules(), ["page_id"]).withColumn("priority", F.expr(_PRIORITY))
    q = top_k(q, ["page_id"], [F.desc("priority"), F.asc("code")], 20)
    return q.select("page_id", "code", "severity", "priority", F.when(F.col("priority") >= 75, "Now").when(F.col("priority") >= 55, "Next").otherwise("Later").alias("bucket"), "rank")


_HEAD_NAMES = ["title", "title_tags", "description", "description_tags", "robots", "robots_tags", "viewport", "charset_tags", "canonical", "html_lang", "author", "date", "hreflang", "og_tags", "og_title", "og_description", "og_type", "og_url", "og_image", "twitter_tags", "twitter_card", "twitter_title", "twitter_image"]


@query(f"{_W} SELECT page_id, {', '.join(_HEAD_NAMES)}, length(title) AS title_len, length(description) AS description_len FROM fe")
def h17_head_features(spark, sf_dir):
    """Everything a head says: titles, descriptions, robots, canonical, author and date, Open Graph and Twitter tags."""
    return A.markup_features(site_pages(spark, sf_dir)).select("page_id", *_HEAD_NAMES, F.length("title").cast("long").alias("title_len"), F.length("description").cast("long").alias("description_len"))


_DOM_NAMES = ["h1", "h2", "h3", "h4", "h5", "h6", "semantic_tags", "main_tags", "lists", "tables", "faq", "deprecated", "scripts", "script_files", "blocking_scripts", "stylesheets", "preloads", "elements", "images", "images_no_alt", "generic_alt", "decorative_alt", "modern_images", "lazy_images", "repeated_images", "links", "internal_links", "external_links", "nofollow_links", "empty_anchors", "buttons", "cta", "cta_quality"]


@query(f"{_W} SELECT page_id, {', '.join(_DOM_NAMES)} FROM fe")
def h18_dom_features(spark, sf_dir):
    """Counts over a page's elements: headings, semantic and deprecated tags, scripts, images, links, calls to action."""
    return features(spark, sf_dir).select("page_id", *_DOM_NAMES)


@query(f"{_W} SELECT page_id, outline, level_skips, repeated_headings, first_level FROM fe")
def e3_outline_status(spark, sf_dir):
    """What is wrong with a page's headings."""
    return features(spark, sf_dir).select("page_id", "outline", "level_skips", "repeated_headings", "first_level")


@query(f"{_W} SELECT page_id, canonical_status, indexable, indexability_reason FROM fe")
def b17_page_indexability(spark, sf_dir):
    """Whether a page can be indexed, and what speaks against it."""
    return features(spark, sf_dir).select("page_id", "canonical_status", "indexable", "indexability_reason")


@query(f"{_W} SELECT page_id, csp <> '' AS csp, hsts <> '' AS hsts, frame_options <> '' AS frame_options, mixed_content, {_ROUNDED('security_score - least(20e0, mixed_content * 2e0)', 1)} AS security_score FROM fe")
def b28_security_headers(spark, sf_dir):
    """Security headers and insecure resources, and a score of them."""
    present = [(F.col(c) != "").alias(c) for c in ("csp", "hsts", "frame_options")]
    return features(spark, sf_dir).select("page_id", *present, "mixed_content", rnd(F.col("security_score") - F.least(F.lit(20.0), F.col("mixed_content") * 2.0), 1).alias("security_score"))


_SCORES = ["trust", "expertise", "authoritativeness", "trustworthiness", "experience", "eeat", "perf_light", "ai_risk", "marker_density"]


@query(f"{_W} SELECT page_id, {', '.join(_SCORES)}, CASE WHEN ai_risk >= 70 THEN 'high' WHEN ai_risk >= 40 THEN 'medium' ELSE 'low' END AS ai_risk_level FROM fe")
def h25_trust_scores(spark, sf_dir):
    """Trust, its four parts, light performance and machine-text risk of each page."""
    level = F.when(F.col("ai_risk") >= 70, "high").when(F.col("ai_risk") >= 40, "medium").otherwise("low")
    return features(spark, sf_dir).select("page_id", *_SCORES, level.alias("ai_risk_level"))


_LINKED = "page_id % 5 AS incoming, CASE WHEN title = '' THEN 0 ELSE count(*) OVER (PARTITION BY lower(title)) END AS same_title, CASE WHEN description = '' THEN 0 ELSE count(*) OVER (PARTITION BY lower(description)) END AS same_description"


@query(f"{_W}, l AS (SELECT *, {_LINKED} FROM fe) SELECT page_id, {_ROUNDED('greatest(0e0, least(100e0, ' + ' + '.join(A.HEALTH_POINTS) + '))', 1)} AS site_health FROM l")
def h25_site_health(spark, sf_dir):
    """Health of each page within its site, from indexability, speed, text, head and links."""
    f = features(spark, sf_dir).withColumn("incoming", F.col("page_id") % 5)
    for c in ("title", "description"):  # counts by value, so that pages are not gathered by a title that many have
        f = f.withColumn("value", F.lower(c))
        same = f.where("value <> ''").groupBy("value").agg(F.count("*").alias(f"same_{c}")).where(F.col(f"same_{c}") > 1)
        f = f.join(same, "value", "left").withColumn(f"same_{c}", F.coalesce(f"same_{c}", F.when(F.col("value") == "", 0).otherwise(1))).drop("value")
    return f.select("page_id", A.site_health().alias("site_health"))


@query(f"{_W}, n AS (SELECT lower(trim(description)) AS description, count(*) AS pages, min(page_id) AS first_page FROM fe WHERE description <> '' GROUP BY 1) SELECT * FROM n WHERE pages > 1")
def d22_description_groups(spark, sf_dir):
    """Pages with one description."""
    d = A.markup_features(site_pages(spark, sf_dir)).select("page_id", F.lower(F.trim("description")).alias("description")).where("description <> ''")
    return d.groupBy("description").agg(F.count("*").alias("pages"), F.min("page_id").alias("first_page")).where("pages > 1")


@query(f"{_W} SELECT page_id, count(*) OVER (PARTITION BY lower(trim(description))) > 1 AS duplicate_description FROM fe WHERE description <> ''")
def c15_duplicate_descriptions(spark, sf_dir):
    d = A.markup_features(site_pages(spark, sf_dir)).select("page_id", F.lower(F.trim("description")).alias("d")).where("d <> ''")
    return d.select("page_id", (F.count("*").over(Window.partitionBy("d")) > 1).alias("duplicate_description"))


@query(f"{_W} SELECT page_id, code FROM jc")
def h19_structured_errors(spark, sf_dir):
    """Fields that the structured data of a page should have and has not, each once."""
    return M.structured_issues(M.structured_objects(site_pages(spark, sf_dir)))


_TYPE = lambda x: f"regexp_replace(regexp_replace(trim({x}), '^.*[#?/]', ''), '^schema:', '')"


@query(
    rf"""{_W}, b AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<script type="application/ld\+json">(.*?)</script>', 1)) AS body FROM sp),
u AS (SELECT DISTINCT page_id, 'json-ld' AS syntax, unnest(types) AS type FROM jt UNION SELECT page_id, 'json-ld', lower({_TYPE("x")}) FROM (SELECT page_id, unnest(regexp_extract_all(body, '"@type"\s*:\s*"(.*?)"', 1)) AS x FROM b WHERE TRY_CAST(body AS JSON) IS NULL)
 UNION SELECT page_id, 'microdata', lower({_TYPE("x")}) FROM (SELECT page_id, unnest(regexp_extract_all(bare, '(?is)\sitemtype\s*=\s*["'']([^"'']*)', 1)) AS x FROM fe) UNION SELECT page_id, 'rdfa', lower({_TYPE("x")}) FROM (SELECT page_id, unnest(regexp_extract_all(bare, '(?is)\stypeof\s*=\s*["'']([^"'']*)', 1)) AS x FROM fe))
SELECT * FROM u WHERE type <> ''"""
)
def h19_structured_syntaxes(spark, sf_dir):
    """Types of structured data by syntax: JSON-LD, also where it is broken, microdata and RDFa."""
    return M.structured_types(site_pages(spark, sf_dir))


@query(f"{_W} SELECT page_id, hidden_nodes AS nodes, CAST(hidden_sum AS BIGINT) AS chars, cloaked FROM fe")
def h20_hidden_signals(spark, sf_dir):
    """Hidden elements by style, attribute, assistive flag or tiny letters; icons and code do not count."""
    f = A.markup_features(site_pages(spark, sf_dir))
    return f.select("page_id", F.col("hidden_nodes").alias("nodes"), F.col("hidden.chars").cast("long").alias("chars"), "cloaked")


@query(f"{_W} SELECT page_id, {_ROUNDED('CASE WHEN np = 0 THEN 0e0 ELSE nw / np END', 2)} AS mean_paragraph, {_ROUNDED('1e0 - ' + _ratio('len(list_distinct(w))', 'len(w)'), 4)} AS duplicate_words, text_html_ratio, CASE WHEN all_words >= 300 THEN 'sufficient' WHEN all_words >= 120 THEN 'short' ELSE 'thin' END AS sufficiency FROM (SELECT *, len(ps) AS np, CAST(coalesce(list_sum(list_transform(ps, lambda x: len(list_filter(string_split_regex(trim(x), '\\s+'), lambda y: y <> '')))), 0) AS DOUBLE) AS nw FROM (SELECT *, list_filter(regexp_extract_all(bare, '(?is)<p(?:\\s[^>]*)?>([^<]*)', 1), lambda x: trim(x) <> '') AS ps FROM fe))")
def h27_text_quality(spark, sf_dir):
    """Mean words of a paragraph, share of repeated words, share of text, and whether there is enough of it."""
    f = A.text_features(A.markup_features(site_pages(spark, sf_dir)))
    ps = F.filter(F.regexp_extract_all("bare", F.lit(r"(?is)<p(?:\s[^>]*)?>([^<]*)"), F.lit(1)), lambda x: F.trim(x) != "")
    n = F.aggregate(F.transform("ps", lambda x: F.size(F.filter(F.split(F.trim(x), r"\s+"), lambda y: y != ""))), F.lit(0), lambda a, b: a + b)
    f = f.withColumn("ps", ps)
    return f.select(
        "page_id",
        F.when(F.size("ps") == 0, 0.0).otherwise(rnd(n / F.size("ps"), 2)).alias("mean_paragraph"),
        rnd(1.0 - T.ratio(F.size(F.array_distinct("w")), F.size("w")), 4).alias("duplicate_words"),
        "text_html_ratio",
        F.when(F.col("all_words") >= 300, "sufficient").when(F.col("all_words") >= 120, "short").otherwise("thin").alias("sufficiency"),
    )

