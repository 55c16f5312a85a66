"""Queries over blocks and things of pages, as nested intervals; the SQL finds the intervals by levels of opening and closing tags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlframe.functions.common import rnd_sql as R
from crawlframe.operators import blocks as K
from crawlframe.plans.registry import query, table

_PROSE = "Pumps move water from one place to another where it is wanted most and valves keep it from running back again while meters tell how much has gone by since spring came and sensors listen for leaks along every pipe below ground so that workers find them early enough to mend before winter frost breaks what old iron could hold no longer because nobody cared about its joints or looked after them during summer when soil stays dry and digging costs little money"

# What stands before the footer of a page, the same expression in both engines.
_MORE = f"""CASE page_id % 9
 WHEN 0 THEN '<div id="bx_menu" class="catalog megamenu section-list"><a href="/c/a">Catalog pumps</a> <a href="/c/b">Catalog valves</a> <a href="/c/c">Catalog meters</a> <a href="/c/d">Sensors</a></div>'
 WHEN 1 THEN '<section class="live">Live match 2:1 continues after the qualifier 1:0 tonight</section><script async src="https://pagead2.googlesyndication.com/adsbygoogle.js"></script><div class="promo">Get what nobody needs, today and tomorrow and ever</div>'
 WHEN 2 THEN '<section class="faq content" itemscope itemtype="https://schema.org/FAQPage"><h2 itemprop="name">Frequently asked things</h2><p itemprop="text">How long does it take to read all of this page aloud, and who listens</p></section>'
 WHEN 3 THEN '<aside class="sidebar filter"><a href="/f/1">Red</a> <a href="/f/2">Green ones</a> <a href="/f/3">Blue ones</a> choose a colour from this list</aside><div class="site-header"><a href="/">Start</a> <a href="/x">Other pages</a> <a href="/y">More of them</a></div>'
 WHEN 4 THEN '<div class="content"><h2>Pumps and valves</h2><div class="text">{_PROSE}</div></div>'
 WHEN 5 THEN '<div class="reviews" typeof="schema:Review"><span property="schema:name">A fine machine</span> Customers gave a high rating to it, see below</div><div class="legal-note">All of our policy and the terms apply to each order</div>'
 WHEN 6 THEN '<div class="box">Sign up to hear more of it, it costs you nothing</div><div class="box">You may also like these other ones that we keep</div><div class="catalog-list"><a href="/1">One</a> <a href="/2">Two</a> three things in one category of ours</div>'
 WHEN 7 THEN '<div itemscope itemtype="https://schema.org/Organization https://schema.org/LocalBusiness"><span itemprop="name legalName">ACME ' || CAST(page_id AS {{S}}) || '</span><div itemprop="address" itemscope itemtype="https://schema.org/PostalAddress"><span itemprop="streetAddress">Main street 5</span><meta itemprop="name" content="Head office"></div><a itemprop="url" href="https://acme.example.com/">our own page there</a></div>'
 ELSE '<div class="product-card">The price of this product is low and the cart is empty, buy it before it is gone for good, or come again next week for more</div><div class="contacts">Write to us@example.com or +49 30 1234567 on any day of the week</div>' END"""


def block_pages(spark, sf_dir) -> DataFrame:
    """The pages with further blocks before their footers."""
    return table(spark, sf_dir, "pages").select("page_id", F.expr(f"replace(html, '<footer>', concat({_MORE.format(S='STRING')}, '<footer>'))").alias("html"))


_PLAIN = "replace(replace(replace(regexp_replace(t, '&amp;?', '&', 'g'), '&copy;', '©'), '&middot;', '·'), '&quot;', '\"')"
_ATTR = "coalesce(nullif(regexp_extract(t, ' {0}=\"([^\"]*)\"', 1), ''), '')"
_BLOCK_TAGS = "('main', 'article', 'section', 'div', 'nav', 'header', 'footer', 'aside', 'menu')"

#: Tokens of a page with what has gone before them: characters, links and nodes.
_TOKENS = f"""bp AS (SELECT page_id, replace(html, '<footer>', {_MORE.format(S="VARCHAR")} || '<footer>') AS html FROM pages),
tl AS (SELECT page_id, regexp_extract_all(html, '(?s)<!--.*?-->|<script[^>]*>.*?</script>|<style.*?</style>|<![^>]*>|</?[a-zA-Z][^>]*>|[^<]+') AS l FROM bp),
tk AS (SELECT page_id, unnest(l) AS t, generate_subscripts(l, 1) AS i FROM tl),
tt AS (SELECT page_id, t, i, CASE WHEN t LIKE '<!%' THEN 'skip' WHEN t LIKE '<script%' OR t LIKE '<style%' THEN 'code' WHEN t LIKE '</%' THEN 'close' WHEN t LIKE '<%' THEN 'open' ELSE 'text' END AS k,
 lower(regexp_extract(t, '^</?([a-zA-Z0-9]+)', 1)) AS tag, CASE WHEN t LIKE '<%' THEN '' ELSE trim(regexp_replace({_PLAIN}, '\\s+', ' ', 'g')) END AS run FROM tk),
tw AS (SELECT *, CASE k WHEN 'open' THEN 1 WHEN 'code' THEN CASE WHEN regexp_matches(t, '^<[^>]*></') THEN 1 ELSE 2 END WHEN 'text' THEN CASE WHEN run = '' THEN 0 ELSE 1 END ELSE 0 END AS weight FROM tt),
ta AS (SELECT *, CAST(sum(CASE WHEN run = '' THEN 0 ELSE length(run) + 1 END) OVER o AS BIGINT) AS at_, CAST(sum(CASE WHEN k = 'open' AND tag = 'a' AND t LIKE '% href=%' THEN 1 ELSE 0 END) OVER o AS BIGINT) AS links_at,
 CAST(sum(weight) OVER o - weight AS BIGINT) AS pos FROM tw WINDOW o AS (PARTITION BY page_id ORDER BY i ROWS UNBOUNDED PRECEDING)),
pt AS (SELECT page_id, string_agg(run, ' ' ORDER BY i) AS page_text FROM ta WHERE run <> '' GROUP BY page_id)"""


def _intervals(name: str, tags: str, by_tag: bool = False) -> str:
    """Opening tags with what has gone by when they are closed: the next tag of the same level."""
    part = "page_id, tag" if by_tag else "page_id"
    return f"""{name}l AS (SELECT *, sum(CASE k WHEN 'open' THEN 1 ELSE -1 END) OVER (PARTITION BY {part} ORDER BY i) + CASE k WHEN 'open' THEN 0 ELSE 1 END AS level FROM ta WHERE k IN ('open', 'close') AND tag IN {tags}),
{name} AS (SELECT * FROM (SELECT *, lead(at_) OVER w AS till, lead(links_at) OVER w AS links_till, lead(pos) OVER w - 1 AS leave FROM {name}l WINDOW w AS (PARTITION BY {part}, level ORDER BY i)) WHERE k = 'open')"""


_RULES = [
    (f"ad_page AND (len(list_filter({K.AD_NAMES}, lambda m: contains(names, m))) > 0 OR len(list_filter({K.AD_MARKS}, lambda m: contains(low, m))) > 0)", "ads", 0.92),
    ("regexp_matches(low, '{LIVE}') AND (density >= 0.12 OR n <= 140)", "live_scores", 0.84),
    ("regexp_matches(names, '{HEADER_HINT}') AND density > 0.2", "header", 0.8),
    ("regexp_matches(names, '{SIDEBAR_HINT}') AND density > 0.18", "sidebar", 0.8),
    ("tag = 'footer'", "footer", 0.86),
    ("tag IN ('nav', 'menu', 'header', 'aside')", "nav", 0.85),
    ("regexp_matches(names, '{NAV_HINT}') AND density >= 0.5 AND text_density < 0.2", "nav", 0.93),
    ("density > 0.58 AND text_density < 0.22", "nav", 0.82),
    ("regexp_matches(names, '{CATEGORY}') AND density >= 0.2", "category", 0.78),
    ("regexp_matches(names, '{REVIEW}') OR regexp_matches(low, '{REVIEW}')", "reviews", 0.76),
    ("regexp_matches(names, '{FAQ}') OR regexp_matches(low, '{FAQ}')", "faq", 0.78),
    ("regexp_matches(names, '{PRODUCT}') OR (regexp_matches(low, '{PRODUCT}') AND n >= 20)", "product", 0.77),
    ("regexp_matches(names, '{LEGAL}') OR regexp_matches(low, '{LEGAL}')", "legal", 0.8),
    ("regexp_matches(low, '{CTA}')", "cta", 0.75),
    ("regexp_matches(low, '{NOISE}')", "noise", 0.72),
    ("regexp_matches(names, '{UTILITY}') OR regexp_matches(low, '{UTILITY}') OR regexp_matches(low, '{EMAIL}') OR regexp_matches(low, '{PHONE}')", "utility", 0.8),
    ("n < 18", "utility", 0.64),
]
_NAMED = {k: getattr(K, k) for k in ("LIVE", "HEADER_HINT", "SIDEBAR_HINT", "NAV_HINT", "CATEGORY", "REVIEW", "FAQ", "PRODUCT", "LEGAL", "CTA", "NOISE", "UTILITY", "EMAIL", "PHONE")}


def _rule(when: str) -> str:
    for k, v in _NAMED.items():
        when = when.replace(f"{{{k}}}", v)
    return when


_W = "regexp_extract_all(lower({0}), '[a-zа-я0-9]+')"


def _cases(values: list[str], other: str) -> str:
    return "CASE " + " ".join(f"WHEN {_rule(w)} THEN {v}" for (w, _, _), v in zip(_RULES, values, strict=True)) + f" ELSE {other} END"


_SEGMENTS = f"""{_intervals("bl", _BLOCK_TAGS)},
c1 AS (SELECT bl.*, level + 2 AS depth, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS idx, count(*) OVER (PARTITION BY page_id) AS candidates, greatest(till - at_ - 1, 0) AS chars, links_till - links_at AS links,
 trim(regexp_replace(lower({_ATTR.format("class")}), '\\s+', ' ', 'g')) AS classes FROM bl),
c2 AS (SELECT c1.*, substr(page_text, at_ + 1, chars) AS raw FROM c1 JOIN pt USING (page_id) WHERE chars >= 35),
c3 AS (SELECT *, {_W.format("raw")} AS w, lower(raw) AS low FROM c2 QUALIFY row_number() OVER (PARTITION BY page_id, substr(raw, 1, 1500) ORDER BY i) = 1),
ad AS (SELECT DISTINCT page_id, TRUE AS ad_page FROM ta WHERE (k = 'code' AND t LIKE '<script%' AND len(list_filter({K.AD_MARKS}, lambda m: contains(lower(t), m))) > 0) OR regexp_matches(t, '^<(script|iframe)[^>]* src="[^"]*{K.AD_DOMAINS}')),
c4 AS (SELECT c3.*, len(w) AS n, links / greatest(1, len(w))::DOUBLE AS density, {R("len(w) / greatest(1, chars)::DOUBLE", 4)} AS text_density, {R("len(list_distinct(w)) / greatest(1, len(w))::DOUBLE", 4)} AS unique_score,
 lower({_ATTR.format("id")}) || ' ' || classes || ' ' || tag AS names, coalesce(ad_page, FALSE) AS ad_page,
 CASE WHEN tag = 'section' AND list_contains(string_split(classes, ' '), 'content') THEN 'section.content' WHEN tag = 'div' AND list_contains(string_split(classes, ' '), 'content') THEN 'div.content' WHEN tag = 'div' AND list_contains(string_split(classes, ' '), 'article') THEN 'div.article'
  WHEN tag = 'div' AND list_contains(string_split(classes, ' '), 'text') THEN 'div.text' WHEN tag = 'div' AND list_contains(string_split(classes, ' '), 'description') THEN 'div.description' ELSE tag END AS selector,
 {_ATTR.format("itemtype")} <> '' OR {_ATTR.format("typeof")} <> '' AS schema_hint, array_to_string(w[1:16], ' ') AS begins FROM c3 LEFT JOIN ad USING (page_id)),
c5 AS (SELECT *, {R("density", 4)} AS link_density, greatest(0.2, 1.0 - least(0.7, abs(depth - 8) / 14.0::DOUBLE))::DOUBLE AS depth_weight, greatest(0.15::DOUBLE, 1.0 - abs(idx / greatest(1, candidates - 1)::DOUBLE - 0.45::DOUBLE) * 1.4::DOUBLE) AS position_weight,
 least(1.0, (row_number() OVER (PARTITION BY page_id, begins ORDER BY i) - 1) / 4.0)::DOUBLE AS repetition_score,
 CASE selector WHEN 'main' THEN 1.0 WHEN 'article' THEN 1.0 WHEN 'section.content' THEN 1.0 WHEN 'div.content' THEN 1.0 WHEN 'div.article' THEN 1.0 WHEN 'section' THEN 0.7 WHEN 'div.text' THEN 0.7 WHEN 'div.description' THEN 0.7 WHEN 'header' THEN 0.2 WHEN 'footer' THEN 0.2 WHEN 'nav' THEN 0.15 WHEN 'aside' THEN 0.15 WHEN 'menu' THEN 0.1 ELSE 0.55 END::DOUBLE AS priority,
 {_cases([f"'{k}'" for _, k, _ in _RULES], "'main'")} AS type, {_cases([f"{c}::DOUBLE" for _, _, c in _RULES], "0.7::DOUBLE")} AS confidence, regexp_matches(names, '{K.NAV_HINT}') AS mega FROM c4),
c6 AS (SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, least(1.0::DOUBLE, n / 220.0::DOUBLE) * 0.30::DOUBLE + (1.0::DOUBLE - least(1.0::DOUBLE, link_density)) * 0.22::DOUBLE + priority * 0.17::DOUBLE + position_weight * 0.08::DOUBLE + unique_score * 0.08::DOUBLE + depth_weight * 0.08::DOUBLE + CASE WHEN schema_hint THEN 1.0 ELSE 0.55 END::DOUBLE * 0.07::DOUBLE)) AS score FROM c5),
sg AS (SELECT *, CASE WHEN type IN ('nav', 'footer', 'header', 'sidebar', 'category') THEN 'navigation' WHEN type IN ('ads', 'live_scores', 'noise') THEN 'boilerplate' WHEN type IN ('utility', 'cta', 'legal') THEN 'utility' WHEN score >= 0.62 AND n >= 70 THEN 'main' ELSE 'supporting' END AS segment_class FROM c6)"""


@query(
    f"""WITH {_TOKENS}, {_SEGMENTS}
SELECT page_id, CAST(pos AS INTEGER) AS pos, type, segment_class, selector, tag, chars, CAST(n AS INTEGER) AS words, links, link_density, text_density, {R("priority", 3)} AS priority, {R("score", 4)} AS block_score, {R("position_weight", 4)} AS position_weight, unique_score, {R("repetition_score", 4)} AS repetition_score,
 CAST(depth AS INTEGER) AS depth, {R("depth_weight", 4)} AS depth_weight, schema_hint, confidence, mega, md5(raw) AS text_md5 FROM sg"""
)
def h21_blocks(spark, sf_dir):
    """Blocks of each page: type of 15, class of 5, score and its parts."""
    s = K.segments(K.nodes(block_pages(spark, sf_dir)))
    return s.withColumn("text_md5", F.md5("text")).drop("text")


def _terms(x: str, least: int = 3) -> str:
    return f"list_distinct(list_filter({_W.format(x)}, lambda y: length(y) >= {least} AND NOT list_contains({K.STOP}, y)))"


def _semantic(x: str) -> str:
    return f"CASE WHEN len({_W.format(x)}) = 0 THEN 0.0 ELSE {R(f'len({_terms(x, 4)}) / greatest(1, len({_W.format(x)}))::DOUBLE', 4)} END"


def _linkish(x: str) -> str:
    w = _W.format(x)
    return f"CASE WHEN len({w}) = 0 THEN 1.0 ELSE least(1.0::DOUBLE, (len(list_filter({w}, lambda y: list_contains({K.LINKISH}, y))) + 2 * len(regexp_extract_all(lower({x}), '(?:https?://|www\\.|/[a-z0-9_\\-]{{2,}})'))) / len({w})::DOUBLE * 3.0::DOUBLE) END"


def _quality(x: str) -> str:
    w, both = _W.format(x), f"len(list_intersect({_terms(x)}, headings))"
    overlap = f"CASE WHEN len(headings) = 0 OR len({_terms(x)}) = 0 THEN 0.0 ELSE {R(f'{both} / greatest(1, len(headings))::DOUBLE', 4)} END"
    score = f"0.30::DOUBLE * least(1.0::DOUBLE, len({w}) / 900.0::DOUBLE) + 0.25::DOUBLE * {_semantic(x)} + 0.20::DOUBLE * {overlap} + 0.15::DOUBLE * (1.0::DOUBLE - {_linkish(x)}) + 0.10::DOUBLE * {R(f'len(list_distinct({w})) / greatest(1, len({w}))::DOUBLE', 4)}"
    return f"CASE WHEN len({w}) = 0 THEN 0.0 ELSE {R(score, 4)} END"


def _compare(a: str, b: str) -> str:
    both = f"len(list_intersect(t_{a}, t_{b}))"
    value = f"CASE WHEN len(t_{a}) = 0 OR len(t_{b}) = 0 THEN 0.0 ELSE {both} / greatest(1, len(t_{a}) + len(t_{b}) - {both})::DOUBLE END"
    return f"CASE WHEN n_{a} >= 40 AND n_{b} >= 40 THEN {value} END"


_TEXTS = ["page_text", "dom_main", "heading_based", "landmark"]
_PAIRS = [_compare(a, b) for i, a in enumerate(_TEXTS) for b in _TEXTS[i + 1 :]]
_COUNT = "len(" + _W + ")"


def _of(x: str, n: int = 4, k: str = "") -> str:
    return R(f"{x} / greatest(1, total)::DOUBLE{k}", n)


def _chars_of(when: str) -> str:
    return f"coalesce(sum(chars) FILTER ({when}), 0)"


_PAGE = f"""{_intervals("hh", "('h1', 'h2', 'h3')", True)}, {_intervals("pp", "('p', 'li')", True)},
he AS (SELECT page_id, i, tag, substr(page_text, at_ + 1, greatest(coalesce(till, article_till) - at_ - 1, 0)) AS x FROM (SELECT page_id, i, tag, at_, till FROM hh UNION ALL SELECT page_id, i, tag, at_, till FROM pp) LEFT JOIN (SELECT page_id, till AS article_till FROM bl WHERE tag = 'article') USING (page_id) JOIN pt USING (page_id)),
hb AS (SELECT page_id, coalesce(string_agg(x, ' ' ORDER BY i) FILTER ((tag IN ('h1', 'h2', 'h3') AND x <> '') OR (tag IN ('p', 'li') AND length(x) >= 60)), '') AS heading_based, {_terms("coalesce(string_agg(x, ' ' ORDER BY i) FILTER (tag IN ('h1', 'h2')), '')")} AS headings FROM he GROUP BY 1),
lm AS (SELECT page_id, string_agg(x, ' ' ORDER BY i) AS landmark FROM (SELECT page_id, i, substr(page_text, at_ + 1, chars) AS x FROM c1 JOIN pt USING (page_id) WHERE tag IN ('main', 'article') OR (tag IN ('section', 'div') AND list_contains(string_split(classes, ' '), 'content')) OR (tag = 'div' AND list_contains(string_split(classes, ' '), 'article'))) WHERE {_COUNT.format("x")} >= 30 GROUP BY 1),
by_ AS (SELECT page_id, count(*) AS segments, sum(chars) AS total, {", ".join(f"{_chars_of(f'segment_class = {k!r}')} AS {k}_class" for k in ("main", "supporting", "navigation", "utility", "boilerplate"))},
 {", ".join(f"{_chars_of(f'type IN {k}')} AS {n}_type" for n, k in (("main", "('main')"), ("ads", "('ads')"), ("live", "('live_scores')"), ("nav", "('nav', 'footer')"), ("utility", "('utility')")))},
 coalesce(sum(links) FILTER (type = 'nav'), 0) AS nav_links, sum(links) AS all_links, coalesce(bool_or(mega AND type = 'nav'), FALSE) AS mega_menu, count(*) FILTER (type = 'utility') AS utility_blocks,
 string_agg(raw, ' ' ORDER BY i) FILTER (segment_class = 'main' AND priority >= 0.55) AS dom_main, string_agg(raw, ' ' ORDER BY i) FILTER (segment_class = 'supporting') AS dom_supporting FROM sg GROUP BY 1),
q0 AS (SELECT page_id, page_text, coalesce(segments, 0) AS segments, coalesce(total, 0) AS total, {", ".join(f"coalesce({x}, 0) AS {x}" for x in [*(f"{k}_class" for k in ("main", "supporting", "navigation", "utility", "boilerplate")), *(f"{k}_type" for k in ("main", "ads", "live", "nav", "utility")), "nav_links", "all_links", "utility_blocks"])},
 coalesce(mega_menu, FALSE) AS mega_menu, coalesce(dom_main, '') AS dom_main, coalesce(dom_supporting, '') AS dom_supporting, coalesce(heading_based, '') AS heading_based, coalesce(headings, []) AS headings, coalesce(landmark, '') AS landmark FROM pt LEFT JOIN by_ USING (page_id) LEFT JOIN hb USING (page_id) LEFT JOIN lm USING (page_id)),
q1 AS (SELECT *, {", ".join(f"{_COUNT.format(x)} AS n_{x}" for x in [*_TEXTS, "dom_supporting"])}, {", ".join(f"{_terms(x)} AS t_{x}" for x in _TEXTS)}, {_quality("dom_main")} AS q_dom, {_quality("heading_based")} AS q_head, {_quality("landmark")} AS q_land FROM q0),
q2 AS (SELECT *, list_filter([{", ".join(_PAIRS)}], lambda x: x IS NOT NULL) AS pairs, greatest(q_dom, q_head, q_land) AS best, greatest({", ".join(f"CASE WHEN n_{x} >= 60 THEN n_{x} ELSE 0 END" for x in _TEXTS)}) AS longest FROM q1),
q3 AS (SELECT *, {R("coalesce(list_sum(pairs), 0.0) / greatest(1, len(pairs))::DOUBLE", 4)} AS agreement, CASE WHEN q_dom = best THEN 'dom_density' WHEN q_head = best THEN 'heading_based' ELSE 'semantic_landmark' END AS primary_extractor,
 CASE longest WHEN 0 THEN NULL {" ".join(f"WHEN n_{x} THEN {x}" for x in _TEXTS)} END AS fallback FROM q2),
q4 AS (SELECT *, CASE WHEN dom_main <> '' THEN dom_main ELSE coalesce(fallback, page_text) END AS m1, CASE primary_extractor WHEN 'dom_density' THEN dom_main WHEN 'heading_based' THEN heading_based ELSE landmark END AS chosen FROM q3),
q5 AS (SELECT *, CASE WHEN {_COUNT.format("m1")} < 80 AND n_dom_supporting >= 80 THEN trim(m1 || ' ' || dom_supporting) ELSE m1 END AS m2 FROM q4),
q6 AS (SELECT *, CASE WHEN {_COUNT.format("m2")} < 60 AND fallback IS NOT NULL THEN fallback ELSE m2 END AS m3 FROM q5),
q7 AS (SELECT *, CASE WHEN {_COUNT.format("chosen")} >= 70 AND {_COUNT.format("chosen")} >= {_COUNT.format("m3")} THEN chosen ELSE m3 END AS m FROM q6),
q8 AS (SELECT *, {R("length(m) / greatest(1, length(page_text))::DOUBLE", 4)} AS ratio, {R(f"{_COUNT.format('m')} / greatest(1, length(m))::DOUBLE", 4)} AS density FROM q7),
q9 AS (SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, agreement * 0.45::DOUBLE + least(1.0::DOUBLE, density / 0.24::DOUBLE) * 0.25::DOUBLE + least(1.0::DOUBLE, {_semantic("m")} * 2.2::DOUBLE) * 0.2::DOUBLE + least(1.0::DOUBLE, ratio / 0.6::DOUBLE) * 0.1::DOUBLE)) AS sure FROM q8)"""


@query(
    f"""WITH {_TOKENS}, {_SEGMENTS}, {_PAGE}
SELECT page_id, segments, {", ".join(f"{_of(f'{k}_class')} AS {k}_ratio" for k in ("main", "supporting", "navigation", "utility", "boilerplate"))}, {", ".join(f"{_of(f'{k}_type', 2, ' * 100.0::DOUBLE')} AS {k}_pct" for k in ("main", "ads", "live", "nav", "utility"))},
 {R("nav_links / greatest(1, all_links)::DOUBLE", 4)} AS nav_link_ratio, mega_menu, utility_blocks, agreement AS extractor_agreement, primary_extractor, length(m) AS main_chars, ratio AS main_text_ratio, {R("sure", 4)} AS confidence,
 CASE WHEN sure >= 0.75 THEN 'high' WHEN sure >= 0.5 THEN 'medium' ELSE 'low' END AS level,
 array_to_string(list_filter([CASE WHEN agreement < 0.35 THEN 'low_agreement' END, CASE WHEN {_of("nav_type", 2, " * 100.0::DOUBLE")} >= 45 THEN 'much_navigation' END, CASE WHEN {_of("main_type", 2, " * 100.0::DOUBLE")} < 25 THEN 'little_main' END, CASE WHEN {_COUNT.format("m")} < 80 THEN 'short_main' END], lambda x: x IS NOT NULL), ',') AS reasons,
 {R("least(1.0::DOUBLE, agreement * 0.45::DOUBLE + best * 0.55::DOUBLE)", 4)} AS extraction_confidence FROM q9"""
)
def h21_segmentation(spark, sf_dir):
    """Shares of a page's text by class and type, agreement of four extractors, and confidence."""
    return K.segmentation(K.nodes(block_pages(spark, sf_dir)))


# --- things of the markup

_SCOPES = f"""{_intervals("el", "('div', 'section', 'span', 'h2', 'a')")},
vo AS (SELECT page_id, i, t, tag, pos, at_, at_ AS till, pos AS leave FROM ta WHERE k = 'open' AND tag = 'meta' AND t LIKE '% itemprop=%'),
ea AS (SELECT page_id, t, tag, pos, at_, till, leave FROM el UNION ALL SELECT page_id, t, tag, pos, at_, till, leave FROM vo UNION ALL SELECT page_id, t, tag, pos, at_, till, leave FROM p_ WHERE t LIKE '% itemprop=%'),
en AS (SELECT page_id, pos, leave, t LIKE '% itemscope%' AS scoped, t LIKE '% typeof=%' AS typed, {_ATTR.format("itemtype")} AS itemtype, {_ATTR.format("typeof")} AS typeof, {_ATTR.format("itemprop")} AS itemprop, {_ATTR.format("property")} AS property,
 CASE WHEN {_ATTR.format("content")} <> '' THEN {_ATTR.format("content")} WHEN {_ATTR.format("href")} <> '' THEN {_ATTR.format("href")} ELSE substr(page_text, at_ + 1, greatest(till - at_ - 1, 0)) END AS said,
 CASE WHEN {_ATTR.format("content")} <> '' THEN {_ATTR.format("content")} ELSE substr(page_text, at_ + 1, greatest(till - at_ - 1, 0)) END AS named FROM ea JOIN pt USING (page_id))"""
_THINGS = f"{_TOKENS}, {_intervals('p_', chr(40) + repr('p') + chr(41))}, {_SCOPES}"
_TYPES = "list_transform(string_split({0}, ' '), lambda x: regexp_replace(x, '^.*[/#:]', ''))"


@query(
    f"""WITH {_THINGS}, x AS (SELECT *, 'microdata' AS syntax, itemtype AS kind, itemprop AS prop FROM en WHERE scoped UNION ALL SELECT *, 'rdfa', typeof, property FROM en WHERE typed)
SELECT x.page_id, CAST(x.pos AS INTEGER) AS item, x.syntax, array_to_string(CASE WHEN x.kind = '' THEN [] ELSE {_TYPES.format("x.kind")} END, ',') AS types, CAST(max(o.pos) AS INTEGER) AS within, nullif(any_value(x.prop), '') AS as_property
FROM x LEFT JOIN x o ON o.page_id = x.page_id AND o.syntax = x.syntax AND o.pos < x.pos AND o.leave >= x.leave GROUP BY x.page_id, x.pos, x.syntax, x.kind"""
)
def h19_dom_items(spark, sf_dir):
    """Things of microdata and RDFa with their types, and the thing they stand in."""
    items = K.dom_items(K.nodes(block_pages(spark, sf_dir)))
    return items.withColumn("types", F.array_join("types", ","))


@query(
    f"""WITH {_THINGS}, x AS (SELECT *, 'microdata' AS syntax, itemprop AS prop, scoped AS opens FROM en WHERE itemprop <> '' UNION ALL SELECT *, 'rdfa', property, typed FROM en WHERE property <> ''),
o AS (SELECT page_id, pos, leave, 'microdata' AS syntax FROM en WHERE scoped UNION ALL SELECT page_id, pos, leave, 'rdfa' FROM en WHERE typed),
j AS (SELECT x.page_id, x.syntax, x.pos, prop, said, opens, max(o.pos) AS item FROM x JOIN o ON o.page_id = x.page_id AND o.syntax = x.syntax AND o.pos < x.pos AND o.leave >= x.leave GROUP BY ALL)
SELECT page_id, CAST(item AS INTEGER) AS item, syntax, CAST(pos AS INTEGER) AS pos, unnest(string_split(prop, ' ')) AS property, CASE WHEN NOT opens THEN said END AS value, CASE WHEN opens THEN CAST(pos AS INTEGER) END AS nested FROM j"""
)
def h19_dom_properties(spark, sf_dir):
    """Each property with the nearest thing around it, and its value or the thing that is its value."""
    return K.dom_properties(K.nodes(block_pages(spark, sf_dir)))


@query(
    f"""WITH {_THINGS}, x AS (SELECT *, 'microdata' AS syntax, itemtype AS kind FROM en WHERE itemtype <> '' UNION ALL SELECT *, 'rdfa', typeof FROM en WHERE typeof <> ''),
p AS (SELECT page_id, pos, named, 'microdata' AS syntax FROM en WHERE lower(itemprop) IN ('name', 'legalname', 'alternatename', 'headline', 'title') AND named <> '' UNION ALL SELECT page_id, pos, named, 'rdfa' FROM en WHERE lower(property) IN ('name', 'schema:name', 'headline', 'title') AND named <> ''),
j AS (SELECT x.page_id, x.pos, x.syntax, x.kind, x.named AS own, list(DISTINCT p.named) FILTER (p.pos IS NOT NULL) AS names FROM x LEFT JOIN p ON p.page_id = x.page_id AND p.syntax = x.syntax AND p.pos > x.pos AND p.pos <= x.leave GROUP BY ALL),
k AS (SELECT DISTINCT page_id, pos, syntax, unnest({_TYPES.format("kind")}) AS type, CASE WHEN len(names) > 0 THEN names WHEN own <> '' THEN [own] ELSE [] END AS names FROM j)
SELECT page_id, CAST(pos AS INTEGER) AS item, syntax, type, unnest(names) AS name FROM k"""
)
def h19_dom_entities(spark, sf_dir):
    """Names of the typed things of the markup."""
    return K.dom_entities(K.nodes(block_pages(spark, sf_dir)))
