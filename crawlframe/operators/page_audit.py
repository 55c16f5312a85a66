"""Page audit: features of each page from its markup, headers and text, and the catalogues of rules on top of them.

Features are patterns over a page's markup, so a page costs one pass and nothing is shuffled. Rules and scores are conditions
over named features; the names are the interface, and a user may add features and rules of their own.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlframe.functions import text as T
from crawlframe.functions.rules import Rule
from crawlframe.operators import html as H

_Q = "[\"']"


def _tag(name: str, attribute: str, value: str) -> str:
    return rf"(?is)<{name}[^>]*\s{attribute}\s*=\s*{_Q}{value}{_Q}[^>]*>"


def _meta(name: str) -> str:
    return _tag("meta", "(?:name|property)", name)


@dataclass
class Count:
    """How often a pattern stands in a part of the page: html, bare (without scripts, styles, comments) or head."""

    pattern: str
    part: str = "html"


@dataclass
class Value:
    """An attribute of the first tag that a pattern finds; empty if there is none."""

    pattern: str
    attribute: str = "content"


_IMG_ALT = r"(?is)<img[^>]*\salt\s*=\s*" + _Q
_DECORATIVE = rf"(?:role\s*=\s*{_Q}presentation|aria-hidden\s*=\s*{_Q}true)"
FEATURES: dict[str, Count | Value] = {
    "title_tags": Count(r"(?i)<title[\s>]"),
    "description_tags": Count(_meta("description")),
    "description": Value(_meta("description")),
    "robots_tags": Count(_meta("robots")),
    "robots": Value(_meta("robots")),
    "viewport": Value(_meta("viewport")),
    "charset_tags": Count(r"(?i)<meta[^>]*charset\s*="),
    "canonical": Value(_tag("link", "rel", "canonical"), "href"),
    "html_lang": Value(r"(?is)<html[^>]*>", "lang"),
    "author": Value(_meta("(?:author|article:author|og:author)")),
    "date": Value(_meta("(?:date|pubdate|publish_date|article:published_time|article:modified_time)")),
    "hreflang": Count(_tag("link", "hreflang", f"[^\"']*")),
    "og_tags": Count(_meta("og:[^\"']*")),
    "og_title": Value(_meta("og:title")),
    "og_description": Value(_meta("og:description")),
    "og_type": Value(_meta("og:type")),
    "og_url": Value(_meta("og:url")),
    "og_image": Value(_meta("og:image")),
    "twitter_tags": Count(_meta("twitter:[^\"']*")),
    "twitter_card": Value(_meta("twitter:card")),
    "twitter_title": Value(_meta("twitter:title")),
    "twitter_image": Value(_meta("twitter:image")),
    "json_ld": Count(rf"(?is)<script[^>]*type\s*=\s*{_Q}application/ld\+json"),
    "microdata": Count(r"(?is)<[a-z][^>]*\sitemtype\s*=", "bare"),
    "rdfa": Count(r"(?is)<[a-z][^>]*\stypeof\s*=", "bare"),
    **{f"h{i}": Count(rf"(?i)<h{i}[\s>]", "bare") for i in range(1, 7)},
    "images": Count(r"(?i)<img[\s>]", "bare"),
    "images_with_alt": Count(_IMG_ALT + r"\s*[^\"'\s]", "bare"),
    "generic_alt": Count(_IMG_ALT + rf"\s*(?:image|photo|picture|img|фото|картинка)\s*{_Q}", "bare"),
    "decorative_before": Count(rf"(?is)<img[^>]*\s{_DECORATIVE}[^>]*\salt\s*=\s*{_Q}[^\"']", "bare"),
    "decorative_after": Count(_IMG_ALT + rf"[^\"'][^>]*\s{_DECORATIVE}", "bare"),
    "modern_images": Count(rf"(?is)<img[^>]*\ssrc\s*=\s*{_Q}[^\"']*\.(?:webp|avif)[\"'?#]", "bare"),
    "lazy_images": Count(rf"(?is)<img[^>]*\sloading\s*=\s*{_Q}lazy", "bare"),
    "lists": Count(r"(?i)<(?:ul|ol)[\s>]", "bare"),
    "tables": Count(r"(?i)<table[\s>]", "bare"),
    "faq": Count(rf"(?is)itemtype\s*=\s*{_Q}[^\"']*FAQPage", "bare"),
    "buttons": Count(r"(?i)<(?:a|button)[\s>]", "bare"),
    "cta": Count(r"(?is)<(?:a|button)(?:\s[^>]*)?>[^<]*(?:buy|order|contact|sign|register)[^<]*<", "bare"),
    "good_cta": Count(r"(?is)<(?:a|button)(?:\s[^>]*)?>[^<]*(?:buy|start|contact|book|sign|register|learn more)[^<]*<", "bare"),
    "deprecated": Count(r"(?i)<(?:font|center|marquee|blink)[\s>]", "bare"),
    "semantic_tags": Count(r"(?i)<(?:main|article|section|aside|nav|header|footer)[\s>]", "bare"),
    "main_tags": Count(r"(?i)<main[\s>]", "bare"),
    "scripts": Count(r"(?i)<script[\s>]"),
    "script_files": Count(r"(?is)<script[^>]*\ssrc\s*="),
    "stylesheets": Count(_tag("link", "rel", "stylesheet")),
    "preloads": Count(_tag("link", "rel", "preload")),
    "head_script_files": Count(r"(?is)<script[^>]*\ssrc\s*=", "head"),
    "deferred_before": Count(r"(?is)<script[^>]*\s(?:async|defer)(?:[\s=][^>]*)?\ssrc\s*=", "head"),
    "deferred_after": Count(r"(?is)<script[^>]*\ssrc\s*=[^>]*\s(?:async|defer)[\s=>]", "head"),
    "elements": Count(r"<[a-zA-Z]", "bare"),
    "links": Count(r"(?is)<a\s[^>]*href\s*=", "bare"),
    "nofollow_links": Count(rf"(?is)<a\s[^>]*rel\s*=\s*{_Q}[^\"']*nofollow", "bare"),
    "external_links": Count(rf"(?is)<a\s[^>]*href\s*=\s*{_Q}https?://", "bare"),
    "empty_anchors": Count(r"(?is)<a\s[^>]*href[^>]*>\s*</a>", "bare"),
    "insecure_resources": Count(rf"(?i)(?:src|href)\s*=\s*{_Q}http://"),
}
#: Headers whose presence is asked for, by feature.
HEADERS = {
    "content_encoding": "content-encoding",
    "cache_control": "cache-control",
    "etag": "etag",
    "expires": "expires",
    "x_robots": "x-robots-tag",
    "csp": "content-security-policy",
    "hsts": "strict-transport-security",
    "frame_options": "x-frame-options",
    "referrer_policy": "referrer-policy",
    "permissions_policy": "permissions-policy",
}
SRC = rf"(?is)<img[^>]*\ssrc\s*=\s*{_Q}([^\"']*)"
HEADING = r"(?is)<h[1-6](?:\s[^>]*)?>[^<]*"

# Points of risk, penalties and bands.
#: Features that follow from the others, in ANSI SQL and in the order in which they are worked.
DERIVED = {
    "decorative_alt": "decorative_before + decorative_after",
    "images_no_alt": "images - images_with_alt",
    "blocking_scripts": "head_script_files - deferred_before - deferred_after",
    "internal_links": "links - external_links",
    "compressed": "content_encoding <> ''",
    "cached": "cache_control LIKE '%max-age%' OR etag <> '' OR expires <> ''",
    "https": "lower(url) LIKE 'https://%'",
    "noindex": "lower(robots) LIKE '%noindex%'",
    "budget_risk": "CASE WHEN params >= 3 OR depth >= 5 THEN 'high' WHEN params >= 1 OR depth >= 3 THEN 'medium' ELSE 'low' END",
    "perf_light": "floor(greatest(0e0, least(100e0, 100e0 - greatest(0e0, (ms - 800) / 120e0) - greatest(0e0, (bytes / 1024e0 - 180e0) / 12e0) - greatest(0e0, (elements - 1800) / 220e0) - blocking_scripts * 2e0)) * 10e0 + 0.5e0) / 10e0",
    "mixed_content": "CASE WHEN lower(url) LIKE 'https://%' THEN insecure_resources ELSE 0 END",
    "security_score": "CASE WHEN csp <> '' THEN 20e0 ELSE 0e0 END + CASE WHEN hsts <> '' THEN 20e0 ELSE 0e0 END + CASE WHEN frame_options <> '' THEN 20e0 ELSE 0e0 END + CASE WHEN referrer_policy <> '' THEN 20e0 ELSE 0e0 END + CASE WHEN permissions_policy <> '' THEN 20e0 ELSE 0e0 END",
    "marker_density": "CASE WHEN words > 0 THEN floor(markers * 1000e0 / words * 100e0 + 0.5e0) / 100e0 ELSE 0e0 END",
    "ai_guard": "(page_type = 'legal' OR technical_words) AND markers <= 6",
    "ai_risk": "floor(greatest(0e0, least(100e0, (markers * 4e0 + marker_density * 2e0 + toxic_pct * 0.6e0 + filler_ratio * 35e0) * CASE WHEN ai_guard THEN 0.75e0 ELSE 1e0 END * CASE WHEN words < 120 AND markers <= 2 THEN 0.8e0 ELSE 1e0 END)) * 10e0 + 0.5e0) / 10e0",
    "canonical_status": "CASE WHEN canonical = '' THEN 'missing' WHEN canonical LIKE '%:%' AND lower(canonical) NOT LIKE 'http%' THEN 'invalid' WHEN canonical_host <> '' AND canonical_host <> host THEN 'external' WHEN canonical_key = url_key THEN 'self' ELSE 'other' END",
    "indexable": "NOT noindex AND code < 400",
    "indexability_reason": "CASE WHEN code >= 400 THEN 'http_error' WHEN noindex THEN 'meta_noindex' WHEN lower(x_robots) LIKE '%noindex%' THEN 'x_robots_noindex' WHEN canonical_status = 'external' THEN 'canonical_external' ELSE 'indexable' END",
    "trust": "least(100e0, 5e0 + CASE WHEN contact THEN 20e0 ELSE 0e0 END + CASE WHEN legal THEN 20e0 ELSE 0e0 END + CASE WHEN reviews THEN 25e0 ELSE 0e0 END + CASE WHEN badges THEN 30e0 ELSE 0e0 END)",
    "expertise": "CASE WHEN has_author THEN 18e0 ELSE 6e0 END",
    "authoritativeness": "least(30e0, 22e0 + CASE WHEN reviews THEN 8e0 ELSE 0e0 END + CASE WHEN badges THEN 5e0 ELSE 0e0 END)",
    "trustworthiness": "CASE WHEN contact AND legal THEN 30e0 WHEN contact OR legal THEN 15e0 ELSE 0e0 END",
    "experience": "CASE WHEN words >= 300 AND has_author THEN 20e0 ELSE 0e0 END",
    "eeat": "least(100e0, expertise + authoritativeness + trustworthiness + experience)",
    "cta_quality": "CASE WHEN buttons = 0 THEN 0e0 ELSE floor(good_cta * 100e0 / buttons * 10e0 + 0.5e0) / 10e0 END",
    "outline": "CASE WHEN first_level IS NOT NULL AND first_level <> 1 THEN 'wrong start' WHEN h1 = 0 THEN 'missing h1' WHEN h1 > 1 THEN 'multiple h1' WHEN level_skips > 0 THEN 'level skip' ELSE 'good' END",
}
#: Page rules: code, severity, penalty and condition.
# Codes, severities, penalties and limits of the page rules.
RULES = [
    ("http_status_error", "critical", "60", "code >= 400"),
    ("missing_title", "warning", "20", "title = ''"),
    ("multiple_title_tags", "warning", "6", "title_tags > 1"),
    ("missing_meta_description", "info", "8", "description = ''"),
    ("multiple_meta_descriptions", "warning", "4", "description_tags > 1"),
    ("missing_charset_meta", "info", "2", "charset_tags = 0"),
    ("missing_viewport_meta", "info", "2", "viewport = ''"),
    ("multiple_meta_robots", "warning", "3", "robots_tags > 1"),
    ("noindex_detected", "warning", "15", "noindex"),
    ("missing_canonical", "info", "5", "canonical = ''"),
    ("thin_content", "warning", "10", "words < 120"),
    ("light_perf_low_score", "warning", "6", "perf_light < 60"),
    ("h1_hierarchy_issue", "warning", "7", "h1 <> 1"),
    ("compression_disabled", "info", "4", "NOT compressed"),
    ("cache_disabled", "info", "3", "NOT cached"),
    ("non_https_url", "warning", "12", "NOT https"),
    ("low_modern_image_formats", "info", "2", "images > 0 AND modern_images * 100 < images * 20"),
    ("duplicate_image_sources", "info", "2", "repeated_images > 0"),
    ("generic_alt_texts", "info", "2", "generic_alt > 0"),
    ("decorative_images_with_alt", "info", "2", "decorative_alt > 0"),
    ("crawl_budget_risk_high", "warning", "4", "budget_risk = 'high'"),
    ("crawl_budget_risk_medium", "info", "1", "budget_risk = 'medium'"),
    ("structured_data_common_errors", "warning", "least(12, structured_errors * 2)", "structured_errors > 0"),
    ("ai_risk_high", "warning", "4", "ai_risk >= 70"),
    ("hidden_content_css", "warning", "least(10, greatest(2, floor(hidden_nodes / 2e0)))", "hidden_nodes > 0"),
    ("cloaking_detected", "critical", "20", "cloaked"),
    ("cta_missing", "info", "2", "cta = 0 AND page_type IN ('home', 'service', 'product', 'category')"),
    ("no_lists_tables_on_long_content", "info", "1", "words >= 600 AND lists = 0 AND tables = 0"),
]
#: Rules of a single page with its limits as settings: code, severity and condition.
# Limits, codes and penalties of the rules on a page's text and head.
LIMITS = {"words_min": 300, "title_min": 30, "title_max": 60, "description_min": 120, "description_max": 160, "h1_max": 1}
ONPAGE_RULES = [
    ("title_missing", "critical", "title = ''"),
    ("title_length_out_of_range", "warning", "title <> '' AND (length(title) < {title_min} OR length(title) > {title_max})"),
    ("description_missing", "warning", "description = ''"),
    ("description_length_out_of_range", "warning", "description <> '' AND (length(description) < {description_min} OR length(description) > {description_max})"),
    ("h1_missing", "critical", "h1 = 0"),
    ("h1_multiple", "warning", "h1 > {h1_max}"),
    ("low_word_count", "warning", "all_words < {words_min}"),
    ("top_term_spam", "critical", "top_term_pct >= 8"),
    ("top_term_repetition", "warning", "top_term_pct >= 6 AND top_term_pct < 8"),
    ("meta_noindex", "critical", "noindex"),
    ("meta_nofollow", "warning", "lower(robots) LIKE '%nofollow%'"),
    ("canonical_missing", "warning", "canonical = ''"),
    ("canonical_not_self", "warning", "canonical <> '' AND canonical_status <> 'self'"),
    ("viewport_missing", "warning", "viewport = ''"),
    ("heading_level_skips", "warning", "level_skips > 0"),
    ("duplicate_headings", "warning", "repeated_headings > 0"),
    ("schema_missing", "warning", "json_ld = 0 AND microdata = 0"),
    ("schema_invalid_jsonld", "warning", "json_ld > 0 AND valid_json_ld = 0"),
    ("opengraph_missing_required", "warning", "og_title = '' OR og_description = '' OR og_type = '' OR og_url = '' OR og_image = ''"),
    ("twitter_card_type_missing", "warning", "twitter_card = ''"),
    ("twitter_card_title_missing", "warning", "twitter_title = ''"),
    ("twitter_card_image_missing", "info", "twitter_image = ''"),
    ("images_alt_missing_critical", "critical", "images > 0 AND images_no_alt * 100 >= images * 30"),
    ("images_alt_missing", "warning", "images_no_alt > 0 AND images_no_alt * 100 < images * 30"),
    ("internal_links_missing", "warning", "internal_links = 0"),
    ("external_links_many", "warning", "external_links >= 50"),
    ("empty_anchor_links", "warning", "empty_anchors > 0"),
    ("low_lexical_diversity", "warning", "lexical_diversity < 0.25e0"),
    ("long_sentences_excess", "warning", "long_sentence_ratio > 0.35e0"),
    ("bigram_spam", "critical", "top_bigram_pct >= 4"),
    ("bigram_repetition_high", "warning", "top_bigram_pct >= 2.5e0 AND top_bigram_pct < 4"),
    ("trigram_spam", "critical", "top_trigram_pct >= 2.5e0"),
    ("trigram_repetition_high", "warning", "top_trigram_pct >= 1.6e0 AND top_trigram_pct < 2.5e0"),
    ("duplicate_sentences_high", "critical", "duplicate_sentence_ratio >= 0.2e0"),
    ("duplicate_sentences_warning", "warning", "duplicate_sentence_ratio >= 0.1e0 AND duplicate_sentence_ratio < 0.2e0"),
    ("uppercase_spam_signal", "warning", "uppercase_ratio > 0.35e0"),
    ("punctuation_spam_signal", "warning", "punctuation_ratio > 0.12e0"),
    ("stopword_ratio_low", "warning", "stopword_ratio < 0.2e0"),
    ("content_html_ratio_low", "warning", "text_html_ratio < 0.1e0"),
    ("ai_risk_high", "critical", "ai_risk >= 75"),
    ("ai_risk_elevated", "warning", "ai_risk >= 55 AND ai_risk < 75"),
    ("ai_marker_density_high", "warning", "marker_density >= 8"),
    ("template_repetition_high", "warning", "template_repetition >= 6"),
]
#: Health of a page within its site: points by condition.
# Points of a page's health within its site.
HEALTH_POINTS = [
    "CASE WHEN indexable THEN 20e0 ELSE 0e0 END",
    "CASE WHEN https THEN 5e0 ELSE 0e0 END",
    "CASE WHEN viewport <> '' THEN 5e0 ELSE 0e0 END",
    "CASE WHEN compressed THEN 4e0 ELSE 0e0 END",
    "CASE WHEN cache_control <> '' THEN 4e0 ELSE 0e0 END",
    "CASE canonical_status WHEN 'self' THEN 4e0 WHEN 'other' THEN 2e0 WHEN 'external' THEN 1e0 ELSE 0e0 END",
    "CASE WHEN ms <= 800 THEN 4e0 WHEN ms <= 1500 THEN 2e0 WHEN ms <= 3000 THEN 1e0 ELSE 0e0 END",
    "CASE WHEN json_ld + microdata + rdfa > 0 THEN 2e0 ELSE 0e0 END",
    "least(10e0, words / 300e0 * 10e0)",
    "least(8e0, unique_pct / 100e0 * 8e0)",
    "least(5e0, readability / 100e0 * 5e0)",
    "CASE WHEN toxic_pct <= 20 THEN 4e0 WHEN toxic_pct <= 40 THEN 2e0 WHEN toxic_pct <= 60 THEN 1e0 ELSE 0e0 END",
    "CASE WHEN length(title) BETWEEN 40 AND 65 THEN 5e0 WHEN length(title) BETWEEN 25 AND 75 THEN 3e0 ELSE 0e0 END",
    "CASE WHEN length(description) BETWEEN 80 AND 160 THEN 3e0 WHEN length(description) BETWEEN 50 AND 200 THEN 1e0 ELSE 0e0 END",
    "CASE WHEN h1 = 1 THEN 2e0 ELSE 0e0 END",
    "greatest(0e0, 2e0 - images_no_alt * 0.4e0)",
    "least(6e0, incoming * 1.5e0)",
    "CASE WHEN incoming > 0 THEN 2e0 ELSE 0e0 END",
    "CASE WHEN internal_links > 0 THEN 2e0 ELSE 0e0 END",
    "CASE WHEN same_title > 1 THEN -2e0 ELSE 0e0 END",
    "CASE WHEN same_description > 1 THEN -1e0 ELSE 0e0 END",
]


def header(headers: Column, name: str) -> Column:
    """A header's value, whatever the case of its name; empty if it is not there."""
    found = F.filter(F.map_entries(headers), lambda e: F.lower(e["key"]) == name)
    return F.coalesce(F.trim(F.get(found, 0)["value"]), F.lit(""))


def _feature(spec: Count | Value) -> Column:
    if isinstance(spec, Count):
        return F.regexp_count(F.col(spec.part), F.lit(spec.pattern)).cast("long")
    tag = F.regexp_extract("html", spec.pattern, 0)
    return F.trim(F.regexp_extract(tag, rf"(?is)\s{spec.attribute}\s*=\s*{_Q}([^\"']*)", 1))


def repeated(values: Column) -> Column:
    """How many different values of an array stand in it more than once."""
    return F.size(F.filter(F.array_distinct(values), lambda x: F.size(F.filter(values, lambda y: y == x)) > 1)).cast("long")


def markup_features(pages: DataFrame) -> DataFrame:
    """``pages(page_id, url, html, code, ms, headers)`` with all of FEATURES and HEADERS, title, text, hidden content, headings."""
    from crawlframe.functions import urls as U
    from crawlframe.operators import markup as M

    url = F.col("url")
    p = pages.withColumns({"bare": H.without_code(F.col("html")), "head": F.regexp_extract("html", r"(?is)<head[\s>](.*?)</head>", 1), "title": H.title(F.col("html")), "text": H.visible_text(F.col("html"))})
    levels = F.transform(F.regexp_extract_all("bare", F.lit(HEADING), F.lit(0)), lambda x: F.struct(F.substring(x, 3, 1).cast("int").alias("level"), F.trim(F.lower(F.regexp_extract(x, "(?s)>(.*)$", 1))).alias("text")))
    p = p.select("*", *[_feature(f).alias(k) for k, f in FEATURES.items()], *[header(F.col("headers"), h).alias(k) for k, h in HEADERS.items()], levels.alias("outline_rows"), M.hidden_content(F.col("html")).alias("hidden"), F.regexp_extract_all("bare", F.lit(SRC), F.lit(1)).alias("sources"))
    rows = F.col("outline_rows")
    pairs = F.zip_with(F.slice(rows, 2, 1_000_000_000), F.slice(rows, 1, F.greatest(F.lit(0), F.size(rows) - 1)), lambda b, a: b["level"] - a["level"])
    n_of = lambda x, sep: F.size(F.filter(F.split(x, sep), lambda s: s != "")).cast("long")
    return p.withColumns(
        {
            "bytes": F.octet_length("html").cast("long"),
            "params": n_of(U.query_string(url), "&"),
            "depth": n_of(U.path(url), "/"),
            "host": U.host(url),
            "url_key": U.normalised(url),
            "canonical_host": F.lower(F.regexp_extract("canonical", r"^[a-zA-Z]+://([^/?#:]*)", 1)),
            "canonical_key": U.normalised(F.when(F.col("canonical").startswith("/"), F.concat(F.regexp_extract(url, "^([a-z]+://[^/]*)", 1), "canonical")).otherwise(F.col("canonical"))),
            "first_level": F.get(rows, 0)["level"],
            "level_skips": F.size(F.filter(pairs, lambda d: d > 1)).cast("long"),
            "repeated_headings": repeated(F.transform(rows, lambda r: r["text"])),
            "repeated_images": repeated(F.col("sources")),
            "hidden_nodes": F.col("hidden.nodes").cast("long"),
            "cloaked": M.cloaking(F.col("hidden"), F.length("text")),
        }
    )


def text_features(pages: DataFrame) -> DataFrame:
    """Adds what the visible text says: words, markers, toxicity, filler, trust signals, readability."""
    from crawlframe.operators import markup as M

    x, low = F.col("text"), F.lower("text")
    markers = [T.has_word(low, m).cast("int") for m in T.TECH_MARKERS] + [F.contains(low, F.lit(m)).cast("int") for m in T.AI_MARKERS]
    p = pages.withColumns({"t": T.tokens(x), "w": T.words(low), "s": T.sentences(x), "signals": M.trust_signals(F.concat_ws(" ", "title", "text"))})
    content = F.filter("w", lambda v: (F.length(v) > 2) & ~T.in_list(v, T.STOP_WORDS))
    p = p.withColumn("c", content)
    share = lambda a, b: T.ratio(F.size(a), F.size(b))
    return p.withColumns(
        {
            "words": F.size("t").cast("long"),
            "all_words": F.size("w").cast("long"),
            "markers": sum(markers[1:], markers[0]).cast("long"),
            "toxic_pct": F.floor(share(F.filter("t", lambda v: T.in_list(v, T.TOXIC_WORDS)), "t") * 100.0 * 100.0 + 0.5) / 100.0,
            "filler_ratio": F.floor(share(F.filter("w", lambda v: T.in_list(v, T.FILLER_WORDS)), "w") * 10000.0 + 0.5) / 10000.0,
            "technical_words": T.has_word(low, "api", "sdk", "json", "http", "ssl", "tls", "csp"),
            **{k: F.col(f"signals.{k}") for k in ("contact", "legal", "reviews", "badges")},
            "has_author": F.col("signals.author") | (F.col("author") != ""),
            "unique_pct": F.when(F.size("c") == 0, 0.0).otherwise(F.floor(share(F.array_distinct("c"), "c") * 1000.0 + 0.5) / 10.0),
            "readability": T.readability(F.col("w"), F.col("s")),
            "lexical_diversity": F.floor(share(F.array_distinct("w"), "w") * 10000.0 + 0.5) / 10000.0,
            "long_sentence_ratio": F.floor(share(F.filter("s", lambda v: F.size(T.words(v)) > 20), "s") * 10000.0 + 0.5) / 10000.0,
            "stopword_ratio": F.floor((1.0 - share("c", "w")) * 10000.0 + 0.5) / 10000.0,
            "uppercase_ratio": F.floor(T.ratio(T.count_chars(x, r"\P{Lu}+"), T.count_chars(x, r"\P{L}+")) * 10000.0 + 0.5) / 10000.0,
            "punctuation_ratio": F.floor(T.ratio(T.count_chars(x, "[^!?.,;:]+"), F.length(x)) * 10000.0 + 0.5) / 10000.0,
            "text_html_ratio": F.floor(T.ratio(F.length(x), F.length("html")) * 10000.0 + 0.5) / 10000.0,
            "duplicate_sentence_ratio": F.floor(T.ratio(F.size("s") - F.size(F.array_distinct("s")), F.size("s")) * 10000.0 + 0.5) / 10000.0,
            "template_repetition": F.floor(T.ratio(T.occurrences(low, T.TEMPLATE_PHRASES) * 1000.0, F.size("w")) * 100.0 + 0.5) / 100.0,
        }
    )


def top_shares(pages: DataFrame) -> DataFrame:
    """Adds ``top_term_pct``, ``top_bigram_pct`` and ``top_trigram_pct`` of the content words ``c``."""
    size = F.size("c")
    moved = lambda i: F.slice("c", F.lit(i + 1), F.greatest(F.lit(0), size - i))
    two = F.slice(F.zip_with("c", moved(1), lambda a, b: F.concat_ws(" ", a, b)), 1, F.greatest(F.lit(0), size - 1))
    three = F.slice(F.zip_with(F.zip_with("c", moved(1), lambda a, b: F.concat_ws(" ", a, b)), moved(2), lambda a, b: F.concat_ws(" ", a, b)), 1, F.greatest(F.lit(0), size - 2))
    p = pages.withColumns({"g1": F.sort_array("c"), "g2": F.sort_array(two), "g3": F.sort_array(three)})

    def share(sorted_: str) -> Column:
        # The longest run of equal terms, side by side in the sorted array.
        again = F.array_join(F.zip_with(sorted_, F.slice(sorted_, F.lit(2), F.size(sorted_)), lambda a, b: F.when(a == b, "1").otherwise("0")), "")
        most = F.when(F.size(sorted_) == 0, 0).otherwise(F.array_max(F.transform(F.split(again, "0+"), F.length)) + 1)
        return F.floor(most * 10000.0 / F.greatest(F.lit(1), F.size(sorted_)) + 0.5) / 100.0

    return p.withColumns({"top_term_pct": share("g1"), "top_bigram_pct": share("g2"), "top_trigram_pct": share("g3")}).drop("g1", "g2", "g3")


def with_page_type(pages: DataFrame, paths: list[tuple[str, tuple[str, ...]]], legal: tuple[str, ...]) -> DataFrame:
    """Page type by words of the path, in the order given, and of the text; the last kind is asked for after the legal one."""
    from crawlframe.functions import urls as U

    path = F.regexp_replace(F.lower(U.path(F.col("url"))), "^/+|/+$", "")
    said = F.lower(F.concat_ws(" ", "title", "text"))
    has = lambda c, words: F.coalesce(*[F.when(c.contains(w), True) for w in words], F.lit(False))
    kind = F.when(path == "", "home")
    for name, words in paths[:-1]:
        kind = kind.when(has(path, words), name)
    return pages.withColumn("page_type", kind.when(has(said, legal), "legal").when(has(path, paths[-1][1]), paths[-1][0]).otherwise("other"))


def derived(features: DataFrame) -> DataFrame:
    """Adds DERIVED, one after the other."""
    for name, rule in DERIVED.items():
        features = features.withColumn(name, F.expr(rule))
    return features


def page_rules() -> list[Rule]:
    return [Rule(code, severity, F.expr(penalty).cast("double"), F.expr(when)) for code, severity, penalty, when in RULES]


def onpage_rules(limits: dict[str, int] | None = None) -> list[Rule]:
    """The rules of a single page; settings replace the limits."""
    used = LIMITS | (limits or {})
    return [Rule(code, severity, 0.0, F.expr(when.format(**used))) for code, severity, when in ONPAGE_RULES]


def site_health() -> Column:
    return F.expr(f"floor(greatest(0e0, least(100e0, {' + '.join(HEALTH_POINTS)})) * 10e0 + 0.5e0) / 10e0")
