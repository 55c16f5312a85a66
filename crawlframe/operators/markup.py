"""Operators over marked-up pages: images, canonicals, alternates, structured data, hidden content, challenges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crawlframe.functions import urls as U
from crawlframe.functions.common import clamp, pct, rnd
from crawlframe.functions.text import all_of, has_any

# Fixed values.
GENERIC_ALT = ["image", "photo", "picture", "img", "фото", "картинка"]
LANGUAGE_CODE = "^(x-default|[a-z]{2}(-[A-Z]{2})?)$"
HIDDEN = r"display:\s*none|visibility:\s*hidden|opacity:\s*0|text-indent:-|left:\s*-9999|clip:rect\(0|height:0"
CHALLENGE = ["/cdn-cgi/challenge-platform", "cf-chl", "attention required", "verify you are human", "checking your browser", "captcha", "hcaptcha", "g-recaptcha", "bot protection", "just a moment...", "access denied"]
STRONG_CHALLENGE = ["/cdn-cgi/challenge-platform", "cf-chl", "hcaptcha", "g-recaptcha"]
CHALLENGE_SCRIPT = "challenge-platform|cf_chl|turnstile|hcaptcha|recaptcha"
WAF_HEADERS = ["cf-ray", "cf-mitigated", "x-sucuri-id", "x-ddos", "x-akamai"]
TINY = r"font-size\s*:\s*[0-4](?:\.[0-9]+)?\s*px"
HIDDEN_ELEMENT = rf'(?is)<[a-z][a-z0-9]*(?:\s[^>]*)?(?:style="[^"]*(?:{HIDDEN}|{TINY})[^"]*"|\shidden|\saria-hidden="true")[^>]*>[^<]*<'
SKIPPED_TAGS = ["script", "style", "noscript", "template", "svg", "code", "pre"]
ICON = "(?is)^<[^>]*class=[\"'][^\"'>]*(?:icon|fa-|bi-|material)"


def attribute(tag: Column, name: str) -> Column:
    return F.regexp_extract(tag, f'(?i)\\s{name}="([^"]*)"', 1)


def images(pages: DataFrame) -> DataFrame:
    """One row per image, with flags."""
    rows = pages.select("page_id", "url", F.posexplode(all_of(F.col("html"), "(?is)<img[^>]*>")).alias("pos", "tag"))
    src, alt = attribute(F.col("tag"), "src"), F.trim(attribute(F.col("tag"), "alt"))
    rows = rows.withColumns({"src": src, "alt": alt, "format": F.lower(F.regexp_extract(src, r"\.([A-Za-z]+)(?:$|[?#])", 1))})
    external = F.col("src").rlike("^[a-z]+://") & (U.host(F.col("src")) != U.host(F.col("url")))
    return rows.select(
        "page_id",
        "pos",
        "src",
        "format",
        (F.col("alt") == "").alias("no_alt"),
        F.lower("alt").isin(*GENERIC_ALT).alias("generic_alt"),
        (F.lower(attribute(F.col("tag"), "loading")) == "lazy").alias("lazy"),
        ((attribute(F.col("tag"), "width") != "") & (attribute(F.col("tag"), "height") != "")).alias("sized"),
        external.alias("external"),
        F.col("format").isin("webp", "avif").alias("modern"),
        (F.count("*").over(Window.partitionBy("page_id", "src")) > 1).alias("repeated"),
    )


def canonical(html: Column) -> Column:
    return F.regexp_extract(html, '(?i)<link rel="canonical" href="([^"]*)"', 1)


def canonical_status(canon: Column, url: Column) -> Column:
    scheme = F.regexp_extract(canon, "^([a-z]+):", 1)
    resolved = F.when(scheme != "", canon).otherwise(F.concat(F.regexp_extract(url, "^([a-z]+://[^/]*)", 1), F.when(canon.startswith("/"), canon).otherwise(F.concat(F.lit("/"), canon))))
    return (
        F.when(canon == "", "missing")
        .when((scheme != "") & ~scheme.startswith("http"), "invalid")
        .when(scheme.startswith("http") & (U.host(canon) != U.host(url)), "external")
        .when(U.normalised(resolved) == U.normalised(url), "self")
        .otherwise("other")
    )


def canonical_targets(pages: DataFrame) -> DataFrame:
    """``pages(page_id, url, canonical, code, noindex)``: pages whose canonical leads to one that fails, moves or stays out."""
    t = pages.select(U.normalised(F.col("url")).alias("key"), F.col("code").alias("t_code"), F.col("noindex").alias("t_noindex")).dropDuplicates(["key"])
    j = pages.where("canonical <> ''").withColumn("key", U.normalised(F.col("canonical"))).where(F.col("key") != U.normalised(F.col("url"))).join(t, "key")
    problem = F.when(F.col("t_code") >= 400, "target_error").when(F.col("t_code") >= 300, "target_redirect").when(F.col("t_noindex"), "target_noindex")
    return j.withColumn("problem", problem).where("problem is not null").select("page_id", "canonical", "problem")


def alternates(pages: DataFrame) -> DataFrame:
    """``(page_id, url, lang, target)`` from alternate links."""
    found = all_of(F.col("html"), '(?i)<link rel="alternate" hreflang="[^"]*" href="[^"]*"')
    rows = pages.select("page_id", "url", F.explode(found).alias("tag"))
    return rows.select("page_id", U.normalised(F.col("url")).alias("url"), F.regexp_extract("tag", 'hreflang="([^"]*)"', 1).alias("lang"), U.normalised(F.regexp_extract("tag", 'href="([^"]*)"$', 1)).alias("target"))


def alternate_issues(alt: DataFrame, pages: DataFrame) -> DataFrame:
    """Invalid codes, repeated codes, missing x-default, targets that were not scanned, and targets without a link back."""
    known = pages.select(U.normalised(F.col("url")).alias("target")).distinct()
    back = alt.select(F.col("url").alias("target"), F.col("target").alias("url")).distinct()
    code = lambda df, c: df.select("page_id", "lang", F.lit(c).alias("code"))
    invalid = code(alt.where(~F.col("lang").rlike(LANGUAGE_CODE)), "invalid_code")
    repeated = code(alt.groupBy("page_id", "lang").count().where("count > 1"), "repeated_code")
    no_default = code(alt.groupBy("page_id").agg(F.max(F.when(F.col("lang") == "x-default", 1).otherwise(0)).alias("d")).where("d = 0").withColumn("lang", F.lit("x-default")), "missing_default")
    unknown = code(alt.join(known, "target", "left_anti"), "target_not_scanned")
    one_way = code(alt.where("url <> target").join(known, "target", "left_semi").join(back, ["url", "target"], "left_anti"), "no_return_link")
    return reduce(DataFrame.unionByName, [invalid, repeated, no_default, unknown, one_way])


def structured_scripts(pages: DataFrame) -> DataFrame:
    """``(page_id, body, v)``: JSON-LD scripts, v being null where they do not parse."""
    bodies = F.regexp_extract_all("html", F.lit('(?is)<script[^>]*type="application/ld\\+json"[^>]*>(.*?)</script>'), F.lit(1))
    return pages.select("page_id", F.explode(bodies).alias("body")).select("page_id", "body", F.try_parse_json("body").alias("v"))


def _elements(rows: DataFrame, path: str) -> DataFrame:
    """The elements of an array in a variant."""
    return rows.select("page_id", F.explode(F.try_variant_get("v", path, "array<variant>")).alias("v"))


def structured_objects(pages: DataFrame) -> DataFrame:
    """``(page_id, types, v)``: objects of JSON-LD scripts, those of lists and graphs by themselves; types in lower case.

    Types given as addresses or with a prefix are known by their last part. Lists and graphs may stand in each other once.
    """
    raw = structured_scripts(pages).where("v is not null").select("page_id", "v")
    rows = raw.unionByName(_elements(raw, "$"))
    rows = rows.unionByName(_elements(rows, '$["@graph"]'))
    rows = rows.where(F.schema_of_variant("v").startswith("OBJECT"))
    kind = F.coalesce(F.try_variant_get("v", '$["@type"]', "array<string>"), F.array(F.try_variant_get("v", '$["@type"]', "string")))
    named = F.filter(F.transform(kind, lambda x: F.lower(_type_name(x))), lambda x: x.isNotNull() & (x != ""))
    return rows.select("page_id", named.alias("types"), "v").where(F.size("types") > 0)


def _type_name(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.trim(x), "^.*[#?/]", ""), "^schema:", "")


def structured_types(pages: DataFrame) -> DataFrame:
    """``(page_id, syntax, type)``, each once: of JSON-LD (of scripts that do not parse by pattern), microdata and RDFa."""
    by = lambda df, syntax, x: df.select("page_id", F.lit(syntax).alias("syntax"), F.explode(x).alias("type"))
    broken = structured_scripts(pages).where("v is null")
    bare = pages.select("page_id", F.regexp_replace("html", r"(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->", " ").alias("bare"))
    named = lambda c, pattern: F.transform(F.regexp_extract_all(c, F.lit(pattern), F.lit(1)), lambda x: F.lower(_type_name(x)))
    found = [
        by(structured_objects(pages), "json-ld", F.col("types")),
        by(broken, "json-ld", named("body", r'"@type"\s*:\s*"(.*?)"')),
        by(bare, "microdata", named("bare", "(?is)\\sitemtype\\s*=\\s*[\"']([^\"']*)")),
        by(bare, "rdfa", named("bare", "(?is)\\stypeof\\s*=\\s*[\"']([^\"']*)")),
    ]
    return reduce(DataFrame.unionByName, found).where("type <> ''").distinct()


def structured_issues(objects: DataFrame) -> DataFrame:
    """``(page_id, code)``, each once: what an object of a type should have and has not."""
    text = lambda path: F.trim(F.coalesce(F.try_variant_get("v", path, "string"), F.lit("")))
    is_ = lambda *kinds: F.arrays_overlap("types", F.array(*[F.lit(k) for k in kinds]))
    offer = F.try_variant_get("v", "$.offers", "variant")
    kind = F.schema_of_variant(offer)
    offers = F.when(kind.startswith("OBJECT"), F.array(offer)).when(kind.startswith("ARRAY"), F.try_variant_get("v", "$.offers", "array<variant>"))
    n_offers = F.coalesce(F.size(offers), F.lit(0))
    without = lambda path: (n_offers > 0) & ~F.exists(offers, lambda o: F.trim(F.coalesce(F.try_variant_get(o, path, "string"), F.lit(""))) != "")
    article, organization = is_("article", "newsarticle", "blogposting"), is_("organization", "localbusiness")
    empty = lambda path: text(path).isin("", "[]")
    rules = {
        "product_missing_name": is_("product") & (text("$.name") == ""),
        "product_missing_offers": is_("product") & (n_offers == 0),
        "product_missing_price": is_("product") & without("$.price"),
        "product_missing_price_currency": is_("product") & without("$.priceCurrency"),
        "article_missing_headline": article & (text("$.headline") == ""),
        "article_missing_date_published": article & (text("$.datePublished") == ""),
        "article_missing_author": article & (text("$.author") == ""),
        "organization_missing_name": organization & (text("$.name") == ""),
        "organization_missing_url": organization & (text("$.url") == ""),
        "breadcrumb_missing_item_list": is_("breadcrumblist") & empty("$.itemListElement"),
        "faq_missing_main_entity": is_("faqpage") & empty("$.mainEntity"),
    }
    codes = F.filter(F.array(*[F.when(F.coalesce(rule, F.lit(False)), code) for code, rule in rules.items()]), lambda x: x.isNotNull())
    return objects.select("page_id", F.explode(codes).alias("code")).distinct()


def hidden_content(html: Column) -> Column:
    """Elements hidden by style, attribute, assistive flag or tiny letters: how many with text, and the length of their text."""
    found = F.transform(
        F.regexp_extract_all(html, F.lit(HIDDEN_ELEMENT), F.lit(0)),
        lambda x: F.struct(F.lower(F.regexp_extract(x, "^<([a-zA-Z]+)", 1)).alias("tag"), F.trim(F.regexp_extract(x, "(?s)>([^<]*)<$", 1)).alias("said"), x.rlike(ICON).alias("icon")),
    )
    kept = F.filter(found, lambda h: (F.length(h["said"]) >= 4) & ~h["tag"].isin(*SKIPPED_TAGS) & ~(h["tag"].isin("i", "span") & h["icon"]))
    return F.struct(F.size(kept).alias("nodes"), F.aggregate(kept, F.lit(0), lambda n, h: n + F.length(h["said"])).alias("chars"))


def cloaking(hidden: Column, text_chars: Column) -> Column:
    n, c = hidden["nodes"], hidden["chars"]
    return (n > 0) & (text_chars > 0) & ((n >= 20) | ((c / F.greatest(F.lit(1), text_chars) >= 0.30) & (c >= 200)) | ((n >= 8) & (c >= 200)) | ((n >= 6) & (text_chars < 200)))


def challenge(pages: DataFrame) -> DataFrame:
    """``pages(page_id, code, headers, html)`` -> score, verdict, status, risk and marks of challenge pages.

    Points for the answer's code, for headers of a firewall, for marks in the body (more for those that are never said in
    passing), and for scripts of a challenge.
    """
    low = F.lower("html")
    status = F.when(F.col("code").isin(403, 429, 503), 0.35).when(F.col("code") == 401, 0.18).otherwise(0.0)
    keys = F.transform(F.map_keys("headers"), F.lower)
    server = F.exists(F.map_entries("headers"), lambda e: (F.lower(e["key"]) == "server") & F.contains(F.lower(e["value"]), F.lit("akamai")))
    headers = F.when(F.arrays_overlap(keys, F.array(*[F.lit(h) for h in WAF_HEADERS])) | server, 0.28).otherwise(0.0)
    marks = sum([low.contains(m).cast("int") for m in CHALLENGE[1:]], low.contains(CHALLENGE[0]).cast("int"))
    strong = reduce(lambda a, b: a | b, [low.contains(m) for m in STRONG_CHALLENGE])
    body = F.when(strong, 0.44).when(marks > 0, 0.24).otherwise(0.0)
    scripts = F.when(low.rlike(CHALLENGE_SCRIPT), 0.22).otherwise(0.0)
    p = pages.select("page_id", rnd(F.least(F.lit(1.0), status + headers + body + scripts), 3).alias("score"), marks.alias("marks"))
    score = F.col("score")
    return p.select(
        "page_id",
        "score",
        (score >= 0.55).alias("challenge"),
        F.when(score >= 0.55, "detected").when(score >= 0.35, "suspected").otherwise("none").alias("status"),
        F.when(score >= 0.8, "high").when(score >= 0.55, "medium").otherwise("low").alias("risk"),
        "marks",
    )


def picture_sources(pages: DataFrame) -> DataFrame:
    """``(page_id, src, descriptor)``: every candidate of the source sets of pictures and images."""
    sets = F.regexp_extract_all("html", F.lit(r"(?is)<(?:source|img)[^>]*\ssrcset\s*=\s*[\"']([^\"']*)"), F.lit(1))
    each = F.transform(F.flatten(F.transform(sets, lambda s: F.split(s, ","))), lambda x: F.trim(x))
    rows = pages.select("page_id", F.explode(F.filter(each, lambda x: x != "")).alias("x"))
    return rows.select("page_id", F.regexp_extract("x", r"^(\S+)", 1).alias("src"), F.trim(F.regexp_extract("x", r"^\S+(.*)$", 1)).alias("descriptor"))


def three_way_difference(cosines: DataFrame) -> DataFrame:
    """``cosines(page_id, gpt, search, length_delta)`` -> risk that bots are shown something else."""
    risk = F.when((F.col("gpt") < 0.6) | (F.col("search") < 0.6) | (F.col("length_delta") > 0.4), "high").when((F.col("gpt") < 0.75) | (F.col("search") < 0.75), "medium").otherwise("low")
    return cosines.withColumn("risk", risk)


def opportunities(audits: DataFrame, k: int = 15) -> DataFrame:
    """``audits(site, id, score, savings_ms, savings_bytes)``: impact, priority, and the first of each site."""
    impact = (1.0 - F.col("score")) * 120.0 + F.coalesce(F.least(F.lit(35.0), F.col("savings_ms") / 120.0), F.lit(0.0)) + F.coalesce(F.least(F.lit(25.0), F.col("savings_bytes") / (1024.0 * 60.0)), F.lit(0.0))
    a = audits.where("score < 0.95").withColumn("impact", rnd(impact, 2))
    a = a.withColumn("priority", F.when((F.col("impact") >= 35) | (F.col("score") <= 0.35), "critical").when((F.col("impact") >= 20) | (F.col("score") <= 0.6), "high").otherwise("medium"))
    order = F.when(F.col("priority") == "critical", 0).when(F.col("priority") == "high", 1).otherwise(2)
    w = Window.partitionBy("site").orderBy(order, F.desc("impact"), "score", "id")
    return a.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("site", "rank", "id", "impact", "priority")


def image_inventory(img: DataFrame) -> DataFrame:
    """Formats of the site's images with shares."""
    total = F.sum("n").over(Window.partitionBy())
    g = img.groupBy(F.when(F.col("format") == "", "unknown").otherwise(F.col("format")).alias("format")).agg(F.count("*").alias("n"), F.count_if("no_alt").alias("no_alt"))
    return g.select("format", "n", "no_alt", pct(F.col("n"), total).alias("pct"))


def trust_signals(text: Column) -> Column:
    """Whether a text shows contacts, legal documents, an author, reviews and badges."""
    low = F.lower(text)
    said = lambda *parts: has_any(low, list(parts))
    # What stands before a number's first digit or before the last letter of a mail name changes nothing about there being one.
    number, mail = low.rlike(r"\d[\d\s\-()]{7,}\d"), F.contains(low, F.lit("@")) & low.rlike(r"[a-z0-9._%+-]@[a-z0-9.-]+\.[a-z]{2}")
    return F.struct(
        (said("contact", "phone", "call us", "support", "help center", "email", "e-mail") | mail | number).alias("contact"),
        said("privacy", "terms", "policy", "cookie", "gdpr", "ccpa", "disclaimer").alias("legal"),
        said("author", "written by", "reviewed by", "editor").alias("author"),
        said("review", "rating", "testimonial").alias("reviews"),
        said("certified", "award", "guarantee", "verified").alias("badges"),
    )


def trust_score(signals: Column) -> Column:
    return clamp(sum([signals[c].cast("double") * 20.0 for c in ("legal", "author", "reviews", "badges")], signals["contact"].cast("double") * 20.0))
