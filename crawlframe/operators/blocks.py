"""Pages as nested intervals: what stands inside an element is told by where it is entered and left.

``nodes`` numbers elements and runs of text in document order; an element is entered at its number and left at that of the last
node inside it. Sums over a page in that order (characters, links) give what an element holds as the difference of two of them,
and the nearest enclosing element of a kind is the last one entered and not yet left. So block texts, link counts and the scope
of properties are windows and joins over rows, whatever the depth.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crawlframe.functions.common import rnd
from crawlframe.functions.text import all_of
from crawlframe.operators.graph import cut
from crawlframe.operators.html import BATCH_CHARS, VOID
from crawlframe.sources.shipping import ship

NODES = "page_id long, pos int, leave int, tag string, attrs map<string,string>, text string, depth int, parent int"

# Patterns, words, weights and limits of the segmentation.
BLOCK_TAGS = ["main", "article", "section", "div", "nav", "header", "footer", "aside", "menu"]
WORD = "[a-zа-я0-9]+"
STOP = ["the", "and", "for", "with", "that", "this", "from", "your", "about", "как", "что", "это", "для", "или", "если", "страница", "menu", "home"]
AD_MARKS = ["adsbygoogle", "doubleclick", "yandex_rtb", "googletag", "adriver", "mgid", "taboola"]
AD_DOMAINS = r"(doubleclick\.net|googlesyndication\.com|googletagmanager\.com|yandex\.(ru|net)/ads|adriver\.ru|mgid\.com|taboola\.com)"
AD_NAMES = ["ad", "banner", "promo", "sponsor"]
LIVE = r"(\b\d+\s*:\s*\d+\b|\blive\b|qualifier|schedule|match|score|fixture)"
NAV_HINT = "(catalog|menu|nav|navigation|sidebar|megamenu|mega-menu|section-list|header|footer|breadcrumbs)"
CTA = "(buy now|get started|book demo|request quote|contact us|sign up|try free|subscribe|learn more)"
UTILITY = "(contact|contacts|support|phone|email|address|privacy|terms|cookie|login|signup|register|cta)"
REVIEW = "(review|rating|testimonial|case study|обзор|рейтинг|отзыв)"
FAQ = "(faq|frequently asked|q&a|question|вопрос|ответ)"
PRODUCT = "(product|sku|price|pricing|buy|cart|checkout|товар|цена|купить)"
CATEGORY = "(category|catalog|collection|tag|категор|раздел)"
LEGAL = "(privacy|terms|policy|legal|gdpr|cookies|оферт|политик|условия)"
HEADER_HINT = "(header|topbar|navbar|site-header)"
SIDEBAR_HINT = "(sidebar|side-nav|aside|filter|facets?)"
NOISE = "(related posts|you may also like|recommended|similar items|share this|поделиться)"
EMAIL = r"[\w\.-]+@[\w\.-]+\.[a-z]{2,}"
PHONE = r"\+?\d[\d\-\s\(\)]{7,}"
LINKISH = ["home", "menu", "catalog", "category", "news", "contact", "about", "privacy", "terms", "login", "signup", "register"]
PRIORITY = {"main": 1.0, "article": 1.0, "section.content": 1.0, "div.content": 1.0, "div.article": 1.0, "section": 0.7, "div.text": 0.7, "div.description": 0.7, "header": 0.2, "footer": 0.2, "nav": 0.15, "aside": 0.15, "menu": 0.1}
OTHER_PRIORITY = 0.55
CLASSES = {"navigation": ["nav", "footer", "header", "sidebar", "category"], "boilerplate": ["ads", "live_scores", "noise"], "utility": ["utility", "cta", "legal"]}


class _Nodes(HTMLParser):
    """Rows of one page: elements, and runs of text as ``#text``, ``#script`` or ``#style``."""

    def __init__(self, page_id: int):
        super().__init__(convert_charrefs=True)
        self.page_id, self.rows, self.open, self.parted = page_id, [], [], False

    def _add(self, tag: str, attrs: dict | None, text: str | None) -> int:
        at = len(self.rows)
        self.rows.append([self.page_id, at, at, tag, attrs, text, len(self.open), self.open[-1] if self.open else -1])
        return at

    def handle_starttag(self, tag, attrs):
        at = self._add(tag, {k: v or "" for k, v in attrs}, None)
        if tag not in VOID:
            self.open.append(at)

    def handle_startendtag(self, tag, attrs):
        self._add(tag, {k: v or "" for k, v in attrs}, None)

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, -1, -1):
            if self.rows[self.open[i]][3] == tag:
                self._leave(i)
                break

    def _leave(self, i: int) -> None:
        for at in self.open[i:]:
            self.rows[at][2] = len(self.rows) - 1
        del self.open[i:]

    def handle_comment(self, data):
        self.parted = True

    def handle_data(self, data):
        inside = self.rows[self.open[-1]][3] if self.open else ""
        tag = f"#{inside}" if inside in ("script", "style") else "#text"
        parent = self.open[-1] if self.open else -1
        if self.rows and self.rows[-1][3] == tag and self.rows[-1][7] == parent and not self.parted:
            self.rows[-1][5] += data
        elif data.strip():
            self._add(tag, None, data)
            self.parted = False


def page_nodes(page_id: int, html: str | None) -> list[list]:
    """Rows of one page; what the tokenizer gives up on ends its page there, not the job."""
    parser = _Nodes(page_id)
    try:
        parser.feed((html or "").replace("<![", "&lt;!["))
        parser.close()
    except (AssertionError, ValueError):
        pass
    parser._leave(0)
    return parser.rows


#: Pages of an Arrow batch: a few MB, where Spark's default of 10,000 rows may be hundreds.
PAGE_ROWS = 200


def nodes(pages: DataFrame) -> DataFrame:
    """``pages(page_id, html)`` -> elements and texts with the intervals that they span; a null page has none.

    Written once, since blocks and things are joins of several views of it, and each would parse all pages again.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in NODES.replace("<string,string>", "").split(", ")]
        for batch in batches:
            rows, size = [], 0
            for page_id, html in zip(batch["page_id"], batch["html"], strict=True):
                rows += page_nodes(page_id, html)
                size += len(html or "")
                if size >= BATCH_CHARS:
                    yield pd.DataFrame(rows, columns=names)
                    rows, size = [], 0
            yield pd.DataFrame(rows, columns=names)

    ship(pages.sparkSession)
    conf, key = pages.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(key)
    conf.set(key, str(PAGE_ROWS))
    try:
        return cut(pages.select(F.col("page_id").cast("long"), "html").mapInPandas(run, NODES))
    finally:
        conf.set(key, before)


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def spans(nodes_: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Elements with ``start``, ``chars`` and ``links``, and ``(page_id, page_text)``.

    An element's text is the page's from ``start`` on, ``chars`` long; runs of text are trimmed and parted by a space.
    """
    run = F.when(F.col("tag") == "#text", squeezed(F.col("text"))).otherwise("")
    order = Window.partitionBy("page_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    size = F.when(F.col("run") != "", F.length("run") + 1).otherwise(0)
    link = ((F.col("tag") == "a") & F.col("attrs")["href"].isNotNull()).cast("int")
    n = nodes_.withColumn("run", run).withColumns({"size": size, "link": link}).withColumns({"at": F.sum("size").over(order), "links_at": F.sum("link").over(order)})
    ends = n.select("page_id", F.col("pos").alias("leave"), F.col("at").alias("till"), F.col("links_at").alias("links_till"))
    el = n.where(~F.col("tag").startswith("#")).join(ends, ["page_id", "leave"])
    el = el.withColumns({"start": F.col("at"), "chars": F.greatest(F.col("till") - F.col("at") - 1, F.lit(0)), "links": F.col("links_till") - F.col("links_at")})
    runs = n.where("run <> ''").groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("pos", "run"))).alias("r"))
    pages = runs.select("page_id", F.array_join(F.col("r.run"), " ").alias("page_text"))
    return el.drop("text", "run", "size", "link", "at", "links_at", "till", "links_till"), pages


def text_of() -> Column:
    """Of an element of ``spans`` joined with its page's text."""
    return F.coalesce(F.substring(F.col("page_text"), (F.col("start") + 1).cast("int"), F.col("chars").cast("int")), F.lit(""))


def words(text: Column) -> Column:
    return all_of(F.lower(text), WORD)


def _share(a: Column, b: Column) -> Column:
    return a.cast("double") / F.greatest(F.lit(1), b).cast("double")


def _classes() -> Column:
    return F.split(squeezed(F.lower(F.coalesce(F.col("attrs")["class"], F.lit("")))), " ")


def selector() -> Column:
    has = lambda tag, name: (F.col("tag") == tag) & F.array_contains(_classes(), name)
    kinds = [("section", "content"), ("div", "content"), ("div", "article"), ("div", "text"), ("div", "description")]
    picked = F.when(has(*kinds[0]), ".".join(kinds[0]))
    for kind in kinds[1:]:
        picked = picked.when(has(*kind), ".".join(kind))
    return picked.otherwise(F.col("tag"))


def ads(nodes_: DataFrame) -> DataFrame:
    """``(page_id, evidence)``: marks of advertising in scripts and frames, sorted; pages without any have no row."""
    src = F.lower(F.coalesce(F.col("attrs")["src"], F.lit("")))
    said = F.when(F.col("tag") == "script", src).when(F.col("tag") == "#script", F.lower("text")).otherwise("")
    hits = [F.when(F.contains(said, F.lit(m)), m) for m in AD_MARKS]
    hits += [F.when((F.col("tag") == "script") & src.rlike(AD_DOMAINS), "ad_domain_script"), F.when((F.col("tag") == "iframe") & src.rlike(AD_DOMAINS), "ad_domain_iframe")]
    found = nodes_.where(F.col("tag").isin("script", "#script", "iframe")).select("page_id", F.explode(F.array_compact(F.array(*hits))).alias("hit"))
    return found.groupBy("page_id").agg(F.array_sort(F.collect_set("hit")).alias("evidence"))


def block_type() -> Column:
    """``(type, confidence)`` of rows with ``tag, names, low, n_words, density, text_density, ad_page``: the first rule that holds."""
    names, low, n = F.col("names"), F.col("low"), F.col("n_words")
    links, text = F.col("density"), F.col("text_density")
    tag, nav = F.col("tag"), F.col("mega")
    any_of = lambda x, marks: F.exists(F.array(*[F.lit(m) for m in marks]), lambda m: F.contains(x, m))
    rules = [
        (F.col("ad_page") & (any_of(names, AD_NAMES) | any_of(low, AD_MARKS)), "ads", 0.92),
        (low.rlike(LIVE) & ((links >= 0.12) | (n <= 140)), "live_scores", 0.84),
        (names.rlike(HEADER_HINT) & (links > 0.2), "header", 0.8),
        (names.rlike(SIDEBAR_HINT) & (links > 0.18), "sidebar", 0.8),
        (tag == "footer", "footer", 0.86),
        (tag.isin("nav", "menu", "header", "aside"), "nav", 0.85),
        (nav & (links >= 0.5) & (text < 0.2), "nav", 0.93),
        ((links > 0.58) & (text < 0.22), "nav", 0.82),
        (names.rlike(CATEGORY) & (links >= 0.2), "category", 0.78),
        (names.rlike(REVIEW) | low.rlike(REVIEW), "reviews", 0.76),
        (names.rlike(FAQ) | low.rlike(FAQ), "faq", 0.78),
        (names.rlike(PRODUCT) | (low.rlike(PRODUCT) & (n >= 20)), "product", 0.77),
        (names.rlike(LEGAL) | low.rlike(LEGAL), "legal", 0.8),
        (low.rlike(CTA), "cta", 0.75),
        (low.rlike(NOISE), "noise", 0.72),
        (names.rlike(UTILITY) | low.rlike(UTILITY) | low.rlike(EMAIL) | low.rlike(PHONE), "utility", 0.8),
        (n < 18, "utility", 0.64),
    ]
    out = None
    for when, kind, sure in rules:
        value = F.struct(F.lit(kind).alias("type"), F.lit(sure).alias("confidence"))
        out = F.when(when, value) if out is None else out.when(when, value)
    return out.otherwise(F.struct(F.lit("main").alias("type"), F.lit(0.7).alias("confidence")))


def segments(nodes_: DataFrame, least_chars: int = 35, spanned: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Blocks of each page that hold some text and no text that an earlier block has, with type, class and score.

    ``(page_id, pos, type, segment_class, selector, tag, chars, words, links, link_density, text_density, priority,
    block_score, position_weight, unique_score, repetition_score, depth, depth_weight, schema_hint, confidence, mega, text)``.
    ``spanned`` are the ``spans`` of the nodes, where they are known.
    """
    el, pages = spanned or spans(nodes_)
    page = Window.partitionBy("page_id")
    c = el.where(F.col("tag").isin(*BLOCK_TAGS))
    c = c.withColumns({"idx": F.row_number().over(page.orderBy("pos")) - 1, "candidates": F.count("*").over(page)})
    c = c.where(F.col("chars") >= least_chars).join(pages, "page_id").withColumn("text", text_of()).drop("page_text")
    c = c.withColumn("copy", F.row_number().over(Window.partitionBy("page_id", F.md5(F.substring("text", 1, 1500))).orderBy("pos"))).where("copy = 1")
    c = c.withColumn("w", words(F.col("text"))).withColumns({"low": F.lower("text"), "n_words": F.size("w"), "selector": selector()})
    classes = squeezed(F.lower(F.coalesce(F.col("attrs")["class"], F.lit(""))))
    c = c.withColumns({
        "names": F.concat_ws(" ", F.lower(F.coalesce(F.col("attrs")["id"], F.lit(""))), classes, "tag"),
        "density": _share(F.col("links"), F.col("n_words")),
        "text_density": rnd(_share(F.col("n_words"), F.col("chars")), 4),
        "unique_score": rnd(_share(F.size(F.array_distinct("w")), F.col("n_words")), 4),
        "priority": F.coalesce(F.create_map(*[F.lit(x) for kv in PRIORITY.items() for x in kv])[F.col("selector")], F.lit(OTHER_PRIORITY)),
        "depth": F.col("depth") + 1,
        "schema_hint": (F.coalesce(F.col("attrs")["itemtype"], F.lit("")) != "") | (F.coalesce(F.col("attrs")["typeof"], F.lit("")) != ""),
        "begins": F.array_join(F.slice("w", 1, 16), " "),
    })
    c = c.join(ads(nodes_).select("page_id", F.lit(True).alias("ad_page")), "page_id", "left").withColumn("ad_page", F.coalesce("ad_page", F.lit(False)))
    again = F.row_number().over(Window.partitionBy("page_id", "begins").orderBy("pos")) - 1
    place = F.col("idx") / F.greatest(F.lit(1), F.col("candidates") - 1)
    c = c.withColumns({
        "link_density": rnd(F.col("density"), 4),
        "depth_weight": F.greatest(F.lit(0.2), 1.0 - F.least(F.lit(0.7), F.abs(F.col("depth") - 8) / 14.0)),
        "position_weight": F.greatest(F.lit(0.15), 1.0 - F.abs(place - 0.45) * 1.4),
        "repetition_score": F.least(F.lit(1.0), again / 4.0),
        "mega": F.col("names").rlike(NAV_HINT),
    })
    score = (
        F.least(F.lit(1.0), F.col("n_words") / 220.0) * 0.30
        + (1.0 - F.least(F.lit(1.0), F.col("link_density"))) * 0.22
        + F.col("priority") * 0.17
        + F.col("position_weight") * 0.08
        + F.col("unique_score") * 0.08
        + F.col("depth_weight") * 0.08
        + F.when(F.col("schema_hint"), 1.0).otherwise(0.55) * 0.07
    )
    c = c.withColumns({"score": F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), "kind": block_type()})
    kind = F.col("kind.type")
    named = None
    for name, kinds in CLASSES.items():
        named = F.when(kind.isin(*kinds), name) if named is None else named.when(kind.isin(*kinds), name)
    named = named.when((F.col("score") >= 0.62) & (F.col("n_words") >= 70), "main").otherwise("supporting")
    return c.select(
        "page_id", "pos", kind.alias("type"), named.alias("segment_class"), "selector", "tag", "chars", F.col("n_words").alias("words"), "links", "link_density", "text_density",
        rnd(F.col("priority"), 3).alias("priority"), rnd(F.col("score"), 4).alias("block_score"), rnd(F.col("position_weight"), 4).alias("position_weight"), "unique_score",
        rnd(F.col("repetition_score"), 4).alias("repetition_score"), "depth", rnd(F.col("depth_weight"), 4).alias("depth_weight"), "schema_hint", "kind.confidence",
        "mega", "text",
    )


def _terms(w: Column, least: int = 3) -> Column:
    """Different words of three letters and more that are no stop words."""
    return F.array_distinct(F.filter(w, lambda x: (F.length(x) >= least) & ~x.isin(*STOP)))


def _jaccard(a: Column, b: Column, both: Column) -> Column:
    """Of two sets that have so many terms in common; null if it is not known how many."""
    return F.when(both.isNotNull(), F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / F.greatest(F.lit(1), F.size(a) + F.size(b) - both)))


def semantic_density(w: Column) -> Column:
    """Of a text's words."""
    return F.when(F.size(w) == 0, 0.0).otherwise(rnd(_share(F.size(_terms(w, 4)), F.size(w)), 4))


def linkish(text: Column, w: Column) -> Column:
    """How much of a text with such words is words of menus and addresses, 0 to 1."""
    hits = F.size(F.filter(w, lambda x: x.isin(*LINKISH))) + 2 * F.size(all_of(F.lower(text), r"(?:https?://|www\.|/[a-z0-9_\-]{2,})"))
    return F.when(F.size(w) == 0, 1.0).otherwise(F.least(F.lit(1.0), hits / F.size(w) * 3.0))


def extractor_quality(text: Column, w: Column, terms: Column, headings: Column) -> Column:
    """Of a text, its words and terms, with the terms of the page's headings: length, density, overlap, few links, few repeats."""
    n = F.size(w)
    overlap = F.when((F.size(headings) == 0) | (F.size(terms) == 0), 0.0).otherwise(rnd(F.size(F.array_intersect(terms, headings)) / F.greatest(F.lit(1), F.size(headings)), 4))
    unique = rnd(_share(F.size(F.array_distinct(w)), n), 4)
    score = 0.30 * F.least(F.lit(1.0), n / 900.0) + 0.25 * semantic_density(w) + 0.20 * overlap + 0.15 * (1.0 - linkish(text, w)) + 0.10 * unique
    return F.when(n == 0, 0.0).otherwise(rnd(score, 4))


def segmentation(nodes_: DataFrame) -> DataFrame:
    """A row for each page with text: shares of characters by class and type, agreement of the extractors, confidence.

    Extractors are the whole text, the main blocks, headings with their paragraphs, and landmarks (``main``, ``article`` and
    the like). Agreement is the mean Jaccard similarity of the pairs of those with 40 words. Each text is cut into words once:
    the main text is one of them, or two put together, and so are its words.
    """
    el, pages = spans(nodes_)
    seg = segments(nodes_, spanned=(el, pages))
    ordered = lambda when: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(when, F.struct("pos", "text")))), lambda s: s["text"]), " ")
    chars = lambda when: F.coalesce(F.sum(F.when(when, F.col("chars"))), F.lit(0))
    by = seg.groupBy("page_id").agg(
        F.count("*").alias("segments"),
        F.sum("chars").alias("total"),
        *[chars(F.col("segment_class") == k).alias(f"{k}_class") for k in ("main", "supporting", "navigation", "utility", "boilerplate")],
        *[chars(F.col("type").isin(*k)).alias(f"{k[0]}_type") for k in (["main"], ["ads"], ["live_scores"], ["nav", "footer"], ["utility"])],
        F.coalesce(F.sum(F.when(F.col("type") == "nav", F.col("links"))), F.lit(0)).alias("nav_links"),
        F.sum("links").alias("all_links"),
        F.coalesce(F.bool_or(F.col("mega") & (F.col("type") == "nav")), F.lit(False)).alias("mega_menu"),
        F.count_if(F.col("type") == "utility").alias("utility_blocks"),
        ordered((F.col("segment_class") == "main") & (F.col("priority") >= 0.55)).alias("dom_main"),
        ordered(F.col("segment_class") == "supporting").alias("dom_supporting"),
    )
    role = F.col("attrs")["role"] == "main"
    mark = F.col("tag").isin("main", "article") | F.coalesce(role, F.lit(False)) | F.col("selector").isin("section.content", "div.content", "div.article")
    head = F.col("tag").isin("h1", "h2", "h3")
    parts = el.withColumn("selector", selector()).where(mark | head | F.col("tag").isin("p", "li")).join(pages, "page_id").withColumn("text", text_of()).drop("page_text")
    parts = parts.withColumns({"mark": mark & (F.size(words(F.col("text"))) >= 30), "head": (head & (F.col("text") != "")) | (F.col("tag").isin("p", "li") & (F.length("text") >= 60))})
    texts = parts.groupBy("page_id").agg(ordered(F.col("mark")).alias("landmark"), ordered(F.col("head")).alias("heading_based"), ordered(F.col("tag").isin("h1", "h2")).alias("headings"))
    p = pages.join(by, "page_id", "left").join(texts, "page_id", "left")
    p = p.fillna("", ["dom_main", "dom_supporting", "landmark", "heading_based", "headings"]).fillna(0).fillna(False)
    names = ["page_text", "dom_main", "heading_based", "landmark"]
    p = p.withColumns({f"w_{x}": words(F.col(x)) for x in [*names, "dom_supporting", "headings"]}).withColumn("headings", _terms(F.col("w_headings")))
    p = p.withColumns({f"n_{x}": F.size(F.col(f"w_{x}")) for x in [*names, "dom_supporting"]} | {f"t_{x}": _terms(F.col(f"w_{x}")) for x in names})
    # Each pair is compared in a step of its own, as a value that is used twice inside an expression is worked out twice.
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    p = p.withColumns({f"both_{a}_{b}": F.when((F.col(f"n_{a}") >= 40) & (F.col(f"n_{b}") >= 40), F.size(F.array_intersect(f"t_{a}", f"t_{b}"))) for a, b in pairs})
    compared = [_jaccard(F.col(f"t_{a}"), F.col(f"t_{b}"), F.col(f"both_{a}_{b}")) for a, b in pairs]
    total = reduce(lambda s, x: s + F.coalesce(x, F.lit(0.0)), compared, F.lit(0.0))
    mean = total / F.greatest(F.lit(1), reduce(lambda s, x: s + x.isNotNull().cast("int"), compared, F.lit(0)))
    # In this order, so that the first of equal ones is taken.
    extractors = {"dom_density": "dom_main", "heading_based": "heading_based", "semantic_landmark": "landmark"}
    p = p.withColumns({"agreement": rnd(mean, 4)} | {f"q_{k}": extractor_quality(F.col(x), F.col(f"w_{x}"), F.col(f"t_{x}"), F.col("headings")) for k, x in extractors.items()})
    best = F.greatest(*[F.col(f"q_{k}") for k in extractors])
    picked = F.when(F.col("q_dom_density") == best, "dom_density").when(F.col("q_heading_based") == best, "heading_based").otherwise("semantic_landmark")
    longest = F.greatest(*[F.when(F.col(f"n_{x}") >= 60, F.col(f"n_{x}")) for x in names])
    p = p.withColumns({"primary_extractor": picked, "best": best, "longest": longest})
    both = lambda text, w: F.struct(text.alias("text"), w.alias("w"))
    of = lambda x: both(F.col(x), F.col(f"w_{x}"))
    p = p.withColumn("fallback", F.coalesce(*[F.when((F.col(f"n_{x}") == F.col("longest")) & (F.col(f"n_{x}") >= 60), of(x)) for x in names]))
    size = lambda x: F.size(F.col(f"{x}.w"))
    p = p.withColumn("main", F.when(F.col("dom_main") != "", of("dom_main")).otherwise(F.coalesce("fallback", of("page_text"))))
    joined = both(squeezed(F.concat_ws(" ", F.col("main.text"), "dom_supporting")), F.concat(F.col("main.w"), "w_dom_supporting"))
    p = p.withColumn("main", F.when((size("main") < 80) & (F.col("n_dom_supporting") >= 80), joined).otherwise(F.col("main")))
    p = p.withColumn("main", F.when((size("main") < 60) & F.col("fallback").isNotNull(), F.col("fallback")).otherwise(F.col("main")))
    p = p.withColumn("chosen", F.when(F.col("primary_extractor") == "dom_density", of("dom_main")).when(F.col("primary_extractor") == "heading_based", of("heading_based")).otherwise(of("landmark")))
    p = p.withColumn("main", F.when((size("chosen") >= 70) & (size("chosen") >= size("main")), F.col("chosen")).otherwise(F.col("main")))
    p = p.withColumns({"main": F.col("main.text"), "w_main": F.col("main.w"), "n_main": size("main")})
    share = lambda x, n=4, k=1.0: rnd(F.col(x) / F.greatest(F.lit(1), F.col("total")) * k, n)
    ratio = rnd(F.length("main") / F.greatest(F.lit(1), F.length("page_text")), 4)
    density = rnd(_share(F.col("n_main"), F.length("main")), 4)
    sure = F.col("agreement") * 0.45 + F.least(F.lit(1.0), density / 0.24) * 0.25 + F.least(F.lit(1.0), semantic_density(F.col("w_main")) * 2.2) * 0.2 + F.least(F.lit(1.0), ratio / 0.6) * 0.1
    p = p.withColumn("confidence", F.greatest(F.lit(0.0), F.least(F.lit(1.0), sure)))
    low = [(F.col("agreement") < 0.35, "low_agreement"), (share("nav_type", 2, 100.0) >= 45, "much_navigation"), (share("main_type", 2, 100.0) < 25, "little_main"), (F.col("n_main") < 80, "short_main")]
    return p.select(
        "page_id", "segments", *[share(f"{k}_class").alias(f"{k}_ratio") for k in ("main", "supporting", "navigation", "utility", "boilerplate")],
        *[share(f"{k}_type", 2, 100.0).alias(f"{a}_pct") for k, a in (("main", "main"), ("ads", "ads"), ("live_scores", "live"), ("nav", "nav"), ("utility", "utility"))],
        rnd(_share(F.col("nav_links"), F.col("all_links")), 4).alias("nav_link_ratio"), "mega_menu", "utility_blocks", F.col("agreement").alias("extractor_agreement"), "primary_extractor",
        F.length("main").alias("main_chars"), ratio.alias("main_text_ratio"), rnd(F.col("confidence"), 4).alias("confidence"),
        F.when(F.col("confidence") >= 0.75, "high").when(F.col("confidence") >= 0.5, "medium").otherwise("low").alias("level"),
        F.array_join(F.array_compact(F.array(*[F.when(w, r) for w, r in low])), ",").alias("reasons"),
        rnd(F.least(F.lit(1.0), F.col("agreement") * 0.45 + F.col("best") * 0.55), 4).alias("extraction_confidence"),
    )


# --- Entities of the markup

# Properties that name a thing.
NAME_PROPS = {"itemprop": ["name", "legalname", "alternatename", "headline", "title"], "property": ["name", "schema:name", "headline", "title"]}


def scope_of(nodes_: DataFrame, attr: str) -> DataFrame:
    """``(page_id, pos, scope)``: for each element the nearest element around it that has the attribute, -1 if none has.

    Elements that open a scope are entered and left in order, so in document order a stack of them is kept by depth: the nearest
    one around a node is the last with the attribute, among those with a smaller depth, that is not yet left.
    """
    scopes = nodes_.where(F.map_contains_key("attrs", attr) & ~F.col("tag").startswith("#")).select("page_id", F.struct(F.col("pos").alias("enter"), "leave").alias("s"))
    scopes = scopes.groupBy("page_id").agg(F.array_sort(F.collect_list("s")).alias("scopes"))
    el = nodes_.where(~F.col("tag").startswith("#")).join(scopes, "page_id")
    around = F.filter("scopes", lambda s: (s["enter"] < F.col("pos")) & (s["leave"] >= F.col("pos")))
    return el.select("page_id", "pos", F.coalesce(F.array_max(F.transform(around, lambda s: s["enter"])), F.lit(-1)).alias("scope"))


def type_name(value: Column) -> Column:
    """The last part of a type's address or prefix: ``https://schema.org/Person`` and ``schema:Person`` are ``Person``."""
    return F.regexp_replace(F.trim(value), "^.*[/#:]", "")


def dom_items(nodes_: DataFrame) -> DataFrame:
    """``(page_id, item, syntax, types, within, as_property)``: things of microdata and RDFa, with the thing they stand in.

    A thing that is a property of another (``itemprop`` on its own element) says which.
    """
    out = []
    for syntax, opens, typed, prop in (("microdata", "itemscope", "itemtype", "itemprop"), ("rdfa", "typeof", "typeof", "property")):
        a = F.col("attrs")
        items = nodes_.where(F.map_contains_key("attrs", opens))
        types = F.filter(F.transform(F.split(squeezed(F.coalesce(a[typed], F.lit(""))), " "), type_name), lambda t: t != "")
        items = items.join(scope_of(nodes_, opens), ["page_id", "pos"])
        out.append(items.select("page_id", F.col("pos").alias("item"), F.lit(syntax).alias("syntax"), types.alias("types"), F.when(F.col("scope") >= 0, F.col("scope")).alias("within"), a[prop].alias("as_property")))
    return out[0].unionByName(out[1])


def dom_properties(nodes_: DataFrame) -> DataFrame:
    """``(page_id, item, syntax, pos, property, value, nested)``: each property belongs to the nearest thing around it.

    Its value is the thing that its own element opens, else ``content``, ``href``, ``src`` or ``datetime``, else its text. An
    element may give several properties, parted by spaces. Properties outside of any thing have none.
    """
    el, pages = spans(nodes_)
    out = []
    for syntax, opens, prop in (("microdata", "itemscope", "itemprop"), ("rdfa", "typeof", "property")):
        a = F.col("attrs")
        rows = el.where(F.map_contains_key("attrs", prop)).join(scope_of(nodes_, opens), ["page_id", "pos"]).where("scope >= 0").join(pages, "page_id", "left")
        nested = F.when(F.map_contains_key("attrs", opens), F.col("pos"))
        given = F.coalesce(*[F.when(a[k] != "", squeezed(a[k])) for k in ("content", "href", "src", "datetime")], text_of())
        rows = rows.select("page_id", F.col("scope").alias("item"), F.lit(syntax).alias("syntax"), "pos", F.explode(F.filter(F.split(squeezed(a[prop]), " "), lambda p: p != "")).alias("property"), F.when(nested.isNull(), given).alias("value"), nested.alias("nested"))
        out.append(rows)
    return out[0].unionByName(out[1])


def dom_entities(nodes_: DataFrame) -> DataFrame:
    """``(page_id, item, syntax, type, name)``: the different names of each typed thing.

    They are the values of its name properties, those of things inside it included; where it has none, its own ``content`` or
    text.
    """
    el, pages = spans(nodes_)
    out = []
    for syntax, typed, prop in (("microdata", "itemtype", "itemprop"), ("rdfa", "typeof", "property")):
        a = F.col("attrs")
        items = el.where(F.coalesce(squeezed(a[typed]), F.lit("")) != "").join(pages, "page_id", "left")
        types = F.filter(F.transform(F.split(squeezed(a[typed]), " "), type_name), lambda t: t != "")
        items = items.select("page_id", F.col("pos").alias("item"), "leave", types.alias("types"), F.coalesce(F.when(a["content"] != "", squeezed(a["content"])), text_of()).alias("own"))
        named = el.where(F.lower(squeezed(a[prop])).isin(*NAME_PROPS[prop])).join(pages, "page_id", "left")
        named = named.select("page_id", "pos", F.coalesce(F.when(a["content"] != "", squeezed(a["content"])), text_of()).alias("name")).where("name <> ''")
        lists = named.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("pos", "name"))).alias("names"))
        # A page's names stand in one row, so things are not paired with names of other pages; a page is bounded.
        items = items.join(lists, "page_id", "left")
        inside = F.array_distinct(F.transform(F.filter(F.coalesce("names", F.array().cast("array<struct<pos:int,name:string>>")), lambda x: (x["pos"] > F.col("item")) & (x["pos"] <= F.col("leave"))), lambda x: x["name"]))
        names = F.when(F.size(inside) > 0, inside).otherwise(F.filter(F.array("own"), lambda x: x != ""))
        rows = items.select("page_id", "item", F.explode("types").alias("type"), names.alias("names")).distinct()
        out.append(rows.select("page_id", "item", F.lit(syntax).alias("syntax"), "type", F.explode("names").alias("name")))
    return out[0].unionByName(out[1])
