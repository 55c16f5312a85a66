"""HTML pages: an element table from a tokenizer, and feature columns by patterns for well-formed parts."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crawlframe.functions import urls as U
from crawlframe.functions.text import all_of
from crawlframe.sources.shipping import ship

ELEMENTS = "page_id long, pos int, tag string, attrs map<string,string>, text string, depth int, parent int"
# Elements without content.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class _Elements(HTMLParser):
    """Rows of one page; text goes to the innermost open element."""

    def __init__(self, page_id: int):
        super().__init__(convert_charrefs=True)
        self.page_id, self.rows, self.open = page_id, [], []

    def handle_starttag(self, tag, attrs):
        parent = self.open[-1] if self.open else -1
        self.rows.append([self.page_id, len(self.rows), tag, {k: v or "" for k, v in attrs}, [], len(self.open), parent])
        if tag not in VOID:
            self.open.append(len(self.rows) - 1)

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, -1, -1):
            if self.rows[self.open[i]][2] == tag:
                del self.open[i:]
                break

    def handle_data(self, data):
        if self.open:
            self.rows[self.open[-1]][4].append(data)


#: Characters of pages whose rows are handed over together.
BATCH_CHARS = 2_000_000


def parsed(page_id: int, html: str | None) -> list[list]:
    """Element rows of one page. Marked sections are text; what the tokenizer gives up on ends its page there, not the job."""
    parser = _Elements(page_id)
    try:
        parser.feed((html or "").replace("<![", "&lt;!["))
        parser.close()
    except (AssertionError, ValueError):
        pass
    return [[*r[:4], "".join(r[4]).strip(), *r[5:]] for r in parser.rows]


def elements(pages: DataFrame) -> DataFrame:
    """``pages(page_id, html)`` -> one row per element, in document order; a null page has none."""
    ship(pages.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in ELEMENTS.replace("<string,string>", "").split(", ")]
        for batch in batches:  # of 64 MB at most, Spark's own bound
            rows, size = [], 0
            for page_id, html in zip(batch["page_id"], batch["html"], strict=True):
                rows += parsed(page_id, html)
                size += len(html or "")
                if size >= BATCH_CHARS:
                    yield pd.DataFrame(rows, columns=names)
                    rows, size = [], 0
            yield pd.DataFrame(rows, columns=names)

    return pages.select(F.col("page_id").cast("long"), "html").mapInPandas(run, ELEMENTS)


def title(html: Column) -> Column:
    return F.trim(F.regexp_extract(html, "(?is)<title>(.*?)</title>", 1))


def without_code(html: Column) -> Column:
    """Without scripts, styles and comments."""
    return F.regexp_replace(html, r"(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->", " ")


def visible_text(html: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(without_code(html), "(?s)<[^>]*>", " "), r"\s+", " "))


def count_tag(html: Column, tag: str) -> Column:
    return F.size(all_of(html, f"(?i)<{tag}[ >]"))


def links(pages: DataFrame) -> DataFrame:
    """``pages(page_id, url, html)`` -> links with resolved targets, anchors and flags, by pattern."""
    found = F.regexp_extract_all("html", F.lit(r'(?is)<a\s[^>]*>[^<]*</a>'), F.lit(0))
    rows = pages.select("page_id", "url", F.posexplode(found).alias("pos", "a"))
    rows = rows.select("page_id", "url", "pos", F.regexp_extract("a", r'(?i)href="([^"]*)"', 1).alias("href"), F.trim(F.regexp_extract("a", "(?s)>([^<]*)<", 1)).alias("anchor"), F.col("a").rlike(r'(?i)rel="[^"]*nofollow').alias("nofollow"))
    base = F.regexp_extract("url", "^([a-z]+://[^/?#]*)", 1)
    target = F.when(F.col("href").rlike("^[a-z]+://"), F.col("href")).when(F.col("href").startswith("/"), F.concat(base, "href")).otherwise(F.concat(base, F.lit("/"), "href"))
    rows = rows.withColumn("target", target)
    weak = F.lower("anchor").isin("click here", "here", "read more", "more", "link")
    return rows.select("page_id", "pos", "href", "target", "anchor", "nofollow", (U.host(F.col("target")) == U.host(F.col("url"))).alias("internal"), weak.alias("weak"))


def heading_outline(el: DataFrame) -> DataFrame:
    """Per page: first level, skips of more than one level, repeated texts."""
    h = el.where(F.col("tag").rlike("^h[1-6]$")).select("page_id", "pos", F.substring("tag", 2, 1).cast("int").alias("level"), F.lower("text").alias("t"))
    before = F.lag("level").over(Window.partitionBy("page_id").orderBy("pos"))
    h = h.withColumn("skip", F.col("level") - before > 1)
    return h.groupBy("page_id").agg(F.count("*").alias("headings"), F.min_by("level", "pos").alias("first_level"), F.count_if("skip").alias("level_skips"), (F.count("t") - F.count_distinct("t")).alias("repeated_texts"))


# What a snapshot loses for each kind of difference, at most.
MISSING_POINTS = {"text": 40.0, "links": 25.0, "headings": 20.0, "meta": 15.0}


def snapshot_diff(raw: DataFrame, rendered: DataFrame) -> DataFrame:
    """``(page_id, text, hrefs, headings, meta map)`` of both sides, compared.

    Coverage of the text, links added and removed, headings added and removed, and meta fields that are the same, changed, or
    on one side only. The score is 100 less what the raw side lacks of the rendered one. A page on one side only is compared
    with an empty one.
    """
    a = raw.select("page_id", *[F.col(c).alias(f"{c}_a") for c in ("text", "hrefs", "headings", "meta")])
    b = rendered.select("page_id", *[F.col(c).alias(f"{c}_b") for c in ("text", "hrefs", "headings", "meta")])
    j = a.join(b, "page_id", "full_outer")
    none, empty = F.array().cast("array<string>"), F.create_map().cast("map<string,string>")
    la, lb, ha, hb = (F.coalesce(x, none) for x in ("hrefs_a", "hrefs_b", "headings_a", "headings_b"))
    na, nb = F.coalesce(F.length("text_a"), F.lit(0)), F.coalesce(F.length("text_b"), F.lit(0))
    j = j.withColumns({"ma": F.map_filter(F.coalesce("meta_a", empty), lambda k, v: v != ""), "mb": F.map_filter(F.coalesce("meta_b", empty), lambda k, v: v != "")})
    keys = F.array_union(F.map_keys("ma"), F.map_keys("mb"))
    count = lambda f: F.size(F.filter(keys, f))
    in_a, in_b = (lambda k: F.map_contains_key("ma", k)), (lambda k: F.map_contains_key("mb", k))
    j = j.select(
        "page_id",
        na.alias("raw_chars"),
        nb.alias("rendered_chars"),
        F.size(F.array_except(lb, la)).alias("links_added"),
        F.size(F.array_except(la, lb)).alias("links_removed"),
        F.size(F.array_except(hb, ha)).alias("headings_added"),
        F.size(F.array_except(ha, hb)).alias("headings_removed"),
        count(lambda k: in_a(k) & in_b(k) & (F.col("ma")[k] == F.col("mb")[k])).alias("meta_same"),
        count(lambda k: in_a(k) & in_b(k) & (F.col("ma")[k] != F.col("mb")[k])).alias("meta_changed"),
        count(lambda k: ~in_b(k)).alias("meta_raw_only"),
        count(lambda k: ~in_a(k)).alias("meta_rendered_only"),
        F.size(lb).alias("n_links"),
        F.size(hb).alias("n_headings"),
        F.size(keys).alias("n_meta"),
    )
    part = lambda n, of: n / F.greatest(F.lit(1), of)
    p = MISSING_POINTS
    lost = (
        part(F.greatest(F.lit(0), F.col("rendered_chars") - F.col("raw_chars")), F.col("rendered_chars")) * p["text"]
        + part(F.col("links_added"), F.col("n_links")) * p["links"]
        + part(F.col("headings_added"), F.col("n_headings")) * p["headings"]
        + part(F.col("meta_changed") + F.col("meta_rendered_only"), F.col("n_meta")) * p["meta"]
    )
    coverage = F.least(F.lit(1.0), F.col("raw_chars") / F.greatest(F.lit(1), F.col("rendered_chars")))
    return j.withColumns({"coverage": F.floor(coverage * 10000.0 + 0.5) / 10000.0, "score": F.floor((100.0 - lost) * 10.0 + 0.5) / 10.0}).drop("n_links", "n_headings", "n_meta")
