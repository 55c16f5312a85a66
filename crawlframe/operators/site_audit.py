"""What only a site as a whole shows: repeated titles, depths, broken links, images; and what could be won, step by step."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlframe.functions.common import rnd
from crawlframe.sources.shipping import ship

# Codes with their severities, limits of the site-level rules.
SITE_CODES = {
    "duplicate_title": "warning",
    "duplicate_meta_description": "warning",
    "deep_click_depth": "warning",
    "broken_links_on_page": "warning",
    "low_modern_image_formats_site": "warning",
    "large_images": "warning",
    "very_large_images": "critical",
    "security_missing_csp": "warning",
    "security_missing_hsts": "warning",
    "security_missing_xfo": "info",
    "security_missing_referrer_policy": "info",
    "security_missing_permissions_policy": "info",
    "security_mixed_content_homepage": "warning",
    "request_failed": "critical",
}
DEEP = 3
MODERN_SHARE = 50.0
LARGE_BYTES, VERY_LARGE_BYTES = 500 * 1024, 1024 * 1024
MODERN = ["webp", "avif", "svg"]
HEADERS = {"security_missing_csp": "csp", "security_missing_xfo": "xfo", "security_missing_referrer_policy": "referrer_policy", "security_missing_permissions_policy": "permissions_policy"}


def _repeated(pages: DataFrame, column: str) -> DataFrame:
    """``(site, value, count)`` of values that stand on several pages of a site; written counts, so pages are not gathered by them."""
    return pages.where(F.coalesce(F.col(column), F.lit("")) != "").groupBy("site", column).agg(F.count("*").alias(f"same_{column}")).where(F.col(f"same_{column}") > 1)


def site_issues(pages: DataFrame, links: DataFrame, images: DataFrame) -> DataFrame:
    """``(page_id, code, severity, details)`` of rules that need other rows of a site.

    ``pages(page_id, site, url, title, description, status, depth, home, https, hsts, csp, xfo, referrer_policy,
    permissions_policy, mixed)``; ``links(page_id, target, status)`` as checked; ``images(site, src, bytes, format)``. A status
    that is null is a request that failed. Rules on headers and images are told of the home page of a site; where it has
    several pages marked so, of the first.
    """
    out = []
    for column, code in (("title", "duplicate_title"), ("description", "duplicate_meta_description")):
        found = pages.select("page_id", "site", column).join(_repeated(pages, column), ["site", column])
        out.append(found.select("page_id", F.lit(code).alias("code"), F.col(f"same_{column}").cast("string").alias("details")))
    deep = pages.where(F.col("depth") > DEEP)
    out.append(deep.select("page_id", F.lit("deep_click_depth").alias("code"), F.col("depth").cast("string").alias("details")))
    broken = links.where((F.col("status") >= 400) | F.col("status").isNull()).groupBy("page_id").agg(F.count_distinct("target").alias("n"))
    out.append(broken.select("page_id", F.lit("broken_links_on_page").alias("code"), F.col("n").cast("string").alias("details")))
    out.append(pages.where("status is null").select("page_id", F.lit("request_failed").alias("code"), F.lit("").alias("details")))
    home = pages.where("home").groupBy("site").agg(F.min("page_id").alias("page_id"))
    head = pages.join(home, ["site", "page_id"])
    missing = [F.when(~F.coalesce(F.col(c), F.lit(False)), code) for code, c in HEADERS.items()]
    missing += [F.when(F.col("https") & ~F.coalesce(F.col("hsts"), F.lit(False)), "security_missing_hsts"), F.when(F.col("mixed") > 0, "security_mixed_content_homepage")]
    out.append(head.select("page_id", F.explode(F.array_compact(F.array(*missing))).alias("code"), F.lit("").alias("details")))
    sized = images.dropDuplicates(["site", "src"]).groupBy("site").agg(
        F.count("*").alias("n"), F.count_if(F.col("format").isin(*MODERN)).alias("modern"), F.count_if(F.col("bytes") > LARGE_BYTES).alias("large"), F.count_if(F.col("bytes") > VERY_LARGE_BYTES).alias("very_large")
    )
    share = rnd(F.col("modern") / F.col("n") * 100.0, 1)
    told = F.array_compact(F.array(
        F.when(share < MODERN_SHARE, F.struct(F.lit("low_modern_image_formats_site").alias("code"), F.concat_ws("/", "modern", "n").alias("details"))),
        F.when(F.col("very_large") > 0, F.struct(F.lit("very_large_images").alias("code"), F.col("very_large").cast("string").alias("details"))).when(F.col("large") > 0, F.struct(F.lit("large_images").alias("code"), F.col("large").cast("string").alias("details"))),
    ))
    out.append(sized.join(home, "site").select("page_id", F.explode(told).alias("x")).select("page_id", "x.code", "x.details"))
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    severity = F.create_map(*[F.lit(x) for kv in SITE_CODES.items() for x in kv])[F.col("code")]
    return found.select("page_id", "code", severity.alias("severity"), "details")


# What can be won, in this order: name, condition, points.
PROJECTED = [("schema_coverage", "schema < 50", 12.0), ("author_and_date", "author = 0", 8.0), ("trust_signals", "trust < 50", 5.0)]


def waterfall(pages: DataFrame, base: str, steps: list[tuple[str, str, float]] = PROJECTED, top: float = 100.0) -> DataFrame:
    """``(page_id, step, label, before, after, gained)``: the score after each step that applies, in order.

    A step gains its points, but no more than those before it left below the top; what is gained adds up to the last score.
    Pages to which no step applies have one row, step 0, that says what they have.
    """
    asked = F.array_compact(F.array(*[F.when(F.expr(when), F.struct(F.lit(label).alias("label"), F.lit(points).alias("points"))) for label, when, points in steps]))
    start = F.col(base).cast("double")
    kind = "array<struct<label:string,before:double,after:double>>"

    def add(s: Column, x: Column) -> Column:
        now = F.when(F.size(s) > 0, F.get(s, F.size(s) - 1)["after"]).otherwise(start)
        return F.concat(s, F.array(F.struct(x["label"].alias("label"), now.alias("before"), F.greatest(now, F.least(F.lit(top), now + x["points"])).alias("after"))))

    made = F.aggregate(asked, F.array().cast(kind), add)
    rows = pages.select("page_id", start.alias("start"), F.posexplode_outer(made).alias("at", "s"))
    before, after = F.coalesce("s.before", "start"), F.coalesce("s.after", "start")
    return rows.select("page_id", F.coalesce(F.col("at") + 1, F.lit(0)).alias("step"), F.coalesce("s.label", F.lit("none")).alias("label"), rnd(before, 2).alias("before"), rnd(after, 2).alias("after"), rnd(after - before, 2).alias("gained"))


def in_order(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence: the longest rising run through the places of a's items in b."""
    places: dict[str, list[int]] = {}
    for i, x in enumerate(b):
        places.setdefault(x, []).append(i)
    ends: list[int] = []
    for x in a:
        for i in reversed(places.get(x, ())):
            at = bisect_left(ends, i)
            if at == len(ends):
                ends.append(i)
            else:
                ends[at] = i
    return len(ends)


_ALIGNED = "page_id long, kind string, bot string, seen long, got long, missing long, added long, moved long"


def aligned_lists(snapshots: DataFrame) -> DataFrame:
    """``snapshots(page_id, kind, bot, seen, got)``, lists of a browser and of a bot in document order, compared as sequences.

    ``missing`` items the bot did not get, ``added`` ones only it got (repeats count), ``moved`` those of both that do not stand
    in the browser's order. A null list is empty.
    """
    ship(snapshots.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for page, kind, bot, seen, got in zip(*[batch[c] for c in ("page_id", "kind", "bot", "seen", "got")], strict=True):
                seen, got = list(seen if seen is not None else ()), list(got if got is not None else ())
                left = {}
                for x in got:
                    left[x] = left.get(x, 0) + 1
                both = 0
                for x in seen:
                    if left.get(x, 0):
                        left[x] -= 1
                        both += 1
                rows.append((page, kind, bot, len(seen), len(got), len(seen) - both, len(got) - both, both - in_order(seen, got)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _ALIGNED.split(", ")])

    return snapshots.select(F.col("page_id").cast("long"), "kind", "bot", "seen", "got").mapInPandas(run, _ALIGNED)
