"""Scans: exports with foreign headers, keyword lists, sitemaps, vitals reports."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Headers that exports use for a field, in order of preference.
ALIASES = {
    "page_title": ["referring page title", "page title", "title"],
    "source_url": ["source_url", "referring page url", "referring_url", "source", "url_from", "from", "referrer", "referring page", "source page", "url"],
    "target_url": ["target_url", "target url", "target", "url_to", "to", "destination", "target page", "url target"],
    "anchor": ["anchor", "anchor_text", "text", "anchor text"],
    "follow": ["follow", "link_type", "type", "rel", "is_dofollow", "dofollow"],
    "nofollow": ["nofollow"],
    "redirect_chain_status": ["redirect chain status codes", "redirect_status_codes", "redirect status", "status codes"],
    "link_type": ["type", "link type"],
    "platform": ["platform"],
    "http_code": ["http_code", "referring page http code", "http code", "status"],
    "language": ["language", "lang"],
    "lost_status": ["lost status", "drop reason", "discovered status"],
    "drop_reason": ["drop reason"],
    "discovered_status": ["discovered status"],
    "first_seen": ["first seen"],
    "last_seen": ["last seen"],
    "lost": ["lost"],
    "content": ["content"],
    "ugc": ["ugc"],
    "sponsored": ["sponsored"],
    "rendered": ["rendered"],
    "raw": ["raw"],
    "external_links": ["external links"],
    "linked_domains": ["linked domains"],
    "referring_domains": ["referring domains"],
    "page_traffic": ["page traffic"],
    "keywords": ["keywords"],
    "author": ["author"],
    "links_in_group": ["links in group"],
    "left_context": ["left context"],
    "right_context": ["right context"],
    "redirect_chain_urls": ["redirect chain urls"],
    "ur": ["ur", "url rating"],
    "dr": ["dr", "domain rating", "domain_rating", "ahrefs_dr"],
    "traffic": ["traffic", "domain traffic", "organic / traffic", "organic_traffic", "ahrefs_traffic"],
}
FLAGS = ["nofollow", "lost", "ugc", "sponsored", "rendered", "raw"]
NUMBERS = ["external_links", "linked_domains", "referring_domains", "page_traffic", "keywords", "links_in_group", "ur", "dr", "traffic"]
LOWER = ["link_type", "platform", "language", "lost_status", "drop_reason", "discovered_status", "content"]
METRIC_ALIASES = {
    "domain": ["domain", "target", "referring_domain", "site", "host"],
    "dr": ["dr", "domain rating", "domain_rating", "ahrefs_dr"],
    "traffic": ["traffic", "organic / traffic", "domain traffic", "organic_traffic", "ahrefs_traffic"],
    "backlinks_all": ["backlinks / all", "backlinks_all", "total backlinks"],
    "backlinks_followed": ["backlinks / followed", "backlinks_followed"],
    "backlinks_not_followed": ["backlinks / not followed", "backlinks_not_followed"],
    "backlinks_redirects": ["backlinks / redirects", "backlinks_redirects"],
    "backlinks_internal": ["backlinks / internal", "backlinks_internal"],
    "ref_domains_all": ["ref. domains / all", "ref domains all", "ref_domains_all"],
    "ref_domains_followed": ["ref. domains / followed", "ref_domains_followed"],
    "ref_domains_not_followed": ["ref. domains / not followed", "ref_domains_not_followed"],
    "organic_keywords_total": ["organic / total keywords", "organic_keywords_total"],
    "organic_keywords_top3": ["organic / keywords (top 3)", "organic_keywords_top3"],
    "organic_keywords_4_10": ["organic / keywords (4-10)", "organic_keywords_4_10"],
    "organic_keywords_11_20": ["organic / keywords (11-20)", "organic_keywords_11_20"],
    "paid_keywords": ["paid / keywords", "paid_keywords"],
    "paid_traffic": ["paid / traffic", "paid_traffic"],
    "outgoing_domains_followed": ["outgoing domains / followed", "outgoing_domains_followed"],
    "outgoing_domains_all_time": ["outgoing domains / all time", "outgoing_domains_all_time"],
    "outgoing_links_followed": ["outgoing links / followed", "outgoing_links_followed"],
    "outgoing_links_all_time": ["outgoing links / all time", "outgoing_links_all_time"],
}


SEPARATORS = ["\t", ";", ",", "|"]
HEAD_BYTES = 8192
#: Charsets that Spark reads by itself.
OWN_CHARSETS = {"utf-8", "us-ascii", "iso-8859-1", "utf-16", "utf-16be", "utf-16le", "utf-32"}


def _head(spark: SparkSession, path: str) -> bytes:
    """The first bytes of the first file under a path, wherever Spark can read it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = target.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [f.getPath() for f in store.listStatus(target) if f.isFile() and f.getLen() and f.getPath().getName()[0] not in "._"]
    if not found:
        return b""
    stream = store.open(min(found, key=lambda p: p.getName()))
    try:
        return bytes(stream.readNBytes(HEAD_BYTES))
    finally:
        stream.close()


def encoding_of(head: bytes) -> str:
    """By its mark, by zero bytes, else UTF-8 if that can be read and Windows-1251 if not."""
    if head.startswith(b"\xef\xbb\xbf"):
        return "UTF-8"
    if head.startswith((b"\xff\xfe", b"\xfe\xff")) or head.count(0) > 0.1 * len(head):
        return "UTF-16" if head.startswith((b"\xff\xfe", b"\xfe\xff")) else "UTF-16LE"
    for cut in range(4):  # the head may end within a character
        try:
            head[: len(head) - cut].decode("utf-8")
            return "UTF-8"
        except UnicodeDecodeError:
            continue
    return "windows-1251"


def told_encoding(spark: SparkSession, path: str, head: bytes) -> str:
    """By the first bytes; where these are plain ASCII, which code pages share, by whether all lines are UTF-8.

    The first file may hold a header only, or no other letters for long.
    """
    found = encoding_of(head)
    if found == "UTF-8" and head.isascii() and spark.read.text(path).where(~F.is_valid_utf8("value")).limit(1).count():
        return "windows-1251"
    return found


def separator_of(head: str) -> str:
    """What parts the first line that is not empty: a tab if no other mark is more frequent, else the most frequent one."""
    line = next((x for x in head.lstrip("\ufeff").splitlines() if x.strip()), "")
    return max(SEPARATORS, key=line.count) if any(map(line.count, SEPARATORS)) else ","


def read_export(spark: SparkSession, path: str, sep: str | None = None, encoding: str | None = None) -> DataFrame:
    """An export as strings; malformed rows are kept with what could be read.

    Encoding and separator that are not given are told from the first bytes, or from all lines where these do not tell.
    """
    if sep is None or encoding is None:
        head = _head(spark, path)
        encoding = encoding or told_encoding(spark, path, head)
        sep = sep or separator_of(head.decode(encoding, "ignore"))
    if encoding.lower() not in OWN_CHARSETS:
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")  # other code pages, as exports have them
    return spark.read.csv(path, header=True, sep=sep, encoding=encoding, multiLine=True, mode="PERMISSIVE", escape='"')


def split_rows(lines: DataFrame, headers: list[str], sep: str) -> DataFrame:
    """``lines(line)`` cut at every separator: short rows are filled up, what is too much stays in the last field."""
    parts = F.split("line", rf"\Q{sep}\E", len(headers))
    return lines.where(F.trim("line") != "").select(*[F.coalesce(F.get(parts, i), F.lit("")).alias(h) for i, h in enumerate(headers)])


def pick_fields(df: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """The wanted fields, each from the first of its headers that is there and not empty; null without any."""
    have = {c.strip().lstrip("\ufeff").lower(): c for c in df.columns}

    def pick(names: list[str]) -> Column:
        found = [F.when(F.trim(df[f"`{have[n]}`"]) != "", F.trim(df[f"`{have[n]}`"])) for n in names if n in have]
        return F.coalesce(*found) if found else F.lit(None).cast("string")

    return df.select(*[pick(names).alias(field) for field, names in aliases.items()])


def number(x: Column) -> Column:
    return F.replace(F.trim(x), F.lit(","), F.lit(".")).try_cast("double")


def flag(x: Column) -> Column:
    v = F.lower(F.trim(x))
    return F.when(v.isin("1", "true", "yes", "y", "on", "dofollow", "follow", "lost"), True).when(v.isin("0", "false", "no", "n", "off", "nofollow", "no-follow"), False)


def backlink_rows(df: DataFrame) -> DataFrame:
    """All fields of a backlink export under whatever headers it has, with flags, numbers and lower-case marks.

    A link that is not said to be followed is so if it is said not to be nofollow; one that is flagged as lost has that status.
    """
    r = pick_fields(df, ALIASES)
    typed = {c: flag(F.col(c)) for c in FLAGS} | {c: number(F.col(c)) for c in NUMBERS} | {c: F.lower(c) for c in LOWER}
    r = r.withColumns(typed | {"follow": flag(F.col("follow"))})
    return r.withColumns({"follow": F.coalesce("follow", ~F.col("nofollow")), "lost_status": F.coalesce("lost_status", F.when(F.col("lost"), "lost"))})


def metric_rows(df: DataFrame) -> DataFrame:
    """Domain metrics of an export under whatever headers it has, as numbers; the domain in lower case without its ``www.``."""
    r = pick_fields(df, METRIC_ALIASES)
    domain = F.regexp_replace(F.regexp_replace(F.lower("domain"), "^[a-z]+://", ""), "^www\\.|[/?#].*$", "")
    return r.withColumns({c: number(F.col(c)) for c in METRIC_ALIASES if c != "domain"} | {"domain": domain})


def read_exports(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Exports with different columns as one table, each row with the ``file`` that it came from."""
    read = [read_export(spark, p).withColumn("file", F.col("_metadata.file_path")) for p in paths]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), read)


#: What the first cell of a table without headers looks like.
_NUMERIC = r"[+-]?\d+(?:[.,]\d+)?"


def read_keyword_table(spark: SparkSession, path: str) -> DataFrame:
    """``(keyword, frequency)`` of a keyword table. If its first cell is a number it has no headers.

    Then keywords stand in the first column that does not begin with a number, frequencies in the first that does.
    """
    head = _head(spark, path)
    encoding = told_encoding(spark, path, head)
    text = head.decode(encoding, "ignore")
    sep = separator_of(text)
    first = next((x for x in text.lstrip("\ufeff").splitlines() if x.strip()), "")
    cells = [c.strip().strip('"') for c in first.split(sep)]
    if not re.fullmatch(_NUMERIC, cells[0]):
        got = pick_fields(read_export(spark, path, sep, encoding), {"keyword": ["keyword", "query"], "frequency": ["volume", "frequency"]})
        return got.select("keyword", number(F.col("frequency")).alias("frequency"))
    rows = spark.read.csv(path, header=False, sep=sep, encoding=encoding, multiLine=True, mode="PERMISSIVE", escape='"')
    texts = [i for i, c in enumerate(cells) if not re.fullmatch(_NUMERIC, c)]
    numbers = [i for i, c in enumerate(cells) if re.fullmatch(_NUMERIC, c)]
    keyword = F.trim(rows[rows.columns[texts[0] if texts else 0]])
    return rows.select(keyword.alias("keyword"), number(rows[rows.columns[numbers[0]]]).alias("frequency")).where("keyword <> ''")


def parse_keyword_lines(lines: DataFrame) -> DataFrame:
    """``lines(pos, line)`` -> ``(pos, keyword, frequency)``: a keyword and a number after tab, ; > | : or a comma, or a list."""
    line = F.trim("line")
    pair = r"^(.*\S)\s*[\t;>|:,]\s*([0-9]+(?:[.,][0-9]+)?)$"
    is_pair = line.rlike(pair)
    parts = F.when(is_pair, F.array(F.regexp_extract(line, pair, 1))).otherwise(F.split(line, "[;,]"))
    rows = lines.select("pos", F.when(is_pair, number(F.regexp_extract(line, pair, 2))).otherwise(1.0).alias("frequency"), F.explode(parts).alias("keyword"))
    rows = rows.withColumn("keyword", F.trim("keyword")).where(F.col("keyword") != "")
    return rows.where(~F.col("keyword").rlike(r"^[0-9.,]+$")).select("pos", "keyword", "frequency")


_BLOCK = r"(?m)^[ \t]*[\"'](?![^\n]*[\"'][ \t]*$)[\s\S]*?[\"'][ \t]*$|^[^\n]*\S[^\n]*$"


def keyword_rows(texts: DataFrame) -> DataFrame:
    """``texts(file, text)`` -> ``(file, pos, line)``: lines, where a quoted block over several lines is one."""
    rows = F.regexp_extract_all(F.replace("text", F.lit("\r"), F.lit("\n")), F.lit(_BLOCK), F.lit(0))
    return texts.select("file", F.posexplode(rows).alias("pos", "line"))


def parse_keyword_rows(rows: DataFrame) -> DataFrame:
    """``rows(pos, line)`` -> ``(pos, keyword, frequency)``; of a block the last line is the number, if it is one."""
    block = F.contains("line", F.lit("\n"))
    bare = F.regexp_replace(F.trim("line"), "^[\"']|[\"']$", "")
    parts = F.filter(F.transform(F.split(bare, "\n"), lambda x: F.trim(F.regexp_replace(F.trim(x), "^[\"']+|[\"']+$", ""))), lambda x: x != "")
    b = rows.where(block).select("pos", parts.alias("parts")).where(F.size("parts") > 0)
    last = number(F.element_at("parts", -1))
    whole = (F.size("parts") < 2) | last.isNull()
    found = b.select("pos", F.when(whole, F.array_join("parts", " ")).otherwise(F.array_join(F.slice("parts", F.lit(1), F.size("parts") - 1), " ")).alias("keyword"), F.when(whole, 1.0).otherwise(F.least(last, F.lit(1e9))).alias("frequency"))
    return found.unionByName(parse_keyword_lines(rows.where(~block)))


def read_keyword_files(spark: SparkSession, path: str) -> DataFrame:
    """Keyword lists as whole files, as people type them; each is small, and there may be many."""
    texts = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("text"))
    rows = keyword_rows(texts).select(F.struct("file", "pos").alias("pos"), "line")
    return parse_keyword_rows(rows).select("pos.file", "pos.pos", "keyword", "frequency")


#: A url element with what may stand in it; namespaces are left out of the names.
SITEMAP_URL = "loc string, lastmod string, changefreq string, priority string, link array<struct<_hreflang: string, _href: string>>, image array<struct<loc: string>>"


def parse_sitemap_urls(rows: DataFrame) -> DataFrame:
    """Adds loc, lastmod, changefreq and priority from ``xml``, a url element per row."""
    schema = "loc string, lastmod string, changefreq string, priority string"
    parsed = rows.withColumn("u", F.from_xml("xml", schema, {"rowTag": "url", "nullValue": "\u0000", "inferSchema": "false"}))
    out = parsed.select(*rows.columns, "u.*")
    return reduce(lambda d, c: d.withColumn(c, F.coalesce(F.col(c), F.lit(""))), ["loc", "lastmod"], out)


def read_sitemaps(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Sitemap files (gzip too), one row per url element: ``(file, loc, lastmod, changefreq, priority, alternates, images)``."""
    rows = spark.read.format("xml").option("rowTag", "url").option("ignoreNamespace", True).option("inferSchema", False).schema(SITEMAP_URL).load(paths)
    alternates = F.transform(F.coalesce("link", F.array()), lambda x: F.struct(x["_hreflang"].alias("lang"), x["_href"].alias("target")))
    images = F.transform(F.coalesce("image", F.array()), lambda x: x["loc"])
    return rows.select(F.input_file_name().alias("file"), "loc", "lastmod", "changefreq", "priority", alternates.alias("alternates"), images.alias("images"))


def read_sitemap_index(spark: SparkSession, path: str, folder: str) -> DataFrame:
    """The urls of all sitemaps that an index lists, by the names that its addresses end with in a folder.

    An index lists at most 50,000 files by its own standard, so their names come to the driver.
    """
    listed = spark.read.format("xml").option("rowTag", "sitemap").option("ignoreNamespace", True).schema("loc string").load(path)
    names = sorted(r[0] for r in listed.select(F.regexp_extract("loc", "([^/]+)$", 1)).distinct().collect())
    return read_sitemaps(spark, [f"{folder}/{n}" for n in names])


def parse_vitals(reports: DataFrame) -> DataFrame:
    """``reports(site, raw)`` -> ``(site, score, metric, value)``: fixed parts by schema, the open map of audits as variant."""
    r = reports.select("site", F.from_json("raw", "categories struct<performance: struct<score: double>>").alias("c"), F.parse_json(F.get_json_object("raw", "$.audits")).alias("audits"))
    entries = F.try_variant_get("audits", "$", "map<string,variant>")
    return r.select("site", F.col("c.categories.performance.score").alias("score"), F.explode(entries).alias("metric", "v")).select("site", "score", "metric", F.try_variant_get("v", "$.numericValue", "double").alias("value"))


# Metrics of field reports. A layout shift is given in hundredths.
FIELD_METRICS = {"LARGEST_CONTENTFUL_PAINT_MS": "lcp", "INTERACTION_TO_NEXT_PAINT": "inp", "CUMULATIVE_LAYOUT_SHIFT_SCORE": "cls", "FIRST_CONTENTFUL_PAINT_MS": "fcp", "EXPERIMENTAL_TIME_TO_FIRST_BYTE": "ttfb"}


def parse_field_vitals(reports: DataFrame) -> DataFrame:
    """``reports(site, raw)`` -> ``(site, scope, metric, percentile, category)`` of page and origin experience in the field."""
    names = F.create_map(*[F.lit(x) for kv in FIELD_METRICS.items() for x in kv])
    kind = "map<string,struct<percentile: double, category: string>>"
    parts = {"page": "$.loadingExperience.metrics", "origin": "$.originLoadingExperience.metrics"}
    rows = [reports.select("site", F.lit(scope).alias("scope"), F.explode(F.from_json(F.get_json_object("raw", path), kind)).alias("name", "m")) for scope, path in parts.items()]
    all_ = reduce(DataFrame.unionByName, rows).withColumn("metric", names[F.col("name")]).where("metric is not null")
    value = F.when(F.col("metric") == "cls", F.col("m.percentile") / 100.0).otherwise(F.col("m.percentile"))
    return all_.select("site", "scope", "metric", value.alias("percentile"), F.lower("m.category").alias("category"))


def category_scores(reports: DataFrame) -> DataFrame:
    """``reports(site, raw)`` -> ``(site, category, score)``, scores out of a hundred."""
    scores = F.from_json(F.get_json_object("raw", "$.categories"), "map<string,struct<score: double>>")
    return reports.select("site", F.explode(scores).alias("category", "s")).select("site", "category", (F.col("s.score") * 100.0).alias("score"))
