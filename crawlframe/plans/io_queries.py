"""Queries that write one of the views in an exchange format and read it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from crawlframe.functions.common import exact_mean, exact_mean_sql, rnd, rnd_sql
from crawlframe.plans.adapters import BACKLINKS, KEYWORDS, backlinks, keywords
from crawlframe.plans.event_queries import VITALS, vitals
from crawlframe.plans.registry import query, table
from crawlframe.plans.site_queries import _SITEMAP, sitemap_urls
from crawlframe.sources import readers as R
from crawlframe.sources import sinks as W
from crawlframe.sources.scratch import scratch_path

def _export(links):
    """The view under the headers of an export, numbers with decimal commas."""
    return links.select(F.col("source_url").alias("Referring page URL"), F.col("target_url").alias("Target URL"), F.regexp_replace(F.col("dr").cast("string"), r"\.", ",").alias("Domain rating"), F.when(F.col("follow"), "dofollow").otherwise("nofollow").alias("Type"), F.col("http_code").alias("Referring page HTTP code"))


@query(f"WITH {BACKLINKS} SELECT source_url, target_url, dr, coalesce(follow, FALSE) AS follow, nullif(http_code, '') AS http_code FROM bl")
def a1_backlink_export(spark, sf_dir):
    """A backlink export with foreign headers, written as CSV and read back through the alias table."""
    path = scratch_path(spark, "export")
    _export(backlinks(spark, sf_dir)).write.csv(path, header=True, sep=";")
    got = R.pick_fields(R.read_export(spark, path, sep=";"), {k: R.ALIASES[k] for k in ("source_url", "target_url", "dr", "follow", "http_code")})
    return got.select("source_url", "target_url", R.number(F.col("dr")).alias("dr"), R.flag(F.col("follow")).alias("follow"), "http_code")


@query(f"WITH {BACKLINKS} SELECT CASE link_id % 2 WHEN 0 THEN 'first.csv' ELSE 'second.csv' END AS file, source_url, dr, CASE WHEN link_id % 2 = 0 THEN nullif(trim(anchor), '') END AS anchor FROM bl")
def g1_union_of_exports(spark, sf_dir):
    """Two exports with different columns and separators, written and read as one table, with the file each row came from."""
    links, path = backlinks(spark, sf_dir), scratch_path(spark, "exports")
    links.where("link_id % 2 = 0").select("source_url", F.col("dr").alias("Domain Rating"), F.col("anchor").alias("Anchor Text")).write.csv(f"{path}/first.csv", header=True, sep=";")
    links.where("link_id % 2 = 1").select(F.col("source_url").alias("Referring Page URL"), "dr").write.csv(f"{path}/second.csv", header=True, sep="\t")
    rows = R.read_exports(spark, [f"{path}/first.csv", f"{path}/second.csv"])
    got = R.pick_fields(rows, {"file": ["file"], **{k: R.ALIASES[k] for k in ("source_url", "dr", "anchor")}})
    return got.select(F.regexp_extract("file", "/([^/]*)/[^/]*$", 1).alias("file"), "source_url", R.number(F.col("dr")).alias("dr"), "anchor")


@query(f"WITH {BACKLINKS} SELECT source_url, target_url, dr, CASE WHEN link_id % 3 = 0 THEN TRUE WHEN link_id % 3 = 1 THEN FALSE END AS follow, CASE link_id % 4 WHEN 0 THEN 'not found' WHEN 1 THEN 'lost' END AS lost_status, CAST(link_id % 50 AS DOUBLE) AS external_links, 'en' AS language, '301,200' AS redirect_chain_status, CAST(NULL AS DOUBLE) AS ur, link_id % 2 = 0 AS ugc FROM bl")
def b6_backlink_headers(spark, sf_dir):
    """A backlink export under foreign headers, all fields typed."""
    nofollow = F.when(F.col("link_id") % 3 == 0, "false").when(F.col("link_id") % 3 == 1, "true")
    raw = backlinks(spark, sf_dir).select(
        F.col("source_url").alias("Referrer"), F.col("target_url").alias("URL target"), F.col("dr").cast("string").alias("Ahrefs_DR"), nofollow.alias("Nofollow"),
        F.when(F.col("link_id") % 4 == 0, "Not Found").alias("Drop reason"), F.when(F.col("link_id") % 4 == 1, "true").otherwise("false").alias("Lost"),
        F.concat((F.col("link_id") % 50).cast("string"), F.lit(",0")).alias("External links"), F.lit(" EN ").alias("Lang"), F.lit("301,200").alias("Redirect status"), F.when(F.col("link_id") % 2 == 0, "yes").otherwise("no").alias("UGC"),
    )
    return R.backlink_rows(raw).select("source_url", "target_url", "dr", "follow", "lost_status", "external_links", "language", "redirect_chain_status", "ur", "ugc")


@query("SELECT 's' || s_suppkey || '.example.com' AS domain, CAST(s_suppkey % 90 AS DOUBLE) AS dr, CAST(s_suppkey * 10 AS DOUBLE) AS backlinks_all, CAST(s_suppkey % 7 AS DOUBLE) AS ref_domains_not_followed, CAST(s_suppkey % 5 AS DOUBLE) + 0.5 AS organic_keywords_4_10, CAST(NULL AS DOUBLE) AS paid_traffic, CAST(s_suppkey % 3 AS DOUBLE) AS outgoing_links_all_time FROM supplier")
def b6_metric_headers(spark, sf_dir):
    """Domain metrics under foreign headers."""
    n = lambda e: F.expr(e).cast("string")
    raw = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("https://WWW.S"), "s_suppkey", F.lit(".example.com/x?y")).alias("Host"), n("s_suppkey % 90").alias("Domain Rating"), n("s_suppkey * 10").alias("Total Backlinks"), n("s_suppkey % 7").alias("Ref. domains / Not followed"),
        F.concat(n("s_suppkey % 5"), F.lit(",5")).alias("Organic / Keywords (4-10)"), F.lit("n/a").alias("Paid / Traffic"), n("s_suppkey % 3").alias("outgoing_links_all_time"),
    )
    return R.metric_rows(raw).select("domain", "dr", "backlinks_all", "ref_domains_not_followed", "organic_keywords_4_10", "paid_traffic", "outgoing_links_all_time")


@query(f"WITH {BACKLINKS} SELECT link_id, coalesce(nullif(trim(source_url), ''), NULL) AS source_url, dr, CAST(NULL AS VARCHAR) AS lost FROM bl")
def b6_alias_pick(spark, sf_dir):
    """Fields from whichever header is there; null where none is."""
    raw = backlinks(spark, sf_dir).select(F.col("link_id").cast("string").alias("link_id"), F.lit("").alias("source_url"), F.col("source_url").alias("Referring Page URL"), F.col("dr").cast("string").alias("Domain Rating"))
    got = R.pick_fields(raw, {"link_id": ["link_id"], "source_url": R.ALIASES["source_url"], "dr": R.ALIASES["dr"], "lost": R.ALIASES["lost"]})
    return got.select(F.col("link_id").cast("long").alias("link_id"), "source_url", R.number(F.col("dr")).alias("dr"), "lost")


@query(f"WITH {KEYWORDS} SELECT keyword, CAST(sum(frequency) AS DOUBLE) AS frequency FROM kw GROUP BY keyword")
def a2_keyword_file(spark, sf_dir):
    """A keyword table with a volume column, written and read by header."""
    path = scratch_path(spark, "keywords")
    keywords(spark, sf_dir).groupBy("keyword").agg(F.sum("frequency").alias("volume")).select(F.col("keyword").alias("Keyword"), F.col("volume").alias("Volume")).write.csv(path, header=True)
    got = R.pick_fields(R.read_export(spark, path), {"keyword": ["keyword", "query"], "frequency": ["volume", "frequency"]})
    return got.select("keyword", R.number(F.col("frequency")).alias("frequency"))


@query(f"WITH {KEYWORDS} SELECT keyword, CAST(sum(frequency) AS DOUBLE) AS frequency FROM kw GROUP BY keyword")
def a2_headerless_file(spark, sf_dir):
    """A keyword table without headers, its numbers first."""
    path = scratch_path(spark, "keywords")
    keywords(spark, sf_dir).groupBy("keyword").agg(F.sum("frequency").alias("n")).select("n", "keyword").write.csv(path, header=False, sep=";")
    return R.read_keyword_table(spark, path)


@query(f"WITH {KEYWORDS} SELECT pos, trim(replace(keyword, ',', ' ')) AS keyword, CASE WHEN pos % 3 = 2 THEN 1.0 ELSE frequency END AS frequency FROM kw")
def a3_keyword_lines(spark, sf_dir):
    """Free text: one keyword a line, with a number in two of three."""
    k = keywords(spark, sf_dir).withColumn("keyword", F.trim(F.replace("keyword", F.lit(","), F.lit(" "))))
    n = F.format_string("%.1f", F.col("frequency"))
    line = F.when(F.col("pos") % 3 == 0, F.concat("keyword", F.lit("\t"), n)).when(F.col("pos") % 3 == 1, F.concat("keyword", F.lit(" ; "), n)).otherwise(F.col("keyword"))
    return R.parse_keyword_lines(k.select("pos", line.alias("line")))


@query(f"WITH {VITALS}, g AS (SELECT site, metric, {rnd_sql('avg(value)', 4)} AS value FROM vt GROUP BY 1, 2), s AS (SELECT site, {rnd_sql('min(value) / 1000.0', 6)} AS score FROM g GROUP BY site) SELECT site, score, metric, value FROM g JOIN s USING (site)")
def a7_vitals_json(spark, sf_dir):
    """Reports as JSON, read back by schema and variant."""
    g = vitals(spark, sf_dir).groupBy("site", "metric").agg(rnd(F.avg("value"), 4).alias("value"))
    audits = F.map_from_entries(F.collect_list(F.struct("metric", F.struct(F.col("value").alias("numericValue")))))
    raw = g.groupBy("site").agg(F.to_json(F.struct(F.struct(F.struct(rnd(F.min("value") / 1000.0, 6).alias("score")).alias("performance")).alias("categories"), audits.alias("audits"))).alias("raw"))
    return R.parse_vitals(raw)


@query(
    """WITH d AS (SELECT (row_number() OVER (ORDER BY doc_id) - 1) // 400 AS part, doc_id, '{"doc_id":' || doc_id || CASE WHEN lang IS NULL THEN '' ELSE ',"lang":"' || lang || '"' END || ',"chars":' || length(coalesce(text, '')) || '}' || chr(10) AS line FROM documents),
p AS (SELECT part, count(*) AS rows, string_agg(line, '' ORDER BY doc_id) AS x FROM d GROUP BY 1) SELECT part, rows, CAST(octet_length(encode(x)) AS BIGINT) AS bytes, sha256(x) AS sha256 FROM p"""
)
def a8_chunked_json(spark, sf_dir):
    """Facts of documents as JSON lines in chunks: the manifest, file by file."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", F.length(F.coalesce("text", F.lit(""))).alias("chars"))
    return W.write_chunked_json(d, scratch_path(spark, "chunks"), ["doc_id"], 400)


@query(f"WITH {BACKLINKS}, g AS (SELECT source_domain, avg(CASE WHEN lost THEN 80.0 ELSE 20.0 END) AS score FROM bl GROUP BY 1) SELECT DISTINCT 'domain:' || source_domain AS value FROM g WHERE score >= 55")
def a9_disavow_file(spark, sf_dir):
    """The disavow list of risky donors, written as sorted text and read back."""
    scores = backlinks(spark, sf_dir).groupBy(F.col("source_domain").alias("domain")).agg(F.avg(F.when(F.col("lost"), 80.0).otherwise(20.0)).alias("score"))
    path = scratch_path(spark, "disavow")
    W.write_lines(W.disavow_lines(scores, 55), path)
    return spark.read.text(path)


@query(f"WITH {_SITEMAP} SELECT count(DISTINCT loc) AS urls FROM sm")
def a10_url_parts(spark, sf_dir):
    """Different sitemap URLs as text files in parts."""
    path = scratch_path(spark, "urls")
    W.write_url_parts(sitemap_urls(spark, sf_dir), path, 2_000)
    return spark.read.text(path).agg(F.count("*").alias("urls"))


@query(f"WITH {BACKLINKS} SELECT source_domain, count(*) AS links FROM bl GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def a11_report_table(spark, sf_dir):
    """A named table of a report with its limit."""
    donors = backlinks(spark, sf_dir).groupBy("source_domain").agg(F.count("*").alias("links"))
    return W.report_tables({"donors": donors}, {"donors": (20, [F.desc("links"), F.asc("source_domain")])})["donors"]



_CYRILLIC = "ссылка"


@query(f"WITH {BACKLINKS} SELECT source_url, anchor || ' {_CYRILLIC}' AS anchor, dr FROM bl")
def a1_sniffed_export(spark, sf_dir):
    """An export in a Windows code page with tabs, both of which are told from what is written."""
    path = scratch_path(spark, "sniffed")
    links = backlinks(spark, sf_dir).select(F.col("source_url").alias("Referring page URL"), F.concat_ws(" ", "anchor", F.lit(_CYRILLIC)).alias("Anchor text"), F.col("dr").alias("Domain rating"))
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    links.write.csv(path, header=True, sep="\t", encoding="windows-1251", ignoreLeadingWhiteSpace=False)
    got = R.read_export(spark, path)
    return got.select(F.col("Referring page URL").alias("source_url"), F.col("Anchor text").alias("anchor"), R.number(F.col("Domain rating")).alias("dr"))


@query(f"WITH {BACKLINKS} SELECT link_id, source_url, CASE WHEN link_id % 3 = 0 THEN '' WHEN link_id % 3 = 1 THEN anchor ELSE anchor || ';more;text' END AS anchor FROM bl")
def a1_split_rows(spark, sf_dir):
    """Rows that no quoting holds together: short ones are filled up, the last field takes what is too much."""
    path = scratch_path(spark, "lines")
    tail = F.when(F.col("link_id") % 3 == 0, "").when(F.col("link_id") % 3 == 1, F.concat(F.lit(";"), "anchor")).otherwise(F.concat(F.lit(";"), F.col("anchor"), F.lit(";more;text")))
    backlinks(spark, sf_dir).select(F.concat(F.col("link_id").cast("string"), F.lit(";"), "source_url", tail).alias("value")).write.text(path)
    got = R.split_rows(spark.read.text(path).withColumnRenamed("value", "line"), ["link_id", "source_url", "anchor"], ";")
    return got.select(F.col("link_id").cast("long").alias("link_id"), "source_url", "anchor")


@query(f"WITH {KEYWORDS}, g AS (SELECT keyword, CAST(sum(frequency) AS DOUBLE) AS n, row_number() OVER (ORDER BY keyword) % 4 AS r FROM kw GROUP BY keyword) SELECT keyword, CASE r WHEN 1 THEN 1.0 ELSE n END AS frequency FROM g")
def a3_keyword_blocks(spark, sf_dir):
    """Typed keyword lists, written as text files and read back: pairs, bare words, and quoted blocks over several lines."""
    from crawlframe.operators.sampling import ranked

    path = scratch_path(spark, "typed")
    k = keywords(spark, sf_dir).groupBy("keyword").agg(F.sum("frequency").alias("n"))
    k = ranked(k, [F.asc("keyword")], "r").withColumn("r", F.col("r") % 4)
    n, words = F.format_string("%.1f", F.col("n")), F.split("keyword", " ")
    block = F.concat(F.lit('"'), F.array_join(words, "\n"), F.lit("\n"), n, F.lit('"'))
    line = F.when(F.col("r") == 0, F.concat("keyword", F.lit("\t"), n)).when(F.col("r") == 1, F.col("keyword")).when(F.col("r") == 2, F.concat("keyword", F.lit("; "), n)).otherwise(block)
    k.select(line.alias("value")).write.text(path)
    return R.read_keyword_files(spark, path).select("keyword", "frequency")


@query(
    """SELECT 'https://s.example.com/' || page_id AS loc, '2024-0' || (1 + page_id % 9) || '-01' AS lastmod, CASE WHEN page_id % 2 = 0 THEN 'daily' ELSE 'often' END AS changefreq, 'de>https://s.example.com/de/' || page_id AS alternates, CASE WHEN page_id % 3 = 0 THEN 'https://s.example.com/i' || page_id || '.png' ELSE '' END AS images FROM pages WHERE page_id % 5 < 4"""
)
def a6_sitemap_files(spark, sf_dir):
    """Packed sitemap files that an index lists, with alternates and images; one file that it does not list is left out."""
    path = scratch_path(spark, "sitemaps")
    u = table(spark, sf_dir, "pages").select("page_id", (F.col("page_id") % 5).alias("part"))
    xml = F.expr("""concat('<url><loc>https://s.example.com/', page_id, '</loc><lastmod>2024-0', 1 + page_id % 9, '-01</lastmod><changefreq>', CASE WHEN page_id % 2 = 0 THEN 'daily' ELSE 'often' END, '</changefreq><xhtml:link rel="alternate" hreflang="de" href="https://s.example.com/de/', page_id, '"/>',
      CASE WHEN page_id % 3 = 0 THEN concat('<image:image><image:loc>https://s.example.com/i', page_id, '.png</image:loc></image:image>') ELSE '' END, '</url>')""")
    ends = spark.range(5).select(F.col("id").alias("part"), F.explode(F.array(F.lit(-1), F.lit(1))).alias("at"))
    root = F.when(F.col("at") < 0, '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9" xmlns:xhtml="http://www.w3.org/1999/xhtml" xmlns:image="http://www.google.com/schemas/sitemap-image/1.1">').otherwise("</urlset>")
    lines = u.select("part", F.lit(0).alias("at"), xml.alias("value")).unionByName(ends.select("part", "at", root.alias("value")))
    lines.repartition("part").sortWithinPartitions("part", "at").drop("at").write.partitionBy("part").text(f"{path}/files", compression="gzip")
    listed = F.concat_ws("", F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.concat(F.lit("<sitemap><loc>https://s.example.com/maps/part="), i.cast("string"), F.lit("</loc></sitemap>"))))
    spark.range(1).select(F.concat(F.lit("<sitemapindex>"), listed, F.lit("</sitemapindex>")).alias("value")).write.text(f"{path}/index")
    got = R.read_sitemap_index(spark, f"{path}/index", f"{path}/files")
    return got.select("loc", "lastmod", "changefreq", F.array_join(F.transform("alternates", lambda a: F.concat_ws(">", a["lang"], a["target"])), ",").alias("alternates"), F.array_join("images", ",").alias("images"))


@query(f"WITH {VITALS}, g AS (SELECT site, metric, floor({exact_mean_sql('value')}) AS p FROM vt WHERE metric IN ('lcp', 'cls') GROUP BY 1, 2) SELECT site, scope, metric, CASE WHEN metric = 'cls' THEN p / 100.0::DOUBLE ELSE p END AS percentile, CASE WHEN p > 2500 THEN 'slow' ELSE 'fast' END AS category FROM g, (VALUES ('page'), ('origin')) AS s(scope)")
def a7_field_vitals(spark, sf_dir):
    """Experience in the field, of the page and of its origin, from JSON reports."""
    g = vitals(spark, sf_dir).where("metric in ('lcp', 'cls')").groupBy("site", "metric").agg(F.floor(exact_mean(F.col("value"))).cast("double").alias("p"))
    name = F.when(F.col("metric") == "lcp", "LARGEST_CONTENTFUL_PAINT_MS").otherwise("CUMULATIVE_LAYOUT_SHIFT_SCORE")
    entry = F.struct(name.alias("name"), F.struct(F.col("p").alias("percentile"), F.when(F.col("p") > 2500, "SLOW").otherwise("FAST").alias("category")).alias("m"))
    raw = g.groupBy("site").agg(F.map_from_entries(F.collect_list(entry)).alias("metrics")).withColumn("e", F.struct("metrics"))
    return R.parse_field_vitals(raw.select("site", F.to_json(F.struct(F.col("e").alias("loadingExperience"), F.col("e").alias("originLoadingExperience"))).alias("raw")))


@query(f"WITH {VITALS}, g AS (SELECT site, metric, {rnd_sql(f"least(1.0, ({exact_mean_sql('value')}) / 5000.0)", 2)} AS v FROM vt WHERE metric IN ('lcp', 'fcp') GROUP BY 1, 2) SELECT site, CASE metric WHEN 'lcp' THEN 'performance' ELSE 'seo' END AS category, v * 100.0 AS score FROM g")
def a7_category_scores(spark, sf_dir):
    """Scores of all categories of JSON reports."""
    g = vitals(spark, sf_dir).where("metric in ('lcp', 'fcp')").groupBy("site", "metric").agg(rnd(F.least(F.lit(1.0), exact_mean(F.col("value")) / 5000.0), 2).alias("v"))
    entry = F.struct(F.when(F.col("metric") == "lcp", "performance").otherwise("seo").alias("name"), F.struct(F.col("v").alias("score")).alias("s"))
    raw = g.groupBy("site").agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(entry)).alias("categories"))).alias("raw"))
    return R.category_scores(raw)
