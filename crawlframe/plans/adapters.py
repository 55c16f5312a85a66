"""Views of the driver's tables as the inputs of the web operators, in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlframe.plans.registry import table

OUR = "t0.example.com"

BACKLINKS = """bl AS (SELECT l_orderkey AS link_id, 'https://www.d' || o_custkey || CASE o_custkey % 4 WHEN 0 THEN '.com' WHEN 1 THEN '.org' WHEN 2 THEN '.co.uk' ELSE '.de' END || '/p/' || l_partkey AS source_url,
 'd' || o_custkey || CASE o_custkey % 4 WHEN 0 THEN '.com' WHEN 1 THEN '.org' WHEN 2 THEN '.co.uk' ELSE '.de' END AS source_domain,
 't' || (l_suppkey % 8) || '.example.com' AS target_domain,
 'https://t' || (l_suppkey % 8) || '.example.com' || CASE WHEN l_partkey % 3 = 0 THEN '/' ELSE '/p/' || (l_partkey % 50) END AS target_url,
 CASE WHEN l_partkey % 11 = 0 THEN '' WHEN l_partkey % 7 = 0 THEN 'https://t' || (l_suppkey % 8) || '.example.com/' WHEN l_partkey % 5 = 0 THEN 'Buy ' || p_name ELSE p_name END AS anchor,
 CASE l_returnflag WHEN 'R' THEN TRUE WHEN 'N' THEN FALSE END AS follow, l_linestatus = 'F' AS lost, l_quantity * 2 AS dr, CAST(l_linenumber * 10 AS DOUBLE) AS ur,
 CASE WHEN l_partkey % 13 = 0 THEN NULL ELSE l_extendedprice END AS traffic,
 CASE l_suppkey % 5 WHEN 0 THEN '200' WHEN 1 THEN '301' WHEN 2 THEN '404' WHEN 3 THEN '200' ELSE '' END AS http_code,
 CASE WHEN l_quantity > 40 THEN TRUE WHEN l_quantity > 10 THEN FALSE END AS ugc, CASE WHEN l_tax > 0.06 THEN TRUE WHEN l_tax > 0.02 THEN FALSE END AS sponsored,
 CASE l_returnflag WHEN 'R' THEN 'text' WHEN 'A' THEN 'image' ELSE 'unknown' END AS link_type, CASE o_custkey % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'de' ELSE 'unknown' END AS language,
 CASE WHEN l_partkey % 10 <> 0 THEN CAST(l_partkey % 200 AS DOUBLE) END AS external_links, l_partkey % 3 <> 1 AS rendered, l_partkey % 4 = 0 AS raw,
 CAST(o_orderdate AS DATE) AS first_seen, CAST(l_shipdate AS DATE) AS last_seen
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey WHERE l_linenumber = 1)"""


def backlinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per link: first lines of orders, donors from customers, targets from suppliers."""
    l, o, p = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "part"))
    j = l.where("l_linenumber = 1").join(o, l.l_orderkey == o.o_orderkey).join(p, l.l_partkey == p.p_partkey)
    tld = F.expr("CASE o_custkey % 4 WHEN 0 THEN '.com' WHEN 1 THEN '.org' WHEN 2 THEN '.co.uk' ELSE '.de' END")
    target = F.concat(F.lit("t"), (F.col("l_suppkey") % 8).cast("string"), F.lit(".example.com"))
    return j.select(
        F.col("l_orderkey").alias("link_id"),
        F.concat(F.lit("https://www.d"), F.col("o_custkey").cast("string"), tld, F.lit("/p/"), F.col("l_partkey").cast("string")).alias("source_url"),
        F.concat(F.lit("d"), F.col("o_custkey").cast("string"), tld).alias("source_domain"),
        target.alias("target_domain"),
        F.concat(F.lit("https://"), target, F.when(F.col("l_partkey") % 3 == 0, "/").otherwise(F.concat(F.lit("/p/"), (F.col("l_partkey") % 50).cast("string")))).alias("target_url"),
        F.when(F.col("l_partkey") % 11 == 0, "").when(F.col("l_partkey") % 7 == 0, F.concat(F.lit("https://"), target, F.lit("/"))).when(F.col("l_partkey") % 5 == 0, F.concat(F.lit("Buy "), F.col("p_name"))).otherwise(F.col("p_name")).alias("anchor"),
        F.when(F.col("l_returnflag") == "R", True).when(F.col("l_returnflag") == "N", False).alias("follow"),
        (F.col("l_linestatus") == "F").alias("lost"),
        (F.col("l_quantity") * 2).alias("dr"),
        (F.col("l_linenumber") * 10).cast("double").alias("ur"),
        F.when(F.col("l_partkey") % 13 != 0, F.col("l_extendedprice")).alias("traffic"),
        F.expr("CASE l_suppkey % 5 WHEN 0 THEN '200' WHEN 1 THEN '301' WHEN 2 THEN '404' WHEN 3 THEN '200' ELSE '' END").alias("http_code"),
        F.when(F.col("l_quantity") > 40, True).when(F.col("l_quantity") > 10, False).alias("ugc"),
        F.when(F.col("l_tax") > 0.06, True).when(F.col("l_tax") > 0.02, False).alias("sponsored"),
        F.expr("CASE l_returnflag WHEN 'R' THEN 'text' WHEN 'A' THEN 'image' ELSE 'unknown' END").alias("link_type"),
        F.expr("CASE o_custkey % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'de' ELSE 'unknown' END").alias("language"),
        F.when(F.col("l_partkey") % 10 != 0, (F.col("l_partkey") % 200).cast("double")).alias("external_links"),
        (F.col("l_partkey") % 3 != 1).alias("rendered"),
        (F.col("l_partkey") % 4 == 0).alias("raw"),
        F.to_date("o_orderdate").alias("first_seen"),
        F.to_date("l_shipdate").alias("last_seen"),
    )


METRICS = """dm AS (SELECT 'd' || c_custkey || CASE c_custkey % 4 WHEN 0 THEN '.com' WHEN 1 THEN '.org' WHEN 2 THEN '.co.uk' ELSE '.de' END AS domain, floor(greatest(0.0, c_acctbal) / 100.0) AS dr, greatest(0.0, c_acctbal) * 3 AS traffic, CAST(c_custkey % 90 AS DOUBLE) AS backlinks_all, CAST(c_custkey % 7 AS DOUBLE) AS ref_domains_all FROM customer
 UNION ALL SELECT 'd' || c_custkey || CASE c_custkey % 4 WHEN 0 THEN '.com' WHEN 1 THEN '.org' WHEN 2 THEN '.co.uk' ELSE '.de' END, CAST(NULL AS DOUBLE), c_acctbal, CAST(c_custkey AS DOUBLE), CAST(NULL AS DOUBLE) FROM customer WHERE c_custkey % 10 = 0
 UNION ALL SELECT 't' || s_suppkey || '.example.com', floor(greatest(0.0, s_acctbal) / 100.0), greatest(0.0, s_acctbal), CAST(s_suppkey * 100 AS DOUBLE), CAST(s_suppkey * 10 AS DOUBLE) FROM supplier)"""


def domain_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics per domain, with a second row for every tenth customer."""
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    domain = F.expr("concat('d', c_custkey, CASE c_custkey % 4 WHEN 0 THEN '.com' WHEN 1 THEN '.org' WHEN 2 THEN '.co.uk' ELSE '.de' END)").alias("domain")
    level = lambda x: F.floor(F.greatest(F.lit(0.0), F.col(x)) / 100.0).cast("double").alias("dr")
    first = c.select(domain, level("c_acctbal"), (F.greatest(F.lit(0.0), F.col("c_acctbal")) * 3).alias("traffic"), (F.col("c_custkey") % 90).cast("double").alias("backlinks_all"), (F.col("c_custkey") % 7).cast("double").alias("ref_domains_all"))
    none = F.lit(None).cast("double")
    again = c.where("c_custkey % 10 = 0").select(domain, none.alias("dr"), F.col("c_acctbal").alias("traffic"), F.col("c_custkey").cast("double").alias("backlinks_all"), none.alias("ref_domains_all"))
    targets = s.select(F.expr("concat('t', s_suppkey, '.example.com')").alias("domain"), level("s_acctbal"), F.greatest(F.lit(0.0), F.col("s_acctbal")).alias("traffic"), (F.col("s_suppkey") * 100).cast("double").alias("backlinks_all"), (F.col("s_suppkey") * 10).cast("double").alias("ref_domains_all"))
    return first.unionByName(again).unionByName(targets)


KEYWORDS = "kw AS (SELECT p_name || ' ' || lower(p_type) AS keyword, l_quantity AS frequency, l_orderkey * 10 + l_linenumber AS pos FROM lineitem JOIN part ON l_partkey = p_partkey)"


def keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(keyword, frequency, pos)``: part names and types, searched as often as they were ordered."""
    l, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    return l.join(p, l.l_partkey == p.p_partkey).select(F.concat_ws(" ", "p_name", F.lower("p_type")).alias("keyword"), F.col("l_quantity").alias("frequency"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"))


EDGES = "el AS (SELECT 'c' || o_custkey AS src, 'c' || ((o_orderkey * 31) % (SELECT count(*) FROM customer)) AS dst FROM orders WHERE o_orderstatus = 'F'), ed AS (SELECT DISTINCT src, dst FROM el), nd AS (SELECT 'c' || c_custkey AS node FROM customer)"


def link_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(src, dst)`` for every link between pages."""
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    n = F.broadcast(table(spark, sf_dir, "customer").agg(F.count("*").alias("n")))
    return o.crossJoin(n).select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("src"), F.concat(F.lit("c"), (F.col("o_orderkey") * 31 % F.col("n")).cast("string")).alias("dst"))


def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("node"))
