"""Queries over the link graph and the redirect table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlframe.functions.common import pct_sql, pct, rnd_sql, top_k
from crawlframe.operators import graph as G
from crawlframe.plans.adapters import EDGES, graph_nodes, link_occurrences
from crawlframe.plans.registry import query, table


def edges(spark, sf_dir) -> DataFrame:
    return G.known_edges(link_occurrences(spark, sf_dir), graph_nodes(spark, sf_dir))


def _rank_sql() -> str:
    parts = [f"WITH {EDGES}, og AS (SELECT src AS node, count(*) AS deg FROM ed GROUP BY src), nn AS (SELECT count(*) AS n FROM nd), r0 AS (SELECT node, deg, 1.0::DOUBLE / n AS s FROM nd LEFT JOIN og USING (node), nn)"]
    for i in range(20):
        parts.append(
            f"g{i} AS MATERIALIZED (SELECT dst AS node, sum(s / deg) AS got FROM ed JOIN r{i} ON r{i}.node = ed.src GROUP BY dst), d{i} AS (SELECT coalesce(sum(s), 0.0) AS lost FROM r{i} WHERE deg IS NULL), "
            f"r{i + 1} AS MATERIALIZED (SELECT nd.node, og.deg, 0.15::DOUBLE / n + 0.85::DOUBLE * coalesce(got, 0.0) + 0.85::DOUBLE * lost / n AS s FROM nd LEFT JOIN og USING (node) LEFT JOIN g{i} USING (node), d{i}, nn)"
        )
    return ", ".join(parts)


_RANK = _rank_sql()
_PR = f"pr AS (SELECT node, {rnd_sql('s / (SELECT max(s) FROM r20) * 100.0', 2)} AS pagerank FROM r20)"
_DEG = "de AS (SELECT node, coalesce(i.n, 0) AS incoming, coalesce(o.n, 0) AS outgoing, coalesce(i.n, 0) = 0 AS orphan FROM nd LEFT JOIN (SELECT dst AS node, count(*) AS n FROM el GROUP BY 1) i USING (node) LEFT JOIN (SELECT src AS node, count(*) AS n FROM ed GROUP BY 1) o USING (node))"


@query(f"{_RANK}, {_PR} SELECT * FROM pr")
def i1_pagerank(spark, sf_dir):
    return G.pagerank(G.cut(edges(spark, sf_dir)), graph_nodes(spark, sf_dir))


@query(f"WITH {EDGES}, {_DEG} SELECT * FROM de")
def i2_degrees(spark, sf_dir):
    return G.degrees(link_occurrences(spark, sf_dir), graph_nodes(spark, sf_dir))


@query(f"WITH RECURSIVE {EDGES}, b(node, depth) USING KEY (node) AS (SELECT 'c0', 0 UNION SELECT ed.dst, min(b.depth) + 1 FROM b JOIN ed ON ed.src = b.node WHERE ed.dst NOT IN (SELECT node FROM recurring.b) GROUP BY 1) SELECT node, depth FROM b")
def i3_click_depth(spark, sf_dir):
    return G.click_depth(edges(spark, sf_dir), "c0")


_SEM = "se AS (SELECT src AS node, count(*) % 4 AS semantic FROM el GROUP BY 1)"
_SCORES = f"""ls AS (SELECT node, pagerank, la AS link_authority, floor(greatest(0.0, least(100.0, least(45.0, pagerank * 45) + least(25.0, la * 0.25) + least(15.0, incoming * 2.0) + least(10.0, sem * 2.0)
 - CASE WHEN orphan THEN 10.0 ELSE 0.0 END - CASE WHEN outgoing = 0 THEN 5.0 ELSE 0.0 END))) AS link_quality
 FROM (SELECT *, CAST(floor(least(100.0, pagerank * 20 + sem * 10 + least(50.0, incoming * 2.0))) AS INTEGER) AS la FROM (SELECT *, coalesce(semantic, 0) AS sem FROM pr JOIN de USING (node) LEFT JOIN se USING (node))))"""


@query(f"{_RANK}, {_PR}, {_DEG}, {_SEM}, {_SCORES} SELECT * FROM ls")
def i4_link_scores(spark, sf_dir):
    """Authority and quality; the number of topical links stands in from the link table."""
    links, nodes = G.cut(link_occurrences(spark, sf_dir)), graph_nodes(spark, sf_dir)
    known = G.cut(G.known_edges(links, nodes))
    semantic = links.groupBy(F.col("src").alias("node")).agg((F.count("*") % 4).alias("semantic"))
    return G.link_scores(G.pagerank(known, nodes), G.degrees(links, nodes, known), semantic)


_STATUS = "st AS (SELECT 'c' || c_custkey AS node, CASE c_custkey % 9 WHEN 0 THEN 404 WHEN 1 THEN 301 WHEN 2 THEN 500 ELSE 200 END AS code FROM customer)"


@query(
    f"""WITH {EDGES}, {_STATUS}, j AS (SELECT src AS node, dst, code FROM ed JOIN st ON st.node = ed.dst)
SELECT node, count(*) FILTER (WHERE code >= 400) AS broken, count(*) FILTER (WHERE code BETWEEN 300 AND 399) AS redirecting, coalesce(array_to_string(list_sort(list(DISTINCT dst) FILTER (WHERE code >= 400))[1:5], ', '), '') AS broken_sample
FROM j GROUP BY node HAVING broken > 0 OR redirecting > 0"""
)
def c8_broken_links(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    status = c.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("node"), F.expr("CASE c_custkey % 9 WHEN 0 THEN 404 WHEN 1 THEN 301 WHEN 2 THEN 500 ELSE 200 END").alias("code"))
    return G.broken_links(edges(spark, sf_dir), status)


@query(
    f"""WITH {EDGES}, tp AS (SELECT 'c' || c_custkey AS node, c_mktsegment || '-' || c_nationkey AS topic FROM customer), h AS (SELECT topic, min(node) AS hub FROM tp GROUP BY topic),
m AS (SELECT topic, hub AS src, node AS dst FROM tp JOIN h USING (topic) WHERE node <> hub AND NOT EXISTS (SELECT 1 FROM ed WHERE ed.src = hub AND ed.dst = node))
SELECT src, dst, topic, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY dst) AS rank FROM m) WHERE rank <= 10"""
)
def c18_missing_topic_links(spark, sf_dir):
    """Pages of one topic (segment and nation) that its first page does not link to."""
    topics = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("node"), F.concat_ws("-", "c_mktsegment", F.col("c_nationkey").cast("string")).alias("topic"))
    return G.unlinked_topics(topics, edges(spark, sf_dir)).select("src", "dst", "topic", "rank")


@query(
    f"""WITH {EDGES}, {_DEG} SELECT count(*) AS pages, count(*) FILTER (WHERE orphan) AS orphans, count(*) FILTER (WHERE outgoing >= 5) AS hubs, {rnd_sql("avg(CAST(incoming AS DOUBLE))", 4)} AS mean_incoming, {pct_sql("count(*) FILTER (WHERE orphan)", "count(*)")} AS orphan_pct FROM de"""
)
def d21_pipeline_metrics(spark, sf_dir):
    """Orphans, hubs and mean links of the site."""
    from crawlframe.functions.common import rnd

    d = G.degrees(link_occurrences(spark, sf_dir), graph_nodes(spark, sf_dir))
    return d.agg(F.count("*").alias("pages"), F.count_if("orphan").alias("orphans"), F.count_if(F.col("outgoing") >= 5).alias("hubs"), rnd(F.avg("incoming"), 4).alias("mean_incoming"), pct(F.count_if("orphan"), F.count("*")).alias("orphan_pct"))


# --- redirects: an order's page moves to that of half its number while that is even; 7 and 14 go round

HOPS = """hp AS (SELECT '/o/' || o_orderkey AS "from", CASE WHEN o_orderkey = 7 THEN '/o/14' WHEN o_orderkey % 2 = 0 THEN '/o/' || (o_orderkey // 2) END AS "to", CASE o_orderstatus WHEN 'F' THEN 301 WHEN 'O' THEN 302 ELSE 308 END AS status
 FROM orders WHERE o_orderkey > 0 AND (o_orderkey = 7 OR o_orderkey % 2 = 0))"""
_CHAIN = f"""WITH RECURSIVE {HOPS}, w(start, here, path, codes, loop) AS (SELECT "from", "from", ["from"], CAST([] AS INTEGER[]), FALSE FROM hp
 UNION ALL SELECT start, "to", list_append(path, "to"), list_append(codes, status), list_contains(path, "to") FROM w JOIN hp ON hp."from" = w.here WHERE NOT loop),
ch AS (SELECT start, len(codes) AS hops, here AS final, loop, array_to_string(codes, '>') AS statuses, list_contains(codes, 301) OR list_contains(codes, 308) AS permanent, list_contains(codes, 302) AS temporary
 FROM w WHERE loop OR NOT EXISTS (SELECT 1 FROM hp WHERE hp."from" = w.here))"""


def hops(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders").where("o_orderkey > 0 AND (o_orderkey = 7 OR o_orderkey % 2 = 0)")
    return o.selectExpr("concat('/o/', o_orderkey) AS `from`", "CASE WHEN o_orderkey = 7 THEN '/o/14' ELSE concat('/o/', o_orderkey div 2) END AS `to`", "CASE o_orderstatus WHEN 'F' THEN 301 WHEN 'O' THEN 302 ELSE 308 END AS status")


@query(f"{_CHAIN} SELECT start, CAST(hops AS INTEGER) AS hops, final, loop, statuses, permanent, temporary FROM ch")
def c22_redirect_chains(spark, sf_dir):
    return G.redirect_chains(hops(spark, sf_dir)).drop("path")


_GRADE = "CASE WHEN score >= 90 THEN 'A' WHEN score >= 75 THEN 'B' WHEN score >= 60 THEN 'C' WHEN score >= 40 THEN 'D' ELSE 'F' END"
_CHECKED = """ck AS (SELECT start, CAST(loop AS INTEGER) + CAST(hops > 5 AS INTEGER) AS errors, CAST(hops BETWEEN 3 AND 5 AS INTEGER) + CAST(permanent AND temporary AS INTEGER) AS warnings FROM ch)"""


def _checked(spark, sf_dir) -> DataFrame:
    i = lambda x: F.expr(x).cast("int")
    return c22_redirect_chains(spark, sf_dir).select("start", (i("loop") + i("hops > 5")).alias("errors"), (i("hops BETWEEN 3 AND 5") + i("permanent AND temporary")).alias("warnings"))


@query(f"{_CHAIN}, {_CHECKED}, sc AS (SELECT start, errors, warnings, greatest(0, 100 - 7 * warnings - 15 * errors) AS score FROM ck) SELECT *, {_GRADE} AS grade FROM sc")
def d42_redirect_scores(spark, sf_dir):
    """Warnings and errors of each chain, as score and grade."""
    s = _checked(spark, sf_dir).withColumn("score", F.greatest(F.lit(0), 100 - 7 * F.col("warnings") - 15 * F.col("errors")))
    return s.withColumn("grade", F.expr(_GRADE))


@query(f"{_CHAIN} SELECT hops, loop, permanent AND temporary AS mixed, count(*) AS chains FROM (SELECT CAST(hops AS INTEGER) AS hops, loop, permanent, temporary FROM ch) GROUP BY 1, 2, 3")
def c22_chain_lengths(spark, sf_dir):
    return c22_redirect_chains(spark, sf_dir).groupBy("hops", "loop", F.expr("permanent AND temporary").alias("mixed")).agg(F.count("*").alias("chains"))


@query(
    """WITH v AS (SELECT o_custkey AS url, CASE o_orderpriority WHEN '1-URGENT' THEN 'bot' ELSE 'browser' END AS agent, '/o/' || (o_orderkey % 3) AS final, CASE o_orderstatus WHEN 'F' THEN 200 WHEN 'O' THEN 301 ELSE 403 END AS status FROM orders)
SELECT url, count(DISTINCT agent) AS agents, count(DISTINCT final) AS finals, count(DISTINCT status) AS statuses, count(*) FILTER (WHERE status IN (401, 403, 429)) AS blocked, count(DISTINCT final) > 1 OR count(DISTINCT status) > 1 AS differs FROM v GROUP BY url"""
)
def c26_user_agents(spark, sf_dir):
    """The same page under several user agents: different ends or answers, and refusals."""
    v = table(spark, sf_dir, "orders").selectExpr("o_custkey AS url", "CASE o_orderpriority WHEN '1-URGENT' THEN 'bot' ELSE 'browser' END AS agent", "concat('/o/', o_orderkey % 3) AS final", "CASE o_orderstatus WHEN 'F' THEN 200 WHEN 'O' THEN 301 ELSE 403 END AS status")
    g = v.groupBy("url").agg(F.count_distinct("agent").alias("agents"), F.count_distinct("final").alias("finals"), F.count_distinct("status").alias("statuses"), F.count_if(F.col("status").isin(401, 403, 429)).alias("blocked"))
    return g.withColumn("differs", (F.col("finals") > 1) | (F.col("statuses") > 1))
