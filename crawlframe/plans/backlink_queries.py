"""Queries over the backlink view."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlframe.functions import urls as U
from crawlframe.functions.common import pct, pct_sql, rnd, rnd_sql, top_k
from crawlframe.operators import backlinks as B
from crawlframe.operators import keywords as K
from crawlframe.operators.sampling import ranked
from crawlframe.plans.adapters import BACKLINKS, METRICS, OUR, backlinks, domain_metrics
from crawlframe.plans.keyword_queries import _STEM
from crawlframe.plans.registry import query, table

ANCHOR_WORDS = {
    "spam": ["casino", "viagra"],
    "brand": ["goldenrod", "lavender", "t0"],
    "commercial": ["buy", "price"],
    "informational": ["how", "guide", "small"],
    "navigational": ["login", "home", "large"],
    "generic": ["here", "more"],
}
BL = f"WITH {BACKLINKS}"
_OWN = f"target_domain = '{OUR}'"
_BUCKET = "CASE WHEN {0} IS NULL THEN 'unknown' WHEN {0} < 10 THEN '0-9' WHEN {0} < 30 THEN '10-29' WHEN {0} < 50 THEN '30-49' WHEN {0} < 70 THEN '50-69' ELSE '70+' END"
_HTTP = "CASE WHEN regexp_matches(http_code, '^[2-5]') THEN substr(http_code, 1, 1) || 'xx' ELSE 'unknown' END"


def _decile(x: str) -> str:
    low = f"CAST(floor(greatest(0.0, least(100.0, {x})) / 10) AS INTEGER) * 10"
    return f"CASE WHEN {x} IS NULL THEN 'DR unknown' WHEN {low} >= 90 THEN 'DR 90-100' ELSE 'DR ' || ({low}) || '-' || ({low} + 9) END"


def _has(kind: str) -> str:
    return "(" + " OR ".join(f"contains(x, '{w}')" for w in ANCHOR_WORDS[kind]) + ")"


_ANCHOR = rf"""CASE WHEN x = '' THEN 'empty' WHEN regexp_matches(x, '^(https?://|www\.)') OR regexp_matches(x, '^[a-z0-9.-]+\.[a-z]{{2,}}(?:/[^\s]*)?$') THEN 'naked_url'
 WHEN {_has("spam")} THEN 'spam' WHEN {_has("brand")} AND {_has("commercial")} THEN 'brand_commercial' WHEN {_has("brand")} AND {_has("navigational")} THEN 'brand_navigational'
 WHEN {_has("brand")} THEN 'brand' WHEN {_has("navigational")} THEN 'navigational' WHEN {_has("commercial")} THEN 'commercial' WHEN {_has("informational")} THEN 'informational'
 WHEN {_has("generic")} OR length(x) <= 3 THEN 'generic' ELSE 'other' END"""
_X = r"(SELECT *, trim(regexp_replace(lower(anchor), '\s+', ' ', 'g')) AS x FROM bl)"


def _classed(spark, sf_dir) -> DataFrame:
    return backlinks(spark, sf_dir).withColumn("anchor_type", B.anchor_class(F.col("anchor"), ANCHOR_WORDS))


_HOST = r"lower(regexp_extract(u, '//([^/?#:]*)', 1))"
_REG = rf"""CASE WHEN regexp_matches(h, '^\d{{1,3}}(\.\d{{1,3}}){{3}}$') OR len(p) <= 2 THEN h
 WHEN p[len(p) - 1] || '.' || p[len(p)] IN ({", ".join(f"'{x}'" for x in U.MULTI_PART_TLDS)}) OR (regexp_matches(p[len(p)], '^[a-z]{{2}}$') AND p[len(p) - 1] IN ({", ".join(f"'{x}'" for x in U.SECOND_LEVEL)})) THEN array_to_string(p[len(p) - 2 :], '.')
 ELSE array_to_string(p[len(p) - 1 :], '.') END"""


@query(
    rf"""{BL}, a AS (SELECT link_id, source_url AS u FROM bl), b AS (SELECT link_id, u, regexp_replace({_HOST}, '^www\.', '') AS h FROM a), c AS (SELECT link_id, h, string_split(h, '.') AS p FROM b),
d AS (SELECT link_id, {_REG} AS domain FROM c) SELECT link_id, domain, CASE WHEN contains(domain, '.') AND length(string_split(domain, '.')[-1]) BETWEEN 2 AND 10 THEN string_split(domain, '.')[-1] ELSE 'other' END AS zone FROM d"""
)
def b4_registrable_domain(spark, sf_dir):
    """Registered domain and zone of each link's source."""
    d = backlinks(spark, sf_dir).select("link_id", U.registrable(U.host(F.col("source_url"))).alias("domain"))
    return d.select("link_id", "domain", U.zone(F.col("domain")).alias("zone"))


@query(f"{BL} SELECT link_id, {_OWN} OR ends_with(target_domain, '.{OUR}') AS ours FROM bl")
def b5_own_target(spark, sf_dir):
    return backlinks(spark, sf_dir).select("link_id", U.is_own(F.col("target_domain"), OUR).alias("ours"))


@query(
    f"""SELECT l_orderkey, l_linenumber, coalesce(TRY_CAST(replace(replace(CAST(l_discount AS VARCHAR), '.', ','), ',', '.') AS DOUBLE), 0.0) AS value,
 CASE WHEN l_returnflag = 'R' THEN TRUE WHEN l_returnflag = 'N' THEN FALSE END AS flag FROM lineitem"""
)
def b7_lenient_values(spark, sf_dir):
    """Numbers with decimal commas and flags in words, as exports have them."""
    l = table(spark, sf_dir, "lineitem")
    raw = F.regexp_replace(F.col("l_discount").cast("string"), r"\.", ",")
    word = F.when(F.col("l_returnflag") == "R", " Yes ").when(F.col("l_returnflag") == "N", "OFF").otherwise("?")
    x = F.lower(F.trim(word))
    flag = F.when(x.isin("1", "true", "yes", "y", "on"), True).when(x.isin("0", "false", "no", "n", "off"), False)
    return l.select("l_orderkey", "l_linenumber", F.coalesce(F.replace(raw, F.lit(","), F.lit(".")).try_cast("double"), F.lit(0.0)).alias("value"), flag.alias("flag"))


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders")
def b8_date_formats(spark, sf_dir):
    """Dates in three formats, parsed back."""
    o = table(spark, sf_dir, "orders")
    fmt = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "dd.MM.yyyy")).otherwise(F.date_format("o_orderdate", "MM/dd/yyyy"))
    raw = o.select("o_orderkey", fmt.alias("raw"))
    return raw.select("o_orderkey", F.coalesce(F.try_to_date("raw", "yyyy-MM-dd"), F.try_to_date("raw", "dd.MM.yyyy"), F.try_to_date("raw", "MM/dd/yyyy")).alias("day"))


@query(f"{BL} SELECT link_id, regexp_matches(target_url, '^https?://[^/?#]*/?([?#]|$)') AS homepage, regexp_matches(http_code || ' ' || anchor, '(^|[^0-9])301([^0-9]|$)') AS seen_301 FROM bl")
def b9_homepage_301(spark, sf_dir):
    return backlinks(spark, sf_dir).select("link_id", U.is_homepage(F.col("target_url")).alias("homepage"), F.concat_ws(" ", "http_code", "anchor").rlike("(?<![0-9])301(?![0-9])").alias("seen_301"))


@query(f"SELECT s_suppkey, {_BUCKET.format('dr')} AS bucket, {_decile('dr')} AS decile FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 9 <> 0 THEN s_acctbal / 100.0 END AS dr FROM supplier)")
def b10_authority_buckets(spark, sf_dir):
    d = table(spark, sf_dir, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 9 != 0, F.col("s_acctbal") / 100.0).alias("dr"))
    return d.select("s_suppkey", B.dr_bucket(F.col("dr")).alias("bucket"), B.dr_decile(F.col("dr")).alias("decile"))


@query(f"{BL} SELECT {_HTTP} AS http_class, count(*) AS links FROM bl GROUP BY 1")
def b11_http_class(spark, sf_dir):
    return backlinks(spark, sf_dir).groupBy(B.http_class(F.col("http_code")).alias("http_class")).agg(F.count("*").alias("links"))


@query(f"{BL} SELECT link_id, {_ANCHOR} AS anchor_type FROM {_X}")
def b12_anchor_class(spark, sf_dir):
    return _classed(spark, sf_dir).select("link_id", "anchor_type")


@query(
    rf"""WITH {METRICS}, h AS (SELECT DISTINCT domain, domain AS h, string_split(domain, '.')[1] AS main FROM dm),
t AS (SELECT domain, unnest(list_concat([h, main], string_split_regex(main, '[^a-z0-9а-яё]+'))) AS token FROM h) SELECT DISTINCT domain, token FROM t WHERE length(token) >= 2"""
)
def b13_brand_tokens(spark, sf_dir):
    return B.brand_tokens(domain_metrics(spark, sf_dir).select("domain").distinct())


_BEST = f"""{METRICS}, best AS (SELECT domain, dr, traffic, backlinks_all, ref_domains_all FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY
 CAST(dr IS NOT NULL AS INTEGER) + CAST(traffic IS NOT NULL AS INTEGER) + CAST(backlinks_all IS NOT NULL AS INTEGER) + CAST(ref_domains_all IS NOT NULL AS INTEGER) DESC,
 coalesce(backlinks_all, -1.0) DESC, coalesce(ref_domains_all, -1.0) DESC, coalesce(traffic, -1.0) DESC, coalesce(dr, -1.0) DESC) AS r FROM dm) WHERE r = 1)"""


@query(f"WITH {_BEST} SELECT * FROM best")
def e1_best_metric_row(spark, sf_dir):
    return B.best_metrics(domain_metrics(spark, sf_dir))


@query(f"{BL}, {_BEST} SELECT link_id, coalesce(bl.dr, best.dr) AS effective_dr, coalesce(bl.traffic, best.traffic) AS effective_traffic FROM bl LEFT JOIN best ON source_domain = domain")
def c1_metric_fallback(spark, sf_dir):
    return B.with_metrics(backlinks(spark, sf_dir), domain_metrics(spark, sf_dir)).select("link_id", "effective_dr", "effective_traffic")


@query(
    f"""{BL}, {_BEST}, g AS (SELECT target_domain, count(*) AS links, count(DISTINCT source_domain) AS ref_domains FROM bl WHERE NOT ({_OWN}) GROUP BY 1)
SELECT target_domain AS competitor_domain, links, ref_domains, dr AS batch_dr, traffic AS batch_traffic, {pct_sql("ref_domains", "backlinks_all")} AS ref_domain_share_pct FROM g LEFT JOIN best ON target_domain = domain"""
)
def c2_competitors(spark, sf_dir):
    """Links, donors and metrics of each competitor."""
    g = backlinks(spark, sf_dir).where(~U.is_own(F.col("target_domain"), OUR)).groupBy("target_domain").agg(F.count("*").alias("links"), F.count_distinct("source_domain").alias("ref_domains"))
    j = g.join(B.best_metrics(domain_metrics(spark, sf_dir)).withColumnRenamed("domain", "target_domain"), "target_domain", "left")
    return j.select(F.col("target_domain").alias("competitor_domain"), "links", "ref_domains", F.col("dr").alias("batch_dr"), F.col("traffic").alias("batch_traffic"), pct(F.col("ref_domains"), F.col("backlinks_all")).alias("ref_domain_share_pct"))


@query(
    f"""{BL}, p AS (SELECT DISTINCT source_domain, target_domain FROM bl), o AS (SELECT DISTINCT source_domain FROM p WHERE {_OWN}), n AS (SELECT count(*) AS n FROM o),
g AS (SELECT target_domain, count(*) AS refs, count(o.source_domain) AS shared FROM p LEFT JOIN o USING (source_domain) WHERE NOT ({_OWN}) GROUP BY 1)
SELECT target_domain AS competitor_domain, shared AS shared_ref_domains, refs - shared AS competitor_only_domains, n - shared AS our_only_domains, {pct_sql("shared", "refs")} AS overlap_pct,
 {pct_sql("shared", "n")} AS coverage_of_our_ref_domains_pct, {pct_sql("refs - shared", "refs")} AS donor_gap_pct FROM g, n"""
)
def c3_overlap(spark, sf_dir):
    return B.overlap(backlinks(spark, sf_dir), OUR)


_CLASSES = f"""cl AS (SELECT source_domain AS domain, count(*) AS targets, bool_or({_OWN}) AS ours, count(*) FILTER (WHERE NOT ({_OWN})) AS competitors,
 coalesce(array_to_string(list_sort(list(target_domain) FILTER (WHERE NOT ({_OWN})))[1:5], ', '), '') AS competitor_targets FROM (SELECT DISTINCT source_domain, target_domain FROM bl) GROUP BY 1),
kl AS (SELECT domain, CASE WHEN ours AND competitors > 0 THEN 'with_ours' WHEN ours THEN 'only_ours' WHEN competitors = 1 THEN 'single_competitor' ELSE 'several_competitors' END AS class, targets, competitors, competitor_targets FROM cl)"""


@query(f"{BL}, {_CLASSES} SELECT * FROM kl")
def c4_donor_classes(spark, sf_dir):
    return B.donor_classes(backlinks(spark, sf_dir), OUR)


@query(f"{BL}, {_CLASSES} SELECT link_id, source_domain, target_domain FROM bl WHERE source_domain IN (SELECT domain FROM kl WHERE class = 'several_competitors')")
def c5_class_rows(spark, sf_dir):
    """The links of donors that several competitors have and we have not."""
    links = backlinks(spark, sf_dir)
    gap = B.donor_classes(links, OUR).where("class = 'several_competitors'").select(F.col("domain").alias("source_domain"))
    return links.join(gap, "source_domain", "left_semi").select("link_id", "source_domain", "target_domain")


@query(f"{BL}, g AS (SELECT strftime(first_seen, '%Y-%m') AS month, 1 AS gained, 0 AS lost FROM bl UNION ALL SELECT strftime(last_seen, '%Y-%m'), 0, 1 FROM bl WHERE lost) SELECT month, CAST(sum(gained) AS BIGINT) AS gained, CAST(sum(lost) AS BIGINT) AS lost, CAST(sum(gained) - sum(lost) AS BIGINT) AS net FROM g GROUP BY month")
def c17_velocity(spark, sf_dir):
    return B.velocity(backlinks(spark, sf_dir))


_HOME = "regexp_matches(target_url, '^https?://[^/?#]*/?([?#]|$)')"
_PROFILE = f"""pr AS (SELECT target_domain, n AS total_links, {pct_sql("home", "n")} AS homepage_pct, {pct_sql("n - home", "n")} AS internal_pct, {pct_sql("yes", "n")} AS follow_pct, {pct_sql("no_", "n")} AS nofollow_pct,
 {pct_sql("home_yes", "yes")} AS homepage_follow_pct, {pct_sql("home_no", "no_")} AS homepage_nofollow_pct, {pct_sql("yes - home_yes", "yes")} AS internal_follow_pct, {pct_sql("no_ - home_no", "no_")} AS internal_nofollow_pct,
 {pct_sql("lost", "n")} AS lost_pct, {pct_sql("ugc", "n")} AS ugc_pct, {pct_sql("sponsored", "n")} AS sponsored_pct, {pct_sql("rendered", "n")} AS rendered_pct, {pct_sql("raw", "n")} AS raw_pct, {pct_sql("ok", "n")} AS http_2xx_pct
 FROM (SELECT target_domain, count(*) AS n, count(*) FILTER (WHERE {_HOME}) AS home, count(*) FILTER (WHERE follow) AS yes, count(*) FILTER (WHERE NOT follow) AS no_, count(*) FILTER (WHERE follow AND {_HOME}) AS home_yes,
 count(*) FILTER (WHERE NOT follow AND {_HOME}) AS home_no, count(*) FILTER (WHERE lost) AS lost, count(*) FILTER (WHERE ugc) AS ugc, count(*) FILTER (WHERE sponsored) AS sponsored, count(*) FILTER (WHERE rendered) AS rendered, count(*) FILTER (WHERE raw) AS raw, count(*) FILTER (WHERE starts_with(http_code, '2')) AS ok FROM bl GROUP BY 1))"""


@query(f"{BL}, {_PROFILE} SELECT * FROM pr")
def d2_target_profile(spark, sf_dir):
    return B.target_profile(backlinks(spark, sf_dir))


_DONORS = """ds AS (SELECT source_domain AS domain, count(*) AS links, coalesce(avg(dr), 0.0) AS avg_dr, coalesce(avg(ur), 0.0) AS avg_ur, coalesce(avg(traffic), 0.0) AS avg_traffic, coalesce(avg(external_links), 0.0) AS avg_external_links,
 CAST(count(*) FILTER (WHERE NOT follow) AS DOUBLE) / count(*) AS nofollow_rate, CAST(count(*) FILTER (WHERE lost) AS DOUBLE) / count(*) AS lost_rate, CAST(count(*) FILTER (WHERE starts_with(http_code, '2')) AS DOUBLE) / count(*) AS http2xx_rate FROM bl GROUP BY 1)"""


@query(f"{BL}, {_DONORS} SELECT domain, links, {', '.join(rnd_sql(c, 4) + ' AS ' + c for c in ('avg_dr', 'avg_ur', 'avg_traffic', 'avg_external_links', 'nofollow_rate', 'lost_rate', 'http2xx_rate'))} FROM ds")
def d3_donor_stats(spark, sf_dir):
    s = B.donor_stats(backlinks(spark, sf_dir))
    return s.select("domain", "links", *[rnd(F.col(c), 4).alias(c) for c in s.columns[2:]])


_DIMS = {"follow": "coalesce(CAST(follow AS VARCHAR), 'unknown')", "lost": "CAST(lost AS VARCHAR)", "http": _HTTP, "link_type": "link_type", "language": "language", "zone": "string_split(source_domain, '.')[-1]", "anchor": _ANCHOR}


def _dims(links: DataFrame) -> dict:
    return {"follow": F.col("follow"), "lost": F.col("lost"), "http": B.http_class(F.col("http_code")), "link_type": F.col("link_type"), "language": F.col("language"), "zone": U.zone(F.col("source_domain")), "anchor": F.col("anchor_type")}


_LONG = " UNION ALL ".join(f"SELECT target_domain, '{k}' AS dimension, {v} AS value FROM {_X}" for k, v in _DIMS.items())


@query(f"{BL}, g AS (SELECT dimension, value, count(*) AS count FROM ({_LONG}) GROUP BY 1, 2) SELECT *, {pct_sql('count', 'sum(count) OVER (PARTITION BY dimension)')} AS pct FROM g")
def d4_mix(spark, sf_dir):
    links = _classed(spark, sf_dir)
    return B.mix(links, _dims(links), [])


@query(f"{BL}, g AS (SELECT target_domain, dimension, value, count(*) AS count FROM ({_LONG}) GROUP BY 1, 2, 3) SELECT *, {pct_sql('count', 'sum(count) OVER (PARTITION BY target_domain, dimension)')} AS pct FROM g")
def d4_mix_by_competitor(spark, sf_dir):
    links = _classed(spark, sf_dir)
    return B.mix(links, _dims(links), ["target_domain"])


@query(
    f"""{BL}, {_PROFILE}, u AS (UNPIVOT (SELECT target_domain, {", ".join(B.PROFILE)} FROM pr) ON {", ".join(B.PROFILE)} INTO NAME metric VALUE v),
g AS (SELECT metric, coalesce(max(v) FILTER (WHERE {_OWN}), 0.0) AS our_site_pct, {rnd_sql(f"avg(v) FILTER (WHERE NOT ({_OWN}))", 2)} AS competitors_avg_pct, {rnd_sql(f"median(v) FILTER (WHERE NOT ({_OWN}))", 2)} AS competitors_median_pct FROM u GROUP BY metric)
SELECT *, {rnd_sql("our_site_pct - competitors_avg_pct", 2)} AS delta_vs_avg, {rnd_sql("our_site_pct - competitors_median_pct", 2)} AS delta_vs_median FROM g"""
)
def d5_benchmark(spark, sf_dir):
    return B.benchmark(B.target_profile(backlinks(spark, sf_dir)), OUR)


@query(
    f"""{BL} SELECT coalesce(segment, 'all') AS segment, count(*) AS links, {rnd_sql("avg(dr)", 2)} AS avg_dr, median(dr) AS median_dr, count(*) FILTER (WHERE dr IS NULL) AS unknown
FROM (SELECT CASE WHEN {_OWN} THEN 'ours' ELSE 'competitors' END AS segment, dr FROM bl) GROUP BY GROUPING SETS ((segment), ())"""
)
def d6_segment_stats(spark, sf_dir):
    s = backlinks(spark, sf_dir).select(F.when(U.is_own(F.col("target_domain"), OUR), "ours").otherwise("competitors").alias("segment"), "dr")
    g = s.groupingSets([[F.col("segment")], []], F.col("segment")).agg(F.count("*").alias("links"), rnd(F.avg("dr"), 2).alias("avg_dr"), F.median("dr").alias("median_dr"), F.count_if(F.col("dr").isNull()).alias("unknown"))
    return g.withColumn("segment", F.coalesce("segment", F.lit("all")))


_DECILES = [f"DR {i}-{i + 9}" for i in range(0, 90, 10)] + ["DR 90-100"]


@query(f"{BL} SELECT target_domain, {', '.join(f'count(*) FILTER (WHERE d = {chr(39)}{x}{chr(39)}) AS {chr(34)}{x}{chr(34)}' for x in _DECILES)} FROM (SELECT target_domain, {_decile('dr')} AS d FROM bl) GROUP BY 1")
def d7_decile_matrix(spark, sf_dir):
    g = backlinks(spark, sf_dir).withColumn("d", B.dr_decile(F.col("dr"))).groupBy("target_domain").pivot("d", _DECILES).count()
    return g.fillna(0, _DECILES)


_ZONES = ["com", "org", "uk", "de"]


@query(f"{BL} SELECT target_domain, {', '.join(f'count(*) FILTER (WHERE z = {chr(39)}{x}{chr(39)}) AS zone_{x}' for x in _ZONES)} FROM (SELECT target_domain, string_split(source_domain, '.')[-1] AS z FROM bl) GROUP BY 1")
def d8_zone_matrix(spark, sf_dir):
    g = B.zone_of_source(backlinks(spark, sf_dir)).groupBy("target_domain").pivot("zone", _ZONES).count().fillna(0, _ZONES)
    return g.select("target_domain", *[F.col(z).alias(f"zone_{z}") for z in _ZONES])


@query(f"{BL} SELECT attribute, CASE WHEN v THEN 'true' WHEN NOT v THEN 'false' ELSE 'unknown' END AS value, count(*) AS links FROM (SELECT 'follow' AS attribute, follow AS v FROM bl UNION ALL SELECT 'ugc', ugc FROM bl UNION ALL SELECT 'sponsored', sponsored FROM bl UNION ALL SELECT 'lost', lost FROM bl) GROUP BY 1, 2")
def d9_tri_state(spark, sf_dir):
    names = ["follow", "ugc", "sponsored", "lost"]
    v = F.explode(F.array(*[F.struct(F.lit(n).alias("attribute"), F.coalesce(F.col(n).cast("string"), F.lit("unknown")).alias("value")) for n in names]))
    return backlinks(spark, sf_dir).select(v.alias("v")).groupBy("v.attribute", "v.value").agg(F.count("*").alias("links"))


_LEMMA = f"array_to_string({_STEM}, ' ')"


@query(
    f"""{BL}, g AS (SELECT {_LEMMA} AS lemma, anchor, count(*) AS n FROM (SELECT anchor, list_filter(string_split(lower(anchor), ' '), lambda x: x <> '') AS tokens FROM bl WHERE anchor <> '') GROUP BY 1, 2),
h AS (SELECT lemma, sum(n) AS links, max_by(anchor, struct_pack(n := n, a := anchor)) AS anchor FROM g GROUP BY 1)
SELECT CAST(rank AS INTEGER) AS rank, lemma, anchor, CAST(links AS BIGINT) AS links FROM (SELECT *, row_number() OVER (ORDER BY links DESC, lemma) AS rank FROM h) WHERE rank <= 50"""
)
def d10_top_anchors(spark, sf_dir):
    """Anchors whose words have one stem each in common, shown in their most frequent spelling."""
    lemma = F.array_join(K.stems(F.filter(F.split(F.lower("anchor"), " "), lambda x: x != "")), " ")
    g = backlinks(spark, sf_dir).where("anchor <> ''").groupBy(lemma.alias("lemma"), "anchor").count()
    h = g.groupBy("lemma").agg(F.sum("count").alias("links"), F.max_by("anchor", F.struct("count", "anchor")).alias("anchor"))
    return top_k(h, [], [F.desc("links"), F.asc("lemma")], 50).select("rank", "lemma", "anchor", "links")


@query(f"{BL}, w AS (SELECT lower(unnest(regexp_extract_all(anchor, '[A-Za-zА-Яа-яЁё0-9]{{3,}}'))) AS word FROM bl) SELECT word, count(*) AS n FROM w GROUP BY 1")
def d11_anchor_words(spark, sf_dir):
    w = F.explode(F.regexp_extract_all("anchor", F.lit("[A-Za-zА-Яа-яЁё0-9]{3,}"), F.lit(0)))
    return backlinks(spark, sf_dir).select(w.alias("w")).groupBy(F.lower("w").alias("word")).agg(F.count("*").alias("n"))


@query(
    f"""{BL}, g AS (SELECT source_domain, coalesce(bool_or(follow), FALSE) AS yes, coalesce(bool_or(NOT follow), FALSE) AS no_ FROM bl GROUP BY 1)
SELECT CASE WHEN yes AND no_ THEN 'mixed' WHEN yes THEN 'follow_only' WHEN no_ THEN 'nofollow_only' ELSE 'unknown' END AS follow_class, count(*) AS domains FROM g GROUP BY 1"""
)
def d12_follow_classes(spark, sf_dir):
    return B.follow_classes(backlinks(spark, sf_dir))


@query(f"{BL} SELECT lost, {_HTTP} AS http_class, link_type, language, count(*) AS links FROM bl GROUP BY GROUPING SETS ((lost), (2), (link_type), (language), (lost, 2))".replace("(2)", f"({_HTTP})").replace("(lost, 2)", f"(lost, {_HTTP})"))
def d13_dimension_counts(spark, sf_dir):
    d = backlinks(spark, sf_dir).select("lost", B.http_class(F.col("http_code")).alias("http_class"), "link_type", "language")
    c = F.col
    return d.groupingSets([[c("lost")], [c("http_class")], [c("link_type")], [c("language")], [c("lost"), c("http_class")]], c("lost"), c("http_class"), c("link_type"), c("language")).agg(F.count("*").alias("links"))


@query(
    f"""{BL} SELECT count(*) AS links, count(DISTINCT source_domain) AS ref_domains, count(DISTINCT target_domain) AS targets, count(*) FILTER (WHERE {_OWN}) AS our_links,
 {pct_sql("count(*) FILTER (WHERE follow)", "count(*)")} AS follow_pct, {pct_sql("count(*) FILTER (WHERE lost)", "count(*)")} AS lost_pct, {rnd_sql("avg(dr)", 2)} AS avg_dr, median(traffic) AS median_traffic FROM bl"""
)
def d14_summary(spark, sf_dir):
    n = F.count("*")
    return backlinks(spark, sf_dir).agg(
        n.alias("links"),
        F.count_distinct("source_domain").alias("ref_domains"),
        F.count_distinct("target_domain").alias("targets"),
        F.count_if(U.is_own(F.col("target_domain"), OUR)).alias("our_links"),
        pct(F.count_if(F.col("follow")), n).alias("follow_pct"),
        pct(F.count_if(F.col("lost")), n).alias("lost_pct"),
        rnd(F.avg("dr"), 2).alias("avg_dr"),
        F.median("traffic").alias("median_traffic"),
    )


@query(
    f"""{BL}, {_PROFILE}, {_BEST}, q AS (SELECT target_domain AS competitor_domain, total_links, {rnd_sql("follow_pct * 0.35 + http_2xx_pct * 0.25 + (100.0 - lost_pct) * 0.25 + (100.0 - homepage_pct) * 0.15", 2)} AS quality_score,
 {rnd_sql("coalesce(dr, 0.0) * 0.45 + least(coalesce(backlinks_all, 0.0), 200000.0) / 2000.0 * 0.3 + follow_pct * 0.25", 2)} AS rank_score FROM pr LEFT JOIN best ON target_domain = domain WHERE NOT ({_OWN}))
SELECT *, row_number() OVER (ORDER BY rank_score DESC, competitor_domain) AS rank FROM q"""
)
def d15_competitor_scores(spark, sf_dir):
    """Quality of each competitor's links, and rank by authority, volume and follow share."""
    c = F.col
    p = B.target_profile(backlinks(spark, sf_dir)).where(~U.is_own(c("target_domain"), OUR)).join(B.best_metrics(domain_metrics(spark, sf_dir)).withColumnRenamed("domain", "target_domain"), "target_domain", "left")
    zero = F.lit(0.0)
    q = p.select(
        c("target_domain").alias("competitor_domain"),
        "total_links",
        B.quality_score().alias("quality_score"),
        rnd(F.coalesce("dr", zero) * 0.45 + F.least(F.coalesce("backlinks_all", zero), F.lit(200000.0)) / 2000.0 * 0.3 + c("follow_pct") * 0.25, 2).alias("rank_score"),
    )
    return ranked(q, [F.desc("rank_score"), F.asc("competitor_domain")])


_CAND = f"""ca AS (SELECT ds.*, kl.competitors, (SELECT count(DISTINCT target_domain) FROM bl WHERE NOT ({_OWN})) AS n FROM ds JOIN kl USING (domain) WHERE class IN ('single_competitor', 'several_competitors'))"""
_OPP = f"""op AS (SELECT domain, competitors AS competitors_covered, covered_pct, links AS links_in_dataset, {rnd_sql("avg_dr", 2)} AS avg_dr, {rnd_sql("avg_traffic", 2)} AS avg_traffic, {rnd_sql("(1.0 - nofollow_rate) * 100.0", 2)} AS follow_pct,
 {rnd_sql("lost_rate * 100.0", 2)} AS lost_pct, {rnd_sql("http2xx_rate * 100.0", 2)} AS http_2xx_pct,
 {rnd_sql("covered_pct * 0.35 + avg_dr * 0.35 + least(avg_traffic, 10000.0) / 100.0 * 0.15 + (1.0 - nofollow_rate) * 100.0 * 0.1 + (1.0 - lost_rate) * 100.0 * 0.05", 2)} AS opportunity_score
 FROM (SELECT *, {pct_sql("competitors", "n")} AS covered_pct FROM ca))"""


@query(
    f"""{BL}, {_DONORS}, {_CLASSES}, {_CAND}, p AS (SELECT domain, {rnd_sql("avg_dr", 2)} AS avg_dr, {rnd_sql("avg_ur", 2)} AS avg_ur, {rnd_sql("avg_traffic", 2)} AS avg_traffic, {rnd_sql("nofollow_rate", 4)} AS nofollow_rate,
 {rnd_sql("avg_dr * 0.5 + avg_ur * 0.3 + avg_traffic * 0.2 / 1000.0", 4)} AS priority_score FROM ca WHERE avg_dr > 5)
SELECT * FROM p WHERE CASE WHEN (SELECT count(*) FROM p WHERE avg_dr > 40 AND nofollow_rate < 0.5) > 0 THEN avg_dr > 40 AND nofollow_rate < 0.5 ELSE avg_dr > 30 AND nofollow_rate < 0.7 END"""
)
def d16_priorities(spark, sf_dir):
    return B.priorities(backlinks(spark, sf_dir), OUR)


@query(f"{BL}, {_DONORS}, {_CLASSES}, {_CAND}, {_OPP} SELECT * FROM op")
def d17_opportunities(spark, sf_dir):
    return B.opportunities(backlinks(spark, sf_dir), OUR)


@query(f"{BL}, {_DONORS}, {_CLASSES}, {_CAND}, {_OPP} SELECT *, {rnd_sql('covered_pct * 0.55 + avg_traffic / 200.0 * 0.25 + avg_dr * 0.20', 2)} AS popularity_score FROM op WHERE avg_dr >= 30 AND avg_traffic >= 50 AND follow_pct >= 60 AND lost_pct <= 40")
def d17_ready_to_buy(spark, sf_dir):
    return B.ready_to_buy(B.opportunities(backlinks(spark, sf_dir), OUR))


_CHECKS = {
    "rows": ("count(*) > 0", "count(*) > 0"),
    "dr_range": ("coalesce(min(dr) >= 0 AND max(dr) <= 100, TRUE)",) * 2,
    "domains_known": ("count(*) FILTER (WHERE source_domain = '') = 0",) * 2,
    "rows_vs_follow_total": ("count(*) = count(*) FILTER (WHERE follow) + count(*) FILTER (WHERE NOT follow) + count(*) FILTER (WHERE follow IS NULL)",) * 2,
    "rows_vs_ours_plus_competitors": ("count(*) = count(*) FILTER (WHERE ours) + count(*) FILTER (WHERE NOT ours)",) * 2,
    "ref_domains_vs_rows": ("count(DISTINCT source_domain) <= count(*)",) * 2,
    **{f"range_{k}": (f"count(*) FILTER (WHERE {w}) * 100.0 / greatest(1, count(*)) BETWEEN 0 AND 100",) * 2 for k, w in (("dofollow_pct", "follow"), ("nofollow_pct", "NOT follow"), ("lost_pct", "lost"), ("http_2xx_pct", "http_code LIKE '2%'"))},
}


@query(
    f"""{BL}, o AS (SELECT *, {_OWN} AS ours FROM bl), a AS (SELECT {", ".join(f"{v[0]} AS {k}" for k, v in _CHECKS.items())} FROM o), u AS (UNPIVOT a ON {", ".join(_CHECKS)} INTO NAME check_name VALUE ok)
SELECT check_name, CASE WHEN ok THEN 'ok' ELSE 'error' END AS status FROM u"""
)
def d19_checks(spark, sf_dir):
    """Reconciliation checks of the normalised table, from one pass."""
    links = backlinks(spark, sf_dir).withColumn("ours", U.is_own(F.col("target_domain"), OUR))
    a = links.agg(*[F.expr(v[1]).alias(k) for k, v in _CHECKS.items()])
    return a.unpivot([], list(_CHECKS), "check_name", "ok").select("check_name", F.when(F.col("ok"), "ok").otherwise("error").alias("status"))


@query(
    f"""{BL}, {_BEST}, g AS (SELECT source_domain AS ref_domain, count(*) AS links_to_our_site FROM bl WHERE {_OWN} GROUP BY 1)
SELECT ref_domain, links_to_our_site, dr AS batch_dr, traffic AS batch_traffic, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (ORDER BY links_to_our_site DESC, ref_domain) AS rank FROM g) LEFT JOIN best ON ref_domain = domain WHERE rank <= 50"""
)
def d40_our_donors(spark, sf_dir):
    """Our fifty first donors with their metrics."""
    g = backlinks(spark, sf_dir).where(U.is_own(F.col("target_domain"), OUR)).groupBy(F.col("source_domain").alias("ref_domain")).agg(F.count("*").alias("links_to_our_site"))
    m = B.best_metrics(domain_metrics(spark, sf_dir)).select(F.col("domain").alias("ref_domain"), F.col("dr").alias("batch_dr"), F.col("traffic").alias("batch_traffic"))
    return top_k(g, [], [F.desc("links_to_our_site"), F.asc("ref_domain")], 50).join(m, "ref_domain", "left").select("ref_domain", "links_to_our_site", "batch_dr", "batch_traffic", "rank")


@query(f"{BL} SELECT DISTINCT source_domain FROM bl WHERE NOT ({_OWN}) EXCEPT SELECT DISTINCT source_domain FROM bl WHERE {_OWN}")
def g3_donor_difference(spark, sf_dir):
    """Donors of competitors that are not ours."""
    links, own = backlinks(spark, sf_dir), U.is_own(F.col("target_domain"), OUR)
    return links.where(~own).select("source_domain").subtract(links.where(own).select("source_domain"))


_QUALITY = rnd_sql("follow_pct * 0.35 + http_2xx_pct * 0.25 + (100.0 - lost_pct) * 0.25 + (100.0 - homepage_pct) * 0.15", 2)


@query(
    f"""{BL}, {_PROFILE}, q AS (SELECT target_domain, follow_pct, lost_pct, http_2xx_pct, {_QUALITY} AS quality FROM pr), u AS (UNPIVOT q ON follow_pct, lost_pct, http_2xx_pct, quality INTO NAME metric VALUE v),
g AS (SELECT metric, {rnd_sql(f"avg(v) FILTER (WHERE {_OWN})", 2)} AS ours, {rnd_sql(f"avg(v) FILTER (WHERE NOT ({_OWN}))", 2)} AS competitors_mean FROM u GROUP BY metric UNION ALL SELECT 'avg_dr', {rnd_sql(f"avg(dr) FILTER (WHERE {_OWN})", 2)}, {rnd_sql(f"avg(dr) FILTER (WHERE NOT ({_OWN}))", 2)} FROM bl)
SELECT *, {rnd_sql("ours - competitors_mean", 2)} AS difference FROM g"""
)
def d14_executive_kpis(spark, sf_dir):
    """Our shares, authority and quality beside the competitors' means."""
    return B.executive_kpis(backlinks(spark, sf_dir), OUR)


_STRUCTURE = {"naked_pct": ("empty", "naked_url"), "brand_pct": ("brand", "brand_navigational"), "commercial_pct": ("commercial", "brand_commercial"), "navigational_pct": ("navigational", "generic", "other"), "spam_pct": ("spam",)}


@query(
    f"""{BL}, {_PROFILE}, a AS (SELECT {", ".join(f"{pct_sql(f'count(*) FILTER (WHERE t IN {tuple(ks) if len(ks) > 1 else chr(40) + chr(39) + ks[0] + chr(39) + chr(41)})', 'count(*)')} AS {k}" for k, ks in _STRUCTURE.items())} FROM (SELECT {_ANCHOR} AS t FROM {_X})),
r AS (SELECT a.*, coalesce((SELECT homepage_follow_pct FROM pr WHERE {_OWN}), 0.0) AS follow_to_home_pct, coalesce((SELECT internal_follow_pct FROM pr WHERE {_OWN}), 0.0) AS follow_to_inner_pct FROM a)
SELECT * FROM (UNPIVOT r ON {", ".join(_STRUCTURE)}, follow_to_home_pct, follow_to_inner_pct INTO NAME metric VALUE value)"""
)
def d14_profile_structure(spark, sf_dir):
    """Kinds of anchors as shares, and where our followed links lead."""
    links = _classed(spark, sf_dir)
    n = F.count("*")
    a = links.agg(*[pct(F.count_if(F.col("anchor_type").isin(*ks)), n).alias(k) for k, ks in _STRUCTURE.items()])
    ours = B.target_profile(links).where(U.is_own(F.col("target_domain"), OUR)).agg(F.coalesce(F.max("homepage_follow_pct"), F.lit(0.0)).alias("follow_to_home_pct"), F.coalesce(F.max("internal_follow_pct"), F.lit(0.0)).alias("follow_to_inner_pct"))
    return a.crossJoin(F.broadcast(ours)).unpivot([], [*_STRUCTURE, "follow_to_home_pct", "follow_to_inner_pct"], "metric", "value")


@query(
    f"""{BL}, m AS (SELECT source_domain AS domain, bool_or({_OWN}) AS has_ours, count(*) FILTER (WHERE NOT ({_OWN})) AS competitors, count(*) AS targets, coalesce(array_to_string(list_sort(list(target_domain) FILTER (WHERE NOT ({_OWN})))[1:8], ', '), '') AS competitor_list FROM (SELECT DISTINCT source_domain, target_domain FROM bl) GROUP BY 1)
SELECT *, CASE WHEN NOT has_ours AND competitors >= 2 THEN 'gap' WHEN has_ours AND competitors > 0 THEN 'shared' ELSE 'single' END AS gap_type FROM m"""
)
def c4_overlap_matrix(spark, sf_dir):
    """Every donor with its competitors and what kind of gap it is."""
    return B.overlap_matrix(backlinks(spark, sf_dir), OUR)


_BT = ["dr", "backlinks_all", "ref_domains_all", "follow_pct", "lost_pct", "http_2xx_pct", "homepage_pct", "ugc_pct", "sponsored_pct", "rendered_pct", "quality"]


def _means_sql(rows: str, names: list[str], where: str = "TRUE") -> str:
    row = lambda label, f: f"SELECT '{label}' AS domain, {', '.join(f'{rnd_sql(f + chr(40) + c + chr(41), 2)} AS {c}' for c in names)} FROM {rows} WHERE {where}"
    return f"SELECT domain, {', '.join(names)} FROM {rows} UNION ALL {row('mean', 'avg')} UNION ALL {row('median', 'median')}"


@query(f"{BL}, {_PROFILE}, {_BEST}, r AS (SELECT target_domain AS domain, pr.* EXCLUDE (target_domain), {_QUALITY} AS quality, dr, backlinks_all, ref_domains_all FROM pr LEFT JOIN best ON target_domain = domain) {_means_sql('r', _BT, f'domain <> {chr(39)}{OUR}{chr(39)}')}")
def d40_benchmark_table(spark, sf_dir):
    """Targets side by side, with mean and median of the competitors."""
    return B.benchmark_table(backlinks(spark, sf_dir), domain_metrics(spark, sf_dir), OUR)


@query(f"{BL}, {_BEST}, r AS (SELECT domain, dr, backlinks_all, ref_domains_all FROM best WHERE domain IN (SELECT target_domain FROM bl) AND coalesce(dr, backlinks_all, ref_domains_all) IS NOT NULL) {_means_sql('r', ['dr', 'backlinks_all', 'ref_domains_all'])}")
def d40_core_metrics(spark, sf_dir):
    """Authority, links and donors of the targets, with mean and median."""
    return B.core_metrics(backlinks(spark, sf_dir), domain_metrics(spark, sf_dir))


_TS = ["homepage_pct", "internal_pct", "follow_pct", "nofollow_pct", "ugc_pct", "sponsored_pct", "rendered_pct", "raw_pct"]


@query(f"{BL}, {_PROFILE} SELECT target_domain AS domain, {', '.join(_TS)} FROM pr")
def d40_target_structure(spark, sf_dir):
    """What each target's links are made of."""
    return B.target_profile(backlinks(spark, sf_dir)).select(F.col("target_domain").alias("domain"), *_TS)


@query(f"{BL}, {_DONORS}, {_CLASSES}, {_CAND}, {_OPP} SELECT domain, competitors_covered, covered_pct, avg_dr, avg_traffic, follow_pct, lost_pct, opportunity_score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (ORDER BY opportunity_score DESC, domain) AS rank FROM op) WHERE rank <= 800")
def d40_gap_donors(spark, sf_dir):
    """A report of the eight hundred best donors that only competitors have."""
    names = ["domain", "competitors_covered", "covered_pct", "avg_dr", "avg_traffic", "follow_pct", "lost_pct", "opportunity_score", "rank"]
    return top_k(B.opportunities(backlinks(spark, sf_dir), OUR), [], [F.desc("opportunity_score"), F.asc("domain")], 800).select(*names)


@query(
    f"""{BL}, {_DONORS}, {_CLASSES}, {_CAND}, {_BEST}, p AS (SELECT domain, {rnd_sql("avg_dr", 2)} AS avg_dr, {rnd_sql("avg_traffic", 2)} AS avg_traffic, {rnd_sql("avg_dr * 0.5 + avg_ur * 0.3 + avg_traffic * 0.2 / 1000.0", 4)} AS priority_score, nofollow_rate FROM ca WHERE avg_dr > 5),
f AS (SELECT domain, avg_dr, avg_traffic, priority_score FROM p WHERE CASE WHEN (SELECT count(*) FROM p WHERE avg_dr > 40 AND {rnd_sql("nofollow_rate", 4)} < 0.5) > 0 THEN avg_dr > 40 AND {rnd_sql("nofollow_rate", 4)} < 0.5 ELSE avg_dr > 30 AND {rnd_sql("nofollow_rate", 4)} < 0.7 END),
i AS (SELECT domain, dr AS avg_dr, traffic AS avg_traffic, dr * 2 AS priority_score FROM best WHERE ref_domains_all = 3)
SELECT * FROM i UNION ALL SELECT * FROM f WHERE domain NOT IN (SELECT domain FROM i)"""
)
def d40_imported_scores(spark, sf_dir):
    """Priorities where an imported list has its own scores for some domains."""
    scores = B.priorities(backlinks(spark, sf_dir), OUR).select("domain", "avg_dr", "avg_traffic", "priority_score")
    imported = B.best_metrics(domain_metrics(spark, sf_dir)).where("ref_domains_all = 3").select("domain", F.col("dr").alias("avg_dr"), F.col("traffic").alias("avg_traffic"), (F.col("dr") * 2).alias("priority_score"))
    return B.with_imported(scores, imported)


_ANCHOR_TYPES = ["empty", "naked_url", "spam", "brand_commercial", "brand_navigational", "brand", "navigational", "commercial", "informational", "generic", "other"]


@query(f"{BL} SELECT target_domain, {', '.join(f'count(*) FILTER (WHERE t = {chr(39)}{x}{chr(39)}) AS {x}' for x in _ANCHOR_TYPES)} FROM (SELECT target_domain, {_ANCHOR} AS t FROM {_X}) GROUP BY 1")
def d8_anchor_matrix(spark, sf_dir):
    """Kinds of anchors per target."""
    return _classed(spark, sf_dir).groupBy("target_domain").pivot("anchor_type", _ANCHOR_TYPES).count().fillna(0, _ANCHOR_TYPES)


@query("SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'R' THEN TRUE WHEN 'N' THEN FALSE ELSE l_linestatus <> 'F' END AS follow FROM lineitem")
def b7_follow_flags(spark, sf_dir):
    """Whether a link is followed: by its own flag, else by the opposite of the nofollow flag."""
    from crawlframe.sources.readers import flag

    raw = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", "CASE l_returnflag WHEN 'R' THEN 'DoFollow' WHEN 'N' THEN ' no ' ELSE '' END AS follow", "CASE l_linestatus WHEN 'F' THEN 'True' ELSE '0' END AS nofollow")
    return raw.select("l_orderkey", "l_linenumber", F.coalesce(flag(F.col("follow")), ~flag(F.col("nofollow"))).alias("follow"))
