"""Queries over named things of pages, from patterns, a dictionary of the tables' names and markup."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlframe.functions.common import rnd_sql as R
from crawlframe.operators import blocks as K
from crawlframe.operators import entities as E
from crawlframe.plans.block_queries import _THINGS, _TYPES, block_pages
from crawlframe.plans.registry import query, table

_SAID = """concat('Words of page ', CAST(page_id AS {S}), '. ', CASE page_id % 8 WHEN 0 THEN 'A note by Anna Berg, on Acme Works Ltd and its rivals. ' WHEN 1 THEN 'Our Flowmeter platform, made by acme works; see "Acme Works" too. ' WHEN 2 THEN 'The Borealis Pump price is low. Nordic Pipe Group sells it in Oslo. '
 WHEN 3 THEN 'Ask for Nordic Pipe maintenance, from Bergen, or Leak Finder software. ' WHEN 4 THEN 'Borealis brand pumps were shipped at Rotterdam. ' WHEN 5 THEN '' ELSE concat('What suppliers of ', lower(n_name), ' and ', n_name, ' say about Brand#', CAST(page_id % 5 + 1 AS {S}), CAST(page_id % 3 + 1 AS {S}), '. ') END, 'That is all of it.')"""


def texts(spark, sf_dir) -> DataFrame:
    p, n = table(spark, sf_dir, "pages").select("page_id"), table(spark, sf_dir, "nation")
    return p.join(n, p["page_id"] % 25 == n["n_nationkey"], "left").select("page_id", F.expr(_SAID.format(S="STRING")).alias("text"))


def dictionary(spark, sf_dir) -> DataFrame:
    """Names of nations and brands."""
    places = table(spark, sf_dir, "nation").select(F.col("n_name").alias("term"), F.lit("locations").alias("bucket"))
    return places.union(table(spark, sf_dir, "part").select("p_brand", F.lit("brands"))).distinct()


def things(spark, sf_dir) -> DataFrame:
    t = texts(spark, sf_dir)
    marked = K.dom_entities(K.nodes(block_pages(spark, sf_dir)))
    return E.merged([E.by_patterns(t), E.by_dictionary(t, dictionary(spark, sf_dir)), E.by_markup(marked)])


_FORMS = "|".join(E.SUFFIXES)
_WORDS = "' ' || trim(regexp_replace(lower({0}), '[^a-zа-яё0-9#&]+', ' ', 'g')) || ' '"
_MATCHES = " UNION ALL ".join(f"SELECT page_id, '{b}' AS bucket, unnest(regexp_extract_all(text, '{p}', 1)) AS name, 'text' AS source, {c}::DOUBLE AS confidence FROM tx" for b, c, p in E.PATTERNS)
_GROUP_OF = "CASE " + " ".join(f"WHEN type = '{t}' THEN '{b}'" for t, b in E.TYPE_GROUPS.items()) + " END"
_ENTITIES = f"""{_THINGS}, ex AS (SELECT *, 'microdata' AS syntax, itemtype AS kind FROM en WHERE itemtype <> '' UNION ALL SELECT *, 'rdfa', typeof FROM en WHERE typeof <> ''),
ep AS (SELECT page_id, pos, named, 'microdata' AS syntax FROM en WHERE lower(itemprop) IN ('name', 'legalname', 'alternatename', 'headline', 'title') AND named <> '' UNION ALL SELECT page_id, pos, named, 'rdfa' FROM en WHERE lower(property) IN ('name', 'schema:name', 'headline', 'title') AND named <> ''),
ej AS (SELECT ex.page_id, ex.pos, ex.syntax, ex.kind, ex.named AS own, list(DISTINCT ep.named) FILTER (ep.pos IS NOT NULL) AS names FROM ex LEFT JOIN ep ON ep.page_id = ex.page_id AND ep.syntax = ex.syntax AND ep.pos > ex.pos AND ep.pos <= ex.leave GROUP BY ALL),
ek AS (SELECT DISTINCT page_id, pos, unnest({_TYPES.format("kind")}) AS type, CASE WHEN len(names) > 0 THEN names WHEN own <> '' THEN [own] ELSE [] END AS names FROM ej),
tx AS (SELECT page_id, {_SAID.format(S="VARCHAR")} AS text FROM pages LEFT JOIN nation ON page_id % 25 = n_nationkey),
di AS (SELECT DISTINCT n_name AS term, 'locations' AS bucket FROM nation UNION SELECT DISTINCT p_brand, 'brands' FROM part),
m0 AS ({_MATCHES} UNION ALL SELECT page_id, bucket, term, 'dictionary', 0.83::DOUBLE FROM tx JOIN di ON contains({_WORDS.format("text")}, {_WORDS.format("term")}) UNION ALL SELECT page_id, {_GROUP_OF} AS bucket, unnest(names), 'schema', 0.95::DOUBLE FROM ek WHERE {_GROUP_OF} IS NOT NULL),
m1 AS (SELECT page_id, bucket, substr(regexp_replace(regexp_replace(name, '\\s+', ' ', 'g'), '^[ ,.;:()\\[\\]{{}}]+|[ ,.;:()\\[\\]{{}}]+$', '', 'g'), 1, 120) AS name, source, confidence FROM m0),
m2 AS (SELECT *, regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(lower(name), '["''`]', '', 'g'), '[^a-zа-яё0-9_\\s&-]', ' ', 'g'), '\\s+', ' ', 'g')), '(?:^|\\s)(?:{_FORMS})(?:\\s(?:{_FORMS}))*$', '') AS k FROM m1 WHERE length(name) >= 2),
eg AS (SELECT page_id, bucket, CASE WHEN k <> '' THEN k ELSE lower(name) END AS key, arg_min(name, (-confidence, name)) AS name, max(confidence) AS most, list_sort(list(DISTINCT source)) AS s FROM m2 GROUP BY 1, 2, 3),
ent AS (SELECT page_id, bucket, key, name, {R("least(0.99::DOUBLE, most + (len(s) - 1) * 0.04::DOUBLE)", 3)} AS confidence, array_to_string(s, '+') AS sources, CAST(len(s) AS INTEGER) AS source_count FROM eg)"""


@query(f"WITH {_ENTITIES} SELECT * FROM ent")
def d37_entity_groups(spark, sf_dir):
    """Things of seven groups on each page, spellings merged, with their sources and confidence."""
    return things(spark, sf_dir)


_N = ", ".join(f"count(*) FILTER (bucket = '{b}') AS {b}" for b in E.GROUPS)
_PRESENT = " + ".join(f"CAST({b} > 0 AS INTEGER)" for b in E.GROUPS)
_LINK = " + ".join(f"{b} * {w}::DOUBLE" for b, w in E.LINKAGE.items())


@query(
    f"""WITH {_ENTITIES}, g AS (SELECT page_id, {_N} FROM ent GROUP BY 1), c AS (SELECT tx.page_id, len(regexp_extract_all(text, '[A-Za-zА-Яа-я0-9]+')) AS words, {", ".join(f"coalesce({b}, 0) AS {b}" for b in E.GROUPS)} FROM tx LEFT JOIN g USING (page_id))
SELECT page_id, {", ".join(E.GROUPS)}, {R(f"({_PRESENT}) / 7.0::DOUBLE * 100.0::DOUBLE", 2)} AS coverage, {R(f"({' + '.join(E.GROUPS)}) / greatest(1, words)::DOUBLE", 6)} AS density, {R(f"least(100.0::DOUBLE, ({_LINK}) * 4.5::DOUBLE)", 2)} AS linkage FROM c"""
)
def h30_entity_coverage(spark, sf_dir):
    """How many of the seven groups each page has, things a word, and linkage."""
    return E.coverage(texts(spark, sf_dir), things(spark, sf_dir))


@query(
    f"""WITH {_ENTITIES}, x AS (SELECT a.bucket AS bucket_a, b.bucket AS bucket_b, a.page_id FROM ent a JOIN ent b ON a.page_id = b.page_id AND (a.bucket < b.bucket OR (a.bucket = b.bucket AND a.key < b.key)))
SELECT bucket_a, bucket_b, count(*) AS pairs, count(DISTINCT page_id) AS pages FROM x GROUP BY 1, 2"""
)
def h30_linked_groups(spark, sf_dir):
    """How often things of two groups stand on one page."""
    return E.linked_groups(things(spark, sf_dir))
