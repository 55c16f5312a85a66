"""Queries of score catalogues over pages and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlframe.functions import text as T
from crawlframe.functions.common import rnd, rnd_sql
from crawlframe.operators import corpus
from crawlframe.operators import html as H
from crawlframe.operators import scores as S
from crawlframe.plans.page_queries import _PATH, _TEXT, _TITLE
from crawlframe.plans.registry import query, table
from crawlframe.plans.text_queries import _CHUNKS, _TFIDF, _content, _words, d37_entities


def _facts(spark, sf_dir) -> DataFrame:
    """Counts of a page that the catalogues below share."""
    h = F.col("html")
    d = table(spark, sf_dir, "pages").select("page_id", "url", "html", H.title(h).alias("title"), H.visible_text(h).alias("text"))
    n = lambda tag: H.count_tag(h, tag)
    return d.select("page_id", "url", "title", "text", F.size(F.split("text", " ")).alias("words"), n("h1").alias("h1"), n("p").alias("p"), n("a").alias("a"), n("article").alias("article"), n("nav").alias("nav"), n("ul").alias("ul"))


_COUNT = lambda tag: f"CAST(len(regexp_extract_all(html, '(?i)<{tag}[ >]')) AS INTEGER)"
FACTS = f"fa AS (SELECT page_id, url, {_TITLE} AS title, {_TEXT} AS text, len(string_split({_TEXT}, ' ')) AS words, {', '.join(f'{_COUNT(t)} AS {t}' for t in ('h1', 'p', 'a', 'article', 'nav', 'ul'))} FROM pages)"


_ARTICLE, _LISTING, _HOME = "article * 3 + CAST(p >= 3 AS INTEGER) * 2 + CAST(words >= 300 AS INTEGER) * 2", "CAST(a >= 20 AS INTEGER) * 4 + CAST(a > p AS INTEGER) * 2", f"CAST({_PATH} IN ('', '/') AS INTEGER) * 9"


@query(
    f"""WITH {FACTS}, e AS (SELECT page_id, CAST({_ARTICLE} AS DOUBLE) AS article, CAST({_LISTING} AS DOUBLE) AS listing, CAST({_HOME} AS DOUBLE) AS home FROM fa)
SELECT page_id, CASE WHEN greatest(article, listing, home) < 2 THEN 'unknown' WHEN article = greatest(article, listing, home) THEN 'article' WHEN listing = greatest(article, listing, home) THEN 'listing' ELSE 'home' END AS page_type,
 CASE WHEN greatest(article, listing, home) < 2 THEN 0.0 ELSE {rnd_sql("greatest(article, listing, home) / greatest(1.0, article + listing + home)", 4)} END AS confidence FROM e"""
)
def b19_page_type_evidence(spark, sf_dir):
    """Page type with the highest evidence, and its share of all evidence."""
    from crawlframe.functions.urls import path

    i = lambda c: c.cast("int")
    c = F.col
    evidence = {"article": c("article") * 3 + i(c("p") >= 3) * 2 + i(c("words") >= 300) * 2, "listing": i(c("a") >= 20) * 4 + i(c("a") > c("p")) * 2, "home": i(path(c("url")).isin("", "/")) * 9}
    d = _facts(spark, sf_dir).select("page_id", S.argmax_label(evidence, 2).alias("t"))
    return d.select("page_id", F.col("t.label").alias("page_type"), "t.confidence")


_TERMS = [("content", "words", 0.05, 40.0), ("structure", "h1 * 10 + p", 1.0, 30.0), ("links", "a", 0.5, 20.0), ("title", "CAST(length(title) BETWEEN 10 AND 60 AS INTEGER)", 10.0, 10.0)]


def _terms() -> list[S.Term]:
    return [S.Term(n, F.expr(v), w, c) for n, v, w, c in _TERMS]


_POINTS = [f"least({c!r}::DOUBLE, CAST({v} AS DOUBLE) * {w!r}::DOUBLE)" for _, v, w, c in _TERMS]


@query(f"WITH {FACTS} SELECT page_id, {rnd_sql('greatest(0.0, least(100.0, ' + ' + '.join(_POINTS) + '))', 1)} AS score FROM fa")
def h28_page_score(spark, sf_dir):
    """A page score from the catalogue of terms."""
    return _facts(spark, sf_dir).select("page_id", S.score(_terms()).alias("score"))


@query(f"WITH {FACTS} " + " UNION ALL ".join(f"SELECT page_id, '{t[0]}' AS term, {rnd_sql(p, 2)} AS points FROM fa" for t, p in zip(_TERMS, _POINTS, strict=True)))
def h28_score_breakdown(spark, sf_dir):
    """What each term gives to a page's score."""
    return S.breakdown(_facts(spark, sf_dir), ["page_id"], _terms())


_DETECTORS = {"heading": "CAST(h1 > 0 AS DOUBLE)", "navigation": "CAST(nav > 0 AS DOUBLE) * 0.9", "list": "CAST(ul > 0 AS DOUBLE) * 0.8", "article": "CAST(article > 0 AS DOUBLE)", "long_text": "least(1.0, CAST(words AS DOUBLE) / 500.0)", "question": "CAST(text LIKE '%?%' AS DOUBLE) * 0.5"}
_DET = "dt AS (" + " UNION ALL ".join(f"SELECT page_id, CASE WHEN a >= 20 THEN 'listing' ELSE 'article' END AS page_type, '{k}' AS detector, CAST({v.replace('0.9', '0.9::DOUBLE').replace('0.8', '0.8::DOUBLE').replace('* 0.5', '* 0.5::DOUBLE')} AS DOUBLE) AS confidence FROM fa" for k, v in _DETECTORS.items()) + ")"


def _detected(spark, sf_dir) -> DataFrame:
    d = _facts(spark, sf_dir).withColumn("page_type", F.when(F.col("a") >= 20, "listing").otherwise("article"))
    return S.detector_rows(d, ["page_id", "page_type"], {k: F.expr(v) for k, v in _DETECTORS.items()})


@query(f"WITH {FACTS}, {_DET} SELECT page_id, {rnd_sql('avg(CAST(confidence > 0 AS INTEGER))', 4)} AS coverage, {rnd_sql('coalesce(avg(confidence) FILTER (WHERE confidence > 0), 0.0)', 4)} AS mean_confidence FROM dt GROUP BY page_id")
def h29_detector_coverage(spark, sf_dir):
    """Share of detectors that found something in a page, and their mean confidence."""
    return S.coverage(_detected(spark, sf_dir), ["page_id"])


PROFILE = [("article", "list", 0.5, 0.3), ("article", "long_text", 1.1, 0.2), ("listing", "article", 0.6, 0.7), ("listing", "list", 1.2, 0.0)]


@query(
    f"""WITH {FACTS}, {_DET}, pf(page_type, detector, m, f) AS (VALUES {", ".join(f"('{a}', '{b}', {m!r}::DOUBLE, {f!r}::DOUBLE)" for a, b, m, f in PROFILE)}),
c AS (SELECT page_id, detector, confidence, {rnd_sql("least(1.0, confidence * coalesce(m, 1.0))", 4)} AS v, coalesce(f, 0.0) AS f FROM dt LEFT JOIN pf USING (page_type, detector))
SELECT page_id, detector, {rnd_sql("confidence", 4)} AS confidence, CASE WHEN v < f THEN 0.0 ELSE v END AS calibrated, CASE WHEN v < f THEN 0.0 ELSE v END < confidence AS downgraded FROM c"""
)
def d39_calibration(spark, sf_dir):
    """Confidences by page type and detector."""
    profile = spark.createDataFrame(PROFILE, "page_type string, detector string, multiplier double, floor double")
    c = S.calibrated(_detected(spark, sf_dir), profile)
    return c.select("page_id", "detector", rnd(F.col("confidence"), 4).alias("confidence"), "calibrated", "downgraded")


@query(f"WITH {FACTS} SELECT page_id, CASE WHEN h1 = 0 THEN 'add_heading' WHEN words < 200 THEN 'extend_text' WHEN length(title) > 60 THEN 'shorten_title' WHEN a = 0 THEN 'add_links' ELSE 'none' END AS recommendation FROM fa")
def h26_recommendation(spark, sf_dir):
    """The first recommendation that applies to a page."""
    c = F.col
    pick = F.when(c("h1") == 0, "add_heading").when(c("words") < 200, "extend_text").when(F.length("title") > 60, "shorten_title").when(c("a") == 0, "add_links").otherwise("none")
    return _facts(spark, sf_dir).select("page_id", pick.alias("recommendation"))


BLOCKS = [("navigation", "<nav"), ("footer", "<footer"), ("advert", 'class="ad"'), ("article", "<article"), ("faq", "itemtype=\"https://schema.org/FAQPage\""), ("tracking", "track\\(")]


@query(f"SELECT page_id, block, CAST(len(regexp_extract_all(html, pattern)) AS INTEGER) AS hits FROM pages, (VALUES {', '.join(f'''('{a}', '{b}')''' for a, b in BLOCKS)}) AS b(block, pattern) WHERE regexp_matches(html, pattern)")
def h22_block_patterns(spark, sf_dir):
    """Kinds of blocks found in a page by a dictionary of patterns."""
    d = F.broadcast(spark.createDataFrame(BLOCKS, "block string, pattern string"))
    p = table(spark, sf_dir, "pages").select("page_id", "html").join(d, F.expr("html rlike pattern"))
    return p.select("page_id", "block", F.expr("regexp_count(html, pattern)").alias("hits"))


@query(
    f"""WITH {_TFIDF}, t AS (SELECT doc_id, term FROM tfidf WHERE rank = 1), d AS (SELECT doc_id, trim(regexp_extract(text, '^([^.!?\\n]{{3,80}})[.!?\\n]', 1)) AS head FROM documents)
SELECT doc_id, CASE WHEN head <> '' THEN head ELSE coalesce(term, 'misc') END AS topic, CASE WHEN head <> '' THEN 0.8 WHEN term IS NOT NULL THEN 0.5 ELSE 0.1 END AS confidence FROM d LEFT JOIN t USING (doc_id)"""
)
def h23_topic_label(spark, sf_dir):
    """Topic from the first sentence, else the best term, else none."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    t = corpus.tfidf(docs).where("rank = 1").select("doc_id", "term")
    head = F.trim(F.regexp_extract("text", r"^([^.!?\n]{3,80})[.!?\n]", 1))
    d = docs.select("doc_id", head.alias("head")).join(t, "doc_id", "left")
    return d.select("doc_id", F.when(F.col("head") != "", F.col("head")).otherwise(F.coalesce("term", F.lit("misc"))).alias("topic"), F.when(F.col("head") != "", 0.8).when(F.col("term").isNotNull(), 0.5).otherwise(0.1).alias("confidence"))


_ENTITIES = r"""en AS (SELECT doc_id, unnest(list_filter(regexp_extract_all(text, '[\p{L}\p{N}_]+'), lambda x: regexp_matches(x, '^[A-ZА-Я][A-Za-zА-Яа-я0-9]{2,}$'))) AS x FROM documents),
eg AS (SELECT doc_id, lower(x) AS entity, count(*) AS mentions FROM en GROUP BY 1, 2), et AS (SELECT doc_id, entity FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY mentions DESC, entity) AS r FROM eg) WHERE r <= 20)"""


@query(f"WITH {_ENTITIES} SELECT a.entity AS a, b.entity AS b, count(*) AS documents FROM et a JOIN et b ON a.doc_id = b.doc_id AND a.entity < b.entity GROUP BY 1, 2")
def h30_entity_graph(spark, sf_dir):
    """Entities that stand in the same documents, among the twenty first of each."""
    return S.cooccurrence(d37_entities(spark, sf_dir))


#: Whole words that begin with a capital, as those of RUN that have the form of a name. The capital comes first, so that not every
#: place is looked back from; with U+10000, a letter, in its class Java looks back over whole code points.
NAMED = "[A-ZА-Я](?<![\\p{L}\\p{N}_\U00010000][A-ZА-Я])[A-Za-zА-Яа-я0-9]{2,}+(?![\\p{L}\\p{N}_])"
_UTILITY = "(privacy|cookie|terms|subscribe|copyright)"


@query(
    rf"""WITH {_CHUNKS}, c AS (SELECT struct_pack(doc_id := doc_id, idx := idx) AS b, chunk FROM ch), n AS (SELECT count(*) AS n FROM c),
l AS (SELECT item_id AS a, x, CAST(count(*) AS DOUBLE) AS w FROM (SELECT item_id, unnest({_content("text")}) AS x FROM benchmark) GROUP BY 1, 2), r AS (SELECT b, x, CAST(count(*) AS DOUBLE) AS w FROM (SELECT b, unnest({_content("chunk")}) AS x FROM c) GROUP BY 1, 2),
f AS (SELECT x, count(*) AS df FROM r GROUP BY x), lw AS (SELECT a, x, w * (ln((n + 1) / (coalesce(df, 0) + 1)) + 1.0) AS w FROM l LEFT JOIN f USING (x), n), rw AS (SELECT b, x, w * (ln((n + 1) / (coalesce(df, 0) + 1)) + 1.0) AS w FROM r LEFT JOIN f USING (x), n),
p AS (SELECT a, b, sum(lw.w * rw.w) AS dot FROM lw JOIN rw USING (x) GROUP BY 1, 2), na AS (SELECT a, sum(w * w) AS q FROM lw GROUP BY a), nb AS (SELECT b, sum(w * w) AS q FROM rw GROUP BY b),
m AS (SELECT b, least(1.0, CAST(len(list_filter(regexp_extract_all(chunk, '[\p{{L}}\p{{N}}_]+'), lambda x: regexp_matches(x, '^[A-ZА-Я][A-Za-zА-Яа-я0-9]{{2,}}$'))) AS DOUBLE) / greatest(1, len(regexp_extract_all(chunk, '[A-Za-zА-Яа-я0-9]+')))) AS entity,
 least(1.0, CAST(len(regexp_extract_all(chunk, '[A-Za-zА-Яа-я0-9]')) AS DOUBLE) / greatest(1, length(chunk))) AS ratio, regexp_matches(lower(chunk), '{_UTILITY}') OR len({_content("chunk")}) < 35 AS utility FROM c),
s AS (SELECT a, b, {rnd_sql("(0.65::DOUBLE * dot / sqrt(na.q * nb.q) + 0.2::DOUBLE * entity + 0.15::DOUBLE * ratio) * CASE WHEN utility THEN 0.55::DOUBLE ELSE 1.0::DOUBLE END", 4)} AS score FROM p JOIN na USING (a) JOIN nb USING (b) JOIN m USING (b))
SELECT a AS item_id, b.doc_id AS doc_id, CAST(b.idx AS INTEGER) AS idx, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS rank FROM s) WHERE rank <= 3"""
)
def h16_chunk_ranking(spark, sf_dir):
    """The three best chunks for each item, by rare common terms, entities and content."""
    c = corpus.chunks(table(spark, sf_dir, "documents").select("doc_id", "text")).select(F.struct("doc_id", "idx").alias("doc_id"), F.col("chunk").alias("text"))
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    x, one = F.col("text"), F.lit(1.0)
    c = c.withColumns({"tokens": corpus.content_tokens(x), "runs": T.all_of(x, "[A-Za-zА-Яа-я0-9]+"), "named": F.regexp_count(x, F.lit(NAMED))})
    entity = F.least(one, T.ratio(F.col("named"), F.size("runs")))
    ratio = F.least(one, T.ratio(F.length(F.concat_ws("", "runs")), F.length(x)))
    utility = T.has_any(F.lower(x), _UTILITY.strip("()").split("|")) | (F.size("tokens") < 35)
    c = c.select("doc_id", "tokens", (0.2 * entity + 0.15 * ratio).alias("bonus"), F.when(utility, 0.55).otherwise(1.0).alias("factor"))
    found = corpus.best_matches(items, c, 3, tf_idf=True, share=0.65, digits=4)
    return found.select(F.col("a").alias("item_id"), "b.doc_id", "b.idx", "score", "rank")
