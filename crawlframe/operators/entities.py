"""Named things in texts and markup, in seven groups: found by patterns, by a dictionary and by markup, merged by canonical key."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlframe.functions.common import rnd
from crawlframe.sources.shipping import ship

# Groups, patterns with their confidence, suffixes, boost of a further source, weights of linkage.
GROUPS = ["organizations", "persons", "products", "services", "brands", "software", "locations"]
_CAPITAL, _LETTER, _END = "[A-ZА-Я]", "[A-Za-zА-Яа-я]", "(?:$|[^A-Za-zА-Яа-я0-9_])"
_BEGIN = "(?:^|[^A-Za-zА-Яа-я0-9_])"
PATTERNS = [
    ("organizations", 0.8, rf"{_BEGIN}({_CAPITAL}[A-Za-zА-Яа-я0-9&.-]{{1,40}}(?:\s+{_CAPITAL}[A-Za-zА-Яа-я0-9&.-]{{1,40}}){{0,3}}\s+(?:Inc|LLC|Ltd|Corp|Group|Company|ООО|ЗАО|ОАО|АО)){_END}"),
    ("persons", 0.76, rf"(?i){_BEGIN}(?:by|author|written by|автор)\s+({_LETTER}[A-Za-zА-Яа-я-]{{1,30}}(?:\s+{_LETTER}[A-Za-zА-Яа-я-]{{1,30}}){{0,2}})"),
    ("software", 0.78, rf"(?i){_BEGIN}({_LETTER}[A-Za-zА-Яа-я0-9-]{{2,}}(?:\s+[A-Za-zА-Яа-я0-9-]{{1,20}}){{0,2}})\s+(?:software|platform|app|sdk|api){_END}"),
    ("products", 0.74, rf"(?i){_BEGIN}({_LETTER}[A-Za-zА-Яа-я0-9-]{{2,}}(?:\s+[A-Za-zА-Яа-я0-9-]{{1,15}}){{0,3}})\s+(?:usd|eur|price|pricing|buy|купить|цена){_END}"),
    ("services", 0.75, rf"(?i){_BEGIN}({_LETTER}[A-Za-zА-Яа-я0-9-]{{2,}}(?:\s+[A-Za-zА-Яа-я0-9-]{{1,20}}){{0,3}})\s+(?:service|services|solution|solutions|consulting|integration|support|maintenance|сервис){_END}"),
    ("brands", 0.73, rf"(?i){_BEGIN}({_LETTER}[A-Za-zА-Яа-я0-9&.-]{{2,}}(?:\s+{_LETTER}[A-Za-zА-Яа-я0-9&.-]{{1,20}}){{0,2}})\s+(?:brand|бренд|trade mark|tm){_END}"),
    ("locations", 0.7, rf"(?i){_BEGIN}(?:in|at|from|город|в)\s+({_LETTER}[A-Za-zА-Яа-я-]{{2,}}(?:\s+{_LETTER}[A-Za-zА-Яа-я-]{{2,}}){{0,2}}){_END}"),
]
SUFFIXES = ["inc", "llc", "ltd", "corp", "co", "company", "group", "gmbh", "srl", "ооо", "зао", "оао", "ао", "ип"]
MARKUP_CONFIDENCE = 0.95
DICTIONARY_CONFIDENCE = 0.83
FURTHER_SOURCE = 0.04
LINKAGE = {"organizations": 1.2, "products": 1.0, "services": 1.0, "brands": 0.8, "persons": 0.7}
TYPE_GROUPS = {"Organization": "organizations", "LocalBusiness": "organizations", "Person": "persons", "Product": "products", "Service": "services", "Brand": "brands", "SoftwareApplication": "software", "Place": "locations", "PostalAddress": "locations"}
#: Terms of a dictionary that are sent to all tasks at most: some 100 MB as an automaton.
DICTIONARY_TERMS = 500_000


def clean_name(name: Column) -> Column:
    """Single spaces, no punctuation or brackets at the ends, 120 characters."""
    inner = F.regexp_replace(F.regexp_replace(name, r"\s+", " "), r"^[ ,.;:()\[\]{}]+|[ ,.;:()\[\]{}]+$", "")
    return F.substring(inner, 1, 120)


def canonical_key(name: Column) -> Column:
    """What spellings of a name have in common: lower case, no marks, no legal form at the end; the name itself if nothing is left."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(name), "[\"'`]", ""), r"[^a-zа-яё0-9_\s&-]", " ")
    plain = F.trim(F.regexp_replace(plain, r"\s+", " "))
    forms = "|".join(SUFFIXES)
    key = F.regexp_replace(plain, rf"(?:^|\s)(?:{forms})(?:\s(?:{forms}))*$", "")
    return F.when(key != "", key).otherwise(F.lower(name))


def by_patterns(texts: DataFrame) -> DataFrame:
    """``texts(page_id, text)`` -> ``(page_id, bucket, name, source, confidence)``, a row for each match."""

    def of(bucket: str, confidence: float, pattern: str) -> Column:
        told = lambda x: F.struct(F.lit(bucket).alias("bucket"), x.alias("name"), F.lit("text").alias("source"), F.lit(confidence).alias("confidence"))
        return F.transform(F.regexp_extract_all("text", F.lit(pattern), F.lit(1)), told)

    found = [of(*p) for p in PATTERNS]
    return texts.select("page_id", F.explode(F.concat(*found)).alias("x")).select("page_id", "x.*")


def plain_words(text: Column) -> Column:
    """Lower case words between single spaces, one at either end."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), r"[^a-zа-яё0-9#&]+", " ")), F.lit(" "))


def by_dictionary(texts: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Terms of ``dictionary(term, bucket)`` in each text, as whole words, all in one pass of an automaton over the text."""
    terms = dictionary.select(plain_words(F.col("term")).alias("words"), "term", "bucket").where("length(words) > 2").distinct()
    known = terms.limit(DICTIONARY_TERMS + 1).collect()
    if len(known) > DICTIONARY_TERMS:
        raise ValueError(f"a dictionary holds {DICTIONARY_TERMS} terms at most; deal a larger one over several calls")
    by_words: dict[str, list[tuple[str, str]]] = {}
    for r in known:
        by_words.setdefault(r["words"], []).append((r["term"], r["bucket"]))
    shared = texts.sparkSession.sparkContext.broadcast(by_words)
    ship(texts.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for words, things in shared.value.items():
            automaton.add_word(words, things)
        automaton.make_automaton()
        for batch in batches:
            rows = []
            for page, words in zip(batch["page_id"], batch["words"], strict=True):
                if len(automaton) and words:
                    rows += [(page, bucket, term) for things in {id(t): t for _, t in automaton.iter(words)}.values() for term, bucket in things]
            yield pd.DataFrame(rows, columns=["page_id", "bucket", "name"])

    found = texts.select(F.col("page_id").cast("long"), plain_words(F.col("text")).alias("words")).mapInPandas(run, "page_id long, bucket string, name string")
    return found.select("page_id", "bucket", "name", F.lit("dictionary").alias("source"), F.lit(DICTIONARY_CONFIDENCE).alias("confidence"))


def by_markup(entities: DataFrame) -> DataFrame:
    """Names of typed things (``blocks.dom_entities``) in the group of their type; other types have none."""
    bucket = F.create_map(*[F.lit(x) for kv in TYPE_GROUPS.items() for x in kv])[F.col("type")]
    return entities.select("page_id", bucket.alias("bucket"), "name", F.lit("schema").alias("source"), F.lit(MARKUP_CONFIDENCE).alias("confidence")).where("bucket is not null")


def merged(mentions: list[DataFrame]) -> DataFrame:
    """``(page_id, bucket, key, name, confidence, sources, source_count)``: spellings of one thing on a page are one row.

    The name is that of the surest mention, the first in text order of equals; each further source adds to its confidence.
    """
    m = reduce(DataFrame.unionByName, mentions).withColumn("name", clean_name(F.col("name"))).where(F.length("name") >= 2)
    m = m.withColumn("key", canonical_key(F.col("name")))
    g = m.groupBy("page_id", "bucket", "key").agg(F.min_by("name", F.struct(-F.col("confidence"), "name")).alias("name"), F.max("confidence").alias("most"), F.array_sort(F.collect_set("source")).alias("s"))
    sure = F.least(F.lit(0.99), F.col("most") + (F.size("s") - 1) * FURTHER_SOURCE)
    return g.select("page_id", "bucket", "key", "name", rnd(sure, 3).alias("confidence"), F.array_join("s", "+").alias("sources"), F.size("s").alias("source_count"))


def coverage(pages: DataFrame, entities: DataFrame) -> DataFrame:
    """Per page of ``pages(page_id, text)``: things of each group, share of the groups that have some, things a word, linkage."""
    g = entities.groupBy("page_id").pivot("bucket", GROUPS).count()
    p = pages.select("page_id", F.size(F.regexp_extract_all("text", F.lit("[A-Za-zА-Яа-я0-9]+"), F.lit(0))).alias("words")).join(g, "page_id", "left").fillna(0, GROUPS)
    present = sum((F.col(b) > 0).cast("int") for b in GROUPS)
    total = sum(F.col(b) for b in GROUPS)
    linkage = F.least(F.lit(100.0), sum(F.col(b) * w for b, w in LINKAGE.items()) * 4.5)
    return p.select("page_id", *GROUPS, rnd(present / 7.0 * 100.0, 2).alias("coverage"), rnd(total / F.greatest(F.lit(1), F.col("words")), 6).alias("density"), rnd(linkage, 2).alias("linkage"))


def linked_groups(entities: DataFrame) -> DataFrame:
    """``(bucket_a, bucket_b, pairs, pages)``: how often things of two groups stand on one page.

    Counts of a page's groups are multiplied, so that no pairs of things are made.
    """
    g = entities.groupBy("page_id", "bucket").agg(F.count("*").alias("n"))
    g = g.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("bucket", "n"))).alias("b"))
    two = F.flatten(F.transform("b", lambda x, i: F.transform(F.slice("b", i + 1, F.size("b")), lambda y: F.struct(x["bucket"].alias("a"), y["bucket"].alias("z"), F.when(x["bucket"] == y["bucket"], x["n"] * (x["n"] - 1) / 2).otherwise(x["n"] * y["n"]).cast("long").alias("n")))))
    rows = g.select(F.explode(two).alias("p")).where("p.n > 0")
    return rows.groupBy(F.col("p.a").alias("bucket_a"), F.col("p.z").alias("bucket_b")).agg(F.sum("p.n").alias("pairs"), F.count("*").alias("pages"))
