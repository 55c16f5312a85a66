"""Licence scan by canonical digests: texts that are a known licence once case, punctuation and spelling are evened out.

A text's lines are lower-cased, lines that state a copyright or only name a licence are taken out, all but letters and digits
becomes one space, and equivalent spellings become one. The digest of what is left of the entire text, and that of each of its
lines, are joined to the digests of known licences. Only DataFrame functions are used. The known digests are broadcast if a
count shows that they are few. Texts are evened out once; of the corpus only matches are shuffled by their text, and then
joined to the documents' ids, so that Spark can broadcast them or split copies of one text over tasks.

Defined cases: a null text has no licence; lines that are empty once evened out match nothing; known texts with equal digests
go by the least name; equal texts are treated alike; repeated rows are answered once each; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlframe.llm import license_texts
from crawlframe.llm.common import lower_ascii, save

BROADCAST_ROWS = 100_000

#: Spellings that count as one, as (from, to).
EQUIVALENT = [
    ("licenc", "licens"),
    ("organis", "organiz"),
    ("authoris", "authoriz"),
    ("recognis", "recogniz"),
    ("acknowledgement", "acknowledgment"),
    ("favour", "favor"),
    ("behaviour", "behavior"),
    ("fulfilment", "fulfillment"),
    ("judgement", "judgment"),
    ("merchantibility", "merchantability"),
    ("non commercial", "noncommercial"),
    ("sub licens", "sublicens"),
    ("per cent", "percent"),
    ("whilst", "while"),
    ("copyright owner", "copyright holder"),
    ("http ", "https "),
]

#: A line that only states a copyright: it begins with the word or the sign, and the word is not part of the terms.
COPYRIGHT_LINE = r"^[^\p{L}]*(copyright([^\p{L}]|$)|\(c\)|©|all rights reserved[^\p{L}]*$)"
TERMS_LINE = r"^[^\p{L}]*copyright (notice|holder|owner|law|licen|interest|statement|and |or |in |of |to )"
#: A line that only names a licence: "The MIT License (MIT)".
TITLE_LINE = r"^[^\p{L}]*(the )?((new|modified|simplified|revised|bsd [0-9][- ]clause|mit|mit-0|mit no attribution|isc|0bsd|bsd zero clause|bsd|zlib|boost software)[ -]?)+(\"[a-z0-9 -]+\" ?)?licen[sc]e([ ,-]*version [0-9.]+)?( \([a-z0-9 -]+\))?[^\p{L}]*$"

KNOWN = license_texts.known()


def known_licences(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(KNOWN, "license string, text string")


def canonical_lines(text: Column) -> Column:
    """Lines of a text, evened out; copyright and title lines and empty ones are left out."""
    stated = F.filter(F.split(lower_ascii(text), "\n"), lambda x: ~(x.rlike(COPYRIGHT_LINE) & ~x.rlike(TERMS_LINE)) & ~x.rlike(TITLE_LINE))

    def even(line: Column) -> Column:
        line = F.trim(F.regexp_replace(line, r"[^\p{L}\p{N}]+", " "))
        for a, b in EQUIVALENT:
            line = F.replace(line, F.lit(a), F.lit(b))
        return line

    return F.filter(F.transform(stated, even), lambda x: x != "")


def digest(lines: Column) -> Column:
    return F.sha2(F.array_join(lines, " "), 256)


def digests(known: DataFrame) -> DataFrame:
    """``(digest, license)``: one row per digest of the entire known texts."""
    lines = canonical_lines(F.col("text"))
    found = known.where(F.size(lines) > 0).select(digest(lines).alias("digest"), "license").groupBy("digest").agg(F.min("license").alias("license"))
    return F.broadcast(found) if known.count() <= BROADCAST_ROWS else found


def scan(docs: DataFrame, known: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, license, line_licenses)``: of the entire text, and of its lines (sorted)."""
    key = F.unhex(F.md5("text"))
    evened = docs.where("text is not null").select(key.alias("doc"), canonical_lines(F.col("text")).alias("lines")).where(F.size("lines") > 0)
    entire = F.array(F.struct(F.lit(True).alias("entire"), digest(F.col("lines")).alias("digest")))
    each = F.transform(F.array_distinct("lines"), lambda x: F.struct(F.lit(False).alias("entire"), F.sha2(x, 256).alias("digest")))
    met = evened.select("doc", F.explode(F.concat(entire, each)).alias("x")).select("doc", "x.entire", "x.digest").join(digests(known), "digest")
    licence = lambda of: F.when(F.col("entire") == of, F.col("license"))
    found = save(met.groupBy("doc").agg(F.min(licence(True)).alias("license"), F.array_sort(F.collect_set(licence(False))).alias("line_licenses")), "licences")
    all_docs = docs.select("doc_id", key.alias("doc")).join(found, "doc", "left")
    return all_docs.select("doc_id", "license", F.coalesce("line_licenses", F.array().cast("array<string>")).alias("line_licenses"))


def report(docs: DataFrame) -> DataFrame:
    """``(doc_id, license, n_line_licenses, line_licenses)``, the licences of lines comma-joined."""
    found = scan(docs, known_licences(docs.sparkSession))
    return found.select("doc_id", "license", F.size("line_licenses").cast("long").alias("n_line_licenses"), F.array_join("line_licenses", ",").alias("line_licenses"))


def _sql() -> str:
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    even = r"trim(regexp_replace(x, '[^\p{L}\p{N}]+', ' ', 'g'))"
    for a, b in EQUIVALENT:
        even = f"replace({even}, {quote(a)}, {quote(b)})"
    lines = f"list_filter(list_transform(list_filter(string_split(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), chr(10)), lambda x: NOT (regexp_matches(x, {quote(COPYRIGHT_LINE)}) AND NOT regexp_matches(x, {quote(TERMS_LINE)})) AND NOT regexp_matches(x, {quote(TITLE_LINE)})), lambda x: {even}), lambda x: x <> '')"
    rows = ", ".join(f"({quote(n)}, {quote(t)})" for n, t in KNOWN).replace("\n", "' || chr(10) || '")
    return f"""
WITH k AS (SELECT sha256(array_to_string(l, ' ')) AS digest, min(license) AS license FROM (SELECT license, {lines} AS l FROM (VALUES {rows}) AS v(license, text)) WHERE len(l) > 0 GROUP BY 1),
d AS (SELECT doc_id, {lines} AS l FROM documents),
m AS (SELECT doc_id, count(DISTINCT license) AS n, string_agg(DISTINCT license, ',' ORDER BY license) AS s
      FROM (SELECT doc_id, unnest(l) AS x FROM d) JOIN k ON sha256(x) = k.digest GROUP BY doc_id)
SELECT d.doc_id, k.license, CAST(coalesce(m.n, 0) AS BIGINT) AS n_line_licenses, coalesce(m.s, '') AS line_licenses
FROM d LEFT JOIN k ON len(d.l) > 0 AND sha256(array_to_string(d.l, ' ')) = k.digest LEFT JOIN m USING (doc_id)"""


SQL = _sql()
