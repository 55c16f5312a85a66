"""Corpus operators over ``(doc_id, text)``: term statistics, similarity joins, chunks."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crawlframe.functions.common import rnd, top_k
from crawlframe.functions.text import STOP_WORDS, all_of, in_list, words
from crawlframe.operators.graph import cut
from crawlframe.sources.shipping import ship


def term_arrays(docs: DataFrame, terms: Column, *keep: str) -> DataFrame:
    """``(doc_id, total, counted)`` and columns to keep: the different terms of each document as an array of ``(term, n, first)``.

    Terms are counted inside the row: sorted with their positions, equal ones lie side by side. Nothing is shuffled.
    """
    rows = docs.select("doc_id", *keep, terms.alias("t"))
    placed = F.sort_array(F.transform("t", lambda x, i: F.struct(x.alias("term"), i.alias("pos"))))
    rows = rows.select("doc_id", *keep, F.coalesce(F.size("t"), F.lit(0)).alias("total"), placed.alias("s"))
    fresh = lambda i: (i == 0) | (F.get("s", i)["term"] != F.get("s", i - 1)["term"])
    begins = F.when(F.col("total") > 0, F.filter(F.sequence(F.lit(0), F.col("total") - 1), fresh)).otherwise(F.array().cast("array<int>"))
    rows = rows.select("doc_id", *keep, "total", "s", begins.alias("b"))
    one = lambda i, k: F.struct(F.get("s", i)["term"].alias("term"), (F.coalesce(F.get("b", k + 1), F.col("total")) - i).cast("long").alias("n"), F.get("s", i)["pos"].alias("first"))
    return rows.select("doc_id", *keep, "total", F.transform("b", one).alias("counted"))


def term_counts(docs: DataFrame, terms: Column) -> DataFrame:
    """``(doc_id, term, n, first, total)``: occurrences of each term, its first position, and terms of the document."""
    # An inner explode lets Spark infer a filter on the array, which would work the array out a second time and worse.
    rows = term_arrays(docs, terms).select("doc_id", "total", F.explode_outer("counted").alias("c")).where("c is not null")
    return rows.select("doc_id", "c.term", "c.n", "c.first", "total")


#: The letters and digits of content tokens, which ``content_tokens`` lower-cases before it looks for them.
TOKEN_CHARS = "".join(chr(c) for a, b in ("AZ", "az", "АЯ", "ая", "09") for c in range(ord(a), ord(b) + 1))


def beginning_cosines(docs: DataFrame, length: Column, *keep: str) -> DataFrame:
    """``(doc_id, cosine)`` and columns to keep: of the counts of content tokens in a text and in its beginning of such a length.

    It is 0 where they share none. The text is cut before the token that the length may divide, and each part is looked through
    once: tokens before are in both, of that token's beginning in the beginning only, and of all behind in the text only. All
    are counted in one sorted array of the row, marked by signs that sort before letters and digits, so a token's counts are side
    by side. Nothing is shuffled.
    """
    head = F.lower(F.substr("text", F.lit(1), length))
    rows = docs.select("doc_id", *keep, head.alias("head"), F.lower(F.substr("text", length + 1)).alias("rest"))
    rows = rows.withColumn("whole", F.rtrim("head", F.lit(TOKEN_CHARS)))
    rows = rows.withColumn("divided", F.substr("head", F.length("whole") + 1))
    found = lambda text, mark: F.transform(lowered_tokens(text), lambda x: F.concat(x, F.lit(mark))) if mark else lowered_tokens(text)
    tokens = F.concat(found(F.col("whole"), ""), found(F.col("divided"), "*"), found(F.concat("divided", "rest"), "+"))
    rows = term_arrays(rows, tokens, *keep)
    zero = F.lit(0).cast("long")
    # (token, n in the text, n in the beginning) of an entry and what the two entries after it add, if they are of its token.
    told = lambda c: F.struct(F.rtrim(c["term"], F.lit("*+")).alias("t"), F.when(F.endswith(c["term"], F.lit("*")), zero).otherwise(c["n"]).alias("p"), F.when(F.endswith(c["term"], F.lit("+")), zero).otherwise(c["n"]).alias("q"))
    rows = rows.select("doc_id", *keep, F.transform("counted", told).alias("c"))
    add = lambda a, b: F.when(a["t"] == b["t"], F.struct(a["t"].alias("t"), (a["p"] + b["p"]).alias("p"), (a["q"] + b["q"]).alias("q"))).otherwise(a)
    behind = lambda n: F.slice("c", F.lit(n + 1), F.size("c"))
    rows = rows.withColumn("all", F.zip_with(F.zip_with("c", behind(1), add), behind(2), add))
    # Only the first entry of a token has all of it.
    first = F.zip_with("all", F.concat(F.array(F.lit("")), F.slice(F.col("c.t"), F.lit(1), F.greatest(F.lit(0), F.size("c") - 1))), lambda x, before: F.when(x["t"] != before, x))
    rows = rows.withColumn("first", F.filter(first, lambda x: x.isNotNull()))
    total = lambda a, b: F.aggregate("first", zero, lambda s, x: s + x[a] * x[b])
    rows = rows.select("doc_id", *keep, total("p", "q").alias("dot"), total("p", "p").alias("pp"), total("q", "q").alias("qq"))
    return rows.select("doc_id", *keep, F.when(F.col("dot") > 0, F.col("dot") / F.sqrt(F.col("pp").cast("double") * F.col("qq").cast("double"))).otherwise(0.0).alias("cosine"))


def most_frequent(counted: Column, k: int) -> Column:
    """The k terms with the most occurrences, earlier ones first of equals, as ``(n, first, term)``."""
    best = F.slice(F.sort_array(F.transform(counted, lambda x: F.struct((-x["n"]).alias("m"), x["first"].alias("first"), x["term"].alias("term")))), 1, k)
    return F.transform(best, lambda x: F.struct((-x["m"]).alias("n"), x["first"].alias("first"), x["term"].alias("term")))


def long_terms(text: Column, least: int = 4) -> Column:
    return F.filter(words(F.lower(text)), lambda x: F.length(x) >= least)


def document_frequencies(arrays: DataFrame, terms: str = "counted.term") -> DataFrame:
    """``(term, df)`` of ``term_arrays``, written once, so that joins with it can be broadcast or split by Spark."""
    return cut(arrays.select(F.explode(terms).alias("term")).groupBy("term").agg(F.count("*").alias("df")))


def tfidf(docs: DataFrame, frequent: int = 50, best: int = 10, common: int | None = None) -> DataFrame:
    """The best terms of each document among its most frequent, by tf * ln(N / df).

    Frequencies of common terms are sent to all tasks, so that a document's terms mostly stay in one place and only its best of
    these are shuffled; those of rare terms are joined.
    """
    arrays = term_arrays(docs, long_terms(F.col("text"))).select("doc_id", "total", F.col("counted.term").alias("terms"), most_frequent(F.col("counted"), frequent).alias("often"))
    arrays = cut(arrays)
    df = document_frequencies(arrays, "terms")
    n = arrays.agg(F.count("*").alias("docs"))
    often = arrays.select("doc_id", "total", F.explode("often").alias("o")).select("doc_id", "total", "o.*")
    known = F.broadcast(cut(_common(df, COMMON_TERMS if common is None else common)))
    met = often.join(known, "term").union(often.join(known, "term", "left_anti").join(df, "term"))
    scored = met.crossJoin(F.broadcast(n)).withColumn("raw", F.col("n") / F.col("total") * F.log(F.col("docs") / F.col("df")))
    scored = scored.where("raw > 0.0001").withColumn("score", rnd(F.col("raw"), 6))
    return top_k(scored, ["doc_id"], [F.desc("score"), F.desc("n"), F.asc("first")], best).select("doc_id", "rank", "term", "score")


def top_terms(docs: DataFrame, terms: Column, n: int, k: int) -> DataFrame:
    """The most frequent n-grams of each document's terms, with their share in percent; ties by first occurrence."""
    grams, size = F.col("t"), F.size("t")
    for i in range(1, n):  # zipped with itself moved by i, so no lambda holds the array
        grams = F.zip_with(grams, F.slice("t", F.lit(i + 1), F.greatest(F.lit(0), size - i)), lambda x, y: F.concat_ws(" ", x, y))
    grams = F.slice(grams, F.lit(1), F.greatest(F.lit(0), size - (n - 1)))
    based = docs.select("doc_id", terms.alias("t")).select("doc_id", "t", grams.alias("g"))
    best = term_arrays(based, F.col("g")).select("doc_id", "total", F.posexplode_outer(most_frequent(F.col("counted"), k)).alias("pos", "o")).where("o is not null")
    return best.select("doc_id", (F.col("pos") + 1).alias("rank"), "o.term", F.col("o.n").alias("count"), rnd(F.col("o.n") / F.col("total") * 100.0, 3).alias("pct"))


#: Frequent terms of a document up to which sets of them are looked for.
LISTED_TERMS = 12


def _named(terms: Column) -> Column:
    return F.unhex(F.md5(F.array_join(terms, "\u0001")))


def _frequent_sets(classes: DataFrame, rare: int) -> tuple[DataFrame, DataFrame]:
    """Two frames ``(cid, key, size)``: sets of ``often`` terms of more than ``rare`` documents, and the smallest ones of fewer.

    Sets grow by one term a round, where all sets of one term less are frequent; one that is not grows no further. A set is a
    bit mask over the class's terms. Sets of a single class are left out.
    """
    bits = F.transform("often", lambda x, i: F.pow(F.lit(2), i).cast("long"))
    known = lambda s: F.forall("bits", lambda b: (s.bitwiseAND(b) == 0) | F.array_contains("masks", s - b))
    grown = F.flatten(F.transform("masks", lambda m: F.transform(F.filter("bits", lambda b: (b > m) & known(m + b)), lambda b: m + b)))
    key = _named(F.filter("often", lambda x, i: F.getbit("m", i) == 1))
    classes = classes.select("cid", "n", "often", bits.alias("bits"))
    front, size, levels = classes.select("cid", "n", "often", F.explode("bits").alias("m")), 1, []
    while True:
        front = cut(front.select("cid", "n", "m", key.alias("key")))
        if not front.limit(1).count():
            break
        held = front.groupBy("key").agg(F.sum("n").alias("docs"), F.count("*").alias("classes")).where("classes > 1").select("key", "docs")
        found = cut(front.join(held, "key").select("cid", "key", "m", F.lit(size).alias("size"), (F.col("docs") > rare).alias("frequent")))
        levels.append(found)
        front = classes.join(found.where("frequent").groupBy("cid").agg(F.collect_list("m").alias("masks")), "cid").select("cid", "n", "often", F.explode(grown).alias("m"))
        size += 1
    every = reduce(DataFrame.union, levels) if levels else classes.select("cid", F.lit(b"").alias("key"), F.lit(0).alias("m"), F.lit(0).alias("size"), F.lit(False).alias("frequent")).limit(0)
    return tuple(every.where(c).select("cid", "key", "size") for c in ("frequent", "not frequent"))


def _shared(own: Column, others: Column, least: Column, k: int) -> Column:
    """The k best ids of ``others(ids, terms)`` as ``(less, id, anchor)`` by terms shared with ``own``, from ``least`` on."""
    met = F.transform(others, lambda o: F.struct(o["ids"].alias("ids"), F.array_intersect(own, o["terms"]).alias("both")))
    met = F.transform(F.filter(met, lambda p: F.size(p["both"]) >= least), lambda p: F.struct(p["ids"].alias("ids"), (-F.size(p["both"])).alias("less"), F.array_min(p["both"]).alias("anchor")))
    return F.slice(F.sort_array(F.flatten(F.transform(met, lambda p: F.transform(p["ids"], lambda i: F.struct(p["less"].alias("less"), i.alias("id"), p["anchor"].alias("anchor")))))), 1, k)


def semantic_links(terms: DataFrame, k: int = 20, rare: int = 50, listed: int = LISTED_TERMS) -> DataFrame:
    """Pairs of documents that share terms of ``terms(doc_id, term)``; the k with the most for each, lower ids first of equals.

    Exact without all pairs of a frequent term. Documents with the same terms are one class, of which the k + 1 lowest ids count.
    Classes meet in groups of at most ``rare`` documents: by a rare term, or by the smallest sets of frequent terms that so few
    hold. What else could be among a class's k best shares a set that more hold. Its largest such sets say how many terms the k
    best share at least, so these sets alone are looked up, in lists of the k + 1 lowest ids, and whatever shares less is left
    out where it is met. No pairs are shuffled, but each class's k + 1 best of a group. Documents with more than ``listed``
    frequent terms are counted against all that share one of these, in sums by pair, since their sets would be too many.
    """
    rare = max(rare, k)
    t = cut(terms.select("doc_id", "term").distinct())
    df = cut(t.groupBy("term").agg(F.count("*").alias("df")).where("df > 1"))
    t = t.join(df, "term")
    sets = t.groupBy("doc_id").agg(F.array_sort(F.collect_list("term")).alias("terms"), F.array_sort(F.collect_list(F.when(F.col("df") > rare, F.col("term")))).alias("often"))
    sets = cut(sets.withColumn("name", _named(F.col("terms"))))
    lowest = top_k(sets.select("name", "doc_id"), ["name"], [F.asc("doc_id")], k + 1).groupBy("name").agg(F.array_sort(F.collect_list("doc_id")).alias("ids"))
    alike = sets.groupBy("name").agg(F.min("doc_id").alias("cid"), F.count("*").alias("n"))
    classes = alike.join(lowest, "name").join(sets.select(F.col("doc_id").alias("cid"), "terms", "often"), "cid")
    classes = cut(classes.withColumn("rares", F.array_except("terms", "often")))
    frequent, few = _frequent_sets(classes.where(F.size("often") <= listed), rare)
    least = frequent.groupBy("cid").agg(F.max("size").alias("least"))
    asked = cut(frequent.join(least, "cid").where("size = least").select("cid", "key"))
    classes = cut(classes.join(least, "cid", "left").withColumn("least", F.coalesce("least", F.lit(1))))

    member = F.struct("cid", "ids", "terms", "rares", "least", "by")
    grouped = classes.withColumn("by", F.explode("rares")).select(_named(F.array("by")).alias("key"), member.alias("c"))
    grouped = grouped.union(few.join(classes, "cid").withColumn("by", F.lit(None).cast("string")).select("key", member.alias("c")))
    # Two classes meet by the first rare term that they share; by frequent ones only where they share no rare one.
    first = lambda a, b: F.when(a["by"].isNull(), ~F.arrays_overlap(a["rares"], b["rares"])).otherwise(F.array_min(F.array_intersect(a["rares"], b["rares"])) == a["by"])
    grouped = grouped.groupBy("key").agg(F.collect_list("c").alias("g")).where(F.size("g") > 1)
    met = lambda a: _shared(a["terms"], F.filter("g", lambda b: (b["cid"] != a["cid"]) & first(a, b)), a["least"], k + 1)
    near = grouped.select(F.explode(F.transform("g", lambda a: F.struct(a["cid"].alias("cid"), met(a).alias("best")))).alias("r")).select("r.cid", "r.best")

    holders = frequent.select("cid", "key").join(asked.select("key").distinct(), "key", "left_semi")
    lists = top_k(holders, ["key"], [F.asc("cid")], k + 1).join(classes.select("cid", "ids", "terms"), "cid")
    lists = cut(lists.groupBy("key").agg(F.collect_list(F.struct("ids", "terms")).alias("others")))
    far = cut(asked.join(classes.select("cid", "terms", "least"), "cid")).join(lists, "key")
    far = far.select("cid", _shared(F.col("terms"), F.col("others"), F.col("least"), k + 1).alias("best"))

    own = classes.select("cid", _shared(F.col("terms"), F.array(F.struct("ids", "terms")), F.lit(1), k + 1).alias("best"))
    best = near.union(far).where(F.size("best") > 0).union(own)
    best = best.groupBy("cid").agg(F.sort_array(F.flatten(F.collect_list("best"))).alias("best"))
    once = F.zip_with("best", F.slice("best", F.lit(2), F.size("best")), lambda x, y: F.when(y.isNull() | (x != y), x))
    best = cut(best.select("cid", F.slice(F.filter(once, lambda x: x.isNotNull()), 1, k + 1).alias("best")))
    of = cut(sets.select("doc_id", "name").join(alike.select("name", "cid"), "name").select(F.col("doc_id").alias("src"), "cid"))
    others = F.slice(F.filter("best", lambda b: b["id"] != F.col("src")), 1, k)
    found = of.join(best, "cid").select("src", F.posexplode(others).alias("pos", "b"))
    found = found.select("src", F.col("b.id").alias("dst"), (-F.col("b.less")).cast("long").alias("relevance"), F.col("b.anchor").alias("suggested_anchor"), (F.col("pos") + 1).alias("rank"))
    many = cut(sets.where(F.size("often") > listed).select("doc_id", F.explode("often").alias("term")))
    if not many.limit(1).count():
        return found
    often = sets.select(F.col("doc_id").alias("b"), F.explode("often").alias("term"))
    met = cut(many.select(F.col("doc_id").alias("a"), "term").join(often, "term").where("a <> b").groupBy("a", "b").agg(F.count("*").alias("n")))
    # Either of the two may be the one whose best are asked for.
    pairs = [top_k(met.select(F.col(x).alias("src"), F.col(y).alias("dst"), "n"), ["src"], [F.desc("n"), F.asc("dst")], k).select("src", "dst") for x, y in (("a", "b"), ("b", "a"))]
    both = pairs[0].union(pairs[1]).distinct().join(sets.select(F.col("doc_id").alias("src"), F.col("terms").alias("a")), "src").join(sets.select(F.col("doc_id").alias("dst"), F.col("terms").alias("b")), "dst")
    shared = F.array_intersect("a", "b")
    more = both.select("src", "dst", F.size(shared).cast("long").alias("relevance"), F.array_min(shared).alias("suggested_anchor"))
    return top_k(found.drop("rank").union(more).distinct(), ["src"], [F.desc("relevance"), F.asc("dst")], k)


def topic_labels(links: DataFrame, terms: DataFrame, docs: DataFrame, hub_links: int = 3) -> DataFrame:
    """``(doc_id, topic_label, topic_hub)``: the first term shared with the best link, else the best own term, else ``misc``."""
    by_link = links.groupBy(F.col("src").alias("doc_id")).agg(F.count("*").alias("n"), F.min_by("suggested_anchor", "rank").alias("anchor"))
    own = terms.where("rank = 1").select("doc_id", F.col("term").alias("own"))
    j = docs.select("doc_id").join(by_link, "doc_id", "left").join(own, "doc_id", "left")
    return j.select("doc_id", F.coalesce("anchor", "own", F.lit("misc")).alias("topic_label"), (F.coalesce("n", F.lit(0)) >= hub_links).alias("topic_hub"))


def simhash(docs: DataFrame) -> DataFrame:
    """``(doc_id, simhash, n_words)``: 64-bit similarity hash of the words of three characters and more."""
    content = F.filter(long_terms(F.col("text"), 3), lambda x: ~in_list(x, STOP_WORDS))
    counts = term_counts(docs, content)
    bits = F.conv(F.substring(F.md5("term"), 1, 16), 16, -10).cast("long")
    votes = [F.sum(F.when(F.getbit("h", F.lit(i)) == 1, F.col("n")).otherwise(-F.col("n"))).alias(f"v{i}") for i in range(64)]
    summed = counts.select("doc_id", "n", bits.alias("h")).groupBy("doc_id").agg(*votes)
    value = F.lit(0).cast("long")
    for i in range(64):
        value = value.bitwiseOR(F.when(F.col(f"v{i}") >= 0, F.shiftleft(F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    hashes = summed.select("doc_id", value.alias("simhash"))
    return docs.select("doc_id", F.size(F.split(F.trim("text"), r"\s+")).alias("n_words")).join(hashes, "doc_id", "left").withColumn("simhash", F.coalesce("simhash", F.lit(0).cast("long")))


def _near_hashes(distinct: DataFrame, most: int, blocks: int) -> DataFrame:
    """``(a, b, ca, cb, distance)``: pairs of ``distinct(doc_id, simhash, copies)`` within a Hamming distance, each once.

    The hash is cut into blocks; two hashes within the distance agree on blocks - most of them at least, so an equi-join on
    every choice of that many blocks finds all pairs. A pair is taken at the first blocks that it agrees on and at no other
    choice, so that pairs need not be shuffled to make them distinct: what is shuffled grows with the hashes alone.
    """
    edges = [64 * i // blocks for i in range(blocks + 1)]
    spans = list(zip(edges, edges[1:], strict=False))
    part = lambda x, lo, hi: F.shiftrightunsigned(x, lo).bitwiseAND(F.lit((1 << hi - lo) - 1).cast("long"))

    def choice(chosen: tuple[int, ...]) -> Column:
        # Named by the blocks before its last one that it leaves out: a pair that agrees on one of these was found by another choice.
        left_out, bits = sum(1 << i for i in range(chosen[-1]) if i not in chosen), F.lit(0).cast("long")
        for lo, hi in (spans[i] for i in chosen):
            bits = F.shiftleft(bits, hi - lo).bitwiseOR(part(F.col("simhash"), lo, hi))
        return F.struct(F.lit(left_out).alias("left_out"), bits.alias("bits"))

    keyed = distinct.select("simhash", "doc_id", "copies", F.explode(F.array(*[choice(c) for c in combinations(range(blocks), blocks - most)])).alias("k"))
    a, b = (keyed.select("k.left_out", "k.bits", F.col("doc_id").alias(x), F.col("simhash").alias(f"h{x}"), F.col("copies").alias(f"c{x}")) for x in "ab")
    differ = F.col("ha").bitwiseXOR(F.col("hb"))
    # Spark does not see that a hash is a row for each choice, takes the keys for a small table and sends them to all by the driver.
    found = a.hint("merge").join(b, ["left_out", "bits"]).where((F.col("a") < F.col("b")) & (F.bit_count(differ) <= most))
    for i, (lo, hi) in enumerate(spans[:-1]):
        found = found.where((F.col("left_out").bitwiseAND(F.lit(1 << i)) == 0) | (part(differ, lo, hi) != 0))
    return found.select("a", "b", "ca", "cb", F.bit_count(differ).cast("int").alias("distance"))


def _different(hashes: DataFrame) -> DataFrame:
    return hashes.groupBy("simhash").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


def hamming_pairs(hashes: DataFrame, most: int = 6, blocks: int = 9) -> DataFrame:
    """Pairs of ``(doc_id, simhash)`` within a Hamming distance, as pairs of different hashes and ``(a, b, distance)``."""
    return _near_hashes(_different(hashes), most, blocks).select("a", "b", "distance")


def hamming_neighbours(hashes: DataFrame, most: int = 6, blocks: int = 9) -> DataFrame:
    """``(doc_id, copies, neighbours)`` of each different hash: rows that have it, and other rows within the distance.

    Copies are added up where the pairs are found, so no pairs are shuffled.
    """
    k = _different(hashes)
    ends = F.array(F.struct(F.col("a").alias("doc_id"), F.col("cb").alias("c")), F.struct(F.col("b").alias("doc_id"), F.col("ca").alias("c")))
    near = _near_hashes(k, most, blocks).select(F.explode(ends).alias("e")).groupBy("e.doc_id").agg(F.sum("e.c").alias("near"))
    return k.join(near, "doc_id", "left").select("doc_id", "copies", (F.col("copies") - 1 + F.coalesce("near", F.lit(0))).alias("neighbours"))


def chunks(docs: DataFrame, size: int = 1200, overlap: int = 100, most: int | None = None) -> DataFrame:
    """``(doc_id, idx, chunk)``: windows of a text, each once; all of them, or the first ``most``."""
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("text") - overlap), F.lit(size - overlap))
    starts = starts if most is None else F.slice(starts, 1, most)
    rows = docs.where("text is not null and text <> ''").select("doc_id", "text", F.posexplode(starts).alias("pos", "at"))
    return rows.select("doc_id", (F.col("pos") + 1).alias("idx"), F.col("text").substr(F.col("at"), F.lit(size)).alias("chunk"))


def content_tokens(text: Column) -> Column:
    return lowered_tokens(F.lower(text))


def lowered_tokens(text: Column) -> Column:
    return F.filter(all_of(text, "[A-Za-zА-Яа-я0-9]{3,}"), lambda x: ~in_list(x, STOP_WORDS))


def chunk_duplicates(chunked: DataFrame, threshold: float = 0.9, back: int = 8) -> DataFrame:
    """``(doc_id, idx, duplicate)``: equal to an earlier chunk of the document, or similar to one of the few before it."""
    c = chunked.select("doc_id", "idx", content_tokens(F.col("chunk")).alias("t"))
    c = c.select("doc_id", "idx", F.array_distinct("t").alias("t"), F.xxhash64("t").alias("norm"))
    exact = F.row_number().over(Window.partitionBy("doc_id", "norm").orderBy("idx")) > 1
    c = c.withColumn("exact", exact)
    a, b = c.alias("a"), c.alias("b")
    both = F.size(F.array_intersect("a.t", "b.t")) / F.size(F.array_union("a.t", "b.t"))
    near = a.join(b, (F.col("a.doc_id") == F.col("b.doc_id")) & F.col("b.idx").between(F.col("a.idx") - back, F.col("a.idx") - 1)).where((F.size("a.t") > 0) & (F.size("b.t") > 0) & (both >= threshold))
    near = near.select(F.col("a.doc_id").alias("doc_id"), F.col("a.idx").alias("idx")).distinct().withColumn("near", F.lit(True))
    return c.join(near, ["doc_id", "idx"], "left").select("doc_id", "idx", (F.col("exact") | F.coalesce("near", F.lit(False))).alias("duplicate"))


def survivors(chunked: DataFrame, budgets: tuple[int, ...] = (512, 1024, 2048)) -> DataFrame:
    """How many whole chunks of each document fit its first tokens, per budget."""
    sized = chunked.withColumn("tokens", F.size(F.filter(F.split(F.trim("chunk"), r"\s+"), lambda x: x != "")))
    running = F.sum("tokens").over(Window.partitionBy("doc_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0))
    return sized.withColumn("run", running).groupBy("doc_id").agg(F.count("*").alias("chunks"), *[F.count_if(F.col("run") <= b).alias(f"survive_{b}") for b in budgets])


def cosine_join(left: DataFrame, right: DataFrame, tf_idf: bool = False) -> DataFrame:
    """``(a, b, dot, cosine)`` of documents ``left`` with ``right`` that share a content token, by term weights."""
    l, r = (cut(term_arrays(x, content_tokens(F.col("text")))) for x in (left, right))
    rows = [x.select("doc_id", F.explode("counted").alias("c")).select("doc_id", "c.term", F.col("c.n").cast("double").alias("w")) for x in (l, r)]
    if tf_idf:
        df = document_frequencies(r)
        n = F.broadcast(r.agg(F.count("*").alias("docs")))
        idf = F.log((F.col("docs") + 1) / (F.coalesce("df", F.lit(0)) + 1)) + 1.0
        rows = [cut(x.join(df, "term", "left").crossJoin(n).select("doc_id", "term", (F.col("w") * idf).alias("w"))) for x in rows]
    l, r = rows
    nl, nr = (x.groupBy("doc_id").agg(F.sum(F.col("w") * F.col("w")).alias("q")) for x in (l, r))
    dots = l.select(F.col("doc_id").alias("a"), "term", F.col("w").alias("wa")).join(r.select(F.col("doc_id").alias("b"), "term", F.col("w").alias("wb")), "term").groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("dot"))
    joined = dots.join(nl.select(F.col("doc_id").alias("a"), F.col("q").alias("qa")), "a").join(nr.select(F.col("doc_id").alias("b"), F.col("q").alias("qb")), "b")
    return joined.select("a", "b", "dot", (F.col("dot") / F.sqrt(F.col("qa") * F.col("qb"))).alias("cosine"))


#: Different (item, term) pairs whose weights are sent to all tasks at most: some 100 MB.
ITEM_TERMS = 4_000_000
#: Terms whose weights are sent to all tasks at most, so that not every occurrence of a common term is shuffled.
COMMON_TERMS = 200_000
#: Products of weights, and places for their sums, that a task works out at once: some 100 MB.
AT_ONCE = 2_000_000


def _common(df: DataFrame, most: int) -> DataFrame:
    """The terms of ``df(term, df)`` that the most documents have: whole powers of two of ``df``, of ``most`` terms in all at most."""
    power = F.floor(F.log2(F.col("df").cast("double")))
    of, least = {r["p"]: r["n"] for r in df.groupBy(power.alias("p")).agg(F.count("*").alias("n")).collect()}, None
    for p in sorted(of, reverse=True):
        if (most := most - of[p]) < 0:
            break
        least = p
    return df.where(power >= least) if least is not None else df.limit(0)


def _encoded(arrays: DataFrame, known: dict[str, np.ndarray], keys: list[str], more: list[str]) -> DataFrame:
    """``(keys, more, q, places, w)`` of the documents with an asked term: its place and weight, for each.

    ``known(term, idf, place, sums, rest)`` are terms with the place of those that are asked for (else -1). The squared weights of
    terms where ``sums`` holds, and of all others with the weight ``rest``, are added up in q. Terms are looked up for whole batches, in the rows where they stand.
    """
    table = arrays.sparkSession.sparkContext.broadcast(known)
    rows = arrays.select(*keys, *more, F.col("counted.term").alias("terms"), F.col("counted.n").alias("n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = table.value
        terms = pa.array(known["term"], pa.string())
        # Unknown terms come last.
        idf, place = np.append(known["idf"], known["rest"]), np.append(known["place"], -1)
        sums = np.append(np.where(known["sums"], known["idf"] ** 2, 0.0), known["rest"] ** 2)
        for batch in batches:
            flat = batch.column("terms").flatten()
            at = pc.fill_null(pc.index_in(flat, value_set=terms.cast(flat.type)), len(terms)).to_numpy(zero_copy_only=False)
            n = batch.column("n").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            row = np.repeat(np.arange(len(batch)), pc.fill_null(pc.list_value_length(batch.column("terms")), 0).to_numpy(zero_copy_only=False))
            q = np.bincount(row, n * n * sums[at], len(batch))
            asked = place[at] >= 0
            sizes = np.bincount(row[asked], minlength=len(batch))
            has = sizes > 0
            ends = pa.array(np.append(0, np.cumsum(sizes[has])).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (place[at[asked]].astype(np.int32), n[asked] * idf[at[asked]])]
            kept = batch.filter(pa.array(has))
            yield pa.RecordBatch.from_arrays([*(kept.column(c) for c in (*keys, *more)), pa.array(q[has]), *lists], [*keys, *more, "q", "places", "w"])

    return rows.mapInArrow(run, ", ".join([*(f"{c} long" for c in keys), *(f"{c} double" for c in more), "q double, places array<int>, w array<double>"]))


def best_matches(items: DataFrame, docs: DataFrame, k: int, tf_idf: bool = False, share: float = 1.0, digits: int | None = None, common: int = COMMON_TERMS) -> DataFrame:
    """``(a, b, score, rank, scored)``: for each of ``items(doc_id, text)`` the k documents of ``docs`` with the highest score.

    The score is ``(share * cosine + bonus) * factor``, where ``docs(doc_id, text, bonus, factor)`` has these, rounded to so
    many digits; lower ids first of equals. Where ``docs`` has its content ``tokens`` already, texts are not cut again. Documents
    that share no term with an item are no candidates. Items are a small set: their weights go to every task as postings by
    term, products are added up for blocks of documents at once, and each task hands on its k best of an item only, so no pairs
    are shuffled, and of the documents' terms only those that items have and rare ones. A document is left out early where its
    terms' greatest weights cannot bring it among the k best that a task has. ``scored`` counts a task's documents that were
    scored for the item.
    """
    more = [c for c in ("bonus", "factor") if c in docs.columns]
    tokens = F.col("tokens") if "tokens" in docs.columns else content_tokens(F.col("text"))
    arrays = cut(term_arrays(docs, tokens, *more).drop("total"))
    left = term_arrays(items, content_tokens(F.col("text"))).select("doc_id", F.explode_outer("counted").alias("c")).where("c is not null")
    left, idf = left.select("doc_id", "c.term", F.col("c.n").cast("double").alias("n")), F.lit(1.0)
    if tf_idf:
        df = document_frequencies(arrays)
        idf = F.log((F.lit(arrays.count()) + 1) / (F.coalesce("df", F.lit(0)) + 1)) + 1.0
        left = left.join(df, "term", "left")
    left = cut(left.select("doc_id", "term", (F.col("n") * idf).alias("w"), idf.alias("idf")))
    if (size := left.count()) > ITEM_TERMS:
        raise ValueError(f"{size} terms of items; ask for at most {ITEM_TERMS} at once")
    given = left.toPandas().sort_values(["term", "doc_id"])
    ids = np.unique(given["doc_id"].to_numpy(np.int64))
    at = np.searchsorted(ids, given["doc_id"].to_numpy(np.int64))
    norms = np.sqrt(np.bincount(at, given["w"].to_numpy() ** 2, len(ids)))
    terms, starts = np.unique(given["term"].to_numpy(str), return_index=True)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((ids, np.append(starts, len(given)), at.astype(np.int32), given["w"].to_numpy() / norms[at]))
    asked = pd.DataFrame({"term": terms.astype(object), "place": np.arange(len(terms), dtype=np.int64), "idf": given["idf"].to_numpy()[starts]}).set_index("term")
    kind = docs.schema["doc_id"].dataType
    flat = kind.simpleString().startswith("struct")
    fields = [f"doc_id.{f.name}" for f in kind.fields] if flat else ["doc_id"]
    keys = [f"k{i}" for i in range(len(fields))]
    arrays = arrays.select(*[F.col(f).cast("long").alias(c) for f, c in zip(fields, keys, strict=True)], *[F.col(c).cast("double").alias(c) for c in more], "counted")
    ship(spark)
    known, rest = asked.assign(sums=not tf_idf), 1.0
    if tf_idf:
        often = cut(_common(df, common).select("term", idf.alias("idf")))
        known, rest = often.toPandas().set_index("term").assign(sums=True).join(asked["place"], how="left"), 0.0
        more_asked = asked[~asked.index.isin(known.index)].assign(sums=False)
        known = pd.concat([known.assign(place=known["place"].fillna(-1).astype(np.int64)), more_asked])
    known = {"term": known.index.to_numpy(object), **{c: known[c].to_numpy(kind) for c, kind in (("idf", float), ("place", np.int64), ("sums", bool))}, "rest": rest}
    held = _encoded(arrays, known, keys, more)
    if tf_idf:
        # Of the other terms, which few documents have, occurrences are joined with their frequencies.
        rare = arrays.select(*keys, F.explode("counted").alias("c")).select(*keys, "c.term", F.col("c.n").cast("double").alias("n")).join(F.broadcast(often), "term", "left_anti").join(df, "term")
        rare = rare.groupBy(*keys).agg(F.sum(F.col("n") * idf * F.col("n") * idf).alias("rare"))
        held = held.join(rare, keys, "left").withColumn("q", F.col("q") + F.coalesce("rare", F.lit(0.0))).drop("rare")
    held = held.select(*keys, *more, F.sqrt("q").alias("norm"), "places", "w")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, starts, at, weights = shared.value
        most, postings, n = np.maximum.reduceat(weights, starts[:-1]) if len(weights) else weights, np.diff(starts), len(ids)
        best: list[list[tuple]] = [[] for _ in ids]
        margin = 10.0**-digits if digits is not None else 1e-9
        floor, scored = np.full(n, -np.inf), np.zeros(n, np.int64)
        for batch in batches:
            if not len(batch):
                continue
            known = batch[keys].to_numpy(np.int64)
            plus = batch["bonus"].to_numpy() if "bonus" in batch else np.zeros(len(batch))
            times = batch["factor"].to_numpy() if "factor" in batch else np.ones(len(batch))
            sizes = batch["places"].map(len).to_numpy()
            ends = np.cumsum(sizes)
            places = np.concatenate(batch["places"].to_list())
            w = np.concatenate(batch["w"].to_list()) / np.repeat(batch["norm"].to_numpy(), sizes)
            # No item's product can be greater than this.
            bound = (share * np.minimum(1.0, np.add.reduceat(w * most[places], ends - sizes)) + plus) * times + margin
            block = np.cumsum(np.add.reduceat(postings[places], ends - sizes) + n) // AT_ONCE
            for rows in np.split(np.arange(len(batch)), np.flatnonzero(np.diff(block)) + 1):
                rows = rows[bound[rows] >= floor.min()]
                if not len(rows):
                    continue
                # The rows' (row, term) entries, and of each of them its term's postings.
                entry = np.repeat(ends[rows] - np.cumsum(sizes[rows]), sizes[rows]) + np.arange(sizes[rows].sum())
                owner, p = np.repeat(np.arange(len(rows)), sizes[rows]), places[entry]
                m = postings[p]
                index = np.repeat(starts[p] - (np.cumsum(m) - m), m) + np.arange(m.sum())
                dots = np.bincount(np.repeat(owner, m) * n + at[index], weights[index] * np.repeat(w[entry], m), len(rows) * n).reshape(len(rows), n)
                score = (share * dots + plus[rows, None]) * times[rows, None]
                if digits is not None:
                    score = np.floor(score * 10.0**digits + 0.5) / 10.0**digits
                hit = dots > 0
                scored += hit.sum(0)
                near = hit & (score >= floor)
                if len(rows) > k:
                    score[~hit] = -np.inf
                    near &= score >= np.partition(score, len(rows) - k, axis=0)[len(rows) - k]
                for r, i in zip(*(x.tolist() for x in np.nonzero(near)), strict=True):
                    if score[r, i] < floor[i]:
                        continue
                    mine = best[i]
                    mine.append((-float(score[r, i]), tuple(known[rows[r]].tolist())))
                    if len(mine) > k:
                        mine.sort()
                        mine.pop()
                        floor[i] = -mine[-1][0]
        rows = [(int(ids[i]), *key, -s, int(scored[i])) for i, mine in enumerate(best) for s, key in mine]
        yield pd.DataFrame(rows, columns=["a", *keys, "score", "scored"])

    found = held.mapInPandas(run, f"a long, {', '.join(f'{c} long' for c in keys)}, score double, scored long")
    b = F.struct(*[F.col(c).cast(f.dataType).alias(f.name) for c, f in zip(keys, kind.fields, strict=True)]) if flat else F.col("k0")
    found = cut(found.select("a", b.alias("b"), "score", "scored"))
    return top_k(found, ["a"], [F.desc("score"), F.asc("b")], k)
