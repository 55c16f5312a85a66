"""Queries over documents, benchmark and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlframe.functions import text as T
from crawlframe.functions.common import clamp, over_the_cluster, pct, pct_sql, rnd, rnd_sql, top_k
from crawlframe.operators import corpus
from crawlframe.operators.graph import cut
from crawlframe.plans.registry import query, table


def _list(values) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


def _words(x: str) -> str:
    return rf"list_filter(regexp_extract_all({x}, '{T.RUN}'), lambda w: regexp_matches(w, '{T.PLAIN}'))"


def _sentences(x: str) -> str:
    return rf"list_filter(string_split_regex({x}, '[.!?]+'), lambda s: regexp_matches(s, '\S'))"


def _len(x: str) -> str:
    return f"coalesce(list_sum(list_transform({x}, lambda y: length(y))), 0)"


def _ratio(a: str, b: str) -> str:
    return f"(CAST({a} AS DOUBLE) / greatest(1, CAST({b} AS DOUBLE)))"


def _clamp(x: str) -> str:
    return f"greatest(0.0, least(100.0, {x}))"


def _tokens(x: str) -> str:
    return f"list_filter(regexp_extract_all(lower({x}), '[a-zA-ZЀ-ӿ0-9]{{3,}}'), lambda w: w NOT IN {_list(T.STOP_WORDS)})"


def _occurrences(x: str, phrases) -> str:
    return "(" + " + ".join(f"(length({x}) - length(replace({x}, {_list([p])[1:-1]}, ''))) // {len(p)}" for p in phrases) + ")"


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return over_the_cluster(table(spark, sf_dir, "documents"))


@query(
    f"""SELECT doc_id, len(t) AS n_tokens, len(list_distinct(t)) AS n_distinct, len(w) AS n_words
FROM (SELECT doc_id, {_tokens("text")} AS t, {_words("text")} AS w FROM documents)"""
)
def h1_tokenise(spark, sf_dir):
    """Tokens and words of each document."""
    t = docs(spark, sf_dir).select("doc_id", T.tokens(F.col("text")).alias("t"), T.words(F.col("text")).alias("w"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"), F.size("w").cast("long").alias("n_words"))


_PER_SENTENCE, _PER_WORD = _ratio("len(w)", "len(s)"), _ratio(_len("w"), "len(w)")


@query(
    f"""SELECT doc_id,
 CASE WHEN len(w) = 0 THEN 0.0 ELSE {rnd_sql(_clamp(f"100.0 - greatest(0.0, ({_PER_SENTENCE} - 14.0) * 2.2) - greatest(0.0, ({_PER_WORD} - 5.5) * 8.0)"), 1)} END AS readability,
 CASE WHEN len(w) = 0 THEN 0.0 ELSE {rnd_sql(_PER_SENTENCE, 2)} END AS avg_sentence_length,
 CASE WHEN len(w) = 0 THEN 0.0 ELSE {rnd_sql(_PER_WORD, 2)} END AS avg_word_length,
 {pct_sql("len(list_filter(w, lambda x: length(x) >= 8))", "len(w)")} AS complex_pct,
 {rnd_sql(_ratio("len(list_distinct(list_transform(w, lambda x: lower(x))))", "len(w)"), 4)} AS lexical_diversity
FROM (SELECT doc_id, {_words("text")} AS w, {_sentences("text")} AS s FROM documents)"""
)
def h2_readability(spark, sf_dir):
    """Length and readability features."""
    d = docs(spark, sf_dir).select("doc_id", T.words(F.col("text")).alias("w"), T.sentences(F.col("text")).alias("s"))
    n = F.size("w")
    none = lambda x: F.when(n == 0, 0.0).otherwise(x)
    return d.select(
        "doc_id",
        T.readability(F.col("w"), F.col("s")).alias("readability"),
        none(rnd(T.ratio(n, F.size("s")), 2)).alias("avg_sentence_length"),
        none(rnd(T.ratio(T.total_length(F.col("w")), n), 2)).alias("avg_word_length"),
        pct(F.size(F.filter("w", lambda x: F.length(x) >= 8)), n).alias("complex_pct"),
        rnd(T.ratio(F.size(F.array_distinct(F.transform("w", F.lower))), n), 4).alias("lexical_diversity"),
    )


_SYLLABLES = "coalesce(list_sum(list_transform(w, lambda x: greatest(1, len(regexp_extract_all(lower(x), '[aeiouyаеёиоуыэюя]+'))))), 0)"


@query(
    f"""SELECT doc_id, CASE WHEN len(w) = 0 THEN 0.0 ELSE {rnd_sql(_clamp(f"206.835 - 1.015 * {_ratio('len(w)', 'greatest(1, len(s))')} - 84.6 * {_ratio(_SYLLABLES, 'len(w)')}"), 2)} END AS flesch
FROM (SELECT doc_id, regexp_extract_all(text, '[A-Za-zА-Яа-я0-9]+') AS w, {_sentences("text")} AS s FROM documents)"""
)
def h3_flesch(spark, sf_dir):
    """Reading ease."""
    return docs(spark, sf_dir).select("doc_id", T.flesch(F.col("text")).alias("flesch"))


@query(
    f"""SELECT doc_id, {pct_sql(f"len(list_filter(t, lambda x: x IN {_list(T.TOXIC_WORDS)}))", "len(t)")} AS toxic_pct,
 {rnd_sql(_ratio(f"len(list_filter(w, lambda x: x IN {_list(T.FILLER_WORDS)}))", "len(w)"), 4)} AS filler_ratio, l.toxic AS labelled_toxic
FROM (SELECT doc_id, {_tokens("text")} AS t, {_words("lower(text)")} AS w FROM documents) LEFT JOIN labels l USING (doc_id)"""
)
def h4_toxicity_filler(spark, sf_dir):
    """Shares of toxic and filler words, beside the label where there is one."""
    d = docs(spark, sf_dir).select("doc_id", T.tokens(F.col("text")).alias("t"), T.words(F.lower("text")).alias("w"))
    d = d.select("doc_id", pct(F.size(F.filter("t", lambda x: T.in_list(x, T.TOXIC_WORDS))), F.size("t")).alias("toxic_pct"), rnd(T.ratio(F.size(F.filter("w", lambda x: T.in_list(x, T.FILLER_WORDS))), F.size("w")), 4).alias("filler_ratio"))
    return d.join(table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("labelled_toxic")), "doc_id", "left")


@query(
    rf"""WITH w AS (SELECT doc_id, unnest(list_filter(string_split_regex(trim(lower(text)), '\s+'), lambda x: x <> '')) AS x, len(list_filter(string_split_regex(trim(lower(text)), '\s+'), lambda x: x <> '')) AS n FROM documents),
f AS (SELECT doc_id, x, count(*) AS c FROM w WHERE n >= 50 AND regexp_matches(x, '^\p{{L}}{{4,}}$') AND x NOT IN {_list(T.STOP_WORDS)} GROUP BY 1, 2),
m AS (SELECT doc_id, max(c) AS c, sum(c) AS n FROM f GROUP BY doc_id)
SELECT doc_id, coalesce(CASE WHEN c * 100.0 / n > 3.0 THEN {rnd_sql("CAST(c AS DOUBLE) / CAST(n AS DOUBLE) * 100.0", 2)} ELSE 0.0 END, 0.0) AS stuffing FROM documents LEFT JOIN m USING (doc_id)"""
)
def h5_keyword_stuffing(spark, sf_dir):
    """Share of a document's most frequent content word where it is over 3 % of at least 50 words."""
    w = F.filter(F.split(F.trim(F.lower("text")), r"\s+"), lambda x: x != "")
    rows = docs(spark, sf_dir).select("doc_id", w.alias("w")).where(F.size("w") >= 50).select("doc_id", F.explode("w").alias("x"))
    rows = rows.where(F.col("x").rlike(r"^\p{L}{4,}$") & ~T.in_list(F.col("x"), T.STOP_WORDS))
    m = rows.groupBy("doc_id", "x").count().groupBy("doc_id").agg(F.max("count").alias("c"), F.sum("count").alias("n"))
    share = F.when(F.col("c") * 100.0 / F.col("n") > 3.0, rnd(F.col("c") / F.col("n") * 100.0, 2)).otherwise(0.0)
    return docs(spark, sf_dir).select("doc_id").join(m.select("doc_id", share.alias("stuffing")), "doc_id", "left").fillna(0.0, ["stuffing"])


_BOILER = " + ".join(f"len(regexp_extract_all(lower(text), '{p}'))" for p in T.BOILERPLATE)


@query(
    rf"""SELECT doc_id, CASE WHEN n = 0 THEN 0.0 ELSE {rnd_sql("least(100.0, CAST(m AS DOUBLE) / greatest(1.0, CAST(n AS DOUBLE)) * 100.0)", 1)} END AS boilerplate_pct,
 CASE WHEN len(w) = 0 THEN 0.0 ELSE {rnd_sql("CAST(len(list_distinct(w)) AS DOUBLE) / greatest(1.0, CAST(len(w) AS DOUBLE)) * 100.0", 1)} END AS unique_pct
FROM (SELECT doc_id, len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) AS n, {_BOILER} AS m,
 list_filter({_words("lower(text)")}, lambda x: length(x) > 2 AND x NOT IN {_list(T.STOP_WORDS)}) AS w FROM documents)"""
)
def h6_boilerplate_unique(spark, sf_dir):
    """Boilerplate phrases per word, and share of different content words."""
    low = F.lower("text")
    found = [F.size(T.all_of(low, p)) for p in T.BOILERPLATE]
    d = docs(spark, sf_dir).select("doc_id", F.size(F.filter(F.split("text", r"\s+", -1), lambda x: x != "")).alias("n"), sum(found[1:], found[0]).alias("m"), F.filter(T.words(low), lambda x: (F.length(x) > 2) & ~T.in_list(x, T.STOP_WORDS)).alias("w"))
    return d.select(
        "doc_id",
        F.when(F.col("n") == 0, 0.0).otherwise(rnd(F.least(F.lit(100.0), T.ratio(F.col("m"), F.col("n")) * 100.0), 1)).alias("boilerplate_pct"),
        F.when(F.size("w") == 0, 0.0).otherwise(rnd(T.ratio(F.size(F.array_distinct("w")), F.size("w")) * 100.0, 1)).alias("unique_pct"),
    )


_TECH = " + ".join(f"CAST(regexp_matches(lower(text), '(^|[^\\p{{L}}\\p{{N}}_]){m}([^\\p{{L}}\\p{{N}}_]|$)') AS INTEGER)" for m in T.TECH_MARKERS)
_PHRASES = " + ".join(f"CAST(contains(lower(text), {_list([m])[1:-1]}) AS INTEGER)" for m in T.AI_MARKERS)


@query(f"SELECT doc_id, CAST(n AS BIGINT) AS markers, {rnd_sql(_ratio('n * 1000.0', 'words'), 2)} AS markers_per_1k FROM (SELECT doc_id, {_TECH} + {_PHRASES} AS n, len({_words('text')}) AS words FROM documents)")
def h7_machine_markers(spark, sf_dir):
    """Different marker phrases and words that a text holds, and per thousand words."""
    low = F.lower("text")
    found = [T.has_word(low, m).cast("int") for m in T.TECH_MARKERS] + [F.contains(low, F.lit(m)).cast("int") for m in T.AI_MARKERS]
    d = docs(spark, sf_dir).select("doc_id", sum(found[1:], found[0]).alias("n"), F.size(T.words(F.col("text"))).alias("words"))
    return d.select("doc_id", F.col("n").cast("long").alias("markers"), rnd(T.ratio(F.col("n") * 1000.0, F.col("words")), 2).alias("markers_per_1k"))


@query(
    rf"""WITH d AS (SELECT doc_id, lower(text) AS low, text, {_tokens("text")} AS t, list_transform({_sentences("text")}, lambda s: len({_words("s")})) AS sl, len({_words("text")}) AS n FROM documents),
c AS (SELECT doc_id, x, count(*) AS c FROM (SELECT doc_id, unnest(t) AS x FROM d) GROUP BY 1, 2),
e AS (SELECT doc_id, count(*) AS kinds, sum(c) AS total, sum(c * ln(c)) AS clogc FROM c GROUP BY doc_id)
SELECT doc_id, {rnd_sql(_ratio(f"len(list_filter(t, lambda x: x IN {_list(T.HEDGES)}))", "len(t)"), 4)} AS hedging_ratio,
 {rnd_sql(_ratio(_occurrences("low", T.TEMPLATE_PHRASES) + " * 1000.0", "n"), 2)} AS template_repetition,
 {rnd_sql("sqrt(coalesce(list_var_pop(sl), 0.0)) / greatest(1.0, coalesce(list_avg(sl), 0.0))", 4)} AS burstiness_cv,
 coalesce({rnd_sql("1.0 - ((ln(total) - clogc / total) / ln(2)) / greatest(0.0001, ln(greatest(2, kinds)) / ln(2))", 4)}, 1.0) AS perplexity_proxy,
 {rnd_sql(_clamp("(len(regexp_extract_all(text, '[0-9]+(?:[.,][0-9]+)?')) + len(regexp_extract_all(text, '[0-9]\\s*%'))) * 100.0 / greatest(1.0, n / 25.0)"), 1)} AS claim_specificity
FROM d LEFT JOIN e USING (doc_id)"""
)
def h8_style_metrics(spark, sf_dir):
    """Hedging, stock phrases, variation of sentence lengths, entropy and density of figures."""
    x = F.col("text")
    d = docs(spark, sf_dir).select("doc_id", F.lower("text").alias("low"), "text", T.tokens(x).alias("t"), F.transform(T.sentences(x), lambda s: F.size(T.words(s))).alias("sl"), F.size(T.words(x)).alias("n"))
    figures = F.size(T.all_of(x, "[0-9]+(?:[.,][0-9]+)?")) + F.size(T.all_of(x, r"[0-9]\s*%"))
    hedged = T.ratio(F.size(F.filter("t", lambda w: T.in_list(w, T.HEDGES))), F.size("t"))
    stock = T.ratio(T.occurrences(F.col("low"), T.TEMPLATE_PHRASES) * 1000.0, F.col("n"))
    # The mean is a column of its own, or every sentence would work it out again.
    mean = F.aggregate("sl", F.lit(0.0), lambda s, v: s + v) / F.greatest(F.lit(1), F.size("sl"))
    d = d.select("doc_id", "t", "n", "sl", hedged.alias("hedged"), stock.alias("stock"), mean.alias("mean"), figures.alias("figures"))
    # Terms are counted inside the row, so nothing is shuffled.
    d = corpus.term_arrays(d, F.col("t"), "n", "sl", "hedged", "stock", "mean", "figures")
    d = d.withColumns({"kinds": F.size("counted"), "clogc": F.aggregate("counted", F.lit(0.0), lambda s, v: s + v["n"] * F.log(v["n"]))})
    square = F.aggregate("sl", F.lit(0.0), lambda s, v: s + (v - F.col("mean")) * (v - F.col("mean"))) / F.greatest(F.lit(1), F.size("sl"))
    total = F.when(F.col("total") > 0, F.col("total").cast("double"))
    entropy = (F.log(total) - F.col("clogc") / total) / F.log(F.lit(2.0))
    return d.select(
        "doc_id",
        rnd(F.col("hedged"), 4).alias("hedging_ratio"),
        rnd(F.col("stock"), 2).alias("template_repetition"),
        rnd(F.sqrt(square) / F.greatest(F.lit(1.0), F.col("mean")), 4).alias("burstiness_cv"),
        F.coalesce(rnd(1.0 - entropy / F.greatest(F.lit(0.0001), F.log(F.greatest(F.lit(2), F.col("kinds"))) / F.log(F.lit(2.0))), 4), F.lit(1.0)).alias("perplexity_proxy"),
        rnd(clamp(F.col("figures") * 100.0 / F.greatest(F.lit(1.0), F.col("n") / 25.0)), 1).alias("claim_specificity"),
    )


@query(
    rf"""WITH d AS (SELECT doc_id, text, {_words("lower(text)")} AS w, list_filter(list_transform({_sentences("text")}, lambda s: trim(regexp_replace(lower(s), '\s+', ' ', 'g'))), lambda s: len({_words("s")}) >= 6) AS s FROM documents),
k AS (SELECT *, list_filter(w, lambda x: length(x) > 2 AND x NOT IN {_list(T.STOP_WORDS)}) AS c FROM d)
SELECT doc_id, {rnd_sql(_ratio("len(w) - len(c)", "len(w)"), 4)} AS stopword_ratio,
 {rnd_sql(_ratio(r"len(regexp_extract_all(text, '\p{Lu}'))", r"len(regexp_extract_all(text, '\p{L}'))"), 4)} AS uppercase_ratio,
 {rnd_sql(_ratio("len(regexp_extract_all(text, '[!?.,;:]'))", "length(text)"), 4)} AS punctuation_ratio,
 len(s) - len(list_distinct(s)) AS duplicate_sentences, len(list_distinct(c)) AS core_vocabulary FROM k"""
)
def h9_spam_metrics(spark, sf_dir):
    """Stop-word, case and punctuation shares, and repeated sentences."""
    x = F.col("text")
    s = F.filter(F.transform(T.sentences(x), lambda s: F.trim(F.regexp_replace(F.lower(s), r"\s+", " "))), lambda s: F.size(T.words(s)) >= 6)
    d = docs(spark, sf_dir).select("doc_id", "text", T.words(F.lower("text")).alias("w"), s.alias("s"))
    d = d.withColumn("c", F.filter("w", lambda v: (F.length(v) > 2) & ~T.in_list(v, T.STOP_WORDS)))
    return d.select(
        "doc_id",
        rnd(T.ratio(F.size("w") - F.size("c"), F.size("w")), 4).alias("stopword_ratio"),
        rnd(T.ratio(F.size(T.all_of(x, r"\p{Lu}")), F.size(T.all_of(x, r"\p{L}"))), 4).alias("uppercase_ratio"),
        rnd(T.ratio(F.size(T.all_of(x, "[!?.,;:]")), F.length(x)), 4).alias("punctuation_ratio"),
        (F.size("s") - F.size(F.array_distinct("s"))).cast("long").alias("duplicate_sentences"),
        F.size(F.array_distinct("c")).cast("long").alias("core_vocabulary"),
    )


_SCORES = ", ".join(f"len(regexp_extract_all(x, '{p}')) AS {k}_" for k, p in T.LANGUAGE_CHARS.items())
_BEST = f"greatest({', '.join(k + '_' for k in T.LANGUAGE_CHARS)})"


@query(
    f"""SELECT doc_id, CASE WHEN {_BEST} <= 10 THEN 'en' {" ".join(f"WHEN {k}_ = {_BEST} THEN '{k}'" for k in T.LANGUAGE_CHARS)} END AS guess, lang
FROM (SELECT doc_id, lang, {_SCORES} FROM (SELECT doc_id, lang, text AS x FROM documents))"""
)
def h11_language_guess(spark, sf_dir):
    """Language by letters of its alphabet, over the whole text; the first of equals, English below eleven."""
    d = docs(spark, sf_dir).select("doc_id", "lang", *[F.size(T.all_of(F.col("text"), p)).alias(f"{k}_") for k, p in T.LANGUAGE_CHARS.items()])
    best = F.greatest(*[F.col(f"{k}_") for k in T.LANGUAGE_CHARS])
    guess = F.when(best <= 10, "en")
    for k in T.LANGUAGE_CHARS:
        guess = guess.when(F.col(f"{k}_") == best, k)
    return d.select("doc_id", guess.alias("guess"), "lang")


@query(
    rf"""SELECT doc_id, {rnd_sql(f"least(1.0, {_ratio('len(e)', 'len(w)')})", 4)} AS entity_density, {rnd_sql(f"least(1.0, {_ratio('a', 'n')})", 4)} AS content_ratio,
 {rnd_sql(_ratio("len(list_distinct(w))", "len(w)"), 4)} AS unique_ratio
FROM (SELECT doc_id, regexp_extract_all(text, '[A-Za-zА-Яа-я0-9]+') AS w, list_filter(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+'), lambda x: regexp_matches(x, '^[A-ZА-Я][A-Za-zА-Яа-я0-9]{{2,}}$')) AS e,
 len(regexp_extract_all(text, '[A-Za-zА-Яа-я0-9]')) AS a, length(text) AS n FROM documents)"""
)
def h13_density(spark, sf_dir):
    """Share of capitalised words, of letters and digits, and of different words."""
    x = F.col("text")
    e = F.filter(T.all_of(x, T.RUN), lambda v: v.rlike("^[A-ZА-Я][A-Za-zА-Яа-я0-9]{2,}$"))
    d = docs(spark, sf_dir).select("doc_id", T.all_of(x, "[A-Za-zА-Яа-я0-9]+").alias("w"), e.alias("e"), F.size(T.all_of(x, "[A-Za-zА-Яа-я0-9]")).alias("a"), F.length(x).alias("n"))
    one = F.lit(1.0)
    return d.select("doc_id", rnd(F.least(one, T.ratio(F.size("e"), F.size("w"))), 4).alias("entity_density"), rnd(F.least(one, T.ratio(F.col("a"), F.col("n"))), 4).alias("content_ratio"), rnd(T.ratio(F.size(F.array_distinct("w")), F.size("w")), 4).alias("unique_ratio"))


def _content(x: str) -> str:
    return f"list_filter(regexp_extract_all(lower({x}), '[A-Za-zА-Яа-я0-9]{{3,}}'), lambda w: w NOT IN {_list(T.STOP_WORDS)})"


_TF = f"""l AS (SELECT item_id AS a, x, CAST(count(*) AS DOUBLE) AS w FROM (SELECT item_id, unnest({_content("text")}) AS x FROM benchmark) GROUP BY 1, 2),
r AS (SELECT doc_id AS b, x, CAST(count(*) AS DOUBLE) AS w FROM (SELECT doc_id, unnest({_content("text")}) AS x FROM documents) GROUP BY 1, 2)"""
_COSINE = """p AS (SELECT a, b, sum(lw.w * rw.w) AS dot FROM lw JOIN rw USING (x) GROUP BY 1, 2),
na AS (SELECT a, sum(w * w) AS q FROM lw GROUP BY a), nb AS (SELECT b, sum(w * w) AS q FROM rw GROUP BY b),
c AS (SELECT a, b, dot / sqrt(na.q * nb.q) AS cosine FROM p JOIN na USING (a) JOIN nb USING (b))"""
_BEST5 = f"SELECT a AS item_id, rank, b AS doc_id, {rnd_sql('cosine', 4)} AS cosine FROM (SELECT *, CAST(row_number() OVER (PARTITION BY a ORDER BY {rnd_sql('cosine', 4)} DESC, b) AS INTEGER) AS rank FROM c) WHERE rank <= 5"


def _items(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text")


def _best5(found: DataFrame) -> DataFrame:
    return found.select(F.col("a").alias("item_id"), "rank", F.col("b").alias("doc_id"), F.col("score").alias("cosine"))


@query(f"WITH {_TF}, lw AS (SELECT * FROM l), rw AS (SELECT * FROM r), {_COSINE} {_BEST5}")
def h14_text_cosine(spark, sf_dir):
    """The five documents most similar to each benchmark item, by term counts."""
    return _best5(corpus.best_matches(_items(spark, sf_dir), docs(spark, sf_dir).select("doc_id", "text"), 5, digits=4))


@query(
    f"""WITH {_TF}, f AS (SELECT x, count(*) AS df FROM r GROUP BY x), k AS (SELECT count(*) AS n FROM documents),
lw AS (SELECT a, x, w * (ln((k.n + 1) / (coalesce(df, 0) + 1)) + 1.0) AS w FROM l LEFT JOIN f USING (x), k),
rw AS (SELECT b, x, w * (ln((k.n + 1) / (coalesce(df, 0) + 1)) + 1.0) AS w FROM r LEFT JOIN f USING (x), k), {_COSINE} {_BEST5}"""
)
def h14_tfidf_cosine(spark, sf_dir):
    """The same with weights by rarity."""
    return _best5(corpus.best_matches(_items(spark, sf_dir), docs(spark, sf_dir).select("doc_id", "text"), 5, tf_idf=True, digits=4))


_CHUNKS = "ch AS (SELECT doc_id, i AS idx, substr(text, 1 + (i - 1) * 1100, 1200) AS chunk FROM (SELECT doc_id, text, unnest(range(1, (greatest(1, length(text) - 100) - 1) // 1100 + 1 + 1)) AS i FROM documents WHERE text IS NOT NULL AND text <> ''))"


@query(f"WITH {_CHUNKS} SELECT doc_id, CAST(idx AS INTEGER) AS idx, length(chunk) AS chars, md5(chunk) AS digest FROM ch")
def h15_chunks(spark, sf_dir):
    """Overlapping windows of each text."""
    return corpus.chunks(docs(spark, sf_dir)).select("doc_id", "idx", F.length("chunk").cast("long").alias("chars"), F.md5("chunk").alias("digest"))


@query(
    rf"""WITH {_CHUNKS}, s AS (SELECT doc_id, idx, sum(len(list_filter(string_split_regex(trim(chunk), '\s+'), lambda x: x <> ''))) OVER (PARTITION BY doc_id ORDER BY idx) AS run FROM ch)
SELECT doc_id, count(*) AS chunks, count(*) FILTER (WHERE run <= 512) AS survive_512, count(*) FILTER (WHERE run <= 1024) AS survive_1024, count(*) FILTER (WHERE run <= 2048) AS survive_2048 FROM s GROUP BY doc_id"""
)
def e4_token_budget(spark, sf_dir):
    """Whole chunks within token budgets."""
    return corpus.survivors(corpus.chunks(docs(spark, sf_dir)))


@query(
    f"""WITH {_CHUNKS}, t AS (SELECT doc_id, idx, {_content("chunk")} AS t FROM ch), n AS (SELECT doc_id, idx, list_distinct(t) AS d, row_number() OVER (PARTITION BY doc_id, list_aggregate(t, 'string_agg', ' ') ORDER BY idx) > 1 AS exact FROM t),
m AS (SELECT DISTINCT a.doc_id, a.idx FROM n a JOIN n b ON a.doc_id = b.doc_id AND b.idx BETWEEN a.idx - 8 AND a.idx - 1
 WHERE len(a.d) > 0 AND len(b.d) > 0 AND len(list_intersect(a.d, b.d)) / len(list_distinct(list_concat(a.d, b.d))) >= 0.9)
SELECT n.doc_id, CAST(n.idx AS INTEGER) AS idx, exact OR m.idx IS NOT NULL AS duplicate FROM n LEFT JOIN m ON n.doc_id = m.doc_id AND n.idx = m.idx"""
)
def e9_chunk_dedupe(spark, sf_dir):
    """Chunks that repeat an earlier one."""
    return corpus.chunk_duplicates(corpus.chunks(docs(spark, sf_dir)))


_TFIDF = f"""w AS (SELECT doc_id, list_filter({_words("lower(text)")}, lambda x: length(x) >= 4) AS w FROM documents),
p AS (SELECT doc_id, len(w) AS total, unnest(w) AS term, generate_subscripts(w, 1) AS pos FROM w),
c AS (SELECT doc_id, term, count(*) AS n, min(pos) AS first, any_value(total) AS total FROM p GROUP BY 1, 2),
f AS (SELECT term, count(*) AS df FROM c GROUP BY term),
o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) AS r FROM c) WHERE r <= 50),
s AS (SELECT doc_id, term, n, first, CAST(n AS DOUBLE) / total * ln(CAST((SELECT count(*) FROM documents) AS DOUBLE) / df) AS raw FROM o JOIN f USING (term)),
z AS (SELECT doc_id, term, n, first, {rnd_sql("raw", 6)} AS score FROM s WHERE raw > 0.0001),
tfidf AS (SELECT doc_id, CAST(rank AS INTEGER) AS rank, term, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, n DESC, first) AS rank FROM z) WHERE rank <= 10)"""


@query(f"WITH {_TFIDF} SELECT * FROM tfidf")
def d24_tfidf_top_terms(spark, sf_dir):
    """The ten best terms of each document."""
    return corpus.tfidf(docs(spark, sf_dir).select("doc_id", "text"))


def _ngram_sql(n: int) -> str:
    return f"""WITH t AS (SELECT doc_id, {_tokens("text")} AS t FROM documents),
g AS (SELECT doc_id, i AS pos, array_to_string(t[i : i + {n - 1}], ' ') AS term, len(t) - {n - 1} AS total FROM (SELECT doc_id, t, unnest(range(1, len(t) - {n - 1} + 1)) AS i FROM t)),
c AS (SELECT doc_id, term, count(*) AS n, min(pos) AS first, any_value(total) AS total FROM g GROUP BY 1, 2)
SELECT doc_id, CAST(rank AS INTEGER) AS rank, term, n AS count, {rnd_sql("CAST(n AS DOUBLE) / total * 100.0", 3)} AS pct
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) AS rank FROM c) WHERE rank <= 5"""


@query(_ngram_sql(1))
def d25_top_terms(spark, sf_dir):
    return corpus.top_terms(docs(spark, sf_dir), T.tokens(F.col("text")), 1, 5)


@query(_ngram_sql(2))
def d25_top_bigrams(spark, sf_dir):
    return corpus.top_terms(docs(spark, sf_dir), T.tokens(F.col("text")), 2, 5)


@query(_ngram_sql(3))
def d25_top_trigrams(spark, sf_dir):
    return corpus.top_terms(docs(spark, sf_dir), T.tokens(F.col("text")), 3, 5)


_LINKED = """q AS (SELECT a.doc_id AS src, b.doc_id AS dst, count(*) AS relevance, min(a.term) AS suggested_anchor FROM tfidf a JOIN tfidf b ON a.term = b.term AND a.doc_id <> b.doc_id GROUP BY 1, 2),
li AS (SELECT src, dst, relevance, suggested_anchor, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY relevance DESC, dst) AS rank FROM q) WHERE rank <= 20)"""


@query(f"WITH {_TFIDF}, {_LINKED} SELECT * FROM li")
def c9_semantic_links(spark, sf_dir):
    """Documents that share their best terms: the twenty that share the most, for each."""
    return corpus.semantic_links(corpus.tfidf(docs(spark, sf_dir).select("doc_id", "text"))).select("src", "dst", "relevance", "suggested_anchor", "rank")


@query(
    f"""WITH {_TFIDF}, {_LINKED}, b AS (SELECT src AS doc_id, count(*) AS n, min_by(suggested_anchor, rank) AS anchor FROM li GROUP BY 1)
SELECT d.doc_id, coalesce(anchor, t.term, 'misc') AS topic_label, coalesce(n, 0) >= 3 AS topic_hub FROM documents d LEFT JOIN b USING (doc_id) LEFT JOIN tfidf t ON t.doc_id = d.doc_id AND t.rank = 1"""
)
def c9_topic_labels(spark, sf_dir):
    """Topic of each document by its links, and whether it is a hub of its topic."""
    terms = cut(corpus.tfidf(docs(spark, sf_dir).select("doc_id", "text")))
    return corpus.topic_labels(corpus.semantic_links(terms), terms, docs(spark, sf_dir))


_SIMHASH = rf"""w AS (SELECT doc_id, unnest(list_filter({_words("lower(text)")}, lambda x: length(x) >= 3 AND x NOT IN {_list(T.STOP_WORDS)})) AS t FROM documents),
c AS (SELECT doc_id, t, count(*) AS n, CAST('0x' || substr(md5(t), 1, 16) AS UBIGINT) AS h FROM w GROUP BY 1, 2),
v AS (SELECT doc_id, i, sum(CASE WHEN (h >> i) & 1 = 1 THEN n ELSE -n END) >= 0 AS one FROM c, (SELECT CAST(range AS UBIGINT) AS i FROM range(64)) GROUP BY 1, 2),
sh AS (SELECT doc_id, sum(CASE WHEN one THEN CAST(1 AS HUGEINT) << i ELSE 0 END) AS hu FROM v GROUP BY doc_id),
s AS (SELECT doc_id, CAST(CASE WHEN hu >= 9223372036854775808 THEN hu - 18446744073709551616 ELSE hu END AS BIGINT) AS simhash FROM sh),
nw AS (SELECT doc_id, len(string_split_regex(trim(text), '\s+')) AS n_words FROM documents),
hh AS (SELECT doc_id, n_words, coalesce(simhash, 0) AS simhash FROM nw LEFT JOIN s USING (doc_id)),
u AS (SELECT simhash, min(doc_id) AS doc_id FROM hh WHERE n_words >= 80 AND simhash <> 0 GROUP BY simhash),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, CAST(bit_count(xor(a.simhash, b.simhash)) AS INTEGER) AS distance FROM u a JOIN u b ON a.doc_id < b.doc_id AND bit_count(xor(a.simhash, b.simhash)) <= 6)"""


def _hashes(spark, sf_dir) -> DataFrame:
    """Hashes of documents of 80 words and more, written once."""
    return cut(corpus.simhash(docs(spark, sf_dir)).where("n_words >= 80 and simhash <> 0"))


@query(f"WITH {_SIMHASH} SELECT * FROM pairs")
def c10_near_duplicates(spark, sf_dir):
    """Pairs of different similarity hashes at most six bits apart; equal hashes stand for each other."""
    return corpus.hamming_pairs(_hashes(spark, sf_dir))


@query(
    f"""WITH {_SIMHASH}, m AS (SELECT simhash, count(*) AS copies FROM hh WHERE n_words >= 80 AND simhash <> 0 GROUP BY simhash),
k AS (SELECT u.doc_id, copies FROM u JOIN m USING (simhash)),
n AS (SELECT x.d AS doc_id, sum(k.copies) AS near FROM (SELECT a AS d, b AS o FROM pairs UNION ALL SELECT b, a FROM pairs) x JOIN k ON k.doc_id = x.o GROUP BY 1)
SELECT k.doc_id, copies, CAST(copies - 1 + coalesce(near, 0) AS BIGINT) AS neighbours FROM k LEFT JOIN n USING (doc_id) WHERE copies > 1 OR near > 0"""
)
def i6_duplicate_groups(spark, sf_dir):
    """How many documents are near each different hash that has any."""
    return corpus.hamming_neighbours(_hashes(spark, sf_dir)).where("neighbours > 0")


@query(
    rf"""WITH e AS (SELECT doc_id, unnest(list_filter(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+'), lambda x: regexp_matches(x, '^[A-ZА-Я][A-Za-zА-Яа-я0-9]{{2,}}$'))) AS x FROM documents),
g AS (SELECT doc_id, lower(x) AS entity, count(*) AS mentions, count(DISTINCT x) AS forms FROM e GROUP BY 1, 2)
SELECT doc_id, entity, mentions, {rnd_sql("least(0.99, 0.5 + 0.05 * mentions + 0.05 * (forms - 1))", 4)} AS confidence, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY mentions DESC, entity) AS rank FROM g) WHERE rank <= 20"""
)
def d37_entities(spark, sf_dir):
    """Capitalised words as entities: forms under one key, with a confidence that grows with mentions and forms."""
    e = F.filter(T.all_of(F.col("text"), T.RUN), lambda v: v.rlike("^[A-ZА-Я][A-Za-zА-Яа-я0-9]{2,}$"))
    g = docs(spark, sf_dir).select("doc_id", F.explode(e).alias("x")).groupBy("doc_id", F.lower("x").alias("entity")).agg(F.count("*").alias("mentions"), F.count_distinct("x").alias("forms"))
    confidence = rnd(F.least(F.lit(0.99), 0.5 + 0.05 * F.col("mentions") + 0.05 * (F.col("forms") - 1)), 4)
    return top_k(g, ["doc_id"], [F.desc("mentions"), F.asc("entity")], 20).select("doc_id", "entity", "mentions", confidence.alias("confidence"), "rank")


@query(
    rf"""SELECT lang, source, count(*) AS documents, sum(n) AS tokens, {rnd_sql("avg(CAST(n AS DOUBLE))", 2)} AS mean_tokens, median(n) AS median_tokens
FROM (SELECT lang, source, len({_tokens("text")}) AS n FROM documents) GROUP BY lang, source"""
)
def h1_rollup_by_source(spark, sf_dir):
    """The feature table rolled up by language and source."""
    d = docs(spark, sf_dir).select("lang", "source", F.size(T.tokens(F.col("text"))).alias("n"))
    return d.groupBy("lang", "source").agg(F.count("*").alias("documents"), F.sum("n").alias("tokens"), rnd(F.avg("n"), 2).alias("mean_tokens"), F.median("n").alias("median_tokens"))
