"""Keyword lists: normal forms, intents, similarity join and grouping."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crawlframe.functions.common import rnd
from crawlframe.operators.graph import cut

# Stop words, suffixes in the order in which they are tried, intent stems.
STOP_WORDS = ["a", "an", "and", "as", "at", "be", "by", "for", "from", "how", "in", "is", "it", "of", "on", "or", "that", "the", "to", "with", "и", "в", "во", "на", "по", "под", "от", "до", "к", "ко", "из", "за", "у", "о", "об", "для", "как", "или", "это", "что"]
RU_SUFFIXES = ["иями", "ями", "ами", "ого", "его", "ому", "ему", "ыми", "ими", "ьями", "иях", "ах", "ях", "ов", "ев", "ий", "ый", "ой", "ая", "ое", "ые", "ам", "ям", "ом", "ем", "ую", "юю", "ия", "ья", "ие", "ье", "а", "я", "ы", "и", "е", "о", "у", "ю"]
EN_SUFFIXES = ["ingly", "edly", "ing", "ed", "ies", "ers", "er", "es", "s", "ly"]
INTENTS = {
    "commercial": ["куп", "цена", "стоим", "заказ", "заказать", "достав", "shop", "buy", "price", "discount", "deal", "sale"],
    "informational": ["как", "что", "почему", "гайд", "инструкц", "обзор", "сравнен", "review", "guide", "how", "what", "best"],
    "navigational": ["официальн", "сайт", "вход", "контакт", "login", "official", "site", "homepage"],
    "brand": ["iphone", "samsung", "apple", "xiaomi", "huawei", "google", "yandex", "ozon", "wildberries", "dns"],
}


# Stems that say nothing, prepositions.
NOISE_STEMS = ["скачать", "скачат", "бесплатн", "download", "watch", "pdf", "torrent", "youtube", "ютуб"]
PREPOSITIONS = ["к", "ко", "по", "для", "на", "с", "со", "в", "во", "из", "от", "до", "под", "без", "при", "о", "об", "про"]
#: Stems that stand for a group, and the first of them, its core.
CENTROID, CORE = 8, 4


def normal_form(keyword: Column) -> Column:
    x = F.translate(F.lower(F.trim(keyword)), "ё", "е")
    x = F.regexp_replace(F.regexp_replace(x, r"[_/\\|]+", " "), r"[^\p{L}\p{N}\s-]+", " ")
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def _strip(word: Column, suffixes: list[str]) -> Column:
    found = reduce(lambda w, s: w.when(word.endswith(s) & (F.length(word) - len(s) >= 3), F.left(word, F.length(word) - len(s))), suffixes[1:], F.when(word.endswith(suffixes[0]) & (F.length(word) - len(suffixes[0]) >= 3), F.left(word, F.length(word) - len(suffixes[0]))))
    return found.otherwise(word)


def stems(tokens: Column) -> Column:
    """Tokens without one suffix of each list at most; words of three letters stay."""
    short = lambda w, suffixes: F.when(F.length(w) <= 3, w).otherwise(_strip(w, suffixes))
    return F.transform(F.transform(tokens, lambda w: short(w, RU_SUFFIXES)), lambda w: short(w, EN_SUFFIXES))


def dedupe(rows: DataFrame) -> DataFrame:
    """``(keyword, frequency, pos)`` -> one row per normal form, with occurrences, demand and the first spelling."""
    demand = F.when(F.col("frequency") < 0, 0.0).otherwise(F.least(F.coalesce("frequency", F.lit(1.0)), F.lit(1e9)))
    clean = rows.where(F.trim("keyword") != "").select(normal_form(F.col("keyword")).alias("norm"), F.trim("keyword").alias("display"), demand.alias("demand"), "pos").where("norm <> ''")
    return clean.groupBy("norm").agg(F.count("*").alias("occurrences"), F.sum("demand").alias("demand"), F.min_by("display", "pos").alias("display"), F.min("pos").alias("pos"))


def entries(keywords: DataFrame) -> DataFrame:
    """Adds tokens, stems and character n-grams, as sorted sets."""
    raw = F.filter(F.split("norm", " "), lambda x: x != "")
    kept = F.filter(raw, lambda x: (F.length(x) > 1) & ~x.isin(*STOP_WORDS))
    compact = F.replace("norm", F.lit(" "), F.lit(""))
    n = F.when(F.length(compact) >= 5, 3).otherwise(2)
    grams = F.when(F.length(compact) <= n, F.array(compact)).otherwise(F.transform(F.sequence(F.lit(1), F.length(compact) - n + 1), lambda i: F.substr(compact, i, n)))
    e = keywords.withColumn("tokens", F.array_sort(F.array_distinct(F.when(F.size(kept) > 0, kept).otherwise(raw))))
    return e.withColumns({"stems": F.array_sort(F.array_distinct(stems(F.col("tokens")))), "ngrams": F.array_sort(F.array_distinct(grams))})


def intents(e: DataFrame) -> DataFrame:
    """``(norm, intent)``: two points for an equal stem, one for a common beginning; ties alphabetically."""
    d = F.broadcast(e.sparkSession.createDataFrame([(k, w) for k, ws in INTENTS.items() for w in ws], "label string, word string"))
    s = e.select("norm", F.explode("stems").alias("stem"))
    hits = s.join(d, s.stem.startswith(F.col("word")) | F.col("word").startswith(s.stem))
    points = hits.groupBy("norm", "stem", "label").agg(F.max(F.when(F.col("stem") == F.col("word"), 2).otherwise(1)).alias("p")).groupBy("norm", "label").agg(F.sum("p").alias("p"))
    best = points.groupBy("norm").agg(F.min_by("label", F.struct(-F.col("p"), "label")).alias("intent"))
    return e.select("norm").join(best, "norm", "left").select("norm", F.coalesce("intent", F.lit("mixed")).alias("intent"))


def _overlap(a: Column, b: Column, method: str) -> Column:
    both, na, nb = F.size(F.array_intersect(a, b)).cast("double"), F.size(a), F.size(b)
    if method == "overlap":
        return both / F.least(na, nb)
    if method == "dice":
        return 2 * both / (na + nb)
    return both / (na + nb - both)


def similar_pairs(e: DataFrame, threshold: float, method: str = "jaccard", frequent: float = 0.05) -> DataFrame:
    """``(a, b, sim)``, a < b: pairs by stems and n-grams.

    They must share a stem of at most five, or the frequent share, of the keywords: that cut is part of the definition.
    """
    s = e.select("norm", F.explode("stems").alias("stem"))
    cut = F.broadcast(e.agg(F.greatest(F.lit(5), F.floor(F.count("*") * frequent)).alias("cut")))
    rare = s.groupBy("stem").agg(F.count("*").alias("df")).crossJoin(cut).where("df <= cut").select("stem")
    s = s.join(rare, "stem")
    pairs = s.select(F.col("norm").alias("a"), "stem").join(s.select(F.col("norm").alias("b"), "stem"), "stem").where("a < b").select("a", "b").distinct()
    side = lambda x: e.select(F.col("norm").alias(x), F.col("stems").alias(f"s{x}"), F.col("ngrams").alias(f"g{x}"))
    j = pairs.join(side("a"), "a").join(side("b"), "b")
    st, ch = _overlap(F.col("sa"), F.col("sb"), method), _overlap(F.col("ga"), F.col("gb"), "jaccard")
    score = st * 0.82 + ch * 0.18 + F.when((st > 0) & (ch > 0), 0.03).otherwise(0.0)
    return j.select("a", "b", rnd(F.least(F.lit(1.0), score), 6).alias("sim")).where(F.col("sim") >= threshold)


def groups(e: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(norm, leader, score)``: greedy grouping in a total order, worked in rounds.

    Better means more stems, more tokens, a shorter spelling, an earlier position. A keyword leads if no better leader is
    similar to it; others join the most similar leader. Each round decides all keywords whose better neighbours are decided;
    the best undecided one always is, so rounds end.
    """
    order = F.struct(-F.size("stems"), -F.size("tokens"), F.length("display"), "pos", "norm")
    nodes = cut(e.select("norm", order.alias("o")))
    both = pairs.select("a", "b", "sim").union(pairs.select("b", "a", "sim"))
    n = nodes.select(F.col("norm").alias("b"), F.col("o").alias("ob"))
    better = cut(both.join(nodes.withColumnRenamed("norm", "a"), "a").join(n, "b").where("ob < o").select("a", "b", "sim"))
    state = cut(nodes.select("norm").withColumn("leads", F.lit(None).cast("boolean")))
    while state.where("leads is null").limit(1).count():
        near = better.join(state.select(F.col("norm").alias("b"), "leads"), "b").groupBy(F.col("a").alias("norm")).agg(F.bool_or("leads").alias("led"), F.bool_or(F.col("leads").isNull()).alias("waits"))
        j = state.join(near, "norm", "left")
        decided = F.when(F.coalesce("led", F.lit(False)), False).when(~F.coalesce("waits", F.lit(False)), True)
        state = cut(j.select("norm", F.coalesce("leads", decided).alias("leads")))
    leaders = state.where("leads").select(F.col("norm").alias("b"))
    joined = better.join(leaders, "b").groupBy(F.col("a").alias("norm")).agg(F.max_by("b", F.struct("sim", F.col("b"))).alias("leader"), F.max("sim").alias("score"))
    return state.join(joined, "norm", "left").select("norm", F.when(F.col("leads"), F.col("norm")).otherwise(F.col("leader")).alias("leader"), F.when(F.col("leads"), 1.0).otherwise(F.col("score")).alias("score"))


def stem_counts(e: DataFrame, assigned: DataFrame) -> DataFrame:
    """``(leader, stem, n, r)``: in how many keywords of a group a stem stands, and its place, ties in the order of letters."""
    n = e.join(assigned, "norm").select("leader", F.explode("stems").alias("stem")).groupBy("leader", "stem").agg(F.count("*").alias("n"))
    return n.withColumn("r", F.row_number().over(Window.partitionBy("leader").orderBy(F.desc("n"), "stem")))


def centroids(counts: DataFrame, k: int = CENTROID) -> DataFrame:
    """``(leader, top)``: the first stems of each group, the most frequent first."""
    top = F.transform(F.array_sort(F.collect_list(F.struct("r", "stem"))), lambda x: x["stem"])
    return counts.where(F.col("r") <= k).groupBy("leader").agg(top.alias("top"))


def merged(e: DataFrame, assigned: DataFrame, threshold: float, method: str = "jaccard", frequent: float = 0.05, more: float = 0.08) -> DataFrame:
    """``(norm, leader, score)`` after a second grouping, of the leaders: by their similarity and the stems of their groups.

    Two groups may become one if 0.75 of the leaders' similarity and 0.25 of the common share of their first stems come to
    the threshold and ``more``, and they share a stem of the leaders or a third of the first stems; two of more than 25
    keywords only if the leaders are nearly the same. Scores become those to the new leader, by what merged the two.
    """
    counts = cut(stem_counts(e, assigned))
    top = cut(centroids(counts).join(assigned.groupBy("leader").agg(F.count("*").alias("size")), "leader"))
    leaders = cut(e.join(top.select(F.col("leader").alias("norm")), "norm", "left_semi"))
    # Below this similarity no share of stems is enough.
    near = similar_pairs(leaders, (threshold + more - 0.25) / 0.75, method, frequent)
    side = lambda x: top.select(F.col("leader").alias(x), F.col("top").alias(f"t{x}"), F.col("size").alias(f"n{x}"))
    stems_of = lambda x: leaders.select(F.col("norm").alias(x), F.col("stems").alias(f"s{x}"))
    j = near.join(side("a"), "a").join(side("b"), "b").join(stems_of("a"), "a").join(stems_of("b"), "b")
    overlap = F.size(F.array_intersect("ta", "tb")) / F.least(F.size("ta"), F.size("tb"))
    score = rnd(F.col("sim") * 0.75 + overlap * 0.25, 6)
    j = j.withColumns({"overlap": overlap, "both": score, "common": F.size(F.array_intersect("sa", "sb"))})
    fits = ((F.col("both") >= threshold + more) & ((F.col("common") >= 1) | (F.col("overlap") >= 0.35))) | (F.col("sim") >= 0.92)
    large = (F.col("na") > 25) & (F.col("nb") > 25) & (F.col("sim") < 0.9)
    edges = cut(j.where(fits & ~large).select("a", "b", F.col("both").alias("sim")))
    above = groups(leaders, edges).select(F.col("norm").alias("leader"), F.col("leader").alias("above"), F.col("score").alias("above_score"))
    j = assigned.join(above, "leader")
    return j.select("norm", F.col("above").alias("leader"), F.when(F.col("above") == F.col("leader"), F.col("score")).otherwise(rnd(F.col("score") * F.col("above_score"), 6)).alias("score"))


def group_summary(e: DataFrame, assigned: DataFrame, pairs: DataFrame) -> DataFrame:
    """Size, demand, share, exact cohesion and quality of each group."""
    g = assigned.select("norm", "leader")
    out = _cohesion(_sizes(e, g, []), g, pairs)
    return out.select("leader", "size", "demand", "share", "cohesion", "quality")


def _sizes(e: DataFrame, g: DataFrame, sums: list[str]) -> DataFrame:
    sizes = e.join(g, "norm").groupBy("leader").agg(F.count("*").alias("size"), F.sum("demand").alias("demand"), *[F.sum(c).alias(c) for c in sums])
    total = sizes.agg(F.sum("demand").alias("total"))
    return sizes.crossJoin(F.broadcast(total)).withColumn("share", rnd(F.col("demand") / F.col("total") * 100.0, 2)).drop("total")


def _cohesion(sizes: DataFrame, g: DataFrame, pairs: DataFrame) -> DataFrame:
    """Adds the mean similarity of all pairs of a group, those below the threshold counting 0, and the share of similar pairs."""
    inner = pairs.join(g.select(F.col("norm").alias("a"), F.col("leader").alias("la")), "a").join(g.select(F.col("norm").alias("b"), F.col("leader").alias("lb")), "b").where("la = lb")
    edges = inner.groupBy(F.col("la").alias("leader")).agg(F.sum("sim").alias("sims"), F.count("*").alias("links"))
    possible, single = F.col("size") * (F.col("size") - 1) / 2.0, F.col("size") == 1
    out = sizes.join(edges, "leader", "left").withColumns({"cohesion": F.when(single, 1.0).otherwise(rnd(F.coalesce("sims", F.lit(0.0)) / possible, 4)), "density": F.when(single, 0.0).otherwise(rnd(F.coalesce("links", F.lit(0)) / possible, 4))})
    return out.withColumn("quality", F.when(F.col("cohesion") >= 0.78, "high").when(F.col("cohesion") >= 0.62, "medium").otherwise("low"))


def group_profile(e: DataFrame, assigned: DataFrame, pairs: DataFrame) -> DataFrame:
    """What group_summary says, and occurrences, density, label, intent and priority of each group."""
    g = assigned.select("norm", "leader")
    counts = cut(stem_counts(e, assigned))
    kinds = intents(counts.groupBy(F.col("leader").alias("norm")).agg(F.collect_set("stem").alias("stems"))).select(F.col("norm").alias("leader"), "intent")
    out = _cohesion(_sizes(e, g, ["occurrences"]), g, pairs).join(centroids(counts, 3), "leader").join(kinds, "leader")
    base = F.array_join("top", " / ")
    label = F.when(F.col("intent") == "mixed", base).otherwise(F.concat_ws(": ", "intent", base))
    priority = rnd(F.col("demand") * 0.55 + F.col("size") * 0.25 + F.col("cohesion") * 20.0, 2)
    return out.select("leader", "size", "occurrences", "demand", "share", "cohesion", "density", "quality", label.alias("label"), "intent", priority.alias("priority"))


def phrase_bonus(display: Column) -> Column:
    """What a spelling gains as a phrase: some words, a preposition, few repeats; long words and digits cost."""
    low = F.lower(display)
    words = F.regexp_extract_all(low, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    n = F.size(words)
    alpha = F.filter(words, lambda w: w.rlike("[a-zа-я]"))
    unique = F.size(F.array_distinct(alpha)) / F.greatest(F.lit(1), F.size(alpha))
    compact = F.regexp_replace(low, r"\s+", "")
    digits = F.length(F.regexp_replace(compact, "[^0-9]", "")) / F.greatest(F.lit(1), F.length(compact))
    bonus = (
        F.when(n.between(3, 6), 0.08).when(n >= 8, -F.least(F.lit(0.14), (n - 7) * 0.02)).otherwise(0.0)
        + F.when(F.exists(words, lambda w: w.isin(*PREPOSITIONS)), 0.09).otherwise(0.0)
        + F.when(F.size(alpha) == 0, 0.0).when(unique >= 0.9, 0.03).when(unique <= 0.6, -0.06).otherwise(0.0)
        + F.when(F.size(F.filter(words, lambda w: F.length(w) >= 18)) >= 2, -0.06).otherwise(0.0)
        + F.when(digits >= 0.35, -0.08).otherwise(0.0)
    )
    return F.when(n == 0, 0.0).otherwise(bonus)


def representatives(e: DataFrame, assigned: DataFrame) -> DataFrame:
    """``(leader, representative, score)``: by demand, stems of the group's core, support, similarity, shape and phrase.

    Ties go by demand, tokens, length and spelling.
    """
    counts = cut(stem_counts(e, assigned))
    core = centroids(counts, CORE).withColumnRenamed("top", "core")
    size = assigned.groupBy("leader").agg(F.count("*").alias("size"))
    support = e.select("norm", F.explode("stems").alias("stem")).join(assigned.select("norm", "leader"), "norm").join(counts.select("leader", "stem", "n"), ["leader", "stem"]).groupBy("norm").agg(F.sum("n").alias("held"))
    j = e.join(assigned, "norm").join(core, "leader").join(size, "leader").join(support, "norm").withColumn("top", F.max("demand").over(Window.partitionBy("leader")))
    n, chars = F.size("tokens"), F.length("display")
    shape = F.when(n.between(2, 6), 0.07).when(n >= 9, -0.05).otherwise(0.0)
    noise = F.arrays_overlap("stems", F.array(*[F.lit(x) for x in NOISE_STEMS])) & (n >= 4)
    penalty = F.when(n <= 1, 0.28).when(n >= 8, F.least(F.lit(0.45), 0.06 * (n - 7))).otherwise(0.0) + F.when(chars >= 70, F.least(F.lit(0.35), (chars - 70) / 90.0)).otherwise(0.0) + F.when(noise, 0.08).otherwise(0.0)
    norm_demand = F.when(F.col("top") > 0, F.log1p("demand") / F.log1p("top")).otherwise(0.0)
    overlap = F.size(F.array_intersect("stems", "core")) / F.size("core")
    held = F.col("held") / (F.col("size") * F.size("stems"))
    score = rnd(norm_demand * 0.55 + overlap * 0.2 + held * 0.1 + F.col("score") * 0.08 + shape + phrase_bonus(F.col("display")) - penalty, 6)
    j = j.withColumn("rep_score", score)
    order = Window.partitionBy("leader").orderBy(F.desc("rep_score"), F.desc("demand"), n.asc(), chars.asc(), F.asc("display"))
    return j.withColumn("r", F.row_number().over(order)).where("r = 1").select("leader", F.col("display").alias("representative"), F.col("rep_score").alias("score"))
