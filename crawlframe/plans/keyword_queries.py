"""Queries over the keyword view."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlframe.functions.common import rnd, rnd_sql, top_k
from crawlframe.operators import keywords as K
from crawlframe.operators.graph import cut
from crawlframe.plans.adapters import KEYWORDS, keywords
from crawlframe.plans.registry import query

THRESHOLD = 0.6
#: The view has few different words, so more of them than usual may be frequent.
FREQUENT = 0.25


def _strip(x: str, suffixes) -> str:
    return "CASE " + " ".join(f"WHEN ends_with({x}, '{s}') AND length({x}) - {len(s)} >= 3 THEN left({x}, length({x}) - {len(s)})" for s in suffixes) + f" ELSE {x} END"


_NORM = r"trim(regexp_replace(regexp_replace(regexp_replace(replace(lower(trim(keyword)), 'ё', 'е'), '[_/\\|]+', ' ', 'g'), '[^\p{L}\p{N}\s-]+', ' ', 'g'), '\s+', ' ', 'g'))"
_D1 = f"""{KEYWORDS}, k1 AS (SELECT {_NORM} AS norm, count(*) AS occurrences, sum(CASE WHEN frequency < 0 THEN 0.0 ELSE least(coalesce(frequency, 1.0), 1e9) END) AS demand, min_by(trim(keyword), pos) AS display, min(pos) AS pos
 FROM kw WHERE trim(keyword) <> '' GROUP BY 1 HAVING norm <> '')"""
_STOP = ", ".join(f"'{w}'" for w in K.STOP_WORDS)
_STEM = f"list_transform(tokens, lambda x: CASE WHEN length(x) <= 3 THEN x ELSE {_strip('(' + _strip('x', K.RU_SUFFIXES) + ')', K.EN_SUFFIXES)} END)"
_E = f"""{_D1}, e1 AS (SELECT *, list_filter(string_split(norm, ' '), lambda x: length(x) > 1 AND x NOT IN ({_STOP})) AS kept, replace(norm, ' ', '') AS compact FROM k1),
e2 AS (SELECT *, list_sort(list_distinct(CASE WHEN len(kept) > 0 THEN kept ELSE string_split(norm, ' ') END)) AS tokens, CASE WHEN length(compact) >= 5 THEN 3 ELSE 2 END AS n FROM e1),
e AS (SELECT norm, occurrences, demand, display, pos, tokens, list_sort(list_distinct({_STEM})) AS stems,
 list_sort(list_distinct(CASE WHEN length(compact) <= n THEN [compact] ELSE list_transform(range(1, length(compact) - n + 2), lambda i: substr(compact, i, n)) END)) AS ngrams FROM e2)"""
_SIM = "both_ * 1.0 / (na + nb - both_)"
_PAIRS = f"""s AS (SELECT norm, unnest(stems) AS stem FROM e), rare AS (SELECT stem FROM s GROUP BY stem HAVING count(*) <= (SELECT greatest(5, floor(count(*) * {FREQUENT})) FROM e)),
pr AS (SELECT DISTINCT x.norm AS a, y.norm AS b FROM s x JOIN s y ON x.stem = y.stem AND x.norm < y.norm WHERE x.stem IN (SELECT stem FROM rare)),
sc AS (SELECT a, b, CAST(len(list_intersect(ea.stems, eb.stems)) AS DOUBLE) / (len(ea.stems) + len(eb.stems) - len(list_intersect(ea.stems, eb.stems))) AS st,
 CAST(len(list_intersect(ea.ngrams, eb.ngrams)) AS DOUBLE) / (len(ea.ngrams) + len(eb.ngrams) - len(list_intersect(ea.ngrams, eb.ngrams))) AS ch FROM pr JOIN e ea ON ea.norm = a JOIN e eb ON eb.norm = b),
pairs AS (SELECT a, b, {rnd_sql("least(1.0, st * 0.82::DOUBLE + ch * 0.18::DOUBLE + CASE WHEN st > 0 AND ch > 0 THEN 0.03::DOUBLE ELSE 0.0 END)", 6)} AS sim FROM sc WHERE sim >= {THRESHOLD})"""


def entries(spark, sf_dir) -> DataFrame:
    return K.entries(K.dedupe(keywords(spark, sf_dir)))


@query(f"WITH {_D1} SELECT * FROM k1")
def d1_keyword_dedupe(spark, sf_dir):
    return K.dedupe(keywords(spark, sf_dir))


@query(f"WITH {_E} SELECT norm, array_to_string(tokens, ' ') AS tokens, array_to_string(stems, ' ') AS stems, array_to_string(ngrams, ' ') AS ngrams FROM e")
def b14_keyword_entries(spark, sf_dir):
    """Tokens, stems and character n-grams of each keyword."""
    return entries(spark, sf_dir).select("norm", *[F.array_join(c, " ").alias(c) for c in ("tokens", "stems", "ngrams")])


_WORDS = ", ".join(f"('{k}', '{w}')" for k, ws in K.INTENTS.items() for w in ws)


@query(
    f"""WITH {_E}, s AS (SELECT norm, unnest(stems) AS stem FROM e), d(label, word) AS (VALUES {_WORDS}),
p AS (SELECT norm, stem, label, max(CASE WHEN stem = word THEN 2 ELSE 1 END) AS p FROM s JOIN d ON starts_with(stem, word) OR starts_with(word, stem) GROUP BY 1, 2, 3),
q AS (SELECT norm, label, sum(p) AS p FROM p GROUP BY 1, 2), r AS (SELECT norm, label, row_number() OVER (PARTITION BY norm ORDER BY p DESC, label) AS r FROM q)
SELECT e.norm, coalesce(label, 'mixed') AS intent FROM e LEFT JOIN r ON r.norm = e.norm AND r = 1"""
)
def b15_keyword_intent(spark, sf_dir):
    return K.intents(entries(spark, sf_dir))


@query(f"WITH {_E}, {_PAIRS} SELECT * FROM pairs")
def c11_similar_keywords(spark, sf_dir):
    return K.similar_pairs(cut(entries(spark, sf_dir)), THRESHOLD, frequent=FREQUENT)


def _grouping(name: str, nodes: str, pairs: str) -> str:
    """Greedy grouping of nodes by pairs: {name}(norm, leader, score). Leaders are found in rounds, as in the operator."""
    return f"""{name}_o AS (SELECT norm, row_number() OVER (ORDER BY len(stems) DESC, len(tokens) DESC, length(display), pos, norm) AS o FROM {nodes}),
{name}_b AS (SELECT p.a, p.b, p.sim FROM (SELECT a, b, sim FROM {pairs} UNION ALL SELECT b, a, sim FROM {pairs}) p JOIN {name}_o x ON x.norm = p.a JOIN {name}_o y ON y.norm = p.b WHERE y.o < x.o),
{name}_s(norm, leads) USING KEY (norm) AS (SELECT norm, TRUE FROM {nodes} WHERE norm NOT IN (SELECT a FROM {name}_b)
 UNION SELECT x.a, NOT bool_or(s.leads) FROM {name}_b x JOIN recurring.{name}_s s ON s.norm = x.b WHERE x.a NOT IN (SELECT norm FROM recurring.{name}_s) GROUP BY x.a HAVING bool_or(s.leads) OR count(*) = (SELECT count(*) FROM {name}_b y WHERE y.a = x.a)),
{name} AS (SELECT s.norm, CASE WHEN s.leads THEN s.norm ELSE j.leader END AS leader, CASE WHEN s.leads THEN 1.0::DOUBLE ELSE j.score END AS score FROM {name}_s s
 LEFT JOIN (SELECT b.a, max_by(b.b, struct_pack(s := b.sim, b := b.b)) AS leader, max(b.sim) AS score FROM {name}_b b JOIN {name}_s l ON l.norm = b.b AND l.leads GROUP BY b.a) j ON j.a = s.norm)"""


def _stems(name: str, groups: str) -> str:
    return f"{name} AS (SELECT *, row_number() OVER (PARTITION BY leader ORDER BY n DESC, stem) AS r FROM (SELECT leader, stem, count(*) AS n FROM (SELECT g.leader, unnest(e.stems) AS stem FROM {groups} g JOIN e ON e.norm = g.norm) GROUP BY 1, 2))"


_MORE = 0.08
_LEAST = f"(({THRESHOLD} + {_MORE} - 0.25) / 0.75)"
_MERGE = f"""{_stems("gs", "ga")}, gt AS (SELECT leader, list(stem ORDER BY r) FILTER (WHERE r <= {K.CENTROID}) AS top, (SELECT count(*) FROM ga WHERE ga.leader = gs.leader) AS size FROM gs GROUP BY leader),
le AS (SELECT e.* FROM e JOIN gt ON gt.leader = e.norm), ls AS (SELECT norm, unnest(stems) AS stem FROM le), lr AS (SELECT stem FROM ls GROUP BY stem HAVING count(*) <= (SELECT greatest(5, floor(count(*) * {FREQUENT})) FROM le)),
lp AS (SELECT DISTINCT x.norm AS a, y.norm AS b FROM ls x JOIN ls y ON x.stem = y.stem AND x.norm < y.norm WHERE x.stem IN (SELECT stem FROM lr)),
lc AS (SELECT a, b, len(list_intersect(ea.stems, eb.stems)) AS common, CAST(len(list_intersect(ea.stems, eb.stems)) AS DOUBLE) / (len(ea.stems) + len(eb.stems) - len(list_intersect(ea.stems, eb.stems))) AS st,
 CAST(len(list_intersect(ea.ngrams, eb.ngrams)) AS DOUBLE) / (len(ea.ngrams) + len(eb.ngrams) - len(list_intersect(ea.ngrams, eb.ngrams))) AS ch, ga_.top AS ta, gb_.top AS tb, ga_.size AS na, gb_.size AS nb
 FROM lp JOIN le ea ON ea.norm = a JOIN le eb ON eb.norm = b JOIN gt ga_ ON ga_.leader = a JOIN gt gb_ ON gb_.leader = b),
ld AS (SELECT *, {rnd_sql("least(1.0, st * 0.82::DOUBLE + ch * 0.18::DOUBLE + CASE WHEN st > 0 AND ch > 0 THEN 0.03::DOUBLE ELSE 0.0 END)", 6)} AS sim, CAST(len(list_intersect(ta, tb)) AS DOUBLE) / least(len(ta), len(tb)) AS overlap FROM lc),
me AS (SELECT a, b, both_ AS sim FROM (SELECT *, {rnd_sql("sim * 0.75::DOUBLE + overlap * 0.25::DOUBLE", 6)} AS both_ FROM ld WHERE sim >= {_LEAST}) WHERE ((both_ >= {THRESHOLD + _MORE} AND (common >= 1 OR overlap >= 0.35)) OR sim >= 0.92) AND NOT (na > 25 AND nb > 25 AND sim < 0.9))"""
_GROUPED = f"WITH RECURSIVE {_E}, {_PAIRS}, {_grouping('ga', 'e', 'pairs')}"
_FINAL = f"""{_GROUPED}, {_MERGE}, {_grouping("gb", "le", "me")},
gm AS (SELECT ga.norm, gb.leader, CASE WHEN gb.leader = ga.leader THEN ga.score ELSE {rnd_sql("ga.score * gb.score", 6)} END AS score FROM ga JOIN gb ON gb.norm = ga.leader), {_stems("ms", "gm")}"""


def _grouped(spark, sf_dir):
    e = cut(entries(spark, sf_dir))
    pairs = cut(K.similar_pairs(e, THRESHOLD, frequent=FREQUENT))
    return e, pairs, cut(K.groups(e, pairs))


def _merged(spark, sf_dir):
    e, pairs, assigned = _grouped(spark, sf_dir)
    return e, pairs, cut(K.merged(e, assigned, THRESHOLD, frequent=FREQUENT))


@query(f"{_GROUPED} SELECT * FROM ga")
def i5_keyword_groups(spark, sf_dir):
    """Every keyword in one group, by its most similar leader."""
    return _grouped(spark, sf_dir)[2]


@query(f"{_FINAL} SELECT norm, leader, score FROM gm")
def i5_merged_groups(spark, sf_dir):
    """The groups after those of similar leaders and stems became one."""
    return _merged(spark, sf_dir)[2]


@query(
    f"""{_FINAL}, d(label, word) AS (VALUES {_WORDS}), p AS (SELECT leader, stem, label, max(CASE WHEN stem = word THEN 2 ELSE 1 END) AS p FROM ms JOIN d ON starts_with(stem, word) OR starts_with(word, stem) GROUP BY 1, 2, 3), q AS (SELECT leader, label, sum(p) AS p FROM p GROUP BY 1, 2),
it AS (SELECT leader, min_by(label, struct_pack(p := -p, l := label)) AS intent FROM q GROUP BY leader), ed AS (SELECT x.leader, sum(sim) AS sims, count(*) AS links FROM pairs JOIN gm x ON x.norm = a JOIN gm y ON y.norm = b AND y.leader = x.leader GROUP BY 1),
sz AS (SELECT leader, count(*) AS size, sum(occurrences) AS occurrences, sum(demand) AS demand FROM gm JOIN e USING (norm) GROUP BY leader), tp AS (SELECT leader, array_to_string(list(stem ORDER BY r), ' / ') AS base FROM ms WHERE r <= 3 GROUP BY leader),
z AS (SELECT sz.leader, size, CAST(occurrences AS BIGINT) AS occurrences, demand, {rnd_sql("demand / sum(demand) OVER () * 100.0", 2)} AS share, CASE WHEN size = 1 THEN 1.0 ELSE {rnd_sql("coalesce(sims, 0.0) / (size * (size - 1) / 2.0)", 4)} END AS cohesion,
 CASE WHEN size = 1 THEN 0.0 ELSE {rnd_sql("coalesce(links, 0) / (size * (size - 1) / 2.0)", 4)} END AS density, coalesce(intent, 'mixed') AS intent, base FROM sz LEFT JOIN ed USING (leader) LEFT JOIN it USING (leader) JOIN tp USING (leader))
SELECT leader, size, occurrences, demand, share, cohesion, density, CASE WHEN cohesion >= 0.78 THEN 'high' WHEN cohesion >= 0.62 THEN 'medium' ELSE 'low' END AS quality, CASE WHEN intent = 'mixed' THEN base ELSE intent || ': ' || base END AS label, intent, {rnd_sql("demand * 0.55::DOUBLE + size * 0.25::DOUBLE + cohesion * 20.0", 2)} AS priority FROM z"""
)
def d26_group_summary(spark, sf_dir):
    e, pairs, assigned = _merged(spark, sf_dir)
    return K.group_profile(e, assigned, pairs)


_LIST = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]"
_BONUS = f"""CASE WHEN len(ws) = 0 THEN 0.0 ELSE CASE WHEN len(ws) BETWEEN 3 AND 6 THEN 0.08 WHEN len(ws) >= 8 THEN -least(0.14, (len(ws) - 7) * 0.02) ELSE 0.0 END + CASE WHEN list_has_any(ws, {_LIST(K.PREPOSITIONS)}) THEN 0.09 ELSE 0.0 END
 + CASE WHEN len(aw) = 0 THEN 0.0 WHEN len(list_distinct(aw)) / len(aw) >= 0.9 THEN 0.03 WHEN len(list_distinct(aw)) / len(aw) <= 0.6 THEN -0.06 ELSE 0.0 END + CASE WHEN len(list_filter(ws, lambda w: length(w) >= 18)) >= 2 THEN -0.06 ELSE 0.0 END + CASE WHEN length(regexp_replace(lower(display), '[^0-9]', '', 'g')) / greatest(1, length(regexp_replace(display, '\\s+', '', 'g'))) >= 0.35 THEN -0.08 ELSE 0.0 END END"""


@query(
    f"""{_FINAL}, co AS (SELECT leader, list(stem) FILTER (WHERE r <= {K.CORE}) AS core FROM ms GROUP BY leader), sz AS (SELECT leader, count(*) AS size FROM gm GROUP BY leader), he AS (SELECT norm, sum(n) AS held FROM (SELECT g.norm, g.leader, unnest(e.stems) AS stem FROM gm g JOIN e ON e.norm = g.norm) JOIN ms USING (leader, stem) GROUP BY norm),
m AS (SELECT e.*, g.leader, g.score, core, size, held, max(demand) OVER (PARTITION BY g.leader) AS best, regexp_extract_all(lower(display), '[\\p{{L}}\\p{{N}}_]+') AS ws FROM e JOIN gm g ON g.norm = e.norm JOIN co ON co.leader = g.leader JOIN sz ON sz.leader = g.leader JOIN he ON he.norm = e.norm),
k AS (SELECT *, list_filter(ws, lambda w: regexp_matches(w, '[a-zа-я]')) AS aw, CASE WHEN len(tokens) BETWEEN 2 AND 6 THEN 0.07 WHEN len(tokens) >= 9 THEN -0.05 ELSE 0.0 END AS shape,
 CASE WHEN len(tokens) <= 1 THEN 0.28 WHEN len(tokens) >= 8 THEN least(0.45, 0.06 * (len(tokens) - 7)) ELSE 0.0 END + CASE WHEN length(display) >= 70 THEN least(0.35, (length(display) - 70) / 90.0) ELSE 0.0 END + CASE WHEN list_has_any(stems, {_LIST(K.NOISE_STEMS)}) AND len(tokens) >= 4 THEN 0.08 ELSE 0.0 END AS penalty FROM m),
f AS (SELECT *, {rnd_sql(f"CASE WHEN best > 0 THEN ln(1 + demand) / ln(1 + best) ELSE 0.0 END * 0.55::DOUBLE + len(list_intersect(stems, core)) / len(core) * 0.2::DOUBLE + held / (size * len(stems)) * 0.1::DOUBLE + score * 0.08::DOUBLE + shape + {_BONUS} - penalty", 6)} AS rep FROM k)
SELECT leader, display AS representative, rep AS score FROM (SELECT *, row_number() OVER (PARTITION BY leader ORDER BY rep DESC, demand DESC, len(tokens), length(display), display) AS r FROM f) WHERE r = 1"""
)
def e7_group_representatives(spark, sf_dir):
    e, _, assigned = _merged(spark, sf_dir)
    return K.representatives(e, assigned)


@query(f"WITH {_D1} SELECT norm, demand, {rnd_sql('demand / sum(demand) OVER () * 100.0', 4)} AS share FROM k1")
def e6_demand_share(spark, sf_dir):
    """Share of each keyword in all demand."""
    k = K.dedupe(keywords(spark, sf_dir))
    total = F.broadcast(k.agg(F.sum("demand").alias("total")))
    return k.crossJoin(total).select("norm", "demand", rnd(F.col("demand") / F.col("total") * 100.0, 4).alias("share"))


@query(f"WITH {_D1} SELECT display, demand, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (ORDER BY demand DESC, length(display), display) AS rank FROM k1) WHERE rank <= 100")
def f1_top_keywords(spark, sf_dir):
    """A report of the hundred most wanted keywords."""
    k = K.dedupe(keywords(spark, sf_dir))
    return top_k(k, [], [F.desc("demand"), F.length("display").asc(), F.asc("display")], 100).select("display", "demand", "rank")
