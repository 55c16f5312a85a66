"""Small literal cases of the web operators."""

import hashlib
import math
import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from crawlframe.functions import text as T
from crawlframe.functions import urls as U
from crawlframe.functions.rules import Rule, health, issues
from crawlframe.operators import backlinks, corpus, events, graph, html, keywords, markup, sampling, site_files
from crawlframe.plans import score_queries, text_queries
from crawlframe.sources import readers, sinks
from crawlframe.sources.scratch import scratch_path


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column).first()[0]


def test_three_page_site_pagerank(spark):
    nodes = spark.createDataFrame([("/",), ("/about",), ("/blog",)], "node string")
    edges = spark.createDataFrame([("/", "/about"), ("/", "/blog"), ("/about", "/"), ("/blog", "/")], "src string, dst string")
    assert rows(graph.pagerank(edges, nodes)) == [("/", 100.0), ("/about", 54.05), ("/blog", 54.05)]
    assert rows(graph.click_depth(edges, "/about")) == [("/", 1), ("/about", 0), ("/blog", 2)]
    assert rows(graph.pagerank(edges.limit(0), nodes.limit(0))) == []


def test_dangling_mass_is_kept(spark):
    nodes = spark.createDataFrame([("a",), ("b",)], "node string")
    edges = spark.createDataFrame([("a", "b")], "src string, dst string")
    got = dict(rows(graph.pagerank(edges, nodes)))
    assert got["b"] == 100.0 and 50 < got["a"] < 60


def test_redirect_chain_with_a_loop(spark):
    hops = spark.createDataFrame([("a", "b", 301), ("b", "c", 302), ("x", "y", 301), ("y", "x", 301)], "from string, to string, status int")
    got = {r.start: r for r in graph.redirect_chains(hops).collect()}
    assert (got["a"].hops, got["a"].final, got["a"].loop, got["a"].statuses) == (2, "c", False, "301>302") and got["a"].permanent and got["a"].temporary
    assert got["x"].loop and got["y"].loop


@pytest.mark.parametrize("url, host, domain", [("https://www.shop.example.co.uk:8080/x", "www.shop.example.co.uk", "example.co.uk"), ("blog.example.com/a", "blog.example.com", "example.com"), ("http://10.0.0.1/", "10.0.0.1", "10.0.0.1")])
def test_domains(spark, url, host, domain):
    assert one(spark, U.host(F.col("x")), url) == host
    assert one(spark, U.registrable(U.host(F.col("x"))), url) == domain


def test_normalised_url(spark):
    assert one(spark, U.normalised(F.col("x")), "HTTPS://Example.COM/Path/#top") == "https://example.com/Path"


def test_text_features(spark):
    assert one(spark, T.tokens(F.col("x")), "The quick, brown fox and the café 42 of 2024") == ["quick", "brown", "fox", "caf", "2024"]
    assert one(spark, T.words(F.col("x")), "The café was nice_one ok 42") == ["The", "was", "ok", "42"]
    assert one(spark, T.readability(T.words(F.col("x")), T.sentences(F.col("x"))), "") == 0.0
    assert one(spark, T.flesch(F.col("x")), "The cat sat. The dog ran.") == 100.0


def test_anchor_classes(spark):
    words = {"brand": ["acme"], "commercial": ["buy"], "generic": ["here"], "spam": ["casino"], "navigational": ["login"]}
    cases = {"": "empty", "https://a.com": "naked_url", "acme.com": "naked_url", "Buy ACME": "brand_commercial", "acme login": "brand_navigational", "acme": "brand", "buy it": "commercial", "casino acme": "spam", "click here": "generic", "ok": "generic", "some long words": "other"}
    df = spark.createDataFrame([(k,) for k in cases], "x string").select("x", backlinks.anchor_class(F.col("x"), words).alias("c"))
    assert dict(rows(df)) == cases


LINK = "source_domain string, target_domain string, target_url string, follow boolean, lost boolean, dr double, ur double, traffic double, http_code string, ugc boolean, sponsored boolean"


def test_donor_classes_and_overlap(spark):
    pairs = [("d1", "me.com"), ("d1", "c1.com"), ("d2", "me.com"), ("d3", "c1.com"), ("d4", "c1.com"), ("d4", "c2.com")]
    links = spark.createDataFrame([(s, t, f"https://{t}/", True, False, None, 1.0, None, "200", None, None) for s, t in pairs], LINK)
    got = {r.domain: r["class"] for r in backlinks.donor_classes(links, "me.com").collect()}
    assert got == {"d1": "with_ours", "d2": "only_ours", "d3": "single_competitor", "d4": "several_competitors"}
    c1 = backlinks.overlap(links, "me.com").where("competitor_domain = 'c1.com'").first()
    assert (c1.shared_ref_domains, c1.competitor_only_domains, c1.our_only_domains, c1.overlap_pct) == (1, 2, 1, 33.33)
    stats = backlinks.donor_stats(links).where("domain = 'd1'").first()
    assert (stats.links, stats.avg_dr, stats.http2xx_rate) == (2, 0.0, 1.0)
    assert rows(backlinks.donor_classes(links.limit(0), "me.com")) == []


@pytest.mark.parametrize("order", [1, -1])
def test_best_metric_row_does_not_depend_on_order(spark, order):
    data = [("a.com", 50.0, 10.0, None, 1.0), ("a.com", 40.0, 10.0, 5.0, 1.0)][::order]
    df = spark.createDataFrame(data, "domain string, dr double, traffic double, backlinks_all double, ref_domains_all double")
    assert rows(backlinks.best_metrics(df)) == [("a.com", 40.0, 10.0, 5.0, 1.0)]


def test_velocity(spark):
    links = spark.createDataFrame([(date(2024, 1, 5), date(2024, 2, 1), True), (date(2024, 2, 9), None, False)], "first_seen date, last_seen date, lost boolean")
    assert rows(backlinks.velocity(links)) == [("2024-01", 1, 0, 1), ("2024-02", 1, 1, 0)]


def test_keyword_groups_equal_a_greedy_pass(spark):
    words = ["red running shoes", "running shoes", "red shoes", "blue hats", "blue hat", "cheap flights", "flights cheap", "garden"]
    raw = spark.createDataFrame([(w, 1.0, i) for i, w in enumerate(words)], "keyword string, frequency double, pos int")
    e = keywords.entries(keywords.dedupe(raw)).cache()
    pairs = keywords.similar_pairs(e, 0.5, frequent=1.0).cache()
    got = {r.norm: r for r in keywords.groups(e, pairs).collect()}
    info = {r.norm: (-len(r.stems), -len(r.tokens), len(r.display), r.pos, r.norm) for r in e.collect()}
    near = {}
    for r in pairs.collect():
        near.setdefault(r.a, {})[r.b] = near.setdefault(r.b, {})[r.a] = r.sim
    leaders = []
    for n in sorted(info, key=info.get):
        if not any(x in near.get(n, {}) for x in leaders):
            leaders.append(n)
    assert {n for n, r in got.items() if r.leader == n} == set(leaders)
    assert set(got) == set(info)
    for n, r in got.items():
        assert r.leader in leaders and (r.leader == n or near[n][r.leader] == max(near[n][x] for x in leaders if x in near[n] and info[x] < info[n]))
    summary = {r.leader: r for r in keywords.group_summary(e, keywords.groups(e, pairs), pairs).collect()}
    assert sum(r["size"] for r in summary.values()) == len(info)
    assert keywords.representatives(e, keywords.groups(e, pairs)).count() == len(leaders)


def test_keyword_dedupe_keeps_the_first_spelling(spark):
    raw = spark.createDataFrame([("SEO_Audit", 2.0, 1), ("seo audit!", 3.0, 2), (" ", 1.0, 3), ("ёлка", -1.0, 4)], "keyword string, frequency double, pos int")
    assert rows(keywords.dedupe(raw)) == [("seo audit", 2, 5.0, "SEO_Audit", 1), ("елка", 1, 0.0, "ёлка", 4)]


def test_hamming_pairs_find_all(spark):
    import random

    rng = random.Random(3)
    base = [rng.getrandbits(63) for _ in range(30)]
    values = [*base, *(b ^ sum(1 << i for i in rng.sample(range(62), k)) for k, b in enumerate(base[:9]))]
    df = spark.createDataFrame(list(enumerate(values)), "doc_id long, simhash long")
    want = sorted((i, j, (a ^ b).bit_count()) for i, a in enumerate(values) for j, b in enumerate(values) if i < j and 0 < (a ^ b).bit_count() <= 6)
    assert rows(corpus.hamming_pairs(df)) == want


def test_near_hashes_shuffle_no_pairs(spark):
    import random

    rng = random.Random(4)
    base = rng.getrandbits(62)
    values = [base ^ sum(1 << i for i in rng.sample(range(62), 3)) for _ in range(60)] + [base, base]
    df = spark.createDataFrame(list(enumerate(values)), "doc_id long, simhash long")
    pairs = corpus.hamming_pairs(df)
    assert len(rows(pairs)) == len(set(values)) * (len(set(values)) - 1) // 2
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan[: plan.index("Join")]
    first = {v: values.index(v) for v in values}
    near = lambda v: sum(0 < (v ^ w).bit_count() <= 6 for w in values)
    assert sorted(rows(corpus.hamming_neighbours(df))) == sorted((i, values.count(v), values.count(v) - 1 + near(v)) for v, i in first.items())


def test_keys_of_hashes_are_not_broadcast(spark):
    """A row for each choice of blocks looks like one a hash to Spark, which would gather those of a million hashes in the driver."""
    df = graph.cut(spark.range(200).select(F.col("id").alias("doc_id"), F.xxhash64("id").alias("simhash")))
    for found in (corpus.hamming_pairs(df, 1, 3), corpus.hamming_neighbours(df, 1, 3)):
        found.collect()
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin [left_out" in plan and "BroadcastHashJoin [left_out" not in plan


def test_group_shares_need_no_window_over_all_groups(spark):
    e = spark.createDataFrame([("a", 30), ("b", 30), ("c", 20)], "norm string, demand long")
    assigned = spark.createDataFrame([("a", "a"), ("b", "a"), ("c", "c")], "norm string, leader string")
    pairs = spark.createDataFrame([("a", "b", 0.9)], "a string, b string, sim double")
    found = keywords.group_summary(e, assigned, pairs)
    assert rows(found) == [("a", 2, 60, 75.0, 0.9, "high"), ("c", 1, 20, 25.0, 1.0, "high")]
    assert "Window" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_chunks_reach_the_end_of_a_long_text(spark):
    text = "".join(chr(97 + i % 26) for i in range(128_657))
    got = corpus.chunks(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("idx").collect()
    assert len(got) == 117 and "".join(r.chunk[: 1200 if i == 116 else 1100] for i, r in enumerate(got)) == text


def test_chunks_and_duplicates(spark):
    docs = spark.createDataFrame([(1, "x" * 2500), (2, ""), (3, None), (4, "abc")], "doc_id long, text string")
    assert [(r.doc_id, r.idx, len(r.chunk)) for r in corpus.chunks(docs).orderBy("doc_id", "idx").collect()] == [(1, 1, 1200), (1, 2, 1200), (1, 3, 300), (4, 1, 3)]
    c = spark.createDataFrame([(1, 1, "alpha beta gamma"), (1, 2, "delta words other"), (1, 3, "Alpha, beta gamma!")], "doc_id long, idx int, chunk string")
    assert [r.duplicate for r in corpus.chunk_duplicates(c).orderBy("idx").collect()] == [False, False, True]


ROBOTS = "# c\nUser-agent: *\nDisallow: /private\nAllow: /private/open\n\nUser-agent: Googlebot\nUser-agent: Bingbot\nDisallow:\nbroken\nSitemap: https://x/s.xml"


def test_robots(spark):
    rules = site_files.directives(spark.createDataFrame([("h", ROBOTS)], "host string, text string"))
    assert rules.where("key = 'user-agent'").select("group_id", "value").orderBy("line").collect() == [(1, "*"), (2, "Googlebot"), (2, "Bingbot")]
    assert rules.where("key = 'syntax_error'").count() == 1
    bots = spark.createDataFrame([("Googlebot",), ("OtherBot",)], "bot string")
    paths = spark.createDataFrame([("h", "/private/a"), ("h", "/private/open/b"), ("h", "/x")], "host string, path string")
    got = {(r.bot, r.path): r.allowed for r in site_files.access(rules, bots, paths).collect()}
    assert got == {("Googlebot", "/private/a"): True, ("Googlebot", "/private/open/b"): True, ("Googlebot", "/x"): True, ("OtherBot", "/private/a"): False, ("OtherBot", "/private/open/b"): True, ("OtherBot", "/x"): True}
    assert site_files.lint(rules).first().syntax_errors == 1


def test_elements_survive_bad_markup(spark):
    page = '<html><body><script>var t="</p>";</script><h1>A</h1><p>one<p>two <b>x</b><img src="a.png"><h3>B</h3></body>'
    el = html.elements(spark.createDataFrame([(1, page), (2, None), (3, "")], "page_id long, html string"))
    assert [r.tag for r in el.where("page_id = 1").orderBy("pos").collect()] == ["html", "body", "script", "h1", "p", "p", "b", "img", "h3"]
    assert el.where("tag = 'img'").first().attrs == {"src": "a.png"}
    assert rows(html.heading_outline(el)) == [(1, 2, 1, 1, 0)]


def test_rules(spark):
    df = spark.createDataFrame([(1, ""), (2, "t"), (3, None)], "id int, title string")
    catalogue = [Rule("missing", "warning", 20, F.col("title") == ""), Rule("short", "info", 5, F.length("title") < 2)]
    assert rows(issues(df, catalogue, ["id"]).select("id", "code")) == [(1, "missing"), (1, "short"), (2, "short")]
    assert rows(health(df, catalogue).select("id", "health")) == [(1, 75.0), (2, 95.0), (3, 100.0)]


def test_vitals(spark):
    v = spark.createDataFrame([("a", "lcp", 2000.0), ("a", "inp", 100.0), ("a", "cls", 0.05), ("b", "lcp", 5000.0)], "site string, metric string, value double")
    s = events.leaderboard(events.site_snapshots(v))
    assert rows(s.select("rank", "site", "status")) == [(1, "a", "good"), (2, "b", "poor")]


def test_export_aliases_and_keyword_lines(spark):
    df = spark.createDataFrame([("http://a", " ", "12,5")], ["Referring page URL", "Source", "Domain Rating"])
    got = readers.pick_fields(df, {"source_url": readers.ALIASES["source_url"], "dr": readers.ALIASES["dr"], "lost": ["lost"]}).select("source_url", readers.number(F.col("dr")).alias("dr"), "lost").first()
    assert tuple(got) == ("http://a", 12.5, None)
    lines = spark.createDataFrame([(1, "red shoes\t10"), (2, "blue hats"), (3, "a; b, c"), (4, "12345"), (5, "x,7"), (6, "")], "pos int, line string")
    assert rows(readers.parse_keyword_lines(lines)) == [(1, "red shoes", 10.0), (2, "blue hats", 1.0), (3, "a", 1.0), (3, "b", 1.0), (3, "c", 1.0), (5, "x", 7.0)]


def test_sinks(spark):
    path = scratch_path(spark, "t")
    manifest = sinks.write_chunked_json(spark.range(25).repartition(3), path, ["id"], 10)
    lines = ["".join(f'{{"id":{i}}}\n' for i in range(a, min(a + 10, 25))) for a in (0, 10, 20)]
    assert rows(manifest) == [(k, x.count("\n"), len(x), hashlib.sha256(x.encode()).hexdigest()) for k, x in enumerate(lines)]
    assert rows(spark.read.json(path)) == sorted(((i, i // 10) for i in range(25)), key=repr)  # readers pass over the manifest
    scores = spark.createDataFrame([("b.com", 60.0), ("a.com", 90.0), ("c.com", 10.0), ("a.com", 70.0)], "domain string, score double")
    assert rows(sinks.disavow_lines(scores, 55)) == [("domain:a.com",), ("domain:b.com",)]


@pytest.mark.parametrize("n", [0, 1, 7, 100])
def test_spread(spark, n):
    df = spark.range(n).repartition(3)
    k = 5
    want = sorted({int(i * (n - 1) / (k - 1) + 0.5) for i in range(k)}) if n else []
    assert [r.id for r in sampling.spread(df, ["id"], k).orderBy("id").collect()] == want


@pytest.mark.parametrize("n, words, listed", [(6, 40, 12), (30, 60, 12), (9, 14, 5), (10, 12, 12)])
def test_semantic_links_equal_all_pairs_where_terms_are_frequent(spark, n, words, listed):
    rng = random.Random(n)
    rows = [(d, f"w{t:02}") for d in range(70) for t in rng.sample(range(words), n)] + [(100 + d, f"w{t:02}") for d in range(6) for t in range(3)] + [(200, "alone"), (201, "rare"), (202, "rare")]
    got = corpus.semantic_links(spark.createDataFrame(rows, "doc_id long, term string"), k=5, rare=3, listed=listed).collect()
    held = {}
    for d, t in rows:
        held.setdefault(d, set()).add(t)
    for d, own in held.items():
        best = sorted(((-len(own & other), e, min(own & other)) for e, other in held.items() if e != d and own & other))[:5]
        assert [(r.dst, r.relevance, r.suggested_anchor) for r in sorted(got, key=lambda r: r.rank) if r.src == d] == [(e, -m, a) for m, e, a in best], d


def test_sets_of_frequent_terms_stop_where_few_hold_them(spark):
    # All pairs of frequent terms are shared, no three terms are: a document's sets must not be all of its terms' subsets.
    spans = [(i, j) for i in range(10) for j in range(i)]
    rows = [(n, f"n{n}", [f"w{i}", f"w{j}"]) for n, (i, j) in enumerate(spans * 2)] + [(900, "x", [f"w{i}" for i in range(10)]), (901, "y", [f"w{i}" for i in range(10)])]
    classes = spark.createDataFrame([(n, 1, sorted(often)) for n, _, often in rows], "cid long, n long, often array<string>")
    frequent, few = corpus._frequent_sets(classes, 3)
    assert sorted((r["size"], r["count"]) for r in frequent.groupBy("size").count().collect()) == [(1, 200), (2, 180)]
    assert [(r["size"], r["count"]) for r in few.groupBy("size").count().collect()] == [(3, 240)]
    links = corpus.semantic_links(spark.createDataFrame([(n, t) for n, _, often in rows for t in often], "doc_id long, term string"), k=3, rare=3)
    got = {n: [(r.dst, r.relevance) for r in sorted(links.where(f"src = {n}").collect(), key=lambda r: r["rank"])] for n in (0, 900)}
    assert got == {0: [(45, 2), (900, 2), (901, 2)], 900: [(901, 10), (0, 2), (1, 2)]}


def test_best_matches_equal_the_join_of_all(spark):
    rng = random.Random(3)
    words = [a + b + c for a in "bcdfg" for b in "aei" for c in "klmn"]
    some = lambda n: [(i, " ".join(rng.choices(words, k=rng.randint(0, 30)))) for i in range(n)]
    items, docs = spark.createDataFrame([(i + 100, t) for i, t in some(12)], "doc_id long, text string"), spark.createDataFrame([*some(300), (900, None), (901, "")], "doc_id long, text string").repartition(5)
    for tf_idf in (False, True):
        want = {}
        for r in corpus.cosine_join(items, docs, tf_idf).collect():
            want.setdefault(r.a, []).append((-r.cosine, r.b))
        got = {}
        for r in sorted(corpus.best_matches(items, docs, 4, tf_idf, digits=6).collect(), key=lambda r: r["rank"]):
            got.setdefault(r.a, []).append((-r.score, r.b))
        for a, best in want.items():
            assert [b for _, b in got[a]] == [b for _, b in sorted((-math.floor(-c * 1e6 + 0.5), b) for c, b in best)[:4]]
    assert corpus.best_matches(items.limit(0), docs, 4).count() == 0


def test_style_metrics_work_the_mean_out_once_and_shuffle_nothing(spark, tmp_path):
    # 30,000 sentences: the mean within each of them took some 900 million steps.
    texts = ["Maybe a cat. " + "one two three. word! " * 15_000, "", None, "to"]
    spark.createDataFrame([(i, t, "en", "web", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    found = text_queries.h8_style_metrics(spark, str(tmp_path))
    assert "Exchange hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()
    got = {r.doc_id: r for r in found.collect()}
    n = [3] + [3, 1] * 15_000
    mean = sum(n) / len(n)
    assert got[0].burstiness_cv == round(math.sqrt(sum((x - mean) ** 2 for x in n) / len(n)) / mean, 4)
    assert [got[i].perplexity_proxy for i in (1, 2, 3)] == [1.0, 1.0, 1.0]


def test_words_signs_and_signals_equal_their_plain_patterns(spark):
    parts = ["ai", "http", "xhttp", "apis", "_api", "tls.", "\U0001d400ai", "\U0001f600ai", "sais ai", "ai\n", "я", "É", "ß!", "+49 (30) 123-45 6", "12345678", "a.b@c.de", "@c.de", "a@b.c", "e-mail", "review", "award", "terms", "call us", ",;:", "\U0001d400"]
    rng = random.Random(6)
    texts = ["", None, *parts, *("".join(rng.choices([*parts, " ", "."], k=rng.randint(2, 6))) for _ in range(400))]
    x = F.col("x")
    plain = lambda some: x.rlike(rf"(^|[^\p{{L}}\p{{N}}_])({some})([^\p{{L}}\p{{N}}_]|$)")
    tech = ("api", "sdk", "json", "http", "ssl", "tls", "csp")
    signals = markup.trust_signals(x)
    low = F.lower(x)
    contact = low.rlike(r"(\+?\d[\d\s\-()]{7,}\d)|([a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,})|contact|phone|call us|support|help center|e-?mail")
    pairs = {
        "ai": (T.has_word(x, "ai"), plain("ai")),
        "tech": (T.has_word(x, *tech), plain("|".join(tech))),
        "upper": (T.count_chars(x, r"\P{Lu}+"), F.regexp_count(x, F.lit(r"\p{Lu}"))),
        "letters": (T.count_chars(x, r"\P{L}+"), F.regexp_count(x, F.lit(r"\p{L}"))),
        "signs": (T.count_chars(x, "[^!?.,;:]+"), F.regexp_count(x, F.lit("[!?.,;:]"))),
        "contact": (signals["contact"], contact),
        "legal": (signals["legal"], low.rlike("privacy|terms|policy|cookie|gdpr|ccpa|disclaimer")),
        "badges": (signals["badges"], low.rlike("certified|award|guarantee|verified")),
    }
    frame = spark.createDataFrame([(t,) for t in texts], "x string")
    for name, (a, b) in pairs.items():
        assert frame.where(~a.eqNullSafe(b)).collect() == [], name


def test_cosine_of_a_text_and_its_beginning_is_counted_in_the_row(spark):
    import re
    from collections import Counter

    from crawlframe.functions.text import STOP_WORDS
    from crawlframe.plans import registry

    texts = [None, "", "ab", "pump pump valve", "pumpstation", "the thermal there", "pump PUMP, İpump valve-valve 123 пример Примеры ΣΑΣ", "abc " * 40 + "abcabc", "and andes and andes the then", "x" * 50 + " xxx xxxx xxxxx", "Ёлка ёлка лка abc1 abc 1abc"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(100 + n, "valves and valve, pumps; pump 12 123 then there the"[:n]) for n in range(50)]
    tokens = lambda t: Counter(w for w in re.findall("[A-Za-zА-Яа-я0-9]{3,}", t.lower()) if w not in STOP_WORDS)
    want = {}
    for i, t in rows:
        a, b = tokens(t or ""), tokens((t or "")[: math.floor(len(t or "") * 0.7)])
        dot = sum(a[x] * b[x] for x in a)
        want[i] = dot / math.sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values())) if dot else 0.0
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = corpus.beginning_cosines(docs, F.floor(F.length("text") * 0.7).cast("int"))
    assert {r.doc_id: round(r.cosine, 9) for r in got.collect()} == {k: round(v, 9) for k, v in want.items()}
    plan = registry.queries()["c28_three_way_difference"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan


def test_times_of_hops_are_added_up_on_the_way(spark):
    hops = [("a", "b", 301, 5), ("b", "c", 302, 7), ("x", "y", 301, 1), ("y", "x", 301, 2), ("z", "z", 301, 4)]
    got = graph.hop_times(spark.createDataFrame(hops, "from string, to string, status int, ms long"))
    assert rows(got) == [("a", 2, 12), ("b", 1, 7), ("x", 2, 3), ("y", 2, 3), ("z", 1, 4)]
    assert "Aggregate" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_best_matches_are_the_same_whatever_terms_are_common_and_cut_no_text_twice(spark):
    rng = random.Random(5)
    words = [a + b + c for a in "bcdfg" for b in "aei" for c in "klmn"]
    texts = [(i, " ".join(rng.choices(words, weights=range(1, len(words) + 1), k=rng.randint(1, 30)))) for i in range(3000)]
    items, docs = spark.createDataFrame(texts[:15], "doc_id long, text string"), spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    want = {}
    for r in corpus.cosine_join(items, docs, True).collect():
        want.setdefault(r.a, []).append((-math.floor(r.cosine * 1e6 + 0.5), r.b))
    for common in (0, 20, 1000):
        cut = docs.select("doc_id", corpus.content_tokens(F.col("text")).alias("tokens"))
        got = sorted((r.a, r["rank"], r.b) for r in corpus.best_matches(items, cut, 5, True, digits=6, common=common).collect())
        assert got == [(a, i + 1, b) for a in sorted(want) for i, (_, b) in enumerate(sorted(want[a])[:5])]
    names = spark.createDataFrame([(x,) for x in ("", "Abc", "aAbc Abc_ Ab Ábc AbcÁ Жук ЖукЖ9 _Abc Abc-Def", "Abć A\U0001d400bc Abc\U0001d400")], "x string")
    plain = F.size(F.filter(T.all_of(F.col("x"), T.RUN), lambda v: v.rlike("^[A-ZА-Я][A-Za-zА-Яа-я0-9]{2,}$")))
    assert names.where(plain != F.regexp_count("x", F.lit(score_queries.NAMED))).count() == 0


def test_pagerank_of_pages_with_several_rows_of_links_equals_plain_rounds(spark, monkeypatch):
    monkeypatch.setattr(graph, "LINKS_A_ROW", 3)
    rng = random.Random(8)
    names = [f"p{i}" for i in range(30)]
    links = sorted({("p0", x) for x in names[5:]} | {(rng.choice(names[:20]), rng.choice(names)) for _ in range(60)})
    score, out = dict.fromkeys(names, 1 / 30), {x: sum(a == x for a, _ in links) for x in names}
    for _ in range(20):
        lost = sum(s for x, s in score.items() if not out[x])
        score = {x: 0.15 / 30 + 0.85 * sum(score[a] / out[a] for a, b in links if b == x) + 0.85 * lost / 30 for x in names}
    found = graph.pagerank(spark.createDataFrame(links, "src string, dst string"), spark.createDataFrame([(x,) for x in names], "node string"))
    assert {r.node: r.pagerank for r in found.collect()} == pytest.approx({x: s / max(score.values()) * 100 for x, s in score.items()}, abs=0.006)


def test_tfidf_is_the_same_whatever_terms_are_common(spark):
    rng = random.Random(9)
    words = [f"word{i}" for i in range(40)]
    docs = spark.createDataFrame([(i, " ".join(rng.choices(words, weights=range(1, 41), k=rng.randint(0, 25)))) for i in range(200)] + [(900, None)], "doc_id long, text string").repartition(3)
    found = [sorted(map(tuple, corpus.tfidf(docs, 8, 3, common=n).collect())) for n in (0, 12, 1000)]
    assert found[0] == found[1] == found[2] and len(found[0]) > 400
    df = spark.createDataFrame([("a", 9), ("b", 8), ("c", 4), ("d", 1)], "term string, df long")
    assert [sorted(r.term for r in corpus._common(df, n).collect()) for n in (0, 1, 2, 3, 9)] == [[], [], ["a", "b"], ["a", "b", "c"], ["a", "b", "c", "d"]]
