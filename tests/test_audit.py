"""Page audit, structured data, sources, ranks and links on small literal cases."""

import random

import pytest
from pyspark.sql import functions as F

from crawlframe.functions import common
from crawlframe.functions.rules import issues
from crawlframe.operators import corpus, graph, html, keywords, markup, page_audit, sampling, site_files
from crawlframe.sources import readers
from crawlframe.sources.scratch import scratch_path
from crawlframe.streaming import jobs

PAGE = "page_id long, url string, html string, code int, ms long, headers map<string,string>"
GOOD = (
    "<html lang='en'><head><title>A good page about red lamps</title><meta charset='utf-8'><meta name='description' content='All about lamps'>"
    "<meta content='width=device-width' name='viewport'><link href='https://x.example.com/lamps' rel='canonical'><script src='/a.js' defer></script></head>"
    "<body><h1>Lamps</h1><h2>Red</h2><ul><li>one</li></ul><a href='/buy'>Buy now</a><img src='a.webp' alt='A lamp'>" + "<p>" + "lamps light rooms well. " * 80 + "</p></body></html>"
)
BAD = "<html><head><title></title><meta name=\"robots\" content=\"NOINDEX\"></head><body><h3>Deep</h3><img src='b.png'><img src='b.png' alt='image'><div hidden>secret words</div><p>few words</p></body></html>"


@pytest.fixture(scope="module")
def audited(spark):
    rows = [
        (1, "https://x.example.com/lamps", GOOD, 200, 300, {"Content-Encoding": "gzip", "cache-control": "max-age=9"}),
        (2, "http://x.example.com/a/b/c/d/e?x=1", BAD, 404, 2000, {}),
        (3, "https://x.example.com/", None, 200, None, None),
    ]
    f = page_audit.markup_features(spark.createDataFrame(rows, PAGE))
    f = page_audit.with_page_type(page_audit.text_features(f), [("product", ("shop",)), ("service", ("contact",))], ("terms",))
    return page_audit.derived(page_audit.top_shares(f).withColumns({"structured_errors": F.lit(0), "valid_json_ld": F.lit(0)})).cache()


def test_page_rules(audited):
    got = {}
    for r in issues(audited, page_audit.page_rules(), ["page_id"]).collect():
        got.setdefault(r.page_id, set()).add(r.code)
    assert len(page_audit.RULES) == 28 and 1 not in got
    assert {"http_status_error", "missing_title", "noindex_detected", "h1_hierarchy_issue", "non_https_url", "duplicate_image_sources", "generic_alt_texts", "hidden_content_css", "crawl_budget_risk_high", "thin_content"} <= got[2]
    assert "missing_meta_description" in got[2] and "cloaking_detected" not in got[2]


def test_features_and_scores(audited):
    r = {x.page_id: x for x in audited.collect()}
    assert (r[1].title, r[1].canonical_status, r[1].indexability_reason, r[1].outline) == ("A good page about red lamps", "self", "indexable", "good")
    assert (r[1].blocking_scripts, r[1].images, r[1].modern_images, r[1].cta) == (0, 1, 1, 1)
    assert (r[2].indexability_reason, r[2].outline, r[2].images_no_alt, r[2].repeated_images) == ("http_error", "wrong start", 1, 1)
    assert r[1].perf_light == 100.0 and r[2].perf_light == 90.0 and r[1].top_term_pct > 20


def test_onpage_rules_take_limits(audited):
    codes = lambda limits: {r.code for r in issues(audited.where("page_id = 1"), page_audit.onpage_rules(limits), ["page_id"]).collect()}
    assert "title_length_out_of_range" in codes(None) and "title_length_out_of_range" not in codes({"title_min": 5})
    assert {"opengraph_missing_required", "schema_missing", "top_term_spam"} <= codes(None)


def test_structured_data(spark):
    scripts = [
        '[{"@type":["Product","Thing"],"name":"n","offers":[{"price":1,"priceCurrency":"EUR"}]},{"@graph":[{"@type":"Article","headline":"h"}]}]',
        '{"@type":"https://schema.org/FAQPage","mainEntity":[]}',
        '{"@type":"Organization", broken',
    ]
    body = "".join(f'<script type="application/ld+json">{s}</script>' for s in scripts) + '<i itemscope itemtype="https://schema.org/Person"></i><b typeof="schema:Event"></b>'
    pages = spark.createDataFrame([(1, body), (2, None), (3, "")], "page_id long, html string")
    types = {(r.syntax, r.type) for r in markup.structured_types(pages).collect()}
    assert types == {("json-ld", "product"), ("json-ld", "thing"), ("json-ld", "article"), ("json-ld", "faqpage"), ("json-ld", "organization"), ("microdata", "person"), ("rdfa", "event")}
    codes = {r.code for r in markup.structured_issues(markup.structured_objects(pages)).collect()}
    assert codes == {"article_missing_date_published", "article_missing_author", "faq_missing_main_entity"}


def test_hidden_content(spark):
    cases = ['<div style="display: none">four words are hidden</div>', '<i class="fa-x" aria-hidden="true">icon text</i>', '<p aria-hidden="true">not read aloud</p>', '<pre hidden>code code</pre>', '<p style="font-size:3px">tiny print</p>', "<p>plain</p>", '<b hidden>abc</b>']
    found = spark.createDataFrame(list(enumerate(cases)), "id int, html string").select("id", markup.hidden_content(F.col("html")).alias("h")).orderBy("id").collect()
    assert [(r.h.nodes, r.h.chars) for r in found] == [(1, 21), (0, 0), (1, 14), (0, 0), (1, 10), (0, 0), (0, 0)]


def test_odd_markup_does_not_stop_the_tokenizer(spark):
    pages = [(1, "<p>a<![foo[ x ]]><b>c</b>"), (2, None), (3, "<a href=x"), (4, "<!DOCTYPE [<!x>]><i>d</i>"), (5, "<p>ok</p>")]
    got = html.elements(spark.createDataFrame(pages, "page_id long, html string")).collect()
    assert {(r.page_id, r.tag) for r in got} >= {(1, "p"), (1, "b"), (5, "p")}


def test_semantic_links_equal_all_pairs(spark):
    rng = random.Random(4)
    terms = {(d, rng.choice(["common", "often", "usual", *(f"t{i}" for i in range(30))])) for d in range(90) for _ in range(5)}
    terms |= {(d, "common") for d in range(90)}
    frame = spark.createDataFrame(sorted(terms), "doc_id long, term string")
    held = {}
    for d, t in terms:
        held.setdefault(d, set()).add(t)
    want = []
    for a in held:
        best = sorted((-len(held[a] & held[b]), b) for b in held if b != a and held[a] & held[b])[:5]
        want += [(a, b, -n, min(held[a] & held[b]), i + 1) for i, (n, b) in enumerate(best)]
    for rare in (3, 1000):
        got = corpus.semantic_links(frame, 5, rare).select("src", "dst", "relevance", "suggested_anchor", "rank").collect()
        assert sorted(tuple(r) for r in got) == sorted(want)


def test_terms_are_counted_inside_rows(spark):
    docs = spark.createDataFrame([(1, "b a b c a b"), (2, ""), (3, None)], "doc_id long, text string")
    got = corpus.term_counts(docs, F.filter(F.split("text", " "), lambda x: x != "")).collect()
    assert {tuple(r) for r in got} == {(1, "b", 3, 0, 6), (1, "a", 2, 1, 6), (1, "c", 1, 3, 6)}


def test_ranks_over_partitions(spark):
    values = random.Random(1).sample(range(1000), 300)
    frame = spark.createDataFrame([(v, v % 3) for v in values], "v long, k long").repartition(7)
    got = {(r.v, r["rank"]) for r in sampling.ranked(frame, [F.asc("k"), F.desc("v")]).collect()}
    assert got == {(v, i + 1) for i, v in enumerate(sorted(values, key=lambda v: (v % 3, -v)))}
    assert sampling.ranked(frame.limit(0), [F.asc("v")]).count() == 0


def test_long_chains_of_links_and_redirects_have_no_end_of_rounds(spark):
    n = 40
    edges = spark.createDataFrame([(f"p{i}", f"p{i + 1}") for i in range(n)], "src string, dst string")
    assert {(r.node, r.depth) for r in graph.click_depth(edges, "p0").collect()} == {(f"p{i}", i) for i in range(n + 1)}
    hops = edges.select(F.col("src").alias("from"), F.col("dst").alias("to"), F.lit(301).alias("status"))
    got = {r.start: (r.hops, r.final, r.loop) for r in graph.redirect_chains(hops).collect()}
    assert got["p0"] == (n, f"p{n}", False) and len(got) == n
    pages = spark.createDataFrame([("https://b.example.org/x", 200, "Page not found")], "url string, code int, title string")
    chain = graph.redirect_chains(spark.createDataFrame([("https://a.example.com/", "https://b.example.org/x", 301)], "from string, to string, status int"))
    end = graph.redirect_ends(chain, pages).collect()[0]
    assert end.cross_domain and end.soft_404 and not end.broken


def test_merge_pass_joins_similar_leaders(spark):
    rows = [("red lamp shop berlin", 5.0), ("red lamp shop", 9.0), ("red lamp shops munich", 2.0), ("blue car", 1.0), ("blue car rent", 3.0), ("green tea", 4.0)]
    raw = spark.createDataFrame([(k, f, i) for i, (k, f) in enumerate(rows)], "keyword string, frequency double, pos long")
    e = keywords.entries(keywords.dedupe(raw)).cache()
    pairs = keywords.similar_pairs(e, 0.75, frequent=1.0).cache()
    first = keywords.groups(e, pairs)
    merged = {r.norm: r.leader for r in keywords.merged(e, first, 0.6, frequent=1.0).collect()}
    assert set(merged) == {k for k, _ in rows} and len(set(merged.values())) <= first.select("leader").distinct().count()
    assert merged["red lamp shop berlin"] == merged["red lamp shop"] and merged["green tea"] == "green tea"
    summary = {r.leader: r for r in keywords.group_profile(e, first, pairs).collect()}
    assert abs(sum(r.share for r in summary.values()) - 100) < 0.1 and summary["green tea"].label == "green / tea"
    reps = {r.leader: r.representative for r in keywords.representatives(e, first).collect()}
    assert set(reps) == set(summary)


@pytest.mark.parametrize("encoding", ["windows-1251", "utf-8"])
def test_encoding_of_an_export_whose_first_bytes_are_ascii(spark, tmp_path, encoding):
    (tmp_path / "part-0.csv").write_text("Anchor text\tDomain rating\n")  # a first part without rows
    (tmp_path / "part-1.csv").write_text("Anchor text\tDomain rating\n" + "plain\t1\n" * 2000 + "ссылка\t2\n", encoding=encoding)
    got = readers.read_export(spark, str(tmp_path))
    assert got.count() == 2001 and got.where("`Domain rating` = '2'").first()[0] == "ссылка"
    (tmp_path / "lines").mkdir()
    (tmp_path / "lines" / "a.csv").write_text("1;plain\n" * 2000 + "2;ссылка\n", encoding=encoding)
    assert readers.read_keyword_table(spark, str(tmp_path / "lines")).where("frequency = 2").first()[0] == "ссылка"


def test_exact_means_do_not_depend_on_the_order(spark):
    values = [(0, 0.1)] * 300 + [(0, 1e6 + 0.25)] * 300 + [(1, 0.7)] * 7 + [(1, None), (2, None), (3, 2e7), (3, 1.0), (4, -2.5), (4, float("nan"))]
    import duckdb

    con, want = duckdb.connect(), {0: 500000.175, 1: 0.7, 2: None, 3: 10000000.5}
    for seed in range(3):
        random.Random(seed).shuffle(values)
        got = dict(spark.createDataFrame(values, "g int, v double").repartition(3).groupBy("g").agg(common.exact_mean(F.col("v"))).collect())
        assert {k: v for k, v in got.items() if k < 4} == want and got[4] != got[4]
        con.execute("create or replace table t (g int, v double)").executemany("insert into t values (?, ?)", values)
        assert {k: v for k, v in con.execute(f"select g, {common.exact_mean_sql('v')} from t where g < 4 group by g").fetchall()} == want


@pytest.mark.parametrize("name", ["a7_category_scores", "a7_field_vitals", "b23_grades", "c20_against_primary", "e2_leaderboard"])
def test_means_at_ties_equal_the_sql(spark, tmp_path, name):
    """Means that lie on a boundary of rounding, of values whose plain sums miss it in one order or the other."""
    import duckdb

    from crawlframe.plans import registry

    rows = []
    for site in range(40):
        for kind, mean in (("click", 35.4 if site % 2 else 37.5), ("error", 50.0), ("view", 52.5), ("purchase", 43.125)):
            spread = [random.Random(site).randrange(1, 3000) / 100 for _ in range(200)]
            spread += [-x for x in spread]
            spread[0] += 0.004 if kind == "error" else 0.0  # a mean of 250.00005
            rows += [(len(rows) + i, site, kind, round(mean + d, 3), '{"k": 1}') for i, d in enumerate(spread)]
    random.Random(5).shuffle(rows)
    events = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double, props string")
    events.withColumn("ts", F.lit("2024-01-20").cast("timestamp")).repartition(7).write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"create view events as select * from read_parquet('{tmp_path}/events.parquet/*.parquet')")
    want = con.execute(registry.oracle_sql()[name])
    names = sorted(c[0] for c in want.description)
    at = [[c[0] for c in want.description].index(n) for n in names]
    got = registry.queries()[name](spark, str(tmp_path))
    assert sorted(map(repr, (tuple(r[n] for n in names) for r in got.collect()))) == sorted(repr(tuple(r[i] for i in at)) for r in want.fetchall())


def test_encodings_and_separators():
    assert readers.encoding_of("é".encode()) == "UTF-8" and readers.encoding_of("ссылка".encode("cp1251")) == "windows-1251"
    assert readers.encoding_of("ab".encode("utf-16")) == "UTF-16" and readers.encoding_of("abcd".encode("utf-16-le")) == "UTF-16LE"
    assert readers.encoding_of(("x" * 10 + "é").encode()[:-1]) == "UTF-8"
    assert [readers.separator_of(x) for x in ("a;b;c\n", "\n a\tb,c\n", "a|b", "a,b;c,d", "one")] == [";", "\t", "|", ",", ","]


def test_keyword_blocks_and_split_rows(spark):
    text = 'red lamp\t5\n"big\nblue\n12"\n\nplain words\na, b\n77\n"one\ntwo"\n'
    rows = readers.keyword_rows(spark.createDataFrame([("f", text)], "file string, text string")).select("pos", "line")
    got = sorted((r.keyword, r.frequency) for r in readers.parse_keyword_rows(rows).collect())
    assert got == sorted([("red lamp", 5.0), ("big blue", 12.0), ("plain words", 1.0), ("a", 1.0), ("b", 1.0), ("one two", 1.0)])
    lines = spark.createDataFrame([("a;b;c;d",), ("a",), (" ",)], "line string")
    assert [tuple(r) for r in readers.split_rows(lines, ["x", "y"], ";").collect()] == [("a", "b;c;d"), ("a", "")]


def test_robots_details(spark):
    text = "User-agent: *\nDisallow: /a\nAllow: /a/b\nUser-agent: Yandex\nDisallow: /\n"
    rules = site_files.directives(spark.createDataFrame([("h", text)], "host string, text string"))
    assert [tuple(r) for r in site_files.overlapping(rules).collect()] == [("h", "*", "/a/b", "/a", True)]
    assert {r.bot for r in site_files.missing_bots(rules, ["yandex", "gptbot"]).collect()} == {"gptbot"}


def test_later_snapshots_replace_earlier_ones(spark):
    path = scratch_path(spark, "events")
    frame = spark.createDataFrame([(1, 7, "2024-01-01 01:00", 5.0), (2, 7, "2024-01-01 09:00", 6.0), (3, 7, "2024-01-02 00:00", 4.0), (4, 8, "2024-01-01 00:00", 1.0)], "event_id long, user_id long, t string, value double")
    out = scratch_path(spark, "daily")
    for part in ("event_id <> 2", "event_id = 2"):  # the late one comes in a later run
        frame.where(part).select("event_id", "user_id", F.to_timestamp("t").alias("ts"), "value").write.mode("append").parquet(path)
        stream = spark.readStream.schema("event_id long, user_id long, ts timestamp, value double").parquet(path)
        jobs.keep_daily_snapshots(stream, out)
    got = {(r.user_id, str(r.day)): (r.value, r.delta) for r in jobs.snapshot_history(spark.read.parquet(out)).collect()}
    assert got == {(7, "2024-01-01"): (6.0, None), (7, "2024-01-02"): (4.0, -2.0), (8, "2024-01-01"): (1.0, None)}
