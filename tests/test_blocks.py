"""Nested intervals of pages: odd markup, scopes, block types."""

from crawlframe.operators import blocks as K


def pages_of(spark, *html):
    return spark.createDataFrame(list(enumerate(html)), "page_id long, html string")


def test_nodes_of_odd_markup(spark):
    html = ["<div>a<p>b<p>c</div>d", None, "", "text only", "</p><br/><b>x", "<ul><li>1<li>2</ul>", "<div><!-- c -->a<!-- d -->b</div>", "<script>if (a<b) {}</script><style>p{}</style>x", "<![CDATA[x]]><p", "<div" + " a='1'" * 50 + ">" + "<i>" * 300]
    rows = K.nodes(pages_of(spark, *html)).collect()
    by = {}
    for r in rows:
        by.setdefault(r.page_id, []).append(r)
    assert [(r.tag, r.pos, r.leave, r.depth, r.parent) for r in by[0]] == [("div", 0, 5, 0, -1), ("#text", 1, 1, 1, 0), ("p", 2, 5, 1, 0), ("#text", 3, 3, 2, 2), ("p", 4, 5, 2, 2), ("#text", 5, 5, 3, 4), ("#text", 6, 6, 0, -1)]
    assert 1 not in by and 2 not in by and [r.tag for r in by[3]] == ["#text"]
    assert [r.tag for r in by[4]] == ["br", "b", "#text"] and by[4][1].leave == 2
    assert [(r.tag, r.text) for r in by[6]] == [("div", None), ("#text", "a"), ("#text", "b")]
    assert [r.tag for r in by[7]] == ["script", "#script", "style", "#style", "#text"]
    assert len(by[9]) == 301 and max(r.depth for r in by[9]) == 300
    for own in by.values():  # intervals are nested
        for r in own:
            assert r.pos <= r.leave and (r.parent < 0 or own[r.parent].pos < r.pos <= r.leave <= own[r.parent].leave)


def test_texts_and_links_of_elements(spark):
    el, pages = K.spans(K.nodes(pages_of(spark, "<body><nav> <a href='/'>Home </a>\n<a>no</a></nav><div>One  two <i>three</i><script>x()</script> four</div></body>")))
    rows = {r.tag: r for r in el.join(pages, "page_id").withColumn("text", K.text_of()).collect()}
    assert rows["nav"].text == "Home no" and rows["nav"].links == 1
    assert rows["div"].text == "One two three four" and rows["body"].text == "Home no One two three four" and rows["script"].text == ""


NOISY = """<html><body><nav><a href="/a">Home</a> <a href="/b">News</a> <a href="/c">Live</a> and more of that kind</nav>
<div class="promo">Something that a firm would like to be read by all people</div>
<section class="live">Live match 2:1 goes on, qualifier 1:0 is over</section>
<article><h1>Vacuum gauges for plants</h1><p>Gauges help to tell the pressure and to keep lines in order.</p><p>What follows is about upkeep, tolerance and faults of sensors.</p></article>
<footer>copyright terms policy of this whole site</footer></body></html>"""


def test_types_of_blocks(spark):
    found = {r.tag: (r.type, r.segment_class) for r in K.segments(K.nodes(pages_of(spark, NOISY))).collect()}
    assert found["section"] == ("live_scores", "boilerplate") and found["footer"] == ("footer", "navigation") and found["article"] == ("main", "supporting")
    page = K.segmentation(K.nodes(pages_of(spark, NOISY))).first()
    assert page.main_pct >= 20.0 and page.ads_pct == 0.0 and page.main_chars > 0 and page.level in ("low", "medium", "high")


BLOCKS = [
    ('<div class="site-header"><a href="/">Start here</a> <a href="/x">Other pages that we have</a></div>', "header"),
    ('<div class="filter"><a href="/">Red and blue</a> <a href="/x">Green and black ones too</a></div>', "sidebar"),
    ('<div class="megamenu"><a href="/">Pumpsandvalvesandsuchlike</a> <a href="/x">Metersandmoresuchlike</a></div>', "nav"),
    ('<div class="category-list"><a href="/">One</a> <a href="/x">two</a> <a href="/y">three</a> four five six seven eight</div>', "category"),
    ("<div>Customers gave a testimonial after each of the visits</div>", "reviews"),
    ("<div>A frequently asked thing is how long all of this takes</div>", "faq"),
    ('<div class="product-card">A pump that lasts for years and years</div>', "product"),
    ("<div>What the gdpr says holds for all of the visitors too</div>", "legal"),
    ("<div>Sign up and hear more of it every other week</div>", "cta"),
    ("<div>You may also like these other things of ours</div>", "noise"),
    ("<div>Call +49 30 1234567 on any day of the whole week</div>", "utility"),
    ("<div>Some few words that are about nothing at all</div>", "utility"),
    (f"<div>{'Plain words about water and stone and wood. ' * 4}</div>", "main"),
    ("<footer>All that stands at the end of a page here</footer>", "footer"),
]


def test_each_type(spark):
    found = {r.page_id: r.type for r in K.segments(K.nodes(pages_of(spark, *[b for b, _ in BLOCKS]))).collect()}
    assert found == {i: kind for i, (_, kind) in enumerate(BLOCKS)}


def test_advertising_needs_its_technique(spark):
    html = '<script async src="https://pagead2.googlesyndication.com/pagead/js/adsbygoogle.js"></script><iframe src="https://doubleclick.net/ad/slot"></iframe><div class="banner">Words that fill a place on this page somehow</div>'
    assert [tuple(r) for r in K.ads(K.nodes(pages_of(spark, html, NOISY))).collect()] == [(0, ["ad_domain_iframe", "ad_domain_script", "adsbygoogle"])]
    assert [r.type for r in K.segments(K.nodes(pages_of(spark, html))).collect()] == ["ads"]


THINGS = """<div itemscope itemtype="https://schema.org/Organization"><span itemprop="name">ACME Works</span>
<div itemprop="address" itemscope itemtype="https://schema.org/PostalAddress"><span itemprop="streetAddress">Main street 5</span></div>
<a itemprop="url sameAs" href="https://acme.example.com">page</a></div><span itemprop="name">outside</span>
<article typeof="schema:FAQPage"><h2 property="schema:name">Asked often</h2></article><div typeof="Review">Good one</div><section itemscope><b itemprop="name">no type"""


def test_things_and_their_properties(spark):
    n = K.nodes(pages_of(spark, THINGS, "<p>none</p>", None))
    items = {(r.syntax, ",".join(r.types)): r for r in K.dom_items(n).collect()}
    assert set(items) == {("microdata", "Organization"), ("microdata", "PostalAddress"), ("microdata", ""), ("rdfa", "FAQPage"), ("rdfa", "Review")}
    org, address = items["microdata", "Organization"], items["microdata", "PostalAddress"]
    assert address.within == org.item and address.as_property == "address" and org.within is None
    found = {(r.item, r.property): (r.value, r.nested) for r in K.dom_properties(n).collect()}
    assert found[org.item, "name"] == ("ACME Works", None) and found[org.item, "address"] == (None, address.item)
    assert found[address.item, "streetAddress"] == ("Main street 5", None)
    assert found[org.item, "url"] == found[org.item, "sameAs"] == ("https://acme.example.com", None)
    assert "outside" not in {v for v, _ in found.values()} and found[items["microdata", ""].item, "name"] == ("no type", None)
    names = {(r.type, r.name) for r in K.dom_entities(n).collect()}
    assert names == {("Organization", "ACME Works"), ("PostalAddress", "Main street 5"), ("FAQPage", "Asked often"), ("Review", "Good one")}


def test_pages_are_parsed_once_and_in_small_batches(spark, monkeypatch):
    key, rows, cut = "spark.sql.execution.arrow.maxRecordsPerBatch", [], K.cut
    before = spark.conf.get(key)
    monkeypatch.setattr(K, "cut", lambda df: (rows.append(int(spark.conf.get(key))), cut(df))[1])
    n = K.nodes(pages_of(spark, THINGS))
    assert rows == [K.PAGE_ROWS] and spark.conf.get(key) == before
    for found in (n, K.dom_items(n), K.dom_properties(n), K.segments(n)):
        assert "mapinpandas" not in found._jdf.queryExecution().optimizedPlan().toString().lower()


def test_segmentation_cuts_each_text_into_words_once(spark):
    n, key = K.nodes(pages_of(spark, NOISY)), "spark.sql.debug.maxToStringFields"
    before = spark.conf.get(key)
    spark.conf.set(key, "1000")
    try:
        plan = K.segmentation(n)._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set(key, before)
    # Words of four extractors, supporting blocks and headings; addresses in three; words of blocks, and of landmarks.
    assert plan.count("regexp_extract_all(") <= 11
