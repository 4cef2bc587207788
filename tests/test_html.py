"""The tree, the selectors and the six rungs on hand-written pages."""

import json

from offerlens.html.extract import Page
from offerlens.html.jsondata import literal_at
from offerlens.html.links import best_links, links, next_page
from offerlens.html.tree import parse
from offerlens.plans.pages import SHOP_PAGES


def offers(html, url="https://s.test/x"):
    return list(Page(html, url, "s").ladder())


def test_implied_end_tags_and_ranges():
    t = parse("<ul><li>a<li>b<ul><li>c</ul></ul><p>x<p><b>y<br>z</p>")
    assert [t.text(i) for i in t.all("li")] == ["a", "bc", "c"]
    assert [t.text(i) for i in t.all("p")] == ["x", "yz"]
    assert t.first("li ul li") is not None and t.first("p li") is None


def test_selectors():
    t = parse('<div class="Foo bar" id="x" data-p><a href="/q" rel="next">n</a><script src="a.js"></script><script>1</script></div>')
    for s in (".bar", "#x", "[data-p]", '[class*="foo" i]', "div a", 'a[rel="next"][href]', "p, div"):
        assert t.first(s) is not None, s
    assert t.first('[class*="foo"]') is None
    assert len(t.all("script:not([src])")) == 1


def test_each_rung_finds_its_own():
    got = {i: [(r, p["title"], p["dealPrice"], p["currency"]) for r, p in offers(h, u)] for i, u, h in SHOP_PAGES}
    assert got[-1] == [("json-ld", "Steel kettle K200", 1499.0, "BDT")]
    assert got[-2][0] == ("microdata", "Desk lamp L9", 650.0, "USD")
    assert got[-3] == [("opengraph", "Wool blanket", 2200.0, "BDT")]
    assert [x[:3] for x in got[-4]] == [("embedded-json", "Alpha phone", 1500.0), ("embedded-json", "Beta phone", 2500.0)]
    assert [x[:3] for x in got[-5]] == [("dom", "Mini fan 20mm", 450.0), ("dom", "Rice sack 5kg", 320.0)]
    assert [x[:3] for x in got[-6]] == [("structure", t, p) for t, p in (("Nice kettle 2L steel", 1200.0), ("Another pot of iron", 2200.0), ("A lamp for the desk", 700.0), ("Woven basket large", 450.0))]


def test_struck_price_and_badge():
    (_, p), *_ = offers(SHOP_PAGES[4][2])
    assert (p["originalPrice"], p["discountPercentage"], p["imageUrl"]) == (900.0, 50, "https://s.test/1.png")


def test_sold_count_and_instalment_are_no_prices():
    html = '<div class="product"><h3>Air cooler Z9</h3><span class="price-sold">176 Sold</span><span class="price emi">৳1,367/month</span><span class="price">৳16,400</span></div>'
    assert [p["dealPrice"] for _, p in offers(html)] == [16400.0]


def test_inner_card_blocks_its_container():
    html = '<div class="product-list"><div class="product"><h3>Soap bar one</h3><i class="price">৳40</i></div><div class="product"><h3>Soap bar two</h3><i class="price">৳50</i></div></div>'
    assert [p["title"] for _, p in offers(html)] == ["Soap bar one", "Soap bar two"]


def test_broken_and_empty_pages():
    for html in ("", "<", "<div", "<script>{", '<script type="application/ld+json">{bad</script>', "<p>" * 300):
        assert offers(html) == []


def test_balanced_literals():
    text = 'x = {"a": "}\\"{", "b": [1, 2]} ; rest'
    assert json.loads(literal_at(text, 4)) == {"a": '}"{', "b": [1, 2]}
    assert literal_at("{[", 0) is None and literal_at("abc", 0) is None


def test_flight_chunks():
    part = json.dumps('3:{"items":[{"name":"Alpha phone","price":1500},{"name":"Beta phone","price":2500}]}\n')
    assert [p["title"] for _, p in offers(f"<script>self.__next_f.push([1,{part}])</script>")] == ["Alpha phone", "Beta phone"]


def test_regions_and_best_links(spark):
    html = '<header><a href="/d">Deals</a></header><div class="hero-x"><a href="/h"><img alt="Hero"></a></div><a href="/b#x">B</a><footer><nav><a href="/d?utm_a=1">Again</a></nav></footer>'
    got = list(links(html, "https://s.test/"))
    assert [(g[1], g[2]) for g in got] == [("https://s.test/d", "nav"), ("https://s.test/h", "hero"), ("https://s.test/b#x", "body"), ("https://s.test/d?utm_a=1", "nav")]
    raw = spark.createDataFrame([(1, *g, u) for g, u in zip(got, ["/d", "/h", "/b", "/d"], strict=True)], "page int, ord int, href string, region string, anchorText string, titleText string, url string")
    best = {r["url"]: r for r in best_links(raw, ["page"]).collect()}
    assert best["/d"]["source"] == "nav" and best["/d"]["anchorText"] == "Deals" and best["/h"]["titleText"] == "Hero"


def test_next_page():
    assert next_page('<a rel="next" href="/x?page=2">', "https://s.test/x") == "https://s.test/x?page=2"
    assert next_page('<nav><a class="disabled" href="#">Next</a><a href="?page=2">2</a></nav>', "https://s.test/x") is None
    assert next_page('<a href="/x/page/2/">two</a>', "https://s.test/x") == "https://s.test/x/page/2/"
