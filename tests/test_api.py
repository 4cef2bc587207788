import pytest

from offerlens import api
from offerlens.plans.pages import SHOP_PAGES
from offerlens.sources import stores


def test_scrape(spark):
    html = '<div class="product"><h3>Samsung Galaxy A15 128GB</h3><i class="price">৳{}</i><a href="/p">x</a></div><div class="product"><h3>Rice of shop {}</h3><i class="price">৳50</i></div>'
    pages = spark.createDataFrame([("https://one.test/a", html.format(18499, "one")), ("https://two.test/a", html.format(19499, "two")), ("https://wall.test/", "<p>Access denied</p>")], "url string, html string")
    out = api.scrape(pages)
    assert [(r["savings"], r["sites"]) for r in out["groups"].collect() if "samsung" in r["representativeTitle"].lower()] == [(1000.0, 2)]
    reports = {r["site"]: r for r in out["reports"].collect()}
    assert reports["Wall"]["status"] == "blocked" and reports["One"]["status"] == "ok" and reports["One"]["productCount"] == 2
    assert reports["One"]["rungs"] == ["dom"]
    made = spark.createDataFrame(SHOP_PAGES, "page_id long, url string, html string")
    assert api.scrape(made, options=api.Options(min_discount=45))["offers"].count() == 1


def test_targets_and_options(spark):
    t = api.targets(spark, ["b.test", "https://a.test/", "b.test", "", "localhost"])
    assert [r["url"] for r in t.orderBy("ord").collect()] == ["https://b.test/", "https://a.test/"]
    with pytest.raises(ValueError):
        api.targets(spark, [])
    for bad in ({"mode": "x"}, {"min_discount": 101}, {"include": [""]}, {"exclude": ["x" * 201]}, {"most_targets": 11}):
        with pytest.raises(ValueError):
            api.Options(**bad)


def test_add_page(spark):
    reg = spark.createDataFrame([("0", "https://x.test/", "x.test", "excluded", 0.0, 0, 0)], "id string, url string, domain string, status string, dealDensity double, lastVerifiedAt long, nextCheckAt long")
    offers = spark.createDataFrame([(20.0, 50), (None, None)], "originalPrice double, discountPercentage int")
    got = api.add_page(reg, "https://S.test/deals/?utm_x=1", offers, 1000)
    row = got.where("status = 'active'").first()
    assert (row["url"], row["domain"], row["dealDensity"]) == ("https://s.test/deals", "s.test", 0.5)
    assert api.add_page(got, "https://s.test/deals", offers, 5).count() == 2
    with pytest.raises(PermissionError):
        api.add_page(got.withColumn("status", api.F.lit("excluded")), "https://s.test/deals", offers, 5)


def test_store_versions(spark, tmp_path):
    path, schema = str(tmp_path / "reg"), "url string, n int"
    assert stores.load(spark, path, schema).count() == 0
    for n in range(1, 4):
        assert stores.save(spark.createDataFrame([("u", n), (None, n)], schema), path) == n
    assert stores.versions(spark, path) == [2, 3]
    assert [r["n"] for r in stores.load(spark, path, schema).collect()] == [3]
    for f in (tmp_path / "reg" / "v=3").glob("part-*"):
        f.write_bytes(b"broken")
    assert [r["n"] for r in stores.load(spark, path, schema).collect()] == [2]


def test_lexicon_file():
    words, seasons = stores.lexicon_from('{"A": ["Soldes"], "C": ["deal"], "SEASON": {"soldes": [1, 7]}}')
    assert "soldes" in words[1.0] and "deal" in words[0.45] and "deal" not in words[1.0] and seasons["soldes"] == [1, 7]


def test_scrape_follows_a_listing(spark):
    card = '<div class="product"><h3>{}</h3><i class="price">৳{}</i><a href="/p/{}">x</a></div>'
    page = lambda names, after: "".join(card.format(f"Thing of name {n}", 100 + n, n) for n in names) + (f'<a rel="next" href="{after}">n</a>' if after else "")
    rows = [("https://s.test/l", page((1, 2), "/l?page=2")), ("https://s.test/l?page=2", page((2, 3), "/l?page=3")), ("https://s.test/l?page=3", page((1, 3), "/l?page=4")), ("https://s.test/l?page=4", page((4, 5), "/l")), ("https://t.test/", page((8, 9), "/gone"))]
    pages = spark.createDataFrame(rows, "url string, html string")
    wanted = spark.createDataFrame([("https://s.test/l",), ("https://t.test/",)], "url string")
    found = spark.createDataFrame([("https://s.test/l", 1, "later", 0.1), ("https://s.test/l", 0, "s.test", 0.9)], "url string, ord int, discoveredFrom string, candidateScore double")
    out = api.scrape(pages, wanted, found=found)
    got = {}
    for r in out["offers"].collect():
        got.setdefault(r["key"], set()).add(r["title"][-1])
    assert got == {"https://s.test/l": {"1", "2", "3"}, "https://t.test/": {"8", "9"}}  # the third page adds nothing
    reports = {r["key"]: r for r in out["reports"].collect()}
    assert (reports["https://s.test/l"]["productCount"], reports["https://s.test/l"]["discoveredFrom"], reports["https://s.test/l"]["candidateScore"]) == (3, "s.test", 0.9)
    assert reports["https://t.test/"]["discoveredFrom"] is None
    one = api.scrape(pages, wanted, api.Options(most_pages=1))["offers"]
    assert one.where("key = 'https://s.test/l'").count() == 2
    runs = api.scrape(pages.withColumn("run", api.F.substring("url", 9, 1)))
    assert {r["run"] for r in runs["offers"].select("run").distinct().collect()} == {"s", "t"}
