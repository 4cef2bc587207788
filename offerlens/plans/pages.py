"""Queries over collected pages and their URLs."""

from __future__ import annotations

from pyspark.sql import functions as F

from offerlens.functions import page as G
from offerlens.functions import url as U
from offerlens.html.extract import extract_offers as ladder
from offerlens.html.links import harvest, next_page
from offerlens.operators import crawl
from offerlens.sources.tables import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def _pages(spark, sf_dir):
    return table(spark, sf_dir, "pages")


_HOST = "lower(regexp_extract({0}, '(?i)^\\s*https?://([^/?#:]+)', 1))"
_PATH = "CASE WHEN regexp_extract({0}, '(?i)^\\s*https?://[^/?#]+([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract({0}, '(?i)^\\s*https?://[^/?#]+([^?#]*)', 1) END"
_QUERY = "regexp_extract({0}, '\\?([^#]*)', 1)"
_KEEP = "[" + ", ".join(f"'{p}'" for p in U.MEANINGFUL) + "]"


def _canonical(u: str) -> str:
    path = f"regexp_replace({_PATH.format(u)}, '/{{2,}}', '/', 'g')"
    path = f"(CASE WHEN length({path}) > 1 THEN regexp_replace({path}, '/$', '') ELSE {path} END)"
    pairs = f"list_filter(string_split({_QUERY.format(u)}, '&'), lambda x: x <> '' AND list_contains({_KEEP}, lower(string_split(x, '=')[1])))"
    q = f"coalesce(list_aggregate([lower(string_split(x, '=')[1]) || '=' || regexp_replace(x, '^[^=]*=?', '') FOR x IN list_sort({pairs})], 'string_agg', '&'), '')"
    out = f"lower(regexp_extract({u}, '(?i)^\\s*(https?)://', 1)) || '://' || {_HOST.format(u)} || {path} || CASE WHEN {q} = '' THEN '' ELSE '?' || {q} END"
    return f"CASE WHEN len(list_filter(string_split({path}, '/'), lambda x: x <> '')) <= 6 AND length({out}) <= 512 THEN {out} END"


@query(f"SELECT page_id, {_canonical('url')} AS canonical FROM pages")
def url_canonicalize(spark, sf_dir):
    """C12."""
    return _pages(spark, sf_dir).select("page_id", U.canonicalize("url").alias("canonical"))


_SUFFIX = "[" + ", ".join(f"'{s}'" for s in U.TWO_PART_SUFFIXES) + "]"


def _registrable(h: str) -> str:
    two = f"list_aggregate(string_split({h}, '.')[-2:], 'string_agg', '.')"
    return f"CASE WHEN {h} = '' OR regexp_matches({h}, '^\\d{{1,3}}(\\.\\d{{1,3}}){{3}}$') OR len(string_split({h}, '.')) < 2 THEN NULL WHEN list_contains({_SUFFIX}, {two}) THEN CASE WHEN len(string_split({h}, '.')) >= 3 THEN list_aggregate(string_split({h}, '.')[-3:], 'string_agg', '.') END ELSE {two} END"


_KNOWN = " ".join(f"WHEN h = '{d}' OR h LIKE '%.{d}' THEN '{n}'" for d, n in U.KNOWN_SITES.items())


@query(
    f"""WITH p AS (SELECT page_id, url, {_HOST.format("url")} AS host, regexp_replace({_HOST.format("url")}, '^www\\.', '') AS h FROM pages)
  SELECT page_id, host, h AS hostOf, {_registrable("host")} AS domain, CASE WHEN host = '' THEN 'Unknown' {_KNOWN} ELSE upper(substr(string_split(h, '.')[1], 1, 1)) || substr(string_split(h, '.')[1], 2) END AS site,
    host <> '' AND regexp_matches(url, '(?i)^https?://[^/?#]+/?$') AS isRoot FROM p"""
)
def url_sites(spark, sf_dir):
    """C13, C15-C17."""
    return _pages(spark, sf_dir).select("page_id", U.host("url").alias("host"), U.host_of("url").alias("hostOf"), U.registrable_domain(U.host("url")).alias("domain"), U.site_name("url").alias("site"), U.is_root("url").alias("isRoot"))


_INPUTS = ["  chaldal.com/deals ", "https://Shop.Test/a?b=1", "localhost", "", "http://10.1.2.3/x", "http://8.8.8.8/", "https://172.20.0.1", "ftp://x.test/", "https://daraz.com.bd", "http://192.168.0.1:80/a", "https://203.0.113.9/", "x y.test"]


@query()
def url_intake(spark, sf_dir):
    """The target list of a request: normalised, distinct, in order, the first ten, public ones marked."""
    t = spark.createDataFrame(list(enumerate(_INPUTS)), "ord int, raw string").withColumn("url", U.normalize_url("raw")).where("url is not null")
    return t.groupBy("url").agg(F.min("ord").alias("ord")).orderBy("ord").limit(10).withColumn("public", U.public_address("url"))


@query(
    f"""WITH p AS (SELECT page_id, url, {_registrable(_HOST.format("url"))} AS d FROM pages)
  SELECT d AS domain, count(*) AS pages, count(DISTINCT url) AS urls, min(page_id) AS first FROM p WHERE d IS NOT NULL GROUP BY d"""
)
def same_site_groups(spark, sf_dir):
    """Pages by registrable domain, the first one standing for it."""
    p = _pages(spark, sf_dir).select("page_id", "url", U.registrable_domain(U.host("url")).alias("domain")).where("domain is not null")
    return p.groupBy("domain").agg(F.count("*").alias("pages"), F.countDistinct("url").alias("urls"), F.min("page_id").alias("first"))


@query(
    f"""SELECT page_id, CASE WHEN regexp_matches({_PATH.format("url")}, '(?i)^/.*\\.html$') THEN '/*.html' WHEN lower(regexp_replace({_PATH.format("url")}, '(.)/+$', '\\1')) = '/de' THEN 'de' WHEN regexp_matches({_PATH.format("url")} || CASE WHEN {_QUERY.format("url")} = '' THEN '' ELSE '?' || {_QUERY.format("url")} END, '(?i)^/.*\\?page=2$') THEN '/*?page=2' END AS pattern FROM pages"""
)
def user_patterns(spark, sf_dir):
    """The first of three patterns that matches."""
    return _pages(spark, sf_dir).select("page_id", U.first_pattern(["/*.html", "de", "/*?page=2"], "url").alias("pattern"))


ROBOTS = "User-agent: bad\nDisallow: /\n\nUser-agent: *\nDisallow: /en\nAllow: /en/a # but\nDisallow: /de/\nDisallow:\nSitemap: https://x.test/s.xml\n"


@query(
    f"""WITH p AS (SELECT page_id, {_PATH.format("url")} AS path FROM pages), r(prefix, ok) AS (VALUES ('/en', false), ('/en/a', true), ('/de/', false))
  SELECT p.page_id, coalesce(arg_max(ok, length(prefix)), true) AS allowed FROM p LEFT JOIN r ON starts_with(p.path, r.prefix) GROUP BY p.page_id"""
)
def robots_allowed(spark, sf_dir):
    """One robots file for all pages."""
    rules = crawl.robots_rules(spark.createDataFrame([("all", ROBOTS)], "site string, body string"))
    return crawl.allowed(_pages(spark, sf_dir).select("page_id", F.lit("all").alias("site"), U.path("url").alias("path")), rules).select("page_id", "allowed")


_MADE = [
    (-1, "<html><title>Just a moment...</title></html>"),
    (-2, '<div id="root"></div><script>x</script>'),
    (-3, '<meta name="generator" content="WordPress 6"><div class="countdown">ends in 5</div>'),
    (-4, '<script src="https://cdn.shopify.com/x.js"></script>Hurry, limited time'),
    (-5, '<script id="__NEXT_DATA__">{}</script><p>of 1,234 products</p>'),
    (-6, ""),
]
_MADE_SQL = ", ".join("({}, '{}')".format(i, h.replace("'", "''")) for i, h in _MADE)
_C = G.COUNTDOWN.replace("'", "''")
_TELLS = " ".join("WHEN regexp_matches(s, '(?i){}') THEN '{}'".format(p.replace("'", "''"), n) for n, p in G.PLATFORM_TELLS)
_GENS = " ".join(f"WHEN contains(g, '{w}') THEN '{n}'" for w, n in G.GENERATORS)
_VISIBLE = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>', '', 'g'), '(?is)<style.*?</style>', '', 'g'), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'))"


@query(
    f"""WITH a AS (SELECT page_id, html FROM pages UNION ALL SELECT * FROM (VALUES {_MADE_SQL}) v(page_id, html)), b AS (SELECT page_id, html, substr(html, 1, 500000) AS s, lower(regexp_extract(html, '{G.GENERATOR.replace("'", "''")}', 1)) AS g FROM a)
  SELECT page_id, CASE WHEN regexp_matches(substr(html, 1, 20000), '(?i){"|".join(G.BLOCK_PHRASES)}') THEN 'challenge page ("' || regexp_extract(substr(html, 1, 20000), '(?i)({"|".join(G.BLOCK_PHRASES)})', 1) || '")' END AS block,
    CASE WHEN regexp_matches(html, '(?i)<div\\s+id=["''](__next|root|app)["'']|__NEXT_DATA__|__NUXT__') AND length({_VISIBLE}) < 500 THEN 'CSR' ELSE 'SSR' END AS renderType,
    regexp_matches(s, '{_C}') AS countdown, CASE {_GENS} {_TELLS} END AS platform FROM b"""
)
def page_tells(spark, sf_dir):
    """C20, C22-C24 over the pages and six made ones."""
    p = _pages(spark, sf_dir).select("page_id", "html").unionByName(spark.createDataFrame(_MADE, "page_id long, html string"))
    return p.select("page_id", G.detect_block("html").alias("block"), G.render_type("html").alias("renderType"), G.has_countdown("html").alias("countdown"), G.platform("html").alias("platform"))


@query()
def harvest_links(spark, sf_dir):
    """Each page's links by canonical URL."""
    return harvest(_pages(spark, sf_dir), ["page_id"]).select("page_id", "url", F.col("source"), "anchorText", "titleText", "inNavAndFooter")


@query("""WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '<li><a href="([^"]+)"', 1)) AS href FROM pages) SELECT page_id, count(*) AS links, count(DISTINCT href) AS targets FROM a GROUP BY page_id""")
def nav_links_native(spark, sf_dir):
    """Link counts of a fixed page skeleton, by a pattern instead of a tree."""
    a = _pages(spark, sf_dir).select("page_id", F.explode(F.regexp_extract_all("html", F.lit('<li><a href="([^"]+)"'), F.lit(1))).alias("href"))
    return a.groupBy("page_id").agg(F.count("*").alias("links"), F.countDistinct("href").alias("targets"))


_LABELS = ["Flash Sale today", "hot dealz", "Black Friday", "about us", "wholesale prices", "discuont club", "clearence corner", "Eid offer", "best price", "summerSale", "blog deals", "promotiom", "back to school", "save big", "অফার"]
_TERMS = ", ".join(f"('{t}', {w}, {(min(1.0, w + 0.1) if 11 in G.SEASONS[t] else 0.45) if t in G.SEASONS else w})" for w, terms in G.LEXICON.items() for t in terms)
_STRONG = ", ".join(f"('{t}')" for t in G.LEXICON[1.0] if " " not in t and len(t) >= 6 and t.isascii())


@query(
    f"""WITH l AS (SELECT * FROM (VALUES {", ".join(f"({i}, '{t}')" for i, t in enumerate(_LABELS))}) v(id, label) UNION ALL SELECT 1000 + page_id, regexp_extract(html, '<title>([^<]*)', 1) FROM pages),
  t AS (SELECT id, label, list_filter(regexp_split_to_array(lower(regexp_replace(label, '([a-z])([A-Z])', '\\1 \\2', 'g')), '[^a-z0-9ঀ-৿]+'), lambda x: x <> '') AS w FROM l),
  g AS (SELECT id, unnest(list_concat(w, [w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))])) AS term FROM t), lex(term, base, weight) AS (VALUES {_TERMS}), strong(term) AS (VALUES {_STRONG}),
  k AS (SELECT g.id, max(CAST(lex.weight AS DOUBLE)) AS w FROM g JOIN lex USING (term) GROUP BY g.id),
  f AS (SELECT DISTINCT u.id FROM (SELECT id, unnest(w) AS x FROM t) u JOIN strong s ON length(u.x) >= 6 AND levenshtein(u.x, s.term) <= 1 WHERE u.x NOT IN (SELECT term FROM lex))
  SELECT CAST(t.id AS BIGINT) AS id, greatest(coalesce(k.w, 0), CASE WHEN f.id IS NOT NULL THEN CAST(1 AS DOUBLE) ELSE 0 END) AS keyword, list_filter(t.w, lambda x: list_contains(['{"', '".join(G.NEGATIVE)}'], x))[1] AS negative, list_filter(t.w, lambda x: list_contains(['{"', '".join(G.STOP)}'], x))[1] AS stop
  FROM t LEFT JOIN k ON k.id = t.id LEFT JOIN f ON f.id = t.id"""
)
def keyword_scores(spark, sf_dir):
    """C26-C29 in November, over made labels and page titles."""
    made = spark.createDataFrame(list(enumerate(_LABELS)), "id long, label string")
    l = made.unionByName(_pages(spark, sf_dir).select((F.col("page_id") + 1000).alias("id"), F.regexp_extract("html", "<title>([^<]*)", 1).alias("label")))
    return l.select("id", G.keyword_score("label", 11).alias("keyword"), G.negative_token("label").alias("negative"), G.stop_segment("label").alias("stop"))


@query()
def candidate_priors(spark, sf_dir):
    """J13 over harvested links, the best three of a site."""
    from pyspark.sql.window import Window

    links = harvest(_pages(spark, sf_dir).withColumn("site", U.host("url")), ["site"])
    s = links.withColumn("p", G.candidate_prior(F.col("url"), F.col("source"), F.col("anchorText"), F.col("titleText"), 11, nav_and_footer=F.col("inNavAndFooter")))
    s = s.select("site", "url", "ord", F.col("p.score").alias("score"), F.col("p.reject").alias("reject"))
    w = Window.partitionBy("site").orderBy(F.desc("score"), "ord", "url")
    return s.withColumn("rank", F.row_number().over(w)).where("rank <= 3").select("site", "url", F.floor(F.col("score") * 1e6 + 0.5).alias("micros"), "reject", "rank")


@query()
def offers_of_pages(spark, sf_dir):
    """J7 over the driver's pages (which hold none) and one shop page for each rung."""
    made = spark.createDataFrame(SHOP_PAGES, "page_id long, url string, html string")
    p = _pages(spark, sf_dir).select("page_id", "url", "html").unionByName(made).withColumn("site", U.site_name("url"))
    return ladder(p, ["page_id"]).drop("selector")


_DOCS = """s AS (SELECT n_nationkey AS k, 'https://n' || n_nationkey || '.test/' AS o FROM nation)"""


@query(
    f"""WITH {_DOCS}, c AS (SELECT c_nationkey AS k, c_custkey, row_number() OVER (PARTITION BY c_nationkey, c_custkey % 6 ORDER BY c_custkey) - 1 AS ord FROM customer),
  v AS (SELECT k, o, x.place, x.part FROM s, (VALUES (4, 1)) x(place, part) UNION ALL SELECT k, o, 2, 0 FROM s)
  SELECT o AS site, CAST(place AS BIGINT) AS place, count(*) AS pages, min(o || 'c/' || c_custkey || '?a=1&b=2') AS first, count(*) FILTER (c_custkey % 4 = 0) AS dated FROM v JOIN c ON c.k = v.k AND c.c_custkey % 6 = v.part GROUP BY o, place"""
)
def sitemap_recursive(spark, sf_dir):
    """A site for each nation, whose root index lists part maps of its customers: part 0, part 2 (named
    as products, not followed), a nested index of parts 3 to 5, part 1, and a part that the four documents leave out.

    Read are the root, part 0, the nested index (place 3, no page of its own) and part 1.
    """
    t = lambda name: table(spark, sf_dir, name)
    origin = F.concat(F.lit("https://n"), F.col("k"), F.lit(".test/"))
    entry = F.concat(F.lit("<url><loc> "), origin, F.lit("c/"), "c_custkey", F.lit("?a=1&amp;b=2 </loc>"), F.when(F.col("c_custkey") % 4 == 0, "<lastmod>2026-09-01</lastmod>").otherwise(""), F.lit("</url>"))
    parts = t("customer").withColumn("k", F.col("c_nationkey")).select("k", (F.col("c_custkey") % 6).alias("part"), "c_custkey", entry.alias("e"))
    parts = parts.groupBy("k", "part").agg(F.concat(F.lit("<urlset>"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", "e"))), lambda x: x["e"]), ""), F.lit("</urlset>")).alias("xml"))
    name = F.when(F.col("part") == 2, "products").otherwise(F.col("part").cast("string"))
    docs = parts.select(F.concat(origin, F.lit("m/"), name, F.lit(".xml")).alias("url"), "xml")
    index = lambda *names: F.concat(F.lit("<sitemapindex>"), *(x for n in names for x in (F.lit("<sitemap><loc>"), origin, F.lit(f"m/{n}.xml</loc></sitemap>"))), F.lit("</sitemapindex>"))
    n = t("nation").select(F.col("n_nationkey").alias("k"))
    docs = docs.unionByName(n.select(F.concat(origin, F.lit("m/root.xml")).alias("url"), index("0", "products", "nested", "1", "5").alias("xml"))).unionByName(n.select(F.concat(origin, F.lit("m/nested.xml")).alias("url"), index("3", "4").alias("xml")))
    roots = n.select(origin.alias("site"), F.concat(origin, F.lit("m/root.xml")).alias("url"), F.lit(0).alias("ord"))
    w = crawl.walk_sitemaps(roots, docs)
    return w.groupBy("site", F.col("place").cast("long").alias("place")).agg(F.count("*").alias("pages"), F.min("loc").alias("first"), F.count("lastmod").alias("dated"))


@query("""WITH RECURSIVE n AS (SELECT page_id AS start, page_id AS url, 0 AS n FROM pages UNION ALL SELECT start, url + 7, n + 1 FROM n WHERE n < 4 AND EXISTS (SELECT 1 FROM pages p WHERE p.page_id = n.url + 7)) SELECT start, count(*) AS pages, max(url) AS last FROM n GROUP BY start""")
def page_chains(spark, sf_dir):
    """Chains of at most five pages over a made next relation."""
    p = _pages(spark, sf_dir).select(F.col("page_id").alias("url"))
    nexts = p.select("url", (F.col("url") + 7).alias("next")).join(p.select(F.col("url").alias("next")), "next", "left_semi")
    return crawl.page_chains(p, nexts).groupBy("start").agg(F.count("*").alias("pages"), F.max("url").alias("last"))


_NEXT = [
    (1, "https://s.test/x", '<a rel="next" href="/x?page=2">n</a>'),
    (2, "https://s.test/x?page=2", '<div class="Pagination"><a href="?page=1">Prev</a><a href="?page=3">Next ›</a></div>'),
    (3, "https://s.test/x?page=9", '<div class="pager"><a class="disabled" href="#">Next</a></div><a href="?page=10">10</a>'),
    (4, "https://s.test/x", '<a href="/x/page/2">two</a>'),
    (5, "https://s.test/x", "<p>none</p>"),
]


@query("SELECT * FROM (VALUES (CAST(1 AS BIGINT), 'https://s.test/x?page=2'), (2, 'https://s.test/x?page=3'), (3, NULL), (4, 'https://s.test/x/page/2'), (5, NULL)) v(id, next)")
def next_pages(spark, sf_dir):
    """C34."""
    from pyspark.sql.types import StringType

    follow = F.udf(next_page, StringType(), useArrow=True)
    return spark.createDataFrame(_NEXT, "id long, url string, html string").select("id", follow("html", "url").alias("next"))


@query("""WITH t AS (SELECT doc_id, list_distinct(list_filter(string_split(regexp_replace(lower(coalesce(text, '')), '[^\\p{L}\\p{M}\\p{N}]+', ' ', 'g'), ' '), lambda x: x <> '')) AS w FROM documents)
  SELECT CAST(len(w) AS BIGINT) AS words, count(*) AS documents FROM t GROUP BY len(w)""")
def distinct_words(spark, sf_dir):
    """Distinct words of every text, as the fingerprint's token sets have them (F7), in letters of any script; a null text has none."""
    w = F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}\p{M}\p{N}]+", " "), " "), lambda x: x != ""))
    return table(spark, sf_dir, "documents").select(F.size(w).cast("long").alias("words")).groupBy("words").agg(F.count("*").alias("documents"))


# One shop page for each rung of the ladder.
SHOP_PAGES = [
    (-1, "https://ld.test/deals", '<script type="application/ld+json">{"@type":"ItemList","itemListElement":[{"@type":"ListItem","item":{"@type":["Product"],"name":"Steel kettle K200","url":"/p/k200","image":[{"url":"/k.png"}],"offers":[{"price":"1,499.00","priceCurrency":"bdt"}]}},{"item":{"@type":"Product","name":"Pan","offers":{"lowPrice":20}}}]}</script>'),
    (-2, "https://md.test/", '<div itemscope itemtype="https://schema.org/Product"><span itemprop="name">Desk lamp L9</span><meta itemprop="price" content="650"><meta itemprop="priceCurrency" content="usd"><img itemprop="image" src="l9.jpg"><a itemprop="url" href="/l9">more</a></div>'),
    (-3, "https://og.test/p/1", '<meta property="og:title" content="Wool blanket"><meta property="product:price:amount" content="2200"><meta property="og:image" content="/b.png">'),
    (-4, "https://js.test/", '<script>window.__INITIAL_STATE__ = {"list":[{"title":"Alpha phone","price":1500,"mrp":2000,"slug":"/a"},{"title":"Beta phone","price":"৳2500"}]};</script>'),
    (-5, "https://dom.test/", '<ul><li class="product-item"><a href="/1"><img src="/1.png"></a><h3>Mini fan 20mm</h3><span class="price">৳450</span> <del>৳900</del><span class="badge">-50%</span><p class="sold">176 Sold</p></li><li class="product-item"><h3>Rice sack 5kg</h3><span class="price">Tk 320</span></li></ul>'),
    (-6, "https://flat.test/", "<body><div>" + "".join(f'<div><a href="/{i}"><img src="/i.png"><p>{t}</p><span>৳{p}</span><span>৳{p + 300}</span></a></div>' for i, (t, p) in enumerate((("Nice kettle 2L steel", 1200), ("Another pot of iron", 2200), ("A lamp for the desk", 700), ("Woven basket large", 450)))) + "</div></body>"),
]


_IMPORTS = [
    (1, '{"url":"https://a.test/d","status":"active","dealDensity":0.5,"evidence":["x",null,"y"],"seasonHint":[0,11,13]}'),
    (2, '{"url":"https://b.test/d","status":"odd"}'),
    (3, '{"status":"active"}'),
    (4, "not json"),
    (5, '{"url":""}'),
]


@query("SELECT * FROM (VALUES (1, substr(sha1('https://a.test/d'), 1, 16), 'active', CAST(0.5 AS DOUBLE), 'x,y', '11'), (2, substr(sha1('https://b.test/d'), 1, 16), 'candidate', 0, '', '')) v(ord, id, status, dealDensity, evidence, season)")
def import_sanitizer(spark, sf_dir):
    """A20 over made records."""
    from offerlens.sources.stores import sanitize

    s = sanitize(spark.createDataFrame(_IMPORTS, "ord int, body string"))
    return s.select("ord", "id", "status", "dealDensity", F.array_join("evidence", ",").alias("evidence"), F.array_join("seasonHint", ",").alias("season"))


@query()
def scrape_reports(spark, sf_dir):
    """The request over all pages and the made shop pages: reports with rungs, quality and status."""
    from offerlens.api import scrape

    p = _pages(spark, sf_dir).select("url", "html").unionByName(spark.createDataFrame(SHOP_PAGES, "page_id long, url string, html string").drop("page_id"))
    return scrape(p)["reports"]
