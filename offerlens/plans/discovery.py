"""Queries of page discovery: verdicts, selection, warm start, precision."""

from __future__ import annotations

from pyspark.sql import functions as F

from offerlens.functions import page as G
from offerlens.functions import url as U
from offerlens.html.links import harvest
from offerlens.operators import crawl
from offerlens.operators import discovery as D
from offerlens.operators import offers as O
from offerlens.plans.offers import _six
from offerlens.sources.tables import OFFERS_SQL, offers, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


_SIX = "floor({} * 1e6 + CAST(0.5 AS DOUBLE)) / 1e6"
_V = f"""{OFFERS_SQL}, d AS (SELECT suppkey, (suppkey % 10) / CAST(10 AS DOUBLE) AS prior, suppkey % 3 = 0 AS countdown, count(*) FILTER (ord <= suppkey % 15) AS n, coalesce(avg(CASE WHEN discountPercentage >= 5 AND ord <= suppkey % 15 THEN CAST(1 AS DOUBLE) ELSE CASE WHEN ord <= suppkey % 15 THEN 0 END END), 0) AS density, (suppkey % 7) / CAST(7 AS DOUBLE) AS quality FROM offers GROUP BY suppkey)"""


def _listings(spark, sf_dir):
    """A listing for each shop: its first few offers, with made prior, quality and countdown."""
    o = offers(spark, sf_dir)
    k, inside = F.col("suppkey") % 15, F.col("ord") <= F.col("suppkey") % 15
    d = o.groupBy("suppkey").agg(F.count_if(inside).alias("n"), F.coalesce(F.avg(F.when(inside, F.when(F.col("discountPercentage") >= 5, 1.0).otherwise(0.0))), F.lit(0.0)).alias("density"))
    return d.select("suppkey", "n", "density", (F.col("suppkey") % 10 / 10.0).alias("prior"), (F.col("suppkey") % 7 / 7.0).alias("quality"), (F.col("suppkey") % 3 == 0).alias("countdown"))


@query(
    f"""WITH {_V} SELECT suppkey, CASE WHEN n < 3 THEN 'not-a-listing' WHEN density < 0.05 AND prior < 0.75 THEN 'no-discounts' WHEN NOT (n >= 8 AND quality >= 0.35 AND (density >= 0.30 OR countdown OR prior >= 0.80)) THEN 'demoted' END AS verdict,
  {_SIX.format("greatest(CAST(0 AS DOUBLE), least(CAST(1 AS DOUBLE), CAST(0.35 AS DOUBLE) * prior + CAST(0.3 AS DOUBLE) * least(CAST(1 AS DOUBLE), n / CAST(40 AS DOUBLE)) + CAST(0.2 AS DOUBLE) * density + CAST(0.15 AS DOUBLE) * quality + CASE WHEN countdown THEN CAST(0.05 AS DOUBLE) ELSE 0 END))")} AS finalScore FROM d"""
)
def verification_verdict(spark, sf_dir):
    """J14, J15."""
    l = _listings(spark, sf_dir).withColumn("finalScore", G.final_score(F.col("prior"), F.col("n"), F.col("density"), F.col("quality"), F.col("countdown")))
    return l.select("suppkey", G.verdict(F.col("n"), F.col("density"), F.col("quality"), F.col("countdown"), F.col("prior")).alias("verdict"), _six("finalScore").alias("finalScore"))


_T = """t AS (SELECT p_brand || p_size % 3 AS url, p_type AS site, list_distinct(list(p_name)) AS w FROM part GROUP BY ALL)"""


@query(
    f"""WITH {_T} SELECT a.site, a.url AS a, b.url AS b FROM t a JOIN t b ON a.site = b.site AND a.url < b.url WHERE CAST(len(list_intersect(a.w, b.w)) AS DOUBLE) / len(list_distinct(list_concat(a.w, b.w))) >= 0.3"""
)
def duplicate_listing_pairs(spark, sf_dir):
    """F7, E10 as pairs within a site."""
    from offerlens.functions.text import jaccard

    t = table(spark, sf_dir, "part").groupBy(F.concat("p_brand", F.col("p_size") % 3).alias("url"), F.col("p_type").alias("site")).agg(F.collect_set("p_name").alias("w"))
    a, b = (t.select("site", F.col("url").alias(x), F.col("w").alias(f"w{x}")) for x in "ab")
    return a.join(b, "site").where("a < b").where(jaccard("wa", "wb") >= 0.3).select("site", "a", "b")


@query()
def duplicate_listing_collapse(spark, sf_dir):
    """Greedy, in score order."""
    t = table(spark, sf_dir, "part").groupBy(F.concat("p_brand", F.col("p_size") % 3).alias("url"), F.col("p_type").alias("site")).agg(F.collect_set("p_name").alias("tokens"), F.avg("p_retailprice").alias("score"))
    return O.same_listings(t, ["site"], overlap=0.3)


@query()
def discovery_selection(spark, sf_dir):
    """J12-J19 over all sites of the pages table: harvested links, probes where the links do not suffice, made
    checks, the walk of each site with the listings of the same titles collapsed."""
    pages = table(spark, sf_dir, "pages").withColumn("site", U.host("url"))
    links = harvest(pages, ["site"])
    scored = D.intake(links.withColumn("root", F.concat(F.lit("https://"), "site", F.lit("/"))), F.col("root"), 11, exclude=["/was"], include=["/the"])
    cands = D.best_candidates(scored).persist()  # used by probes, checks, hubs and the walk
    homes = pages.groupBy("site").agg(F.min(F.regexp_extract("url", "^(https?://[^/?#]+)", 1)).alias("origin"), F.max(G.platform("html")).alias("platform"))
    probed = crawl.probes(homes, cands).withColumn("ord", F.lit(10_000) + F.col("ord")).withColumn("source", F.lit("probe")).withColumn("prior", F.lit(0.5))
    tiers = cands.withColumn("tier", F.lit(0)).unionByName(probed.select(*cands.columns, F.lit(3).alias("tier"))).withColumn("reject", F.lit(None).cast("string"))
    cands = D.by_tier(tiers).select(*cands.columns).persist()  # platforms are told once
    h = F.pmod(F.xxhash64("url"), F.lit(100))
    checks = cands.select("site", "url", (h % 50).alias("productCount"), (h / 100.0).alias("density"), (F.pmod(h * 7, F.lit(100)) / 100.0).alias("quality"), (h % 9 == 0).alias("countdown"), F.when(h % 23 == 0, "blocked:captcha").alias("reason"), F.transform(F.sequence(F.lit(0), h % 20), lambda i: F.concat(F.lit("t"), i)).alias("titles"))
    hubs = cands.alias("a").join(cands.alias("b"), "site").where("a.url <> b.url AND b.ord BETWEEN a.ord + 1 AND a.ord + 12").select("site", F.col("a.url").alias("hub"), F.col("b.url").alias("url"), F.col("b.ord").alias("ord"), F.lit(0.7).alias("prior"))
    return D.select_pages(cands, checks, hubs)


_S = """v AS (SELECT s, u, r FROM (VALUES ('a', 'a1', 1), ('a', 'a2', 2), ('a', 'a3', 3), ('b', 'b1', 1), ('b', 'b2', 2)) x(s, u, r)), g AS (SELECT * FROM (VALUES ('a', 'a1'), ('a', 'a3'), ('b', 'b2'), ('b', 'b9'), ('c', 'c1')) x(s, u))"""


@query(
    f"""WITH {_S}, p AS (SELECT v.s, count(g.u) AS hits, CAST(count(g.u) AS DOUBLE) / least(5, count(*)) AS precision FROM v LEFT JOIN g ON v.s = g.s AND v.u = g.u WHERE r <= 5 GROUP BY v.s), w AS (SELECT s, count(*) AS n FROM g GROUP BY s)
  SELECT w.s AS site, coalesce(precision, 0) AS precision, coalesce(hits, 0) = n AS full_recall FROM w LEFT JOIN p ON w.s = p.s"""
)
def precision_at_5(spark, sf_dir):
    """F26 over made selections."""
    sel = spark.createDataFrame([("a", "a1", 1), ("a", "a2", 2), ("a", "a3", 3), ("b", "b1", 1), ("b", "b2", 2)], "site string, url string, rank int")
    truth = spark.createDataFrame([("a", "a1"), ("a", "a3"), ("b", "b2"), ("b", "b9"), ("c", "c1")], "site string, url string")
    return D.precision_at(sel, truth)


@query(
    """WITH s AS (SELECT 'd' || (user_id % 20) AS site, user_id, CASE user_id % 4 WHEN 0 THEN 'active' WHEN 1 THEN 'pinned' WHEN 2 THEN 'stale' ELSE 'parked' END AS status, count(*) AS n FROM events GROUP BY user_id),
  v AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY n, 'u' || user_id) AS k FROM s WHERE status IN ('active', 'pinned') OR (status = 'stale' AND n <= 70)),
  r AS (SELECT site, k <= 6 AS checked, k <= 6 AND user_id % 3 > 0 AS alive, user_id % 2 = 0 AS changed FROM v), m AS (SELECT DISTINCT site FROM s WHERE status = 'parked' AND user_id % 11 = 0),
  a AS (SELECT site, count(*) AS saved, count(*) FILTER (checked) AS checked, count(*) FILTER (alive) AS alive, count(*) FILTER (alive AND changed) AS changed FROM r GROUP BY site)
  SELECT site, saved, checked, alive, changed, alive > 0 AND alive * 2 >= checked AND site NOT IN (SELECT site FROM m) AS warm FROM a"""
)
def warm_start(spark, sf_dir):
    """A user's parked pages of every eleventh number are pinned for this run and not among the saved ones."""
    u = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("nextCheckAt"))
    k = F.col("user_id") % 4
    status = F.when(k == 0, "active").when(k == 1, "pinned").when(k == 2, "stale").otherwise("parked")
    url = F.concat(F.lit("u"), "user_id")
    saved = u.select(F.concat(F.lit("d"), F.col("user_id") % 20).alias("site"), url.alias("url"), status.alias("status"), "nextCheckAt", F.lit("f").alias("fingerprint"))
    checks = u.select(url.alias("url"), F.when(F.col("user_id") % 3 == 0, "not-a-listing").alias("reason"), F.when(F.col("user_id") % 2 == 0, "g").otherwise("f").alias("fingerprint"))
    pins = saved.where((F.substring("url", 2, 20).cast("long") % 11 == 0) & (F.col("status") == "parked")).select("site", "url")
    return D.warm_start(saved, checks, 70, pins)


_TIERS = """t AS (SELECT p_brand || '/' || p_size % 5 AS site, p_name || p_partkey % 3 AS url, p_partkey % 4 AS tier, CASE WHEN p_partkey % 13 = 0 THEN 'neg-token:x' END AS reject, (p_partkey % 100) / CAST(100 AS DOUBLE) AS prior FROM part)"""


@query(
    f"""WITH {_TIERS}, s AS (SELECT site, url, min(tier) AS tier FROM t WHERE reject IS NULL AND prior >= 0.55 GROUP BY site, url)
  SELECT site, tier, count(*) AS candidates FROM t WHERE (SELECT count(*) FROM s WHERE s.site = t.site AND s.tier < t.tier) < 4 GROUP BY site, tier"""
)
def discovery_tiers(spark, sf_dir):
    """The candidates of each tier that is asked; sites, tiers and priors are made from parts."""
    k = F.col("p_partkey")
    t = table(spark, sf_dir, "part").select(F.concat("p_brand", F.lit("/"), F.col("p_size") % 5).alias("site"), F.concat("p_name", k % 3).alias("url"), (k % 4).alias("tier"), F.when(k % 13 == 0, "neg-token:x").alias("reject"), (k % 100 / 100.0).alias("prior"))
    return D.by_tier(t).groupBy("site", "tier").agg(F.count("*").alias("candidates"))


_PROBED = """p AS (SELECT page_id, url, regexp_extract(url, '^https?://([^/?#:]+)', 1) AS site, nullif(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '^\\s+|\\s+$', '', 'g'), '') AS title FROM pages)"""


@query(
    f"""WITH {_PROBED}, h AS (SELECT site, arg_min(title, page_id) AS title FROM p GROUP BY site) SELECT p.page_id, p.page_id % 7 <> 0 AND (p.title IS NULL OR h.title IS NULL OR p.title <> h.title) AS hit FROM p JOIN h USING (site)"""
)
def probe_answers(spark, sf_dir):
    """Every page as a probe of its site, whose first page is the home; every seventh gives no answer."""
    p = table(spark, sf_dir, "pages").withColumn("site", F.regexp_extract("url", "^https?://([^/?#:]+)", 1))
    probed = p.select("site", "page_id", F.concat("url", F.lit("#"), "page_id").alias("url"))
    homes = p.groupBy("site").agg(F.min_by("html", "page_id").alias("html"))
    answers = p.where("page_id % 7 <> 0").select(F.concat("url", F.lit("#"), "page_id").alias("url"), "html")
    return crawl.judge_probes(probed, answers, homes).select("page_id", "hit")


@query(
    """WITH p AS (SELECT page_id, url, lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)) AS h FROM pages), d AS (SELECT *, list_aggregate(string_split(h, '.')[-2:], 'string_agg', '.') AS site FROM p), f AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY page_id) AS n FROM d)
  SELECT page_id, site, 'discover' AS route FROM f WHERE n = 1 UNION ALL SELECT min(page_id), site, 'direct' FROM d GROUP BY url, site"""
)
def discovery_routing(spark, sf_dir):
    """D4 in mode always: the first page of each site to discovery, and every page as it is."""
    t = table(spark, sf_dir, "pages").select("page_id", "url", F.col("page_id").alias("ord"))
    return D.route(t, "always").select("page_id", "site", "route")


@query(
    """WITH d AS (SELECT url, min(page_id) AS ord FROM pages WHERE page_id % 3 = 0 GROUP BY url), f AS (SELECT url, min(page_id) AS ord FROM pages WHERE page_id % 2 = 0 GROUP BY url)
  SELECT coalesce(d.url, f.url) AS url, CASE WHEN d.url IS NULL THEN 'discovered' ELSE 'direct' END AS route, coalesce(d.ord, f.ord) AS ord FROM d FULL JOIN f ON d.url = f.url"""
)
def request_targets(spark, sf_dir):
    """Every third page is asked for, every second one is discovered."""
    p = table(spark, sf_dir, "pages").select("url", F.col("page_id").alias("ord"))
    return D.all_targets(p.where("ord % 3 = 0"), p.where("ord % 2 = 0"))


@query(
    """WITH f AS (SELECT url, 'site' || min(page_id) AS discoveredFrom, min(page_id) / CAST(4 AS DOUBLE) AS candidateScore FROM pages WHERE page_id % 2 = 0 GROUP BY url)
  SELECT page_id, f.discoveredFrom, CASE WHEN page_id % 5 = 0 THEN CAST(9 AS DOUBLE) ELSE f.candidateScore END AS candidateScore FROM pages p LEFT JOIN f ON p.url = f.url"""
)
def report_provenance(spark, sf_dir):
    """Reports of all pages, every fifth with a score of its own; every second page was discovered."""
    p = table(spark, sf_dir, "pages").select("page_id", "url")
    reports = p.select("page_id", F.col("url").alias("key"), F.when(F.col("page_id") % 5 == 0, 9.0).alias("candidateScore"))
    found = p.where("page_id % 2 = 0").select("url", F.col("page_id").alias("ord"), F.concat(F.lit("site"), "page_id").alias("discoveredFrom"), (F.col("page_id") / 4.0).alias("candidateScore"))
    return D.provenance(reports, found).select("page_id", "discoveredFrom", "candidateScore")
