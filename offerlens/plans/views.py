"""Queries behind lists and dashboards."""

from __future__ import annotations

from pyspark.sql import functions as F

from offerlens.functions import price as P
from offerlens.functions import url as U
from offerlens.html.render import render_scores
from offerlens.operators import crawl
from offerlens.plans.pages import SHOP_PAGES
from offerlens.plans.registry import _REG, NOW, _registry
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


@query(f"""WITH {OFFERS_SQL} SELECT sourceSite, count(*) AS offers, min(dealPrice) AS cheapest FROM offers WHERE contains(lower(title), 'large') GROUP BY sourceSite""")
def text_filter(spark, sf_dir):
    """D10."""
    return offers(spark, sf_dir).where(F.contains(F.lower("title"), F.lit("large"))).groupBy("sourceSite").agg(F.count("*").alias("offers"), F.min("dealPrice").alias("cheapest"))


@query(f"""WITH {_REG} SELECT domain, count(*) AS pages, count(*) FILTER (status = 'active') AS active, count(*) FILTER (status = 'pinned') AS pinned FROM reg GROUP BY domain""")
def pages_by_domain(spark, sf_dir):
    """F24, F27, D11."""
    return _registry(spark, sf_dir).groupBy("domain").agg(F.count("*").alias("pages"), F.count_if(F.col("status") == "active").alias("active"), F.count_if(F.col("status") == "pinned").alias("pinned"))


@query(
    f"""WITH {_REG}, t AS (SELECT id, lastVerifiedAt - CAST({NOW} AS BIGINT) AS d FROM reg), n AS (SELECT id, d, CAST(floor(d / CAST(60000 AS DOUBLE) + 0.5) AS BIGINT) AS m, CAST(floor(d / CAST(3600000 AS DOUBLE) + 0.5) AS BIGINT) AS h, CAST(floor(d / CAST(86400000 AS DOUBLE) + 0.5) AS BIGINT) AS y FROM t)
  SELECT id, CASE WHEN d IS NULL THEN '—' WHEN abs(d) < 60000 THEN 'just now' WHEN abs(d) < 3600000 THEN CASE WHEN m > 0 THEN 'in ' || m || ' minute' || CASE WHEN m = 1 THEN '' ELSE 's' END ELSE abs(m) || ' minute' || CASE WHEN m = -1 THEN '' ELSE 's' END || ' ago' END
   WHEN abs(d) < 86400000 THEN CASE WHEN h > 0 THEN 'in ' || h || ' hour' || CASE WHEN h = 1 THEN '' ELSE 's' END ELSE abs(h) || ' hour' || CASE WHEN h = -1 THEN '' ELSE 's' END || ' ago' END
   WHEN y = -1 THEN 'yesterday' WHEN y = 1 THEN 'tomorrow' WHEN y > 0 THEN 'in ' || y || ' days' ELSE abs(y) || ' days ago' END AS verified FROM n"""
)
def relative_times(spark, sf_dir):
    """B21."""
    return _registry(spark, sf_dir).select("id", P.relative_time(F.col("lastVerifiedAt"), F.lit(NOW)).alias("verified"))


@query(
    """WITH h AS (SELECT s_suppkey, s_name, list_reduce(list_prepend(CAST(0 AS BIGINT), [CAST(ord(c) AS BIGINT) FOR c IN string_split(s_name, '')]), lambda a, b: (a * 31 + b) % 4294967296) AS h FROM supplier) SELECT s_suppkey, h % 8 AS colour FROM h"""
)
def store_colours(spark, sf_dir):
    """B19."""
    return table(spark, sf_dir, "supplier").select("s_suppkey", P.store_colour("s_name").alias("colour"))


_CENTS = "CAST(CAST(floor(p_retailprice * 4) AS BIGINT) AS DOUBLE) / 4"


@query(f"""SELECT p_partkey, '$' || regexp_replace(regexp_replace(format('{{:,.2f}}', {_CENTS}), '(\\.\\d*?)0+$', '\\1'), '\\.$', '') AS shown FROM part""")
def prices_shown(spark, sf_dir):
    """B18, at quarters of a dollar."""
    return table(spark, sf_dir, "part").select("p_partkey", P.format_price(F.floor(F.col("p_retailprice") * 4).cast("double") / 4, F.lit("USD")).alias("shown"))


@query(
    """SELECT page_id, CASE WHEN p IN ('', '/') AND q = '' THEN '(homepage)' ELSE CASE WHEN p = '' THEN '/' ELSE p END || CASE WHEN q = '' THEN '' ELSE '?' || q END END AS shown
  FROM (SELECT page_id, regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS p, regexp_extract(url, '\\?([^#]*)', 1) AS q FROM pages)"""
)
def short_paths(spark, sf_dir):
    """C38."""
    return table(spark, sf_dir, "pages").select("page_id", U.short_path("url").alias("shown"))


_MONEY = ["৳ 1,200", "Rp 99", "SAR. 45", "€12", "kr 500", "12 Tk", "$5", "₦ 700", "&#2547;300", "EQ27", ""]


@query(
    "SELECT * FROM (VALUES (0, true, true, true, true, true), (1, false, true, true, false, true), (2, false, false, true, false, false), (3, true, true, true, true, true), (4, false, false, true, false, false), (5, false, false, false, true, false), (6, false, false, false, false, false), (7, false, false, true, false, false), (8, false, false, false, true, false), (9, false, false, false, false, false), (10, false, false, false, false, false)) v(k, text, struct, money, hint, leaf)"
)
def money_predicates(spark, sf_dir):
    """The four readings of what looks like money differ."""
    t = spark.createDataFrame(list(enumerate(_MONEY)), "k int, t string")
    return t.select("k", F.col("t").rlike(P.PRICE_TEXT).alias("text"), F.col("t").rlike(P.STRUCT_PRICE).alias("struct"), F.col("t").rlike(P.MONEY_TEXT).alias("money"), F.col("t").rlike(P.PRICE_HINT).alias("hint"), P.is_price_leaf("t").alias("leaf"))


@query(
    """SELECT * FROM (VALUES (1, '12 products, many missing product links — medium confidence (50%)'), (2, 'high confidence (70%)'), (3, '0 products, nothing extracted, odd — low confidence (0%)')) v(k, why)"""
)
def confidence_texts(spark, sf_dir):
    """B20."""
    t = spark.createDataFrame([(1, 0.5, 12, ["mostly-fallback-links"]), (2, 0.7, None, None), (3, 0.0, 0, ["empty", "odd"])], "k int, score double, n int, flags array<string>")
    return t.select("k", P.confidence_text("score", "n", "flags").alias("why"))


@query(
    """WITH RECURSIVE r AS (SELECT user_id AS host, event_id, epoch_us(ts) // 1000 AS arrival, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS n FROM events),
  s AS (SELECT host, event_id, arrival, n, arrival AS start FROM r WHERE n = 1 UNION ALL SELECT r.host, r.event_id, r.arrival, r.n, greatest(r.arrival, s.start + 7200000) FROM s JOIN r ON r.host = s.host AND r.n = s.n + 1) SELECT event_id, start FROM s"""
)
def host_schedule(spark, sf_dir):
    """S8, with a gap of two hours so that requests do queue."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("host"), F.col("event_id").alias("ord"), F.unix_millis(F.col("ts").cast("timestamp")).alias("arrival"))
    return crawl.host_schedule(e, 7_200_000).select(F.col("ord").alias("event_id"), "start")


@query()
def rendering(spark, sf_dir):
    """C21 over the pages and the made shop pages."""
    made = spark.createDataFrame(SHOP_PAGES, "page_id long, url string, html string")
    return render_scores(table(spark, sf_dir, "pages").select("page_id", "html").unionByName(made.select("page_id", "html")), ["page_id"])
