"""Readers of the driver's tables, and offers and check events derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from offerlens.functions import price as P

LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
CURRENCY = {"AMERICA": "USD", "ASIA": "INR", "EUROPE": "EUR", "MIDDLE EAST": "GBP"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def part_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.concat_ws(" ", "p_name", "p_brand", "p_type", F.concat(F.lit("pk"), "p_partkey")).alias("title"))


def offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One offer for each line item; ord is its place among its supplier's, by the line's own columns."""
    t = lambda name: table(spark, sf_dir, name)
    region = F.lit(P.DEFAULT_CURRENCY)
    for name, code in CURRENCY.items():
        region = F.when(F.col("r_name") == name, code).otherwise(region)
    shops = t("supplier").join(F.broadcast(t("nation")), F.col("s_nationkey") == F.col("n_nationkey")).join(F.broadcast(t("region")), F.col("n_regionkey") == F.col("r_regionkey"))
    shops = shops.select("s_suppkey", F.col("s_name").alias("sourceSite"), region.alias("currency"))
    full = F.col("l_extendedprice") / F.col("l_quantity")
    lines = t("lineitem").join(part_titles(spark, sf_dir), F.col("l_partkey") == F.col("p_partkey")).join(shops, F.col("l_suppkey") == F.col("s_suppkey"))
    deal = full * (F.lit(1.0) - F.col("l_discount"))
    shop_url = F.concat(F.lit("https://shop"), F.col("l_suppkey"), F.lit(".test/"))
    return lines.select(
        F.col("l_suppkey").alias("suppkey"),
        F.row_number().over(Window.partitionBy("l_suppkey").orderBy(*LINE)).cast("long").alias("ord"),
        "title",
        full.alias("originalPrice"),
        deal.alias("dealPrice"),
        P.compute_discount(full, deal).alias("discountPercentage"),
        "currency",
        "sourceSite",
        F.when(F.col("l_linenumber") % 4 == 0, shop_url).otherwise(F.concat(shop_url, F.lit("p/"), F.col("l_partkey"), F.lit("?o="), F.col("l_orderkey"))).alias("productUrl"),
        F.when(F.col("l_linenumber") % 3 != 0, F.concat(F.lit("https://img.test/"), F.col("l_partkey"), F.lit(".png"))).alias("imageUrl"),
        shop_url.alias("pageUrl"),
        F.col("l_linenumber").alias("line"),
    )


OFFERS_SQL = f"""offers AS (
  SELECT l_suppkey AS suppkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY {", ".join(LINE)}) AS ord,
    p_name || ' ' || p_brand || ' ' || p_type || ' pk' || p_partkey AS title, l_extendedprice / l_quantity AS originalPrice,
    l_extendedprice / l_quantity * (CAST(1 AS DOUBLE) - l_discount) AS dealPrice,
    CASE WHEN l_extendedprice / l_quantity > l_extendedprice / l_quantity * (CAST(1 AS DOUBLE) - l_discount)
      THEN CAST(floor((l_extendedprice / l_quantity - l_extendedprice / l_quantity * (CAST(1 AS DOUBLE) - l_discount)) / (l_extendedprice / l_quantity) * 100 + CAST(0.5 AS DOUBLE)) AS BIGINT) END AS discountPercentage,
    CASE r_name {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in CURRENCY.items())} ELSE 'BDT' END AS currency, s_name AS sourceSite,
    CASE WHEN l_linenumber % 4 = 0 THEN 'https://shop' || l_suppkey || '.test/' ELSE 'https://shop' || l_suppkey || '.test/p/' || l_partkey || '?o=' || l_orderkey END AS productUrl,
    CASE WHEN l_linenumber % 3 <> 0 THEN 'https://img.test/' || l_partkey || '.png' END AS imageUrl, 'https://shop' || l_suppkey || '.test/' AS pageUrl, l_linenumber AS line
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page checks from events: a user is a page; purchase, click and view are ok (view: changed), signup a miss, error blocked."""
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "signup", "miss").when(F.col("event_type") == "error", "blocked").otherwise("ok")
    return e.select(F.col("user_id").alias("record_id"), "ts", "event_id", kind.alias("kind"), (F.get_json_object("props", "$.k").cast("double") / 100.0).alias("density"), (F.col("event_type") == "view").alias("changed"))


CHECKS_SQL = """checks AS (
  SELECT user_id AS record_id, ts, event_id, CASE event_type WHEN 'signup' THEN 'miss' WHEN 'error' THEN 'blocked' ELSE 'ok' END AS kind,
    CAST(json_extract_string(props, '$.k') AS DOUBLE) / CAST(100 AS DOUBLE) AS density, event_type = 'view' AS changed FROM events)"""
