"""Whole requests as functions over tables of collected pages: compare offers, discover pages, add a page."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from offerlens.functions import page as G
from offerlens.functions import price as P
from offerlens.functions import url as U
from offerlens.html.extract import RUNGS, extract_offers
from offerlens.html.links import next_page
from offerlens.operators import crawl
from offerlens.operators import discovery as D
from offerlens.operators import offers as O
from offerlens.operators import registry as R


@dataclass(frozen=True)
class Options:
    """A request's options, checked."""

    mode: str = "auto"
    min_discount: float = 0
    include: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)
    most_targets: int = 10
    cap: int = 200
    most_pages: int = 5

    def __post_init__(self):
        if self.mode not in ("auto", "always", "never"):
            raise ValueError(f"mode {self.mode!r}")
        if not 0 <= self.min_discount <= 100:
            raise ValueError("min_discount must be 0..100")
        for name in ("include", "exclude"):
            patterns = getattr(self, name)
            if len(patterns) > 50 or any(not p or len(p) > 200 for p in patterns):
                raise ValueError(f"{name}: at most 50 patterns of 1..200 characters")
        if not 1 <= self.most_targets <= 10:
            raise ValueError("most_targets must be 1..10")


def targets(spark, urls: list[str], registry: DataFrame | None = None, most: int = 10) -> DataFrame:
    """A1, A2: a request's pages in order; without any, the saved active and pinned ones."""
    if urls:
        t = spark.createDataFrame(list(enumerate(urls)), "ord int, raw string").select("ord", U.normalize_url("raw").alias("url"))
    elif registry is not None:
        t = registry.where(F.col("status").isin("active", "pinned")).select(F.lit(0).alias("ord"), "url")
    else:
        raise ValueError("no targets")
    return t.where("url is not null").groupBy("url").agg(F.min("ord").alias("ord")).orderBy("ord", "url").limit(most)


def scrape(pages: DataFrame, wanted: DataFrame | None = None, options: Options = Options(), found: DataFrame | None = None) -> dict[str, DataFrame]:  # noqa: B008 - frozen
    """Offers, reports and comparison groups of pages (url, html): extraction, merge, quality, filters, groups.

    wanted (url) narrows the pages; then the collected further pages of each one's listing count with it, up to
    the first that adds nothing (J8). A column run of the pages tells comparisons apart, else all are one. found
    (url, ord, discoveredFrom, candidateScore) says which pages discovery gave; its first row of a page goes on the
    page's report (E1).
    """
    run = F.col("run") if "run" in pages.columns else F.lit(1)
    p = pages.withColumn("run", run)
    if wanted is None:
        p = p.withColumn("start", F.col("url")).withColumn("n", F.lit(0))
    else:
        follow = F.udf(next_page, StringType(), useArrow=True)
        nexts = p.select("url", follow("html", "url").alias("next")).where("next is not null")
        starts = wanted.select("url").distinct()
        p = p.join(crawl.page_chains(starts, nexts, options.most_pages), "url")
    p = p.withColumn("site", U.site_name("start")).withColumn("key", U.canonicalize("start"))
    raw = extract_offers(p, ["run", "key", "n"]).withColumn("page", F.col("key")).withColumn("ord", F.col("n") * 1_000_000 + F.col("ord"))
    if wanted is not None:
        raw = crawl.until_nothing_new(raw, p.select("run", "key", "n").distinct(), ["run", "key"])
    by = ["run", "key"]
    merged = O.merge(raw, by, options.cap, "page")
    first = p.where("n = 0")
    told = first.groupBy(by).agg(F.first("site").alias("site"), F.max(P.claimed_total("html")).alias("claimed"), F.max(G.detect_block("html")).alias("blockReason"), F.max(G.render_type("html")).alias("renderType"))
    q = O.quality(merged.join(told.select(*by, "claimed"), by), by, F.col("key"), F.col("claimed"))
    order = F.array(*map(F.lit, RUNGS))
    rungs = raw.groupBy(by).agg(F.collect_set("rung").alias("r_"), F.max("selector").alias("selector"))
    rungs = rungs.select(*by, F.filter(order, lambda x: F.array_contains("r_", x)).alias("rungs"), "selector")
    reports = D.reports(told.join(q, by, "left").join(rungs, by, "left").withColumn("productCount", F.coalesce("productCount", F.lit(0))))
    if found is not None:
        reports = D.provenance(reports, found)
    offers = O.min_discount(merged, options.min_discount)
    groups = O.comparison_groups(offers.withColumn("ord", F.xxhash64("key") % 1_000_000 * 100_000_000 + F.col("ord")), ["run"])
    if "run" not in pages.columns:
        offers, reports, groups = (d.drop("run") for d in (offers, reports, groups))
    return {"offers": offers, "reports": reports, "groups": groups}


def add_page(registry: DataFrame, url: str, listing: DataFrame, now: int) -> DataFrame:
    """A registry with a page added by hand as active once it is verified; known pages stay as they are.

    listing: productCount, originalPrice, discountPercentage of the page's offers. Its median per cent is the
    upper one. An excluded page is refused.
    """
    spark = registry.sparkSession
    one = spark.createDataFrame([(url,)], "raw string").select(U.canonicalize("raw").alias("url")).where("url is not null")
    key = one.select("url", F.substring(F.sha1(F.col("url").cast("binary")), 1, 16).alias("id"))
    known = registry.join(key.select("id"), "id", "left_semi").select("status").first()
    if known is not None and known["status"] == "excluded":
        raise PermissionError(f"{url} is excluded")
    if known is not None:
        return registry
    discounted = F.col("originalPrice").isNotNull() | (F.coalesce("discountPercentage", F.lit(0)) > 0)
    pct = F.sort_array(F.collect_list("discountPercentage"))
    v = listing.agg(F.count("*").alias("n"), F.coalesce(F.avg(F.when(discounted, 1.0).otherwise(0.0)), F.lit(0.0)).alias("dealDensity"), F.get(pct, F.floor(F.size(pct) / 2).cast("int")).alias("medianDiscountPct"))
    row = key.crossJoin(v.where("n > 0")).select("id", "url", U.registrable_domain(U.host("url")).alias("domain"), F.lit("active").alias("status"), "dealDensity", F.lit(now).alias("lastVerifiedAt"), (F.lit(now) + P.js_round(R.interval_hours(F.lit(0.0), F.col("dealDensity")) * R.HOUR)).alias("nextCheckAt"))
    return registry.unionByName(row, allowMissingColumns=True).select(*registry.columns)
