"""Robots rules, sitemaps and page chains as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from offerlens.functions import page as G
from offerlens.functions import url as U

LOC, LASTMOD = r"(?i)<loc>\s*([^<]+?)\s*</loc>", r"(?i)<lastmod>\s*([^<]+?)\s*</lastmod>"
TITLE = r"(?is)<title[^>]*>(.*?)</title>"
MOST_ENTRIES = 20_000
MOST_SITEMAPS, SITEMAP_CHARS = 4, 5 * 1024 * 1024
MOST_PROBES = 8


def robots_rules(robots: DataFrame) -> DataFrame:
    """(site, ord, kind, value) of the rules for every agent, and of all sitemaps, from (site, body)."""
    lines = robots.select("site", F.posexplode(F.split("body", r"\r?\n")).alias("ord", "line"))
    lines = lines.select("site", "ord", F.trim(F.regexp_replace("line", "#.*$", "")).alias("line"))
    parts = lines.select("site", "ord", F.lower(F.trim(F.substring_index("line", ":", 1))).alias("kind"), F.trim(F.regexp_replace("line", "^[^:]*:", "")).alias("value")).where(F.col("kind").isin("user-agent", "allow", "disallow", "sitemap"))
    w = Window.partitionBy("site").orderBy("ord")
    # a group begins with an agent line after a rule line; it holds for all if any of its agents is *
    rule = F.col("kind").isin("allow", "disallow")
    parts = parts.withColumn("before_", F.lag(rule).over(Window.partitionBy("site").orderBy("ord")))
    parts = parts.withColumn("group_", F.sum(F.when((F.col("kind") == "user-agent") & F.coalesce("before_", F.lit(True)), 1).otherwise(0)).over(w))
    every = F.max(F.when((F.col("kind") == "user-agent") & (F.col("value") == "*"), True).otherwise(False)).over(Window.partitionBy("site", "group_"))
    parts = parts.withColumn("every_", every)
    return parts.where((F.col("kind") == "sitemap") | (rule & F.col("every_"))).select("site", "ord", "kind", "value")


def allowed(paths: DataFrame, rules: DataFrame, by: str = "site") -> DataFrame:
    """Paths with `allowed`: the longest rule that begins the path, allow on ties; none allows."""
    r = rules.where(F.col("kind").isin("allow", "disallow") & (F.col("value") != "")).select(by, F.col("value").alias("prefix"), (F.col("kind") == "allow").alias("ok"))
    listed = r.groupBy(by).agg(F.collect_list(F.struct(F.length("prefix").alias("n"), "ok", "prefix")).alias("rules_"))
    best = F.array_max(F.filter("rules_", lambda x: F.col("path").startswith(x["prefix"])))
    return paths.join(listed, by, "left").withColumn("allowed", F.coalesce(best["ok"], F.lit(True))).drop("rules_")


def parse_sitemaps(docs: DataFrame) -> DataFrame:
    """(url, kind, ord, loc, lastmod) of each document (url, xml); an index only if it lists no pages."""
    xml = F.col("xml")
    kind = F.when(xml.rlike("(?i)<urlset"), "urlset").when(xml.rlike("(?i)<sitemapindex"), "index").otherwise("unknown")
    block = F.when(kind == "index", F.regexp_extract_all(xml, F.lit(r"(?is)<sitemap\b[^>]*>(.*?)</sitemap>"), F.lit(1))).when(kind == "urlset", F.regexp_extract_all(xml, F.lit(r"(?is)<url\b[^>]*>(.*?)</url>"), F.lit(1))).otherwise(F.array().cast("array<string>"))
    rows = docs.select("url", kind.alias("kind"), F.posexplode(F.slice(block, 1, MOST_ENTRIES)).alias("ord", "b"))
    text = F.regexp_extract("b", LOC, 1)
    for entity, c in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(c))
    return rows.select("url", "kind", "ord", text.alias("loc"), F.nullif(F.regexp_extract("b", LASTMOD, 1), F.lit("")).alias("lastmod")).where("loc <> ''")


def walk_sitemaps(roots: DataFrame, docs: DataFrame, most: int = MOST_SITEMAPS) -> DataFrame:
    """A10: (site, place, ord, loc, lastmod) of the pages listed below the roots (site, url, ord).

    Documents are read breadth first, `most` of them a site, a missing or repeated one included; product maps are
    not followed, and a document ends after 5 M characters. place is the document's place in that order.
    """
    parsed = parse_sitemaps(docs.withColumn("xml", F.substring("xml", 1, SITEMAP_CHARS)))
    index = parsed.where((F.col("kind") == "index") & ~F.lower(U.path("loc")).rlike("product|item|sku|catalog")).select("url", "ord", "loc")
    nth = F.row_number().over(Window.partitionBy("site").orderBy("ord", "url"))
    now = roots.select("site", "url", nth.alias("place")).where(F.col("place") <= most)
    visited = now
    for _ in range(most - 1):  # a level takes a place at least
        after = now.groupBy("site").agg(F.max("place").alias("after"))
        nth = F.row_number().over(Window.partitionBy("site").orderBy("place", "ord"))
        below = now.join(index, "url").join(after, "site").select("site", F.col("loc").alias("url"), (F.col("after") + nth).alias("place"))
        now = below.where(F.col("place") <= most)
        visited = visited.unionByName(now)
    return visited.join(parsed.where("kind = 'urlset'"), "url").select("site", "place", "ord", "loc", "lastmod")


def page_chains(starts: DataFrame, nexts: DataFrame, most: int = 5) -> DataFrame:
    """The pages of a listing: from each start along (url, next) to a repeat or so many pages."""
    now = starts.select(F.col("url").alias("start"), "url", F.lit(0).alias("n"), F.array("url").alias("seen"))
    out = now
    for k in range(1, most):
        now = now.join(nexts, "url").where(~F.array_contains("seen", F.col("next"))).select("start", F.col("next").alias("url"), F.lit(k).alias("n"), F.concat("seen", F.array("next")).alias("seen"))
        out = out.unionByName(now)
    return out.select("start", "n", "url")


def until_nothing_new(offers: DataFrame, chain: DataFrame, by: list[str]) -> DataFrame:
    """A listing's offers (by, n, title, dealPrice) up to its first further page that adds none, repeats included."""
    new = offers.groupBy(*by, F.lower("title"), "dealPrice").agg(F.min("n").alias("n")).select(*by, "n").distinct().withColumn("new_", F.lit(True))
    stop = chain.where("n > 0").join(new, [*by, "n"], "left").where("new_ is null").groupBy(by).agg(F.min("n").alias("stop_"))
    return offers.join(stop, by, "left").where(F.col("stop_").isNull() | (F.col("n") <= F.col("stop_"))).select(*offers.columns)


def probes(homes: DataFrame, known: DataFrame, most: int = MOST_PROBES) -> DataFrame:
    """(site, url, path, ord) of the first conventional paths of each home's platform that are not known yet."""
    paths = homes.select("site", F.posexplode(G.probe_paths(F.coalesce("platform", F.lit("unknown")))).alias("ord", "path"), "origin")
    urls = paths.select("site", U.canonicalize(F.concat("origin", "path")).alias("url"), "path", "ord").where("url is not null")
    urls = urls.groupBy("site", "url").agg(F.min_by("path", "ord").alias("path"), F.min("ord").alias("ord"))
    urls = urls.join(known.select("site", "url"), ["site", "url"], "left_anti")
    nth = F.row_number().over(Window.partitionBy("site").orderBy("ord"))
    return urls.withColumn("n_", nth).where(F.col("n_") <= most).drop("n_")


def judge_probes(probed: DataFrame, answers: DataFrame, homes: DataFrame) -> DataFrame:
    """Probes (site, url, path) with `hit`: answered (url, html), and not with the title of the home (site, html),
    which many shops serve for paths they do not know. The paths that miss are the site's negative paths."""
    title = lambda c: F.nullif(F.regexp_replace(F.regexp_extract(c, TITLE, 1), r"^\s+|\s+$", ""), F.lit(""))
    home = homes.groupBy("site").agg(title(F.max("html")).alias("home_"))
    got = answers.groupBy("url").agg(F.max("html").alias("html_"))
    rows = probed.join(got, "url", "left").join(home, "site", "left")
    soft = F.coalesce(title(F.col("html_")) == F.col("home_"), F.lit(False))
    return rows.withColumn("hit", F.col("html_").isNotNull() & ~soft).select(*probed.columns, "hit")


def host_schedule(requests: DataFrame, gap_ms: int = 1000) -> DataFrame:
    """When each request (host, ord, arrival) starts if a host's starts keep a gap.

    start(i) = max(arrival(i), start(i - 1) + gap), which is i * gap + the running maximum of arrival(j) - j * gap.
    """
    w = Window.partitionBy("host").orderBy("arrival", "ord")
    n = F.row_number().over(w)
    lead = F.max(F.col("arrival") - F.col("n_") * gap_ms).over(w)
    return requests.withColumn("n_", n).withColumn("start", lead + F.col("n_") * gap_ms).drop("n_")


def frames_if_empty(pages: DataFrame, frames: DataFrame, offers: DataFrame) -> DataFrame:
    """Child frames (url, frame_url, html) only of pages that gave no offer."""
    return frames.join(pages.select("url"), "url", "left_semi").join(offers.select("url").distinct(), "url", "left_anti")
