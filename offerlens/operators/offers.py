"""Operators over offers: merge, quality, filters, attempts, cross-shop groups.

An offer has: ord, title, originalPrice, dealPrice, discountPercentage, currency, sourceSite, productUrl, imageUrl.
"""

from __future__ import annotations

import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from offerlens.functions import price as P
from offerlens.functions import text as X


def merge(offers: DataFrame, by: list[str], cap: int = 200, page_url: str | None = None, batch: str | None = None) -> DataFrame:
    """one offer for each (lower title, deal price) of a group `by`, missing parts filled from later ones.

    The first is kept; its image from the first that has one; its link, if a page's own URL, from the first
    that is none of the pages seen by then; its original price, and the per cent with it, from the first that
    is greater than the deal price. The first `cap` keys of a group are kept. With `batch`, pages count as seen
    from their batch on.
    """
    key = [*by, "key_title", "dealPrice"]
    rows = offers.withColumn("key_title", F.lower("title"))
    url = F.col(page_url) if page_url else F.lit(None).cast("string")
    rows = rows.withColumn("page_url_", url).withColumn("batch_", F.col(batch) if batch else F.lit(0))
    pages = F.col("pages_") if page_url else F.array().cast("array<struct<b:int,u:string>>")
    if page_url:
        seen = rows.groupBy(by).agg(F.collect_set(F.struct(F.col("batch_").alias("b"), F.col("page_url_").alias("u"))).alias("pages_"))
        rows = rows.join(seen, by)
    is_page = lambda link, b: F.exists(pages, lambda p: (p["u"] == link) & (p["b"] <= b))
    item = F.struct("ord", "batch_", "title", "originalPrice", "discountPercentage", "currency", "sourceSite", "productUrl", "imageUrl")
    got = rows.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("rows"), *([F.first("pages_").alias("pages_")] if page_url else []))
    first = F.col("rows")[0]
    pick = lambda cond: F.get(F.filter("rows", cond), F.lit(0))
    image = pick(lambda r: F.coalesce(r["imageUrl"], F.lit("")) != "")["imageUrl"]
    better = lambda link, r: is_page(link, r["batch_"]) & (F.coalesce(r["productUrl"], F.lit("")) != "") & ~is_page(r["productUrl"], r["batch_"])
    # an upgraded link may turn out to be a page of a later batch, so this is a fold over the key's rows
    link = F.aggregate("rows", first["productUrl"], lambda link, r: F.when(better(link, r), r["productUrl"]).otherwise(link))
    filled = pick(lambda r: r["originalPrice"] > F.col("dealPrice"))
    own = first["originalPrice"].isNotNull()
    out = got.select(
        *by,
        first["ord"].alias("ord"),
        first["title"].alias("title"),
        F.when(own, first["originalPrice"]).otherwise(filled["originalPrice"]).alias("originalPrice"),
        "dealPrice",
        F.when(own | first["discountPercentage"].isNotNull(), first["discountPercentage"]).otherwise(filled["discountPercentage"]).alias("discountPercentage"),
        first["currency"].alias("currency"),
        first["sourceSite"].alias("sourceSite"),
        link.alias("productUrl"),
        F.coalesce(image, first["imageUrl"]).alias("imageUrl"),
    )
    nth = F.row_number().over(Window.partitionBy(by).orderBy("ord"))
    return out.withColumn("nth_", nth).where(F.col("nth_") <= cap).drop("nth_")


def first_by_price(offers: DataFrame, by: list[str], cap: int = 200) -> DataFrame:
    """the first offer of each (lower title, deal price), `cap` of a group at most."""
    w = Window.partitionBy(*by, F.lower("title"), "dealPrice").orderBy("ord")
    kept = offers.withColumn("n_", F.row_number().over(w)).where("n_ = 1")
    return kept.withColumn("n_", F.row_number().over(Window.partitionBy(by).orderBy("ord"))).where(F.col("n_") <= cap).drop("n_")


def quality(offers: DataFrame, by: list[str], page_url: Column, claimed: Column | None = None) -> DataFrame:
    """how well an extraction went: shares, coverage, flags and a score, one row for each group."""
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    rows = offers.withColumn("page_", page_url).withColumn("claim_", claimed if claimed is not None else F.lit(None).cast("long"))
    q = rows.groupBy(by).agg(
        F.count("*").alias("productCount"),
        share(~F.col("productUrl").eqNullSafe(F.col("page_"))).alias("links"),
        share(F.coalesce("imageUrl", F.lit("")) != "").alias("pctWithImage"),
        share(F.col("originalPrice").isNotNull()).alias("pctWithOriginalPrice"),
        F.min("dealPrice").alias("lo"),
        F.max("dealPrice").alias("hi"),
        F.max("claim_").alias("claimedTotal"),
    )
    n = F.col("productCount")
    q = q.withColumn("pctWithRealLink", F.when(n == 1, F.lit(1.0)).otherwise(F.col("links"))).withColumn("coverage", F.when(F.col("claimedTotal") >= n, n / F.col("claimedTotal")))
    same, wide = (n > 1) & (F.col("lo") == F.col("hi")), (n > 2) & (F.col("lo") > 0) & (F.col("hi") / F.col("lo") > 500)
    mix = F.lit(0.35) * F.col("pctWithRealLink") + F.lit(0.25) * F.col("pctWithImage") + F.lit(0.15) * F.col("pctWithOriginalPrice") + F.lit(0.25) * F.least(F.coalesce("coverage", F.lit(0.0)), F.lit(1.0))
    raw = mix / (F.lit(0.75) + F.when(F.col("coverage").isNotNull(), 0.25).otherwise(0.0))
    flags = F.array_compact(F.array(F.when(same, "all-prices-identical"), F.when(wide, "extreme-variance"), F.when((F.col("pctWithRealLink") < 0.5) & (n > 1), "mostly-fallback-links"), F.when(F.col("coverage") < 0.2, "low-coverage")))
    score = P.clamp01(raw * F.when(same, 0.3).otherwise(1.0) * F.when(wide, 0.7).otherwise(1.0))
    return q.select(*by, "productCount", "pctWithRealLink", "pctWithImage", "pctWithOriginalPrice", "claimedTotal", "coverage", score.alias("score"), flags.alias("flags"))


def best_attempt(attempts: DataFrame, by: list[str], good: float = 0.35) -> DataFrame:
    """Of tries in order `attempt` with `score`: later ones count only up to the first that is good; the greatest wins, the earliest on ties."""
    w = Window.partitionBy(by).orderBy("attempt").rowsBetween(Window.unboundedPreceding, -1)
    tried = attempts.withColumn("before_", F.max("score").over(w)).where(F.coalesce("before_", F.lit(0.0)) < good)
    return tried.groupBy(by).agg(F.max_by("attempt", F.struct("score", -F.col("attempt"))).alias("attempt"), F.max("score").alias("score"))


def min_discount(offers: DataFrame, least: float) -> DataFrame:
    """Offers of at least so many per cent off; no filter at 0."""
    return offers if least <= 0 else offers.where(P.effective_discount("discountPercentage", "originalPrice", "dealPrice") >= least)


def discounted_only(offers: DataFrame, fallback: Column, floor: float = 0) -> DataFrame:
    """D3: on fallback pages only offers with an original price or a per cent of at least the floor."""
    return offers.where(~fallback | F.col("originalPrice").isNotNull() | F.coalesce(F.col("discountPercentage") >= floor, F.lit(False)))


def _dice(a: str, b: str) -> float:
    a, b = re.sub(r"\s+", "", a), re.sub(r"\s+", "", b)
    if a == b:
        return 1.0
    if len(a) < 2 or len(b) < 2:
        return 0.0
    x, y = Counter(zip(a, a[1:], strict=False)), Counter(zip(b, b[1:], strict=False))
    return 2.0 * (x & y).total() / (len(a) + len(b) - 2)


def _cluster(rows: pd.DataFrame, threshold: float, same_site: float, ratio: float) -> list[int]:
    """The group's number of each row, rows in price order; -1 for titles that are too short."""
    groups: list[dict] = []
    by_model: dict[str, list[int]] = {}
    plain: list[int] = []  # groups without model tokens, which veto nothing
    out = []
    scores: dict[tuple[str, str], float] = {}
    for norm, tokens, models, deal, site in zip(rows["norm"], rows["tokens"], rows["models"], rows["dealPrice"], rows["sourceSite"], strict=True):
        if len(norm) < 4:
            out.append(-1)
            continue
        tokens, models = frozenset(tokens), frozenset(models)
        best, best_score = None, 0.0
        near = sorted({*plain, *(k for m in models for k in by_model.get(m, ()))}) if models else range(len(groups))
        for k in near:
            g = groups[k]
            lo, hi = min(g["lo"], deal), max(g["hi"], deal)
            if lo <= 0 or hi / lo > ratio:
                continue
            pair = (norm, g["norm"])
            if pair not in scores:
                union = len(tokens | g["tokens"])
                scores[pair] = 0.5 * _dice(*pair) + 0.5 * (len(tokens & g["tokens"]) / union if union else 0.0)
            s = scores[pair] - (same_site if site in g["sites"] else 0.0)
            if s > best_score:
                best, best_score = k, s
        if best is not None and best_score >= threshold:
            g = groups[best]
            g["lo"], g["hi"] = min(g["lo"], deal), max(g["hi"], deal)
            g["sites"].add(site)
            out.append(best)
        else:
            out.append(len(groups))
            for m in models:
                by_model.setdefault(m, []).append(len(groups))
            if not models:
                plain.append(len(groups))
            groups.append({"norm": norm, "tokens": tokens, "models": models, "lo": deal, "hi": deal, "sites": {site}})
    return out


def comparison_groups(offers: DataFrame, run: list[str], threshold: float = 0.5, same_site: float = 0.15, ratio: float = 5.0) -> DataFrame:
    """the same product across shops: greedy clusters of offers in price order, with two shops at least.

    A run is one comparison (its columns `run`), of bounded size by its nature; currencies never mix, so a task
    holds one currency of one run. Titles are normalised by Spark; only the order-dependent walk is Python.
    """
    cols = [*run, "currency"]
    t = offers.withColumn("norm", X.normalize_title("title")).withColumn("tokens", X.content_tokens("norm")).withColumn("models", X.model_tokens("tokens"))
    if "productUrl" not in t.columns:
        t = t.withColumn("productUrl", F.lit(None).cast("string"))
    kept = [*cols, "ord", "title", "norm", "dealPrice", "sourceSite", "productUrl"]
    t = t.select(*kept, "tokens", "models")

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["dealPrice", "ord"], kind="stable")
        return rows.assign(grp=_cluster(rows, threshold, same_site, ratio))[[*kept, "grp"]]

    kind = {f.name: f.dataType.simpleString() for f in t.schema}
    schema = ", ".join(f"`{c}` {kind[c]}" for c in kept) + ", grp int"
    return summarize_groups(t.groupBy(cols).applyInPandas(walk, schema).where("grp >= 0"), [*cols, "grp"]).drop("grp")


def similar_titles(titles: DataFrame, by: list[str], least: float, salts: int = 8, block: int = 1024) -> DataFrame:
    """(a, b, jaccard) of the pairs of (id, tokens) within a group `by` that reach `least`.

    A token that only one title of a group has is in no intersection. Titles of as many tokens and the same others
    are therefore one kind, and what is compared are kinds. Two kinds that reach `least` share one of the rarest
    tokens of either: of n tokens, the n - ceil(least x n) + 1 rarest. Only kinds that meet in such a token are
    compared; `salts` spread a token's pairs over tasks. The members of similar kinds are told as pairs at the end,
    from lists of about `block` ids at most, so that no pair of titles is ever shuffled.
    """
    t = titles.dropna(subset=by).withColumn("tokens", F.array_distinct("tokens")).where(F.size("tokens") > 0)
    words = t.select(*by, "id", F.explode("tokens").alias("w"))
    own = words.groupBy(*by, "w").agg(F.count("*").alias("n"), F.min("id").alias("id")).where("n = 1").groupBy(*by, "id").agg(F.collect_list("w").alias("own"))
    core = F.array_sort(F.when(F.col("own").isNull(), F.col("tokens")).otherwise(F.array_except("tokens", "own")))
    t = t.join(own, [*by, "id"], "left").select(*by, "id", core.alias("core"), F.size("tokens").alias("n"))
    t = t.withColumn("kind", F.md5(F.to_json(F.struct(*by, "core", "n"))))
    kinds = t.groupBy("kind").agg(*(F.first(c).alias(c) for c in (*by, "core", "n")), F.count("*").alias("size"))
    prefix = F.size("core") - F.ceil(F.col("n") * least - 1e-9) + 1
    kinds = kinds.withColumn("prefix", prefix).where("prefix > 0")
    words = kinds.select(*by, "kind", "n", "prefix", F.explode("core").alias("w"))
    df = words.groupBy(*by, "w").agg(F.count("*").alias("df"))
    nth = F.row_number().over(Window.partitionBy("kind").orderBy("df", "w"))
    rare = words.join(df, [*by, "w"]).withColumn("k", nth).where(F.col("k") <= F.col("prefix"))
    a = rare.select(*by, "w", F.col("kind").alias("a"), F.col("n").alias("n_a"), F.pmod(F.xxhash64("kind"), F.lit(salts)).cast("int").alias("salt"))
    b = rare.select(*by, "w", F.col("kind").alias("b"), F.col("n").alias("n_b"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    near = F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * least - 1e-9
    pairs = a.join(b, [*by, "w", "salt"]).where((F.col("a") < F.col("b")) & near).select("a", "b").distinct()
    pairs = pairs.unionByName(kinds.where("size > 1").select(F.col("kind").alias("a"), F.col("kind").alias("b")))
    parts = F.ceil(F.col("size") / block).cast("int")
    for x in "ab":
        pairs = pairs.join(kinds.select(F.col("kind").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("core", "n")), parts.alias(f"parts_{x}")), x)
    shared = F.size(F.array_intersect("core_a", "core_b"))
    pairs = pairs.withColumn("jaccard", shared / (F.col("n_a") + F.col("n_b") - shared)).where(F.col("jaccard") >= least)
    # a list of each side's members; of one kind's lists, each two meet once
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
    pairs = pairs.select("a", "b", "jaccard", "parts_b", every("parts_a").alias("part_a")).select("a", "b", "jaccard", "part_a", every("parts_b").alias("part_b"))
    pairs = pairs.where("a <> b OR part_a <= part_b")
    lists = t.join(kinds.select("kind", parts.alias("parts")), "kind").groupBy("kind", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part")).agg(F.collect_list("id").alias("ids"))
    for x in "ab":
        pairs = pairs.join(lists.select(F.col("kind").alias(x), F.col("part").alias(f"part_{x}"), F.col("ids").alias(f"ids_{x}")), [x, f"part_{x}"])
    one = (F.col("a") == F.col("b")) & (F.col("part_a") == F.col("part_b"))
    pairs = pairs.select(one.alias("one"), "jaccard", "ids_b", F.explode("ids_a").alias("x")).select("one", "jaccard", "x", F.explode("ids_b").alias("y"))
    return pairs.where("x <> y AND (NOT one OR x < y)").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "jaccard")


def summarize_groups(members: DataFrame, by: list[str]) -> DataFrame:
    """The items by price, best and worst price, savings; groups of one shop go. Most savings come
    first within a run by `place`."""
    g = members.groupBy(by).agg(
        F.min_by("title", F.struct("dealPrice", "ord")).alias("representativeTitle"),
        F.min_by("norm", F.struct("dealPrice", "ord")).alias("repNorm"),
        F.countDistinct("sourceSite").alias("sites"),
        F.count("*").alias("items"),
        F.min("dealPrice").alias("bestPrice"),
        F.max("dealPrice").alias("worstPrice"),
        F.array_sort(F.collect_list(F.struct(*(F.col(c) for c in ("dealPrice", "ord", "sourceSite", "title", "productUrl") if c in members.columns)))).alias("members"),
    )
    savings = F.col("worstPrice") - F.col("bestPrice")
    pct = F.when(F.col("worstPrice") > 0, P.js_round(savings / F.col("worstPrice") * 100)).otherwise(F.lit(0)).cast("long")
    told = g.where("sites > 1").select(*by, P.make_id(F.col("repNorm")).alias("key"), "representativeTitle", "sites", "items", "bestPrice", "worstPrice", savings.alias("savings"), pct.alias("savingsPercent"), "members")
    first = F.get("members", F.lit(0))["ord"]
    return told.withColumn("place", F.row_number().over(Window.partitionBy([c for c in by if c != "grp"]).orderBy(F.desc("savings"), "bestPrice", first)))


def fingerprint(offers: DataFrame, by: list[str], title: str = "title", top: int = 20, decomposed: bool = False) -> DataFrame:
    """a listing's fingerprint: the first titles in order, each once."""
    t = offers.select(*by, X.fingerprint_title(title, decomposed).alias("t_"))
    return t.groupBy(by).agg(F.substring(F.sha1(F.array_join(F.array_distinct(F.slice(F.array_sort(F.collect_list("t_")), 1, top)), "").cast("binary")), 1, 16).alias("fingerprint"))


def listing_stats(offers: DataFrame, by: list[str], most: int = 60) -> DataFrame:
    """of a listing's first offers: count, discounted share, median per cent."""
    nth = F.row_number().over(Window.partitionBy(by).orderBy("ord"))
    discounted = F.col("originalPrice").isNotNull() | F.col("discountPercentage").isNotNull()
    return offers.withColumn("n_", nth).where(F.col("n_") <= most).groupBy(by).agg(
        F.count("*").alias("productCount"), F.avg(F.when(discounted, 1.0).otherwise(0.0)).alias("dealDensity"), F.median("discountPercentage").cast("double").alias("medianDiscountPct")
    )


def same_listings(fingerprints: DataFrame, by: list[str], url: str = "url", tokens: str = "tokens", score: str = "score", overlap: float = 0.8) -> DataFrame:
    """In score order, drop a listing that overlaps a kept one by 0.8 of their titles. A group is one
    site's candidates, a bounded list."""

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([score, url], ascending=[False, True], kind="stable")
        kept: list[tuple[str, set]] = []
        into = []
        for u, t in zip(rows[url], rows[tokens], strict=True):
            t = set(t)
            hit = next((k for k, s in kept if s and t and len(s & t) / len(s | t) >= overlap), None)
            into.append(hit)
            if hit is None:
                kept.append((u, t))
        return rows[[*by, url]].assign(duplicate_of=into)

    kind = {f.name: f.dataType.simpleString() for f in fingerprints.schema}
    return fingerprints.groupBy(by).applyInPandas(walk, ", ".join(f"`{c}` {kind[c]}" for c in (*by, url)) + ", duplicate_of string")
