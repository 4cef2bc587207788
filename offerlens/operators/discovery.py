"""Page discovery over all sites at once: candidates, checks, the frontier walk of each site, selection."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from offerlens.functions import page as G
from offerlens.functions import url as U

MOST_CANDIDATES, MOST_CHECKS, MOST_SELECTED = 120, 6, 3
HUB_PRODUCTS, HUB_LEAST, HUB_LINKS, HUB_MOST, HUB_DECAY = 8, 0.6, 3, 9, 0.7
ENOUGH_PRIOR, ENOUGH_COUNT, DEMOTED_CAP = 0.55, 4, 0.49
FALLBACK_TRIES = 3
SITEMAP_PRIOR, MOST_SITEMAP_PAGES = 0.4, 200
MOST_FETCHES, SAME_LISTING = 20, 0.8


def intake(raw: DataFrame, root: Column, month: Column | int, excluded: DataFrame | None = None, include: list[str] = (), exclude: list[str] = (), now_ms: Column | None = None) -> DataFrame:
    """Raw candidates (site, url, source, anchorText, titleText) of one site with prior and reject.

    With a column lastmodMs and a time, pages changed of late gain. Other sites' pages and excluded ones go silently; a user's exclusion is a visible reject, a user's
    inclusion has prior 1 and source user.
    """
    rows = raw.where(U.same_site(F.col("url"), root))
    if excluded is not None:
        rows = rows.join(excluded.select("url").distinct(), "url", "left_anti")
    pinned, banned = U.first_pattern(list(include), "url"), U.first_pattern(list(exclude), "url")
    p = G.candidate_prior(F.col("url"), F.col("source"), F.col("anchorText"), F.col("titleText"), month, F.col("lastmodMs") if "lastmodMs" in raw.columns else None, now_ms)
    return rows.withColumn("p_", p).withColumn("pin_", pinned).withColumn("ban_", banned).select(
        *(c for c in rows.columns if c != "source"),
        F.when(F.col("pin_").isNotNull() & F.col("ban_").isNull(), "user").otherwise(F.col("source")).alias("source"),
        F.when(F.col("ban_").isNotNull(), F.lit(0.0)).when(F.col("pin_").isNotNull(), F.lit(1.0)).otherwise(F.col("p_.score")).alias("prior"),
        F.when(F.col("ban_").isNotNull(), F.concat(F.lit("user-excluded:"), "ban_")).when(F.col("pin_").isNull(), F.col("p_.reject")).alias("reject"),
    )


def best_candidates(scored: DataFrame, cap: int = MOST_CANDIDATES) -> DataFrame:
    """Each site's candidates by URL, the higher prior (the first on ties), the first `cap` URLs."""
    best = scored.where("reject is null").groupBy("site", "url").agg(F.max_by(F.struct("source", "prior"), F.struct("prior", -F.col("ord"))).alias("b"), F.min("ord").alias("ord"))
    nth = F.row_number().over(Window.partitionBy("site").orderBy("ord", "url"))
    return best.withColumn("n_", nth).where(F.col("n_") <= cap).select("site", "url", "ord", "b.source", "b.prior")


def sitemap_pages(scored: DataFrame, most: int = MOST_SITEMAP_PAGES) -> DataFrame:
    """Of the pages listed in sitemaps (site, place, ord, prior, reject) those with keywords, the first of a site."""
    rows = scored.where(F.col("reject").isNull() & (F.col("prior") > SITEMAP_PRIOR))
    nth = F.row_number().over(Window.partitionBy("site").orderBy("place", "ord"))
    return rows.withColumn("n_", nth).where(F.col("n_") <= most).drop("n_")


def by_tier(scored: DataFrame) -> DataFrame:
    """Scored candidates (site, url, tier, prior, reject) without the tiers that are not asked: tier 0 is
    free, a later one is asked only of sites whose earlier tiers gave fewer than four strong candidates."""
    strong = scored.where(F.col("reject").isNull() & (F.col("prior") >= ENOUGH_PRIOR)).groupBy("site", "url").agg(F.min("tier").alias("tier"))
    counts = strong.groupBy("site", "tier").agg(F.count("*").alias("n"))
    so_far = F.sum("n").over(Window.partitionBy("site").orderBy("tier"))
    full = counts.withColumn("so_far", so_far).where(F.col("so_far") >= ENOUGH_COUNT).groupBy("site").agg(F.min("tier").alias("full_"))
    return scored.join(full, "site", "left").where(F.col("full_").isNull() | (F.col("tier") <= F.col("full_"))).select(*scored.columns)


def _walk(site: str, cands: pd.DataFrame, checks: pd.DataFrame, links: pd.DataFrame) -> list[tuple]:
    """Pop by prior, check within the budget, take in a small hub's links, collapse listings of the
    same products, rank, fall back."""
    known = {r.url: r for r in checks.itertuples()}
    below: dict[str, list] = {}
    for r in links.sort_values(["prior", "ord"], ascending=[False, True], kind="stable").itertuples():
        below.setdefault(r.hub, []).append(r)
    # (url, source, prior, depth), in order of arrival
    frontier = [(r.url, r.source, float(r.prior), 0) for r in cands.sort_values(["ord", "url"]).itertuples()]
    seen = {u for u, *_ in frontier}
    done: list[dict] = []
    spent = 0 if cands["spent"].isna().all() else int(cands["spent"].max())
    while frontier and len(done) < MOST_CHECKS and spent + len(done) < MOST_FETCHES:
        k = max(range(len(frontier)), key=lambda i: (frontier[i][2], -i))
        url, source, prior, depth = frontier.pop(k)
        c = known.get(url)
        if c is None:
            done.append({"url": url, "source": source, "prior": prior, "final": None, "reason": "fetch-failed", "depth": depth})
            continue
        reason = None if pd.isna(c.reason) else c.reason
        final = min(1.0, max(0.0, 0.35 * prior + 0.3 * min(1.0, c.productCount / 40) + 0.2 * c.density + 0.15 * c.quality + (0.05 if c.countdown else 0.0)))
        if c.productCount >= 3 and (c.density >= 0.05 or prior >= 0.75):
            strong = c.productCount >= 8 and c.quality >= 0.35 and (c.density >= 0.30 or c.countdown or prior >= 0.80)
            reason = reason or (None if strong else "demoted")
        else:
            reason = reason or ("not-a-listing" if c.productCount < 3 else "no-discounts")
        done.append({"url": url, "source": source, "prior": prior, "final": min(final, DEMOTED_CAP) if reason == "demoted" else final, "reason": reason, "depth": depth})
        if depth < 1 and reason in (None, "demoted", "not-a-listing") and c.productCount <= HUB_PRODUCTS:
            fresh = [r for r in below.get(url, []) if r.prior >= HUB_LEAST and r.url not in seen]
            if len(fresh) >= HUB_LINKS:
                for r in fresh[:HUB_MOST]:
                    seen.add(r.url)
                    frontier.append((r.url, "expanded", float(r.prior) * HUB_DECAY, depth + 1))
    ranked: list[dict] = []
    kept: list[tuple[str, set]] = []
    for d in sorted((d for d in done if d["reason"] in (None, "demoted")), key=lambda d: -(d["final"] or 0)):
        titles = set(known[d["url"]].titles if known[d["url"]].titles is not None else ())
        same = next((u for u, t in kept if t and titles and len(t & titles) / len(t | titles) >= SAME_LISTING), None)
        if same is not None:
            d["reason"] = f"duplicate-of:{same}"
            continue
        kept.append((d["url"], titles))
        ranked.append(d)
    ranked = ranked[:MOST_SELECTED]
    if not ranked:  # the strongest unchecked regions, flagged
        order = {"nav": 0, "hero": 1, "body": 2, "footer": 3}
        pool = sorted((f for f in frontier if f[1] in order), key=lambda f: (order[f[1]], -f[2]))
        for url, _, prior, depth in pool[:FALLBACK_TRIES]:
            c = known.get(url)
            if c is not None and c.productCount >= 3:
                ranked = [{"url": url, "source": "body", "prior": prior, "final": min(DEMOTED_CAP, prior), "reason": "fallback", "depth": depth}]
                done.append(ranked[0])
                break
    place = {d["url"]: n for n, d in enumerate(ranked, 1)}
    return [(site, d["url"], d["source"], d["prior"], d["final"], d["reason"], d["depth"], place.get(d["url"])) for d in done]


SELECTED = "site string, url string, source string, prior double, finalScore double, reason string, depth int, rank int"


def select_pages(candidates: DataFrame, checks: DataFrame, links: DataFrame) -> DataFrame:
    """Which pages of each site list deals.

    candidates: site, url, ord, source, prior (at most MOST_CANDIDATES a site), and spent, if given: the fetches a
    site's earlier tiers took of its MOST_FETCHES. checks: site, url, productCount, density, quality, countdown,
    reason (blocked or null), and titles, if given: the fingerprint titles of its products, at most 60. links:
    site, hub, url, ord, prior. The walk is sequential within a site and independent across sites; only pages a
    walk could reach are handed to it.
    """
    if "titles" not in checks.columns:
        checks = checks.withColumn("titles", F.lit(None).cast("array<string>"))
    if "spent" not in candidates.columns:
        candidates = candidates.withColumn("spent", F.lit(0))
    reach = candidates.select("site", "url").unionByName(links.select("site", "url")).distinct()
    checks = checks.join(reach, ["site", "url"], "left_semi")
    nth = F.row_number().over(Window.partitionBy("site", "hub").orderBy(F.desc("prior"), "ord"))
    links = links.where(F.col("prior") >= HUB_LEAST).withColumn("n_", nth).where(F.col("n_") <= HUB_MOST + MOST_CANDIDATES).drop("n_")
    none = lambda t: F.lit(None).cast(t)
    rows = (
        candidates.select("site", F.lit("c").alias("k"), "url", "ord", "source", "prior", none("string").alias("hub"), none("long").alias("productCount"), none("double").alias("density"), none("double").alias("quality"), none("boolean").alias("countdown"), none("string").alias("reason"), none("array<string>").alias("titles"), "spent")
        .unionByName(checks.select("site", F.lit("v").alias("k"), "url", "productCount", "density", "quality", "countdown", "reason", "titles"), allowMissingColumns=True)
        .unionByName(links.select("site", F.lit("l").alias("k"), "hub", "url", "ord", "prior"), allowMissingColumns=True)
    )

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        part = {k: rows[rows["k"] == k] for k in "cvl"}
        out = _walk(rows["site"].iloc[0], part["c"], part["v"], part["l"])
        return pd.DataFrame(out, columns=[c.split()[0] for c in SELECTED.split(", ")]).astype({"rank": "Int32", "depth": "int32"})

    return rows.groupBy("site").applyInPandas(walk, SELECTED)


def warm_start(saved: DataFrame, checks: DataFrame, now: int, pins: DataFrame | None = None) -> DataFrame:
    """Whether a site's saved pages still answer: at least half of the first six, and every pin saved.

    saved: site, url, status, nextCheckAt, fingerprint. checks: url, reason, fingerprint. pins: site, url.
    """
    s = saved.where(F.col("status").isin("pinned", "active") | ((F.col("status") == "stale") & (F.col("nextCheckAt") <= now)))
    s = s.withColumn("n_", F.row_number().over(Window.partitionBy("site").orderBy(F.coalesce("nextCheckAt", F.lit(0)), "url")))
    c = checks.select("url", "reason", F.col("fingerprint").alias("new_"))
    first = F.col("n_") <= MOST_CHECKS
    rows = s.join(c, "url", "left").withColumn("alive", first & F.col("new_").isNotNull() & F.col("reason").isNull()).withColumn("changed", ~F.col("fingerprint").eqNullSafe(F.col("new_")))
    out = rows.groupBy("site").agg(F.count("*").alias("saved"), F.count_if(first).alias("checked"), F.count_if("alive").alias("alive"), F.count_if(F.col("alive") & F.col("changed")).alias("changed"))
    missing = pins.join(s.select("site", "url"), ["site", "url"], "left_anti").groupBy("site").agg(F.count("*").alias("missing")) if pins is not None else None
    out = out.join(missing, "site", "left") if missing is not None else out.withColumn("missing", F.lit(0))
    return out.select("site", "saved", "checked", "alive", "changed", ((F.col("alive") > 0) & (F.col("alive") * 2 >= F.col("checked")) & (F.coalesce("missing", F.lit(0)) == 0)).alias("warm"))


def precision_at(selected: DataFrame, truth: DataFrame, k: int = 5) -> DataFrame:
    """of each site: hits among its first k, and whether all true pages are selected."""
    top = selected.where(F.col("rank") <= k).join(truth.select("site", "url").distinct().withColumn("hit_", F.lit(1)), ["site", "url"], "left")
    per = top.groupBy("site").agg((F.count("hit_") / F.least(F.lit(k), F.count("*"))).alias("precision"), F.count("hit_").alias("hits"))
    wanted = truth.groupBy("site").agg(F.countDistinct("url").alias("wanted"))
    return wanted.join(per, "site", "left").select("site", F.coalesce("precision", F.lit(0.0)).alias("precision"), (F.coalesce("hits", F.lit(0)) == F.col("wanted")).alias("full_recall"))


def reports(attempts: DataFrame) -> DataFrame:
    """Blocked only if a page gave no products and looks like a wall, else ok."""
    return attempts.select("*", F.when((F.col("productCount") == 0) & F.col("blockReason").isNotNull(), "blocked").otherwise("ok").alias("status"))


def route(targets: DataFrame, mode: str = "auto") -> DataFrame:
    """Front pages go to discovery, once for each site (the first one); the rest are read as they are.

    In mode always every page goes to discovery and is read as well; in mode never all are only read.
    """
    site = U.registrable_domain(U.host("url"))
    found = {"always": site.isNotNull(), "never": F.lit(False)}.get(mode, U.is_root("url") & site.isNotNull())
    ways = F.array_compact(F.array(F.when(found, "discover"), F.when(F.lit(mode == "always") | ~found, "direct")))
    rows = targets.withColumn("site", site).withColumn("route", F.explode(ways))
    first = F.row_number().over(Window.partitionBy("route", F.when(F.col("route") == "discover", F.col("site")).otherwise(F.col("url"))).orderBy("ord"))
    return rows.withColumn("n_", first).where("n_ = 1").drop("n_")


def all_targets(direct: DataFrame, found: DataFrame) -> DataFrame:
    """Direct pages (url, ord), then discovered ones (url, ord) that are not among them, each once, in order."""
    rows = direct.select("url", F.lit(0).alias("way"), "ord").unionByName(found.select("url", F.lit(1).alias("way"), "ord"))
    once = rows.groupBy("url").agg(F.min(F.struct("way", "ord")).alias("o"))
    return once.select("url", F.when(F.col("o.way") == 0, "direct").otherwise("discovered").alias("route"), F.col("o.ord").alias("ord"))


def provenance(reports: DataFrame, found: DataFrame, key: str = "key") -> DataFrame:
    """Reports with discoveredFrom and candidateScore of the first discovery of their page, by its canonical URL;
    what they hold stays."""
    told = ("discoveredFrom", "candidateScore")
    f = found.groupBy(F.col("url").alias(key)).agg(F.min_by(F.struct(*told), "ord").alias("f_"))
    rows = reports.join(f, key, "left")
    for c in told:
        rows = rows.withColumn(c, F.coalesce(c, f"f_.{c}") if c in reports.columns else F.col(f"f_.{c}"))
    return rows.drop("f_")
