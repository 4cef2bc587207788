"""Links of a page with the region they stand in, and the next page of a listing."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from offerlens.functions import url as U
from offerlens.html.extract import resolve
from offerlens.html.tree import Tree, clean, parse

# What marks a region, and a next-page link.
REGIONS = [("footer", 'footer, [class*="footer" i]'), ("nav", 'header, nav, [role="navigation"], [class*="menu" i], [class*="nav" i]'), ("hero", '[class*="banner" i], [class*="hero" i], [class*="slider" i], [class*="carousel" i]')]
RANK = {"nav": 3, "hero": 2, "body": 1, "footer": 0}
NEXT = re.compile(r"^(next|next\s*[›»→]?|[›»→]|পরবর্তী|পরের\s*পাতা)$", re.IGNORECASE)
PAGE_NUMBER = re.compile(r"[?&](?:page|p|pageNo|pageNumber)=(\d+)", re.IGNORECASE)
PAGE_PATH = re.compile(r"/page/(\d+)(?:[/?]|$)")
MOST_ANCHORS = 800


def region(t: Tree, i: int) -> str:
    """Of the nearest ancestor that marks one."""
    return next((name for a in t.ancestors(i) for name, s in REGIONS if t.matches(a, s)), "body")


def links(html: str, url: str):
    """(ord, absolute href, region, anchor text, title text) of the first anchors."""
    t = parse(html)
    for n, i in enumerate(t.all("a[href]")[:MOST_ANCHORS]):
        to = resolve(t.attrs[i]["href"].strip(), url)
        if not to or not re.match(r"(?i)https?://", to):
            continue
        image = t.first("img[alt]", i)
        title = clean(t.attrs[i].get("title", "")) or clean(t.attrs[i].get("aria-label", "")) or clean(t.get(image, "alt") or "")
        yield n, to, region(t, i), clean(t.text(i)) or None, title or None


@udtf(returnType="ord int, href string, region string, anchorText string, titleText string")
class HarvestLinks:
    def eval(self, html: str, url: str):
        yield from links(html or "", url or "")


def harvest(pages: DataFrame, keep: list[str]) -> DataFrame:
    """Each page's links by canonical URL: best region, first labels, whether in both nav and footer."""
    narrow = pages.select(*keep, F.col("html").alias("html_in"), F.col("url").alias("url_in"))
    raw = narrow.lateralJoin(HarvestLinks(F.col("html_in").outer(), F.col("url_in").outer())).drop("html_in", "url_in")
    return best_links(raw.withColumn("url", U.canonicalize("href")).where("url is not null"), keep)


def best_links(raw: DataFrame, by: list[str]) -> DataFrame:
    rank = F.lit(0)
    for name, r in RANK.items():
        rank = F.when(F.col("region") == name, r).otherwise(rank)
    at = F.col("ord")
    return raw.withColumn("rank_", rank).groupBy(*by, "url").agg(
        F.min("ord").alias("ord"),
        F.max_by("region", F.struct("rank_", -at)).alias("source"),
        F.min_by("anchorText", F.when(F.col("anchorText").isNotNull(), at)).alias("anchorText"),
        F.min_by("titleText", F.when(F.col("titleText").isNotNull(), at)).alias("titleText"),
        (F.bool_or(F.col("region") == "nav") & F.bool_or(F.col("region") == "footer")).alias("inNavAndFooter"),
    )


def next_page(html: str, url: str) -> str | None:
    """rel=next, a next caption in a pager, or the link with the next page's number.

    A next caption that is disabled means the last page and rules the number out.
    """
    t = parse(html)
    to = lambda i: (x := resolve(t.attrs[i].get("href"), url)) and re.match(r"(?i)https?://", x) and x or None
    rel = t.first('a[rel="next"][href]')
    if rel is not None and to(rel) and to(rel) != url:
        return to(rel)
    caption = lambda i: bool(NEXT.match(x := clean(t.text(i)))) and len(x) <= 20
    off = lambda i: bool(re.search("disabled|inactive", f"{t.get(i, 'class') or ''} {t.get(t.parent[i], 'class') or ''}", re.IGNORECASE))
    dead = lambda i: (h := t.attrs[i].get("href") or "") in ("", "#") or h.startswith("javascript:")
    for i in t.all('[class*="pagination" i] a[href], [class*="pager" i] a[href], nav a[href]'):
        if caption(i) and not off(i) and not dead(i) and to(i) and to(i) != url:
            return to(i)
    for i in t.all('[class*="pagination" i] a, [class*="pager" i] a, nav a, [class*="pagination" i] span, [class*="pager" i] span'):
        navigable = not dead(i) and to(i) != url
        if NEXT.match(clean(t.text(i))) and (off(i) or (t.get(i, "aria-disabled") == "true" and not navigable)):
            return None
    now = PAGE_NUMBER.search(url)
    wanted = int(now[1]) + 1 if now else 2
    for i in t.all("a[href]"):
        full = to(i)
        if full and full != url and (m := PAGE_NUMBER.search(full) or PAGE_PATH.search(full)) and int(m[1]) == wanted:
            return full
    return None
