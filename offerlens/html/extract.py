"""The extraction ladder: offers of a page from declared data, cards and structure, as a Spark table function."""

from __future__ import annotations

import hashlib
import json
import re
from urllib.parse import urljoin, urlsplit

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from offerlens.functions import price as P
from offerlens.html import jsondata as J
from offerlens.html import prices as R
from offerlens.html.tree import Tree, clean, parse

# Selector banks and the tells of a card's parts.
CARDS = [
    '[itemtype*="Product"]', "[data-product]", "[data-product-id]", ".product", ".product-card", ".productCard", ".product-item", ".product-box", ".product-tile", '[class*="product-card"]', '[class*="productCard"]',
    '[class*="product-item"]', '[class*="productItem"]', '[class*="product-tile"]', '[class*="ProductCard"]', '[class*="product-block"]', 'li[class*="product"]', '[class*="product-"]', '[class*="product_"]',
    '[class*="productV2"]', '[class*="productPane"]',
]
TITLES = ["h1", "h2", "h3", "h4", '[class*="title"]', '[class*="Title"]', '[class*="name"]', '[class*="Name"]', ".product-title", ".product-name"]
ORIGINAL_HOST = (
    'del, s, strike, [class*="old"], [class*="Old"], [class*="regular"], [class*="Regular"], [class*="mrp"], [class*="MRP"], [class*="compare"], [class*="was"], [class*="Was"], [class*="origin"], [class*="Origin"], '
    '[class*="discounted"] [class*="price"], [style*="line-through"], [class*="line-through"]'
)
DEAL_HOST = '[class*="price"], [class*="Price"], [class*="amount"], [class*="Amount"], [class*="sale"], [class*="Sale"], [class*="offer"], [class*="Offer"], ins'
DISCOUNT_HOST = '[class*="discount"], [class*="Discount"], [class*="off"], [class*="Off"], [class*="badge"], [class*="Badge"]'
NO_PRICE_HOST = '[class*="emi" i], [id*="emi" i], [class*="install" i], [id*="install" i], [class*="sold" i], [id*="sold" i], [class*="discount" i], [class*="badge" i]'
STRUCT_PRICE = re.compile(r"(?:৳|Tk\.?|BDT|Rs\.?|INR|RM|Rp|AED|SAR|USD|EUR|GBP|\$|€|£|₹|₨)\s*[\d,]{2,}", re.IGNORECASE)
CALLS = re.compile(r"^(buy now|add to cart|order now|shop now|quick view|view|details|checkout|কিনুন|অর্ডার করুন|বিস্তারিত|কার্ট)\.?$", re.IGNORECASE)
_price_text, _badge = re.compile(P.PRICE_TEXT), re.compile(P.BADGE)
CARD_TEXT, CARD_PRICES, CLIMB, MOST = 400, 6, 6, 200
RUNGS = ["json-ld", "microdata", "opengraph", "embedded-json", "dom", "structure"]


def resolve(href: str | None, base: str) -> str | None:
    if not href:
        return None
    try:
        out = urljoin(base, href.strip())
        parts = urlsplit(out)
    except ValueError:
        return None
    return out + "/" if parts.scheme in ("http", "https") and not parts.path and not parts.query else out or None


class Page:
    """One parsed page and its rungs; every rung gives offers as dictionaries."""

    def __init__(self, html: str, url: str, site: str, cards: list[str] | None = None):
        self.t: Tree = parse(html)
        self.url, self.site = url, site
        self.cards = [*(cards or []), *CARDS]
        self.winner: str | None = None

    def offer(self, title, deal, currency, link=None, image=None, original=None, pct=None) -> dict | None:
        if not title or len(title) < 4 or deal is None or deal < P.LEAST_DEAL:
            return None
        link = link or self.url
        key = hashlib.sha1("|".join((self.site, link, title)).encode()).hexdigest()[:12]
        return {"id": key, "title": title, "originalPrice": original, "dealPrice": deal, "discountPercentage": pct, "currency": currency, "sourceSite": self.site, "productUrl": link, "imageUrl": image}

    # declared data

    def json_ld(self):
        for i in self.t.all('script[type="application/ld+json"]'):
            try:
                data = json.loads(self.t.text(i))
            except (ValueError, RecursionError):
                continue
            for o in J.ld_products(data):
                price, currency = J.ld_price(o.get("offers"))
                image = o.get("image")
                image = image[0] if isinstance(image, list) and image else image
                if isinstance(image, dict):
                    image = image.get("url") or image.get("contentUrl")
                title = clean(o["name"]) if isinstance(o.get("name"), str) else None
                link = o.get("url") if isinstance(o.get("url"), str) else None
                yield self.offer(title, R.price(price), currency.upper() if currency else R.currency(price), resolve(link, self.url), resolve(image if isinstance(image, str) else None, self.url))

    def microdata(self):
        t = self.t
        for card in t.all('[itemtype*="Product"]'):
            prop = lambda name, c=card: t.first(f'[itemprop="{name}"]', c)

            def value(name, *attrs):
                i = prop(name)
                if i is None:
                    return ""
                return clean(next((t.attrs[i][a] for a in attrs if a in t.attrs[i]), None) or t.text(i))

            image, currency = prop("image"), value("priceCurrency", "content", "href")
            src = next((t.attrs[image][a] for a in ("src", "content", "href") if a in t.attrs[image]), None) if image is not None else None
            price = value("price", "content", "href")
            yield self.offer(value("name", "content", "href"), R.price(price), currency.upper() or R.currency(price), resolve(value("url", "href", "content") or None, self.url), resolve(src, self.url))

    def opengraph(self):
        def meta(*names):
            for n in names:
                i = self.t.first(f'meta[property="{n}"], meta[name="{n}"]')
                if i is not None and "content" in self.t.attrs[i]:
                    return self.t.attrs[i]["content"]
            return None

        currency = meta("product:price:currency", "og:price:currency") or P.DEFAULT_CURRENCY
        yield self.offer(clean(meta("og:title") or ""), R.price(meta("product:price:amount", "og:price:amount")), currency.upper(), resolve(meta("og:url"), self.url), resolve(meta("og:image"), self.url))

    def embedded_json(self):
        for _, data in J.sources(self.t):
            yield from self.json_offers(data)

    def json_offers(self, data):
        """Offers of product objects in any JSON value, each (title, price) once."""
        named = lambda o: isinstance(n := J.first(o, J.NAME), str) and len(n.strip()) > 3
        seen = set()
        for o in J.product_objects(data, lambda o: named(o) and R.price(J.first(o, J.DEAL)) is not None):
            deal, original = R.price(J.first(o, J.DEAL)), R.price(J.first(o, J.ORIGINAL))
            original = original if original and deal and original > deal else None
            image = J.first(o, J.IMAGE)
            image = image[0] if isinstance(image, list) and image else image
            if isinstance(image, dict):
                image = image.get("url") or image.get("src") or image.get("href")
            stated = R.price(J.first(o, J.DISCOUNT))
            pct = int(stated + 0.5) if stated and 0 < stated <= 95 else R.discount(original, deal)
            text = next((v for v in (J.first(o, J.DEAL), J.first(o, J.ORIGINAL)) if isinstance(v, str)), "")
            link = J.first(o, J.URL)
            p = self.offer(clean(J.first(o, J.NAME)), deal, R.currency(text), resolve(link if isinstance(link, str) else None, self.url), resolve(image if isinstance(image, str) else None, self.url), original, pct)
            if p and (k := (p["title"].lower(), deal)) not in seen:
                seen.add(k)
                yield p

    # cards

    def title_of(self, card: int) -> str | None:
        t = self.t
        for s in TITLES:
            i = t.first(s, card)
            if i is not None and 4 <= len(x := clean(t.text(i))) <= 220:
                return x
        for s, a in (("img[alt]", "alt"), ("a[title]", "title")):
            i = t.first(s, card)
            if i is not None and len(x := clean(t.attrs[i][a])) >= 4:
                return x
        return None

    def link_of(self, card: int) -> str | None:
        t = self.t
        inner = lambda i: resolve(t.get(t.first("a[href]", i), "href"), self.url)
        own = resolve(t.get(card, "href"), self.url) if t.tag[card] == "a" else None
        around = next((resolve(t.attrs[i]["href"], self.url) for i in t.ancestors(card) if t.tag[i] == "a" and "href" in t.attrs[i]), None)
        near = (inner(i) for _, i in zip(range(3), t.ancestors(card), strict=False))
        return own or inner(card) or around or next((x for x in near if x), None)

    def image_of(self, card: int) -> str | None:
        t = self.t
        for i in [card, *(a for _, a in zip(range(2), t.ancestors(card), strict=False))]:
            img = t.first("img", i)
            if img is not None:
                a = t.attrs[img]
                sets = a.get("srcset", "").split(",")[0].strip().split(" ")[0]
                src = next((a[k] for k in ("src", "data-src", "data-lazy-src", "data-original", "data-srcset") if k in a), sets)
                if src and not re.search(r"data:image|placeholder|blank\.gif|loading\.gif", src, re.IGNORECASE):
                    return resolve(src, self.url)
        return None

    def discount_of(self, card: int) -> int | None:
        m = _badge.search(clean("".join(self.t.text(i) for i in self.t.all(DISCOUNT_HOST, card))))
        return int(m[1]) if m else None

    def prices_of(self, card: int) -> tuple[float | None, float | None, str]:
        t = self.t
        old = [n for i in t.all(ORIGINAL_HOST, card) for n in R.price_amounts(clean(t.text(i)))]
        deals, sample = [], ""
        for i in t.all(DEAL_HOST, card):
            if re.search("emi|install|sold", f"{t.get(i, 'id') or ''} {t.get(i, 'class') or ''}", re.IGNORECASE):
                continue
            x = clean(t.text(i))
            sample = sample or (x if _price_text.search(x) else "")
            deals += R.price_amounts(x)
        if not deals:
            without = [(i, t.end[i]) for i in t.all(NO_PRICE_HOST, card)]
            x = clean("".join(s for e, _, s in t.texts if card <= e < t.end[card] and not any(a <= e < b for a, b in without)))
            if _price_text.search(x):
                deals, sample = R.price_amounts(x), x
        deal = min(deals, default=None)
        return deal, min((n for n in old if deal is None or n > deal), default=None), R.currency(sample)

    def dom(self):
        t = self.t
        by: dict[int, str] = {}
        for s in self.cards:
            try:
                for i in t.all(s):
                    by.setdefault(i, s)
            except ValueError:  # a learned selector that is none
                continue
        found = sorted(by)
        if not found:
            found = [i for i in t.all("a[href]") if t.first("img", i) is not None and _price_text.search(t.text(i))]
        inner = {c: sum(c < o < t.end[c] for o in found) for c in found} if by else dict.fromkeys(found, 0)
        # the innermost first; a card that yields an offer blocks what it stands in
        order = sorted(found, key=lambda c: (inner[c], list(by).index(c) if c in by else c))
        blocked: set[int] = set()
        wins: dict[str, int] = {}
        for c in order:
            if c in blocked:
                continue
            deal, original, currency = self.prices_of(c)
            pct = self.discount_of(c)
            p = self.offer(self.title_of(c), deal, currency, self.link_of(c), self.image_of(c), original, pct if pct is not None or deal is None else R.discount(original, deal))
            if p:
                if c in by:
                    wins[by[c]] = wins.get(by[c], 0) + 1
                blocked.update(t.ancestors(c))
                yield p
        self.winner = max(wins, key=wins.get) if wins else None

    def structure(self):
        """Cards inferred from prices: from each price leaf up to the last ancestor that still has a card's size."""
        t = self.t
        body = t.first("body") or 0
        leaf = [i for i in range(body + 1, t.end[body]) if 3 <= len(x := t.own_text(i)) <= 60 and STRUCT_PRICE.search(x)]
        if len(leaf) < 2:
            return
        cards = set()
        for i in leaf:
            card, up = None, t.parent[i]
            for _ in range(CLIMB):
                if up <= 0 or t.tag[up] in ("body", "html") or len(clean(t.text(up))) > CARD_TEXT or sum(up < k < t.end[up] for k in leaf) > CARD_PRICES:
                    break
                card, up = up, t.parent[up]
            if card is not None:
                cards.add(card)
        blocked: set[int] = set()
        for c in sorted(cards, key=lambda c: (t.end[c] - c, c)):
            if c in blocked or not (t.tag[c] == "a" or t.first("img, a[href]", c) is not None):
                continue
            own = [k for k in leaf if c < k < t.end[c]]
            found = [n for k in own for n in R.anchored(t.own_text(k))]
            deal = min(found, default=None)
            if deal is None:
                continue
            original, pct = min((n for n in found if n > deal), default=None), self.discount_of(c)
            p = self.offer(self.title_of(c) or self.inline_title(c), deal, R.currency(t.own_text(own[0])), self.link_of(c), self.image_of(c), original, pct if pct is not None else R.discount(original, deal))
            if p:
                blocked.update(t.ancestors(c))
                yield p

    def inline_title(self, card: int) -> str | None:
        own = (self.t.own_text(i) for i in range(card + 1, self.t.end[card]))
        return max((x for x in own if 8 <= len(x) <= 220 and not STRUCT_PRICE.search(x) and not CALLS.match(x)), key=len, default=None)

    def ladder(self):
        """(rung, offer) of the five declared and card rungs; of structure only if those have none."""
        any_one = False
        for name in RUNGS[:5]:
            n = 0
            for p in getattr(self, name.replace("-", "_"))():
                if p and n < MOST:
                    any_one, n = True, n + 1
                    yield name, p
        if not any_one:
            for n, p in enumerate(self.structure()):
                if n < MOST:
                    yield "structure", p


OFFER = "id string, title string, originalPrice double, dealPrice double, discountPercentage int, currency string, sourceSite string, productUrl string, imageUrl string"


@udtf(returnType=f"rung string, ord int, {OFFER}, selector string")
class ExtractOffers:
    """extract_offers(html, url, site): every rung's offers of a page, before they are merged."""

    def eval(self, html: str, url: str, site: str):
        page = Page(html or "", url or "", site or "")
        for n, (rung, p) in enumerate(list(page.ladder())):
            yield rung, n, *p.values(), page.winner


def extract_offers(pages: DataFrame, keep: list[str]) -> DataFrame:
    """Pages (html, url, site and the columns to keep) to one row for each rung's offer, in ladder order."""
    spark = pages.sparkSession
    spark.udtf.register("offerlens_extract_offers", ExtractOffers)
    narrow = pages.select(*keep, *(F.col(c).alias(f"{c}_in") for c in ("html", "url", "site")))
    return narrow.lateralJoin(ExtractOffers(F.col("html_in").outer(), F.col("url_in").outer(), F.col("site_in").outer())).drop("html_in", "url_in", "site_in")
